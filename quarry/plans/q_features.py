"""Registered feature-engineering and model queries (loan-like stand-in)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import association as asc, features as fe, model as md
from quarry.plans import loan_job, loan_model
from quarry.plans.q_profile import LOAN, features_chi_sql
from quarry.plans.registry import query
from quarry.sources.standins import Tables, loan_table

INDEXED = ["lang", "source", "quality"]


@query("derived_sum", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_tax, 6) AS total FROM lineitem
""")
def q_derived_sum(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")
    d = fe.derived_sum(li, "l_extendedprice", "l_tax", "total")
    return d.select("l_orderkey", "l_linenumber", F.round("total", 6).alias("total"))


@query("cast_to_string", LOAN + "SELECT doc_id, CAST(toxic AS VARCHAR) AS toxic_str FROM loan")
def q_cast_to_string(spark, sf):
    return loan_table(Tables(spark, sf)).select("doc_id", F.col("toxic").cast("string")
                                                .alias("toxic_str"))


@query("impute_mean", LOAN + """
SELECT doc_id, round(coalesce(CAST(toxic AS DOUBLE), (SELECT avg(toxic) FROM loan)), 6) AS toxic_imp
FROM loan
""")
def q_impute_mean(spark, sf):
    d = fe.impute(loan_table(Tables(spark, sf)).select("doc_id", "toxic"), ["toxic"], "mean")
    return d.select("doc_id", F.round("toxic_imp", 6).alias("toxic_imp"))


def _mode_sql(c):
    return (f"coalesce(CAST({c} AS DOUBLE), (SELECT CAST({c} AS DOUBLE) FROM loan WHERE {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}_imp")


@query("impute_mode", LOAN + f"SELECT doc_id, {_mode_sql('toxic')}, {_mode_sql('quality')} FROM loan")
def q_impute_mode(spark, sf):
    d = fe.impute(loan_table(Tables(spark, sf)).select("doc_id", "toxic", "quality"),
                  ["toxic", "quality"], "mode")
    return d.select("doc_id", "toxic_imp", "quality_imp")


@query("quartile_bins", LOAN + """
, x AS (SELECT doc_id, ln(1 + n_chars) AS v FROM loan)
, t AS (SELECT quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.5) AS q2,
               quantile_disc(v, 0.75) AS q3, max(v) AS mx FROM x)
SELECT doc_id, CASE WHEN v <= q1 THEN 'min-Q1' WHEN v <= q2 THEN 'Q1-Q2' WHEN v <= q3 THEN 'Q2-Q3'
                    WHEN v <= mx THEN 'Q3-max' END AS n_chars_qcat
FROM x, t
""")
def q_quartile_bins(spark, sf):
    d = fe.log_features(loan_table(Tables(spark, sf)).select("doc_id", "n_chars"), ["n_chars"],
                        suffix="_log")
    return fe.quartile_bins(d, "n_chars_log", "n_chars_qcat").select("doc_id", "n_chars_qcat")


@query("rule_bins", LOAN + """
SELECT doc_id, CASE WHEN toxic = 0 THEN '0' ELSE '>0' END AS toxic_zcat,
       CASE WHEN n_chars < 360 THEN '<360' WHEN n_chars = 360 THEN '360'
            WHEN n_chars > 360 THEN '>360' END AS n_chars_tcat
FROM loan
""")
def q_rule_bins(spark, sf):
    d = loan_table(Tables(spark, sf)).select("doc_id", "toxic", "n_chars")
    d = fe.term_bin(fe.zero_bin(d, "toxic", "toxic_zcat"), "n_chars", "n_chars_tcat")
    return d.select("doc_id", "toxic_zcat", "n_chars_tcat")


def _rank_cte(c):
    return (f", r_{c} AS (SELECT CAST({c} AS VARCHAR) AS v, "
            f"row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) - 1 AS idx "
            f"FROM loan WHERE {c} IS NOT NULL GROUP BY {c})\n")


def _idx(c):
    return (f"CAST(coalesce((SELECT idx FROM r_{c} WHERE r_{c}.v = CAST(loan.{c} AS VARCHAR)), "
            f"(SELECT count(*) FROM r_{c})) AS DOUBLE) AS {c}_idx")


@query("string_index", LOAN + "".join(_rank_cte(c) for c in INDEXED)
       + f"SELECT doc_id, {', '.join(_idx(c) for c in INDEXED)} FROM loan")
def q_string_index(spark, sf):
    d, _ = fe.string_index(loan_table(Tables(spark, sf)), INDEXED)
    return d.select("doc_id", *[f"{c}_idx" for c in INDEXED])


@query("one_hot", LOAN + _rank_cte("lang") + """
SELECT doc_id, CAST(idx AS INTEGER) AS slot, CAST(1.0 AS DOUBLE) AS value
FROM loan JOIN r_lang ON r_lang.v = loan.lang
""")
def q_one_hot(spark, sf):
    d, _ = fe.string_index(loan_table(Tables(spark, sf)), ["lang"])
    d, _ = fe.one_hot(d, ["lang_idx"])
    return (d.select("doc_id", F.posexplode(vector_to_array("lang_idx_vec")).alias("slot", "value"))
            .filter(F.col("value") != 0))


@query("assemble", LOAN + _rank_cte("lang") + _rank_cte("source") + """
SELECT doc_id, [""" + _idx("lang").rsplit(" AS ", 1)[0] + ", " + _idx("source").rsplit(" AS ", 1)[0]
       + """, CAST(n_chars AS DOUBLE)] AS features FROM loan
""")
def q_assemble(spark, sf):
    d, _ = fe.string_index(loan_table(Tables(spark, sf)), ["lang", "source"])
    d = fe.assemble(d.withColumn("n_chars", F.col("n_chars").cast("double")),
                    ["lang_idx", "source_idx", "n_chars"])
    return d.select("doc_id", vector_to_array("features").alias("features"))


def _chi_features_sql():
    feats = [("lang", "lang"), ("source", "source"), ("toxic", "CAST(toxic AS VARCHAR)")]
    u = " UNION ALL ".join(
        f"SELECT '{n}' AS variable, {e} AS value, CAST(quality AS VARCHAR) AS label "
        f"FROM loan WHERE quality IS NOT NULL" for n, e in feats)
    return LOAN + f""", u AS ({u})
, obs AS (SELECT variable, value, label, count(*) AS o FROM u GROUP BY ALL)
, ra AS (SELECT variable, value, sum(o) AS r FROM obs GROUP BY ALL)
, cb AS (SELECT variable, label, sum(o) AS c FROM obs GROUP BY ALL)
, nn AS (SELECT variable, sum(o) AS n FROM obs GROUP BY ALL)
, grid AS (SELECT ra.variable, ra.value, cb.label, coalesce(obs.o, 0) AS o,
                  ra.r * cb.c / nn.n AS e, nn.n
           FROM ra JOIN cb ON ra.variable = cb.variable JOIN nn ON nn.variable = ra.variable
           LEFT JOIN obs ON obs.variable = ra.variable AND obs.value = ra.value
                        AND obs.label = cb.label)
, s AS (SELECT variable, max(n) AS n,
               (count(DISTINCT value) - 1) * (count(DISTINCT label) - 1) AS dof,
               sum(power(o - e, 2) / e) AS stat,
               sum(power(o + sign(e - o) * least(0.5, abs(e - o)) - e, 2) / e) AS stat_y
        FROM grid GROUP BY variable)
SELECT variable, CAST(n AS BIGINT) AS n, CAST(dof AS BIGINT) AS dof, round(stat, 6) AS statistic,
       round(CASE WHEN dof = 1 THEN stat_y END, 6) AS statistic_yates FROM s
"""


@query("chi_square_features", _chi_features_sql())
def q_chi_square_features(spark, sf):
    return asc.chi_square_many(loan_table(Tables(spark, sf)), ["lang", "source", "toxic"],
                              "quality", with_p=False)


def _ranked_sql(features: list[str]) -> str:
    tests = features_chi_sql("known", features, "quality").replace("stat_y ELSE stat END", "stat ELSE stat END")
    places = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(features))
    return (f", known AS (SELECT * FROM loan WHERE quality IS NOT NULL), tests AS ({tests}), "
            f"ranked AS (SELECT variable, CASE variable {places} END AS place, p_value, row_number() OVER "
            f"(ORDER BY p_value, CASE variable {places} END) AS rank FROM tests)\n")


@query("chi_rank", LOAN + _ranked_sql(["lang", "source", "toxic"])
       + "SELECT variable, CAST(place AS INTEGER) AS place, round(p_value, 6) AS p_value, CAST(rank AS INTEGER) AS rank FROM ranked")
def q_chi_rank(spark, sf):
    ranked = asc.chi_rank(loan_table(Tables(spark, sf)), ["lang", "source", "toxic"], "quality")
    return ranked.withColumn("p_value", F.round("p_value", 6))


@query("chi_select", LOAN + _rank_cte("lang").replace("WHERE lang", "WHERE quality IS NOT NULL AND lang")
       + _rank_cte("source").replace("WHERE source", "WHERE quality IS NOT NULL AND source") + _ranked_sql(["lang", "source", "toxic"]) + """
SELECT doc_id, list_concat(list_concat(CASE WHEN list_contains(places, 0) THEN [""" + _idx("lang").rsplit(" AS ", 1)[0]
       + "] ELSE [] END, CASE WHEN list_contains(places, 1) THEN [" + _idx("source").rsplit(" AS ", 1)[0] + """] ELSE [] END),
         CASE WHEN list_contains(places, 2) THEN [CAST(toxic AS DOUBLE)] ELSE [] END) AS selected
FROM loan, (SELECT list(place) AS places FROM ranked WHERE rank <= 2) WHERE quality IS NOT NULL
""")
def q_chi_select(spark, sf):
    d = loan_table(Tables(spark, sf)).filter(F.col("quality").isNotNull())
    d, _ = fe.string_index(d, ["lang", "source"])
    d, _ = fe.chi_select(d.withColumn("toxic", F.col("toxic").cast("double")), ["lang_idx", "source_idx", "toxic"],
                         "quality", 2, "selected")
    return d.select("doc_id", vector_to_array("selected").alias("selected"))


_TRAIN = """, train AS (SELECT *, ln(1 + n_chars) AS v FROM loan WHERE quality IS NOT NULL AND
  CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 70)
, t AS (SELECT quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.5) AS q2, quantile_disc(v, 0.75) AS q3 FROM train)
"""


@query("loan_score", LOAN + _TRAIN + "".join(_rank_cte(c).replace("FROM loan", "FROM train") for c in ("lang", "source")) + f"""
SELECT doc_id, CASE WHEN ln(1 + n_chars) <= q1 THEN 'min-Q1' WHEN ln(1 + n_chars) <= q2 THEN 'Q1-Q2'
                    WHEN ln(1 + n_chars) <= q3 THEN 'Q2-Q3' ELSE 'Q3-max' END AS n_chars_qcat,
       CASE WHEN toxic = 0 THEN '0' ELSE '>0' END AS toxic_zcat,
       CASE WHEN n_chars < 360 THEN '<360' WHEN n_chars = 360 THEN '360' ELSE '>360' END AS n_chars_tcat,
       {_idx("lang").replace("lang_idx", "lang_cat_idx")}, {_idx("source").replace("source_idx", "source_cat_idx")},
       true AS same
FROM loan, t
""")
def q_loan_score(spark, sf):
    """A fitted pipeline, saved, loaded and applied to all rows, most of them never seen."""
    found = loan_model.trained_and_scored(loan_table(Tables(spark, sf)))
    return found.select("doc_id", "n_chars_qcat", "toxic_zcat", "n_chars_tcat", "lang_cat_idx", "source_cat_idx", "same")


_SCORES = """, scored AS (SELECT quality AS y, n_chars % 13 AS score, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS hard
  FROM loan WHERE quality IS NOT NULL)
"""


def _auc_sql(kind, x):
    return (f"SELECT '{kind}' AS kind, (SELECT count(*) FROM scored WHERE y = 1) AS n_positive, "
            f"(SELECT count(*) FROM scored WHERE y = 0) AS n_negative, round((SELECT avg(CASE WHEN p.{x} > q.{x} THEN 1.0 "
            f"WHEN p.{x} = q.{x} THEN 0.5 ELSE 0.0 END) FROM scored p JOIN scored q ON p.y = 1 AND q.y = 0), 9) AS auc")


@query("rank_auc", LOAN + _SCORES + _auc_sql("score", "score") + " UNION ALL " + _auc_sql("hard", "hard"))
def q_rank_auc(spark, sf):
    """Area under the ROC curve of a score with many ties and of a hard label."""
    d = loan_table(Tables(spark, sf)).select(
        "quality", (F.col("n_chars") % 13).alias("score"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("hard"))
    parts = [md.rank_auc(d, "quality", c).select(F.lit(c).alias("kind"), "n_positive", "n_negative", F.round("auc", 9).alias("auc"))
             for c in ("score", "hard")]
    return parts[0].union(parts[1])


@query("logistic_certificate", LOAN.replace("WITH", "WITH RECURSIVE", 1) + """
, rows AS (SELECT CAST(quality AS DOUBLE) AS y, ln(1 + n_chars) AS x FROM loan WHERE quality IS NOT NULL)
, newton AS (
  SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
  UNION ALL
  SELECT i + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT i, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
               sum(p * (1 - p) * x * x) AS h11
        FROM (SELECT *, 1 / (1 + exp(-b0 - b1 * x)) AS p FROM newton, rows) GROUP BY i, b0, b1)
  WHERE i < 30)
, best AS (SELECT b0, b1 FROM newton WHERE i = 30)
SELECT count(*) AS n, round(max(b0), 4) AS intercept, round(max(b1), 4) AS slope,
       round(avg(ln(1 + exp(b0 + b1 * x)) - y * (b0 + b1 * x)), 6) AS log_loss, true AS converged
FROM rows, best
""")
def q_logistic_certificate(spark, sf):
    """A logistic regression, with log-loss and gradient at its stored coefficients."""
    d = loan_table(Tables(spark, sf)).filter("quality IS NOT NULL").select(
        F.col("quality").cast("double").alias("y"), F.log1p(F.col("n_chars").cast("double")).alias("x"))
    path = loan_model.scratch_path(spark, "logistic")
    loan_model.save(md.fit_logistic(d, ["x"], "y", tol=1e-12), path)
    fitted = loan_model.load(spark, path).stages[-1]
    slope, intercept = float(fitted.coefficients[0]), float(fitted.intercept)
    return md.log_loss(d, ["x"], "y", [slope], intercept).select(
        "n", F.round(F.lit(intercept), 4).alias("intercept"), F.round(F.lit(slope), 4).alias("slope"),
        F.round("log_loss", 6).alias("log_loss"), (F.col("gradient_norm") < 1e-6).alias("converged"))


@query("hash_split", LOAN + """
SELECT doc_id, CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 70
       AS is_train
FROM loan
""")
def q_hash_split(spark, sf):
    return md.hash_split(loan_table(Tables(spark, sf)).select("doc_id"), "doc_id")


@query("logistic_auc")
def q_logistic_auc(spark, sf):
    res = loan_job.run(loan_table(Tables(spark, sf)))
    return loan_job.summary_frame(spark, res)
