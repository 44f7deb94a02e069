"""The loan-approval job end to end, parameterised by column roles.

Order of the original job, on Spark throughout: log features, mean and
mode imputation (the term before it is binned), quartile and rule bins, one multi-column indexer, mode
imputation of index columns, chi-square screening, chi-square selector,
one-hot encoding, split, two logistic regressions, ROC AUC.

rows without a label, so the model is binary; the split hashes the key, so it
is reproducible under any partitioning; ``impute_first`` fills categorical
text nulls with the mode before indexing (otherwise a null is its own index,
as in the original); ``fit_on_train`` fits every step, the screening, the selector
and the encoder included, on the training rows only (the original fits on all rows
before splitting). ``selector_features`` and ``model_features`` name the candidate
columns given to the selector and to the hand-picked model (default: all).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import association as asc, features as fe, model as md
from quarry.session import scratch_path


@dataclass
class LoanRoles:
    key: str = "doc_id"
    label: str = "quality"
    categorical: list[str] = field(default_factory=lambda: ["lang", "source"])
    log_binned: list[str] = field(default_factory=lambda: ["n_chars"])
    zero_binned: list[str] = field(default_factory=lambda: ["toxic"])
    term_binned: list[str] = field(default_factory=lambda: ["n_chars"])
    mode_imputed: list[str] = field(default_factory=lambda: ["toxic"])
    top_k: int = 2
    train_percent: int = 70
    seed: int = 42
    impute_first: bool = False  # fill categorical text nulls with the mode before indexing
    fit_on_train: bool = False  # fit every step on the training rows only
    selector_features: list[str] | None = None  # columns the selector chooses from
    model_features: list[str] | None = None  # columns of the hand-picked model


def prepare(df: DataFrame, r: LoanRoles) -> tuple[DataFrame, list[str]]:
    """Features up to the indexed, imputed categorical columns, plus the
    ``is_train`` flag of the key-hash split.
    Returns the frame and the names of the model's candidate columns.

    By default every fitted step sees all rows, as the original job does;
    ``fit_on_train`` fits them on the training rows and applies them to all.
    """
    d = md.hash_split(df.filter(F.col(r.label).isNotNull()), r.key, r.train_percent, r.seed)

    def fit(x: DataFrame) -> DataFrame | None:
        return x.filter(F.col("is_train")) if r.fit_on_train else None

    d = fe.log_features(d, r.log_binned, suffix="_log")
    d = fe.impute(d, [f"{c}_log" for c in r.log_binned], "mean",
                  [f"{c}_log_imp" for c in r.log_binned], fit_on=fit(d))
    if r.impute_first:
        d = fe.impute_string_mode(d, list(r.categorical), fit_on=fit(d))
    cats = list(r.categorical)
    for c in r.log_binned:
        src = fit(d) if r.fit_on_train else d
        d = fe.quartile_bins(d, f"{c}_log_imp", f"{c}_qcat",
                             thresholds=fe.quartile_thresholds(src, f"{c}_log_imp"))
        cats.append(f"{c}_qcat")
    for c in r.zero_binned:
        d = fe.zero_bin(d, c, f"{c}_zcat")
        cats.append(f"{c}_zcat")
    if r.term_binned:
        d = fe.impute(d, r.term_binned, "mode", [f"{c}_term_imp" for c in r.term_binned], fit_on=fit(d))
    for c in r.term_binned:
        d = fe.term_bin(d, f"{c}_term_imp", f"{c}_tcat")
        cats.append(f"{c}_tcat")
    d, _ = fe.string_index(d, cats, [f"{c}_idx" for c in cats], "keep", fit_on=fit(d))
    d = d.withColumn("_label_s", F.col(r.label).cast("string"))
    d, _ = fe.string_index(d, ["_label_s"], ["label_idx"], "error", fit_on=fit(d))
    imp_in = [f"{c}_idx" for c in r.categorical] + list(r.mode_imputed)
    imp_out = [f"{c}_imp" for c in imp_in]
    d = fe.impute(d, imp_in, "mode", imp_out, fit_on=fit(d))
    feats = imp_out + [f"{c}_idx" for c in cats if c not in r.categorical]
    return d, feats


def run(df: DataFrame, r: LoanRoles | None = None) -> dict:
    """Whole job. Returns screening table, selected features and the AUCs."""
    r = r or LoanRoles()
    d, feats = prepare(df, r)
    for name, chosen in (("selector_features", r.selector_features), ("model_features", r.model_features)):
        unknown = sorted(set(chosen or ()) - set(feats))
        if unknown:
            raise ValueError(f"{name}: {unknown} not among the prepared columns {feats}")
    selectable, modelled = r.selector_features or feats, r.model_features or feats
    # Several fits read the prepared rows: they are stored once in the shared folder, so
    # a lost executor re-reads stored rows instead of re-running the chain.
    stored = scratch_path(d.sparkSession, "loan")
    d.write.parquet(stored)
    d = d.sparkSession.read.schema(d.schema).parquet(stored)

    def fit(x: DataFrame) -> DataFrame | None:
        return x.filter("is_train") if r.fit_on_train else None

    screening = asc.chi_square_many(fit(d) if r.fit_on_train else d, feats, "label_idx")
    selected_df, selected = fe.chi_select(d, selectable, "label_idx", r.top_k, "chisq", fit_on=fit(d))
    # an index met only in test rows gets the slot for unknown values
    enc, _ = fe.one_hot(selected_df, modelled, [f"{c}_enc" for c in modelled],
                        handle_invalid="keep" if r.fit_on_train else "error", fit_on=fit(selected_df))
    train = enc.filter("is_train")
    test = enc.filter(~F.col("is_train"))
    enc_cols = [f"{c}_enc" for c in modelled]
    m1 = md.fit_logistic(train, enc_cols, "label_idx")
    s1 = m1.transform(test)
    m2 = md.fit_logistic(train, ["chisq"], "label_idx")
    s2 = m2.transform(test)
    out = {
        "screening": screening,
        "selected": [selectable[i] for i in selected],
        "n_train": train.count(), "n_test": test.count(),
        "auc_score": md.roc_auc(s1, "label_idx"),
        "auc_label": md.roc_auc(s1, "label_idx", "prediction"),
        "auc_selected_score": md.roc_auc(s2, "label_idx"),
        "auc_selected_label": md.roc_auc(s2, "label_idx", "prediction"),
    }
    return out


def summary_frame(spark: SparkSession, res: dict) -> DataFrame:
    """The job's scalar results as one row."""
    keys = ["n_train", "n_test", "auc_score", "auc_label", "auc_selected_score",
            "auc_selected_label"]
    row = [res[k] for k in keys] + [",".join(res["selected"])]
    return spark.createDataFrame([tuple(row)], keys + ["selected"])
