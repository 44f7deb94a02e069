"""Stand-in inputs built from the driver's test tables.

The reference ships no data. Each builder maps test tables onto the input the
reference's jobs expect (see FIXTURES.md). All are lazy DataFrame plans whose
work grows with the underlying tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.dates import LOG_TS_FORMAT
from quarry.sources.tables import read_table


class Tables:
    """Lazy access to the test tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:  # one relation per table: listed and planned once
            self._frames[name] = read_table(self.spark, self.sf_dir, name)
        return self._frames[name]


# ---------------------------------------------------------------- web log

def weblog_tm_from_events(events: DataFrame) -> DataFrame:
    """Events as a timestamped web log (all text): the time as
    ``yyyy-MM-dd HH:mm:ss``, the user, the event type as the search query."""
    return events.select(
        F.date_format("ts", LOG_TS_FORMAT).alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("search_query"),
        F.col("event_type").alias("browser"),
        F.col("props").alias("os"),
        F.col("value").cast("string").alias("referrer"))


def weblog_from_events(events: DataFrame) -> DataFrame:
    return weblog_tm_from_events(events).drop("timestamp")


def weblog_from_documents(documents: DataFrame) -> DataFrame:
    """Documents as a web log: the language as query and browser, the source as
    operating system and referrer."""
    return documents.select(
        F.col("doc_id").cast("string").alias("user_id"), F.col("lang").alias("search_query"),
        F.col("lang").alias("browser"), F.col("source").alias("os"), F.col("source").alias("referrer"))


# ---------------------------------------------------------------- clinical sources

def visit(t: Tables) -> DataFrame:
    """orders as visits; provider = smallest supplier among the order's lines
    (null when the order has no lines)."""
    provider = (t.lineitem.groupBy(F.col("l_orderkey").alias("visit_id"))
                .agg(F.min("l_suppkey").alias("provider_id")))
    v = t.orders.select(F.col("o_orderkey").alias("visit_id"),
                        F.col("o_custkey").alias("patient_id"),
                        F.col("o_orderdate").cast("date").alias("visit_date"))
    return (v.join(provider, "visit_id", "left")
            .select("visit_id", "provider_id", "patient_id", "visit_date"))


def visit_lab(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("visit_id"),
                             F.col("l_partkey").alias("lab_id"))


def visit_procedure(t: Tables) -> DataFrame:
    return (t.lineitem.filter(F.col("l_returnflag") == "R")
            .select(F.col("l_orderkey").alias("visit_id"), F.col("l_partkey").alias("procedure_id")))


def visit_diagnosis(t: Tables) -> DataFrame:
    return (t.lineitem.filter(F.col("l_linestatus") == "O")
            .select(F.col("l_orderkey").alias("visit_id"), F.col("l_partkey").alias("diagnosis_id")))


def patient(t: Tables) -> DataFrame:
    """customer as patients; market segment as gender, first order date as dob
    (null for customers without orders)."""
    first = (t.orders.groupBy(F.col("o_custkey").alias("patient_id"))
             .agg(F.min("o_orderdate").cast("date").alias("dob")))
    c = t.customer.select(F.col("c_custkey").alias("patient_id"),
                          F.col("c_name").alias("first_name"),
                          F.col("c_nationkey").cast("string").alias("last_name"),
                          F.col("c_mktsegment").alias("gender"))
    return c.join(first, "patient_id", "left").select(
        "patient_id", "first_name", "last_name", "gender", "dob")


def provider(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("provider_id"),
                             F.col("s_name").alias("first_name"),
                             F.lit(None).cast("string").alias("last_name"),
                             F.col("s_nationkey").cast("string").alias("specialty"))


def lab(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("lab_id"), F.col("p_brand").alias("cpt_code"),
                         F.col("p_name").alias("lab_name"))


def clinical_procedures(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("procedure_id"),
                         F.col("p_type").alias("icd10_code"), F.col("p_name").alias("proc_name"),
                         F.col("p_brand").alias("description"))


def diagnosis(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("diagnosis_id"), F.col("p_name").alias("name"),
                         F.col("p_type").alias("icd10_code"))


class _Sources(dict):
    """Source tables built on first use (each stand-in is planned once)."""

    def __init__(self, t: Tables):
        super().__init__()
        self._t = t

    def __missing__(self, name: str) -> DataFrame:
        if name not in CLINICAL_BUILDERS:
            raise KeyError(name)
        self[name] = df = CLINICAL_BUILDERS[name](self._t)
        return df


CLINICAL_BUILDERS = {
    "visit": visit, "visit_lab": visit_lab, "visit_procedure": visit_procedure,
    "visit_diagnosis": visit_diagnosis, "patient": patient, "provider": provider, "lab": lab,
    "clinical_procedures": clinical_procedures, "diagnosis": diagnosis,
}


def clinical_sources(t: Tables) -> dict[str, DataFrame]:
    """The nine operational tables, each built when first looked up."""
    return _Sources(t)


# ---------------------------------------------------------------- loan-like table

def loan_table(t: Tables, with_text: bool = False) -> DataFrame:
    """documents left join labels: doc_id key; lang, source categorical;
    n_chars measure; toxic plays credit history; quality is the label (null
    where unlabelled)."""
    cols = ["doc_id", "lang", "source", "n_chars"] + (["text"] if with_text else [])
    return t.documents.select(*cols).join(t.labels, "doc_id", "left")
