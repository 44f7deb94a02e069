"""The warehouse ETL and its checks as a job over written tables.

1. dimensions are written first (the facts' foreign keys point at them);
2. the visits are staged once; the four facts are built from the staged
   visits and the *written* calendar, which cuts the lineage (a lost executor
   recomputes from stored tables, not from the sources);
3. all ten tables become the current version at once (quarry.sources.versions): a
   run that ends half-way leaves the warehouse as it was;
4. the checks read the written tables back.
Everything is written under one root in the shared checkpoint folder (or a
caller-given warehouse location).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import calendar as cal, quality as dq, warehouse as wh
from quarry.schemas import WAREHOUSE
from quarry.session import rows_in_memory, scratch_path
from quarry.sources import versions
from quarry.sources.sinks import write_warehouse


def run_etl(spark: SparkSession, src: dict[str, DataFrame], root: str, by_month: bool = False) -> dict[str, str]:
    """Write the dimensions, stage the visits once, write the facts built from the
    stored calendar and the staged visits, publish all. Returns the tables' paths.
    ``by_month`` stores a folder per month of each fact, so that :func:`month_of_fact` reads
    the folders of its months only."""
    def write(folder: str) -> list[str]:
        paths = write_warehouse(spark, wh.dimensions(src), folder)
        dim_time = spark.read.schema(WAREHOUSE["dim_time"]).parquet(paths["dim_time"])
        staged = f"{folder}/_staging/visit"
        src["visit"].write.parquet(staged)
        staged_src = {**{k: src[k] for k in ("visit_lab", "visit_procedure", "visit_diagnosis")},
                      "visit": spark.read.schema(src["visit"].schema).parquet(staged)}
        paths.update(write_warehouse(spark, wh.facts(staged_src, dim_time), folder,
                                     facts_by="date_id" if by_month else None))
        return list(paths)
    with rows_in_memory(spark):
        return versions.rebuild(spark, root, write)


def load(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The written tables with their declared columns in order (a folder per month puts
    that column last)."""
    return {n: spark.read.schema(WAREHOUSE[n]).parquet(p).select(*WAREHOUSE[n].names) if n in WAREHOUSE else
            spark.read.parquet(p) for n, p in paths.items()}


def month_of_fact(tables: dict[str, DataFrame], name: str, year: int, month: str) -> DataFrame:
    """Rows of a written fact in one month, chosen by the calendar's attributes. Over facts
    stored by month the calendar's rows prune the folders before the scan."""
    return dq.month_slice_fact(tables[name], tables["dim_time"], WAREHOUSE[name].names, year, month)


def _accepted(src: dict[str, DataFrame]) -> DataFrame:
    """Visits that may enter a fact; the others are listed by ``rejected_visits``."""
    return src["visit"].filter("provider_id IS NOT NULL AND visit_date IS NOT NULL")


def run_checks(spark: SparkSession, src: dict[str, DataFrame], paths: dict[str, str]
               ) -> dict[str, DataFrame]:
    """Findings frames over the written tables; empty frames / zero counts mean pass.

    Every measure of every fact is compared with the sources over the visits that a
    fact takes: with provider and date, and with a patient where that is a key.
    """
    t = load(spark, paths)
    dim = t["dim_time"]
    kept = _accepted(src)
    found = {}
    with_patient = kept.filter("patient_id IS NOT NULL")
    keys = ["patient_id", "provider_id"]
    measures = {"visit_count": (None, "visit_id"), "lab_count": ("visit_lab", "lab_id"),
                "procedure_count": ("visit_procedure", "procedure_id"), "diagnosis_count": ("visit_diagnosis", "diagnosis_id")}
    for measure, (lines, counted) in measures.items():
        name = measure if measure == "lab_count" else f"fact_patient_{measure}"
        found[f"{name}_vs_source"] = dq.reconcile(
            dq.source_measure(with_patient, src[lines] if lines else None, keys, counted),
            dq.fact_measure(t["fact_patient"], dim, keys, measure), keys + ["month"]).filter("diff <> 0")
    for name, (lines, item, measure) in wh.ITEM_FACTS.items():
        keys = ["provider_id", item]
        for column, counted in ((measure, item), ("patient_count", "patient_id"), ("visit_count", "visit_id")):
            found[f"{name}_vs_source" if column == measure else f"{name}_{column}_vs_source"] = dq.reconcile(
                dq.source_measure(kept, src[lines], keys, counted, item),
                dq.fact_measure(t[name], dim, keys, column), keys + ["month"]).filter("diff <> 0")
    # every table is read once for all its key checks
    stored = scratch_path(spark, "warehouse-findings")
    findings = dq.warehouse_findings(t)
    findings.write.parquet(stored)
    findings = spark.read.schema(findings.schema).parquet(stored)
    totals = findings.filter("check = 'rows'").select("table_name", F.col("findings").alias("rows"))
    dates = findings.filter("check = 'null' AND column_name = 'date_id'").select("table_name", F.col("findings").alias("null_rows"))
    return found | {
        "calendar": dq.calendar_faults(dim),
        "not_null": findings.filter("check = 'null'").select("table_name", "column_name", F.col("findings").alias("null_rows")),
        "null_date_ids": totals.join(dates, "table_name"),
        "orphans": findings.filter("check = 'orphans'").select(
            F.col("table_name").alias("fact_table"), "column_name", F.col("findings").alias("orphan_rows")),
        "duplicates": findings.filter("check = 'duplicates'").select("table_name", F.col("findings").alias("duplicate_keys")),
        "ambiguous_months": dq.ambiguous_months(cal.visit_month(src["visit"], dim)),
    }
