"""Star-schema warehouse: dimensions and monthly fact tables.

Facts are built in a single pass per fact:
* visits get their month by a broadcast of the bounded calendar;
* ``fact_patient`` pre-aggregates the line tables per ``visit_id`` (map-side
  partial aggregation collapses a hot visit before anything shuffles), then
  joins one row per visit;
* the item facts join lines to visits once; a hot visit is left to AQE's skew join
  (quarry.operators.joins), then group at the fact grain.

Fact rows need all three keys (the targets declare them NOT NULL); rows with
a null key are available from :func:`rejected_visits`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions.dates import month_name
from quarry.operators.calendar import dim_time as build_dim_time, visit_month
from quarry.operators.joins import skew_join

LINE_KINDS = (("lab", "lab_id", "visit_lab"), ("procedure", "procedure_id", "visit_procedure"),
              ("diagnosis", "diagnosis_id", "visit_diagnosis"))


def dim_patient(patient: DataFrame) -> DataFrame:
    return (patient.filter(F.col("patient_id").isNotNull())
            .select("patient_id", "first_name", "last_name", "gender", "dob",
                    month_name("dob").alias("birth_month"), F.year("dob").alias("birth_year")))


def copy_dimension(source: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """``SELECT <columns> FROM source WHERE key IS NOT NULL`` with the column
    list spelled out so a positional insert stays correct."""
    return source.filter(F.col(key).isNotNull()).select(*(columns or source.columns))


def dimensions(src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {
        "dim_time": build_dim_time(src["visit"]),
        "dim_patient": dim_patient(src["patient"]),
        "dim_provider": copy_dimension(src["provider"], "provider_id",
                                       ["provider_id", "first_name", "last_name", "specialty"]),
        "dim_lab": copy_dimension(src["lab"], "lab_id", ["lab_id", "cpt_code", "lab_name"]),
        "dim_procedure": copy_dimension(src["clinical_procedures"], "procedure_id",
                                        ["procedure_id", "icd10_code", "proc_name", "description"]),
        "dim_diagnosis": copy_dimension(src["diagnosis"], "diagnosis_id",
                                        ["diagnosis_id", "name", "icd10_code"]),
    }


def _keys_present(df: DataFrame, keys) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond)


def fact_patient(visits: DataFrame, dim: DataFrame, visit_lab: DataFrame,
                 visit_procedure: DataFrame, visit_diagnosis: DataFrame) -> DataFrame:
    """Grain provider x patient x month: visits and their lab, procedure and
    diagnosis lines. Equal to counting each line table in its own left join
    and joining the four counts, without the fan-out."""
    z = F.lit(0).cast("long")
    parts = []
    for (name, item, _), lines in zip(LINE_KINDS, (visit_lab, visit_procedure, visit_diagnosis)):
        cols = [F.col("visit_id")] + [
            (F.col(item).isNotNull().cast("long") if n == name else z).alias(f"n_{n}")
            for n, _, _ in LINE_KINDS]
        parts.append(lines.select(*cols))
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
    per_visit = lines.groupBy("visit_id").agg(
        *[F.sum(f"n_{n}").alias(f"n_{n}") for n, _, _ in LINE_KINDS])
    keys = ["provider_id", "patient_id", "date_id"]
    vm = _keys_present(visit_month(visits.select("visit_id", "provider_id", "patient_id",
                                                 "visit_date"), dim), keys)
    j = vm.join(per_visit, "visit_id", "left")
    return j.groupBy(*keys).agg(
        F.count("visit_id").alias("visit_count"),
        *[F.coalesce(F.sum(f"n_{n}"), z).alias(f"{n}_count") for n, _, _ in LINE_KINDS])


def fact_lines(visits: DataFrame, dim: DataFrame, lines: DataFrame, item: str,
               measure: str, preaggregate: bool = False, skew: str = "aqe") -> DataFrame:
    """Grain provider x item x month for one line table:
    ``patient_count, visit_count, <measure>`` (row counts of lines whose
    visit has a patient / a date, and of lines).

    Lines join their visit once (many to one on ``visit_id``) and are counted before the
    exchange on the fact grain. ``preaggregate`` counts the copies of a ``(visit_id, item)``
    line first: one more exchange of all lines, which pays where most lines are copies.
    Visits that hold a large share of the lines are left to AQE's skew-join
    split; ``skew='salt'`` counts them first and salts them
    (quarry.operators.joins), for sessions without AQE.
    """
    it = lines.filter(F.col(item).isNotNull()).select("visit_id", item)
    if preaggregate:
        it = it.groupBy("visit_id", item).agg(F.count(item).alias("_n"))
    keys = ["provider_id", item, "date_id"]
    vm = _keys_present(visit_month(visits.select("visit_id", "provider_id", "patient_id",
                                                 "visit_date"), dim),
                       ["provider_id", "date_id"])
    j = skew_join(it, vm, "visit_id") if skew == "salt" else it.join(vm, "visit_id", "inner")
    if preaggregate:
        counts = [F.sum(F.when(F.col("patient_id").isNotNull(), F.col("_n")).otherwise(F.lit(0).cast("long"))), F.sum("_n")]
    else:
        counts = [F.count("patient_id"), F.count(F.lit(1))]
    # a visit with a month has a date: its lines are counted once for both columns
    return j.groupBy(*keys).agg(counts[0].alias("patient_count"), counts[1].alias(measure)).select(
        *keys, "patient_count", F.col(measure).alias("visit_count"), measure)


ITEM_FACTS = {  # fact: (line table, item column, measure)
    "fact_lab": ("visit_lab", "lab_id", "lab_count"),
    "fact_procedure": ("visit_procedure", "procedure_id", "procedure_count"),
    "fact_diagnosis": ("visit_diagnosis", "diagnosis_id", "diagnosis_frequency"),
}
FACTS = ("fact_patient",) + tuple(ITEM_FACTS)


def fact(src: dict[str, DataFrame], dim: DataFrame, name: str) -> DataFrame:
    """One fact table by name."""
    v = src["visit"]
    if name == "fact_patient":
        return fact_patient(v, dim, src["visit_lab"], src["visit_procedure"],
                            src["visit_diagnosis"])
    lines, item, measure = ITEM_FACTS[name]
    return fact_lines(v, dim, src[lines], item, measure)


def facts(src: dict[str, DataFrame], dim: DataFrame) -> dict[str, DataFrame]:
    return {n: fact(src, dim, n) for n in FACTS}


def build_warehouse(src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All six dimensions and four facts as lazy DataFrames."""
    dims = dimensions(src)
    return {**dims, **facts(src, dims["dim_time"])}


def rejected_visits(visits: DataFrame, dim: DataFrame) -> DataFrame:
    """Visits that cannot enter a fact: a null provider, patient or month."""
    vm = visit_month(visits, dim)
    return vm.filter(F.col("provider_id").isNull() | F.col("patient_id").isNull()
                     | F.col("date_id").isNull())
