"""Data-quality and reconciliation checks for the warehouse.

Every check returns a DataFrame of findings (or of compared values) instead
of a value read by eye; an empty frame or zero counts means pass. Checks run
over all keys and all months at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from quarry.functions.dates import in_month, month_start
from quarry.schemas import FOREIGN_KEYS, PRIMARY_KEYS, WAREHOUSE, not_null_columns


def reconcile(source: DataFrame, fact: DataFrame, keys: list[str], value: str = "value"
              ) -> DataFrame:
    """Full comparison of a measure computed from the sources with the same
    measure read from a fact: ``keys, source_value, fact_value, diff``. Keys
    present on one side only appear with the other value null; a null key meets a null key."""
    s = source.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col(value).alias("source_value"), F.lit(1).alias("_in_s"))
    f = fact.select(*[F.col(k).alias(f"_f_{k}") for k in keys], F.col(value).alias("fact_value"))
    same = reduce(lambda a, b: a & b, [F.col(f"_s_{k}").eqNullSafe(F.col(f"_f_{k}")) for k in keys])
    out = s.join(f, same, "full_outer")
    either = [F.when(F.col("_in_s").isNotNull(), F.col(f"_s_{k}")).otherwise(F.col(f"_f_{k}")).alias(k) for k in keys]
    diff = F.coalesce("source_value", F.lit(0)) - F.coalesce("fact_value", F.lit(0))
    return out.select(*either, "source_value", "fact_value", diff.alias("diff"))


def source_measure(visits: DataFrame, lines: DataFrame | None, keys: list[str],
                   counted: str, require_item: str | None = None) -> DataFrame:
    """``COUNT(counted)`` from visits left joined to a line table, grouped by
    ``keys`` plus the visit's month start ``month``.

    With ``require_item`` (the left join plus ``item IS NOT NULL``, i.e. an
    inner join) lines join visits once; a hot visit is left to AQE's skew-join split. Without
    it, a line column is counted per visit first, so the left join is one row
    per visit whatever a single visit's share of the lines."""
    v = visits.withColumn("month", month_start("visit_date"))
    if lines is None:
        return v.groupBy(*keys, "month").agg(F.count(counted).alias("value"))
    if require_item:
        j = lines.filter(F.col(require_item).isNotNull()).join(v, "visit_id")
        return j.groupBy(*keys, "month").agg(F.count(counted).alias("value"))
    if counted in lines.columns and counted != "visit_id":
        per = lines.groupBy("visit_id").agg(F.count(counted).alias("_c"))
        j = v.join(per, "visit_id", "left")
        return j.groupBy(*keys, "month").agg(
            F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("value"))
    j = v.join(lines, "visit_id", "left")
    return j.groupBy(*keys, "month").agg(F.count(counted).alias("value"))


def fact_measure(fact: DataFrame, dim: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """A fact measure with its month start, via the (bounded) calendar."""
    d = F.broadcast(dim.select("date_id", F.col("start_dt").alias("month")))
    return fact.join(d, "date_id", "left").select(*keys, "month", F.col(measure).alias("value"))


def month_slice_source(visits: DataFrame, lines: DataFrame, keys: list[str], counted: str,
                       year: int, month: int, require_item: str | None = None) -> DataFrame:
    """Source side of a one-month check; the month filter is a half-open
    range on the date, so it reaches the scan."""
    v = visits.filter(in_month("visit_date", year, month))
    if require_item:
        j = lines.filter(F.col(require_item).isNotNull()).join(v, "visit_id")
    else:
        j = v.join(lines, "visit_id", "left")
    return j.groupBy(*keys).agg(F.count(counted).alias(counted.split(".")[-1] + "_n"))


def month_slice_fact(fact: DataFrame, dim: DataFrame, cols: list[str], year: int,
                     month_label: str) -> DataFrame:
    """Fact rows of one month selected through the calendar's attributes."""
    d = F.broadcast(dim.filter((F.col("year") == year) & (F.col("month") == month_label))
                    .select("date_id"))
    return fact.join(d, "date_id", "inner").select(*cols)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, null_rows`` for every listed column, in one pass."""
    cols = columns or df.columns
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, null_rows)")


def null_key_rows(tables: dict[str, DataFrame], key: str = "date_id") -> DataFrame:
    """Rows with a null ``key`` per table: ``table_name, rows, null_rows``."""
    parts = [t.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                   F.count(F.when(F.col(key).isNull(), 1)).alias("null_rows"))
             for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def warehouse_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """Nulls in every column the target schemas declare NOT NULL, one pass
    per table: ``table_name, column_name, null_rows``."""
    parts = [null_counts(tables[n], not_null_columns(WAREHOUSE[n]))
             .select(F.lit(n).alias("table_name"), "column_name", "null_rows")
             for n in WAREHOUSE if n in tables]
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once: ``keys..., count``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def orphan_rows(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None
                ) -> DataFrame:
    """Child rows whose non-null key has no parent row (a foreign-key check)."""
    p = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(p, key, "left_anti")


def orphan_count(child: DataFrame, parent: DataFrame, key: str,
                 parent_key: str | None = None) -> DataFrame:
    """One row: ``orphan_rows``. Child keys are counted per value first
    (map-side partial aggregation), so a key held by a large share of the
    rows reaches the anti join as a single row."""
    per_key = (child.filter(F.col(key).isNotNull()).groupBy(key)
               .agg(F.count(F.lit(1)).alias("_rows")))
    p = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return (per_key.join(p, key, "left_anti")
            .agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("orphan_rows")))


def warehouse_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphan counts for every declared foreign key:
    ``fact_table, column_name, orphan_rows``."""
    parts = [orphan_count(tables[f], tables[d], c)
             .select(F.lit(f).alias("fact_table"), F.lit(c).alias("column_name"), "orphan_rows")
             for f, c, d in FOREIGN_KEYS]
    return reduce(DataFrame.unionByName, parts)


def warehouse_duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    """Duplicate primary-key values per table: ``table_name, duplicate_keys``."""
    parts = [duplicate_keys(tables[n].select(*k), k)
             .agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("duplicate_keys"))
             for n, k in PRIMARY_KEYS.items()]
    return reduce(DataFrame.unionByName, parts)


def table_findings(name: str, table: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """All key checks of one table: ``table_name, check, column_name, findings`` with checks
    ``rows``, ``duplicates`` (key values that occur more than once), ``null`` (per column that must not be) and
    ``orphans`` (rows whose key has no row in ``parents``, the dimension by column).

    The table is read once and grouped by its primary key; every check is a total over those
    groups. Each group adds to one entry of the whole table and to one per foreign key
    and value, all of them in one exchange; the entries of values meet the dimensions' keys in one
    join. Nothing is read, grouped or joined twice."""
    keys = PRIMARY_KEYS[name]
    others = [c for c in not_null_columns(WAREHOUSE[name]) if c not in keys]
    groups = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"),
                                      *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"_no_{c}") for c in others])
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    nothing = F.lit(0).cast("long")
    found = {("rows", None): F.col("_rows"),
             ("duplicates", None): F.when(complete & (F.col("_rows") > 1), 1).otherwise(0).cast("long")}
    found |= {("null", k): F.when(F.col(k).isNull(), F.col("_rows")).otherwise(nothing) for k in keys}
    found |= {("null", c): F.col(f"_no_{c}") for c in others}

    def entry(column: str | None):
        """What a group adds to the entry of the table, or of its value of a foreign key (numbers:
        one column holds the values of all of them)."""
        value = F.lit(None) if column is None else F.col(column)
        counts = [(x if column is None or i == 0 else nothing).alias(f"_{i}") for i, x in enumerate(found.values())]
        return F.struct(F.lit(column).cast("string").alias("column_name"), value.cast("long").alias("value"), *counts)
    entries = (groups.select(F.explode(F.array(entry(None), *[entry(c) for c in parents])).alias("x")).select("x.*")
               .filter("column_name IS NULL OR value IS NOT NULL").groupBy("column_name", "value")
               .agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(found))]))
    sums = {(check, c): F.when(F.col("column_name").isNull(), F.col(f"_{i}")) for i, (check, c) in enumerate(found)}
    if parents:
        known = reduce(DataFrame.unionByName, [
            p.select(F.lit(c).alias("column_name"), F.col(c).cast("long").alias("value")).distinct() for c, p in parents.items()])
        entries = entries.join(known.withColumn("_known", F.lit(True)), ["column_name", "value"], "left")
        sums |= {("orphans", c): F.when((F.col("column_name") == c) & F.col("_known").isNull(), F.col("_0")) for c in parents}
    # one row, whatever the table holds; an empty one has no entry
    totals = entries.agg(*[F.coalesce(F.sum(x), nothing).alias(f"_{i}") for i, x in enumerate(sums.values())])
    out = totals.select(F.explode(F.array(*[
        F.struct(F.lit(check).alias("check"), F.lit(c).cast("string").alias("column_name"), F.col(f"_{i}").alias("findings"))
        for i, (check, c) in enumerate(sums)])).alias("x")).select("x.*")
    return out.select(F.lit(name).alias("table_name"), "check", "column_name", "findings")


def warehouse_findings(tables: dict[str, DataFrame]) -> DataFrame:
    """:func:`table_findings` of every table, each read once."""
    parents = {n: {c: tables[d] for f, c, d in FOREIGN_KEYS if f == n} for n in tables}
    return reduce(DataFrame.unionByName, [table_findings(n, tables[n], parents[n]) for n in WAREHOUSE if n in tables])


def month_mapping_counts(visits_by_month: DataFrame) -> DataFrame:
    """Visits per ``patient, provider, date_id`` (null groups included)."""
    return (visits_by_month.groupBy("patient_id", "provider_id", "date_id")
            .agg(F.count("visit_id").alias("visit_count")))


def ambiguous_months(visits_by_month: DataFrame) -> DataFrame:
    """Visits that map to no month or to more than one: ``visit_id, months``."""
    return (visits_by_month.groupBy("visit_id").agg(F.count("date_id").alias("months"))
            .filter(F.col("months") != 1))


def calendar_faults(dim: DataFrame) -> DataFrame:
    """Calendar rows that are no whole month or not followed by the next one:
    ``date_id, start_dt, fault`` (``start``, ``end``, ``repeated`` or ``gap``, the first
    that holds). The window runs over the calendar alone, 12 rows a year."""
    after = F.lead("start_dt").over(Window.orderBy("start_dt", "date_id"))
    fault = (F.when(F.col("start_dt").isNull() | (F.col("start_dt") != F.trunc("start_dt", "MM")), "start")
             .when(F.col("end_dt").isNull() | (F.col("end_dt") != F.last_day("start_dt")), "end")
             .when(after == F.col("start_dt"), "repeated")
             .when(after != F.add_months("start_dt", 1), "gap"))
    return dim.select("date_id", "start_dt", fault.alias("fault")).filter("fault IS NOT NULL")
