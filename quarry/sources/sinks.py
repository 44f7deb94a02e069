"""Sinks: tab-separated result folders, warehouse tables, positional inserts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quarry.schemas import WAREHOUSE

#: Tables whose write jobs are submitted together.
TABLES_AT_ONCE = 4


def store_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists",
                    header: bool = False) -> str:
    """Store a result as delimited part files; fails if ``path`` exists by
    default, like the log jobs' store. Nothing is quoted, as in those files: empty
    strings are empty fields (read back as null), and a text that holds the
    separator or a line feed ends the job with an error instead of shifting columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    for c in texts:
        x = F.col(f"`{c}`")
        split = F.contains(x, F.lit(sep)) | F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\r"))
        df = df.withColumn(c, F.when(split, F.raise_error(F.lit(f"separator in column {c}")).cast("string"))
                           .otherwise(x))
    (df.write.mode(mode).option("sep", sep).option("quote", "").option("escape", "")
       .option("emptyValue", "").option("nullValue", "")
       .option("header", str(header).lower()).csv(path))
    return path


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast ``df`` to the target column order and types."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def _fits(given: T.DataType, wanted: T.DataType) -> bool:
    """Whether every value of a type is one of the other: equal types, or wider numbers."""
    ladder = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if type(given) in ladder and type(wanted) in ladder:
        return ladder.index(type(given)) <= ladder.index(type(wanted))
    if isinstance(wanted, T.DoubleType) and isinstance(given, (T.FloatType, T.IntegerType, T.ShortType, T.ByteType)):
        return True
    return given == wanted or isinstance(given, T.NullType)


def insert_positional(df: DataFrame, table: str, overwrite: bool = False) -> None:
    """``INSERT INTO table SELECT ...`` for a table of the session's catalog: columns
    are matched by position, whatever their names. Another number of columns, or a
    column whose type does not fit the one at its place, raises before anything is written.
    ``overwrite`` replaces, in a partitioned table, only the partitions that
    ``df`` has rows for (a table's partition columns come last)."""
    target = df.sparkSession.table(table).schema.fields
    if len(df.schema.fields) != len(target):
        raise ValueError(f"{table} has {len(target)} columns, the rows have {len(df.schema.fields)}")
    wrong = [f"{i}: {g.name} {g.dataType.simpleString()} for {w.name} {w.dataType.simpleString()}"
             for i, (g, w) in enumerate(zip(df.schema.fields, target)) if not _fits(g.dataType, w.dataType)]
    if wrong:
        raise ValueError(f"columns that do not fit {table}: {'; '.join(wrong)}")
    df = df.toDF(*[f"_{i}" for i in range(len(target))]).select(
        *[F.col(f"_{i}").cast(w.dataType).alias(w.name) for i, w in enumerate(target)])
    # catalog tables take the mode from the session only
    conf, mode = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(mode)
    try:
        conf.set(mode, "dynamic")
        df.write.insertInto(table, overwrite=overwrite)
    finally:
        conf.set(mode, before)


def save_table(df: DataFrame, path: str, schema: T.StructType | None = None,
               mode: str = "overwrite", sort_by: list[str] | None = None,
               partition_by: str | None = None) -> str:
    """Rebuild a target table as Parquet at ``path`` (drop + create).

    ``sort_by`` sorts inside each partition only, which keeps row groups
    clustered on the key without a global sort. ``partition_by`` gives each value of a
    column a folder: rows meet by that column first, so that a folder holds few
    files, and AQE splits the values that hold many rows.
    """
    if schema is not None:
        df = conform(df, schema)
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
        sort_by = [partition_by] + [c for c in sort_by or [] if c != partition_by]
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    out = df.write.mode(mode)
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return path


def write_warehouse(spark: SparkSession, tables: dict[str, DataFrame], root: str,
                    mode: str = "overwrite", facts_by: str | None = None) -> dict[str, str]:
    """Write every warehouse table under ``root``; dimensions first, as the
    foreign keys demand. Tables of a kind are written side by side: the next one's tasks fill
    the cores that the last tasks of one leave. ``facts_by``: a column whose values get folders of their own in
    the facts."""
    def save(name: str) -> str:
        schema = WAREHOUSE.get(name)
        keys = None
        if name.startswith("fact_") and schema is not None:
            keys = [f.name for f in schema.fields[:3]]
        by = facts_by if name.startswith("fact_") else None
        return save_table(tables[name], f"{root.rstrip('/')}/{name}", schema, mode, keys, by)

    out = {}
    for group in ([n for n in sorted(tables) if n.startswith("dim_")],
                  [n for n in sorted(tables) if not n.startswith("dim_")]):
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            out.update(zip(group, pool.map(save, group)))
    return out
