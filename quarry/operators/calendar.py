"""Calendar dimension and the visit-to-month mapping.

``dim_time`` has one row per calendar month between the first and the last
visit, so its size is bounded by the span of the dates (12 rows a year), not
by the number of visits: it is always safe to broadcast.

The reference maps visits to months with a range join
(``visit_date BETWEEN start_dt AND end_dt``). Spark has no range-join
strategy (that plan is a nested-loop join), but months are disjoint and
complete, so the predicate equals ``trunc(visit_date, 'MM') = start_dt``: a
broadcast hash join with no shuffle of the visits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions.dates import month_name, month_start


def dim_time(visits: DataFrame, date_col: str = "visit_date",
             inclusive_extra_day: bool = True) -> DataFrame:
    """Months from the first to the last date.

    ``inclusive_extra_day`` (default, as the reference's day recursion) also
    covers the day after the last date, which adds the next month when the
    last date is a month's last day.
    ``date_id`` is the 1-based month position, equal to numbering the months
    in ``start_dt`` order, computed without a global window.
    """
    d = F.col(date_col).cast("date")
    rng = visits.agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    hi = F.date_add("hi", 1) if inclusive_extra_day else F.col("hi")
    months = rng.select(F.posexplode(F.sequence(F.trunc("lo", "MM"), F.trunc(hi, "MM"),
                                                F.expr("INTERVAL 1 MONTH")))
                        .alias("pos", "start_dt"))
    return months.select(
        (F.col("pos") + 1).cast("int").alias("date_id"),
        F.col("start_dt"),
        F.last_day("start_dt").alias("end_dt"),
        F.dayofmonth(F.last_day("start_dt")).alias("days_in_month"),
        month_name("start_dt").alias("month"),
        F.year("start_dt").alias("year"),
        F.quarter("start_dt").alias("quarter"))


def visit_month(visits: DataFrame, dim: DataFrame, how: str = "left",
                date_col: str = "visit_date") -> DataFrame:
    """Attach ``date_id, start_dt, end_dt`` of the visit's month.

    ``how='left'`` keeps visits with no month (null date); ``'inner'`` is the
    theta-join form used by the date-mapping check. ``dim`` must hold calendar
    months (as :func:`dim_time` builds).
    """
    months = F.broadcast(dim.select("date_id", "start_dt", "end_dt"))
    v = visits.withColumn("_month", month_start(date_col))
    out = v.join(months, v["_month"] == months["start_dt"], how).drop("_month")
    front = [c for c in ("visit_id", "provider_id", "patient_id") if c in visits.columns]
    rest = [c for c in visits.columns if c not in front]
    return out.select(*front, "date_id", *rest, "start_dt", "end_dt")
