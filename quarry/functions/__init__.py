"""Column-level helpers (all built from pyspark.sql.functions, JVM-side)."""

from quarry.functions.text import token_concat, strip_spaces, tokenize  # noqa: F401
from quarry.functions.dates import (  # noqa: F401
    parse_timestamp, month_start, month_name, month_range, in_month)
from quarry.functions.predicates import missing_value, missing_counts_exprs  # noqa: F401
