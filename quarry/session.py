"""Session helpers: recommended SQL settings and a shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime-settable SQL options this library is planned around.
RECOMMENDED_SQL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Local / test session. On a cluster, use the cluster's session and
    call :func:`tune` instead."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in RECOMMENDED_SQL_CONF.items():
        b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def recommended_shuffle_partitions(input_bytes: int, target_bytes: int = 256 << 20,
                                   minimum: int = 8) -> int:
    """Initial shuffle partitions for an input of ``input_bytes``: about one
    ``target_bytes`` partition each, so the largest shuffle's reducers fit in
    executor memory; AQE then coalesces the small ones."""
    return max(minimum, -(-int(input_bytes) // int(target_bytes)))


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the recommended runtime SQL options to an existing session and,
    given the input size, size the shuffle partitions for it."""
    for k, v in RECOMMENDED_SQL_CONF.items():
        spark.conf.set(k, v)
    if input_bytes:
        spark.conf.set("spark.sql.shuffle.partitions",
                       str(recommended_shuffle_partitions(input_bytes)))
    return spark


@contextmanager
def rows_in_memory(spark: SparkSession, target: str = "16m", scanned: str | None = None):
    """While it holds, AQE joins small shuffle partitions up to ``target`` only. Rows of keys and
    counts take ten times their shuffled bytes in hash maps and sort buffers: partitions of the
    default 64 MB do not fit a task's share of memory and are spilled. ``scanned``: bytes of
    files that a task reads, where those hold some 5 bytes a row and are grouped before an exchange."""
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": target}
    if scanned:
        sizes["spark.sql.files.maxPartitionBytes"] = scanned
    before = {name: spark.conf.get(name) for name in sizes}
    try:
        for name, value in sizes.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local session without one gets a private
    folder; elsewhere executors would write to folders of their own, so it raises.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
            "spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="quarry-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/quarry-{name}-{uuid.uuid4().hex[:12]}"
