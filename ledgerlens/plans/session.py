"""Session construction, shared scratch locations and size-checked broadcasts."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shuffle-partition sizing: ~128 MB per post-shuffle partition at scale.  AQE
# coalesces small partitions and splits skewed ones at runtime, so the static
# number only has to be an upper bound that fits executor memory.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    # No broadcast on planner estimates: a side is broadcast only through an
    # explicit, size-checked hint (broadcast_bounded, fixed rule tables) or by
    # AQE after the stage ran and its real size is known.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerlens") -> SparkSession:
    """Create (or reuse) a session with the settings every job here assumes.  The number
    of shuffle partitions stays the cluster's unless it is given (AQE merges small ones)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is set by the operator to shared storage and is only
    read here; if it is missing there, this fails rather than fall back to a
    machine-local folder.  Only in local mode (tests; not ``local-cluster``) a private folder is made.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster "
                               "(scratch tables and lineage cuts are written there)")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the shared checkpoint location."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/ledgerlens/{name}/{uuid.uuid4().hex}"


class _PlanMemo:
    """What was read from a plan, per application: found again only for a plan that
    Spark calls the same, over the same input files.  (A hash alone could name two.)"""

    def __init__(self):
        self.known: dict[tuple, list[tuple]] = {}

    def get(self, df: DataFrame, param, read):
        key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), param)
        files = sorted(df.inputFiles())
        for other, other_files, value in self.known.get(key, ()):
            if other_files == files and df.sameSemantics(other):
                return value
        value = read()
        self.known.setdefault(key, []).append((df, files, value))
        return value


_BOUND_CHECKS, _COLLECTED = _PlanMemo(), _PlanMemo()


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The proof is a ``limit(max_rows + 1).count()``, which stops reading as soon
    as the bound is exceeded.  Beyond the bound the frame is returned unhinted
    and Spark plans a shuffle join (AQE may still demote it at runtime).  The
    result is remembered per application, plan and input files, so a dimension
    used by many queries is checked once.
    """
    n = _BOUND_CHECKS.get(df, max_rows, lambda: df.limit(max_rows + 1).count())
    return F.broadcast(df) if n <= max_rows else df


def collect_bounded(df: DataFrame, max_rows: int) -> list:
    """Rows of a small dimension, refused beyond ``max_rows``; read once per
    application, plan and input files."""
    rows = _COLLECTED.get(df, max_rows, lambda: df.limit(max_rows + 1).collect())
    if len(rows) > max_rows:
        raise ValueError(f"dimension exceeds {max_rows} rows")
    return rows


def constant(value, schema: str) -> Column:
    """A nested constant of bounded size (lists, dicts) as one literal: the optimiser
    reads the JSON once, and the value goes to the tasks as an object, not as code.
    A scalar subquery can't stand inside a higher-order function."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint to the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
