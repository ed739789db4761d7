"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "sparkaudit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where nothing is set (tests, one
    machine) is a local folder used, and then it is set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-sparkaudit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a small input has fewer splits than there are cores.

    Only the physical plan is looked at. An input of 64 splits or more is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def deal_rows(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Deal out a table whose rows each cost milliseconds, so that no task has much more than ``rows`` of them.

    Splits are cut by bytes, and a row of two keys has few, so millions of rows share a split however large the table is.
    The rows are counted first, which Parquet answers from its footers.
    """
    pieces = -(-df.count() // rows)
    return df.repartition(max(pieces, df.sparkSession.sparkContext.defaultParallelism))


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that several later expressions read.

    The optimizer merges neighbouring projections and would repeat the expression at every use; it
    does not merge across a generator.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(packed)))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back, so lost executors never repeat the work."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
