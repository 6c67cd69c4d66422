"""Session builder with the settings that the engine's plans assume."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow; on a cluster leave master and shuffle_partitions to the submit command."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; on a cluster ship it with --py-files instead."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset a local session (as in tests) gets a folder of its own; on a cluster
    it's an error, for no folder but a shared one outlives an executor."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(place or "/tmp/checkpoints/tessera")
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared checkpoint folder: what several branches read, or a later round needs."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and read back as Parquet: for wide tables of which each reader needs some columns. The files stay in the
    checkpoint folder until the caller clears it."""
    place = f"{shared_folder(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
