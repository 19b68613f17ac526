"""Session helpers: a tuned local session for tests and a checkpoint folder
that always comes from the cluster configuration when one is set."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, partitions: int | None = None,
                app: str = "lectern") -> SparkSession:
    """Return the active session, or build a local one suitable for tests.

    On a cluster the caller's session wins (``getOrCreate`` keeps it); the
    settings below only apply when this process creates the session.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session has none (local tests) is a private folder under
    the system temp directory created and registered.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="lectern-ckpt-")
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # core config not modifiable at run time: the context setting suffices
        pass
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used after expensive, non-repeatable steps (model inference) so a lost
    executor never re-runs them; ``localCheckpoint`` is deliberately not used.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
