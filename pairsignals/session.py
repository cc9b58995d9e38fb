"""Session helpers: building a local session for tests and benches, and the
shared folder where written tables live."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "pairsignals") -> SparkSession:
    """A session for tests and benches. On a cluster use the session given."""
    master = master or os.environ.get("PAIRSIGNALS_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # HotSpot does not JIT methods above 8000 bytes; past that, Spark falls
        # back to per-operator code instead of running one huge method interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", os.environ.get("PAIRSIGNALS_HUGE_METHOD_LIMIT", "8000"))
        .config("spark.driver.memory", os.environ.get("PAIRSIGNALS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture for error messages walks the Python stack on every
        # column operation; the closing formulas build thousands of them, so
        # it costs ~1-2 s of driver time per query.
        .config("spark.python.sql.dataFrameDebugging.enabled",
                os.environ.get("PAIRSIGNALS_DATAFRAME_DEBUGGING", "false"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; only when it is unset and the session is local
    (tests), a fresh folder is made and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            current = tempfile.mkdtemp(prefix="pairsignals-ckpt-")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique table folder under the shared checkpoint folder."""
    root = checkpoint_dir(spark).rstrip("/")
    return f"{root}/tables/{name}-{uuid.uuid4().hex[:12]}"
