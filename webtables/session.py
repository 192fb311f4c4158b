"""Session settings every operator relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings the library needs (all settable on a live session):
#  - UTC so timestamps, date_trunc and ISO text agree with the oracle;
#  - LAST_WIN so page metadata maps can overwrite keys (title, repeated meta);
#  - AQE so joins pick broadcast/sort-merge at runtime and skewed joins split.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches to Python workers: pages are large, so fewer per batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``webtables`` importable in Python workers (once per context).

    Functions sent to executors refer to this package by name, so it is
    zipped and added with ``addPyFile`` (Spark copies it to every node)."""
    import os
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: ship with spark.addArtifacts instead
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    d = checkpoint_dir(spark)
    local = d[len("file:"):] if d.startswith("file:") else d
    if "://" in local or not os.path.isdir(local):
        local = tempfile.mkdtemp(prefix="webtables-lib-")  # driver-side upload source only
    path = os.path.join(local, f"webtables-{app}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is read, never replaced.
    Only when it is unset and Spark runs in one local process (tests, a smoke
    run) a private folder is created and registered; elsewhere it has to be set.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context; use the configured folder
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder") from None
        return d
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="webtables-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def spread(df, partitions: int | None = None):
    """``df`` dealt round-robin over ``partitions`` tasks, for CPU-heavy work on input
    that Spark reads as a few splits. The number comes from the caller or from the
    setting ``spark.webtables.spread``; without either the input's splits decide and
    nothing is shuffled."""
    n = partitions or int(df.sparkSession.conf.get("spark.webtables.spread", None) or 0)
    return df.repartition(n) if n and not df.isStreaming else df


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench (local mode only)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("webtables")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    checkpoint_dir(spark)
    return spark
