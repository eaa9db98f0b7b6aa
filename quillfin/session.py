"""Session set-up shared by the command line, the tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Applied only where the cluster has not decided otherwise.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A multivector row can be megabytes, so Arrow batches are cut by rows *and* bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quillfin") -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only where it is unset
    (local tests) a fresh temporary folder is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillfin-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per application).

    The archive is built on the driver, which serves it to the executors.
    """
    import os
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    name = f"quillfin-{spark.sparkContext.applicationId}.zip"
    if any(name in f for f in spark.sparkContext.listFiles):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="quillfin-zip-"), name)
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)


def spread(df, *keys: str):
    """Hash-spread rows over the cores when the input has too few splits for CPU-heavy stages.

    Large tables already have more splits than cores and are left where they lie.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores, *keys)


def gathered(df, rows: int, per_task: int = 250_000):
    """As few partitions as ``rows`` rows need, but one for each core; for small tables that pass many shuffles
    and checkpoints, each of which otherwise writes files for every shuffle partition. Never more than there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // per_task)))
