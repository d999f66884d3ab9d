"""Spark session settings shared by the library, the tests and the bench.

The library never creates its own scratch space on a cluster: lineage is cut
with ``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``. Only when that key is unset (unit tests, a laptop)
do we fall back to a fresh folder under the system temp directory.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: adaptive execution re-plans joins from runtime
# sizes (broadcast only when the materialised side is small), coalesces tiny
# shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Settings for a large cluster (hundreds of TB, ~1000 executors), applied by
# whoever launches the job; not used by the tests. Shuffle partitions start
# high and AQE coalesces them to ~256 MB each; file splits stay at 256 MB so
# a scan task's rows fit in executor memory; skewed join partitions larger
# than 5x the median (and 1 GB) are split.
CLUSTER_CONF = {
    **SCALE_CONF,
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "prescient", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session. Where the key is unset, a
    local master (tests, a laptop) gets a private folder; any other is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="prescient-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never ``localCheckpoint``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


_READY: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``prescient`` importable in every Python worker.

    Pandas UDFs and ``mapInPandas`` functions defined in this package are
    pickled by reference, so workers import it. The package is zipped on the
    driver and shipped with ``addPyFile`` (Spark serves it to executors);
    once per application.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _READY:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="prescient-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _READY.add(app)


def ready(spark: SparkSession) -> None:
    """Checkpoint folder registered and package shipped (idempotent)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
