"""Session helpers: UTC time zone, AQE, and a checkpoint folder taken from the session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package assumes. They are runtime SQL confs, so they can be
# applied to a session that someone else built (the driver's, a notebook's, a cluster's).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what a Python worker holds at once: rows may be whole texts or blocks of vectors
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # stateful streams (dedup, risk state, incremental Elo): state off the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # no lookup for each write only to count the rows for a metric
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # stream-stream joins: one store a partition (column families) instead of four
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``courtline`` importable in the Python workers (the grouped folds and stream
    state functions are pickled by reference to this package).

    Local mode: the package is zipped once and added with ``addPyFile``. On a cluster the
    package is expected on the executors already (installed, or ``--py-files`` at submit):
    nothing is written to a machine-local folder there.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    _SHIPPED.add(id(sc))
    if not sc.master.startswith("local"):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="courtline-pyfiles-"), "courtline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (idempotent) and make the package
    available to the Python workers."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def build_session(master: str | None = None, app: str = "courtline", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false")
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session names none (local tests) a private folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="courtline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut_lineage(df: DataFrame, fmt: str = "checkpoint") -> DataFrame:
    """Cut the lineage at a step boundary into the shared checkpoint folder (survives
    executor loss, unlike local checkpoints). Default: reliable ``Dataset.checkpoint``;
    ``fmt='parquet'`` writes a Parquet table there instead (columnar and compressed — the
    better choice for wide step tables that are re-read with column pruning; slower for many
    small ones)."""
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    if fmt == "checkpoint":
        return df.checkpoint(eager=True)
    path = os.path.join(base, "tables", uuid.uuid4().hex)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
