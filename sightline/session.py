"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators were planned with.  All are runtime SQL settings, so they can be put on a
# session that somebody else built; values the user set, whatever they are, are left alone by ``tuned``.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even when that costs one more exchange after it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # JSON-LD in the wild repeats keys; keep the last one like common JSON readers
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Put those of the library's SQL settings on a session that nobody has set, and return it."""
    taken = {r["key"] for r in spark.sql("SET").collect()}  # what has been set, on the session or where it was built
    for key, value in SQL_SETTINGS.items():
        if key not in taken:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "sightline", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # noting the Python line of every column doubles the time to state a large plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = tuned(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Where the cluster names none (tests, a laptop) a temporary folder is taken, which is only right
    when driver and executors share one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="sightline-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete a stored table that nothing reads any more."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
