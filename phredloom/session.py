"""Session defaults."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "phredloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` entries (dots as ``__``) override."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


class Scratch:
    """Folders for intermediate tables under one root on any file system that Spark writes to.

    ``root`` defaults to ``spark.checkpoint.dir``, else a folder of the
    warehouse: places that driver and executors share.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        where = root or spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        self.root = f"{where.rstrip('/')}/phredloom-{uuid.uuid4().hex}"
        self.peak = 0

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name or uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str = "") -> DataFrame:
        """``df`` written and read back: computed once, and lineage ends here."""
        to = self.path(name)
        df.write.mode("overwrite").parquet(to)
        self.peak = max(self.peak, size(self.spark, self.root))
        return self.spark.read.schema(df.schema).parquet(to)

    def purge(self) -> None:
        at, fs = _hadoop(self.spark, self.root)
        fs.delete(at, True)


def partitions(spark: SparkSession, wanted: int) -> list[int]:
    """What goes before the columns of a repartition: nothing while the session's own number, which adaptive execution may lower, is enough, else ``wanted``."""
    return [wanted] if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else []


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _hadoop(spark, path)
    return fs.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes under a path of any Hadoop file system; 0 if it does not exist."""
    at, fs = _hadoop(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0
