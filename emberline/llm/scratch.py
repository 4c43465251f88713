"""Tables that cut lineage, written in the folder that all machines share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from emberline.llm.textkernel import release


#: Folders of local sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that the driver and all executors share is needed")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="emberline-")
        _OWN[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


#: Bytes of an Arrow batch; a task holds a few of them, on both sides.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to BATCH_BYTES, so that long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if int(now.rstrip("kmg") or 0) * scale > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def free_shuffles(spark: SparkSession) -> None:
    """Has the session remove a query's shuffle files when the query has ended; what is needed later is written."""
    with contextlib.suppress(Exception):  # versions without the setting keep them until the driver collects its garbage
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(spark: SparkSession) -> None:
    """Has the driver, Python and JVM, collect its garbage and give memory back, so that plans, broadcasts and shuffles of ended queries don't pile up in a long job."""
    release()
    with contextlib.suppress(Exception):  # where the session has no gateway the driver does so in its own time
        spark.sparkContext._jvm.java.lang.System.gc()


#: Tables after which the driver is tidied.
TIDY = 5


class Scratch:
    """A folder of written tables of one run; each can be dropped when no result needs it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        bound_batches(spark)
        free_shuffles(spark)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._emberline_path = path
        if self.count % TIDY == 0:
            tidy(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes written tables; only for those that no later plan reads."""
        jvm = self.spark._jvm
        for df in tables:
            p = jvm.org.apache.hadoop.fs.Path(df._emberline_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
