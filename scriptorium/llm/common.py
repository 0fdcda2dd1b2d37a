"""What the operators of this subpackage share: table access, the shared scratch folder and word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, as a character class and as plain characters.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"
#: Bytes of an Arrow batch of whole texts. A Python worker holds several copies of a batch, keeps that memory for the tasks
#: to come, and stands beside a JVM that fills its heap.
BATCH = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. Only a session in one process, as in
    tests, may do without: there it is a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or "/tmp/checkpoints"


def materialize(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there, and a lost executor takes
    nothing with it. The folder is the cluster's scratch space and is emptied with it. Arrow batches hold ``batch`` bytes, if
    given, and the row that goes beyond; the session's own limit holds again when the table is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scriptorium/{name}-{uuid.uuid4().hex}"
    limit = spark.conf.get(BATCH_LIMIT)
    if batch:
        spark.conf.set(BATCH_LIMIT, str(batch))
    try:
        df.write.parquet(path)
    finally:
        if batch:
            spark.conf.set(BATCH_LIMIT, limit)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/scriptorium/" in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_CLASS + "+"), "")


def n_words(text) -> F.Column:
    """Number of words, without keeping them."""
    return F.size(words(text)).cast("long")
