"""Helpers shared by the operators: scratch tables in the shared folder, row keys, word patterns."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything but space and the ASCII white space 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where that is unset and all is one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="postglean-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables() -> list[str]:
    """Paths of the tables that ``written`` has made and that are still there."""
    return list(_scratch)


def made_since(before: list[str], *names: str) -> list[str]:
    """Tables that ``written`` has made since ``scratch_tables`` gave ``before``, of these names if any are given."""
    return [x for x in _scratch if x not in set(before) and (not names or x.rpartition("/scratch-")[2].rpartition("-")[0] in names)]


def clear_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of ``written``, and shuffles that nothing refers to; only for callers that have stored what was derived from them."""
    gc.collect()  # lets go of frames that only the JVM's side of them holds
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        if name in _scratch:
            _scratch.remove(name)
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
    jvm.System.gc()  # the driver removes shuffle files once it finds that their data can't be asked for any more


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of at most ``rows``: bounds what Python objects of a batch take."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")
