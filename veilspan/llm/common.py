"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import ship_package

#: The white space that separates words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_CLASS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Only a local master, whose single machine runs everything, may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return f"file://{tempfile.gettempdir()}/veilspan-shared"


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs its tasks, not what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspan/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that stage_table wrote, once no later step reads it."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/veilspan/" in folder and folder.replace("file:///", "file:/").startswith(root.replace("file:///", "file:/")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_state: dict = {}


def worker_state(build, *args):
    """What ``build(*args)`` makes, kept by the worker process for its next tasks.

    Workers outlive a stage, so what one operator has learnt would stay beside what the next one learns: a worker
    keeps one such thing and lets it go before it builds another.
    """
    key = (build.__module__, build.__qualname__, args)
    if key not in _state:
        import pyarrow as pa

        _state.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _state[key] = build(*args)
    return _state[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder; also makes sure that workers can import this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where an installed public tokenizer file lies; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
