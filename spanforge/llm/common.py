"""Helpers shared by the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor and the driver share; Spark's own writers commit them, so a lost
executor costs a retry and never a result. A table written inside ``cleared`` is
deleted when the block ends; a result that a caller reads lazily is written with ``keep``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python, about: rows are counted by bytes, whatever their number.
ARROW_BYTES = 2 << 20
#: A word of the text contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_JAVA = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Tables written in each open ``cleared`` block, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("spanforge_open", default=())


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    if text.isascii():
        return text.lower()
    return text.translate(_ASCII_LOWER)


def ascii_lower_col(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``: no name of theirs can clash with one of ours."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("row").getField(c).alias(c) for c in columns))


def arrow_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: a worker holds one batch, or one text where that is longer.

    Lazy results are planned when they are read, so the bound stays set for the session. It
    changes no result, and a lower bound of the user's is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)([bkmgt]?)b?", str(spark.conf.get(key)).strip().lower())
    size = int(found[1]) << 10 * "bkmgt".index(found[2] or "b") if found else 0
    if not 0 < size <= ARROW_BYTES:
        spark.conf.set(key, f"{ARROW_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors; one of our own only where all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def published(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    Inside ``cleared`` the table goes with the block; with ``keep``, with the block around it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    owners = _OPEN.get()[:-1] if keep else _OPEN.get()
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the tables published inside, once whatever reads them has been written."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in own:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
