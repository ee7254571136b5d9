"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word pattern `[^\x20\x09-\x0D]+`; `bytes.split()` splits at exactly these bytes.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Only where that setting is absent (tests on one machine) is a temporary folder made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_keyflow_checkpoint_dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = sc._keyflow_checkpoint_dir = tempfile.mkdtemp(prefix="keyflow-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: later steps start from the files, so that
    a lost executor costs its running tasks only."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_is(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_key() -> Column:
    """A number of a row's text, null as empty; beside the id it names the row, whatever ids are null or repeated."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches, rows: int):
    """Arrow batches of at most so many rows, to bound what a task holds as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(column, most_bytes: int, most_rows: int):
    """Of an Arrow string column, null as empty: the number of a first row, and texts from there of at most so many bytes
    and rows, or one text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else ()
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1)
        to = min(to, at + most_rows)
        yield at, texts.slice(at, to - at)
        at = to
