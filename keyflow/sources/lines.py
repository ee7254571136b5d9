"""Text lines and record tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FlowConfig
from .paths import PathTemplate

SPLIT_BYTES = 32 << 20
#: Line ends, the longer first. In "pairs", CR LF ends two lines; in "spark", LF CR does.
ENDS = {"spark": rb"\r\n|\n|\r", "pairs": rb"\n\r|\n|\r"}
_MORE = 1 << 16


def read_lines(spark: SparkSession, path: str, newline: str = "spark", split_bytes: int | None = None, split_count: int | None = None) -> DataFrame:
    """line: the lines of text files. A line belongs to the split where it starts; nothing follows a last line end.

    `newline="spark"` ends lines at LF, CR LF and CR; `newline="pairs"` ends them at LF CR, LF and CR. Files are read by
    Spark's own reader, or, for pairs and for given splits, in byte ranges: of `split_bytes` (by default `SPLIT_BYTES`),
    or of a file's length over `split_count` each, of which a rest is one more. A task then holds a range and the rest of
    its last line. Bytes that aren't UTF-8 become the replacement character.
    """
    if newline not in ENDS:
        raise ValueError(f"newline is one of {', '.join(ENDS)}")
    if newline == "spark" and not split_bytes and not split_count:
        return spark.read.text(path).select(F.col("value").alias("line"))
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")  # the listing: contents aren't read
    width = F.greatest(F.lit(1), F.expr(f"length div {split_count}")) if split_count else F.lit(split_bytes or SPLIT_BYTES)
    files = files.withColumn("width", width.cast("long"))
    ranges = files.select("path", "length", "width", F.explode(F.expr("sequence(0L, length - 1, width)")).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    ends = ENDS[newline]

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, length, width, start in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path) as file:
                    found = list(lines_in(file, length, start, min(length, start + width), ends))
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 10_000], pa.string())], names=["line"])

    return ranges.mapInArrow(rows, "line string")


def read_configured(spark: SparkSession, path: str, config: FlowConfig, template: PathTemplate | None = None) -> DataFrame:
    """line: by the settings' dialect and split length; a template expands the path first."""
    path = template.get(template.expand(path)) if template else path
    return read_lines(spark, path, config.newline, None if config.newline == "spark" and config.split_bytes == SPLIT_BYTES else config.split_bytes)


def opened(path: str):
    """A seekable Arrow file for a local path or a URI that Arrow's file systems know."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))
    found, inner = fs.FileSystem.from_uri(path)
    return found.open_input_file(inner)


def lines_in(file, length: int, start: int, end: int, ends: bytes) -> list[str]:
    """The lines that start in [start, end) of a file."""
    base, pattern = max(0, start - 1), re.compile(ends)  # one byte before tells whether a line starts here
    data = file.read_at(end + 1 - base, base)
    begins = [] if start else [0]
    cuts = []
    for found in pattern.finditer(data):
        cuts.append((found.start(), found.end()))
        if start <= base + found.end() < end:
            begins.append(found.end())
    out, k = [], 0
    for a in begins:
        while k < len(cuts) and cuts[k][0] < a:
            k += 1
        if k < len(cuts):
            out.append(data[a : cuts[k][0]])
            continue
        parts, at = [data[a:]], base + len(data)  # the last line goes on behind the range
        while at < length and not re.search(rb"[\r\n]", parts[-1]):
            parts.append(file.read_at(_MORE, at))
            at += len(parts[-1])
        out.append(re.split(rb"[\r\n]", b"".join(parts), maxsplit=1)[0])
    return [line.decode("utf-8", "replace") for line in out]


def split_lines(df: DataFrame, text) -> DataFrame:
    """Add `line_no` and `line`: the lines of a text column by the pairs dialect; nothing follows a last line end."""
    parts = F.split(text, "\n\r|\n|\r")
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return df.select("*", F.posexplode(kept).alias("line_no", "line"))


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay(df: DataFrame, saved: str) -> DataFrame:
    """Records that were saved as Parquet, before those of `df`."""
    return df.sparkSession.read.parquet(saved).unionByName(df)
