"""Quality rules with the cross-document frequency of lines.

Lines are normalised (A-Z lowered, white space runs to one space) and hashed. For each host (the source), a line's
frequency is the number of its documents that have it; a line over the host's limit, `LIMIT_SHARE` of the host's
documents but `LEAST_LIMIT` at least and `MOST_LIMIT` at most, is boilerplate. Exact copies of a text are one document
here, share its verdict, and are left to deduplication (`count_copies` counts each). A frequent line is removed from all
of the host's texts but its first (of the smallest id), so that of many near copies one stays whole (`keep_first=False`
removes it there too). A document is rejected when less than `LEAST_KEPT` of its words remain, or
when a base rule fails.

Frequencies are counted with partial sums before the shuffle, and only lines over a limit are joined back: broadcast
while there are at most `BROADCAST_LINES` of them, shuffled (with Spark's skew handling) beyond.

Defined results: a null text has no words and fails the base rule; a null source is a host of its own; repeated rows
each get their row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
LEAST_LIMIT, MOST_LIMIT, LIMIT_SHARE, LEAST_KEPT = 20, 200, 0.01, 0.3
BROADCAST_LINES = 250_000
SYMBOLS = b"#*$%&|<>"
_ROWS = 300
_SCHEMA = "row_no long, doc_id long, text_key long, host string, content long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def repeat_words(texts: list[list[bytes]]) -> list[int]:
    """For each list of words, those in WINDOW-word windows that the list has twice or more."""
    import numpy as np

    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for words in texts for w in words], np.uint64)
    sizes = np.array([len(words) for words in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(ids) < WINDOW:
        return [0] * len(texts)
    mix = np.uint64(0x9E3779B97F4A7C15)
    key = np.zeros(len(ids) - WINDOW + 1, np.uint64)
    for part in [*(ids[k : k + len(key)] for k in range(WINDOW)), doc[: len(key)].astype(np.uint64)]:
        key = (key ^ (part + np.uint64(1))) * mix
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(doc[: len(key)] == doc[WINDOW - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order[1:]] == key[order[:-1]] if len(order) else np.zeros(0, bool)
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else same
    ends = np.zeros(len(ids) + 1, np.int64)
    np.add.at(ends, order[twice], 1)
    np.add.at(ends, order[twice] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(ends[:-1]) > 0], minlength=len(texts)).tolist()


def measure(docs: DataFrame) -> DataFrame:
    """Base counts, content hash, and the different normalised lines with their words, of every row."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        row_no = TaskContext.get().partitionId() << 40
        # of each byte: 1 if it is a word's and starts a character, and 2 if it is a symbol
        kind = np.array([(b & 0xC0 != 0x80 and b not in common.SPACE) + 2 * (b in SYMBOLS) for b in range(256)], np.uint8)
        signed = lambda h: h - (h >> 63 << 64)
        for batch in common.slices(batches, _ROWS):
            texts = common.utf8(batch.column(1))
            out: dict[str, list] = {k: [] for k in ("content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "lines", "line_words")}
            all_words = []
            for text in texts:
                words = text.split()
                all_words.append(words)
                kinds = kind[np.frombuffer(text, np.uint8)]
                seen: set[bytes] = set()
                lines: dict[int, int] = {}
                with_word = 0
                for line in text.split(b"\n"):
                    if parts := line.split():
                        with_word += 1
                        seen.add(line)
                        h = signed(xxh3_64_intdigest(b" ".join(parts).lower()))
                        lines[h] = lines.get(h, 0) + len(parts)
                for k, x in zip(out, (signed(xxh3_64_intdigest(text)), len(words), int((kinds & 1).sum()), int((kinds >> 1).sum()), with_word - len(seen), list(lines), list(lines.values()))):
                    out[k].append(x)
            n = batch.num_rows
            longs = [pa.array(out[k], pa.int64()) for k in ("content", "n_words", "word_chars", "n_symbols", "n_dup_lines")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row_no, row_no + n), pa.int64()), batch.column(0), batch.column(3), batch.column(2), *longs, pa.array(repeat_words(all_words), pa.int64()), pa.array(out["lines"], pa.list_(pa.int64())), pa.array(out["line_words"], pa.list_(pa.int32()))],
                names=[x.split()[0] for x in _SCHEMA.split(", ")],
            )
            row_no += n

    return docs.select("doc_id", "text", "source", common.text_key().alias("text_key")).mapInArrow(rows, _SCHEMA)


def _host(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))


def verdicts(docs: DataFrame, *limits, **named) -> DataFrame:
    """doc_id, base counts, base_failed, kept, and words_left after the removal of frequent lines, of every row."""
    return _verdicts(docs, *limits, **named).drop("text_key", "host")


def _verdicts(
    docs: DataFrame, least_limit: int = LEAST_LIMIT, limit_share: float = LIMIT_SHARE, least_kept: float = LEAST_KEPT, broadcast_lines: int = BROADCAST_LINES, most_limit: int = MOST_LIMIT, count_copies: bool = False, keep_first: bool = True
) -> DataFrame:
    """What `verdicts` has, with text_key and host."""
    found = common.materialize(measure(docs), "lines").withColumn("host", _host("host"))
    # one document for each different text of a host: the first, with the number of its copies
    firsts = found.groupBy("host", "content").agg(F.min(F.struct("doc_id", "row_no")).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = firsts.select(F.col("first.row_no").alias("first_no"), F.col("copies") if count_copies else F.lit(1).alias("copies"))
    texts = common.materialize(found.join(firsts, found["row_no"] == F.col("first_no")).select("host", "content", "doc_id", "row_no", "lines", "copies"), "lines-texts")
    limits = texts.groupBy("host").agg(F.least(F.lit(float(most_limit)), F.greatest(F.lit(float(least_limit)), F.sum("copies") * limit_share)).alias("limit"))
    counted = texts.select("host", F.explode("lines").alias("line"), "copies", F.struct("doc_id", "row_no", "content").alias("at")).groupBy("host", "line").agg(F.sum("copies").alias("n"), F.min("at").alias("first"))
    over = common.materialize(counted.join(limits, "host").where("n > limit").select("host", "line", F.col("first.content").alias("stays_in")), "lines-over")
    side = F.broadcast(over) if over.count() <= broadcast_lines else over
    lines = found.select("row_no", "host", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row_no", "host", "content", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = lines.join(side, ["host", "line"])
    if keep_first:
        removed = removed.where("content <> stays_in")
    removed = removed.groupBy("row_no").agg(F.sum("words").alias("removed"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    kept = ~failed & (left >= F.col("n_words") * least_kept)
    return found.join(removed, "row_no", "left").select("doc_id", "text_key", found["host"], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), left.alias("words_left"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows, with their columns, that are kept: each by its own text and host, whatever its id."""
    good = _verdicts(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_text"), F.col("host").alias("kept_host")).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (common.text_key() == F.col("kept_text")) & (_host("source") == F.col("kept_host")), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(common.table(spark, sf_dir, "documents")).drop("words_left")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
wins AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM w, unnest(range(1, len(words) - 3)) AS t(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS t(k) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
      FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
lw AS (SELECT doc_id, host, text, line, len(lw) AS words,
       translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
texts AS (SELECT host, text, min(doc_id) AS first_id FROM d GROUP BY host, text),
limits AS (SELECT host, least(200.0, greatest(20.0, 0.01 * count(*))) AS lim FROM texts GROUP BY host),
freq AS (SELECT host, norm, count(*) AS n, min(first_id) AS stays FROM
         (SELECT DISTINCT x.host, x.norm, t.first_id FROM lw x JOIN texts t ON x.host = t.host AND x.text = t.text) GROUP BY host, norm),
frequent AS (SELECT f.host, f.norm, t.text AS stays_in FROM freq f JOIN limits m ON f.host = m.host AND f.n > m.lim
         JOIN texts t ON t.host = f.host AND t.first_id = f.stays),
gone AS (SELECT x.doc_id, sum(x.words) AS n FROM lw x JOIN frequent o ON x.host = o.host AND x.norm = o.norm AND x.text <> o.stays_in GROUP BY x.doc_id),
b AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS gone
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - gone >= 0.3 * n_words AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
"""
