"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 4 of their 8 bytes: they share the bytes of
at least 4 positions. That is the guaranteed minimum of the count filter. A plain index of (position, byte) has lists of
a 256th of all fingerprints; so the index posts each different fingerprint under its bytes at every 4 of the 8 positions
(70 posting lists, each of four positional bytes), in which exactly the pairs that share those meet. For each pair that
is met in a list, the shared positional bytes are tallied over all 8 positions; a pair is retained where the tally is 4
or more, by the one list of the first 4 positions that it shares, and verified by its differing bits. A task reads its
lists in key order and passes on only as many links as connect a list's fingerprints: a group of copies yields links in
proportion to its fingerprints, not to its pairs. Within a list of over `_LONG` fingerprints the other four bytes are
indexed again, by five runs of bits of which two similar ones share at least one.

Exact copies share one fingerprint and are one row of the index, whatever their number.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; rows with a null
doc_id are linked like any other and get the smallest id of their class, or null if there is none; repeated rows each get their row;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, SEED, MAX_BITS, BYTES = 4, 42, 4, 8
LEAST_SHARED = BYTES - MAX_BITS
POSITIONS = list(combinations(range(BYTES), LEAST_SHARED))
#: Lists longer than this are indexed again within.
_LONG, _ROWS = 4096, 200


def fingerprint(text: bytes) -> int:
    """The bits set in over half the shingles' hashes; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, counts = len(words) - WORDS + 1, np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = zip(starts[at : min(n, at + 8192)].tolist(), ends[at + WORDS - 1 : min(n, at + 8192) + WORDS - 1].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in part], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long) of every row."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in common.slices(batches, _ROWS):
            found = np.array([fingerprint(t) for t in common.utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found)], names=["doc_id", "text_key", "fp"])

    return docs.select("doc_id", "text", common.text_key().alias("text_key")).mapInArrow(rows, "doc_id long, text_key long, fp long")


@cache
def _owners():
    """For each set of shared positions, as bits: the list of its first four, or -1 where the tally is below four."""
    import numpy as np

    sets = ([p for p in range(BYTES) if k >> p & 1] for k in range(1 << BYTES))
    return np.array([POSITIONS.index(tuple(s[:LEAST_SHARED])) if len(s) >= LEAST_SHARED else -1 for s in sets])


def _similar(differ, which):
    """Of pairs, by their differing bits, that a list (or an array of lists) has met: those that it retains and that are similar."""
    import numpy as np

    shared = np.packbits(differ.reshape(-1, 1).view(np.uint8).reshape(-1, BYTES) == 0, axis=1, bitorder="little")[:, 0]
    return (_owners()[shared] == which) & (np.bitwise_count(differ) <= MAX_BITS)


def _spanning(values, which: int) -> list[tuple[int, int]]:
    """Links that connect all of the values that chains of similar pairs connect, of those that the list retains."""
    import numpy as np

    out: list[tuple[int, int]] = []
    rest = values
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = []
            for value in front:
                near = _similar(rest ^ value, which)
                if near.any():
                    reached.append(rest[near])
                    out += [(int(value), int(x)) for x in rest[near]]
                    rest = rest[~near]
            front = np.concatenate(reached) if reached else rest[:0]
    return out


def _runs(values, positions: tuple[int, ...]):
    """The bits at the positions that a posting list's key leaves open, as five runs: a value's run under (run, value)."""
    import numpy as np

    open_bits = [8 * p + b for p in range(BYTES) if p not in positions for b in range(8)]
    for run in np.array_split(np.array(open_bits), MAX_BITS + 1):
        key = np.zeros(len(values), np.uint64)
        for k, bit in enumerate(run.tolist()):
            key |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        order = np.argsort(key, kind="stable")
        yield from np.split(values[order], np.flatnonzero(np.diff(key[order])) + 1)


def _links(batches: Iterator) -> Iterator:
    """Posting lists, as rows (list, key, fp) in order, to links (a, b) of fingerprints."""
    import numpy as np
    import pyarrow as pa

    held: list = []  # pieces of the list that is still open

    def of(lists, keys, values):
        cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(lists) != 0)) + 1
        edges = np.concatenate([[0], cut, [len(keys)]])
        sizes = np.diff(edges)
        out = []
        two = edges[:-1][sizes == 2]
        a, b = values[two], values[two + 1]
        near = _similar(a ^ b, lists[two])
        out += zip(a[near].tolist(), b[near].tolist())
        for k in np.flatnonzero(sizes > 2):
            part, which = values[edges[k] : edges[k + 1]], int(lists[edges[k]])
            if len(part) <= _LONG:
                out += _spanning(part, which)
            else:
                for again in _runs(part, POSITIONS[which]):
                    if len(again) > 1:
                        out += _spanning(again, which)
        found = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.array(c) for c in batch.columns]
        now[2] = now[2].view(np.uint64)
        if held and (now[0][0], now[1][0]) != (held[-1][0][0], held[-1][1][0]):
            yield of(*[np.concatenate(x) for x in zip(*held)])
            held = []
        last = np.flatnonzero((np.diff(now[1]) != 0) | (np.diff(now[0]) != 0))
        if not len(last):  # one list so far: as many fingerprints as share four bytes
            held.append(now)
            continue
        end = int(last[-1]) + 1
        yield of(*[np.concatenate(x) for x in zip(*held, [c[:end] for c in now])])
        held = [[c[end:] for c in now]]
    if held:
        yield of(*[np.concatenate(x) for x in zip(*held)])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """fp -> links a, b that connect exactly the fingerprints that chains of at most 4 differing bits connect."""
    fp = F.col("fp")
    byte = [F.shiftrightunsigned(fp, 8 * p).bitwiseAND(255) for p in range(BYTES)]

    def key(positions):
        out = byte[positions[0]]
        for p in positions[1:]:
            out = F.shiftleft(out, 8).bitwiseOR(byte[p])
        return out

    postings = F.explode(F.array(*[F.struct(F.lit(k).alias("list"), key(p).alias("key")) for k, p in enumerate(POSITIONS)]))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt anew before they multiply: a few files would be a few tasks
    rows = distinct.repartition(n, "fp").select("fp", postings.alias("posting")).select("posting.list", "posting.key", "fp")
    return rows.repartition(n, "list", "key").sortWithinPartitions("list", "key").mapInArrow(_links, "a long, b long").distinct()


def _classes(found: DataFrame) -> DataFrame:
    """fp, first, root: of each different fingerprint of doc_id, text_key, fp, its first row (id, null last, then text)
    with the number of rows that repeat it, and the fingerprint that stands for its class."""
    rows = found.groupBy("fp", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n")).alias("first")
    classes = common.materialize(rows.groupBy("fp").agg(first), "simhash-classes")
    reached = components(fingerprint_links(classes.select("fp")))
    return classes.join(reached, classes["fp"] == reached["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    found = common.materialize(fingerprints(docs), "simhash")
    classes = common.materialize(_classes(found).select("fp", "root", F.col("first.doc_id").alias("first_id")), "simhash-roots")
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return found.join(classes.join(least, "root"), "fp").select("doc_id", "fp", "component_id")


def one_row_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies, with its columns: that of the smallest id, null last, and among rows that
    share it that of the smallest text hash. Rows of different classes stay even if they share an id or have none."""
    stays = _classes(common.materialize(fingerprints(docs), "simhash")).groupBy("root").agg(F.min("first").alias("first"))
    stays = common.materialize(stays.select(F.col("first.doc_id").alias("stays_id"), F.col("first.text_key").alias("stays_text"), F.col("first.n").alias("n")), "simhash-stays")
    columns = [docs[c] for c in docs.columns]
    this = docs["doc_id"].eqNullSafe(F.col("stays_id")) & (common.text_key() == F.col("stays_text"))
    once = docs.join(stays.where("n = 1"), this).select(*columns)
    repeated = docs.join(stays.where("n > 1"), this).select(*columns, common.text_key().alias("_text_key"))
    return once.unionByName(repeated.dropDuplicates(["doc_id", "_text_key"]).drop("_text_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
