"""Mixing sources to target weights with a low-discrepancy schedule.

A source's documents are shuffled by a hash of the id and laid end to end; the line is cut into blocks of `BLOCK` words.
A source gives its line as often as its target has it, and then the line's beginning: so many turns, a block each, of
which the last takes the beginning of its block. All sources' turns together are the plan's slots, which grow with the
input. Slot i goes to the source in whose share of the line [0, 1) the golden-ratio point frac(i * phi) falls (in 32-bit
integers); every run of slots holds each source close to its weight. Slots are ranked by source, and the k-th takes the
source's k-th turn. Points beyond a source's turns are left out, and turns that no point reaches (of sources too small
for any) come after the last point, so that all turns are taken and targets are met to the word, at every size. What a
document gives is what the slots take of its words; `planned` returns slots with source, block, and words.

Positions are sums in two steps (documents within hash buckets, then buckets), and ranks likewise (slots within
runs, then runs), so that a source with a third of all rows is not one group. Targets are worked out from one row a
source; such tables are broadcast up to `BROADCAST_SOURCES` rows and joined by a shuffle beyond.

Defined results: null texts have size 0 and give nothing; the null source comes last in the order of weights;
repeated ids are separate documents, ordered by their text's hash; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, MAX_PASSES, BLOCK = (5, 2, 1), 3, 512
BROADCAST_SOURCES = 100_000
#: floor(2**32 / golden ratio), odd: the points of successive slots, as 32-bit fractions.
STEP = 2654435769
_RUN, _BUCKET, _BIN_BITS = 4096, 64, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, passes: int = MAX_PASSES) -> dict[str | None, float]:
    """What each source is to give of the total, by weight, none more than `passes` times its size.

    `sizes`: one entry a source. In code point order, null last, sources weigh `weights`, repeated.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(ordered)}
    size, out, free = dict(ordered), {}, [s for s, _ in ordered]
    left = float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > passes * size[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(passes * size[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def turns(size: int, target: float, block: int = BLOCK) -> tuple[int, int, int, int]:
    """Whole passes over a source's line, the words of its beginning that come on top, its blocks, and its turns."""
    if not size:
        return 0, 0, 1, 0
    whole = int(target / size)
    rest = max(0, int(target - whole * size))
    blocks = -(-size // block)
    return whole, rest, blocks, whole * blocks + -(-rest // block)


def _side(df: DataFrame, rows: int) -> DataFrame:
    """A table of one row a source, or of bins and sources: broadcast if it is small."""
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def schedule(spark: SparkSession, counts: list[tuple[int, int]]) -> DataFrame:
    """slot, source_no, turn: each of the sources (source_no, turns) has all of its turns, from 0, in rising slots."""
    total = sum(n for _, n in counts)
    shares, at = [], 0
    for no, n in counts:
        if n:
            shares.append((no, n, (at << 32) // total, (at + n << 32) // total))
        at += n
    shares = spark.createDataFrame(shares, "source_no int, turns long, since long, upto long")
    # the sources that have points in each of 2**16 equal bins: as many rows as bins and sources
    width = 32 - _BIN_BITS
    bins = shares.where("since < upto").withColumn("bin", F.explode(F.expr(f"sequence(shiftright(since, {width}), shiftright(upto - 1, {width}))")))
    points = spark.range(total).select(F.col("id").alias("slot"), (F.col("id") * STEP).bitwiseAND((1 << 32) - 1).alias("point"), F.expr(f"id div {_RUN}").alias("run"))
    points = points.withColumn("bin", F.shiftright("point", width)).join(_side(bins.drop("turns"), len(counts)), "bin").where("point >= since AND point < upto").select("slot", "source_no", "run")
    runs = points.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = common.materialize(runs.select("source_no", "run", "n", before.alias("before")), "mix-runs")
    within = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1
    ranked = points.withColumn("within", within).join(runs.drop("n"), ["source_no", "run"]).select("slot", "source_no", (F.col("before") + F.col("within")).alias("turn"))
    ranked = ranked.join(_side(shares.select("source_no", "turns"), len(counts)), "source_no").where("turn < turns").select("slot", "source_no", "turn")
    reached = runs.groupBy("source_no").agg(F.sum("n").alias("reached"))
    late = shares.join(reached, "source_no", "left").select("source_no", F.coalesce("reached", F.lit(0)).alias("reached"), "turns").where("reached < turns")
    late = late.select("source_no", F.explode(F.sequence("reached", F.col("turns") - 1)).alias("turn"))
    return ranked.unionByName(late.select((F.lit(total) + F.col("turn")).alias("slot"), "source_no", "turn"))


def _plan(sized: DataFrame, passes: int, block: int) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """A row for each source (source_no, source_size, target, whole, rest, blocks), its turns, and the number of documents."""
    found = [(r.source, r.size, r.docs) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()]  # one row a source
    goals, of = targets([(s, n) for s, n, _ in found], passes=passes), {s: n for s, n, _ in found}
    names = sorted(goals, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    rows = [(s, k, of[s], goals[s], *turns(of[s], goals[s], block)) for k, s in enumerate(names)]
    sources = sized.sparkSession.createDataFrame([r[:-1] for r in rows], "source string, source_no int, source_size long, target double, whole long, rest long, blocks long")
    return sources, [(r[1], r[-1]) for r in rows], sum(n for *_, n in found)


def planned(sources: DataFrame, counts: list[tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """slot, source_no, turn, block (its number in the source's line), words (of the block, from its first)."""
    plan = schedule(sources.sparkSession, counts).join(_side(sources, len(counts)), "source_no")
    number = F.expr("turn % blocks")
    own = F.least(F.lit(block), F.col("source_size") - number * block)
    words = F.when(F.expr("turn div blocks") < F.col("whole"), own).otherwise(F.least(own, F.col("rest") - number * block))
    return plan.select("slot", "source_no", "turn", number.alias("block"), words.alias("words"))


def mix(docs: DataFrame, passes: int = MAX_PASSES, block: int = BLOCK) -> DataFrame:
    """row_no, doc_id, tie (the text's hash), source, size, source_size, target, taken, and copies (whole ones: as many
    as there are whole passes, and one more up to the word at which the rest ends): one row for each of `docs`."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("order"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"))
    sized = common.materialize(sized, "mix-sizes")
    sources, counts, n_docs = _plan(sized, passes, block)
    buckets = max(1, min(1 << 20, n_docs // _BUCKET))
    placed = sized.join(_side(sources, len(counts)), sized.source.eqNullSafe(sources.source)).select(sized["*"], "source_no", "source_size", "target", "whole", "rest").withColumn("bucket", F.expr(f"CAST(conv(substring(`order`, 1, 8), 16, 10) AS BIGINT) * {buckets} div 4294967296"))
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source_no", "bucket", before.alias("before"))
    here = Window.partitionBy("source_no", "bucket").orderBy("order", "doc_id", "tie")
    within = F.coalesce(F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("within", within).withColumn("nth", F.row_number().over(here)).join(sums, ["source_no", "bucket"])
    placed = placed.withColumn("at", F.col("before") + F.col("within"))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("at") * 2 + F.col("size") < F.col("rest") * 2).cast("int")).otherwise(0)
    placed = placed.select(F.struct("source_no", "bucket", "nth").alias("row_no"), "doc_id", "tie", "source", "source_no", "size", "source_size", "target", "at", copies.cast("long").alias("copies"))
    placed = common.materialize(placed, "mix-placed")
    # the part of each block that each document has, and how often slots take the block whole or its first words
    last = F.col("at") + F.col("size")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    parts = parts.select("row_no", "source_no", "block", F.greatest(F.col("at") - F.col("block") * block, F.lit(0)).alias("a"), F.least(last - F.col("block") * block, F.lit(block)).alias("b"))
    slots = planned(sources, counts, block).groupBy("source_no", "block", "words").agg(F.count(F.lit(1)).alias("times"))
    taken = parts.join(slots, ["source_no", "block"]).groupBy("row_no").agg(F.sum(F.greatest(F.least("b", "words") - F.col("a"), F.lit(0)) * F.col("times")).alias("taken"))
    return placed.join(taken, "row_no", "left").select("row_no", "doc_id", "tie", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with their columns: each in its whole copies, so that a source is off its target by half
    a document at most. Rows that share id, text and source, which nothing tells apart, share out their copies."""
    copies = mix(docs).where("copies > 0").groupBy("doc_id", "tie", "source").agg(F.sum("copies").alias("mix_copies"))
    copies = copies.select(F.col("doc_id").alias("mix_id"), F.col("tie").alias("mix_text"), F.col("source").alias("mix_source"), "mix_copies")
    columns = [docs[c] for c in docs.columns]
    own = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", own.alias("tie")).groupBy("doc_id", "tie", "source").agg(F.count(F.lit(1)).alias("mix_rows"))
    rows = rows.select(F.col("doc_id").alias("rows_id"), F.col("tie").alias("rows_text"), F.col("source").alias("rows_source"), "mix_rows")
    copies = copies.join(rows, F.col("mix_id").eqNullSafe(F.col("rows_id")) & (F.col("mix_text") == F.col("rows_text")) & F.col("mix_source").eqNullSafe(F.col("rows_source"))).drop("rows_id", "rows_text", "rows_source")
    copies = common.materialize(copies, "mix-copies")
    this = docs["doc_id"].eqNullSafe(F.col("mix_id")) & (own == F.col("mix_text")) & docs["source"].eqNullSafe(F.col("mix_source"))
    alone = docs.join(copies.where("mix_rows = 1"), this).select(*columns, F.col("mix_copies"))
    nth = F.row_number().over(Window.partitionBy("mix_id", "mix_text", "mix_source").orderBy(F.lit(1)))
    alike = docs.join(copies.where("mix_rows > 1"), this).withColumn("mix_nth", nth)
    alike = alike.select(*columns, F.expr("mix_copies div mix_rows + CAST(mix_nth <= mix_copies % mix_rows AS INT)").alias("mix_copies")).where("mix_copies > 0")
    joined = alone.unionByName(alike)
    return joined.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).drop("mix_copy", "mix_copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total FROM s),
-- the sources in the order in which they reach three times their size; level k leaves the first k at that
r AS (SELECT w.*, row_number() OVER (ORDER BY 3.0 * source_size / weight, no) AS k FROM w),
c AS (SELECT r.*, CAST(coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped,
      CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS free FROM r),
lev AS (SELECT min_by(capped, k) AS capped, min_by(free, k) AS free FROM c, t WHERE (t.total - capped) * weight / free <= 3 * source_size),
g AS (SELECT r.source, r.no, r.source_size, CASE WHEN (t.total - lev.capped) * weight / lev.free > 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
      ELSE (t.total - lev.capped) * weight / lev.free END AS target FROM r, t, lev),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - pos)) AS BIGINT) AS taken
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
"""
