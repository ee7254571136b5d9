"""Toxicity by a factorization machine over hashed terms.

A text's terms (runs of letters, A-Z lowered, and their first `STEM_LETTERS` letters, which inflected forms share) are
hashed to 2**18 buckets, and each bucket that a text has is a feature of value `VALUE`. The score is the logistic of
`bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`, so two terms that are harmless alone can weigh together.

All buckets are fitted together, by gradient steps over sparse rows; none is chosen beforehand. Penalties keep out what
the rows don't bear out: on each |w_i| (`L1`) and on the length of each v_i (`LV`), taken off after each step, so that
most are zero in the end. The linear weights come first, then the pairs on what they leave, from random v of size `INIT`.
The rarer class weighs as much as the other.

It is fitted on a bounded sample of labelled rows (`MAX_TRAIN_ROWS`, by a hash of the id): in each round every task takes
steps over its own rows from the shared weights, and the rows' weighted mean of the tasks' weights starts the next round.
Weights are BUCKETS * (RANK + 1) numbers, whatever the input.

Defined results: null and empty texts score by the bias alone; with no labelled row, or labels of one class only,
all texts score that class's smoothed share. Repeated rows each get their row; of a repeated labelled id, one text is
learned. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TRAIN_ROWS, ROWS_PER_TASK = 20_000, 2_500
BUCKETS, RANK, VALUE, INIT = 1 << 18, 4, 0.5, 0.1
#: Steps of each round, and whether it fits pairs.
ROUNDS = ((60, False), (60, True), (40, True))
RATE, L1, LV, L2 = 0.05, 1e-3, 2e-3, 1e-4
STEM_LETTERS = (5, 6, 7)
THRESHOLD = 0.7
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_KEEP, _ROWS = 300_000, 500


@dataclass
class Model:
    """The bias, and w and v of every bucket."""

    bias: float
    w: object
    v: object


def blank(bias: float = 0.0) -> Model:
    import numpy as np

    return Model(bias, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32))


def term_buckets(term: bytes) -> list[int]:
    """Buckets of a run of letters and of its beginnings."""
    letters = term.decode(errors="ignore")
    stems = [f"^{letters[:k]}".encode() for k in STEM_LETTERS if len(letters) > k]
    return [zlib.crc32(t) % BUCKETS for t in [term, *stems]]


def _buckets(batches: Iterator) -> Iterator:
    """A row of distinct buckets for each text."""
    import pyarrow as pa

    known: dict[bytes, list[int]] = {}
    for batch in common.slices(batches, _ROWS):
        lists = []
        for text in common.utf8(batch.column(0)):
            found: set[int] = set()
            for t in set(_TERM.findall(text.lower())):
                if (b := known.get(t)) is None:
                    b = known[t] = term_buckets(t)
                found.update(b)
            lists.append(sorted(found))
            if len(known) > _KEEP:
                known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["terms", "toxic", "doc_id"])


class Rows:
    """Sparse rows: the features of all rows end to end, and sums over each row's or each feature's."""

    def __init__(self, rows: list):
        import numpy as np

        sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.fromiter((b for r in rows for b in r), np.int64, int(sizes.sum()))
        self.row, self.starts = np.repeat(np.arange(len(rows)), sizes), np.concatenate([[0], np.cumsum(sizes)])

    @staticmethod
    def sums(values, starts):
        import numpy as np

        out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            out[some] = np.add.reduceat(values, starts[some], axis=0)
        return out

    def scores(self, at, bias: float, w, v):
        """The machine's value for each row, and the sums of its features' v; `at` numbers the features in w and v."""
        s = self.sums(v[at], self.starts) * VALUE
        squares = self.sums((v * v).sum(1)[at], self.starts) * VALUE**2
        return bias + self.sums(w[at], self.starts) * VALUE + 0.5 * ((s * s).sum(1) - squares), s


def steps(rows: list, y, weight, model: Model, n: int, pairs: bool):
    """The bias, the buckets that the rows have, and their w and v, after steps over all rows, which count by their weight."""
    import numpy as np

    x = Rows(rows)
    found, at = np.unique(x.at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    row, starts = x.row[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(found)))])
    bias, w, v = np.float64(model.bias), model.w[found], model.v[found]
    params = [w, v] if pairs else [w]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    mean = square = 0.0
    weight = weight / weight.sum()
    for t in range(1, n + 1):
        first, second = 1 - 0.9**t, 1 - 0.999**t
        z, sums = x.scores(at, bias, w, v)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight).astype(np.float32)
        by_feature = Rows.sums(d[row], starts)
        grads = [by_feature * np.float32(VALUE)]
        if pairs:
            grads.append(Rows.sums((d[:, None] * sums)[row], starts) * np.float32(VALUE) - (by_feature * np.float32(VALUE**2) - np.float32(L2))[:, None] * v)
        mean, square = mean + 0.1 * (d.sum() - mean), square + 0.001 * (d.sum() ** 2 - square)
        bias -= RATE * (mean / first) / (np.sqrt(square / second) + 1e-8)
        for k, (p, g) in enumerate(zip(params, grads)):
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.001 * (g * g - s[k])
            size = (RATE / (np.sqrt(s[k] / second) + 1e-4)).astype(np.float32)
            p -= size * m[k] / np.float32(first)
            if k == 0:
                np.copyto(p, np.sign(p) * np.maximum(np.abs(p) - size * np.float32(L1), 0))
            else:
                length = np.sqrt((p * p).sum(1, keepdims=True)) + np.float32(1e-12)
                p *= np.maximum(1 - size.mean(1, keepdims=True) * np.float32(LV) / length, 0)
    return float(bias), found, w, v


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from doc_id, text and doc_id, toxic. Only the sample's ids and labels are broadcast: max_rows rows."""
    import math

    import numpy as np

    spark = docs.sparkSession
    labels = labels.select("doc_id", F.col("toxic").cast("float").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = max_rows / max(1, labels.count())
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "doc_id")
    rows = rows.mapInArrow(_buckets, "terms array<int>, toxic float, doc_id long")
    # one row an id, however often it is repeated: the sample stays within max_rows
    rows = common.materialize(rows.groupBy("doc_id").agg(F.min(F.struct("terms", "toxic")).alias("x")).select("doc_id", "x.terms", "x.toxic"), "fm")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    if not 0 < positive < n:
        return blank(math.log((positive + 1) / (n - positive + 1)))
    even, model = (n - positive) / positive, blank()
    # rows are dealt by a hash of the id: reruns agree, and copies of a text spread over the tasks
    dealt = common.materialize(rows.repartition(max(1, math.ceil(n / ROWS_PER_TASK)), F.xxhash64("doc_id")).select("terms", "toxic"), "fm-dealt")
    for k, (n_steps, pairs) in enumerate(ROUNDS):
        if pairs and not ROUNDS[k - 1][1]:
            model.v = np.random.default_rng(7).normal(0, INIT, model.v.shape).astype(np.float32)
        now = spark.sparkContext.broadcast(model)

        def local(batches: Iterator) -> Iterator:
            import pyarrow as pa

            terms, toxic = [], []
            for batch in batches:
                terms += batch.column(0).to_pylist()
                toxic += batch.column(1).to_pylist()
            if terms:
                y = np.array(toxic, np.float32)
                bias, found, w, v = steps(terms, y, np.where(y > 0, even, 1.0), now.value, n_steps, pairs)  # noqa: B023
                parts = [found.astype(np.int32), w, v.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((len(toxic), bias, *(p.tobytes() for p in parts)), kinds)], names=names)

        import pyarrow as pa

        kinds, names = [pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()], ["n", "bias", "found", "w", "v"]
        tasks = sorted(dealt.mapInArrow(local, "n long, bias double, found binary, w binary, v binary").collect())  # BUCKETS * (RANK + 2) numbers a task at most
        total = sum(x.n for x in tasks)
        # a bucket that a task hasn't met keeps there what it was
        w, v = model.w.astype(float), model.v.astype(float)
        for x in tasks:
            found, share = np.frombuffer(bytes(x.found), np.int32), x.n / total
            w[found] += share * (np.frombuffer(bytes(x.w), np.float32) - model.w[found])
            v[found] += share * (np.frombuffer(bytes(x.v), np.float32).reshape(-1, RANK) - model.v[found])
        now.unpersist()
        model = Model(sum(x.bias * x.n for x in tasks) / total, w.astype(np.float32), v.astype(np.float32))
    # v of buckets that no row has are still what they began as
    seen = np.zeros(BUCKETS, bool)
    for x in tasks:
        seen[np.frombuffer(bytes(x.found), np.int32)] = True
    model.v[~seen] = 0
    return model


def _rated(batches: Iterator, model: Model, column: str) -> Iterator:
    """Slices of the batches and their rows' probabilities."""
    import numpy as np

    known: dict[bytes, list[int]] = {}  # the buckets of each term that weigh
    weighs = (model.w != 0) | model.v.any(1)
    for batch in common.slices(batches, _ROWS):
        lists = []
        for text in common.utf8(batch.column(column)):
            terms = set(_TERM.findall(text.lower()))
            for t in terms.difference(known):
                known[t] = [b for b in term_buckets(t) if weighs[b]]
            lists.append(sorted({b for t in terms for b in known[t]}))
            if len(known) > _KEEP:
                known.clear()
        rows = Rows(lists)
        z = rows.scores(rows.at, model.bias, model.w, model.v)[0].astype(np.float64)
        yield batch, 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch, p in _rated(batches, shared.value, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double, predicted int")


def not_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with their columns, that the model doesn't call toxic: each by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, p in _rated(batches, shared.value, "text"):
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = common.table(spark, sf_dir, "documents"), common.crc_is("doc_id", 3, 1)
    labels = common.table(spark, sf_dir, "labels").where(~held_out)
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
