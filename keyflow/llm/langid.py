"""Language identification by words first, then by ever shorter character n-grams.

Fitting counts words and the n-grams of `_word_` by language over a bounded sample of labelled documents (at most
`rows_per_language` of each language, chosen by a hash of the id). A word is known when it is in `WORD_SHARE` of a
language's sampled documents, an n-gram when it is `GRAM_SHARE` of the language's n-grams of its length; so at most
(mean distinct words of a document) / WORD_SHARE words and 1 / GRAM_SHARE n-grams of a length are known by language,
for each of its languages, which bounds what is broadcast; a language that hasn't a known word or n-gram has one default
for the length. A known word scores its log frequency in each language; any other word scores the
mean log frequency of its known n-grams of the greatest length that has some. A text's language has the greatest sum.

Letters are those of Unicode's categories L; digits, other numerals (such as the superscript two) and marks aren't.

Defined results: `und` with score 0 where the text is null or has no letter; rows without a language aren't learned
from; with nothing to learn from, all is `und`. Repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROWS_PER_LANGUAGE = 5000
LONGEST, WORD_SHARE, GRAM_SHARE = 5, 1e-3, 1e-5
_WORD = re.compile(r"[^\W\d_]+")
#: Word characters that are neither digits nor letters: other numerals. Sets of characters beyond 16 bits are slow to
#: look through, so those are looked for only where a text has some.
_OTHERS = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No")]
_NUMERAL, _FAR_NUMERAL = (re.compile("[" + "".join(re.escape(c) for c in _OTHERS if (c > "\uffff") == far) + "]") for far in (False, True))
_FAR = re.compile("[\U00010000-\U0010ffff]")
#: Scores that a task keeps, whatever the number of languages.
_KEEP, _ROWS = 800_000, 500
#: Language tables of up to so many rows are broadcast.
_BROADCAST = 10_000


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters."""
    text = (text or "").lower()
    if not text.isascii():
        if _NUMERAL.search(text):
            text = _NUMERAL.sub(" ", text)
        if _FAR.search(text):
            text = _FAR_NUMERAL.sub(" ", text)
    return _WORD.findall(text)


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language: of words under length 0, of n-grams under their length. `known` has, for a word or
    n-gram, (language number, difference from that language's default) where it was seen; `default` what unseen ones have."""

    languages: list[str]
    prior: list[float]
    default: dict[int, list[float]]
    known: dict[int, dict[str, list[tuple[int, float]]]]

    def word(self, word: str) -> list[float]:
        for n in (0, *range(LONGEST, 0, -1)):
            known = self.known[n]
            if hits := [x for g in (grams(word, n) if n else [word]) if (x := known.get(g))]:
                out = list(self.default[n])
                for x in hits:
                    for k, d in x:
                        out[k] += d / len(hits)
                return out
        return [0.0] * len(self.languages)


def _count(batches: Iterator) -> Iterator:
    """Rows (lang, n, gram, count, docs): of words as n = 0, and of n-grams, for a task's documents."""
    import pyarrow as pa

    counts: Counter = Counter()
    docs: Counter = Counter()

    def rows():
        found = list(counts.items())
        by_length: Counter = Counter()
        for (lang, word), k in found:
            for n in range(1, LONGEST + 1):
                for g in grams(word, n):
                    by_length[lang, n, g] += k
        out = [(lang, 0, w, k, docs[lang, w]) for (lang, w), k in found] + [(*key, k, 0) for key, k in by_length.items()]
        counts.clear()
        docs.clear()
        for at in range(0, len(out), 50_000):
            part = list(zip(*out[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0], pa.string()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.string()), pa.array(part[3], pa.int64()), pa.array(part[4], pa.int64())],
                names=["lang", "n", "gram", "count", "docs"],
            )

    for batch in common.slices(batches, _ROWS):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = Counter(words_of(text))
            for w, k in words.items():
                counts[lang, w] += k
                docs[lang, w] += 1
        if len(counts) > _KEEP:
            yield from rows()
    yield from rows()


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from doc_id, text, lang."""
    import math

    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], [], {n: [] for n in range(LONGEST + 1)}, {n: {} for n in range(LONGEST + 1)})
    drawn = labelled.sparkSession.createDataFrame([(lang, float(min(rows_per_language, n)), min(1.0, rows_per_language / n)) for lang, n in sizes.items()], "lang string, drawn double, share double")
    small = (lambda df: F.broadcast(df)) if len(languages) <= _BROADCAST else (lambda df: df)
    sample = labelled.join(small(drawn), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30)))
    counted = common.materialize(
        sample.select("text", "lang").mapInArrow(_count, "lang string, n int, gram string, count long, docs long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "lid"
    )
    totals = counted.groupBy("lang", "n").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("kinds"))
    often = F.when(F.col("n") == 0, F.col("docs") >= F.greatest(F.lit(2.0), F.col("drawn") * WORD_SHARE)).otherwise(F.col("count") >= F.greatest(F.lit(3.0), F.col("total") * GRAM_SHARE))
    known = counted.join(small(totals), ["lang", "n"]).join(small(drawn), "lang").where(often).select("n", "gram").distinct()
    rows = counted.join(known, ["n", "gram"]).groupBy("n", "gram").agg(F.collect_list(F.struct("lang", "count")).alias("by_lang"))
    total = {(r.lang, r.n): (r.total, r.kinds) for r in totals.collect()}
    number = {lang: k for k, lang in enumerate(languages)}

    def log(lang: str, n: int, count: int) -> float:
        seen, kinds = total.get((lang, n), (0, 0))
        return math.log((count + 0.5) / (seen + 0.5 * kinds + 1))

    default = {n: [log(lang, n, 0) for lang in languages] for n in range(LONGEST + 1)}
    tables: dict[int, dict[str, list[tuple[int, float]]]] = {n: {} for n in range(LONGEST + 1)}
    for r in rows.toLocalIterator():
        tables[r.n][r.gram] = sorted((k := number[x.lang], log(x.lang, r.n, x["count"]) - default[r.n][k]) for x in r.by_lang)
    n = sum(sizes.values())
    return Model(languages, [math.log(sizes[lang] / n) for lang in languages], default, tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the share of the language among all, after the softmax of the sums)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = shared.value
        width, used, index = len(model.languages), 0, {}
        keep = max(4096, _KEEP // max(1, width))
        scores = np.zeros((keep, width))
        prior = np.array(model.prior)
        for batch in common.slices(batches, _ROWS):
            langs, shares = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                if not words or not width:
                    langs.append("und")
                    shares.append(0.0)
                    continue
                total = prior.copy()
                for at in range(0, len(words), 4096):
                    part = words[at : at + 4096]
                    if used + len(part) > keep:
                        index.clear()
                        used = 0
                    for w in set(part).difference(index):
                        scores[used] = model.word(w)
                        index[w] = used
                        used += 1
                    total += scores[[index[w] for w in part]].sum(0)
                e = np.exp(total - total.max())
                k = int(e.argmax())
                langs.append(model.languages[k])
                shares.append(float(e[k] / e.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.crc_is("doc_id", 4, 2)
    return predict(docs, fit(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
