"""Token counts at every prefix, by dynamic programming.

A BPE encoding is that in which each two neighbouring tokens, encoded together, stay as they are. So the encoding of
the first p letters ends with the one token t that fits the last token of the first p - |t|, and
`n(p) = n(p - |t|) + 1`. A prefix's last letter carries the vocabulary's end of word: its token is looked
for among those at the end of words, in the same way. The counts of each different chunk (a text's parts between white
space) at each of its characters are computed so once and stored as differences; a text's table is their running sum
over its characters, which the total, budgets and truncation read: no text is encoded again.

Pre-tokens are as the library cuts them; the beginnings of contractions and of special strings are cut as the
library cuts a text that ends there. Only where a chunk isn't in composed form (NFC), prefixes that end within a group
of characters that compose are counted from the start of their pre-token.

Defined results: null and empty texts have 0 tokens; special strings inside texts count as the library's default has
it; repeated rows each get their row; other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import sub

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .word_tokens import _PLAIN, ChunkEncoder

TOKEN_LIMIT = 2048
_ROWS, _KEEP, _KEEP_WORDS = 500, 300_000, 1_000_000
#: Chunks of more bytes aren't kept.
_LONG = 512


def vocabulary() -> str:
    """The default vocabulary's path on this machine; tasks that get no path ask for it where they run."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _composing() -> frozenset[str]:
    """Characters that may compose with one before them."""
    pairs = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
    second = {chr(int(d.split()[1], 16)) for d in pairs if d and d[0] != "<" and " " in d}
    return frozenset(second) | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


class PrefixCounts(dict):
    """chunk bytes -> the differences of its counts from each character to the next, as 32-bit integers."""

    def __init__(self, encoder: ChunkEncoder):
        from tokenizers.models import BPE

        super().__init__()
        parts = json.loads(encoder.tokenizer.to_str())
        model, self.end = parts["model"], parts["model"]["end_of_word_suffix"]
        self.tokenizer, self.letters, self.ending = encoder.tokenizer, encoder.letters, encoder.model
        self.within = BPE(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.ids, self.tokens = {"": 0}, [""]
        self.inner = self._finder(t for t in model["vocab"] if not t.endswith(self.end))
        self.final = self._finder((t[: -len(self.end)] for t in model["vocab"] if t.endswith(self.end)), True)
        specials = sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)")
        self.words: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def _finder(self, tokens, final: bool = False):
        """An automaton that finds all of the tokens that end at each place of a word, the longest first: with each its
        number, whether it ends words, and its length."""
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token in tokens:
            if token:
                if token not in self.ids:
                    self.ids[token] = len(self.tokens)
                    self.tokens.append(token)
                found.add_word(token, (self.ids[token] << 1 | final) << 12 | len(token))
        found.make_automaton()
        return found

    def fit(self, key: int) -> bool:
        """Whether two tokens (their numbers, and whether the second ends the word) stay as they are when they are encoded together."""
        before, token, final = self.tokens[key >> 33], self.tokens[key >> 1 & 0xFFFFFFFF], key & 1
        found = [t.value for t in (self.ending if final else self.within).tokenize(before + token)]
        known = self.fits[key] = found == ([before] if before else []) + [token + self.end * final]
        return known

    def word(self, word: str) -> list[int]:
        """The counts of a pre-token's first 1, 2, ... characters."""
        return list(accumulate(array("i", self.words.get(word) or self.steps(word))))

    def steps(self, word: str) -> bytes:
        """The differences of the counts of a pre-token's first 0, 1, 2, ... characters, by the recurrence."""
        if word.isascii() and word.isprintable():  # these bytes stand for themselves
            raw, letters, size = None, word, len(word)
        else:
            raw = word.encode()
            letters, size = raw.decode("latin-1").translate(self.letters), len(raw)
        known = self.fits.get
        # counts, and last tokens as they stand in keys
        n, last, done = [0] * (size + 1), [0] * (size + 1), 0
        for at, value in self.inner.iter(letters):
            if at == done:  # the token that ends here is still to be found
                since, value = at + 1 - (value & 0xFFF), value >> 12
                if (fit := known(key := last[since] | value)) is None:
                    fit = self.fit(key)
                if fit:
                    done += 1
                    n[done], last[done] = n[since] + 1, value << 32
        ends, here = [0] * (size + 1), 0
        for at, value in self.final.iter(letters):
            if at >= here:
                since = at + 1 - (value & 0xFFF)
                if (fit := known(key := last[since] | value >> 12)) is None:
                    fit = self.fit(key)
                if fit:
                    here = at + 1
                    ends[here] = n[since] + 1
        if raw is not None and size != len(word):
            ends = [0, *(ends[k] for k in range(1, size + 1) if k == size or raw[k] & 0xC0 != 0x80)]
        if done != size or 0 in ends[1:]:
            raise AssertionError(f"no token ends at each place of {word!r}")
        found = array("i", map(sub, ends[1:], ends)).tobytes()
        if size <= _LONG:
            self.words[word] = found
        return found

    def composed(self, text: str) -> list[int]:
        """The counts of the first 0, 1, ... characters of a text in normal form, without special strings."""
        out = [0]
        for word, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            out += [out[-1]] * (start + 1 - len(out))
            base, word = out[-1], text[start:end]
            counts = self.word(word)
            if word[0] == "'" and word[1:].isalpha():  # a contraction: cut short, its apostrophe stands alone
                first = self.word("'")
                counts = [*first, *(first[0] + c for c in self.word(word[1:])[: len(word) - 2]), counts[-1]]
            out += [base + c for c in counts]
        return out + [out[-1]] * (len(text) + 1 - len(out))

    def ordinary(self, text: str) -> list[int]:
        """The counts of the first 0, 1, ... characters of a text without special strings."""
        lower = lambda x: "".join([c.lower() for c in x])
        if unicodedata.is_normalized("NFC", text) and len(low := lower(text)) == len(text):
            return self.composed(low)
        starts = [k for k, c in enumerate(text) if not k or not (unicodedata.combining(c) or c in _composing())]
        groups = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]
        normal = [lower(unicodedata.normalize("NFC", g)) for g in groups]
        whole = "".join(normal)
        counts, words = self.composed(whole), [s for _, (s, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]
        out, at, w = [0], 0, 0
        for group, form in zip(groups, normal):
            while w < len(words) and words[w] < at:
                w += 1
            since = words[w - 1] if w else 0
            for k in range(1, len(group)):
                out.append(counts[since] + self.composed(whole[since:at] + lower(unicodedata.normalize("NFC", group[:k])))[-1])
            at += len(form)
            out.append(counts[at])
        return out

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if plain := _PLAIN.fullmatch(text):
            stem, end = plain[1].lower(), plain[2]
            out = self.words.get(stem) or self.steps(stem)
            if end:
                out += self.words.get(end) or self.steps(end)
        else:
            counts, at = [0], 0
            for found in self.special.finditer(text):
                base, size = counts[-1], found.start() - at
                part = self.ordinary(text[at : found.end() - 1])  # a special string cut short is ordinary text
                counts += [base + c for c in part[1:]] + [base + part[size] + 1]
                at = found.end()
            base = counts[-1]
            counts += [base + c for c in self.ordinary(text[at:])[1:]]
            out = array("i", map(sub, counts[1:], counts)).tobytes()
        if len(chunk) <= _LONG:
            self[chunk] = out
        return out

    def trim(self) -> None:
        """Between texts: empty a dictionary once it is over its bound. Words, which are dear to work out, outlast chunks."""
        if len(self) > _KEEP:
            self.clear()
        if len(self.words) > _KEEP_WORDS:
            self.words.clear()
        if len(self.fits) > 4 * _KEEP:
            self.fits.clear()


@cache
def shared_counts(path: str) -> PrefixCounts:
    """One for all tasks of a process."""
    return PrefixCounts(ChunkEncoder(path))


@cache
def _kinds():
    """Of each byte: 0 if it continues a character, 2 if it is white space, else 1."""
    import numpy as np

    return np.array([0 if b & 0xC0 == 0x80 else 2 if b in common.SPACE else 1 for b in range(256)], np.uint8)


class PrefixTable:
    """Exact token counts of all prefixes of one text, stored."""

    def __init__(self, text: str | bytes, encoder: ChunkEncoder | PrefixCounts):
        import numpy as np

        if not isinstance(encoder, PrefixCounts):
            if not hasattr(encoder, "prefix_counts"):
                encoder.prefix_counts = PrefixCounts(encoder)
            encoder = encoder.prefix_counts
        raw = text.encode() if isinstance(text, str) else text
        kinds = _kinds()[np.frombuffer(raw, np.uint8)]
        kinds = kinds[kinds > 0]
        self.counts = np.zeros(len(kinds) + 1, np.int32)
        self.counts[1:][kinds == 1] = np.frombuffer(b"".join(map(encoder.__getitem__, raw.split())), np.int32)
        np.cumsum(self.counts, out=self.counts)
        encoder.trim()

    def count(self, prefix: int) -> int:
        """Tokens of the first `prefix` characters."""
        return int(self.counts[prefix])

    def total(self) -> int:
        return int(self.counts[-1])

    def table(self) -> list[int]:
        """The count at every prefix, from 0 characters to all."""
        return self.counts.tolist()

    def longest_within(self, budget: int) -> int:
        """The longest prefix, in characters, of at most `budget` tokens."""
        import numpy as np

        return int(np.flatnonzero(self.counts <= budget)[-1])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row: the last entry of each text's prefix table."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = shared_counts(path or vocabulary())
        for batch in common.slices(batches, _ROWS):
            n_bytes, n_tokens = [], []
            for text in common.utf8(batch.column(1)):
                n_bytes.append(len(text))
                n_tokens.append(PrefixTable(text, counts).total())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def with_prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and prefix_tokens, the count at every prefix of the text (entry p: the first p characters)."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = shared_counts(path or vocabulary())
        for batch in common.slices(batches, 50):
            tables = []
            for text in common.utf8(batch.column(1)):
                tables.append(PrefixTable(text, counts).counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def truncated(docs: DataFrame, path: str | None, budget: int) -> DataFrame:
    """doc_id and text, cut to its longest prefix of at most `budget` tokens."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = shared_counts(path or vocabulary())
        for batch in common.slices(batches, _ROWS):
            cut = []
            for text in (x.decode() for x in common.utf8(batch.column(1))):
                cut.append(text[: PrefixTable(text, counts).longest_within(budget)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
