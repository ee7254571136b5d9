"""Exact token ids of a word-end BPE vocabulary, one white-space chunk at a time.

The vocabulary's normalizer drops white space and no pre-token crosses it, so the ids of a text are those of its
chunks in order. Chunks of Latin letters and closing punctuation, for which normalizing is plain lower case, go to the
library's BPE model directly; all others go through the library's whole pipeline. A task keeps what it has encoded in
dictionaries of bounded size.

Of a column of texts, Arrow finds the different chunks, and the different words among them, so that only these are
looked up; its ids are then taken by chunk.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from . import common

#: Letters whose NFC form is themselves and whose lower case is one letter, then punctuation that forms one pre-token.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN, _WORD = re.compile(f"([{_LETTERS}]+)([.,;:!?]*)"), re.compile(f"[{_LETTERS}]+")
#: More signs that form one pre-token at a chunk's end: all of ASCII's but the apostrophe.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ALL_LETTERS = "".join(re.findall(f"[{_LETTERS}]", "".join(map(chr, range(256)))))
_KEEP, _KEEP_STEMS = 300_000, 500_000
#: Bytes of text that are taken apart at a time; one text at least.
_AT_ONCE = 8 << 20


def _byte_letters() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    spare = iter(range(256, 512))
    return "".join(chr(b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(spare)) for b in range(256))


class ChunkEncoder(dict):
    """chunk bytes -> its ids as little-endian unsigned 32-bit integers; encodes what is missing."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.stems = self.tokenizer.model, _byte_letters(), {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def encode(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _stem(self, stem: str) -> bytes:
        if (ids := self.stems.get(stem)) is None:
            mapped = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
            packed = self.packed
            ids = self.stems[stem] = b"".join([packed[t.id] for t in self.model.tokenize(mapped)])
        return ids

    def _word(self, word: str) -> bytes:
        """The ids of a lower-case word of Latin letters, or of anything else."""
        if (ids := self.stems.get(word)) is None:
            if _WORD.fullmatch(word):
                return self._stem(word)
            ids = self.stems[word] = self.encode(word)
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if plain := _PLAIN.fullmatch(text):
            ids = self._stem(plain[1].lower())
            if plain[2]:
                ids += self._word(plain[2])
        else:
            ids = self.encode(text)
        self[chunk] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        out = b"".join([self[c] for c in text.split()])
        self.trim()
        return out

    def column_ids(self, texts) -> Iterator[bytes]:
        """The ids of each text of an Arrow string column, null as empty."""
        for _, some in common.text_slices(texts, _AT_ONCE, len(texts)):
            yield from self._some_ids(some)
            self.trim()

    def _some_ids(self, texts) -> Iterator[bytes]:
        """The same, of texts that are few enough to be taken apart together."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts)
        found = lists.flatten().dictionary_encode()
        chunks = found.dictionary
        words = pc.utf8_rtrim(chunks, characters=_SIGNS)
        plain = pc.match_substring_regex(words, f"^[{_LETTERS}]+$")
        # a chunk of a word and signs is both, any other is taken as one word
        words = pc.if_else(plain, pc.utf8_lower(words), chunks).dictionary_encode()
        ends = pc.if_else(plain, pc.utf8_ltrim(chunks, characters=_ALL_LETTERS), "").dictionary_encode()
        known, missing = self.stems.get, self._word
        ids = [pa.array([missing(w) if (i := known(w)) is None else i for w in x.dictionary.to_pylist()], pa.large_binary()).take(x.indices) for x in (words, ends)]
        ids = pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary())).take(found.indices)
        _, cuts, data = ids.buffers()
        cuts = np.frombuffer(cuts, np.int64)[ids.offset :][: len(ids) + 1][lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = memoryview(data or b"")
        for a, b in zip(cuts, cuts[1:]):
            yield bytes(data[a:b])

    def trim(self) -> None:
        """Between texts: empty a dictionary once it is over its bound."""
        if len(self) > _KEEP:
            self.clear()
        if len(self.stems) > _KEEP_STEMS:
            self.stems.clear()
