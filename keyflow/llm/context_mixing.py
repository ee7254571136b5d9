"""Language-model scores by logistic context mixing, and a word unigram base.

A text is, for the base and the model alike, its lower-cased (A-Z) words, each ended by a space, and the byte 0xFF,
which no UTF-8 text has, as its end. Words and the end are its units. Each byte is predicted bit by bit:

- a unit's first byte from the unit before it: from that whole unit (the empty unit before the first), from its last two
  bytes, and from nothing; so the order of a text's words counts;
- a word's other bytes and its space from the word so far: from its last 2, 3 and 4 bytes, and from its whole beginning
  of `LEAST_BEGINNING` to `MOST_BEGINNING` bytes (shorter ones are those of the last 4 bytes).

Where the two units before a unit came before in the same text, one bit more says first whether what then followed
follows again; if it does, the unit has no other bits. It is predicted from how many units in a row did so: by the rate in
training texts, adapted to what the text has shown so far (`MATCH_WEIGHT`).

Each other context counts the zeros and ones that came after it and the byte's bits so far. The counts' logits are summed with
gated weights, chosen by the longest context that has been seen and by how much each one has seen, and learnt online, by
gradient steps. An adaptive probability map then refines the sum by the bits of the byte so far. A text's score is the
sum over its bits, as log10; `bits_per_byte` is the same over its units' bytes.

What depends on bytes alone is done once for each different unit, or unit with the first byte of the next, with their
counts, which grow with the corpus. Units are cut, in order, into parts of about `PART_UNITS`. Counts of whole units and
whole beginnings are exact and are kept by part, beside the units that they belong to: they are as many as the corpus
has. Beginnings that lie in two parts are few and get the sum of both. Counts after short contexts are hashed to tables
of bounded size, which alone, with weights and maps, pass through the driver and are broadcast. In learning, each
occurrence is predicted from counts without itself; a part learns weights over its own units, and the means of the parts'
weights are averaged by the bits they saw.

Scores go back to documents by a join with postings: the `COMMON_UNITS` most frequent units by broadcast, without a
shuffle of their postings, all others by a shuffle. Rows carry lists of one chunk's documents, not all.

Defined results: null and empty texts have the end alone; rows with a null id are learnt from; repeated rows each get
their row; with no training text all counts are 0. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Last bytes of the hashed contexts within a word and at a unit's first byte, and the bits of their slot numbers.
REST, REST_BITS, HEAD, HEAD_BITS = (2, 3, 4), (18, 20, 21), (0, 2), (8, 18)
OFFSETS = [sum(1 << b for b in (*REST_BITS, *HEAD_BITS)[:k]) for k in range(len(REST + HEAD) + 1)]
SLOTS, SEEN_KINDS, MAP_STEPS = OFFSETS[-1], 16, 33
LEAST_BEGINNING, MOST_BEGINNING = 5, 48
PART_UNITS, COMMON_UNITS, STEP_NODES, PARTS_A_TASK = 50_000, 4096, 1 << 14, 8
RATE, CHUNK_DOCS, CHUNK_BYTES = 0.1, 1 << 14, 32 << 20
#: Bytes and texts that are taken apart at a time.
SLICE_BYTES, SLICE_DOCS = 8 << 20, 2048
START, END = b"", b"\xff"
#: Kinds of matches, by the logarithm of how many there were in a row, and the weight of their rate in training texts.
MATCHES, MATCH_WEIGHT = 8, 4.0
#: Units in which matches are looked for at a time.
MATCHED_UNITS = 1 << 18
#: A posting is whether the unit and the next one were matched, in the lowest bits, then its document's number within
#: its chunk, the next unit's first byte, and how often: where these begin.
ROW_AT, NEXT_AT, TIMES_AT = 2, 16, 24
_MOST = (1 << 31 - TIMES_AT) - 1
_FOLLOW = 40
_ROWS = "unit binary, follow array<long>, at array<int>, chunk long, row int, doc_id long, held_out boolean, n_tokens long, n_bytes long, asked array<int>, matched array<int>"
_PART = "part int, unit binary, ghost boolean, nexts array<int>, counts array<long>"


def matches(units, text):
    """Of texts' units, end to end, with their texts' numbers: the places where the two units before came before in the
    text, whether what then followed follows again, and the kind, by how many places in a row it did."""
    import numpy as np

    place = np.flatnonzero((text[2:] == text[1:-1]) & (text[2:] == text[:-2])) + 2
    wide = lambda x: x.astype(np.uint64)
    key = (wide(units[place - 2]) * np.uint64(0x9E3779B97F4A7C15) + wide(units[place - 1])) * np.uint64(0xD6E8FEB86659FD93) + wide(text[place]) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    now, before = place[order[again + 1]], place[order[again]]
    back = np.argsort(now)
    now, hit = now[back], (units[now] == units[before])[back]
    hits = np.zeros(len(units) + 1, bool)
    hits[now[hit]] = True
    last_miss = np.maximum.accumulate(np.where(hits, -1, np.arange(len(hits))))
    return now, hit, np.minimum(np.frexp(now - last_miss[now - 1])[1] - 1, MATCHES - 1)


def spelled(units):
    """The bytes of an Arrow array, end to end and a zero, and where each one's begin and the last one's end."""
    import numpy as np

    _, cuts, data = units.buffers()
    cuts = np.frombuffer(cuts, np.int32)[units.offset :][: len(units) + 1] if len(units) else np.zeros(1, np.int32)
    return np.append(np.frombuffer(data or b"", np.uint8)[cuts[0] : cuts[-1]], np.uint8(0)), cuts - cuts[0]


def postings(docs: DataFrame) -> DataFrame:
    """For chunks of documents: a row for each different unit, with its numbers in training text by the next unit's
    first byte, and the documents that have it, with next bytes and how often; and a row for each document."""

    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [x.split()[0] for x in _ROWS.split(", ")]
        words, docs, n_docs, size = [], [], 0, 0  # each slice's words as an Arrow dictionary, and its documents' columns

        def lists(cuts, a, b, values):
            return pa.ListArray.from_arrays(pa.array((cuts[a : b + 1] - cuts[a]).astype(np.int32)), pa.array(values[cuts[a] : cuts[b]]))

        def flush():
            doc_ids, held, n_tokens, n_bytes = (pa.concat_arrays(c) for c in zip(*docs))
            found = pa.chunked_array(words).unify_dictionaries()
            words.clear()
            units = pa.concat_arrays([pa.array([START, END], pa.binary()), found.chunk(0).dictionary.cast(pa.large_binary()).cast(pa.binary())])
            sizes = n_tokens.to_numpy() + 1
            ends = np.cumsum(sizes)
            inner = np.ones(ends[-1], bool)
            inner[ends - sizes] = inner[ends - 1] = False
            flat = np.zeros(len(inner), np.int32)
            flat[ends - 1] = 1
            flat[inner] = np.concatenate([c.indices.to_numpy() for c in found.chunks])
            flat[inner] += 2
            del found, inner
            data, starts = spelled(units)
            heads = np.where(starts[1:] > starts[:-1], data[starts[:-1]], 0).astype(np.int64)
            after = np.append(heads[flat[1:]], 0)
            after[ends - 1] = 0  # nothing follows the end
            text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            keys = flat.astype(np.int64)
            keys <<= TIMES_AT
            after <<= NEXT_AT
            keys |= after
            del after
            keys |= text << ROW_AT
            asked, matched = np.zeros((2, len(sizes) * MATCHES), np.int64)
            a = 0
            while a < len(sizes):  # some texts at a time
                start = int(ends[a]) - sizes[a]
                b = max(a + 1, int(np.searchsorted(ends, start + MATCHED_UNITS, side="right")))
                now, hit, kind = matches(flat[start : ends[b - 1]], text[start : ends[b - 1]])
                now += start
                which = text[now] * MATCHES + kind
                np.add.at(asked, which, 1)
                np.add.at(matched, which[hit], 1)
                keys[now[hit]] |= 1
                keys[now[hit] - 1] |= 2
                a = b
            asked, matched = asked.reshape(-1, MATCHES), matched.reshape(-1, MATCHES)
            del flat, text
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ns = np.diff(np.append(first, len(keys))).astype(np.int32)
            keys = keys[first]
            del first
            train = ~held.to_numpy(zero_copy_only=False)
            learnt = np.where(train[keys >> ROW_AT & CHUNK_DOCS - 1], ns, 0)
            pair = keys >> NEXT_AT
            start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pair = pair[start]
            follow = (pair & 255) << _FOLLOW | np.add.reduceat(learnt, start, dtype=np.int64)
            follow_cuts = np.searchsorted(pair >> TIMES_AT - NEXT_AT, np.arange(len(units) + 1))
            del learnt, pair, start
            if (ns > _MOST).any():  # a number that is too large for one posting is in several
                parts = (ns + (_MOST - 1)) // _MOST
                which = np.repeat(np.arange(len(ns), dtype=np.int32), parts)
                nth = np.arange(len(which)) - (np.cumsum(parts) - parts)[which]
                keys, ns = keys[which], np.minimum(ns[which] - nth * _MOST, _MOST).astype(np.int32)
                del parts, which, nth
            cuts = np.searchsorted(keys, np.arange(len(units) + 1) << TIMES_AT)
            keys &= (1 << TIMES_AT) - 1
            packed = keys.astype(np.int32) | ns << TIMES_AT
            del keys, ns
            for at in range(0, len(units), 20_000):
                to = min(len(units), at + 20_000)
                own = [lists(follow_cuts, at, to, follow), lists(cuts, at, to, packed), pa.array([chunk] * (to - at), pa.int64())]
                yield pa.RecordBatch.from_arrays([units[at:to], *own, *(pa.nulls(to - at, t) for t in kinds[4:])], names=names)
            k = len(sizes)
            own = [pa.array([chunk] * k, pa.int64()), pa.array(range(k), pa.int32()), doc_ids, held, n_tokens, n_bytes]
            own += [pa.array(list(x), pa.list_(pa.int32())) for x in (asked, matched)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in kinds[:3]), *own], names=names)

        for batch in batches:
            for at, texts in common.text_slices(batch.column(1), SLICE_BYTES, SLICE_DOCS):
                n, more = len(texts), pc.sum(pc.binary_length(texts)).as_py()
                if n_docs and (n_docs + n > CHUNK_DOCS or size + more > CHUNK_BYTES):
                    yield from flush()
                    docs.clear()
                    chunk, n_docs, size = chunk + 1, 0, 0
                by_text = pc.ascii_split_whitespace(pc.ascii_lower(texts))
                cuts, found = by_text.offsets.to_numpy() - by_text.offsets[0].as_py(), by_text.flatten()
                lengths = pc.binary_length(found).to_numpy()
                some = lengths > 0  # white space around a text leaves empty words
                n_words, n_bytes = (np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[cuts]) for x in (some, lengths))
                words.append((found if some.all() else found.filter(pa.array(some))).dictionary_encode())
                docs.append((batch.column(0).slice(at, n).cast(pa.int64()), batch.column(2).slice(at, n), pa.array(n_words + 1), pa.array(n_bytes + n_words + 1)))
                n_docs, size = n_docs + n, size + more
        if n_docs:
            yield from flush()

    return docs.select("doc_id", "text", common.crc_is("doc_id", 7, 2).alias("held_out")).mapInArrow(rows, _ROWS)


def hashed(context, k: int):
    """A context's hash, of its bytes as a number, for the k-th table."""
    import numpy as np

    h = (context + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(31)


def slot(h, spread, k: int):
    """The place in all tables of a context's hash with the bits before, for the k-th table; `spread` is the bits before
    times a factor, the same for all tables."""
    import numpy as np

    bits = (*REST_BITS, *HEAD_BITS)[k]
    turned = (h ^ spread) * np.uint64(0xFF51AFD7ED558CCD)
    turned >>= np.uint64(64 - bits)
    return turned.view(np.int64) + OFFSETS[k]


class Nodes:
    """Bytes to predict: each is one for all units that have it in the same place of the same beginning."""

    def __init__(self, tables: tuple[int, ...]):
        self.tables = tables  # the tables of its hashed contexts; one exact context comes last
        self.exact = None

    def contexts(self) -> int:
        return len(self.tables) + 1

    def count_exact(self, parent, more=(), more_bytes=(), more_ns=()):
        """Zeros and ones, for each of a byte's bits, after the same parent and bits before; a negative parent is none.
        `more` are further parents, with bytes and numbers, which are counted only."""
        import numpy as np

        seen = np.flatnonzero(parent >= 0)
        key = np.concatenate([parent[seen] << 8 | self.bytes[seen], np.asarray(more, np.int64) << 8 | np.asarray(more_bytes, np.int64)])
        order = np.argsort(key, kind="stable")
        key, ns = key[order], np.concatenate([self.ns[seen], np.asarray(more_ns, float)])[order]
        own = order < len(seen)
        back = seen[order[own]]
        self.exact = np.zeros((8, 2, len(self.bytes)), np.float32)
        if not len(key):
            return
        for k in range(7, -1, -1):
            start = np.flatnonzero(np.diff(key >> k + 1, prepend=-1))
            which = np.cumsum(np.diff(key >> k + 1, prepend=-1) != 0) - 1
            ones = np.add.reduceat(ns * (key >> k & 1), start)[which]
            self.exact[7 - k, 0, back] = (np.add.reduceat(ns, start)[which] - ones)[own]
            self.exact[7 - k, 1, back] = ones[own]

    def bits(self, at: int, to: int) -> Iterator:
        """For each of a byte's bits: its number, the bits before it as a number, the bit, and slots of the contexts."""
        import numpy as np

        byte, hashes = self.bytes[at:to], [h[at:to] for h in self.hashes]
        before = np.ones(len(byte), np.int64)
        for k in range(8):
            bit = byte >> 7 - k & 1
            spread = before.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            yield k, before, bit, [slot(h, spread, t) for h, t in zip(hashes, self.tables)]
            before = before << 1 | bit


class Rest(Nodes):
    """All bytes but the first of sorted words, with the space."""

    def __init__(self, words, ns):
        import numpy as np
        import pyarrow.compute as pc

        super().__init__(tuple(range(len(REST))))
        data, cuts = spelled(pc.binary_join_element_wise(words, b"", b" "))
        data, starts = data[:-1], cuts[:-1].astype(np.int64)
        self.sizes = np.diff(cuts).astype(np.int64)
        unit = np.repeat(np.arange(len(words)), self.sizes)
        place = np.arange(len(data)) - starts[unit]
        # the number of first bytes that a word shares with the one before it
        self.shared = np.zeros(len(words), np.int64)
        alike = np.arange(1, len(words))
        for k in range(MOST_BEGINNING):
            alike = alike[(self.sizes[alike] > k) & (self.sizes[alike - 1] > k)]
            alike = alike[data[starts[alike] + k] == data[starts[alike - 1] + k]]
            self.shared[alike] = k + 1
        own = np.flatnonzero(place >= np.maximum(self.shared, 1)[unit])
        counted = self.sizes - np.maximum(self.shared, 1)
        self.first = np.cumsum(counted) - counted
        wide = data.astype(np.uint64)
        contexts = []
        for back in REST:
            last = np.zeros(len(own), np.uint64)
            for k in range(1, back + 1):
                last |= np.where(place[own] >= k, wide[np.maximum(own - k, 0)], np.uint64(0)) << np.uint64(8 * (k - 1))
            contexts.append(last)
        self.hashes = [hashed(c, k) for k, c in enumerate(contexts)]
        self.bytes, self.unit, self.place, self.starts, self.own, self.data = data[own].astype(np.int64), unit[own], place[own], starts, own, data
        self.ns = np.where(self.place < MOST_BEGINNING, 0.0, ns[self.unit])
        for reach, node in self.nodes():
            self.ns += np.bincount(node, weights=ns[reach], minlength=len(own))

    def nodes(self) -> Iterator:
        """At each place where words may share a node, the words that reach it and their nodes there."""
        import numpy as np

        for k in range(1, min(MOST_BEGINNING, int(self.sizes.max(initial=0)))):
            reach = np.flatnonzero(self.sizes > k)
            node = np.where(self.shared[reach] <= k, self.first[reach] + k - np.maximum(self.shared[reach], 1), -1)
            yield reach, np.maximum.accumulate(node)  # a word that shares this place follows one that has it

    def beginnings(self, ghosts: list[tuple[bytes, int, int]] = ()) -> None:
        """Count after whole beginnings; `ghosts` (beginning, byte, number) are those of words elsewhere."""
        import numpy as np

        parent = np.full(len(self.bytes), -1, np.int64)
        # a beginning's number is that of the first word that has it: its place in the file of words and its length
        which = np.arange(len(self.sizes))
        for k in range(LEAST_BEGINNING, MOST_BEGINNING + 1):
            here = np.flatnonzero(self.place == k)
            if not len(here):
                break
            first = np.maximum.accumulate(np.where(self.shared >= k, -1, which))
            parent[here] = first[self.unit[here]] * 64 + k
        more = []
        if len(ghosts):
            known = {}
            for p in dict.fromkeys(parent[parent >= 0].tolist()):
                at, k = self.starts[p // 64], p % 64
                known[self.data[at : at + k].tobytes()] = p
            more = [(known[b], byte, n) for b, byte, n in ghosts if b in known]
        self.count_exact(parent, *(zip(*more) if more else ()))

    def spine(self) -> list[tuple[bytes, int, int]]:
        """(beginning, byte, number) of all beginnings of the first and the last word; one with number 0 at least for each."""
        import numpy as np

        out = {}
        for w in (0, len(self.sizes) - 1):
            for k in range(LEAST_BEGINNING, min(MOST_BEGINNING, int(self.sizes[w]) - 1) + 1):
                begin = self.data[self.starts[w] : self.starts[w] + k].tobytes()
                if begin not in out:
                    differ = np.flatnonzero(self.shared < k)
                    a, b = differ[differ <= w].max(initial=0), differ[differ > w].min(initial=len(self.sizes))
                    inside = (self.unit >= a) & (self.unit < b) & (self.place == k)
                    out[begin] = np.bincount(self.bytes[inside], weights=self.ns[inside], minlength=1)
        return [(begin, byte, int(n)) for begin, ns in out.items() for byte, n in enumerate(ns.tolist()) if n > 0 or byte == 0]

    def sums(self, values):
        """The sum of the values of a word's nodes, for each word."""
        import numpy as np

        deep = self.place >= MOST_BEGINNING
        out = np.bincount(self.unit[deep], weights=values[deep], minlength=len(self.sizes)).astype(float)
        for reach, node in self.nodes():
            out[reach] += values[node]
        return out


class Head(Nodes):
    """First bytes after units: of the unit numbers `unit`, the bytes `after` with their numbers."""

    def __init__(self, units, unit, after, ns):
        import numpy as np

        super().__init__(tuple(range(len(REST), len(REST + HEAD))))
        data, cuts = spelled(units)
        sizes, last = np.diff(cuts), np.zeros(len(units), np.uint64)
        for back in (1, 2):  # the last two bytes, or the only one, the last as the highest
            has = sizes >= back
            last[has] = (last[has] << np.uint64(8)) | data[cuts[1:][has] - back]
        self.hashes = [hashed(np.zeros(len(unit), np.uint64) if back == 0 else last[unit], len(REST) + k) for k, back in enumerate(HEAD)]
        self.bytes, self.unit, self.ns = np.asarray(after, np.int64), np.asarray(unit, np.int64), np.asarray(ns, float)

    def wholes(self) -> None:
        """Count after whole units."""
        self.count_exact(self.unit)


class Part:
    """The units of a part in order, with their numbers, of an Arrow table (unit, nexts, counts); `ghosts` (beginning,
    byte, number) are those of words in other parts."""

    def __init__(self, own, ghosts: list[tuple[bytes, int, int]] = ()):
        import numpy as np
        import pyarrow.compute as pc

        self.units, nexts, counts = (c.combine_chunks() for c in own.sort_by("unit").select(["unit", "nexts", "counts"]).columns)
        cuts = nexts.offsets.to_numpy() - nexts.offsets[0].as_py() if len(nexts) else np.zeros(1, np.int32)
        after, ns = nexts.flatten().to_numpy(), counts.flatten().to_numpy()
        self.ns = np.diff(np.concatenate([[0], np.cumsum(ns, dtype=np.int64)])[cuts])
        end = pc.equal(self.units, END).to_numpy(zero_copy_only=False)
        self.words = np.flatnonzero(pc.not_equal(self.units, START).to_numpy(zero_copy_only=False) & ~end)
        self.rest = Rest(self.units.take(self.words), self.ns[self.words])
        follows = np.repeat(~end, np.diff(cuts))
        self.followed, self.after = np.repeat(np.arange(len(end)), np.diff(cuts))[follows], after[follows]
        self.head = Head(self.units, self.followed, self.after, ns[follows])
        self.ghosts = ghosts

    def count(self) -> "Part":
        self.rest.beginnings(self.ghosts)
        self.head.wholes()
        return self


def parts(table) -> Iterator[Part]:
    """The part of an Arrow table of its rows."""
    import pyarrow.compute as pc

    ghost = table.column("ghost")
    ghosts = [(r["unit"], r["nexts"][0], r["counts"][0]) for r in table.filter(ghost).to_pylist()]
    yield Part(table.filter(pc.invert(ghost)), ghosts)


def _table_counts(batches: Iterator) -> Iterator:
    """A task's counts after hashed contexts: rows (slot, zeros, ones)."""
    import numpy as np
    import pyarrow as pa

    counts = np.zeros(2 * SLOTS)
    for batch in common.slices(batches, 8192):
        part = Part(pa.Table.from_batches([batch]))
        for nodes in (part.rest, part.head):
            for _, _, bit, slots in nodes.bits(0, len(nodes.bytes)):
                for s in slots:
                    np.add.at(counts, bit * SLOTS + s, nodes.ns)
    counts = counts.reshape(2, SLOTS)
    seen = np.flatnonzero(counts.any(0))
    for at in range(0, len(seen), 100_000):
        some = seen[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(counts[b, some].astype(np.int64)) for b in (0, 1))], names=["slot", "zeros", "ones"])


def states(zeros, ones):
    """Of bit counts: the logit that they predict, and the kind, by their number and whether both bits occur."""
    import numpy as np

    logit = np.log((ones + np.float32(0.2)) / (zeros + np.float32(0.2)))
    # the exponent of a number from 1 on, which its bits begin with
    seen = (zeros + ones + np.float32(1)).astype(np.float32, copy=False)
    kind = np.minimum((seen.view(np.int32) >> 23) - 127, SEEN_KINDS // 2 - 1)
    return logit, (kind + SEEN_KINDS // 2 * ((zeros == 0) | (ones == 0))).astype(np.int16)


def mixed(found, weights):
    """The gated sum of states, as a logit, and the gate of each context."""
    import numpy as np

    longest = np.zeros(len(found[0][0]), np.int64)
    for k, (_, kind) in enumerate(found):
        longest[kind != SEEN_KINDS // 2] = k + 1  # that kind has seen nothing
    longest *= SEEN_KINDS
    gates = [longest + kind for _, kind in found]
    z = sum(weights[k][g] * logit for k, (g, (logit, _)) in enumerate(zip(gates, found)))
    return np.clip(z, -12, 12), gates


def _first_weights() -> list:
    """For words' other bytes and for first bytes: equal shares for all gates."""
    import numpy as np

    return [np.full((n, (n + 1) * SEEN_KINDS), 2.0 / n, np.float32) for n in (len(REST) + 1, len(HEAD) + 1)]


def _learn(tables):
    """A part's weights, learnt online, and its probability maps' counts."""

    def learn(table):
        import numpy as np
        import pyarrow as pa

        counts = tables.value
        out = []
        for part in parts(table):
            part.count()
            for side, (nodes, weights) in enumerate(zip((part.rest, part.head), _first_weights())):
                power, sums, masses = np.full(weights.shape, 1e-4), np.zeros(weights.shape), np.zeros(weights.shape)
                map_counts = np.zeros(2 * MAP_STEPS * 256)
                for lo in range(0, len(nodes.bytes), STEP_NODES):
                    weight = nodes.ns[lo : lo + STEP_NODES].astype(np.float32)
                    for b, before, bit, slots in nodes.bits(lo, lo + STEP_NODES):
                        # each occurrence is predicted without itself
                        zero, one = (1 - bit).astype(np.float32), bit.astype(np.float32)
                        pairs = [*((counts[0][s], counts[1][s]) for s in slots), nodes.exact[b, :, lo : lo + STEP_NODES]]
                        found = [states(np.maximum(x - zero, 0), np.maximum(y - one, 0)) for x, y in pairs]
                        z, gates = mixed(found, weights)
                        at = np.rint((z + 12) * ((MAP_STEPS - 1) / 24)).astype(np.int64) * 256 + before
                        map_counts += np.bincount(bit * (MAP_STEPS * 256) + at, weights=weight, minlength=len(map_counts))
                        error = weight * (bit - 1 / (1 + np.exp(-z)))
                        for k, (g, (logit, _)) in enumerate(zip(gates, found)):
                            mass = np.bincount(g, weights=weight, minlength=weights.shape[1])
                            slope = np.bincount(g, weights=error * logit, minlength=weights.shape[1]) / np.maximum(mass, 1)
                            power[k] += slope * slope
                            weights[k] += RATE * slope / np.sqrt(power[k])
                            sums[k] += weights[k] * mass
                            masses[k] += mass
                map_counts = map_counts.reshape(2, -1)
                for name, x, y in (("map", *map_counts), ("weight", sums.ravel(), masses.ravel())):
                    seen = np.flatnonzero((x > 0) | (y > 0))
                    out.append(pa.table({"side": pa.array([side] * len(seen), pa.int32()), "what": pa.array([name] * len(seen), pa.string()), "at": pa.array(seen.astype(np.int32)), "x": x[seen], "y": y[seen]}))
        return pa.concat_tables(out)

    return learn


class Model:
    """Counts after hashed contexts, and, for words' other bytes and for first bytes, weights and probability map."""

    def __init__(self, tables, weights, refine):
        self.tables, self.weights, self.refine, self.states = tables, weights, refine, None

    def node_scores(self, nodes: Nodes, side: int):
        """log10 probability of each node's byte."""
        import numpy as np

        if self.states is None:
            self.states = states(*self.tables)
            self.tables = None
        total, refine = np.zeros(len(nodes.bytes)), self.refine[side]
        for lo in range(0, len(total), STEP_NODES):
            for b, before, bit, slots in nodes.bits(lo, lo + STEP_NODES):
                found = [*((self.states[0][s], self.states[1][s]) for s in slots), states(*nodes.exact[b, :, lo : lo + STEP_NODES])]
                z, _ = mixed(found, self.weights[side])
                p = 1 / (1 + np.exp(-z))
                at = (z + 12) * ((MAP_STEPS - 1) / 24)
                low = np.minimum(at.astype(np.int64), MAP_STEPS - 2)
                part = at - low
                refined = refine[low, before] * (1 - part) + refine[low + 1, before] * part
                p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
                total[lo : lo + STEP_NODES] += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def by_part(units: DataFrame) -> DataFrame:
    """unit, nexts, counts cut into parts in order: with `part`, and the rows of beginnings that other parts have."""
    # one unit in PART_UNITS, by its hash, begins a part: reruns cut alike
    bounds = [bytes(r.unit) for r in units.where(F.pmod(F.xxhash64("unit"), F.lit(PART_UNITS)) == 0).select("unit").orderBy("unit").collect()]
    n_parts = len(bounds) + 1

    def placed(batches: Iterator) -> Iterator:
        from bisect import bisect_right

        import pyarrow as pa

        for batch in batches:
            part = pa.array([bisect_right(bounds, u) for u in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([part, *batch.columns], names=["part", "unit", "nexts", "counts"])

    cut = units.select("unit", "nexts", "counts").mapInArrow(placed, "part int, unit binary, nexts array<int>, counts array<long>")
    cut = dealt(cut, n_parts).sortWithinPartitions("part", "unit").select("part", "unit", F.lit(False).alias("ghost"), "nexts", "counts")
    cut = common.materialize(cut, "cm-parts")

    def spine(table):
        import pyarrow as pa

        rows = [(r, *x) for r in table.column("part").to_pylist()[:1] for p in parts(table) if len(p.words) for x in p.rest.spine()]
        kinds = [pa.int32(), pa.binary(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["part", "begin", "byte", "n"])

    if n_parts == 1:
        return cut
    spines = common.materialize(dealt(cut, n_parts).groupBy("part").applyInArrow(spine, "part int, begin binary, byte int, n long"), "cm-spines")
    total = spines.groupBy("begin", "byte").agg(F.sum("n").alias("n"))
    own = spines.select("part", "begin", "byte", F.col("n").alias("own"))
    ghosts = spines.select("part", "begin").distinct().join(total, "begin").join(own, ["part", "begin", "byte"], "left")
    ghosts = ghosts.withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0")
    ghosts = ghosts.select("part", F.col("begin").alias("unit"), F.lit(True).alias("ghost"), F.array("byte").alias("nexts"), F.array("n").alias("counts"))
    return cut.unionByName(common.materialize(ghosts, "cm-ghosts"))


def dealt(found: DataFrame, n_parts: int) -> DataFrame:
    """Rows dealt to tasks by part, a task for a part or more."""
    return found.repartition(max(1, min(n_parts, 1 << 16)), "part")


def fit(found: DataFrame, n_parts: int) -> Model:
    """Learn from the rows of parts."""
    import numpy as np

    sc = found.sparkSession.sparkContext
    tables = np.zeros((2, SLOTS), np.float32)
    seen = found.where("NOT ghost").select("unit", "nexts", "counts").coalesce(max(sc.defaultParallelism, n_parts // PARTS_A_TASK))
    counted = seen.mapInArrow(_table_counts, "slot int, zeros long, ones long").groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    arrow = counted.toArrow()  # SLOTS rows at most
    at = arrow.column("slot").to_numpy()
    tables[0, at], tables[1, at] = arrow.column("zeros").to_numpy(), arrow.column("ones").to_numpy()
    del arrow
    shared = sc.broadcast(tables)
    learnt = dealt(found, n_parts).groupBy("part").applyInArrow(_learn(shared), "side int, what string, at int, x double, y double")
    sums = learnt.groupBy("side", "what", "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()  # as many as weights and map cells
    weights = [w.ravel().astype(float) for w in _first_weights()]
    refine = [np.repeat(1 / (1 + np.exp(-np.linspace(-12, 12, MAP_STEPS))), 256) for _ in weights]
    for r in sums:
        if r.what == "weight" and r.y > 0:
            weights[r.side][r.at] = r.x / r.y
        elif r.what == "map":
            refine[r.side][r.at] = (r.y + 4 * refine[r.side][r.at]) / (r.x + r.y + 4)
    shared.unpersist()
    return Model(tables, [w.reshape(s.shape).astype(np.float32) for w, s in zip(weights, _first_weights())], [r.reshape(MAP_STEPS, 256) for r in refine])


def scored_units(found: DataFrame, model: Model, n_parts: int) -> DataFrame:
    """unit, n (in training text), log_p (of all bytes but the first), nexts, next_logs (of the next unit's first byte)."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def score(table):
        import numpy as np
        import pyarrow as pa

        out = []
        for part in parts(table):
            part.count()
            logs = np.zeros(len(part.units))
            logs[part.words] = part.rest.sums(shared.value.node_scores(part.rest, 0))
            cuts = np.concatenate([[0], np.cumsum(np.bincount(part.followed, minlength=len(part.units)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x, k)) for x, k in ((part.after.astype(np.int32), pa.int32()), (shared.value.node_scores(part.head, 1), pa.float32()))]
            out.append(pa.table([part.units, pa.array(part.ns), pa.array(logs), *lists], names=["unit", "n", "log_p", "nexts", "next_logs"]))
        return pa.concat_tables(out)

    return dealt(found, n_parts).groupBy("part").applyInArrow(score, "unit binary, n long, log_p double, nexts array<int>, next_logs array<float>")


def counted_units(found: DataFrame) -> DataFrame:
    """unit, nexts (first bytes of next units), counts (of each in training text), of postings."""
    # dealt by unit before lists are taken apart: a chunk has a unit once, so nothing would combine before, and both groupings need this one exchange
    each = found.where("unit IS NOT NULL").select("unit", "follow").repartition("unit").select("unit", F.explode("follow").alias("f"))
    each = each.select("unit", F.shiftright("f", _FOLLOW).cast("int").alias("next"), F.col("f").bitwiseAND((1 << _FOLLOW) - 1).alias("n"))
    each = each.groupBy("unit", "next").agg(F.sum("n").alias("n")).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("next", "n"))).alias("x"))
    return each.select("unit", F.col("x.next").alias("nexts"), F.col("x.n").alias("counts"))


def match_rates(rows: DataFrame) -> list[float]:
    """Of each kind, the share of matches that held in training texts."""
    sums = [F.coalesce(F.sum(F.col(c)[k]), F.lit(0)) for c in ("asked", "matched") for k in range(MATCHES)]
    found = rows.where("NOT held_out").agg(*[x.alias(str(k)) for k, x in enumerate(sums)]).first()
    return [(found[MATCHES + k] + 0.5) / (found[k] + 1.0) for k in range(MATCHES)]


def match_score(asked: list[int], matched: list[int], rates: list[float]) -> float:
    """log10 probability of a text's match bits, each predicted from the rate and the text's bits of that kind before it;
    the order of the bits of a kind doesn't matter."""
    from math import lgamma, log

    total = 0.0
    for n, h, rate in zip(asked, matched, rates):
        if n:
            a, b = MATCH_WEIGHT * rate, MATCH_WEIGHT * (1 - rate)
            total += lgamma(h + a) - lgamma(a) + lgamma(n - h + b) - lgamma(b) - lgamma(n + a + b) + lgamma(a + b)
    return total / log(10)


def with_match_scores(rows: DataFrame) -> DataFrame:
    """The documents' rows with `match_score` in place of the numbers of matches."""
    rates, kept = match_rates(rows), [f for f in rows.schema.fields if f.name not in ("asked", "matched")]

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [match_score(a, m, rates) for a, m in zip(batch.column("asked").to_pylist(), batch.column("matched").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, pa.float64())], names=[*(f.name for f in kept), "match_score"])

    return rows.mapInArrow(score, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", match_score double")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    found = common.materialize(postings(docs), "cm-postings")
    units = by_part(common.materialize(counted_units(found), "cm-units"))
    n_parts = (units.agg(F.max("part")).first()[0] or 0) + 1
    rated = common.materialize(scored_units(units, fit(units, n_parts), n_parts), "cm-rated")
    total, kinds = rated.where(F.octet_length("unit") > 0).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    word = F.octet_length("unit") > 0
    rated = rated.select("unit", "n", "log_p", F.when(word, F.log10(F.col("n") + 1)).otherwise(0.0).alias("log_n"), (word & (F.col("n") > 0)).cast("int").alias("known"), F.map_from_arrays("nexts", "next_logs").alias("next_log"))
    # the most frequent units, COMMON_UNITS rows with 256 next bytes at most
    frequent = common.materialize(rated.orderBy(F.desc("n"), "unit").limit(COMMON_UNITS).drop("n"), "cm-common")
    lists, rated = found.where("unit IS NOT NULL").select("unit", "chunk", "at"), rated.drop("n")
    near = lists.join(F.broadcast(frequent), "unit")
    far = lists.join(F.broadcast(frequent.select("unit")), "unit", "left_anti").join(rated, "unit")
    at = F.col("at")
    each = near.unionByName(far).select("chunk", F.explode("at").alias("at"), "known", "log_n", "log_p", "next_log")
    rest = F.when(at.bitwiseAND(1) == 0, F.col("log_p")).otherwise(0.0)
    head = F.when(at.bitwiseAND(2) == 0, F.coalesce(F.col("next_log")[F.shiftright("at", NEXT_AT).bitwiseAND(255)].cast("double"), F.lit(0.0))).otherwise(0.0)
    each = each.select("chunk", F.shiftright("at", ROW_AT).bitwiseAND(CHUNK_DOCS - 1).alias("row"), F.shiftright("at", TIMES_AT).alias("n"), "known", "log_n", (rest + head).alias("log_p"))
    each = each.groupBy("chunk", "row").agg(F.sum(F.col("n") * F.col("log_p")).alias("spelled"), F.sum(F.col("n") * F.col("log_n")).alias("logs"), F.sum(F.col("n") * F.col("known")).alias("n_known"))
    rows = with_match_scores(found.where("unit IS NULL").select("chunk", "row", "doc_id", "held_out", "n_tokens", "n_bytes", "asked", "matched")).join(each, ["chunk", "row"])
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))
    score = F.col("spelled") + F.col("match_score")
    bits = -score / F.col("n_bytes") * F.log2(F.lit(10.0))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), bits.alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))
