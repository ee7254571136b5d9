"""Vector bin packing of documents into training sequences.

A task packs the documents of its own partition, a window of tokens at a time: nothing is shuffled, and a task
holds one window. What fills a sequence is a vector (tokens, segments, loss-bearing tokens); the next piece is the
one whose vector has the largest dot product with what is left in the sequence, as shares of the limits. When no
whole piece fits, the largest is cut to what is left. Full sequences have exactly `max_tokens`; the last sequence of
a partition and those closed by another limit are cut into sequences whose lengths are powers of two, which need no
padding.

Conversations are packed alike, with loss on their answers alone, so that all three limits bind.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; other columns are not read.
Sequence ids are unique in the result: partition number * 2**32 + number within the partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_prefix import vocabulary
from .word_tokens import ChunkEncoder

MAX_TOKENS, MAX_SEGMENTS, END_ID = 4096, 1024, 2
#: Tokens that a task gathers before it packs; pieces that don't fill a sequence wait for the next window.
WINDOW_TOKENS = 1 << 20
#: And the most documents: packing takes time with the square of a window's pieces.
WINDOW_DOCS = 4096
#: Turns of a conversation that are one example.
TURNS = 256
_ROWS = 500
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(slots=True)
class Piece:
    """A run of a document's ids: `start` within the document; `bears` has a byte for each id, 1 if it bears loss; None: all do."""

    doc_id: int | None
    ids: bytes
    start: int
    doc_tokens: int
    bears: bytes | None = None

    def __len__(self) -> int:
        return len(self.ids) >> 2

    def loss(self) -> int:
        """Loss-bearing ids: not the first one, which nothing predicts."""
        return len(self) - 1 if self.bears is None else self.bears.count(1, 1)

    def within(self, loss: int) -> int:
        """The most first ids of which at most `loss` bear loss."""
        if self.bears is None:
            return min(len(self), loss + 1)
        at = 0
        for _ in range(loss + 1):
            if (at := self.bears.find(1, at + 1)) < 0:
                return len(self)
        return at

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        first, rest = (None, None) if self.bears is None else (self.bears[:n], self.bears[n:])
        return Piece(self.doc_id, self.ids[: 4 * n], self.start, self.doc_tokens, first), Piece(self.doc_id, self.ids[4 * n :], self.start + n, self.doc_tokens, rest)


def halved(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces, in order, as sequences whose lengths are falling powers of two."""
    left = sum(map(len, pieces))
    queue = pieces[::-1]
    while left:
        want = room = 1 << (left.bit_length() - 1)
        out = []
        while room:
            piece = queue.pop()
            if len(piece) > room:
                piece, rest = piece.cut(room)
                queue.append(rest)
            out.append(piece)
            room -= len(piece)
        left -= want
        yield out


def pack(pieces: list[Piece], max_tokens: int, max_segments: int, max_loss: int, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences, and the pieces that didn't fill one (none if `last`)."""
    import numpy as np

    done, whole = [], []
    for piece in pieces:
        while len(piece) >= max_tokens or piece.loss() > max_loss:
            n = min(max_tokens, piece.within(max_loss))
            head, piece = piece.cut(n)
            done += [[head]] if n == max_tokens else halved([head])
        if len(piece):
            whole.append(piece)
    limits = np.array([max_tokens, max_segments, max(1, max_loss)], float)
    vectors = np.array([(len(p), 1, p.loss()) for p in whole], float).reshape(-1, 3)
    waiting, tokens_left = np.ones(len(whole), bool), sum(map(len, whole))
    while tokens_left >= max_tokens or last and tokens_left:
        room, out = limits.copy(), []
        while tokens_left and room[0] >= 1 and room[1] >= 1:
            fits = np.flatnonzero(waiting & (vectors <= room).all(axis=1))
            if len(fits):
                k = fits[np.argmax((vectors[fits] / limits) @ (room / limits))]
                piece, used = whole[k], vectors[k]
                waiting[k] = False
            else:  # cut the longest to what is left
                k = int(np.argmax(np.where(waiting, vectors[:, 0], -1)))
                n = int(min(room[0], len(whole[k]) - 1, whole[k].within(int(room[2]))))
                if n < 1:
                    break
                piece, whole[k] = whole[k].cut(n)
                used, vectors[k] = np.array([n, 1, piece.loss()], float), (len(whole[k]), 1, whole[k].loss())
            room -= used
            tokens_left -= len(piece)
            out.append(piece)
        done += [out] if room[0] == 0 else halved(out)
    return done, [p for p, w in zip(whole, waiting) if w]


def _packed(examples: DataFrame, pieces_of: Callable, max_tokens: int, max_segments: int, max_loss: int | None, window: int) -> DataFrame:
    """One row for each piece of what `pieces_of` makes of each Arrow batch, packed within a task."""
    max_loss = max_tokens if max_loss is None else max_loss
    if max_tokens < 1 or max_segments < 1 or max_loss < 0:
        raise ValueError("limits must be positive")

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 32
        waiting: list[Piece] = []
        held = fresh = 0

        def packed(last: bool):
            nonlocal next_id, waiting, held, fresh
            done, waiting = pack(waiting, max_tokens, max_segments, max_loss, last)
            held, fresh = sum(map(len, waiting)), 0
            out = []
            for sequence in done:
                offset = 0
                for p in sequence:
                    out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, next_id, offset, p.loss()))
                    offset += len(p)
                next_id += 1
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names=names)

        for piece in pieces_of(batches):
            waiting.append(piece)
            held += len(piece)
            fresh += 1
            if held >= window or fresh >= WINDOW_DOCS:
                yield packed(False)
        yield packed(True)

    return examples.mapInArrow(rows, SCHEMA)


def pack_documents(
    docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, window: int = WINDOW_TOKENS, prompt_tokens: str | None = None
) -> DataFrame:
    """One row for each piece. `prompt_tokens` names a column with the number of leading ids that bear no loss."""
    columns = ["doc_id", "text"] + ([prompt_tokens] if prompt_tokens else [])

    def pieces(batches: Iterator) -> Iterator[Piece]:
        encoder, end = ChunkEncoder(path or vocabulary()), END_ID.to_bytes(4, "little")
        for batch in batches:
            masked = batch.column(2).to_pylist() if prompt_tokens else [0] * batch.num_rows
            for doc_id, ids, m in zip(batch.column(0).to_pylist(), encoder.column_ids(batch.column(1)), masked):
                ids += end
                n, m = len(ids) >> 2, m or 0
                yield Piece(doc_id, ids, 0, n, b"\0" * min(m, n) + b"\1" * (n - m) if m else None)

    return _packed(docs.select(*columns), pieces, max_tokens, max_segments, max_loss, window)


def pack_conversations(
    turns: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, window: int = WINDOW_TOKENS, loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row for each piece of conversations (conv_id, turn, role, text), with conv_id as doc_id: a conversation's texts in
    order, each with the end id; ids of `loss_roles` alone bear loss. Conversations of more than `TURNS` turns are cut
    there into examples of their own, so that none is one task's, however long. Null roles bear no loss; null texts are
    the end id alone."""
    example = F.expr(f"coalesce(turn, -1) div {TURNS}").alias("example")
    grouped = turns.select("conv_id", example, F.struct("turn", "role", "text").alias("x")).groupBy("conv_id", "example").agg(F.array_sort(F.collect_list("x")).alias("x"))
    examples = grouped.select("conv_id", F.col("x.role").alias("roles"), F.col("x.text").alias("texts"))

    def pieces(batches: Iterator) -> Iterator[Piece]:
        encoder, end = ChunkEncoder(path or vocabulary()), END_ID.to_bytes(4, "little")
        for batch in common.slices(batches, _ROWS):
            for conv_id, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                ids = [encoder.ids((t or "").encode()) + end for t in texts]
                bears = b"".join((b"\1" if r in loss_roles else b"\0") * (len(i) >> 2) for r, i in zip(roles, ids))
                yield Piece(conv_id, b"".join(ids), 0, len(bears), bears)

    return _packed(examples, pieces, max_tokens, max_segments, max_loss, window)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
