"""Operator 6: bounded-space online packing of token sequences into windows.

Each partition keeps at most ``OPEN`` windows. A document fills whole windows
first; its rest goes to the open window that it fits best. Where none fits, a
new one is opened, or, at the limit, the fullest is topped up with the head of
the rest and emitted. What is still open at a partition's end is merged in
rounds over ever fewer partitions, ``FAN_IN`` to one, so that no task gathers
more than FAN_IN * OPEN windows.

Defined results: null or empty text is its end id alone; a null doc_id is kept;
repeated rows are packed one by one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, materialize, pick, table
from .tokens import SEGMENT, default_path, encoder

WINDOW = 2048
OPEN = 64
FAN_IN = 16
#: A rest isn't cut to top up a window by fewer tokens than this.
LEAST_CUT = 8
#: Distinct pieces of text that a worker keeps where memory is short.
LEAN_PIECES = 50_000
#: Ids in an Arrow batch that the packer emits.
BATCH_IDS = 1 << 18
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, round int, still_open boolean, ids array<int>"


class Packer:
    """Places pieces (any payload with a length) into windows; ``emit`` gets each closed window's pieces."""

    def __init__(self, window: int, most_open: int, emit) -> None:
        self.window, self.most_open, self.emit = window, most_open, emit
        self.free: list[tuple[int, int]] = []  # (free, window), sorted
        self.held: dict[int, list] = {}
        self.made = 0

    def _close(self, at: int) -> None:
        _, w = self.free.pop(at)
        self.emit(self.held.pop(w))

    def place(self, length: int, take) -> None:
        """``take(a, b)`` gives the payload for tokens a to b of this document."""
        a = 0
        while length - a >= self.window:
            self.emit([take(a, a + self.window)])
            a += self.window
        while a < length:
            need = length - a
            at = bisect_left(self.free, (need, -1))
            if at == len(self.free):  # none fits
                if len(self.free) < self.most_open:
                    self.free.append((self.window, self.made))
                    self.held[self.made] = []
                    self.made += 1
                else:
                    gap, w = self.free[0]
                    if gap >= LEAST_CUT:
                        self.held[w].append(take(a, a + gap))
                        a += gap
                    self._close(0)
                continue
            gap, w = self.free.pop(at)
            self.held[w].append(take(a, length))
            a = length
            if gap == need:
                self.emit(self.held.pop(w))
            else:
                insort(self.free, (gap - need, w))

    def rest(self) -> list[list]:
        return [self.held[w] for _, w in self.free]


class _Rows:
    """Gathers piece rows and gives them out as Arrow batches."""

    def __init__(self, base: int, turn: int) -> None:
        self.sequence, self.turn = base, turn
        self._new()

    def _new(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, pieces: list, still_open: bool = False) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), total, self.sequence, offset, self.turn, still_open, ids))
            offset += len(ids)
        self.sequence += 1
        self.size += offset

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True))
        offsets = np.concatenate([[0], np.cumsum(np.array(cols[2], dtype=np.int64))]).astype(np.int32)
        types = [pa.int64()] * 6 + [pa.int32(), pa.bool_()]
        arrays = [pa.array(c, type=t) for c, t in zip(cols[:8], types, strict=True)]
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cols[8]).astype(np.int32))))
        self._new()
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "round", "still_open", "ids"])


def _first_round(vocabulary: str, end_id: int, drops_blanks: bool, plain_specials: bool, window: int, most_open: int, lean: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary if "/" in vocabulary else default_path(vocabulary), drops_blanks, plain_specials, LEAN_PIECES if lean else None)
        rows = _Rows(TaskContext.get().partitionId() << 32, 0)
        packer = Packer(window, most_open, rows.add)
        for batch in batches:
            keys, row = batch.column(0).to_pylist(), 0
            for n, ids, lengths in enc.encode(batch.column(1)):
                ends = np.cumsum(lengths)
                for doc, b, length in zip(keys[row : row + n], ends.tolist(), lengths.tolist(), strict=True):
                    own = np.append(ids[b - length : b], np.int32(end_id))
                    packer.place(length + 1, lambda x, y, doc=doc, own=own: (doc, x, len(own), own[x:y]))
                    if rows.size >= BATCH_IDS:
                        yield rows.batch()
                row += n
        for pieces in packer.rest():
            rows.add(pieces, True)
        if rows.rows:
            yield rows.batch()
        if lean:
            enc.forget()

    return pack


def _merge_round(turn: int, window: int, last: bool):
    """Pack the pieces of open windows again, longest first, with all windows open."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = []
        for batch in batches:
            doc, start, total, ids = (batch.column(i) for i in range(4))
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            pieces += [(d, s, t, values[a:b]) for d, s, t, a, b in zip(doc.to_pylist(), start.to_pylist(), total.to_pylist(), offsets[:-1], offsets[1:], strict=True)]
        pieces.sort(key=lambda p: (-len(p[3]), p[0] is None, p[0] or 0, p[1]))
        rows = _Rows((turn << 56) + (TaskContext.get().partitionId() << 32), turn)
        packer = Packer(window, len(pieces), rows.add)
        for doc, start, total, ids in pieces:
            packer.place(len(ids), lambda x, y, p=(doc, start, total, ids): (p[0], p[1] + x, p[2], p[3][x:y]))
        for held in packer.rest():
            # A window that is all but full gains nothing from another round.
            rows.add(held, not last and sum(len(p[3]) for p in held) < window - LEAST_CUT)
        if rows.rows:
            yield rows.batch()

    return pack


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, drops_blanks: bool = True, window: int = WINDOW, most_open: int = OPEN, plain_specials: bool = False, lean: bool = False) -> DataFrame:
    """Pieces of token sequences of at most ``window`` ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``plain_specials``: strings of special tokens in a text are ordinary text.
    ``lean``: a worker keeps ``LEAN_PIECES`` of text and forgets them after each partition, which takes time and frees memory.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    parts = max(1, rows.rdd.getNumPartitions())
    now = materialize(in_arrow(rows, _first_round(vocabulary, end_id, drops_blanks, plain_specials, window, most_open, lean), SCHEMA, SEGMENT // 8 if lean else SEGMENT), "packed", "snappy")
    done = now.where("NOT still_open")
    turn = 0
    while True:
        parts, turn = -(-parts // FAN_IN), turn + 1
        left = now.where("still_open").withColumn("_to", F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 56) - 1)), 32) % parts)
        dealt = left.repartitionById(parts, F.col("_to").cast("int"))
        now = materialize(in_arrow(dealt.select("doc_id", "start", "doc_tokens", "ids"), _merge_round(turn, window, parts == 1), SCHEMA), "packed", "snappy")
        done = done.union(now.where("NOT still_open"))
        if parts == 1:
            return done.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        offsets = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
        crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], type=pa.int64())
        kept = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), crc], names=[*kept, "ids_crc32"])


def op6_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint"
    return in_arrow(pieces, _digests, schema).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
