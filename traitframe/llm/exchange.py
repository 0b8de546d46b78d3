"""Batches of whole texts that ask parts of a large key space, and get answers back.

Texts are packed into batches once and saved. A batch sends each part its own keys
as one row of arrays; a part meets the rows of all batches and answers each batch in one row again. What is
shuffled are distinct keys of a batch rather than tokens, texts never meet in a group, and a key as
frequent as may be costs one entry for each batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import map_arrow, save
from traitframe.llm.words import CHUNK_BYTES, Texts

BATCH_BYTES = 16 << 20
PART_BYTES = 8 << 20
_CODEC = "zstd"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; types are told again to :func:`unpack`."""
    raw = b"".join([np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True)


def unpack(blob: bytes, *types: object) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), _CODEC, asbytes=True)
    n = np.frombuffer(raw, np.int64, 1 + len(types))[1:]
    out, at = [], 8 * (1 + len(types))
    for k, kind in zip(n.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, kind, k, at))
        at += k * np.dtype(kind).itemsize
    return out


@dataclass
class Batch:
    number: int
    ids: np.ndarray
    flags: np.ndarray
    named: np.ndarray  # whether the text has an id
    starts: np.ndarray
    data: np.ndarray

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=~self.named)

    def chunks(self, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
        row = 0
        while row < len(self.ids):
            last = max(row + 1, int(np.searchsorted(self.starts, self.starts[row] + limit, "right")) - 1)
            yield Texts(np.arange(row, last), self.data[self.starts[row] : self.starts[last]], self.starts[row : last + 1] - self.starts[row])
            row = last


def pack_texts(rows: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Save ``rows(id long, flag boolean, text string)`` as ``(batch, n, bytes, texts)`` of about ``batch_bytes`` of text each; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            texts = [b.column(2).cast(pa.large_binary()).fill_null(b"") for b in held]
            lengths = np.concatenate([np.diff(np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]) for t in texts])
            data = b"".join(x for t in texts for x in t.to_pylist())
            named = table.column(0).is_valid().to_numpy()
            ids, flags = table.column(0).fill_null(0).to_numpy(), table.column(1).to_numpy()
            blob = pack(ids.astype(np.int64), flags.astype(np.uint8), named.astype(np.uint8), np.concatenate(([0], np.cumsum(lengths))), np.frombuffer(data, np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([len(ids)]), pa.array([len(data)]), pa.array([blob], pa.binary())], ["batch", "n", "bytes", "texts"])

        for batch in batches:
            lengths = np.diff(np.frombuffer(batch.column(2).cast(pa.large_binary()).buffers()[1], np.int64)[: batch.num_rows + 1]) if batch.num_rows else np.zeros(0, np.int64)
            at = 0
            while at < batch.num_rows:
                upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), batch_bytes - size, "right")))
                held.append(batch.slice(at, upto - at))
                size += int(lengths[at:upto].sum())
                at = upto
                if size >= batch_bytes or at < batch.num_rows:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    return save(map_arrow(rows.select("id", "flag", "text"), run, "batch long, n long, bytes long, texts binary"), "text-batches")


def read_batch(number: int, blob: bytes) -> Batch:
    ids, flags, named, starts, data = unpack(blob, np.int64, np.uint8, np.uint8, np.int64, np.uint8)
    return Batch(number, ids, flags.astype(bool), named.astype(bool), starts, data)


def n_parts(batches: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts that each serve about ``part_bytes`` of text."""
    return max(1, -(-(batches.agg(F.sum("bytes")).first()[0] or 0) // part_bytes))


def send(batches: DataFrame, emit: Callable[[Batch, list[list[bytes]]], Iterator[tuple[int, bytes]]], answers: tuple[str, ...] = ()) -> DataFrame:
    """``(part, batch, blob)``: what ``emit`` makes of each batch and the answers in the named columns."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for r in row.to_pylist():
                for part, blob in emit(read_batch(r["batch"], r["texts"]), [r[a] or [] for a in answers]):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r["batch"]]), pa.array([blob], pa.binary())], ["part", "batch", "blob"])

    return map_arrow(batches.select("batch", "texts", *answers), run, "part int, batch long, blob binary")


def meet(sent: DataFrame, parts: int, answer: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """``(batch, blob)``: for each part, what ``answer`` makes of the rows of all batches, in the order of batches."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def told():
            for batch, blob in answer(part, held):
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([blob], pa.binary())], ["batch", "blob"])

        for row in rows:
            for own, batch, blob in zip(*(row.column(i).to_pylist() for i in range(3)), strict=True):
                if held and own != part:
                    yield from told()
                    held = []
                part = own
                held.append((batch, blob))
        if held:
            yield from told()

    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "batch")
    return map_arrow(dealt, run, "batch long, blob binary")


def with_answers(batches: DataFrame, told: DataFrame, name: str) -> DataFrame:
    """Batches with all their answers as an array; both are bounded by the size of a batch."""
    gathered = told.groupBy("batch").agg(F.collect_list("blob").alias(name))
    return batches.join(gathered, "batch", "left")


def by_part(part: np.ndarray, parts: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays split by part, in the order they had."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            own = order[cuts[p] : cuts[p + 1]]
            yield p, [a[own] for a in arrays]
