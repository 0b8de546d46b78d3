"""Token files: ids ranked by frequency in a byte-aligned code with separate control bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import map_arrow, save
from traitframe.llm.words import piece_ranges, ranges_hash, text_chunks

END_ID = 1
BLOCK_TOKENS = 1 << 20
PARTITION_BYTES = 48 << 20
CACHE_WORDS = 3_000_000

# lengths and places of the four values behind one control byte, by table
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_SUMS = _SIZES.sum(axis=1)
_BEFORE = np.concatenate((np.zeros((256, 1), np.int64), np.cumsum(_SIZES, axis=1)[:, :3]), axis=1)
_BYTE_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits a value: its bytes less one, four values a byte) and the values' bytes, least first."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of a block: a table tells for each control byte where its four values lie."""
    codes = np.frombuffer(control, np.uint8)
    begin = np.concatenate(([0], np.cumsum(_SUMS[codes])[:-1])) if len(codes) else np.zeros(0, np.int64)
    place = (begin[:, None] + _BEFORE[codes]).ravel()[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    word = raw[place].astype(np.uint32)
    for k in (1, 2, 3):
        word |= raw[np.minimum(place + k, len(raw) - 1)].astype(np.uint32) << np.uint32(8 * k)
    return word & _BYTE_MASK[_SIZES[codes].ravel()[:n]]


class TextEncoder:
    """Ids of whole texts from a tokenizer that drops white space and splits letters from other characters.

    A text's ids are then those of its pieces: words, cut between ASCII letters
    and ASCII marks other than apostrophes and those of special tokens. Each
    different piece goes through the tokenizer once and is kept, up to
    ``CACHE_WORDS`` of them. Texts that hold the start of a special token go through it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # hashes in ascending order, and their pieces' numbers
        self.n_known = self.n_ids = 0
        self.first, self.sizes, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self._append([[END_ID]])

    def _append(self, found: list[list[int]]) -> np.ndarray:
        """Numbers given to pieces of these ids; arrays double when full. Number 0 is the end of a text."""
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        numbers = np.arange(self.n_known, self.n_known + len(found), dtype=np.int32)
        while len(self.first) < self.n_known + len(found):
            self.first, self.sizes = np.concatenate((self.first, np.zeros_like(self.first))), np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        while len(self.ids) < self.n_ids + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.first[numbers], self.sizes[numbers] = self.n_ids + np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_known, self.n_ids = self.n_known + len(found), self.n_ids + len(flat)
        return numbers

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of pieces by their hashes, given in ascending order; -1 for those not known."""
        out = np.full(len(hashes), -1, np.int32)
        for known, numbers in self.levels:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            same = known[at] == hashes
            out[same] = numbers[at[same]]
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces whose hashes are given in ascending order; levels of like size are merged, so a piece moves few times."""
        numbers = self._append([x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])
        self.levels.append((hashes, numbers))
        while len(self.levels) > 1 and 4 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            known, own = (np.concatenate(x) for x in zip(*self.levels[-2:], strict=True))
            order = np.argsort(known, kind="stable")
            self.levels[-2:] = [(known[order], own[order])]
        return numbers

    def chunk(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk end to end, each closed by ``END_ID``, and their counts."""
        data = texts.data
        start, end = piece_ranges(data, texts.starts)
        codes, fresh = pd.factorize(ranges_hash(data, start, end))
        order = np.argsort(fresh)
        numbers = self._numbers(fresh[order])
        new = np.flatnonzero(numbers < 0)
        if len(new):
            if self.n_known + len(new) > CACHE_WORDS:
                self._forget()
                new = np.arange(len(fresh))
            one = np.zeros(len(fresh), np.int64)
            one[codes] = np.arange(len(codes))
            buffer, one = data.tobytes(), one[order[new]]
            pieces = [buffer[a:b].decode() for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            numbers[new] = self._learn(fresh[order[new]], pieces)
        number = np.empty(len(fresh), np.int32)
        number[order] = numbers
        closed = np.searchsorted(start, texts.starts[1:])  # pieces up to the end of each text
        closed = np.insert(number[codes], closed, 0), closed + np.arange(len(closed))
        sizes = self.sizes[closed[0]]
        ends = np.cumsum(sizes, dtype=np.int64)[closed[1]]
        counts = np.diff(ends, prepend=0)
        flat = gather(self.ids, self.first[closed[0]], sizes)
        whole = {i: self.tokenizer.encode(texts.text(i).decode(), add_special_tokens=False).ids for i in self._special(texts)}
        if whole:
            parts = [np.array([*whole[i], END_ID], np.uint32) if i in whole else flat[e - c : e] for i, (c, e) in enumerate(zip(counts, ends, strict=True))]
            counts = np.array([len(p) for p in parts], np.int64)
            flat = np.concatenate(parts).astype(np.uint32)
        return flat, counts

    @staticmethod
    def _special(texts) -> list[int]:
        data = texts.data
        at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else np.zeros(0, np.int64)  # <|
        return np.unique(np.searchsorted(texts.starts, at, "right") - 1).tolist()


def gather(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[first : first + size]`` of many ranges, end to end."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    return values[np.arange(total, dtype=kind) + np.repeat((first - (ends - sizes)).astype(kind), sizes)]


def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column whose rows are the stretches of ``values`` up to ``ends``, not copied one by one."""
    offsets = np.concatenate(([0], ends)) * values.itemsize
    if offsets[-1] >= 1 << 31:
        return pa.array([values[a:b].tobytes() for a, b in pairwise([0, *ends.tolist()])], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


_encoders: dict[str, TextEncoder] = {}


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:  # kept by the worker from task to task
            _encoders[path] = TextEncoder(path)
        encoder = _encoders[path]
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                ids, counts = encoder.chunk(chunk)
                ends = np.cumsum(counts)
                wide = bool(ids.max(initial=0) >= 1 << 16)
                narrow = ids.astype("<u4" if wide else "<u2")
                columns = [batch.column(0).slice(int(chunk.rows[0]), len(chunk.rows)), pa.array(np.full(len(counts), part), pa.int32()), pa.array(at + ends - counts), pa.array(counts), pa.array(np.full(len(counts), wide)), binary(narrow, ends)]
                at += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "at", "n", "wide", "ids"])

    return run


def _ids_of(batch: pa.RecordBatch, column: str = "ids") -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4" if w else "<u2") for b, w in zip(batch.column(column).to_pylist(), batch.column("wide").to_pylist(), strict=True)]


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.concatenate([x.astype(np.int64) for x in _ids_of(batch)] or [np.zeros(0, np.int64)])
        count = np.bincount(ids)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["id", "n"])


def _write_blocks(rank: np.ndarray, offset: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            docs, ids, have = [], [], 0
            columns = zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("at").to_pylist(), _ids_of(batch), strict=True)
            last_part, last_at = None, 0
            for doc, part, at, own in columns:
                if docs and (part != last_part or at != last_at or have >= BLOCK_TOKENS):
                    rows.append(_block(docs, ids, begin, rank))
                    docs, ids, have = [], [], 0
                if not docs:
                    begin = offset[part] + at
                docs.append((doc, len(own)))
                ids.append(own)
                have, last_part, last_at = have + len(own), part, at + len(own)
            if docs:
                rows.append(_block(docs, ids, begin, rank))
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], ["start", "doc_ids", "lengths", "control", "data"])

    return run


def _block(docs, ids, begin, rank) -> tuple:
    control, data = encode_block(rank[np.concatenate(ids).astype(np.int64)])
    return begin, [d for d, _ in docs], [n for _, n in docs], control, data


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", partition_bytes: int = PARTITION_BYTES) -> None:
    """Encode all whole texts in ascending id order to the token files below ``path``.

    ``<path>/blocks`` has a row for each block of about ``BLOCK_TOKENS`` tokens of
    neighbouring documents: ``start`` (tokens before it in the corpus), the
    documents and their lengths with the end id, control bytes and data bytes.
    ``<path>/ranks`` has the id of each rank; rank 0 is the most frequent id,
    ties by id, so frequent ids take one byte. ``<path>`` is any folder that Spark can write.

    Null reads as an empty text: its end id alone. Rows without an id come first;
    rows that share an id stand in the order of their texts. Columns other than
    the two named are not read. No rows give files without blocks.

    Texts move once, to ranges of ids; a range is tokenized by one task that
    counts its tokens on the way, so the tokens before each document follow from
    the sums of the ranges. Only those sums and the counts of the vocabulary reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // partition_bytes))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    tokens = save(map_arrow(ordered, _tokenize(tokenizer), "doc_id long, part int, at long, n long, wide boolean, ids binary"), "tokens")
    offset, before = {}, 0
    for r in sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        offset[r["part"]], before = before, before + r["n"]
    counts = map_arrow(tokens.select("wide", "ids"), _count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted((-r["n"], r["id"]) for r in counts.collect())  # one row for each id of the vocabulary that occurs
    rank = np.zeros(max((i for _, i in ranked), default=0) + 1, np.uint32)
    rank[[i for _, i in ranked]] = np.arange(len(ranked))
    spark.createDataFrame([(k, i) for k, (_, i) in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    blocks = map_arrow(tokens, _write_blocks(rank, offset), "start long, doc_ids array<long>, lengths array<long>, control binary, data binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


def _decode(ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, lengths, control, data in zip(*(batch.column(i) for i in range(5)), strict=True):
                lengths = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(lengths)
                found = ids[decode_block(control.as_py(), data.as_py(), int(lengths.sum()))].astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(docs.as_py(), pa.int64()), pa.array(start.as_py() + ends - lengths), pa.array(lengths), binary(found, ends)], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_token_files(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all documents, ids as little-endian unsigned 32-bit integers."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    ids = np.zeros(len(ranks), np.uint32)
    ids[[r["rank"] for r in ranks]] = [r["id"] for r in ranks]
    blocks = spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "control", "data")
    return map_arrow(blocks, _decode(ids), "doc_id long, start long, n_tokens long, ids binary")
