"""Benchmark passages in documents, found by spaced seeds that tolerate substituted words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import boxed, map_arrow, save
from traitframe.llm.words import mix, text_chunks, words_of
from traitframe.operators.joins import sized_join

# 1 compares a word, 0 ignores it. In any 12 words of which two or
# fewer differ, one of these masks lies on equal words somewhere.
MASKS = ("11101011", "101100111", "1111011")
WINDOW = 12
SIMILARITY = 0.8
MIN_ITEM_WORDS = 5
VERIFY_ROWS = 20_000
SHORT_BLOCKS = 5
_FILTER_BITS = (16, 28)


def short_masks(n: int, similarity: float = SIMILARITY) -> list[list[int]]:
    """Compared offsets in an item of ``n`` words, so that one mask at least lies on equal words if the given part of them is equal.

    The words are cut into blocks. Substitutions touch one block each at most, so
    the masks are all choices of as many blocks as stay untouched.
    """
    differ = n - max(1, math.ceil(similarity * n - 1e-9))
    blocks = np.array_split(np.arange(n), min(n, max(SHORT_BLOCKS, differ + 3)) if differ else 1)
    return [np.concatenate(kept).tolist() for kept in combinations(blocks, len(blocks) - differ)]


def _mask_offsets(short: tuple[int, ...], similarity: float) -> list[tuple[int, int, list[int]]]:
    """(number, item length, compared offsets) of the masks for long items, whose length is told as zero, and for each length of short ones."""
    seeds = [(i, 0, [k for k, c in enumerate(m) if c == "1"]) for i, m in enumerate(MASKS)]
    return seeds + [(1000 * n + i, n, offsets) for n in short for i, offsets in enumerate(short_masks(n, similarity))]


def seed_hashes(words: np.ndarray, counts: np.ndarray, mask: int, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of one mask at all places of texts laid end to end, and the places; none reaches into the next text."""
    span = offsets[-1] + 1
    if len(words) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.full(len(words) - span + 1, mask + 1, np.uint64)
    for k, at in enumerate(offsets):
        total = (total + words[at : at + len(total)]) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & ((1 << 64) - 1) | 1)
    place = np.flatnonzero(text[: len(total)] == text[span - 1 :])
    return mix(total[place]), place


def benchmark_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, n, words)``: word hashes of every item with an id and ``MIN_ITEM_WORDS`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in text_chunks(batch.column(1)):
                found = words_of(chunk)
                cuts = np.concatenate(([0], np.cumsum(found.counts)))
                blobs = [found.hash[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(int(chunk.rows[0]), len(chunk.rows)), pa.array(found.counts, pa.int32()), pa.array(blobs, pa.binary())], ["item_id", "n", "words"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("item_id is not null")
    return map_arrow(rows, run, "item_id long, n int, words binary").filter(F.col("n") >= MIN_ITEM_WORDS)


def _item_seeds(short: tuple[int, ...], similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = np.frombuffer(blob, np.uint64)
                for mask, length, offsets in _mask_offsets(short, similarity):
                    if length == (n if n < WINDOW else 0):
                        hashes, place = seed_hashes(words, np.array([n]), mask, offsets)
                        if length:  # masks of short items lie at their first word only
                            hashes, place = hashes[:1], place[:1]
                        columns = [pa.array(np.full(len(hashes), item)), pa.array(hashes.view(np.int64)), pa.array(place.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, ["item_id", "seed", "item_at"])

    return run


def _document_seeds(short: tuple[int, ...], similarity: float, filter_bits: bytes):
    bits = np.frombuffer(filter_bits, np.uint8)
    low = np.uint64(len(bits) * 8 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in text_chunks(batch.column(1)):
                found = words_of(chunk)
                first = np.concatenate(([0], np.cumsum(found.counts)))
                for mask, _, offsets in _mask_offsets(short, similarity):
                    hashes, place = seed_hashes(found.hash, found.counts, mask, offsets)
                    key = hashes & low
                    hit = (bits[(key >> np.uint64(3)).astype(np.int64)] >> (key & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    hashes, place = hashes[hit], place[hit]
                    text = np.searchsorted(first, place, "right") - 1
                    columns = [pa.array(ids[chunk.rows[text]], pa.int64()), pa.array(hashes.view(np.int64)), pa.array((place - first[text]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seed", "doc_at"])

    return run


def _filter_of(seeds: DataFrame) -> tuple[bytes, int]:
    """A bit for each seed hash of the items, in a table of 32 bits a seed, 32 MB at most. What it lets through is joined exactly."""
    n = seeds.count()
    log = min(max(math.ceil(math.log2(32 * max(n, 1))), _FILTER_BITS[0]), _FILTER_BITS[1])
    low = (1 << log) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy() & low).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary())], ["at"])

    if n > 1 << 22:  # more seeds than the table can tell apart: let all through, the join decides
        return b"\xff" * (1 << log >> 3), n
    flags = np.zeros(1 << log, np.uint8)
    for row in map_arrow(seeds.select("seed"), run, "at binary").toLocalIterator():  # four bytes a seed: 16 MB at most
        flags[np.frombuffer(row["at"], np.int32)] = 1
    return np.packbits(flags, bitorder="little").tobytes(), n


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, similarity: float = SIMILARITY) -> tuple[int, int, int, int] | None:
    """The stretch of an item that a document repeats when item word i lies at ``i + shift``.

    It spans all windows of ``WINDOW`` words (the item, if shorter) of which the
    given part or more is equal. (first item word, words, equal words, first document word), or None.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    window = min(WINDOW, len(item))
    if high - low < window:
        return None
    same = np.concatenate(([0], np.cumsum(doc[low + shift : high + shift] == item[low:high])))
    good = np.flatnonzero(same[window:] - same[:-window] >= similarity * window - 1e-9)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + window
    return low + first, last - first, int(same[last] - same[first]), low + first + shift


def _verify(similarity: float):
    names = ["doc_id", "item_id", "item_at", "doc_at", "n_words", "n_equal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2)
            out: list[tuple] = []
            for chunk in text_chunks(batch.column(1)):
                found = words_of(chunk)
                first = np.concatenate(([0], np.cumsum(found.counts)))
                for i, row in enumerate(chunk.rows.tolist()):
                    words, best = found.hash[first[i] : first[i + 1]], {}
                    for place in wanted[row].as_py():
                        item = place["item_id"]
                        if hit := overlap(words, np.frombuffer(place["words"], np.uint64), place["shift"], similarity):
                            best[item] = max(best.get(item, ()), (hit[2], hit[1], -hit[3], hit[0]))
                    out.extend((ids[row], item, at, -minus, n, equal) for item, (equal, n, minus, at) in best.items())
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def benchmark_overlaps(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``(doc_id, item_id, item_at, doc_at, n_words, n_equal)``: one row for each document that repeats words of an item.

    A document repeats an item if some 12 words of it (all, if it is shorter) occur with
    ``similarity`` or more of them equal, at their places; other words may stand
    in for the rest. Words are compared with A-Z as a-z. The longest stretch of
    each pair is told; of equal ones the first.

    Null and empty texts repeat nothing; items of fewer than five words are not
    looked for. Rows without an id are not told. Rows sharing an id are reported
    together, items likewise. Empty tables give no rows; columns other than the named are not read.

    Documents are read once for seeds: only seeds that pass a bit table of the
    items' seeds (32 MB at most) leave the scan, and the exact join with the
    items' seeds is broadcast if those were counted to be few and salted
    otherwise, so a passage in a third of all documents is spread. Texts are read
    again for documents with a hit only.
    """
    items = save(benchmark_words(items, item_id, item_text), "benchmark-words")
    short = tuple(sorted(r["n"] for r in items.filter(F.col("n") < WINDOW).select("n").distinct().collect()))
    seeds = save(map_arrow(items, _item_seeds(short, similarity), "item_id long, seed long, item_at int").distinct(), "benchmark-seeds")
    bits, _ = _filter_of(seeds)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    hits = save(map_arrow(rows, _document_seeds(short, similarity, bits), "doc_id long, seed long, doc_at int"), "seed-hits")
    pairs = sized_join(hits, seeds, ["seed"], salt_by=["doc_id"], staged=True)
    pairs = pairs.select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    pairs = sized_join(save(pairs, "aligned-pairs"), items.dropDuplicates(["item_id", "words"]), ["item_id"], salt_by=["doc_id"], max_rows=VERIFY_ROWS)
    wanted = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("wanted"))
    texts = sized_join(rows, wanted, ["doc_id"], max_rows=VERIFY_ROWS)
    found = map_arrow(texts.select("doc_id", "text", "wanted"), _verify(similarity), "doc_id long, item_id long, item_at int, doc_at int, n_words int, n_equal int")
    best = F.max_by(F.struct("item_at", "doc_at", "n_words", "n_equal"), F.struct("n_equal", "n_words", -F.col("doc_at"), "item_at"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def without_benchmark(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **names) -> DataFrame:
    """``docs`` without those that repeat an item; rows without an id stay, as they can't be named."""
    taken = benchmark_overlaps(docs, items, doc_id, **names).select(F.col("doc_id").alias("_taken")).distinct()
    return sized_join(boxed(docs, _taken=F.col(doc_id).cast("long")), taken, ["_taken"], "left_anti").select("row.*")
