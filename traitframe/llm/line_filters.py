"""Repeated lines found through two Bloom filters and dropped from all documents but one.

A first filter holds the hashes of lines seen once, a second one those seen
again. Hashes alone are dealt to the filters, eight bytes a line; after that
only lines that the second filter knows move as text, to be counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import map_arrow, save
from traitframe.llm.words import Texts, lower_case, mix, ranges_hash, text_chunks

LINES_PER_FILTER = 1 << 22
FILTER_BYTES = 64 << 20  # second filters up to this size in all are broadcast
VERDICT_ROWS, VERDICT_BYTES = 400_000, 64 << 20  # lines to drop: up to this number and size they are broadcast
SALTS = 16
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Lines:
    """All lines of some texts, and the keys of those with ``min_chars`` code points or more once white space at both ends is cut off."""

    def __init__(self, texts: Texts, min_chars: int):
        data, starts = texts.data, texts.starts
        breaks = np.flatnonzero(data == 10)
        self.counts = 1 + np.diff(np.searchsorted(breaks, starts))
        self.start = np.sort(np.concatenate((starts[:-1], breaks + 1)))
        self.end = np.sort(np.concatenate((breaks, starts[1:])))
        solid = np.flatnonzero(~_IS_SPACE[data])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        filled = np.flatnonzero(b > a)
        key_start, key_end = solid[a[filled]], solid[b[filled] - 1] + 1
        long = chars[key_end] - chars[key_start] >= min_chars
        self.line, self.key_start, self.key_end = filled[long], key_start[long], key_end[long]
        self.lower = lower_case(data)
        self.hash = ranges_hash(self.lower, self.key_start, self.key_end)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)  # of each line

    def once_a_text(self) -> np.ndarray:
        """Places of the keys, each once for each text that holds its hash."""
        order = np.lexsort((self.hash, self.text[self.line]))
        text, value = self.text[self.line][order], self.hash[order]
        first = np.ones(len(order), bool)
        first[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        return order[first]

    def key(self, i: int) -> bytes:
        return self.lower[self.key_start[i] : self.key_end[i]].tobytes()


class Bloom:
    """A Bloom filter that keeps the four bits of a hash in one 64-bit word."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def for_keys(cls, n: int, bits: int) -> Bloom:
        return cls(np.zeros(max(1, n * bits // 64), np.uint64))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
        bits = np.zeros(len(hashes), np.uint64)
        for shift in (0, 6, 12, 18):
            bits |= np.uint64(1) << ((spread >> np.uint64(shift)) & np.uint64(63))
        return ((spread >> np.uint64(24)) % np.uint64(len(self.words))).astype(np.int64), bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at, bits = self._places(hashes)
        return (self.words[at] & bits) == bits

    def add(self, hashes: np.ndarray) -> None:
        at, bits = self._places(hashes)
        np.bitwise_or.at(self.words, at, bits)


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _hashes(min_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different hashes of a chunk of texts, and whether two texts of the chunk share one."""
    for batch in batches:
        for texts in text_chunks(batch.column(0)):
            lines = Lines(texts, min_chars)
            found, n = np.unique(lines.hash[lines.once_a_text()], return_counts=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([_signed(found), pa.array(n > 1)], ["h", "again"])


def _second_filter(lines: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters of each segment from its hashes, which come sorted by segment; the second one is what stays."""
    now, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([twice.words.tobytes()], pa.binary())], ["segment", "bits"])

    for batch in batches:
        segments = batch.column(0).to_numpy()
        hashes = batch.column(1).to_numpy().view(np.uint64)
        again = batch.column(2).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(segments)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(segments)], strict=True):
            if a == b:
                continue
            if segments[a] != now:
                if now is not None:
                    yield done()
                now, once, twice = int(segments[a]), Bloom.for_keys(lines, 16), Bloom.for_keys(lines, 4)
            found, place, n = np.unique(hashes[a:b], return_inverse=True, return_counts=True)
            seen = once.has(found) | (n > 1) | (np.bincount(place, again[a:b], len(found)) > 0)
            twice.add(found[seen])
            once.add(found)
    if now is not None:
        yield done()


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (hashes.view(np.int64) % segments).astype(np.int64)


def _suspects(lines: Lines, known: np.ndarray, ids: list) -> pa.RecordBatch:
    """Keys that are known to be suspected: in how many texts of the chunk, and the largest id among them."""
    once = lines.once_a_text()
    found: dict[bytes, list] = {}
    for i in once[known[once]].tolist():
        doc, key = ids[lines.text[lines.line[i]]], lines.key(i)
        entry = found.setdefault(key, [int(lines.hash[i : i + 1].view(np.int64)[0]), 0, None])
        entry[1] += 1
        if doc is not None and (entry[2] is None or doc > entry[2]):
            entry[2] = doc
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.binary()), *(pa.array([e[k] for e in found.values()], pa.int64()) for k in range(3))], ["key", "h", "n", "keep"]
    )


def _suspects_by_filter(filters, min_chars: int, segments: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blooms = {s: Bloom(np.frombuffer(b, np.uint64)) for s, b in filters.value.items()}
    for batch in batches:
        for texts in text_chunks(batch.column(1)):
            lines = Lines(texts, min_chars)
            segment, known = _segment(lines.hash, segments), np.zeros(len(lines.hash), bool)
            for s in np.unique(segment).tolist():
                own = segment == s
                known[own] = blooms[s].has(lines.hash[own])
            yield _suspects(lines, known, batch.column(0).slice(int(texts.rows[0]), len(texts.rows)).to_pylist())


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hashes that the filter before them, sorted so, knows."""
    now = None
    for batch in batches:
        bits, rid, h = batch.column("bits"), batch.column("rid"), batch.column("h")
        heads = np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for a, b in zip([0, *heads], [*heads, len(bits)], strict=True):
            if a in heads:
                now = Bloom(np.frombuffer(bits[a].as_py(), np.uint64))
            a += a in heads
            if a < b:
                kept = np.flatnonzero(now.has(h.slice(a, b - a).to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([rid.slice(a, b - a).take(pa.array(kept)), h.slice(a, b - a).take(pa.array(kept))], ["rid", "h"])


def _row_hashes(min_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column(0).to_numpy()
        for texts in text_chunks(batch.column(1)):
            lines = Lines(texts, min_chars)
            once = lines.once_a_text()
            yield pa.RecordBatch.from_arrays([pa.array(rid[texts.rows[0] + lines.text[lines.line[once]]]), _signed(lines.hash[once])], ["rid", "h"])


def _suspects_by_row(min_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(1)):
            lines = Lines(texts, min_chars)
            known = np.zeros(len(lines.hash), bool)
            text = lines.text[lines.line]
            for k, row in enumerate(texts.rows.tolist()):
                wanted = batch.column(2)[row].as_py()
                if wanted:
                    own = slice(*np.searchsorted(text, (k, k + 1)))
                    known[own] = np.isin(lines.hash[own].view(np.int64), wanted)
            yield _suspects(lines, known, batch.column(0).slice(int(texts.rows[0]), len(texts.rows)).to_pylist())


def _kept(lines: Lines, texts: Texts, ids: list, keep: dict[bytes, int | None], hashes: np.ndarray) -> pa.RecordBatch:
    """Texts of a chunk without the lines whose key is in ``keep`` with another id."""
    dropped = np.zeros(len(lines.start), bool)
    for i in np.flatnonzero(np.isin(lines.hash, hashes)).tolist():
        line, key = lines.line[i], lines.key(i)
        dropped[line] = key in keep and keep[key] != ids[lines.text[line]]
    n_dropped = np.bincount(lines.text, dropped, len(lines.counts)).astype(np.int64)
    ends = np.cumsum(lines.counts)
    out = []
    for k, (n, end, drops) in enumerate(zip(lines.counts.tolist(), ends.tolist(), n_dropped.tolist(), strict=True)):
        whole = texts.text(k)
        if drops:
            stay = np.flatnonzero(~dropped[end - n : end]) + end - n
            whole = b"\n".join(texts.data[lines.start[i] : lines.end[i]].tobytes() for i in stay.tolist())
        out.append(whole)
    arrays = [pa.array(ids, pa.int64()), pa.array(lines.counts, pa.int64()), pa.array(n_dropped), pa.array(out, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "text"])


def _drop_all(verdicts, min_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep, hashes = verdicts.value
    for batch in batches:
        for texts in text_chunks(batch.column(1)):
            yield _kept(Lines(texts, min_chars), texts, batch.column(0).slice(int(texts.rows[0]), len(texts.rows)).to_pylist(), keep, hashes)


def _drop_by_row(min_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(1)):
            rows = slice(int(texts.rows[0]), int(texts.rows[-1]) + 1)
            found = [v for row in batch.column(2)[rows].to_pylist() for v in row or ()]
            keep, hashes = {v["key"]: v["keep"] for v in found}, np.unique(np.array([v["h"] for v in found], np.int64)).view(np.uint64)
            yield _kept(Lines(texts, min_chars), texts, batch.column(0)[rows].to_pylist(), keep, hashes)


def _with_lists(rows: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """``(doc_id, text, list)``: each row with what was found for it; a list is no longer than its text has lines."""
    lists = found.groupBy("rid").agg(F.collect_list(value).alias("found"))
    return rows.join(lists, "rid", "left").select("doc_id", "text", "found")


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    filter_bytes: int = FILTER_BYTES,
    verdict_rows: int = VERDICT_ROWS,
    verdict_bytes: int = VERDICT_BYTES,
    lines_per_filter: int = LINES_PER_FILTER,
) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)`` for every row, without the lines that many documents share.

    A text is split at line breaks. The key of a line has no white space (the
    six ASCII characters of it) at either end and a-z for A-Z. A key of
    ``min_chars`` code points that ``min_docs`` or more rows hold loses all its
    lines, but for those in the row of the largest id that holds it. What stays is joined by line breaks.

    A null or empty text is one empty line. Each row is a document of its own;
    rows that share the largest id keep their lines alike. A null id is below
    all others; if no holder has an id, all keep the line. Columns other than the
    two named are not read. An empty table gives no rows.

    Different hashes of each chunk of texts (about 1 MB) go to segments of the
    hash space, each with its two filters. The second filters tell which lines
    may be repeats; there are no false negatives, so the exact count behind them
    sees every row of a repeated key, and hash collisions cost only a look. A
    line in very many rows is one row a chunk wherever it is shuffled. Filters
    and verdicts within the given sizes are broadcast; beyond them hashes meet
    their filter segment, and documents are joined with what was found for their rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashes = save(map_arrow(rows.select("text"), partial(_hashes, min_chars), "h long, again boolean"), "line-hashes")
    segments = max(1, -(-hashes.count() // lines_per_filter))
    dealt = hashes.select(F.pmod("h", F.lit(segments)).alias("segment"), "h", "again").repartition(segments, "segment").sortWithinPartitions("segment")
    filters = save(map_arrow(dealt, partial(_second_filter, lines_per_filter), "segment long, bits binary"), "line-filters")
    one = f"key binary, {', '.join(f'{c} long' for c in ('h', 'n', 'keep'))}"
    kept = "doc_id long, n_lines long, n_dropped long, text string"

    numbered = None

    def row_hashes() -> tuple[DataFrame, DataFrame]:
        nonlocal numbered
        if numbered is None:
            fixed = save(rows.select(F.monotonically_increasing_id().alias("rid"), "*"), "line-rows")
            numbered = fixed, save(map_arrow(fixed.select("rid", "text"), partial(_row_hashes, min_chars), "rid long, h long"), "line-row-hashes")
        return numbered

    if segments * (lines_per_filter * 4 // 8) <= filter_bytes:
        known = spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in filters.collect()})
        suspects = map_arrow(rows, partial(_suspects_by_filter, known, min_chars, segments), one)
    else:
        fixed, own = row_hashes()
        asked = own.select(F.pmod("h", F.lit(segments)).alias("segment"), F.pmod("rid", F.lit(SALTS)).alias("salt"), F.lit(None).cast("binary").alias("bits"), "rid", "h")
        told = filters.select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "bits", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("long").alias("h"))
        met = asked.unionByName(told).repartition("segment", "salt").sortWithinPartitions("segment", "salt", F.col("bits").isNull())
        found = map_arrow(met.select("bits", "rid", "h"), _probe, "rid long, h long")
        suspects = map_arrow(_with_lists(fixed, found, "h"), partial(_suspects_by_row, min_chars), one)
    counted = suspects.groupBy("key").agg(F.min("h").alias("h"), F.sum("n").alias("n"), F.max("keep").alias("keep"))
    verdicts = save(counted.filter(F.col("n") >= min_docs).select("key", "h", "keep"), "line-verdicts")
    size = verdicts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= verdict_rows and size["bytes"] <= verdict_bytes:
        told = verdicts.collect()
        lookup = {bytes(r["key"]): r["keep"] for r in told}, np.unique(np.array([r["h"] for r in told], np.int64)).view(np.uint64)
        return map_arrow(rows, partial(_drop_all, spark.sparkContext.broadcast(lookup), min_chars), kept)
    fixed, own = row_hashes()
    salted = verdicts.select("h", F.struct("key", "h", "keep").alias("verdict"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    found = own.withColumn("salt", F.pmod("rid", F.lit(SALTS))).join(salted, ["h", "salt"]).select("rid", "verdict")
    return map_arrow(_with_lists(fixed, found, "verdict"), partial(_drop_by_row, min_chars), kept)
