"""Long byte strings that texts repeat, through a logarithmic family of sparse suffix arrays.

Suffixes are sampled at anchors: of any ``SPAN`` bytes, the place whose ``DEPTH``
bytes have the least hash begins a suffix that is indexed. Equal strings have their anchors at equal places, so every
repeated string shares an indexed suffix. Texts are dealt with in batches. A batch sorts its suffixes
and sends each part of the key space its run; the part scans a new run against its levels, each a sorted array, for
suffixes that are there already, and takes it in as a new level, merging levels of like size, so there are as many as the logarithm of
the batches. Only strings around suffixes found twice are then compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import map_arrow, save
from traitframe.llm.exchange import Batch, by_part, meet, n_parts, pack, pack_texts, read_batch, send, unpack, with_answers
from traitframe.llm.words import Texts, mix, ranges_hash
from traitframe.operators.joins import sized_join

SPAN = 50
DEPTH = 16
CHUNK = 1 << 20
_PLACE_BITS = 28
_WORD = np.dtype(">u8")


def in_order(high: np.ndarray, low: np.ndarray, *rest: np.ndarray) -> list[np.ndarray]:
    """Arrays sorted by the first, ties by the others in turn. Runs that are sorted already are merged, not sorted again."""
    order = np.argsort(high, kind="stable")
    sorted_high = high[order]
    tie = sorted_high[1:] == sorted_high[:-1]
    member = np.flatnonzero(np.concatenate(([False], tie)) | np.concatenate((tie, [False]))) if len(high) else order
    own = order[member]
    order[member] = own[np.lexsort((*(x[own] for x in rest[::-1]), low[own], high[own]))]
    return [x[order] for x in (high, low, *rest)]


class SuffixLevels:
    """Sorted runs of suffix keys (two words each), merged while the last is as large as the one before: sizes double from level to level."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def merged(a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Union of two sorted runs without repeats, and for each key whether it came more than once."""
        high, low = in_order(np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])))
        same = np.concatenate(((high[1:] == high[:-1]) & (low[1:] == low[:-1]), [False])) if len(high) else np.zeros(0, bool)
        first = ~np.concatenate(([False], same[:-1])) if len(high) else same
        return high[first], low[first], same[first]

    def scan(self, run: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a run that some level has: first words are looked up, and where they meet both sides are merged in full."""
        found = [(run[0][:0], run[1][:0])]
        for high, low in self.levels:
            at = np.searchsorted(high, run[0])
            met = high[np.minimum(at, len(high) - 1)] == run[0]
            if met.any():
                words = np.unique(run[0][met])
                there = words[np.minimum(np.searchsorted(words, high), len(words) - 1)] == high if len(words) * 8 > len(high) else None
                if there is None:
                    a, b = np.searchsorted(high, words), np.searchsorted(high, words, "right")
                    there = np.arange(int((b - a).sum())) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
                h, w, both = self.merged((high[there], low[there]), (run[0][met], run[1][met]))
                found.append((h[both], w[both]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def add(self, run: tuple[np.ndarray, np.ndarray]) -> None:
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            last, before = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merged(before, last)[:2])


def anchors(data: np.ndarray, starts: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of texts laid end to end: neighbouring strings of ``span`` bytes with one anchor.

    (anchor, first string's place, number of strings, text) of each block; every
    string of ``span`` bytes inside a text is in one block.
    """
    none = np.zeros(0, np.int64)
    width = span - DEPTH + 1
    if len(data) < span:
        return none, none, none, none
    if len(data) >> _PLACE_BITS:
        raise ValueError("a text of 256 MB or more")
    at = np.arange(len(data) - DEPTH + 1)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = ranges_hash(data, at, at + DEPTH) & ~low | at.astype(np.uint64)
    done = 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: -(width - done)], least[width - done :])
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.flatnonzero(text[: len(least)] == text[span - 1 : span - 1 + len(least)])
    if not len(place):
        return none, none, none, none
    anchor = (least[place] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return anchor[first], place[first], np.diff(np.concatenate((first, [len(place)]))), text[place[first]]


def suffix_keys(data: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``DEPTH`` bytes of suffixes as two words that sort like the bytes."""
    found = data[anchor[:, None] + np.arange(DEPTH)].reshape(-1).view(_WORD).astype(np.uint64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def _part_of(high: np.ndarray, low: np.ndarray, parts: int) -> np.ndarray:
    return (mix(high ^ mix(low)) % np.uint64(parts)).astype(np.int64)


def _send_runs(parts: int, span: int):
    def emit(batch: Batch, _) -> Iterator[tuple[int, bytes]]:
        kept = []
        for chunk in batch.chunks(CHUNK):
            anchor, _, _, text = anchors(chunk.data, chunk.starts, span)
            kept.append((*suffix_keys(chunk.data, anchor), batch.ids[chunk.rows[text]]))
        high, low, doc = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else [np.zeros(0, np.uint64)] * 3
        high, low, doc = in_order(high, low, doc)
        first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))) if len(high) else np.zeros(0, np.int64)
        last = np.concatenate((first[1:], [len(high)]))[: len(first)] - 1
        several = doc[first] != doc[last]  # the batch itself has the suffix in two documents
        high, low = high[first], low[first]
        for part, own in by_part(_part_of(high, low, parts), parts, high, low, several.astype(np.uint8)):
            yield part, pack(*own)

    return emit


def _scan_runs(part: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Tell each batch which of its suffixes are in two documents or more."""
    family, twice, runs = SuffixLevels(), [], []
    for _, blob in rows:
        high, low, several = unpack(blob, np.uint64, np.uint64, np.uint8)
        twice.append(family.scan((high, low)))
        twice.append((high[several == 1], low[several == 1]))
        family.add((high, low))
        runs.append((high, low))
    none = np.zeros(0, np.uint64)
    high, low = np.concatenate([t[0] for t in twice]), np.concatenate([t[1] for t in twice])
    shared = SuffixLevels.merged((none, none), (high, low))
    shared = SuffixLevels.merged(shared[:2], (none, none))[:2]
    for (batch, _), run in zip(rows, runs, strict=True):
        high, low, both = SuffixLevels.merged(run, shared)
        if both.any():
            yield batch, pack(high[both], low[both])


class _Blocks:
    """Blocks of a batch around shared suffixes: equal ones are numbered alike, in the order of their hash."""

    def __init__(self, batch: Batch, shared: list[bytes], span: int):
        pairs = [unpack(b, np.uint64, np.uint64) for b in shared]
        known = np.sort(np.concatenate([mix(h ^ mix(w)) for h, w in pairs] or [np.zeros(0, np.uint64)]))
        kept = []
        for chunk in batch.chunks(CHUNK):
            anchor, place, count, text = anchors(chunk.data, chunk.starts, span)
            key = mix(np.bitwise_xor(*(lambda h, w: (h, mix(w)))(*suffix_keys(chunk.data, anchor))))
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            met = known[at] == key if len(known) else np.zeros(len(key), bool)
            place, count, text, key = place[met], count[met], text[met], key[met]
            whole = ranges_hash(chunk.data, place, place + count + span - 1)
            base = batch.starts[chunk.rows[0]]
            kept.append((key, whole, place + base, count, chunk.rows[text]))
        fields = [np.concatenate(x) for x in zip(*kept, strict=True)] if kept else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
        self.key, self.hash, self.place, self.count, self.row = fields
        self.doc = batch.ids[self.row] if len(self.row) else self.row
        order = np.lexsort((self.doc, self.hash))
        fresh = np.concatenate(([True], self.hash[order][1:] != self.hash[order][:-1])) if len(order) else np.zeros(0, bool)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        self.first = order[fresh]  # the occurrence of the least document stands for all of the batch
        self.least = self.doc[self.first]


def _send_blocks(parts: int, span: int):
    def emit(batch: Batch, answers) -> Iterator[tuple[int, bytes]]:
        blocks = _Blocks(batch, answers[0], span)
        at, count = blocks.place[blocks.first], blocks.count[blocks.first]
        part = (blocks.key[blocks.first] % np.uint64(parts)).astype(np.int64)
        for p, (number, doc, a, n) in by_part(part, parts, np.arange(len(at)), blocks.least, at, count):
            size = n + span - 1
            ends = np.cumsum(size)
            text = batch.data[np.arange(int(ends[-1])) + np.repeat(a - (ends - size), size)]
            yield p, pack(number, doc, n.astype(np.uint8), text)

    return emit


def _compare_blocks(span: int):
    def answer(part: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        """A bit for each string of a block that a document of smaller id has too."""
        own = [unpack(blob, np.int64, np.int64, np.uint8, np.uint8) for _, blob in rows]
        count = np.concatenate([o[2] for o in own]).astype(np.int64)
        doc = np.concatenate([o[1] for o in own])
        data = np.concatenate([o[3] for o in own])
        size = count + span - 1
        begin = np.cumsum(size) - size
        block = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        start = begin[block] + offset
        string = ranges_hash(data, start, start + span)
        order = np.lexsort((doc[block], string))
        fresh = np.concatenate(([True], string[order][1:] != string[order][:-1]))
        least = doc[block][order][fresh][np.cumsum(fresh) - 1]
        later = np.zeros(len(block), bool)
        later[order] = doc[block][order] > least
        mask = np.zeros(len(count), np.uint64)
        np.bitwise_or.at(mask, block[later], np.uint64(1) << offset[later].astype(np.uint64))
        at = 0
        for (batch, _), o in zip(rows, own, strict=True):
            bits = mask[at : at + len(o[0])]
            at += len(o[0])
            if bits.any():
                yield batch, pack(o[0][bits != 0], bits[bits != 0])

    return answer


def _cut(span: int, keep_text: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for r in row.to_pylist():
                batch = read_batch(r["batch"], r["texts"])
                blocks = _Blocks(batch, r["shared"] or [], span)
                mask = np.zeros(len(blocks.first), np.uint64)
                for number, bits in (unpack(b, np.int64, np.uint64) for b in r["later"] or []):
                    mask[number] = bits
                every = (np.uint64(1) << blocks.count.astype(np.uint64)) - np.uint64(1)
                bits = np.where(blocks.doc > blocks.least[blocks.number], every, mask[blocks.number]) if len(blocks.doc) else every
                for chunk in batch.chunks(CHUNK):
                    low, high = np.searchsorted(blocks.place, batch.starts[[chunk.rows[0], chunk.rows[-1] + 1]])
                    place, own, size = blocks.place[low:high] - batch.starts[chunk.rows[0]], bits[low:high], len(chunk.data)
                    step = np.zeros(size + 1, np.int32)
                    for k in range(int(blocks.count[low:high].max(initial=0))):
                        at = place[(own >> np.uint64(k)) & np.uint64(1) == 1] + k
                        np.add.at(step, at, 1)
                        np.add.at(step, at + span, -1)
                    yield _digest(batch.id_column().slice(int(chunk.rows[0]), len(chunk.rows)), chunk, np.cumsum(step[:-1]) > 0, keep_text)

    return run


def _digest(ids: pa.Array, texts: Texts, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    a, b = texts.starts[:-1], texts.starts[1:]
    total = np.concatenate(([0], np.cumsum(gone)))
    opens = gone & ~np.concatenate(([False], gone[:-1])) if len(gone) else gone
    opens[a[a < len(gone)]] = gone[a[a < len(gone)]]
    spans = np.concatenate(([0], np.cumsum(opens)))
    left = [texts.data[x:y][~gone[x:y]].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    columns = [ids, pa.array(b - a), pa.array(total[b] - total[a]), pa.array(spans[b] - spans[a]), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if keep_text:
        columns.append(pa.array(left, pa.binary()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``: one row per document, its bytes without those repeated from a document of smaller id.

    A byte goes if some ``span`` bytes (32 to 79) around it also stand in a document with a smaller id; all
    texts are judged as they came. ``keep_text`` adds the bytes that stay.

    Null reads as an empty text. Texts shorter than ``span`` keep all. Rows without an id keep all
    and take nothing from others. Rows that share an id take nothing from each other. No
    rows give no rows; columns other than the two named are not read.

    A text equal to one of a smaller id goes as a whole and isn't indexed. The others are packed into batches and saved; per batch, about one suffix in
    18 bytes is sent to its part, and strings around suffixes of several documents
    in full, equal ones of a batch once. Answers come back by batch, so a passage in a third of all documents is one entry a batch.
    """
    if not 2 * DEPTH <= span < 64 + DEPTH:
        raise ValueError(f"span must be {2 * DEPTH} to {63 + DEPTH}")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sha = F.sha2("text", 256)
    thin = save(rows.select("id", sha.alias("sha"), F.octet_length("text").cast("long").alias("n")), "text-hashes")
    first = thin.filter(F.col("id").isNotNull() & (F.col("n") >= span)).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("sha", "first")
    copies = save(sized_join(thin, first, ["sha"], salt_by=["id"]).filter("id > first").select("id", "sha", "n").distinct(), "copies")
    keyed = rows.filter(F.col("id").isNotNull() & (F.octet_length("text") >= span)).withColumn("sha", sha)
    single = sized_join(keyed, copies.select("id", "sha"), ["id", "sha"], "left_anti", staged=True)
    batches = pack_texts(single.select("id", F.lit(True).alias("flag"), "text"))
    parts = n_parts(batches)
    shared = save(meet(send(batches, _send_runs(parts, span)), parts, _scan_runs), "shared-suffixes")
    asked = with_answers(batches, shared, "shared")
    later = save(meet(send(asked, _send_blocks(parts, span), ("shared",)), parts, _compare_blocks(span)), "later-strings")
    told = with_answers(asked, later, "later")
    extra = ", kept binary" if keep_text else ""
    found = map_arrow(told.select("batch", "texts", "shared", "later"), _cut(span, keep_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
    zero = F.lit(0).cast("long")
    empty = [F.lit(b"").alias("kept")] if keep_text else []
    again = sized_join(thin, copies.select("id", "sha"), ["id", "sha"], staged=True)
    gone = again.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *empty)
    if keep_text:
        short = rows.filter(F.col("id").isNull() | (F.octet_length("text") < span)).select("id", F.octet_length("text").cast("long").alias("n"), sha.alias("sha"), "text")
    else:
        short = thin.filter(F.col("id").isNull() | (F.col("n") < span))
    whole = short.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if keep_text else []))
    return found.unionByName(gone).unionByName(whole)
