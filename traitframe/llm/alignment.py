"""Tokens of two tokenizers aligned by bytes; long documents as fragments that compose associatively.

A *unit* is a stretch of text between two places where both tokenizers surely
end a token whatever stands around. A byte range of a document is a *fragment*:
an open prefix before its first such place, closed units, and an open suffix
after the last; a range without such a place is open as a whole. Two neighbours
compose: the left suffix and the right prefix become closed units, and what is
open at the outer ends stays open. The empty range is the neutral element, so
fragments of one document may be put together in any tree.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import map_arrow, save
from traitframe.llm.token_files import gather
from traitframe.llm.words import text_chunks

CHUNK_BYTES = 256 << 10  # longer texts are cut into byte ranges of this size
FAN_IN = 16
CACHE_UNITS = 400_000
COUNT_ROWS = 4_000_000  # pairs of ids whose counts are broadcast
SALTS = 32
_UNDERLINE = "▁"
_LAST = 1 << 62

_WIDE = 0xFF << 8 | 32  # a pair that no text holds: whether a space after a wider character may be cut from it


def safe_pairs(pieces: list[str]) -> np.ndarray:
    """Byte pairs, as ``before << 8 | after``, between which no token of either tokenizer can lie.

    The byte-level tokenizer takes letters, digits and other marks apart, and
    white space goes to what follows it; an apostrophe may belong to the letter
    after it. The piece tokenizer only joins neighbours that some piece holds.
    """
    kind = np.zeros(128, np.int8)  # 1 letter, 2 digit, 3 mark, 4 space and line break; 0 anything else
    kind[[*range(65, 91), *range(97, 123)]], kind[48:58], kind[[10, 32]] = 1, 2, 4
    kind[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
    safe = np.zeros((256, 256), bool)
    safe[:128, :128] = (kind[:, None] != kind[None, :]) & (kind[:, None] > 0) & (kind[None, :] > 0)
    safe[[10, 32], :] = False
    safe[39, [*range(65, 91), *range(97, 123)]] = False
    for piece in pieces:
        text = piece.replace(_UNDERLINE, " ")
        for x, y in zip(text, text[1:], strict=False):
            if x < "\x80" and y < "\x80":
                safe[ord(x), ord(y)] = False
    safe[0xFF, 32] = not any(x >= "\x80" and y == _UNDERLINE for piece in pieces for x, y in zip(piece.lstrip(_UNDERLINE), piece.lstrip(_UNDERLINE)[1:], strict=False))
    return safe.ravel()


def cut_places(data: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """Places between the byte pairs of ``safe``, and before spaces that follow a wider character that surely is none itself.

    Three-byte characters from E1 to E3 and two-byte ones from C2 may be white
    space, so nothing is cut after them.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    found = safe[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
    at = np.flatnonzero((data[1:] == 32) & (data[:-1] >= 0x80)) + 1
    at = at[at >= 4]
    at = at[(data[at - 2] != 0xC2) & ~((data[at - 3] >= 0xE1) & (data[at - 3] <= 0xE3))]
    found[at - 1] = safe[_WIDE]
    return np.flatnonzero(found) + 1


@dataclass(frozen=True)
class Fragment:
    """Open ends of a byte range; ``suffix`` is None for a range that is open as a whole."""

    prefix: bytes
    suffix: bytes | None = None

    @staticmethod
    def of(data: bytes, safe: np.ndarray) -> tuple[Fragment, bytes]:
        """The fragment of a byte range, and its closed units end to end."""
        cuts = cut_places(np.frombuffer(data, np.uint8), safe)
        if not len(cuts):
            return Fragment(data), b""
        return Fragment(data[: cuts[0]], data[cuts[-1] :]), data[cuts[0] : cuts[-1]]

    def then(self, other: Fragment) -> tuple[Fragment, bytes]:
        """This range and the one after it as one fragment, and what closes between them."""
        if self.suffix is None:
            return Fragment(self.prefix + other.prefix, other.suffix), b""
        if other.suffix is None:
            return Fragment(self.prefix, self.suffix + other.prefix), b""
        return Fragment(self.prefix, other.suffix), self.suffix + other.prefix


def _byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _byte_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, where each begins, and its length."""
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def _gives_back(ids: np.ndarray, sizes: np.ndarray, table, want: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which units, end to end in ``want`` and ``wide`` bytes long, equal the bytes of their ids."""
    flat, first, length = table
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fine = np.bincount(owner, length[ids], len(sizes)).astype(np.int64) == wide
    kept = ids[fine[owner]]
    made = gather(flat, first[kept], length[kept])
    whole = want if fine.all() else gather(want, np.cumsum(wide) - wide, np.where(fine, wide, 0))
    ends = np.cumsum(np.where(fine, wide, 0))
    fine[np.searchsorted(ends, np.flatnonzero(made != whole), "right")] = False
    return fine


class Aligner:
    """Ids of both tokenizers for texts, unit by unit; each different unit is encoded once and kept."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        letters = _byte_of_letter()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_UNDERLINE, " ").encode())
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 ids")
        self.tables = {side: _byte_table(table) for side, table in (("a", self.a_bytes), ("b", self.b_bytes))}
        self.a_len, self.b_len = self.tables["a"][2], self.tables["b"][2]
        normal = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.space = self.b.piece_to_id(_UNDERLINE)
        # a unit without a space before it is encoded behind a line break, which no piece may hold
        self.behind = self.b.encode("\n")
        self.safe = safe_pairs(normal) if not any("\n" in p for p in normal) else np.zeros(1 << 16, bool)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.fine = np.zeros(0, bool)
        self.flat = {side: np.zeros(0, np.uint16) for side in "ab"}
        self.first = {side: np.zeros(1, np.int64) for side in "ab"}

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """Ids of the piece tokenizer, which puts a space before its text: units that begin with one go without it."""
        spaced = [t[:1] == " " for t in texts]
        found = self.b.encode([t[1:] if s else "\n" + t for t, s in zip(texts, spaced, strict=True)], num_threads=1)
        skip = len(self.behind)
        # a sole space is a token of its own; the library gives none for an empty text
        return [(ids or [self.space]) if s else ids[skip:] for ids, s in zip(found, spaced, strict=True)]

    def _learn(self, units: list[bytes]) -> None:
        """Encode new units."""
        texts = [u.decode("utf-8", "replace") for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        found = {"a": a, "b": self._pieces(texts)}
        sizes = {side: np.fromiter(map(len, ids), np.int64, len(units)) for side, ids in found.items()}
        flat = {side: np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes[side].sum())) for side, ids in found.items()}
        want, fine = np.frombuffer(b"".join(units), np.uint8), np.ones(len(units), bool)
        wide = np.fromiter(map(len, units), np.int64, len(units))
        for side in "ab":
            fine &= _gives_back(flat[side], sizes[side], self.tables[side], want, wide)
        for side in "ab":
            kept = np.where(fine, sizes[side], 0)
            begin = np.cumsum(sizes[side]) - sizes[side]
            self.flat[side] = np.concatenate((self.flat[side], gather(flat[side], begin, kept)))
            self.first[side] = np.concatenate((self.first[side], self.first[side][-1] + np.cumsum(kept)))
        self.codes.update(zip(units, range(len(self.codes), len(self.codes) + len(units)), strict=True))
        self.fine = np.concatenate((self.fine, fine))

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
        """For byte strings laid end to end: whether each could be encoded, and by tokenizer all ids and how many each string has."""
        edge = np.zeros(len(data) + 1, bool)
        edge[cut_places(data, self.safe)] = True
        edge[starts] = True
        edges = np.flatnonzero(edge)
        units = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.codes) + len(different) > CACHE_UNITS:
            self._forget()
        fresh = [u for u in different if u not in self.codes]
        if fresh:
            self._learn(fresh)
        known = np.fromiter(map(self.codes.__getitem__, different), np.int64, len(different))
        code = known[coded.indices.to_numpy()]
        owner = np.searchsorted(starts[1:], edges[:-1], "right")
        fine = np.bincount(owner, ~self.fine[code], len(starts) - 1) == 0
        ids, counts = {}, {}
        for side in "ab":
            sizes = np.diff(self.first[side])[code]
            sizes = np.where(fine[owner], sizes, 0)
            ids[side] = gather(self.flat[side], self.first[side][code], sizes)
            counts[side] = np.bincount(owner, sizes, len(starts) - 1).astype(np.int64)
        return fine, ids, counts


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _aligners:  # kept by the worker from task to task
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


@dataclass
class Aligned:
    """Groups and links of some strings, tokens end to end."""

    group_start: np.ndarray  # of each token of a: whether a group begins
    group_start_b: np.ndarray
    links: np.ndarray  # a id << 16 | b id, by place
    groups_of: np.ndarray  # by string
    links_of: np.ndarray

    @classmethod
    def of(cls, ids: dict[str, np.ndarray], counts: dict[str, np.ndarray], lengths: dict[str, np.ndarray]) -> Aligned:
        # both sides cover the same bytes, string by string, so ends can be marked on one line of bytes
        ends = {side: np.cumsum(lengths[side][ids[side]]) for side in "ab"}
        size = int(ends["a"][-1]) if len(ends["a"]) else 0
        marks, at = {}, {}
        for side in "ab":
            marks[side] = np.zeros(size + 1, bool)
            marks[side][ends[side]] = True
        both, every = marks["a"] & marks["b"], marks["a"] | marks["b"]
        places = np.flatnonzero(every)
        for side in "ab":
            done = np.cumsum(marks[side][places])  # tokens that end here or before
            at[side] = ids[side][done - marks[side][places]]
        opens = {}
        for side in "ab":
            opens[side] = np.ones(len(ends[side]), bool)
            opens[side][1:] = both[ends[side][:-1]]
        owner = np.searchsorted(ends["a"], places)  # the token of a that covers each link
        string = np.repeat(np.arange(len(counts["a"])), counts["a"])
        links_of = np.bincount(string[owner], minlength=len(counts["a"]))
        groups_of = np.bincount(string[owner[both[places]]], minlength=len(counts["a"]))
        return cls(opens["a"], opens["b"], at["a"].astype(np.uint32) << np.uint32(16) | at["b"], groups_of, links_of)


def _pairs_of_rows(found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ``(pair, row)`` of some rows of tokens, sorted so, and how often each occurs."""
    rows = np.repeat(np.arange(len(found.links_of), dtype=np.uint64), found.links_of)
    keys = np.sort(found.links.astype(np.uint64) << np.uint64(32) | rows)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((first, [len(keys)])))
    keys = keys[first]
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), times


def _joined(a: np.ndarray, b: np.ndarray, a_opens: np.ndarray, b_opens: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: decimal ids of each group, one tokenizer after the other."""
    if not len(a):
        return b""
    items = np.concatenate((a, b)).astype(np.int64)
    group = np.concatenate((np.cumsum(a_opens), np.cumsum(b_opens)))
    side = np.concatenate((np.zeros(len(a), np.int8), np.ones(len(b), np.int8)))
    order = np.lexsort((side, group))  # stable: ids stay in their order
    kind = (group * 2 + side)[order]
    last = np.ones(len(order), bool)
    last[:-1] = kind[1:] != kind[:-1]
    separator = np.where(last, np.where(side[order] == 0, 1, 2), 0)
    out = _DECIMAL[separator, items[order]].tolist()
    return b"".join(out)[:-1]


class _Decimals:
    """Ids as text with the separator that follows, made when first asked for."""

    def __init__(self):
        self.table = np.empty((3, 0), object)

    def __getitem__(self, at):
        separator, items = at
        if int(items.max(initial=0)) >= self.table.shape[1]:
            size = max(1 << 16, int(items.max()) + 1)
            self.table = np.array([[b"%d%s" % (i, mark) for i in range(size)] for mark in (b",", b"|", b";")], object)
        return self.table[separator, items]


_DECIMAL = _Decimals()
_TOKENS = "rid long, place long, fine boolean, a binary, b binary"


def _tokens(paths: tuple[str, str], rids: np.ndarray, places: np.ndarray, data: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    fine, ids, counts = _aligner(paths).encode(data, starts)
    blobs = []
    for side in "ab":
        offsets = np.concatenate(([0], np.cumsum(counts[side]))) * 2
        buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids[side].astype("<u2"))]
        blobs.append(pa.Array.from_buffers(pa.binary(), len(rids), buffers))
    return pa.RecordBatch.from_arrays([pa.array(rids), pa.array(places), pa.array(fine), *blobs], ["rid", "place", "fine", "a", "b"])


def _encode_texts(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of whole texts, a space before each; an empty text has none."""
    for batch in batches:
        rids = batch.column(0).to_numpy()
        for texts in text_chunks(batch.column(1)):
            sizes = np.diff(texts.starts)
            starts = texts.starts + np.concatenate(([0], np.cumsum(sizes > 0)))
            data = np.full(int(starts[-1]), 32, np.uint8)
            data[np.arange(len(texts.data)) + np.repeat(np.cumsum(sizes > 0), sizes)] = texts.data
            yield _tokens(paths, rids[texts.rows], np.zeros(len(texts.rows), np.int64), data, starts)


def _encode_pieces(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in text_chunks(batch.column(2)):
            yield _tokens(paths, batch.column(0).to_numpy()[texts.rows], batch.column(1).to_numpy()[texts.rows], texts.data, texts.starts)


_FRAGMENTS = "rid long, chunk long, place long, prefix binary, suffix binary, closed binary"


def _fragments(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each byte range: its open ends, and its closed units."""
    safe = _aligner(paths).safe
    for batch in batches:
        for rid, chunk, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found, closed = Fragment.of(data, safe)
            yield _rows([(rid, chunk, 2 * chunk, found.prefix, found.suffix, closed)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["rid", "chunk", "place", "prefix", "suffix", "closed"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for up to ``FAN_IN`` neighbouring fragments; a row of its own for whatever closes between two of them."""
    for batch in batches:
        for rid, chunk, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            parts.sort(key=lambda p: p["chunk"])
            whole = Fragment(b"", None)
            for part in parts:
                whole, closed = whole.then(Fragment(part["prefix"], part["suffix"]))
                if closed:
                    yield _rows([(rid, None, part["place"] - 1, None, None, closed)])
            yield _rows([(rid, chunk, parts[0]["place"], whole.prefix, whole.suffix, None)])


def _long_tokens(spark, long: DataFrame, paths: tuple[str, str], chunk_bytes: int) -> DataFrame:
    """Tokens of long texts: byte ranges in tasks of their own, their open ends composed in a tree of ``FAN_IN``."""
    size = F.octet_length("data")
    chunk = F.posexplode(F.transform(F.sequence(F.lit(0), ((size - 1) / chunk_bytes).cast("int")), lambda k: F.substring("data", k * chunk_bytes + 1, F.lit(chunk_bytes))))
    ranges = long.select("rid", F.concat(F.lit(b" "), F.encode("text", "utf-8")).alias("data")).select("rid", chunk.alias("chunk", "piece"))
    dealt = ranges.select("rid", F.col("chunk").cast("long"), "piece").repartition("rid", "chunk")
    made = save(map_arrow(dealt, partial(_fragments, paths), _FRAGMENTS), "fragments")
    closed = [made.filter(F.octet_length("closed") > 0).select("rid", "place", "closed")]
    now = made.select("rid", "chunk", "place", "prefix", "suffix")
    chunks = (made.agg(F.max("chunk")).first()[0] or 0) + 1
    while chunks > 1:
        groups = now.groupBy("rid", F.expr(f"chunk div {FAN_IN}").alias("group")).agg(F.collect_list(F.struct("chunk", "place", "prefix", "suffix")).alias("parts"))
        made = save(map_arrow(groups, _compose, _FRAGMENTS), "fragments")
        closed.append(made.filter("closed is not null").select("rid", "place", "closed"))
        now = made.filter("closed is null").select("rid", "chunk", "place", "prefix", "suffix")
        chunks = -(-chunks // FAN_IN)
    # nothing stands before the first or after the last of a document: its open ends close
    closed.append(now.filter(F.octet_length("prefix") > 0).select("rid", F.lit(-1).cast("long").alias("place"), F.col("prefix").alias("closed")))
    closed.append(now.filter(F.octet_length("suffix") > 0).select("rid", F.lit(_LAST).cast("long").alias("place"), F.col("suffix").alias("closed")))
    pieces = closed[0]
    for more in closed[1:]:
        pieces = pieces.union(more)
    return map_arrow(pieces.repartition("rid", "place"), partial(_encode_pieces, paths), _TOKENS)


def tokens_of_both(docs: DataFrame, bytes_path: str, pieces_path: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(rid, doc_id, long)`` for every row, and ``(rid, place, fine, a, b)``: ids of both tokenizers as 16-bit integers, in order of ``place`` within a row.

    Texts longer than ``chunk_bytes`` have several rows of tokens; ``fine`` is
    false where the bytes of one of the tokenizers differ from the text's.
    """
    spark = docs.sparkSession
    columns = [F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")]
    rows = save(docs.select(*columns).withColumn("long", F.octet_length("text") > chunk_bytes), "alignment-rows")
    paths = (bytes_path, pieces_path)
    short = map_arrow(rows.filter("not long").select("rid", "text"), partial(_encode_texts, paths), _TOKENS)
    long = _long_tokens(spark, rows.filter("long").select("rid", "text"), paths, chunk_bytes)
    tokens = save(short.withColumn("long", F.lit(False)).union(long.withColumn("long", F.lit(True))), "alignment-tokens")
    return rows.select("rid", "doc_id", "long"), tokens


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a binary column end to end, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u2"), np.diff(offsets) // 2


def _aligned_batches(lengths, columns: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict, dict, Aligned]]:
    """Slices of at most about a million tokens with their groups and links."""
    a_len, b_len = lengths
    for batch in batches:
        whole = np.cumsum(_ids(batch.column(columns[0]))[1])
        row = 0
        while row < len(batch):
            base = whole[row - 1] if row else 0
            last = max(row + 1, int(np.searchsorted(whole, base + (1 << 20), "right")))
            part = batch.slice(row, last - row)
            sides = {side: _ids(part.column(c)) for side, c in zip("ab", columns, strict=True)}
            ids, counts = {s: v[0] for s, v in sides.items()}, {s: v[1] for s, v in sides.items()}
            yield part, ids, counts, Aligned.of(ids, counts, {"a": a_len, "b": b_len})
            row = last


def _pair_counts(lengths, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For whole documents: how many of a batch hold each linked pair."""
    for _, _, _, found in _aligned_batches(lengths, (0, 1), batches):
        pairs = _pairs_of_rows(found)[0]
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[first]), pa.array(np.diff(np.concatenate((first, [len(pairs)]))))], ["pair", "n"])


def _row_pairs(lengths, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(rid, pair, k)``: how often each row of tokens links each pair."""
    for part, _, _, found in _aligned_batches(lengths, (1, 2), batches):
        pairs, rows, times = _pairs_of_rows(found)
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(pairs), pa.array(times)], ["rid", "pair", "k"])


_SUMS = "rid long, place long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups binary"


def _measure(lengths, counted, hashed: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each row of tokens; ``groups`` is their text, or its digest if the row is a whole document."""
    for part, ids, counts, found in _aligned_batches(lengths, (2, 3), batches):
        best, total = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        if counted is not None and len(found.links):
            pairs, n, top = counted.value
            at = np.searchsorted(pairs, found.links.astype(np.int64))
            owner = np.repeat(np.arange(len(part)), found.links_of)
            before = np.concatenate(([0], np.cumsum(n[at])))
            ends = np.cumsum(found.links_of)
            total = before[ends] - before[ends - found.links_of]  # exact, unlike sums of weights in floats
            best = np.bincount(owner, top[at], len(part)).astype(np.int64)
        texts, a_end, b_end = [], np.cumsum(counts["a"]), np.cumsum(counts["b"])
        for n_a, n_b, x, y in zip(counts["a"].tolist(), counts["b"].tolist(), a_end.tolist(), b_end.tolist(), strict=True):
            one = _joined(ids["a"][x - n_a : x], ids["b"][y - n_b : y], found.group_start[x - n_a : x], found.group_start_b[y - n_b : y])
            texts.append(hashlib.sha256(one).hexdigest().encode() if hashed and one else one)
        columns = [part.column(0), part.column(1), pa.array(counts["a"]), pa.array(counts["b"]), pa.array(found.groups_of), pa.array(found.links_of), pa.array(best), pa.array(total)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], [f.split()[0] for f in _SUMS.split(", ")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a document from its rows in order; only the running digest is held."""
    now, running = None, None
    for batch in batches:
        done = []
        for rid, groups in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if rid != now:
                if running is not None:
                    done.append((now, running.hexdigest()))
                now, running = rid, hashlib.sha256()
            else:
                running.update(b";")
            running.update(groups.as_py())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], ["rid", "digest"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([running.hexdigest()])], ["rid", "digest"])


def linked_pairs(tokens: DataFrame, lengths) -> DataFrame:
    """``(pair, n)``: in how many documents each pair of ids is linked."""
    short = map_arrow(tokens.filter("not long").select("a", "b"), partial(_pair_counts, lengths), "pair long, n long")
    long = map_arrow(tokens.filter("long").select("rid", "a", "b"), partial(_row_pairs, lengths), "rid long, pair long, k long")
    once = long.select("rid", "pair").distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return short.groupBy("pair").agg(F.sum("n").alias("n")).union(once).groupBy("pair").agg(F.sum("n").alias("n"))


def align_tokenizers(
    docs: DataFrame,
    bytes_path: str,
    pieces_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    count_rows: int = COUNT_ROWS,
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row.

    Tokenizer A (a byte-level file of the tokenizers library) encodes a space
    and the text, B (a model of the sentencepiece library, which puts that space
    itself) the text; strings of special tokens are plain text. Bytes where
    tokens of both end cut the text into groups. Two tokens are linked if their
    byte ranges overlap; a pair of ids counts the rows that hold it linked, over
    all rows. ``n_best`` counts the links whose pair is its A id's most frequent
    (ties included), ``count_sum`` adds up the counts over the links.
    ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``.

    Vocabularies may have up to 65,536 ids. Texts that are null or empty, or that one of the tokenizers does not give
    back byte by byte, have no tokens: zeros and an empty digest. Repeated rows
    count each on their own. Columns other than the two named are not read. An empty table gives no rows.

    A text is encoded unit by unit (see the module), so words seen before cost a
    lookup. Longer texts than ``chunk_bytes`` are cut into byte ranges for
    different tasks, and the open ends are composed in a tree; a stretch without
    a safe place is encoded in one piece. Pairs are counted by batch before they
    are shuffled. Up to ``count_rows`` pairs are broadcast; beyond that links join their counts.
    """
    spark = docs.sparkSession
    rows, tokens = tokens_of_both(docs, bytes_path, pieces_path, doc_id, text, chunk_bytes)
    table = Aligner(bytes_path, pieces_path)
    lengths = table.a_len, table.b_len
    bad = tokens.filter("long and not fine").select("rid").distinct()
    good = save(tokens.filter("long").join(bad, "rid", "left_anti").unionByName(tokens.filter("not long")), "alignment-good") if not bad.isEmpty() else tokens
    pairs = save(linked_pairs(good, lengths), "alignment-pairs")
    top = pairs.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("most"))
    judged = pairs.withColumn("a", F.shiftright("pair", 16)).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    few = pairs.count() <= count_rows
    counted = None
    if few:
        found = judged.toArrow()
        order = np.argsort(found["pair"].to_numpy(), kind="stable")
        columns = (found["pair"].to_numpy()[order], found["n"].to_numpy()[order], found["top"].to_numpy()[order].astype(np.int64))
        counted = spark.sparkContext.broadcast(columns)
    short = map_arrow(good.filter("not long").select("rid", "place", "a", "b"), partial(_measure, lengths, counted, True), _SUMS)
    long = save(map_arrow(good.filter("long").select("rid", "place", "a", "b"), partial(_measure, lengths, counted, False), _SUMS), "alignment-long")
    digests = map_arrow(long.filter("n_a > 0").select("rid", "groups", "place").repartition("rid").sortWithinPartitions("rid", "place").select("rid", "groups"), _digests, "rid long, digest string")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    summed = long.groupBy("rid").agg(*[F.sum(c).alias(c) for c in numbers]).join(digests, "rid", "left")
    measured = short.select("rid", *numbers, F.col("groups").cast("string").alias("digest")).union(summed.select("rid", *numbers, "digest"))
    if not few:
        links = map_arrow(good.select("rid", "a", "b"), partial(_row_pairs, lengths), "rid long, pair long, k long")
        salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
        met = links.withColumn("salt", F.pmod("rid", F.lit(SALTS))).join(judged.select("pair", "n", "top", salt), ["pair", "salt"])
        sums = met.groupBy("rid").agg(F.sum(F.when(F.col("top"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        measured = measured.drop("n_best", "count_sum").join(sums, "rid", "left")
    done = rows.select("rid", "doc_id").join(measured, "rid", "left")
    return done.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("digest", F.lit("")).alias("groups_sha256"))
