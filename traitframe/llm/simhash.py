"""Near-duplicate documents by SimHash fingerprints, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitframe.llm.common import boxed, connected_components, map_arrow, save
from traitframe.llm.words import text_chunks
from traitframe.operators.joins import sized_join

SHINGLE_WORDS = 3
MAX_BITS = 2
FANOUT = 8
HOT_NODE = 4096
_SEED = 42
_SHINGLES_AT_ONCE = 1 << 18


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text: a bit is set if more than half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    joined = b" ".join(words)
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = [digest(joined[a:b], _SEED) for a, b in zip(starts[at : at + _SHINGLES_AT_ONCE], ends[at : at + _SHINGLES_AT_ONCE], strict=True)]
        hashes = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long. Null and empty texts, and texts without words, have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(chunk.text(i), shingle_words) for chunk in text_chunks(batch.column(1)) for i in range(len(chunk.rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order: bit i of the place is the parity of the code's bits from i up."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes in Gray order below a hierarchy of shared bit patterns.

    Neighbours in Gray order share many bits. A node stands for ``FANOUT``
    neighbours and keeps the bits that all of them share and that no node above
    it keeps: ``mask`` says which, ``pattern`` how they are set. The masks on the
    way from the top to a code are disjoint and make up all bits, so differences
    added up on the way are the code's Hamming distance at the end, and a lower
    bound of it for the whole group before.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        pattern, mask = codes[self.order], np.full(len(codes), ~np.uint64(0))
        self.levels = [(pattern, mask)]
        while len(pattern) > FANOUT:
            first = np.arange(0, len(pattern), FANOUT)
            own = np.bitwise_and.reduceat(mask, first)
            own &= ~(np.bitwise_or.reduceat(pattern, first) ^ np.bitwise_and.reduceat(pattern, first))
            above = np.repeat(own, FANOUT)[: len(pattern)]
            self.levels[-1] = (pattern & ~above, mask & ~above)
            pattern, mask = pattern[first] & own, own
            self.levels.append((pattern, mask))

    def within(self, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, code number) at ``bits`` or fewer differing bits."""
        pattern, mask = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        far = np.zeros(len(q), np.int16)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            far = far + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            near = far <= bits
            q, node, far = q[near], node[near], far[near]
            if depth:
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = child < len(self.levels[depth - 1][0])
                q, far, node = np.repeat(q, FANOUT)[there], np.repeat(far, FANOUT)[there], child[there]
        return q, self.order[node]


def linked_roots(codes: np.ndarray, bits: int = MAX_BITS, at_once: int = 2048) -> np.ndarray:
    """For distinct codes, the least code number that each reaches by links of ``bits`` or fewer differing bits."""
    index, root = GrayIndex(codes), np.arange(len(codes))
    while True:
        before = root.copy()
        for at in range(0, len(codes), at_once):
            a, b = index.within(codes[at : at + at_once], bits)
            a, b = root[a + at], root[b]
            least = np.minimum(a, b)
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            while (up := root[root] != root).any():
                root[up] = root[root[up]]
        if (root == before).all():
            return root


def _node_links(bits: int):
    """Stream rows ``(node, sub, fp)`` sorted by node; for each node the links of its members to their least."""

    def links(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(codes) < 2:
            return codes[:0], codes[:0]
        root = linked_roots(codes.view(np.uint64), bits)
        moved = root != np.arange(len(codes))
        return codes[moved], codes[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = np.zeros((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate((carry, np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], np.int64)), axis=1)
            if not rows.shape[1]:
                continue
            fresh = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            last = int(fresh[-1]) if len(fresh) else 0
            carry = rows[:, last:]
            found = [links(codes) for codes in np.split(rows[2][:last], fresh[:-1])] if last else []
            yield _edges(found)
        yield _edges([links(carry[2])])

    def _edges(found) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def fingerprint_links(codes: DataFrame, bits: int = MAX_BITS, hot_node: int = HOT_NODE) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` at ``bits`` or fewer differing bits, two at most.

    The top nodes of the index are dealt out to tasks. A top node is a mask of two
    of four 16-bit blocks and the pattern there. Codes with two differing bits
    agree on two blocks at least, so each link lies inside a top node, where its
    differences start at zero; below it, a :class:`GrayIndex` holds the members.
    A node of more than ``hot_node`` members is split by eight-bit blocks of its
    other 32 bits in the same way; members of such a node share 48 bits, so none has more
    than 65,536. Within a node, members are linked to the least they reach
    rather than in pairs: links grow with the codes, not with their pairs.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2: the top nodes hold links of two differing bits or fewer")

    def nodes(blocks: list[int], shift: int):
        ones = (1 << shift) - 1
        for number, pair in enumerate(combinations(blocks, 2)):
            mask = sum(ones << low for low in pair)
            yield number, mask - (1 << 64) if mask >> 63 else mask

    tops = list(nodes([0, 16, 32, 48], 16))
    top = F.explode(F.array(*[F.struct(F.lit(i).alias("top"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("shared")) for i, m in tops])).alias("n")
    members = codes.select("fp", top).select("fp", "n.top", "n.shared")
    hot = members.groupBy("top", "shared").count().filter(F.col("count") > hot_node).select("top", "shared", F.lit(True).alias("hot"))
    members = sized_join(members, hot, ["top", "shared"], "left", salt_by=["fp"])

    def split(number: int) -> Column:
        taken = list(combinations([0, 16, 32, 48], 2))[number]
        rest = [low + half for low in (0, 16, 32, 48) if low not in taken for half in (0, 8)]
        return F.array(*[F.xxhash64(F.lit(i), F.col("shared"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint"))) for i, m in nodes(rest, 8)])

    finer = F.when(F.col("hot"), F.element_at(F.array(*[split(i) for i, _ in tops]), F.col("top") + 1)).otherwise(F.array(F.lit(0).cast("bigint")))
    dealt = members.select(F.xxhash64("top", "shared").alias("node"), F.explode(finer).alias("sub"), "fp")
    dealt = dealt.repartition("node", "sub").sortWithinPartitions("node", "sub")
    return map_arrow(dealt, _node_links(bits), "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per document, with the smallest doc_id reached by links of near fingerprints.

    Null and empty texts have fingerprint zero, which is linked like any other.
    Repeated rows stay, each with the same component. Rows without an id take
    their component from the others; where all are without id it is null. No rows
    give no rows; columns other than the two named are not read.

    Equal fingerprints are one code in the index, so a group of copies costs one entry whatever its size.
    """
    prints = save(fingerprints(docs, doc_id, text, shingle_words), "fingerprints")
    groups = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "codes")
    parts = connected_components(fingerprint_links(groups.select("fp"), bits))
    linked = parts.join(groups, F.col("node") == F.col("fp")).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    copies = groups.filter("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    named = save(linked.union(copies), "components")
    out = sized_join(prints, named, ["fp"], "left", salt_by=["doc_id"], staged=True)
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Rows of ``docs``, all columns, whose id is the smallest of their component: one for each group.

    Rows without an id can't be named as members of a group and stay. Of rows that share a kept id, the one of the least text stays.
    """
    return keep_least_ids(docs, simhash_components(docs, doc_id, text, **settings), doc_id, text)


def keep_least_ids(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is the least ``component_id`` that ``found(doc_id, component_id)`` gives it; one row for an id, and all rows without one."""
    ids = save(found.groupBy(F.col("doc_id").alias("_id")).agg(F.min("component_id").alias("_least"), F.count(F.lit(1)).alias("_n")), "kept-ids")
    keyed = boxed(docs, _id=F.col(doc_id).cast("long"), _text=F.col(text))
    named = keyed.filter("_id is not null")
    kept = sized_join(named, ids.filter("_id <> _least").select("_id"), ["_id"], "left_anti", staged=True)
    repeated = save(ids.filter("_id = _least and _n > 1").select("_id"), "repeated-ids")
    if not repeated.isEmpty():
        first = Window.partitionBy("_id").orderBy("_text")
        several = sized_join(kept, repeated, ["_id"], "left_semi", staged=True).withColumn("_first", F.row_number().over(first)).filter("_first = 1").drop("_first")
        kept = sized_join(kept, repeated, ["_id"], "left_anti", staged=True).unionByName(several)
    return kept.unionByName(keyed.filter("_id is null")).select("row.*")
