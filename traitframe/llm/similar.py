"""Near copies by the exact similarity of word shingles: SimHash fingerprints of several seeds, dealt out by their blocks, in Gray-order indexes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import connected_components, drop_saved, map_arrow, save
from traitframe.llm.simhash import GrayIndex, keep_least_ids
from traitframe.llm.spaced_seeds import seed_hashes
from traitframe.llm.words import Texts, mix, text_chunks, words_of
from traitframe.operators.joins import shuffled, sized_join

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# A band is the fingerprint of one seed, cut into four blocks. A bit of two texts of similarity 0.8 is equal with
# a chance of 0.8485, so a block of 16 bits is with 0.072, and one block or more of all bands but for 1 pair in 1,300
BANDS, BLOCK_BITS = 24, 16
BLOCKS = BANDS * 64 // BLOCK_BITS
# At similarity 0.8 two fingerprints differ in 9.7 of 64 bits, with a deviation of 2.9, and in 19.4 of 128, with one of 4.1
MAX_BITS, MAX_BITS_OF_TWO = 24, 36
# Fixed value: so many of the links of a member by its blocks are compared before classes that are still apart are searched
FIRST_LINKS = 4
# Members of more than HOT_BLOCK that share a block are not searched by one task; for SCANNED or fewer an index would have few upper nodes
HOT_BLOCK, SCANNED = 4096, 32
GROUP_TEXTS, GROUP_SHINGLES = 8192, 1 << 23
CELL_TEXTS, CELL_SHINGLES = 1024, 1 << 18
_QUERIES_AT_ONCE = 64
_BYTE_ONES = np.uint64(0x0101010101010101)
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS), dtype=np.uint64)
_FLIP, _ODD = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def shingle_sets(texts: Texts, shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, end to end, and how many each text has.

    A text of fewer words is one shingle; one without words has none.
    """
    found = words_of(texts)
    first = np.concatenate(([0], np.cumsum(found.counts)))
    parts = []
    for n in range(1, shingle_words + 1):
        if n < shingle_words and not (found.counts == n).any():
            continue
        hashes, place = seed_hashes(found.hash, found.counts, n, list(range(n)))
        text = np.searchsorted(first, place, "right") - 1
        own = found.counts[text] == n if n < shingle_words else np.ones(len(text), bool)
        parts.append((text[own], hashes[own]))
    text, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[fresh], np.bincount(text[fresh], minlength=len(texts.rows))


def _set_names(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each whole set; the empty set has zero."""
    full = np.flatnonzero(counts)
    names = np.zeros(len(counts), np.uint64)
    if len(full):
        names[full] = mix(np.add.reduceat(mix(hashes), (np.cumsum(counts) - counts)[full]) + counts[full].astype(np.uint64))
    return names.view(np.int64)


def set_fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each set of shingle hashes as a signed long: a bit is set if more than half of them have it."""
    full, prints = np.flatnonzero(counts), np.zeros(len(counts), np.int64)
    if len(full):
        # bits eight apart are counted in the eight bytes of one number, over stretches of at most 255 hashes
        stretches = -(-counts[full] // 255)
        first = np.cumsum(stretches) - stretches
        starts = np.repeat((np.cumsum(counts) - counts)[full] - 255 * first, stretches) + 255 * np.arange(int(stretches.sum()))
        ones = np.empty((len(full), 64), np.int32)
        for bit in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(bit)) & _BYTE_ONES, starts).astype("<u8")
            ones[:, bit::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int32), first, axis=0)
        prints[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view("<i8").ravel()
    return prints


def seeded_fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``BANDS`` SimHash fingerprints of each set; the first is that of the hashes as they are."""
    others = [set_fingerprints(mix((hashes ^ _FLIP[i]) * _ODD[i]), counts) for i in range(1, BANDS)]
    return np.column_stack([set_fingerprints(hashes, counts), *others])


def block_keys(prints: np.ndarray) -> np.ndarray:
    """For each row of fingerprints its ``BLOCKS`` blocks, each with its number above its bits."""
    blocks = np.ascontiguousarray(prints, "<i8").view("<u2").astype(np.int32)
    return blocks | np.arange(BLOCKS, dtype=np.int32) << BLOCK_BITS


def _prints(shingle_words: int):
    """Rows ``(doc_id, text)`` to ``(doc_id, name, n, fp, fp2, blocks)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                hashes, counts = shingle_sets(chunk, shingle_words)
                prints = seeded_fingerprints(hashes, counts)
                blocks = pa.ListArray.from_arrays(pa.array(np.arange(0, BLOCKS * len(counts) + 1, BLOCKS, dtype=np.int32)), pa.array(block_keys(prints).ravel()))
                ids = batch.column(0).slice(int(chunk.rows[0]), len(chunk.rows))
                columns = [ids, pa.array(_set_names(hashes, counts)), pa.array(counts.astype(np.int32)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), blocks]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "n", "fp", "fp2", "blocks"])

    return run


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``root`` that links (a, b) connect, in place; every node then points at its least."""
    while True:
        one, other = root[a], root[b]
        apart = one != other
        if not apart.any():
            return
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while ((up := root[root]) != root).any():
            root[:] = up


def near_members(keys: np.ndarray, sizes: np.ndarray, prints: np.ndarray, second: np.ndarray, similarity: float) -> np.ndarray:
    """For rows in the order of ``keys``, the first row of the same key that links of near fingerprints and like sizes reach.

    Small groups are compared in full, all at once; a larger one stands in a :class:`GrayIndex`.
    """
    root, prints, second = np.arange(len(keys)), prints.view(np.uint64), second.view(np.uint64)
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1, append=keys[-1:] + 1))
    members = np.diff(cuts)

    def join(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> None:
        near = (bits <= MAX_BITS) & (bits + np.bitwise_count(second[a] ^ second[b]) <= MAX_BITS_OF_TWO)
        near &= (sizes[a] >= similarity * sizes[b] - 1e-9) & (sizes[b] >= similarity * sizes[a] - 1e-9)
        _union(root, a[near], b[near])

    left = np.repeat(np.where(members <= SCANNED, cuts[1:], cuts[:-1]), members)  # the end of a small group
    a = np.arange(len(keys))
    for step in range(1, SCANNED):
        a = a[a + step < left[a]]
        if not len(a):
            break
        join(a, a + step, np.bitwise_count(prints[a] ^ prints[a + step]))
    for group in np.flatnonzero(members > SCANNED):
        first, last = int(cuts[group]), int(cuts[group + 1])
        index = GrayIndex(prints[first:last])
        for at in range(first, last, _QUERIES_AT_ONCE):
            number, other = index.within(prints[at : min(at + _QUERIES_AT_ONCE, last)], MAX_BITS)
            a, b = number + at, other + first
            a, b = a[a < b], b[a < b]
            join(a, b, np.bitwise_count(prints[a] ^ prints[b]))
    return root


def _block_links(similarity: float):
    """Rows ``(block, name, n, fp, fp2)`` in the order of blocks to ``(name, least)``: members that share a block and may be near copies.

    ``least`` names one member for all that near fingerprints connect. More than ``HOT_BLOCK`` members of a block pass as they are, in a stream, and count as connected.
    """

    def told(names: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(least)], ["name", "least"])

    def groups(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(rows[0]):
            root = near_members(rows[0], rows[2], rows[3], rows[4], similarity)
            several = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
            yield told(rows[1][several], rows[1][root[several]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = [np.zeros(0, t) for t in (np.int32, np.int64, np.int32, np.int64, np.int64)], (-1, 0)
        for batch in batches:
            rows = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns, strict=True)]
            ends = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), len(rows[0])]
            crowds = [(a, b) for a, b in pairwise(ends) if b - a > HOT_BLOCK or (b > a and rows[0][a] == hot[0])]
            at, last = 0, ends[-2]
            for a, b in crowds:
                yield from groups([c[at:a] for c in rows])
                if rows[0][a] != hot[0]:
                    hot = int(rows[0][a]), int(rows[1][a])
                yield told(rows[1][a:b], np.full(b - a, hot[1]))
                at = b
            if at <= last:
                yield from groups([c[at:last] for c in rows])
                at = last
            held = [c[at:] for c in rows]
        yield from groups(held)

    return run


def _shingles(shingle_words: int):
    """Rows ``(text, name)`` to ``(name, shingles)``; other texts of a document's id than the one asked for are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1).to_numpy()
            for chunk in text_chunks(batch.column(0)):
                hashes, counts = shingle_sets(chunk, shingle_words)
                names, cuts = _set_names(hashes, counts), np.concatenate(([0], np.cumsum(counts)))
                own = np.flatnonzero(names == asked[chunk.rows])
                blobs = [hashes[cuts[i] : cuts[i + 1]].tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(blobs, pa.binary())], ["name", "shingles"])

    return run


def _compare(similarity: float):
    """Rows ``(a, b, of_a, of_b)`` to ``(a, b, near)``."""

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return both >= similarity * (len(x) + len(y) - both) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [near(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["a", "b", "near"])

    return run


def class_links(names: np.ndarray, roots: np.ndarray, prints: np.ndarray, asked: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the classes ``roots`` of some texts wherever a text that is ``asked`` has a similar one in another class.

    The texts' fingerprints stand in a :class:`GrayIndex`, which prunes groups of them
    that differ from the asked one in too many bits. One link joins two
    classes, and texts of joined classes are not compared again.
    """
    label = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(ids), bool)
    index, codes, queries, links = GrayIndex(prints.view(np.uint64)), prints.view(np.uint64), np.flatnonzero(asked), []
    for at in range(0, len(queries), _QUERIES_AT_ONCE):
        part = queries[at : at + _QUERIES_AT_ONCE]
        number, other = index.within(codes[part], MAX_BITS)
        one = part[number]
        open_ = (label[one] != label[other]) & (sizes[one] >= similarity * sizes[other] - 1e-9) & (sizes[other] >= similarity * sizes[one] - 1e-9)
        one, other = one[open_], other[open_]
        order = np.argsort(one, kind="stable")
        one, other = one[order], other[order]
        cuts = np.flatnonzero(np.diff(one, prepend=-1, append=-1))
        for a, b in pairwise(cuts):
            q, near = int(one[a]), other[a:b]
            near = near[label[near] != label[q]]
            if not len(near):
                continue
            own = ids[starts[q] : starts[q] + sizes[q]]
            marked[own] = True
            if len(near) * 4 > len(sets):
                both = np.add.reduceat(marked[ids], starts, dtype=np.int32)[near]
            else:
                both = np.array([np.count_nonzero(marked[ids[starts[m] : starts[m] + sizes[m]]]) for m in near])
            marked[own] = False
            for m in near[both >= similarity * (sizes[q] + sizes[near] - both) - 1e-9]:
                if label[m] != label[q]:
                    links.append((q, m))
                    label[label == label[m]] = label[q]
    found = np.array(links, np.int64).reshape(-1, 2)
    return names[found[:, 0]], names[found[:, 1]]


def _cell_links(similarity: float):
    """Rows ``(cell, name, root, fp, asked, shingles)`` in the order of cells to links ``(a, b)`` of different classes."""

    def links(pieces: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(pieces)
        names, roots, prints, asked = (rows.column(i).to_numpy() for i in range(1, 5))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(5)]
        return class_links(names, roots, prints, asked, sets, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell, found = batch.column(0).to_numpy(), []
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]):
                if held and b > a and held[0].column(0)[0].as_py() != cell[a]:
                    found.append(links(held))
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(held)], ["a", "b"])

    return run


def _cells(apart: DataFrame) -> DataFrame:
    """``(cell, name, root, fp, asked)`` from members ``(key, name, n, fp, root, most)`` of units in which several classes meet.

    Units that share classes are a group, dealt as one if it is of moderate size, so that a text is in it
    once; larger groups are dealt by key. What is dealt is cut into cells
    of bounded size: texts outside the group's largest class ask, in blocks; all
    texts answer, in blocks; each pair of blocks is a cell.
    """
    classes = connected_components(apart.filter("root <> most").select(F.col("root").alias("a"), F.col("most").alias("b")).distinct())
    inside = sized_join(apart, classes.select(F.col("node").alias("root"), F.col("root").alias("unit")), ["root"], salt_by=["name"])
    texts = save(inside.groupBy("unit", "name").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("fp").alias("fp")), "group-texts")
    sizes = texts.groupBy("unit").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    small = save(sizes.select("unit", ((F.col("texts") <= GROUP_TEXTS) & (F.col("shingles") <= GROUP_SHINGLES)).alias("small")), "group-sizes")
    by_group = sized_join(texts, small.filter("small"), ["unit"], salt_by=["name"], staged=True).drop("small")
    by_band = sized_join(inside, small.filter("not small"), ["unit"], salt_by=["name"], staged=True).select(F.xxhash64("unit", "key").alias("unit"), "name", "root", "n", "fp")
    dealt = by_group.unionByName(by_band)
    largest = dealt.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    total = (F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles"))
    largest = largest.groupBy("unit").agg(F.max_by(F.struct("root", "texts", "shingles"), F.struct("texts", "root")).alias("most"), *total)

    def blocks(texts, shingles):
        return F.greatest(F.ceil(texts / CELL_TEXTS), F.ceil(shingles / CELL_SHINGLES), F.lit(1)).cast("int")

    asking = blocks(F.col("texts") - F.col("most.texts"), F.col("shingles") - F.col("most.shingles"))
    largest = save(largest.select("unit", F.col("most.root").alias("most"), asking.alias("asking"), blocks(F.col("texts"), F.col("shingles")).alias("answering")), "cell-blocks")
    placed = sized_join(dealt, largest, ["unit"], salt_by=["name"], staged=True).withColumn("hash", F.xxhash64("name"))

    def in_cells(rows: DataFrame, own, other, other_count: str, asked: bool) -> DataFrame:
        rows = rows.select("unit", "name", "root", "fp", own, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)).alias(other))
        return rows.select(F.xxhash64("unit", "i", "j").alias("cell"), "name", "root", "fp", F.lit(asked).alias("asked"))

    answers = in_cells(placed, F.pmod("hash", F.col("answering")).cast("int").alias("j"), "i", "asking", False)
    asks = in_cells(placed.filter("root <> most"), F.pmod("hash", F.col("asking")).cast("int").alias("i"), "j", "answering", True)
    return save(answers.union(asks), "cells")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, component_id)``: one row per document with an id, with the smallest doc_id that links of similar texts reach.

    Texts are linked if their sets of shingles, ``shingle_words`` words with A-Z as a-z, have the given
    Jaccard similarity, 0.8 or more. Candidates come from SimHash fingerprints of the sets, of ``BANDS`` seeds: they share a
    block of one of them, by which they are dealt out, so of pairs at 0.8 about 1 in 1,300 is not met (of sets of few shingles more),
    above it fewer, and a Gray-order index finds those that differ in ``MAX_BITS`` bits or fewer in the first fingerprint and
    ``MAX_BITS_OF_TWO`` in the first two (four deviations beyond the mean at 0.8). What is met is compared in full.
    Null, empty and wordless texts are one group; texts of fewer words than a shingle are one shingle.

    Equal sets are one member whatever their number. Members that near fingerprints connect are a unit, compared with its first and a few they
    were linked to. Classes still apart in a unit are then searched in cells of bounded
    size through Gray-order indexes: one link joins two classes, and no
    pair of members becomes a row, so rows grow with the members of a unit.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"similarity must be from {SIMILARITY} to 1: bands and fingerprints are laid out for that")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    prints = save(map_arrow(rows, _prints(shingle_words), "doc_id long, name long, n int, fp long, fp2 long, blocks array<int>"), "shingle-prints")
    groups = prints.groupBy("name").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.first("blocks").alias("blocks"))
    groups = save(groups, "shingle-sets")
    # a set of n shingles is like another one only if n of n + 1 are enough
    blocks = groups.filter(F.col("n") >= similarity * (F.col("n") + 1) - 1e-9).select(F.explode("blocks").alias("block"), "name", "n", "fp", "fp2")
    dealt = blocks.repartition("block").sortWithinPartitions("block")
    # a member names one other for each block at most, whatever the group
    met = map_arrow(dealt, _block_links(similarity), "name long, least long").groupBy("name").agg(F.collect_set("least").alias("least"))
    met = save(met, "block-links")
    # a member and all it was linked to join the least of them: the same units, and in a large group the others are few, so links grow with members, not with their blocks
    units = connected_components(met.select(F.explode(F.array_union("least", F.array("name"))).alias("a"), F.least(F.array_min("least"), "name").alias("b")))
    units = save(units.toDF("name", "key").join(shuffled(groups), "name").select("key", "name", "n", "fp"), "unit-members")
    firsts = units.groupBy("key").agg(F.min(F.struct("name", "n", "fp")).alias("first"))
    members = save(sized_join(units, firsts, ["key"], salt_by=["name"]), "first-members")
    wanted = save(members.select("name").distinct().join(shuffled(groups), "name").select(F.col("least").alias("doc_id"), "name"), "similar-wanted")
    shingles = map_arrow(sized_join(rows, wanted, ["doc_id"], staged=True).select("text", "name"), _shingles(shingle_words), "name long, shingles binary")
    shingles = save(shingles.dropDuplicates(["name"]), "shingles")

    def alike(x, y):
        return (x >= similarity * y - 1e-9) & (y >= similarity * x - 1e-9)

    few_bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= MAX_BITS
    pairs = members.filter((F.col("name") != F.col("first.name")) & alike(F.col("n"), F.col("first.n")) & few_bits)
    pairs = pairs.select(F.col("first.name").alias("a"), F.col("name").alias("b"))
    some = met.select(F.explode(F.slice("least", 1, FIRST_LINKS)).alias("a"), F.col("name").alias("b")).filter("a <> b")
    pairs = save(pairs.union(some).distinct(), "least-pairs")
    texts = pairs.join(shuffled(shingles.toDF("a", "of_a")), "a").join(shuffled(shingles.toDF("b", "of_b")), "b")
    links = map_arrow(texts.select("a", "b", "of_a", "of_b"), _compare(similarity), "a long, b long, near boolean")
    links = save(links.filter("near").select("a", "b"), "least-links")
    roots = connected_components(links)
    rooted = members.select("key", "name", "n", "fp").join(shuffled(roots.withColumnRenamed("node", "name")), "name", "left")
    rooted = save(rooted.select("key", "name", "n", "fp", F.coalesce("root", "name").alias("root")), "rooted-members")
    mixed = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("count").alias("texts"))
    mixed = save(mixed.filter("roots > 1 and texts > 2").select("key", "most"), "mixed-units")
    apart = save(sized_join(rooted, mixed, ["key"], salt_by=["name"], staged=True), "members-apart")
    if not mixed.isEmpty():
        cells = _cells(apart)
        dealt = cells.join(shuffled(shingles), "name").select("cell", "name", "root", "fp", "asked", "shingles")
        dealt = dealt.repartition("cell").sortWithinPartitions("cell")
        across = save(map_arrow(dealt, _cell_links(similarity), "a long, b long"), "class-links")
        if not across.isEmpty():
            roots = connected_components(links.union(across))
    drop_saved(met, units, members, shingles, rooted, apart)

    linked = roots.withColumnRenamed("node", "name").join(shuffled(groups), "name").select("name", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = sized_join(linked, least, ["root"], salt_by=["name"]).select("name", "component_id")
    same = groups.filter("copies > 1").join(shuffled(linked), "name", "left_anti").select("name", F.col("least").alias("component_id"))
    named = save(linked.union(same), "similar-components")
    out = sized_join(prints.select("doc_id", "name"), named, ["name"], "left", salt_by=["doc_id"], staged=True)
    return out.select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_similar_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Rows of ``docs``, all columns, whose id is the smallest of their group of similar texts: one for each group.

    Rows without an id can't be named as members of a group and stay. Of rows that share a kept id, the one of the least text stays.
    """
    return keep_least_ids(docs, similar_components(docs, doc_id, text, **settings), doc_id, text)
