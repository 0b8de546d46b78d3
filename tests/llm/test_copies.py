from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from traitframe.llm import common, similar, simhash, spaced_seeds, suffix_levels
from traitframe.llm.common import connected_components


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def components(codes):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    root = np.arange(len(codes))
    while True:
        least = np.array([root[x].min() for x in near])
        if (least == root).all():
            return root
        root = least


def test_fingerprints_and_components(edge, edge_rows):
    rows = simhash.simhash_components(edge).collect()
    codes = np.array([fingerprint(r[1]) for r in edge_rows], np.uint64)
    root = components(codes)
    least = {c: min((r[0] for r, x in zip(edge_rows, root, strict=True) if x == c and r[0] is not None), default=None) for c in set(root)}
    want = Counter((r[0], int(c.view(np.int64)), least[x]) for r, c, x in zip(edge_rows, codes, root, strict=True))
    assert Counter(map(tuple, rows)) == want


def test_keep_one_per_group(edge, edge_rows, nothing):
    found = {(r.doc_id, r.component_id) for r in simhash.simhash_components(edge).collect()}
    kept = simhash.keep_one_per_group(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    named = Counter(i for i in ids if i is not None)
    assert set(named.values()) == {1} and ids.count(None) == sum(r[0] is None for r in edge_rows)
    assert set(named) == {c for i, c in found if i is not None and c == i}
    assert simhash.keep_one_per_group(nothing).count() == 0


def _codes():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64) for _ in range(12)]
    chain = [seeds]
    for a, b in zip(flips[::2], flips[1::2], strict=True):
        chain.append(chain[-1] ^ a ^ b)
    return np.unique(np.concatenate(chain))


def test_gray_index_finds_all_pairs():
    codes = _codes()
    q, found = simhash.GrayIndex(codes).within(codes, 2)
    far = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert set(zip(q.tolist(), found.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(far <= 2)), strict=True))
    assert (simhash.linked_roots(codes) == components(codes)).all()
    ranks = simhash.gray_rank(codes)
    assert (ranks ^ (ranks >> np.uint64(1)) == codes).all()


@pytest.mark.parametrize("hot_node", [4096, 3])
def test_links_connect_what_brute_force_connects(spark, hot_node):
    codes = _codes()
    df = spark.createDataFrame([(int(c.view(np.int64)),) for c in codes], "fp long")
    root = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df, 2, hot_node)).collect()}
    got = [root.get(int(c.view(np.int64)), int(c.view(np.int64))) for c in codes]
    want = components(codes)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_end_when_all_are_stars(spark, monkeypatch):
    made, save = [], common.save
    monkeypatch.setattr(common, "save", lambda df, name: made.append(name) or save(df, name))
    stars = spark.createDataFrame([(i, i % 2) for i in range(2, 40)] + [(5, 1), (1, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(stars).collect()}
    assert got == {i: i % 2 for i in range(40)} and made == ["edges"]
    path = spark.createDataFrame([(3, 2), (2, 1), (3, 1), (9, 8), (9, 7)], "a long, b long")
    assert {r.node: r.root for r in connected_components(path).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


def removed(rows, span=50):
    seen, out = {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - span + 1):
            w = raw[i : i + span]
            seen[w] = min(seen.get(w, doc), doc)
    result = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - span + 1) if doc is not None else ():
            if seen[raw[i : i + span]] < doc:
                gone[i : i + span] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(raw) else 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        result[doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return result


def test_long_repeats_equal_brute_force(edge, edge_rows, nothing):
    rows = [(r[0], r[1]) for r in edge_rows]
    assert Counter(map(tuple, suffix_levels.remove_repeats(edge).collect())) == removed(rows)
    kept = suffix_levels.remove_repeats(edge, keep_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept) and len(kept) == len(rows)
    assert suffix_levels.remove_repeats(nothing).count() == 0


def test_levels_double_and_find_what_came_before():
    rng, family, seen = np.random.default_rng(2), suffix_levels.SuffixLevels(), set()
    for _ in range(40):
        keys = np.unique(rng.integers(0, 900, rng.integers(1, 60)).astype(np.uint64))
        run = (keys // np.uint64(20), keys % np.uint64(20))
        high, low = family.scan(run)
        assert set((high * np.uint64(20) + low).tolist()) == seen & set(keys.tolist())
        family.add(run)
        seen |= set(keys.tolist())
    sizes = [len(h) for h, _ in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_every_string_has_an_anchor():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 500).astype(np.uint8)
    starts = np.array([0, 0, 30, 79, 300, 500])
    anchor, place, count, text = suffix_levels.anchors(data, starts)
    strings = {s for p, n in zip(place, count, strict=True) for s in range(p, p + n)}
    assert strings == {s for a, b in zip(starts[:-1], starts[1:], strict=True) for s in range(a, b - 49)}
    assert ((anchor >= place + count - 1) & (anchor + 16 <= place + 50)).all()


def overlaps(docs, items):
    out = set()
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        for item, passage in items:
            want = (passage or "").encode().lower().split()
            w = min(12, len(want))
            if len(want) < 5 or doc is None or item is None:
                continue
            for shift in range(w - len(want), len(words) - w + 1):
                same = [0 <= i + shift < len(words) and words[i + shift] == x for i, x in enumerate(want)]
                inside = [0 <= i + shift < len(words) for i in range(len(want))]
                if any(all(inside[i : i + w]) and sum(same[i : i + w]) >= 0.8 * w - 1e-9 for i in range(len(want) - w + 1)):
                    out.add((doc, item))
                    break
    return out


def test_benchmark_overlaps_equal_brute_force(spark, edge, edge_rows, nothing):
    words = edge_rows[12][1].split() + edge_rows[13][1].split()
    swapped = [("zzz" if i in (3, 9) else x) for i, x in enumerate(words[:14])]
    items = [(1, " ".join(words[:13])), (2, " ".join(swapped)), (3, " ".join(words[5:11])), (4, "one"), (5, None), (None, "a b c d e f"), (6, "nothing like any of these words at all in here ever"), (7, "LOREM ipsum dolor sit amet")]
    docs = [(r[0], r[1]) for r in edge_rows]
    extra = [(7000, "pad pad " + " ".join(words[:14]) + " pad")]
    table = edge.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = spaced_seeds.benchmark_overlaps(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = overlaps(docs + extra, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and {i for _, i in want} >= {1, 2, 3, 7}
    kept = spaced_seeds.without_benchmark(edge, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in edge_rows if r[0] not in {d for d, _ in want})
    assert spaced_seeds.benchmark_overlaps(nothing, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert spaced_seeds.benchmark_overlaps(edge, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_two_substitutions_in_twelve_words_leave_a_seed():
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in spaced_seeds.MASKS]
    for a in range(12):
        for b in range(a):
            assert any({a, b}.isdisjoint(x + at for x in m) for m in masks for at in range(12 - m[-1]))


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar_groups(rows):
    """Least id that links of Jaccard similarity 0.8 or more reach, over all pairs."""
    rows = [(i, shingle_set(t)) for i, t in rows if i is not None]
    least = [i for i, _ in rows]
    near = [[j for j, (_, y) in enumerate(rows) if x == y or len(x & y) >= 0.8 * len(x | y) > 0] for _, x in rows]
    while (after := [min(least[j] for j in n) for n in near]) != least:
        least = after
    return Counter(zip((i for i, _ in rows), least, strict=True))


def test_edited_copies_equal_brute_force(spark, edge, edge_rows, nothing):
    rng = np.random.default_rng(4)
    rows, words = [(r[0], r[1]) for r in edge_rows], [f"w{i}" for i in range(3000)]
    for family in range(12):
        base = rng.choice(words, int(rng.integers(60, 400))).tolist()
        for copy in range(8):
            text = list(base)
            for at in rng.choice(len(base), int(rng.integers(0, 2 + len(base) // 30)), replace=False):
                text[at] = f"new{family}_{copy}_{at}"
            rows.append((10_000 + 100 * family + copy, " ".join(text)))
    for step in range(30):  # a chain: each is near the next only
        rows.append((20_000 + step, " ".join(f"chain{i}" for i in range(5 * step, 5 * step + 100))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.component_id) for r in similar.similar_components(docs).collect())
    want = similar_groups(rows)
    assert got == want and len({c for _, c in want}) < len(want) - 60
    linked = {r.doc_id for r in simhash.keep_one_per_group(docs).collect()}
    kept = {r.doc_id for r in similar.keep_one_per_similar_group(docs).collect()}
    assert kept - {None} == {i for i, c in want if i == c} and len(kept) < len(linked)
    assert similar.keep_one_per_similar_group(edge).columns == edge.columns
    assert similar.keep_one_per_similar_group(nothing).count() == 0


def dense_group(rng, copies, centres=2, n=120):
    """Texts around centres that share half of their words, each with as many changed words as leaves some pairs above and some below 0.8."""
    common = [f"c{i}" for i in range(n // 2)]
    rows = []
    for centre in range(centres):
        base = common + [f"b{centre}_{i}" for i in range(n - n // 2)]
        for copy in range(copies):
            text = list(base)
            for at in rng.choice(n, int(rng.integers(1, 5)), replace=False):
                text[at] = f"e{rng.integers(0, 40)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def matrix_groups(rows):
    """As :func:`similar_groups`, from a matrix of shared shingles."""
    sets = [shingle_set(t) for _, t in rows]
    number = {s: i for i, s in enumerate(set().union(*sets))}
    has = np.zeros((len(rows), len(number)), np.float32)
    for i, x in enumerate(sets):
        has[i, [number[s] for s in x]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-4
    least, ids = np.arange(len(rows)), np.array([i for i, _ in rows])
    while ((after := np.where(near, least[None, :], len(rows)).min(axis=1)) != least).any():
        least = after
    return {int(i): int(ids[k]) for i, k in zip(ids, least, strict=True)}, int(near.sum())


def test_dense_group_makes_rows_by_members_not_pairs(spark, monkeypatch):
    rows = dense_group(np.random.default_rng(8), 400)
    want, pairs = matrix_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, save = {}, similar.save
    monkeypatch.setattr(similar, "save", lambda df, name: made.setdefault(name, save(df, name)))
    monkeypatch.setattr(similar, "drop_saved", lambda *tables: None)
    settings = [{"CELL_TEXTS": 64}, {"GROUP_TEXTS": 10, "CELL_TEXTS": 64}]  # cells of a group, cells of bands
    for values in settings:
        made.clear()
        with monkeypatch.context() as patch:
            for name, value in values.items():
                patch.setattr(similar, name, value)
            got = {r.doc_id: r.component_id for r in similar.similar_components(docs).collect()}
        assert got == want and 1 < len(set(want.values())) < len(want) / 2
        assert max(df.count() for name, df in made.items() if name != "cells") <= similar.BANDS * len(rows) < pairs
    assert made["cells"].count() > 0


def test_links_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """One link a member and some for the group, not one for each block a member shares with others."""
    rng, links, components = np.random.default_rng(13), [], similar.connected_components
    monkeypatch.setattr(similar, "connected_components", lambda edges: links.append(edges.filter("a <> b").distinct().count()) or components(edges))
    words = [f"w{i}" for i in range(300)]
    for n in (300, 600):
        rows = []
        for i in range(n):
            text = list(words)
            for at in rng.integers(0, len(words), 3):
                text[at] = f"x{rng.integers(1 << 30)}"
            rows.append((i, " ".join(text)))
        links.clear()
        got = {r.doc_id: r.component_id for r in similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert got == matrix_groups(rows)[0]
        assert n - 1 <= links[0] <= 6 * n


def test_class_links_equal_all_pairs():
    rows = dense_group(np.random.default_rng(9), 60)
    sets = [np.sort(np.array([abs(hash(s)) for s in shingle_set(t)], np.uint64)) for _, t in rows]
    prints = np.concatenate([similar.set_fingerprints(similar.mix(x), np.array([len(x)])) for x in sets])
    names = np.arange(len(rows))
    a, b = similar.class_links(names, names, prints, np.ones(len(rows), bool), sets, 0.8)
    root = names.copy()
    for x, y in zip(a, b, strict=True):
        root[root == max(root[x], root[y])] = min(root[x], root[y])
    want, _ = matrix_groups(rows)
    assert root.tolist() == list(want.values()) and len(a) == len(rows) - len(set(want.values()))
    nobody = similar.class_links(names, names, prints, np.zeros(len(rows), bool), sets, 0.8)
    assert len(nobody[0]) == 0


def pairs_at_the_limit(rng, n_pairs, n=180):
    """Shingle hashes of pairs of sets whose similarity is 0.8 to 0.82, end to end, and how many each has."""
    sets = []
    for _ in range(n_pairs):
        own = rng.integers(0, 1 << 64, n + 20, dtype=np.uint64)
        sets += [np.sort(own[:n]), np.sort(own[20:])]
    return np.concatenate(sets), np.full(2 * n_pairs, n)


def test_blocks_of_fingerprints_meet_pairs_at_the_limit():
    hashes, counts = pairs_at_the_limit(np.random.default_rng(11), 1000)
    prints = similar.seeded_fingerprints(hashes, counts)
    assert prints[:, 0].tolist() == similar.set_fingerprints(hashes, counts).tolist()
    keys, found, others = similar.block_keys(prints), set(), 0
    assert keys.shape == (2000, similar.BLOCKS) and len(np.unique(keys >> 16)) == similar.BLOCKS
    for block in range(similar.BLOCKS):
        order = np.argsort(keys[:, block], kind="stable")
        root = similar.near_members(keys[order, block], counts[order], prints[order, 0], prints[order, 1], 0.8)
        links = {(int(order[r]), int(order[i])) for i, r in enumerate(root) if r != i}
        found |= {a // 2 for a, b in links if a // 2 == b // 2}
        others += sum(a // 2 != b // 2 for a, b in links)
    assert len(found) >= 990 and others < 20


@pytest.mark.parametrize("scanned", [32, 4])
def test_members_of_blocks_equal_brute_force(monkeypatch, scanned):
    monkeypatch.setattr(similar, "SCANNED", scanned)
    rng = np.random.default_rng(12)
    centres = rng.integers(0, 1 << 64, (12, 2), dtype=np.uint64)
    codes = centres[rng.integers(0, 12, 600)]
    for _ in range(9):
        codes ^= np.uint64(1) << rng.integers(0, 64, codes.shape).astype(np.uint64)
    keys, sizes = np.sort(rng.integers(0, 14, 600).astype(np.int32)), rng.integers(50, 80, 600).astype(np.int32)
    bits = [np.bitwise_count(codes[:, None, c] ^ codes[None, :, c]).astype(int) for c in (0, 1)]
    near = (keys[:, None] == keys) & (bits[0] <= similar.MAX_BITS) & (bits[0] + bits[1] <= similar.MAX_BITS_OF_TWO)
    near &= (sizes[:, None] >= 0.8 * sizes - 1e-9) & (sizes >= 0.8 * sizes[:, None] - 1e-9)
    want = np.arange(600)
    while ((after := np.where(near, want[None, :], 600).min(axis=1)) != want).any():
        want = after
    got = similar.near_members(keys, sizes, codes[:, 0].copy().view(np.int64), codes[:, 1].copy().view(np.int64), 0.8)
    assert got.tolist() == want.tolist() and 14 < len(np.unique(want)) < 400
    columns = [keys, np.arange(600), sizes, *(codes[:, c].copy().view(np.int64) for c in (0, 1))]
    for step, hot in ((600, 4096), (7, 4096), (25, 20), (600, 0)):
        monkeypatch.setattr(similar, "HOT_BLOCK", hot)
        batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + step]) for c in columns], ["block", "name", "n", "fp", "fp2"]) for at in range(0, 600, step)]
        rows = [r for b in similar._block_links(0.8)(iter(batches)) for r in b.to_pylist()]
        groups = {}
        for r in rows:
            groups.setdefault(r["least"], set()).add(r["name"])
        whole = {frozenset(np.flatnonzero(keys == k).tolist()) for k in range(14)}
        several = {frozenset(np.flatnonzero(want == r).tolist()) for r in range(600)} - {frozenset()}
        assert {frozenset(g) for g in groups.values()} == (whole if hot < 4096 else {g for g in several if len(g) > 1})


def test_set_fingerprints_take_the_majority_of_each_bit():
    sets = [np.array([0b0110, 0b0101, 0b1100], np.uint64), np.zeros(0, np.uint64), np.array([1, 2], np.uint64), np.array([1 << 63], np.uint64)]
    got = similar.set_fingerprints(np.concatenate(sets), np.array([len(x) for x in sets]))
    assert got.tolist() == [0b0100, 0, 0, -(1 << 63)]
    rng = np.random.default_rng(10)
    sets = [rng.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1) for n in (254, 255, 256, 0, 1, 2000, 510)]
    got = similar.set_fingerprints(np.concatenate(sets), np.array([len(x) for x in sets]))
    want = [sum((2 * int(((x >> np.uint64(b)) & np.uint64(1)).sum()) > len(x)) << b for b in range(64)) for x in sets]
    assert got.view(np.uint64).tolist() == want


def test_lower_similarity_is_refused(spark, edge):
    with pytest.raises(ValueError, match="from 0.8"):
        similar.similar_components(edge, similarity=0.5)


def test_pipeline_drops_edited_copies(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(200)]
    edited = [*words[:50], "x", *words[51:150], "y", *words[151:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert abs(len(shingle_set(" ".join(words)) & shingle_set(" ".join(edited))) / 206 - 0.9) < 0.01
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()) == [1, 3]


@pytest.mark.parametrize("n", range(5, 12))
def test_substitutions_in_short_items_leave_a_seed(n):
    differ = n - int(np.ceil(0.8 * n - 1e-9))
    masks = spaced_seeds.short_masks(n)
    assert differ == (1 if n < 10 else 2) and min(map(len, masks)) >= 4
    for gone in itertools.combinations(range(n), differ):
        assert any(not set(gone) & set(m) for m in masks)


def test_short_items_with_substituted_words_equal_brute_force(spark):
    rng, words = np.random.default_rng(6), [f"w{i}" for i in range(400)]
    items, docs = [], []
    for n in range(5, 13):
        item = rng.choice(words, n, replace=False).tolist()
        items.append((n, " ".join(item)))
        for differ in range(4):
            for gone in itertools.combinations(range(n), differ):
                text = ["zz" if i in gone else w for i, w in enumerate(item)]
                pad = rng.choice(words, int(rng.integers(0, 5))).tolist()
                docs.append((len(docs), " ".join([*pad, *text, *pad[1:]]).upper()))
    got = spaced_seeds.benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = overlaps(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and {i for _, i in want} == set(range(5, 13))
