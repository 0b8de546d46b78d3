"""Whitening against numpy on all rows, with exact integers for the deviations."""

import numpy as np
import pytest

from traitframe.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, i long, x string, w double, dims int"


def brute(rows, components):
    """Rows by (vec_id, component, whitened up to sign) straight from the definitions."""
    usable = [(k, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for k, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in usable]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d))
    usable = [(k, x) for k, x in usable if len(x) == dims]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for k, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(min(components, dims)):
            w = (np.array(x) - np.array(sums) / n) @ vectors[:, c] / np.sqrt(values[c]) if values[c] > 1e-14 * np.trace(v) else None
            out.append((k, c + 1, n, deviation, w, values[c] / np.trace(v) if np.trace(v) else None))
    return out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "x", 0.5, 7) for k, v in rows], SCHEMA).repartition(parts)


def compare(found, want, components):
    assert len(found) == len(want)
    order = lambda r: (str(r[0]), r[1], str(r[3]), abs(round(r[4], 6)) if r[4] is not None else -1.0)
    a, b = sorted(map(tuple, found), key=order), sorted(want, key=order)
    for have, expect in zip(a, b, strict=True):
        assert have[:3] == expect[:3] and int(have[3]) == expect[3]
        assert (have[4] is None) == (expect[4] is None)
        if have[4] is not None:
            assert abs(have[4]) == pytest.approx(abs(expect[4]), abs=1e-8)
        assert (have[5] is None) if expect[5] is None else have[5] == pytest.approx(expect[5], rel=1e-8, abs=1e-15)
    for c in range(1, components + 1):  # one sign for all rows
        signs = {round(h[4] / e[4]) for h, e in zip(a, b, strict=True) if h[1] == c and e[4] is not None and abs(e[4]) > 1e-3}
        assert len(signs) <= 1


def random_rows(rng, n=300, dims=7):
    base = rng.normal(size=(n, dims)) * np.linspace(3, 0.2, dims) + rng.normal(size=dims) * 4
    return [(i, row.astype(np.float32).tolist()) for i, row in enumerate(base)]


def test_whitening_equals_brute_force(spark):
    rows = random_rows(np.random.default_rng(3))
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third are copies
    rows += [(5, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, []), (2002, [None] * 7), (2003, [float("nan")] * 7), (2004, [float("inf")] + [0.0] * 6), (2005, [1.0, 2.0])]
    found = whiten(table(spark, rows), components=4, block_bytes=1 << 10).collect()
    compare(found, brute(rows, 4), 4)
    assert {r["identity_error"] for r in found}.pop() < 1e-9


def test_all_components_and_flat_directions(spark):
    rows = [(i, [*v[:3], 1.0, v[0]]) for i, v in random_rows(np.random.default_rng(4), 80, 3)]
    found = whiten(table(spark, rows)).collect()
    compare(found, brute(rows, 5), 5)
    assert sum(r["whitened"] is None for r in found) == 2 * 80


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(i * 2**40), -float(2**45 + i * i * 2**22), 0.5]) for i in range(50)]
    found = whiten(table(spark, rows), components=1).collect()
    want = {r[0]: r[3] for r in brute(rows, 1)}
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == want
    assert max(want.values()) > 1 << 63


def test_few_rows(spark):
    assert whiten(table(spark, [(1, None)])).collect() == []
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    one = whiten(table(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])]), components=4).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one) == [
        (v, c, 1, 0, None, None, None) for v in (1, 2) for c in (1, 2)
    ]
