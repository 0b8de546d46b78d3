"""Line dedup against a line by line count."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import SCHEMA, sentence
from traitframe.llm import sql
from traitframe.llm.line_filters import Bloom, dedup_lines

_SPACE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(_SPACE))


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(_key(line)) >= min_chars:
                holders[_key(line)].add(i)
    gone = {k: max((rows[i][0] for i in v if rows[i][0] is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (_key(x) in gone and gone[_key(x)] != doc)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def with_shared_lines(edge_rows):
    rng = random.Random(9)
    shared = [sentence(rng, 12) for _ in range(4)] + ["é" * 40, "Ünï " * 10, "x" * 39, "y" * 40, "thue " * 700]
    rows = [(r[0], r[1]) for r in edge_rows]
    for i in range(60):
        lines = [sentence(rng, rng.randint(0, 14)) for _ in range(rng.randint(0, 5))]
        for _ in range(rng.randint(0, 4)):
            line = rng.choice(shared)
            lines.append(rng.choice([line, line.upper() if line.isascii() else line, f" \t{line}\r", f"{line}\x0b"]))
        rng.shuffle(lines)
        rows.append((1000 + i // 2 * 2 if i % 7 else None, "\n".join(lines)))
    rows += [(5000 + i, "\n" * i + "only held by documents without any number at all" * (i % 2)) for i in range(3)]
    return rows + [(None, "a line that only rows without an id hold, and often too")] * 6


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "w", 2, "r", 3, "i", 0.5) for d, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("settings", [{}, {"filter_bytes": 0, "lines_per_filter": 64}, {"verdict_rows": 0}, {"filter_bytes": 0, "verdict_bytes": 0, "lines_per_filter": 100}])
def test_lines_equal_brute_force(spark, edge_rows, settings):
    rows = with_shared_lines(edge_rows)
    found = dedup_lines(frame(spark, rows), **settings).collect()
    want = brute(rows)
    assert sorted(map(tuple, found), key=str) == want
    assert sum(r[2] for r in want) > 60


def test_other_limits_and_empty_tables(spark, edge_rows, nothing):
    rows = with_shared_lines(edge_rows)
    found = dedup_lines(frame(spark, rows), min_chars=3, min_docs=2).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, 3, 2)
    assert dedup_lines(nothing).collect() == []
    assert [tuple(r) for r in dedup_lines(frame(spark, [(1, None)])).collect()] == [(1, 1, 0, "")]


def test_sql_equals_brute_force(edge_rows):
    rows = with_shared_lines(edge_rows)
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
        found = db.execute(sql.LINE_DEDUP).fetchall()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(0, 1 << 64, 20_000, dtype=np.uint64) for _ in range(2))
    bloom = Bloom.for_keys(len(keys), 16)
    bloom.add(keys)
    assert bloom.has(keys).all()
    assert bloom.has(others).mean() < 0.02
