from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from traitframe.llm import katz, token_files, toxicity, words
from traitframe.llm.common import crc_mod
from traitframe.session import new_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_words_and_hashes():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\x85 é,") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "z" * 3000]
    seen = {}
    for chunk in words.text_chunks(pa.array(texts), limit=500):
        found = words.words_of(chunk)
        want = [w for i in range(len(chunk.rows)) for w in chunk.text(i).split()]
        got = [chunk.data[a:b].tobytes() for a, b in zip(found.start, found.end, strict=True)]
        assert got == want and found.counts.tolist() == [len(chunk.text(i).split()) for i in range(len(chunk.rows))]
        for w, h in zip(want, found.hash.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_texts_of_a_slice():
    column = pa.array(["aa", None, "bbb", ""]).slice(1, 3)
    chunks = list(words.text_chunks(column))
    assert [c.text(i) for c in chunks for i in range(len(c.rows))] == [b"", b"bbb", b""]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 4001])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    control, data = token_files.encode_block(values)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in values)
    assert (token_files.decode_block(control, data, n) == values).all()


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", "ß", "̸", "<", ">", "|", "<|endoftext|>", "'s", "'", "'ll", ",", ".", " ", "\n", " ", "1", "٣", "日本", "#", "İ", "Σ", "\t", "\x1c", "!", "don't", "re", "😀", "_", "\\", "`", "~"]
    encoder = token_files.TextEncoder(TOKENIZER)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)]
    for chunk in words.text_chunks(pa.array(texts), limit=3000):
        ids, counts = encoder.chunk(chunk)
        want = [encoder.tokenizer.encode(chunk.text(i).decode(), add_special_tokens=False).ids + [1] for i in range(len(chunk.rows))]
        assert ids.tolist() == [x for w in want for x in w] and counts.tolist() == [len(w) for w in want]


def test_kept_pieces_move_few_times(monkeypatch):
    encoder, moved, argsort = token_files.TextEncoder(TOKENIZER), [], np.argsort
    monkeypatch.setattr(token_files.np, "argsort", lambda x, **how: moved.append(len(x)) or argsort(x, **how))
    for at in range(0, 60 * 300, 300):
        text = " ".join(f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(at, at + 300))
        ids, counts = encoder.chunk(next(words.text_chunks(pa.array([text]))))
        assert ids.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1] and counts.tolist() == [len(ids)]
    assert sum(moved) < 60 * 300 * 8


def test_encoder_equals_the_tokenizer_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    encoder, rng = token_files.TextEncoder(TOKENIZER), random.Random(3)
    for _ in range(30):
        texts = [" ".join(f"w{chr(97 + rng.randrange(26))}{rng.choice('xyz')}" for _ in range(rng.randint(0, 12))) for _ in range(5)]
        ids, _ = encoder.chunk(next(words.text_chunks(pa.array(texts))))
        assert ids.tolist() == [x for t in texts for x in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]]


def thue_morse(n):
    """A word of ``n`` letters and its complement: polynomials modulo 2**64 give both one value from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 256, 257, 1024, 4096])
def test_words_that_defeat_polynomial_hashes_are_told_apart(n):
    from tokenizers import Tokenizer

    one, other = thue_morse(n)
    chunk = next(words.text_chunks(pa.array([f"x {one}", other])))
    x, a, b = words.words_of(chunk).hash
    assert len({x, a, b}) == 3
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids, counts = token_files.TextEncoder(TOKENIZER).chunk(chunk)
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in (f"x {one}", other)]
    assert ids.tolist() == want[0] + want[1] and counts.tolist() == [len(w) for w in want]


def test_token_files_round_trip(spark, edge, edge_rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    path = new_path(spark, "tokens")
    token_files.write_token_files(edge, path, TOKENIZER, partition_bytes=20_000)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in edge_rows))
    assert [r.doc_id for r in got] == [d if named else None for named, d, _ in want]
    at, texts = 0, defaultdict(list)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        texts[r.doc_id].append(tuple(np.frombuffer(r.ids, "<u4").tolist()))
    for named, d, _ in want:
        own = [tuple(tokenizer.encode(t, add_special_tokens=False).ids + [1]) for n, x, t in want if (n, x) == (named, d)]
        assert Counter(texts[d if named else None]) == Counter(own)
    ranks = [r.id for r in spark.read.parquet(path + "/ranks").orderBy("rank").collect()]
    count = Counter(i for rows in texts.values() for ids in rows for i in ids)
    assert ranks == sorted(count, key=lambda i: (-count[i], i))
    empty = new_path(spark, "tokens")
    token_files.write_token_files(nothing, empty, TOKENIZER)
    assert token_files.read_token_files(spark, empty).count() == 0


def brute_scores(rows):
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in rows]
    train = [t for d, t in tokens if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    one, two, before = Counter(), Counter(), Counter()
    for t in train:
        for a, b in zip(["<s>", *t], t, strict=False):
            one[b] += 1
            two[a, b] += 1
            before[a] += 1
    total, types = sum(one.values()), len(one)

    def discounts(counter):
        n = Counter(counter.values())
        return katz.Discounts.good_turing(np.array([n[i] for i in range(1, katz.DISCOUNTED + 2)]))

    dw, dp = discounts(one), discounts(two)
    left = {k: float(d(np.array([k]))[0]) for d in (dw,) for k in set(one.values())}
    left2 = {k: float(dp(np.array([k]))[0]) for k in set(two.values())}
    freed = sum(c - left[c] for c in one.values())
    p1 = lambda w: left[one[w]] / total if one[w] else freed / total
    after = defaultdict(list)
    for (a, b), c in two.items():
        after[a].append((b, c))
    weight = {}
    for a, seen in after.items():
        f = sum(c - left2[c] for _, c in seen)
        scale = 1.0 if f > 1e-9 else before[a] / (before[a] + 1)
        weight[a] = (f / before[a] if f > 1e-9 else 1 / (before[a] + 1)) / (1 - sum(p1(w) for w, _ in seen)), scale
    out = []
    for d, t in tokens:
        base = score = 0.0
        for a, b in zip(["<s>", *t], t, strict=False):
            base += math.log10((one[b] + 1) / (total + types + 1))
            score += math.log10(left2[two[a, b]] / before[a] * weight[a][1] if two[a, b] else (weight[a][0] if before[a] else 1) * p1(b))
        out.append((-1 if d is None else d, len(t), sum(one[w] > 0 for w in t), total, round(base, 5), round(score, 5)))
    for a, seen in list(after.items())[:40]:
        rest = 1 - sum(p1(w) for w, _ in seen)
        assert sum(left2[c] / before[a] * weight[a][1] for _, c in seen) + weight[a][0] * rest == pytest.approx(1)
    return Counter(out)


@pytest.mark.parametrize("batch_bytes", [1 << 20, 3000])
def test_katz_scores_equal_brute_force(edge, edge_rows, batch_bytes):
    got = katz.score_texts(edge, crc_mod("id", 7) != 2, batch_bytes=batch_bytes).collect()
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == brute_scores(edge_rows)


def test_katz_without_learning_or_rows(edge, nothing):
    got = katz.score_texts(edge, F.lit(False)).agg(F.sum("n_known"), F.sum("train_tokens"), F.sum("score")).first()
    assert tuple(got) == (0, 0, 0.0)
    assert katz.score_texts(nothing, F.lit(True)).count() == 0


def test_good_turing():
    kept = katz.Discounts.good_turing(np.array([1000, 400, 220, 140, 100, 75])).kept
    assert kept[0] == 1 and (np.diff(kept[1:]) > 0).all() and (kept[1:] < 1).all()
    odd = katz.Discounts.good_turing(np.array([0, 5, 0, 0, 0, 0])).kept
    assert odd[1] == 0.5 and odd[2] == 0.75


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    bad = {"en": ["rotten", "vile"], "de": ["grauslich"]}
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "de"])
        toxic = int(rng.random() < 0.3)
        text = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice(bad[lang]) + rng.choice([",", "", "er", "."]))
        rows.append((i, " ".join(text), lang, "s", toxic))
    docs = spark.createDataFrame([r[:4] for r in rows] + [(None, "plain words", "en", "s"), (5000, None, None, None), (5001, "", "fr", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4], 1) for r in rows] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    return docs, labels, {r[0]: r[4] for r in rows}


def test_toxicity_on_held_out_documents(labelled):
    docs, labels, truth = labelled
    got = toxicity.judge(docs, labels, learn=crc_mod("_id", 5) != 0).collect()
    assert len(got) == len(truth) + 3 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) / len(held)
    assert right > 0.95
    rest = {r.doc_id: r for r in got if r.doc_id not in truth}
    assert not any(r.rejected for r in rest.values())


def test_without_toxic_keeps_columns_and_clean_documents(spark, labelled, nothing):
    docs, labels, truth = labelled
    wide = docs.withColumn("_hash", F.lit("x")).withColumn("score", F.lit(3))
    kept = toxicity.without_toxic(wide, labels)
    assert kept.columns == wide.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(truth[i] for i in ids if i in truth) < 0.1 * sum(truth.values())
    assert sum(1 - truth[i] for i in ids if i in truth) > 0.98 * sum(1 - t for t in truth.values()) and {None, 5000, 5001} <= ids
    none = spark.createDataFrame([], labels.schema)
    assert toxicity.without_toxic(docs, none).count() == docs.count()
    assert toxicity.judge(nothing, labels).count() == 0


def test_scores_do_not_hang_on_batches_or_neighbours():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, toxicity.BUCKETS, (toxicity.ROWS, n)).astype(np.int32) for n in (0, 1, 2, 3, 50, 0)]
    model = toxicity.train(ids * 8, np.array([0, 1, 0, 1, 1, 0] * 8, float))
    tables = toxicity.response_tables(model)
    together = toxicity.logits(model, tables, np.concatenate(ids, axis=1), np.array([x.shape[1] for x in ids]))
    alone = np.concatenate([toxicity.logits(model, tables, x, np.array([x.shape[1]])) for x in ids])
    assert np.allclose(together, alone, atol=1e-5)
