from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from traitframe.llm import mixing, transcripts


def test_quotas_equal_seats_given_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        votes, most, seats = rng.integers(0, 50, n).astype(float), rng.integers(0, 12, n), int(rng.integers(0, 40))
        won = [0] * n
        for _ in range(seats):
            open_ = [(votes[i] / (2 * won[i] + 1), -i) for i in range(n) if won[i] < most[i] and votes[i] > 0]
            if open_:
                won[-max(open_)[1]] += 1
        assert mixing.sainte_lague(votes, seats, most).tolist() == won


def test_targets_stop_at_their_cap():
    assert mixing.capped_targets([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, 250 / 3, 500 / 3]
    assert mixing.capped_targets([10, 1000, 10], [3, 1, 2], 1530, 2) == [20.0, 1490.0, 20.0]
    assert mixing.capped_targets([0, 10], [3, 1], 15, 2) == [0.0, 15.0]
    assert mixing.capped_targets([], [], 0, 2) == []


def test_mix_keeps_to_targets(spark, edge, edge_rows):
    got = mixing.mix_sources(edge).collect()
    sizes = Counter()
    for r in edge_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.capped_targets([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2), strict=True))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], len((r[1] or "").encode().split())) for r in edge_rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 8
    again = mixing.mix_sources(edge.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mixed_documents_hold_what_the_plan_takes(edge, nothing):
    mix = mixing.mixed_documents(edge, shard_words=2000)
    assert mix.columns == edge.columns
    words = mix.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n"))
    plan = mixing.mix_sources(edge, shard_words=2000).groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0")
    assert Counter(map(tuple, words.collect())) == Counter(map(tuple, plan.collect()))
    assert all(r.n_chars == len(r.text) for r in mix.collect() if r.text) and mixing.mixed_documents(nothing).count() == 0


def test_parts_of_texts():
    assert mixing.cut_words(" a b\nc d ", 1, 2) == ["b\nc"]
    assert mixing.cut_words("a b c", 2, 2) == ["c", "a"]
    assert mixing.cut_words("a b c", 0, 3) == ["a b c"]


TALK = [
    (c, t, role, text)
    for c in range(60)
    for t, (role, text) in enumerate([("system", "Be brief."), ("user", f"What is {c}?"), ("assistant", "It is a number.\n- one\n- two\nLong answer " * 3), ("user", "Why?"), ("assistant", "Because of reasons.\nMore of them " * 4)][c % 2 :])
]


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")


def test_roles_of_held_out_conversations(talk):
    got = transcripts.parse_transcripts(talk, learn=F.col("conv_id") < 40).filter("conv_id >= 40").collect()
    truth = {(c, t): role for c, t, role, _ in TALK}
    assert len(got) == 90 and sum(r.role == truth[r.conv_id, r.turn] for r in got) > 85
    assert got[0].rendered.startswith(f"<|{got[0].role}|>\n") and got[0].rendered.endswith("\n<|end|>")


def test_chunks_do_not_change_the_path(talk):
    model = transcripts.fit(talk)
    whole, cut = (transcripts.parse_transcripts(talk, model, chunk_turns=n).collect() for n in (256, 2))
    assert Counter(map(tuple, whole)) == Counter(map(tuple, cut))


def test_path_equals_brute_force(talk):
    model = transcripts.fit(talk)
    rng = random.Random(1)
    for _ in range(12):
        texts = [[rng.choice(["User: x", "Why?", "Assistant: fine", "- list", "long " * 30, "", "Tool: 3"]) for _ in range(rng.randint(1, 3))] for _ in range(2)]
        rows = np.concatenate([model.emissions(t) for t in texts])
        opens = [i == 0 for t in texts for i in range(len(t))]

        def total(path, rows=rows, opens=opens):
            steps = sum((model.turn if opens[i] else model.line)[path[i - 1], path[i]] for i in range(1, len(path)))
            return model.first[path[0]] + sum(rows[i][path[i]] for i in range(len(path))) + steps

        best = max(total(p) for p in itertools.product(range(4), repeat=len(rows)))
        found = [x for part in transcripts.decode(model, texts) for x in part]
        assert total(found) == pytest.approx(best)


def test_markers_split_one_text_and_odd_rows_have_results(spark, talk):
    odd = [(900, 0, None, "User: hello there\nhow are you?\nAssistant: fine\n- two\nUser: bye"), (901, None, "user", None), (None, 0, "user", "lost"), (902, 0, "user", ""), (902, 0, "user", ""), (903, 5, "USER", "tie a"), (903, 5, "user", "tie b")]
    rows = talk.union(spark.createDataFrame(odd, talk.schema)).withColumn("chunk", F.lit("x")).withColumn("segment", F.lit(1.5))
    got = [r for r in transcripts.parse_transcripts(rows, learn=F.col("conv_id") < 60).collect() if r.conv_id is None or r.conv_id >= 900]
    own = sorted((r.segment, r.role, r.rendered) for r in got if r.conv_id == 900)
    assert [r[1] for r in own] == ["user", "assistant", "user"] and own[1][2] == "<|assistant|>\nfine\n- two\n<|end|>"
    assert Counter((r.conv_id, r.turn) for r in got) == Counter({(900, 0): 3, (901, -1): 1, (None, 0): 1, (902, 0): 1, (903, 5): 2})


def test_no_conversations(talk):
    assert transcripts.parse_transcripts(talk.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, name, labels = docs.columns, "", spark.read.parquet(f"{sf}/labels.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.count()
        assert docs.columns == columns or i == 4
    assert kept["toxicity"] >= kept["simhash_near_dedup"] >= kept["benchmark_decontamination"] > 0.7 * labels.count()
    assert kept["token_files"] == kept["source_mix"] and corpus_pipeline.run(spark, sf).count() == kept["token_files"]
