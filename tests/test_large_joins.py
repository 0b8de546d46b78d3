"""No join of a query takes Spark's word for what is small: every side that is broadcast was counted."""

from __future__ import annotations

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from __spark_entry__ import queries
from traitframe.constants import BROADCAST_ROWS, SALTS
from traitframe.llm.similar import keep_one_per_similar_group
from traitframe.operators import genotypes, joins

NAMES = [
    "j4_snp_gene",
    "m2_joint_block_weights_classes",
    "m2_joint_block_weights",
    "s12_block_embedding_writer",
    "p9_onehot_by_gene",
    "m2_block_weight_fit",
    "p9_onehot",
    "s3_site_store_range",
    "s3_genotype_scan",
    "s14_site_store",
    "m3_block_embed",
    "m3_block_embed_calls",
    "a6_block_sum",
    "s14_genotype_writer",
    "j9_snp_block_weight",
    "a10_block_snps",
    "a13_counts",
    "p10_index_expansion",
    "w5_snp_index",
    "a12_distinct_blocks",
    "p6_strand",
    "j4_snp_gene_salted",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Parts and nations of which some genes and sites arise."""
    path = str(tmp_path_factory.mktemp("tables"))
    parts = [(p, p % 50 + 1) for p in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    nations = [(n, f"N{n:02d}", n % 5) for n in range(25)]
    spark.createDataFrame(nations, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{path}/nation.parquet")
    return path


def joins_of(df):
    """The joins of the optimized plan, each with its hints."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Join (?:Inner|LeftOuter|RightOuter|FullOuter|LeftSemi|LeftAnti), .*", plan)


@pytest.fixture
def written(monkeypatch):
    """The joins of all that is written meanwhile."""
    seen = []
    write = DataFrameWriter.parquet

    def recorded(self, *args, **kwargs):
        seen.extend(joins_of(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    return seen


@pytest.mark.parametrize("name", NAMES)
def test_every_join_says_how(spark, tables, written, monkeypatch, name):
    for fn in (joins.sized_join, genotypes.snps_in_genes):  # as if every side were large
        values = {BROADCAST_ROWS: 0, SALTS: 2}
        monkeypatch.setattr(fn, "__defaults__", tuple(values.get(x, x) if type(x) is int else x for x in fn.__defaults__))
    found = joins_of(queries()[name](spark, tables)) + written
    assert found
    assert [x for x in found if "strategy=" not in x] == []


def test_near_copies_say_how(spark, written, monkeypatch):
    """Stage 2 of the pipeline, with units of several classes and ids that come twice."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"x{k}y{g}"] + words[k + 1 :] if k else [*words, f"z{g}"]) for g in range(3) for k in range(0, 60, 2)]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (500, "alone"), (None, "none")], "doc_id long, text string")
    monkeypatch.setattr(joins.sized_join, "__defaults__", tuple({BROADCAST_ROWS: 0, SALTS: 2}.get(x, x) if type(x) is int else x for x in joins.sized_join.__defaults__))
    kept = keep_one_per_similar_group(docs)
    found = joins_of(kept) + written
    assert len(found) > 10
    assert [x for x in found if "strategy=" not in x] == []
    assert {r["doc_id"] for r in kept.collect()} >= {0, 500, None}
