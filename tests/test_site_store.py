"""Site-major genotype codes: packing, pruning, and plans in which codes do not move."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from traitframe.operators import genotypes
from traitframe.sources import genome, site_store


def lines_of(spark, samples=7, repeats=True):
    rng = random.Random(2)
    texts = ["0/0", "0/1", "1|1", "./.", "2/1", "."]
    head = [(0, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"i{k}" for k in range(samples)]]))]
    body = []
    for j in range(40):
        for again in range(2 if repeats and j % 9 == 0 else 1):
            chrom, pos = f"chr{j % 3}", 100 + j * 10
            body.append((1 + 2 * j + again, "\t".join([chrom, str(pos), ".", "A", "C,G", ".", ".", ".", "GT", *[rng.choice(texts) for _ in range(samples)]])))
    return spark.createDataFrame(head + body, "line_no long, value string").repartition(3)


def test_codes_survive_packing(spark):
    data = [(list(range(11)),), ([],), ([3],), ([None, 10],)]
    found = spark.createDataFrame(data, "codes array<tinyint>").select(F.size("codes").alias("n"), site_store.unpack_codes(site_store.pack_codes(F.col("codes"))).alias("back"))
    assert sorted((r["n"], r["back"][: r["n"]]) for r in found.collect()) == [(0, []), (1, [3]), (2, [0, 10]), (11, list(range(11)))]


@pytest.mark.parametrize("block", [2, 4, 100])
def test_store_gives_back_calls(spark, tmp_path, block):
    lines = lines_of(spark)
    sites, names = genome.sites_from_lines(lines), genome.vcf_samples(lines)
    edges = sites.where("pos % 20 = 0").select("snp_id", F.concat(F.lit("g"), (F.col("pos") / 100).cast("int")).alias("block_id"))
    site_store.write_site_store(sites, names, edges, f"{tmp_path}/s", sample_block=block)
    calls = genome.calls_from_sites(genotypes.sites_in_genes(sites, edges), names)
    assert rows(site_store.site_calls(spark, f"{tmp_path}/s")) == rows(calls)
    assert rows(calls) == rows(genotypes.calls_in_genes(genome.calls_from_sites(sites, names), edges))
    own = edges.where("block_id = 'g2'").select("snp_id")
    some = site_store.read_sites(spark, f"{tmp_path}/s", genes=["g2"])
    assert rows(site_store.site_calls(spark, f"{tmp_path}/s", some)) == rows(calls.join(own, "snp_id", "left_semi"), "ID", "snp_id", "code")
    part = site_store.read_sites(spark, f"{tmp_path}/s", ("1", 120, 300))
    assert "PushedFilters" in part._jdf.queryExecution().toString() and "GreaterThanOrEqual(pos,120)" in part._jdf.queryExecution().toString()
    assert {r["pos"] for r in part.collect()} == {p for p in range(100, 500, 10) if p % 20 == 0 and 120 <= p <= 300 and (p - 100) // 10 % 3 == 1}
    with pytest.raises(ValueError):
        site_store.write_site_store(sites, names, edges, f"{tmp_path}/t", sample_block=3)


def test_last_record_counts(spark):
    lines = lines_of(spark)
    parsed = genotypes.latest_sites(genome.parse_sites(lines)).select("snp_id", "line_no")
    kept = genome.sites_from_lines(lines)
    assert kept.count() == parsed.count() == 40
    later = {s: n for s, n in parsed.collect()}
    raw = {r["line_no"]: r["fields"] for r in genome.parse_sites(lines).collect()}
    alleles = {"0/0": 1, "0/1": 5, "1|1": 2, "./.": 0, "2/1": 8, ".": 0}
    assert {r["snp_id"]: r["codes"] for r in kept.collect()} == {s: [alleles[x] for x in raw[n]] for s, n in later.items()}


def test_codes_meet_no_shuffle(spark):
    """From coded records to bits, the only joins of the wide rows are with counted small tables."""
    lines = lines_of(spark)
    sites, names = genome.sites_from_lines(lines), genome.vcf_samples(lines)
    edges = sites.select("snp_id", F.lit("g").alias("block_id"))
    index = genotypes.snp_index(edges)
    for df in (genome.calls_from_sites(genotypes.sites_in_genes(sites, edges), names), genotypes.onehot_sites(sites, names, index)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        wide = [x for x in plan.split("\n") if "codes" in x and any(k in x for k in ("Exchange", "Aggregate", "SortMergeJoin", "Sort "))]
        assert not wide
    calls = genome.calls_from_sites(sites, names)
    assert rows(genotypes.onehot_sites(sites, names, index)) == rows(genotypes.onehot_calls(calls, index))
    assert rows(genotypes.onehot_sites_by_block(sites, names, edges, index)) == rows(genotypes.onehot_calls_by_block(calls, edges, index))
