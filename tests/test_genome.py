from __future__ import annotations

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import rows
from traitframe.constants import GENOTYPE_PAIRS
from traitframe.functions import genome as g
from traitframe.operators import blocks, genotypes
from traitframe.plans.genotypes import encode_genotypes
from traitframe.sources import genome, sinks, tables


@pytest.mark.parametrize(
    ("field", "ref", "alts", "code"),
    [
        ("0/0", "A", ["C"], 1), ("0/1", "A", ["C"], 5), ("1|0", "A", ["C"], 5), ("1/1:12:3", "A", ["C"], 2),
        ("./.", "A", ["C"], 0), (".", "A", ["C"], 0), ("1", "A", ["C"], 0), ("0/2", "A", ["C"], 0), ("0/2", "A", ["C", "T"], 7),
        ("0/10", "A", list("CGTACGTAC") + ["G"], 6), ("0/0", "a", ["C"], 0), ("0/1", "GTT", ["TA"], 10), ("0|.", "A", ["C"], 0),
        ("0/1", "A", [], 0), ("", "A", ["C"], 0), ("x/y", "A", ["C"], 0), ("0/1", "A", ["*"], 0),
    ],
)
def test_genotype_code(spark, field, ref, alts, code):
    df = spark.createDataFrame([(field, ref, alts)], "s string, r string, a array<string>")
    assert df.select(g.genotype_code(F.col("s"), F.col("r"), F.col("a"))).first()[0] == code


def test_all_base_pairs(spark):
    pairs = [(a, b) for a in "ACGT" for b in "ACGT"]
    df = spark.createDataFrame(pairs, "r string, a string")
    got = df.select("r", "a", g.genotype_code(F.lit("0/1"), F.col("r"), F.array("a")).alias("c")).collect()
    assert {(r["r"], r["a"]): r["c"] for r in got} == {p: GENOTYPE_PAIRS.index("".join(sorted(p))) + 1 for p in pairs}


def test_sequence_names(spark):
    names = ["Chr1", "CHR01", "chrUn_chr2", "1", "Scaffold_1", "mtChR"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(g.sequence_name(F.col("n"))).collect()] == ["1", "01", "un_2", "1", "Scaffold_1", "mt"]


GFF = """##gff-version 3
Chr1\tm\tgene\t100\t200\t.\t+\t.\tID=g1;Name=x
Chr1\tm\tmRNA\t100\t200\t.\t+\t.\tID=t1
Chr1\tm\tgene\t150\t300\t.\t-\t.\tName=ID=no;ID=g2
2\tm\tgene\t1\t50\t.\t+\t.\tID=g3
2\tm\tgene\tx\t50\t.\t+\t.\tID=bad1
2\tm\tgene\t60\t50\t.\t+\t.\tID=bad2
2\tm\tgene\t60\t70\t.\t+\t.\tName=noid
2\tm\tgene\t60
2\tm\tgene\t10\t90\t.\t-\t.\tID=g3"""

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3
chr1\t100\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/1\t1/1
chr1\t200\t.\tG\tT,C\t.\t.\t.\tGT:DP\t0|2:3\t./.:1\t1|2:9
chr1\t301\t.\tA\tC\t.\t.\t.\tGT\t0/0\t0/0\t0/0
chr2\t90\t.\tC\t.\t.\t.\t.\tGT\t0/0\t0\t0/0
chr2\tpos\t.\tC\tT\t.\t.\t.\tGT\t0/0\t0/0\t0/0
chr1\t100\t.\tA\tG\t.\t.\t.\tGT\t1/1\t0/1"""


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    path = tmp_path_factory.mktemp("genome")
    (path / "a.gff3").write_text(GFF)
    (path / "a.vcf").write_text(VCF)
    (path / "none.gff3").write_text("##gff-version 3\n")
    return path


def test_gff(spark, files):
    got = rows(genome.read_gff_genes(spark, f"{files}/a.gff3"), "gene_id", "seqid", "start", "end", "strand", "len")
    assert got == [("g1", "1", 100, 200, "+", 101), ("g2", "1", 150, 300, "-", 151), ("g3", "2", 10, 90, "-", 81)]
    with pytest.raises(ValueError):
        genome.read_gff_genes(spark, f"{files}/none.gff3")


def test_vcf_and_matching(spark, files):
    done = encode_genotypes(spark, f"{files}/a.vcf", f"{files}/a.gff3", path=f"{files}/out")
    assert rows(done.edges) == [("chr1-100", "g1"), ("chr1-200", "g1"), ("chr1-200", "g2"), ("chr2-90", "g3")]
    want = [
        # the later record of chr1-100 counts; its third field is absent
        ("s1", "chr1-100", 3), ("s1", "chr1-200", 8), ("s1", "chr2-90", 2),
        ("s2", "chr1-100", 6), ("s2", "chr1-200", 0), ("s2", "chr2-90", 0),
        ("s3", "chr1-100", 0), ("s3", "chr1-200", 9), ("s3", "chr2-90", 2),
    ]
    assert rows(done.calls) == want
    saved = tables.read_genotypes(spark, f"{files}/out")
    assert rows(saved["genotypes"]) == want and rows(saved["snp_block"]) == rows(done.edges)
    wide = tables.genotype_matrix(saved["genotypes"], ["chr1-200", "chr2-90"])
    assert rows(wide) == [("s1", 8, 2), ("s2", 0, 0), ("s3", 9, 2)]
    assert rows(encode_genotypes(spark, f"{files}/a.vcf", f"{files}/a.gff3", strand="-").edges) == [("chr1-200", "g2"), ("chr2-90", "g3")]
    with pytest.raises(ValueError):
        encode_genotypes(spark, f"{files}/a.vcf", f"{files}/a.gff3", normalize_vcf=False)


def test_malformed_records_are_kept_apart_and_counted(spark):
    gff = spark.createDataFrame([*enumerate((GFF + "\n\n2\tm\tgene\t1\t5\t.\t*\t.\tID=g4\n2\tm\tgene\t0\t5\t.\t+\t.\tID=g5").split("\n")), (99, None)], "line_no long, value string")
    seen = Observation()
    assert genome.parse_genes(gff, seen).count() == 4
    assert seen.get == {"kept": 4, "fields": 1, "position": 2, "range": 1, "strand": 1, "id": 1}
    assert sorted(rows(genome.malformed_genes(gff).select("line_no", "reason"))) == [(5, "position"), (6, "range"), (7, "id"), (8, "fields"), (11, "strand"), (12, "position")]
    short = "chr1\t5\t.\tA\tC"
    vcf = spark.createDataFrame([*enumerate([*VCF.split("\n"), short, short + "\t.\t.\t.\tGT\t0/0", "\t5\t.\tA\tC\t.\t.\t.\tGT\t0/0", "chr1\t5\t.\t\tC\t.\t.\t.\tGT\t0/0", ""])], "line_no long, value string")
    seen = Observation()
    assert genome.parse_sites(vcf, seen).count() == 6
    assert seen.get == {"kept": 6, "fields": 1, "position": 1, "ref": 1, "chrom": 1}
    assert sorted(rows(genome.malformed_sites(vcf).select("line_no", "reason"))) == [(6, "position"), (8, "fields"), (10, "chrom"), (11, "ref")]
    assert rows(genome.malformed_genes(gff.limit(0))) == []


def test_files_with_different_samples_fail(spark):
    lines = spark.createDataFrame([("#CHROM\t" * 9 + "a", 1), ("#CHROM\t" * 9 + "b", 2)], "value string, line_no int")
    with pytest.raises(Exception, match="different samples"):
        genome.vcf_samples(lines).collect()


@pytest.mark.parametrize("options", [{}, {"bin_width": 7}, {"max_rows": 0, "salts": 3, "bin_width": 50}])
def test_range_join_against_brute_force(spark, options):
    rng = random.Random(1)
    genes = []
    for i in range(60):
        start = rng.randint(1, 400)
        genes.append((f"g{i}", rng.choice("12"), start, start + rng.choice([0, 5, 300]), rng.choice("+-")))
    # one third of the sites at one spot
    sites = [(f"s{i}", rng.choice(["1", "chr1", "2", "3"]), 200 if i % 3 == 0 else rng.randint(1, 700)) for i in range(200)]
    g_df = spark.createDataFrame(genes, "gene_id string, seqid string, start long, end long, strand string")
    s_df = spark.createDataFrame(sites, "snp_id string, chrom string, pos long")
    want = sorted((s, q) for s, c, p in sites for q, n, a, b, _ in genes if n == c.replace("chr", "") and a <= p <= b)
    assert rows(genotypes.snps_in_genes(s_df, g_df, **options)) == want
    plus = sorted((s, q) for s, c, p in sites for q, n, a, b, t in genes if n == c and a <= p <= b and t == "+")
    assert rows(genotypes.snps_in_genes(s_df, g_df, "+", normalize_sites=False, **options)) == plus


def test_long_genes_are_one_row(spark):
    """Ranges of every length, at the ends of bins, without positions: one row a gene, and every edge found."""
    spans = [(1, 100_000_000), (16_383, 16_384), (16_384, 32_767), (131_071, 131_072), (1 << 29, 1 << 29), ((1 << 29) - 1, 1 << 29), (5, 5), (1, (1 << 62) + 7), (-3, 4)]
    genes = [(f"g{n}", "1", a, b, "+") for n, (a, b) in enumerate(spans)] + [("none", "1", None, 9, "+"), ("back", "1", 9, 3, "+")]
    places = sorted({p + d for a, b in spans for p in (a, b, (a + b) // 2) for d in (-1, 0, 1)})
    g_df = spark.createDataFrame(genes, "gene_id string, seqid string, start long, end long, strand string")
    s_df = spark.createDataFrame([(f"s{p}", "1", p) for p in places] + [("nowhere", "1", None)], "snp_id string, chrom string, pos long")
    assert genotypes.gene_bins(g_df).count() == len(genes)
    want = sorted((f"s{p}", q) for p in places for q, _, a, b, _ in genes if a is not None and a <= p <= b)
    assert rows(genotypes.snps_in_genes(s_df, g_df)) == want
    assert rows(genotypes.snps_in_genes(s_df, g_df, max_rows=0, salts=2)) == want
    assert rows(genotypes.snps_in_genes(s_df, g_df.limit(0))) == rows(genotypes.snps_in_genes(s_df.limit(0), g_df)) == []


def test_lists_and_onehot(spark):
    edges = spark.createDataFrame([(f"s{i:02d}", "g") for i in range(10)] + [("s03", "h")], "snp_id string, block_id string")
    index = genotypes.snp_index(edges)
    lists = genotypes.block_snp_lists(edges, index, chunk=4)
    assert rows(lists) == [("g", 0, [0, 1, 2, 3]), ("g", 1, [4, 5, 6, 7]), ("g", 2, [8, 9]), ("h", 0, [3])]
    calls = spark.createDataFrame([("a", "s00", 1), ("a", "s03", 10), ("a", "s04", 0), ("b", "s03", 2)], "ID string, snp_id string, code int")
    bits = genotypes.onehot_calls(calls, index)
    assert rows(bits) == [("a", 0), ("a", 39), ("b", 31)]
    assert rows(genotypes.onehot_vectors(bits, 100)) == [("a", 100, [0, 39]), ("b", 100, [31])]
    assert rows(genotypes.onehot_calls_by_block(calls, edges, index).where("block_id = 'h'")) == [("a", "h", 39), ("b", "h", 31)]


def test_block_embedding(spark):
    edges = spark.createDataFrame([("s1", "g"), ("s2", "g"), ("s2", "h")], "snp_id string, block_id string")
    weights = spark.createDataFrame([("g", "s1", 1, 0.5), ("g", "s2", 2, 1.0), ("h", "s2", 2, -2.0)], "block_id string, snp_id string, code int, w double")
    calls = spark.createDataFrame([("a", "s1", 1), ("a", "s2", 2), ("b", "s1", 3), ("b", "s2", 0)], "ID string, snp_id string, code int")
    assert rows(blocks.block_embed(calls, edges, weights)) == [("a", "g", 1.5), ("a", "h", -2.0), ("b", "g", 0.0), ("b", "h", 0.0)]


def test_block_weights_see_training_rows_only(spark):
    edges = spark.createDataFrame([("s1", "g")], "snp_id string, block_id string")
    targets = spark.createDataFrame([(f"i{i}", i, float(i)) for i in range(6)], "ID string, fragment int, y double")
    calls = spark.createDataFrame([(f"i{i}", "s1", 1 + i % 2) for i in range(6)], "ID string, snp_id string, code int")
    got = {(r["x_outer"], r["x_inner"], r["code"]): r["w"] for r in blocks.fit_block_weights(calls, edges, targets, 3, 2).collect()}
    # fold (0, 0): test 0 1, validation 2 3, training 4 5 with mean 4.5
    assert got[0, 0, 1] == pytest.approx((4 - 4.5) / 2) and got[0, 0, 2] == pytest.approx((5 - 4.5) / 2)
    # fold (2, 1): test 4 5, validation 2 3, training 0 1
    assert got[2, 1, 1] == pytest.approx(-0.25)
