"""Genotype codes stored site by site: four bits a sample, in blocks of samples, sorted by place.

Three tables below one path: ``sites(seqid, pos, snp_id, sample_block, packed)``
sorted by sequence and position, so that the bounds of row groups let a range
skip the rest; ``samples(sample_block, names)``; and ``edges(snp_id, block_id,
seqid, pos)``, which finds the places of a gene. Rows per sample and SNP arise
only when a reader asks for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.functions.genome import sequence_name
from traitframe.operators.genotypes import sites_in_genes
from traitframe.operators.joins import sized_join

SAMPLE_BLOCK = 16_384
ROW_GROUP_BYTES = 16 << 20
_DIGITS = "0123456789A"  # codes 0..10 as hexadecimal digits


def pack_codes(codes: Column) -> Column:
    """An array of codes as binary, four bits each; an odd last one is padded with code 0."""
    digits = F.array_join(F.transform(codes, lambda c: F.hex(F.coalesce(c, F.lit(0)).cast("int"))), "")
    return F.unhex(F.when(F.size(codes) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def unpack_codes(packed: Column) -> Column:
    """The codes of :func:`pack_codes`; padding may follow."""
    return F.transform(F.split(F.hex(packed), ""), lambda d: (F.instr(F.lit(_DIGITS), d) - 1).cast("tinyint"))


def write_site_store(sites: DataFrame, samples: DataFrame, edges: DataFrame, path: str, sample_block: int = SAMPLE_BLOCK, normalize_sites: bool = True) -> None:
    """Write the sites that lie in genes; ``samples`` is the one-row table of :func:`traitframe.sources.genome.vcf_samples`.

    Site rows are cut into blocks of ``sample_block`` samples, an even number, and move once, to their range of places.
    """
    if sample_block < 2 or sample_block % 2:
        raise ValueError("sample_block must be even")
    seqid = sequence_name(F.col("chrom")) if normalize_sites else F.col("chrom")
    placed = sites_in_genes(sites, edges).select(seqid.alias("seqid"), "pos", "snp_id", pack_codes(F.col("codes")).alias("packed"), F.size("codes").alias("_n"))
    width = sample_block // 2
    blocks = F.sequence(F.lit(0), F.greatest(((F.col("_n") - 1) / sample_block).cast("int"), F.lit(0)))
    cut = F.transform(blocks, lambda b: F.struct(b.alias("sample_block"), F.substring("packed", b * width + 1, F.lit(width)).alias("packed")))
    rows = placed.select("seqid", "pos", "snp_id", F.inline(cut))
    even = rows.repartitionByRange("seqid", "pos", "snp_id", "sample_block").sortWithinPartitions("seqid", "pos", "snp_id", "sample_block")
    even.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/sites")
    names = samples.select(F.posexplode("samples").alias("at", "name"))
    names = names.groupBy(F.floor(F.col("at") / sample_block).cast("int").alias("sample_block"))
    names.agg(F.sort_array(F.collect_list(F.struct("at", "name")))["name"].alias("names")).write.parquet(f"{path}/samples")
    where = sites.select("snp_id", seqid.alias("seqid"), "pos")
    sized_join(edges, where, ["snp_id"], salt_by=["block_id"]).select("snp_id", "block_id", "seqid", "pos").write.parquet(f"{path}/edges")


def read_sites(spark: SparkSession, path: str, place: tuple[str, int, int] | None = None, genes: Sequence[str] | None = None) -> DataFrame:
    """Site rows of the whole store, of a place (sequence, first, last position), or of some genes.

    The bounds of a place, or of the range that the genes' SNPs span on each
    sequence, reach the scan as filters.
    """
    rows = spark.read.parquet(f"{path}/sites")
    if place is not None:
        rows = rows.where((F.col("seqid") == place[0]) & F.col("pos").between(place[1], place[2]))
    if genes is not None:
        own = spark.read.parquet(f"{path}/edges").where(F.col("block_id").isin(list(genes)))
        spans = own.groupBy("seqid").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).collect()  # one row a sequence
        inside = F.lit(False)
        for s in spans:
            inside = inside | ((F.col("seqid") == s["seqid"]) & F.col("pos").between(s["first"], s["last"]))
        rows = sized_join(rows.where(inside), own.select("snp_id").distinct(), ["snp_id"], "left_semi", salt_by=["sample_block"])
    return rows


def site_calls(spark: SparkSession, path: str, sites: DataFrame | None = None) -> DataFrame:
    """(ID, snp_id, code) of the given site rows (all by default): one row a sample and SNP, made last."""
    rows = read_sites(spark, path) if sites is None else sites
    named = rows.join(F.broadcast(spark.read.parquet(f"{path}/samples")), "sample_block")  # each name once
    cells = F.arrays_zip(F.col("names").alias("ID"), F.slice(unpack_codes(F.col("packed")), F.lit(1), F.size("names")).alias("code"))
    spread = named.select("snp_id", F.inline(cells))
    return spread.where("ID is not null").select("ID", "snp_id", F.coalesce("code", F.lit(0).cast("tinyint")).alias("code"))
