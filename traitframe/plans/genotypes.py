"""VCF and GFF3 files to the genotype tables of the block model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from traitframe.operators.genotypes import matched_or_error, sites_in_genes, snps_in_genes
from traitframe.session import stage
from traitframe.sources.genome import calls_from_sites, read_gff_genes, read_lines, site_positions, sites_from_lines, vcf_samples
from traitframe.sources.sinks import write_genotypes


@dataclass
class Encoded:
    """Genotype codes of the SNPs that lie in genes, and which genes those are."""

    calls: DataFrame  # ID, snp_id, code
    edges: DataFrame  # snp_id, block_id


def encode_genotypes(
    spark: SparkSession,
    vcf: str,
    gff: str,
    strand: str = ".",
    normalize_vcf: bool = True,
    path: str | None = None,
) -> Encoded:
    """Match SNPs to genes, code their genotypes, and write both tables when ``path`` is given."""
    lines = read_lines(spark, vcf)
    # SNP positions and gene ranges are thin; written once for the two users below
    edges = stage(snps_in_genes(site_positions(lines), read_gff_genes(spark, gff), strand, normalize_vcf), "snp-block")
    matched_or_error(edges)
    calls = calls_from_sites(sites_in_genes(sites_from_lines(lines), edges), vcf_samples(lines))
    if path is not None:
        write_genotypes(calls, edges, path)
    return Encoded(calls, edges)
