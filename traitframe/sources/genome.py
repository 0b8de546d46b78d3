"""GFF3 and VCF text.

Both readers work on a frame of lines ``(value, line_no)``; any orderable
``line_no`` will do. For files it is (path, split offset, row in split), which
is the file order whatever order the splits are read in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from traitframe.functions.genome import gene_length, genotype_code, sequence_name, snp_name
from traitframe.operators.genotypes import current_sites, latest_genes
from traitframe.operators.joins import require_rows
from traitframe.session import stage

VCF_FIXED = 9  # CHROM POS ID REF ALT QUAL FILTER INFO FORMAT
# why a record is malformed; the first that holds is told
GENE_REASONS = ("fields", "position", "range", "strand", "id")
SITE_REASONS = ("fields", "position", "ref", "chrom")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with an order."""
    lines = spark.read.text(path)
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("value", order.alias("line_no"))


def _position(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{1,18}$"), text).try_cast("bigint")


def _records(lines: DataFrame) -> DataFrame:
    """Lines that hold a record, split at tabs; comments and blank lines are none."""
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))


def _reason(tests: dict[str, Column]) -> Column:
    """The name of the first test that does not hold, null where all do; an unknown outcome does not hold."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in tests.items()])


def _observed(records: DataFrame, seen: Observation | None, reasons: tuple[str, ...]) -> DataFrame:
    if seen is None:
        return records
    return records.observe(seen, F.count_if(F.col("reason").isNull()).alias("kept"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons])


def _gene_records(lines: DataFrame) -> DataFrame:
    parts = _records(lines).where((F.size("f") < 9) | (F.get("f", F.lit(2)) == "gene"))
    fields = parts.select(
        F.regexp_extract(F.get("f", F.lit(8)), r"(?:^|;)\s*ID=([^;]+)", 1).alias("gene_id"),
        sequence_name(F.get("f", F.lit(0))).alias("seqid"),
        _position(F.get("f", F.lit(3))).alias("start"),
        _position(F.get("f", F.lit(4))).alias("end"),
        F.get("f", F.lit(6)).alias("strand"),
        F.get("f", F.lit(2)).alias("feature_type"),
        "line_no",
        "value",
        F.size("f").alias("_n"),
    )
    tests = {
        "fields": F.col("_n") == 9,
        "position": (F.col("start") > 0) & F.col("end").isNotNull(),
        "range": F.col("end") >= F.col("start"),
        "strand": F.col("strand").isin("+", "-", ".", "?"),
        "id": F.col("gene_id") != "",
    }
    return fields.withColumn("reason", _reason(tests)).drop("_n")


def parse_genes(lines: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Gene records of GFF3 lines, before removing repeated IDs.

    Malformed records (no nine fields, positions that are no positive
    numbers, end before start, unknown strand, no ID) are dropped;
    :func:`malformed_genes` holds them. ``seen`` gets the number of records
    ``kept`` and of those dropped for each of ``GENE_REASONS``, counted in the
    scan that an action on the result makes.
    """
    records = _observed(_gene_records(lines), seen, GENE_REASONS).where("reason is null").drop("reason", "value")
    return records.withColumn("len", gene_length(F.col("start"), F.col("end")))


def malformed_genes(lines: DataFrame) -> DataFrame:
    """(line_no, reason, value): the gene records that :func:`parse_genes` drops, and lines too short to tell."""
    return _gene_records(lines).where("reason is not null").select("line_no", "reason", "value")


def genes_from_lines(lines: DataFrame) -> DataFrame:
    """One row per gene; the last record of an ID counts."""
    genes = latest_genes(parse_genes(lines))
    return genes.select("gene_id", "seqid", "start", "end", "strand", "feature_type", "len")


def read_gff_genes(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a GFF3 file; an error when there is none."""
    return require_rows(genes_from_lines(read_lines(spark, path)), f"no gene found in {path}")


def vcf_samples(lines: DataFrame) -> DataFrame:
    """One row with the array of sample names of the ``#CHROM`` line.

    Several files may be read together when they name the same samples.
    """
    headers = lines.where(F.col("value").startswith("#CHROM")).agg(F.min("value").alias("one"), F.max("value").alias("other"))
    names = F.slice(F.split("one", "\t"), VCF_FIXED + 1, F.greatest(F.size(F.split("one", "\t")) - VCF_FIXED, F.lit(0)))
    same = F.when(F.col("one").isNull(), F.raise_error(F.lit("no #CHROM line found"))).when(
        F.col("one") != F.col("other"), F.raise_error(F.lit("files name different samples; read them one by one"))
    )
    return headers.select(F.coalesce(same.cast("array<string>"), names).alias("samples"))


def _site_records(lines: DataFrame) -> DataFrame:
    alt = F.get("f", F.lit(4))
    fields = _records(lines).select(
        F.get("f", F.lit(0)).alias("chrom"),
        _position(F.get("f", F.lit(1))).alias("pos"),
        F.get("f", F.lit(3)).alias("ref"),
        F.when(alt == ".", F.array().cast("array<string>")).otherwise(F.split(alt, ",")).alias("alts"),
        F.slice("f", VCF_FIXED + 1, F.greatest(F.size("f") - VCF_FIXED, F.lit(0))).alias("fields"),
        "line_no",
        "value",
        F.size("f").alias("_n"),
    )
    tests = {"fields": F.col("_n") > VCF_FIXED, "position": F.col("pos") > 0, "ref": F.col("ref") != "", "chrom": F.col("chrom") != ""}
    return fields.withColumn("reason", _reason(tests)).drop("_n")


def parse_sites(lines: DataFrame, seen: Observation | None = None) -> DataFrame:
    """VCF records, one row per line: site fields and the array of sample texts.

    Malformed records (no sample field, position no positive number, empty
    REF or CHROM) are dropped; :func:`malformed_sites` holds them. ``seen`` counts
    them by ``SITE_REASONS`` as in :func:`parse_genes`.
    """
    records = _observed(_site_records(lines), seen, SITE_REASONS).where("reason is null").drop("reason", "value")
    return records.withColumn("snp_id", snp_name(F.col("chrom"), F.col("pos")))


def malformed_sites(lines: DataFrame) -> DataFrame:
    """(line_no, reason, value): the records that :func:`parse_sites` drops."""
    return _site_records(lines).where("reason is not null").select("line_no", "reason", "value")


def site_positions(lines: DataFrame) -> DataFrame:
    """(snp_id, chrom, pos) of every SNP: all that matching SNPs to genes needs.

    Repeated records of an ID share its position, so nothing has to be chosen
    and no genotype text leaves the scan.
    """
    return parse_sites(lines).select("snp_id", "chrom", "pos").distinct()


def sites_from_lines(lines: DataFrame) -> DataFrame:
    """One row per SNP with its genotype codes as a byte array; the last record of an ID counts.

    A record has few different genotype texts whatever its number of samples, so
    each text is decoded once per record and looked up for the samples. The
    coded records are written once. Which of them are superseded follows from
    their IDs and line numbers alone, so codes never move.
    """
    sites = parse_sites(lines).withColumn("_gt", F.transform("fields", lambda s: F.substring_index(s, ":", 1))).drop("fields")
    sites = sites.withColumn("_texts", F.array_distinct("_gt"))
    sites = sites.withColumn("_codes", F.transform("_texts", lambda t: genotype_code(t, F.col("ref"), F.col("alts"))))
    looked_up = F.transform("_gt", lambda t: F.get("_codes", (F.array_position("_texts", t) - 1).cast("int")))
    # used a second time, the two tables stay columns; the optimizer would
    # otherwise move their expressions into the loop over the samples
    codes = F.when(F.size("_codes") == F.size("_texts"), looked_up)
    coded = sites.select("snp_id", "chrom", "pos", "ref", "alts", codes.alias("codes"), "line_no")
    return current_sites(stage(coded, "coded-sites")).drop("line_no")


def calls_from_sites(sites: DataFrame, samples: DataFrame) -> DataFrame:
    """(ID, snp_id, code): one row per sample and SNP. Absent fields are code 0.

    ``samples`` is the one-row table of :func:`vcf_samples`.
    """
    named = sites.select("snp_id", "codes", samples.scalar().alias("_names"))
    spread = named.select("snp_id", "codes", F.posexplode("_names").alias("_at", "ID"))
    return spread.select("ID", "snp_id", F.coalesce(F.get("codes", F.col("_at")), F.lit(0).cast("tinyint")).alias("code"))


def read_vcf_sites(spark: SparkSession, path: str) -> DataFrame:
    return require_rows(sites_from_lines(read_lines(spark, path)), f"no variant found in {path}")


def read_vcf_calls(spark: SparkSession, path: str) -> DataFrame:
    """Genotype codes of a VCF file in long form."""
    lines = read_lines(spark, path)
    return calls_from_sites(sites_from_lines(lines), vcf_samples(lines))
