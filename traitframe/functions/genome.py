"""Genotype and gene expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitframe.constants import GENOTYPE_PAIRS, ONEHOT_BITS


def sequence_name(name: Column) -> Column:
    """Lower-case a name holding "chr" in any case and drop every "chr"; others stay."""
    low = F.lower(name)
    return F.when(low.contains("chr"), F.replace(low, F.lit("chr"), F.lit(""))).otherwise(name)


def snp_name(chrom: Column, pos: Column) -> Column:
    """``chrom-pos``."""
    return F.concat_ws("-", chrom, pos.cast("string"))


def gene_length(start: Column, end: Column) -> Column:
    return end - start + 1


def strand_matches(strand: Column, wanted: str) -> Column:
    """``+`` or ``-`` must agree; ``.`` takes any strand."""
    if wanted not in ("+", "-", "."):
        raise ValueError("strand must be '+', '-' or '.'")
    return F.lit(True) if wanted == "." else strand == wanted


def genotype_code(sample: Column, ref: Column, alts: Column) -> Column:
    """Code 1..10 of the unordered base pair called in a sample field, else 0.

    ``sample`` is the VCF sample field (GT before the first ``:``), ``ref`` the
    REF text, ``alts`` the ALT texts. An allele stands for the first base of its
    text. Haploid, missing and out-of-range calls give 0, as do other letters.
    """
    bases = F.concat(F.array(ref), alts)
    # plain text search instead of a regular expression: this runs once per call
    two = F.substring_index(F.replace(F.substring_index(sample, ":", 1), F.lit("|"), F.lit("/")), "/", 2)

    def base(allele: Column) -> Column:
        # checked before the cast: a failing try_cast costs an exception per call
        number = F.when(allele.rlike("^[0-9]{1,6}$"), allele).try_cast("int")
        return F.substring(F.get(bases, number), 1, 1)

    one = base(F.substring_index(two, "/", 1))
    other = base(F.when(two.contains("/"), F.substring_index(two, "/", -1)))
    order = F.array(*[F.lit(p) for p in GENOTYPE_PAIRS])
    # a missing base makes both texts null, an unordered pair is listed one way
    found = F.greatest(F.array_position(order, F.concat(one, other)), F.array_position(order, F.concat(other, one)))
    return F.coalesce(found, F.lit(0)).cast("tinyint")


def onehot_position(snp_idx: Column, code: Column, bits: int = ONEHOT_BITS) -> Column:
    """Set bit of a code in the one-hot vector; null for code 0."""
    return F.when(code > 0, snp_idx.cast("bigint") * bits + code - 1)


def onehot_positions(snp_idx: Column, bits: int = ONEHOT_BITS) -> Column:
    """All vector positions that belong to a SNP index, ascending."""
    first = snp_idx.cast("bigint") * bits
    return F.sequence(first, first + (bits - 1))
