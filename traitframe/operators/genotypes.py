"""Gene ranges, SNP-to-gene matching and genotype matrices.

Canonical tables: ``genes(gene_id, seqid, start, end, strand, feature_type,
len)``, ``sites(snp_id, chrom, pos, ref, alts, ...)``, ``calls(ID, snp_id,
code)`` and ``edges(snp_id, block_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitframe.constants import BROADCAST_ROWS, ONEHOT_BITS, SALTS
from traitframe.functions.genome import onehot_position, sequence_name, strand_matches
from traitframe.operators.joins import one_per_key, require_rows, shuffled, sized_join
from traitframe.operators.positions import sorted_positions
from traitframe.session import stage

BIN_WIDTH = 1 << 14
# a bin holds 2**BIN_STEP bins of the level below; positions of 64 bits end in one bin at the last level
BIN_STEP = 3
BIN_LEVELS = 22
LIST_CHUNK = 4096


def latest_genes(genes: DataFrame, order: str = "line_no") -> DataFrame:
    """The last record of every gene ID."""
    return one_per_key(genes, ["gene_id"], F.col(order), last=True)


def latest_sites(sites: DataFrame, order: str = "line_no") -> DataFrame:
    """The last record of every SNP ID."""
    return one_per_key(sites, ["snp_id"], F.col(order), last=True)


def current_sites(sites: DataFrame, order: str = "line_no") -> DataFrame:
    """Saved site rows without those that a later record of the same SNP ID replaces.

    Repeated IDs are found among (ID, order) pairs, and only the places of
    superseded rows meet the wide table.
    """
    keys = sites.select("snp_id", order)
    last = keys.groupBy("snp_id").agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("snp_id", "_last")
    old = stage(keys.join(shuffled(last), "snp_id").where(F.col(order) < F.col("_last")).select("snp_id", order), "superseded")
    return sites if old.isEmpty() else sized_join(sites, old, ["snp_id", order], "left_anti", salt_by=[order], staged=True)


def snps_in_genes(
    sites: DataFrame,
    genes: DataFrame,
    strand: str = ".",
    normalize_sites: bool = True,
    bin_width: int = BIN_WIDTH,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Edges (snp_id, block_id): ``start <= pos <= end`` on the same sequence.

    Bins form a tree: eight bins of a level make one of the next. A gene is one
    row, in the smallest bin that holds it whole, whatever its length; a SNP
    looks at one bin of each level that some gene is in, and the range test
    follows an equality join on (sequence, level, bin). The gene side is
    counted: small ones are broadcast and SNPs never move, large ones are salted
    by SNP so that a crowded bin is shared by many tasks. Genes or SNPs without
    a position match nothing. ``normalize_sites=False`` compares site names as
    written.
    """
    binned = stage(gene_bins(genes.where(strand_matches(F.col("strand"), strand)), bin_width), "gene-bins")
    levels = binned.agg(F.array_compact(F.collect_set("_level")).alias("levels"))
    chrom = sequence_name(F.col("chrom")) if normalize_sites else F.col("chrom")
    points = sites.select("snp_id", chrom.alias("_seq"), "pos", F.floor(F.col("pos") / bin_width).alias("_lowest"))
    points = points.withColumn("_level", F.explode(levels.scalar()))
    points = points.withColumn("_bin", _bin_at(F.col("_lowest"), F.col("_level"))).drop("_lowest")
    pairs = sized_join(points, binned, ["_seq", "_level", "_bin"], salt_by=["snp_id"], max_rows=max_rows, salts=salts, staged=True)
    return pairs.where(F.col("pos").between(F.col("_from"), F.col("_to"))).select("snp_id", "block_id")


def _bin_at(lowest: Column, level: Column) -> Column:
    """The bin of a level that holds a bin of the lowest one."""
    shifted = F.call_function("shiftright", lowest, (F.lit(BIN_STEP) * level).cast("int"))
    return F.when(level >= BIN_LEVELS, F.lit(0).cast("bigint")).otherwise(shifted)


def gene_bins(genes: DataFrame, bin_width: int = BIN_WIDTH) -> DataFrame:
    """(block_id, _seq, _from, _to, _level, _bin): one row per gene, in the smallest bin that holds both ends.

    The highest bit in which the lowest bins of start and end differ tells the level.
    """
    first, last = F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width)
    apart = first.bitwiseXOR(last)
    level = F.when(apart == 0, F.lit(0)).otherwise(F.ceil(F.length(F.bin(apart)) / BIN_STEP)).cast("int")
    named = genes.select(F.col("gene_id").alias("block_id"), F.col("seqid").alias("_seq"), F.col("start").alias("_from"), F.col("end").alias("_to"), level.alias("_level"), first.alias("_first"))
    return named.withColumn("_bin", _bin_at(F.col("_first"), F.col("_level"))).drop("_first")


def snp_index(edges: DataFrame) -> DataFrame:
    """(snp_id, snp_idx): position of a matched SNP in the sorted list of SNP IDs."""
    # three passes over a thin table: write it rather than match SNPs again
    return sorted_positions(stage(edges.select("snp_id").distinct(), "snp-ids"), "snp_id", out="snp_idx")


def block_ids(edges: DataFrame) -> DataFrame:
    """Genes that hold at least one SNP."""
    return edges.select("block_id").distinct()


def block_snp_lists(edges: DataFrame, index: DataFrame, chunk: int = LIST_CHUNK) -> DataFrame:
    """Sorted SNP indices of every block, in list chunks.

    Chunk ``c`` holds the indices ``c*chunk .. c*chunk + chunk - 1``, so a list
    never exceeds ``chunk`` entries however many SNPs a block has; the chunks of
    a block in order are its whole list.
    """
    numbered = edges.join(shuffled(index), "snp_id")
    part = F.floor(F.col("snp_idx") / chunk).cast("bigint")
    return numbered.groupBy("block_id", part.alias("chunk")).agg(F.sort_array(F.collect_list("snp_idx")).alias("snp_idx"))


def counts(genes: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: genes read, samples, matched SNPs and blocks with SNPs."""
    return genes.agg(F.count(F.lit(1)).alias("n_genes")).select(
        "n_genes",
        calls.agg(F.countDistinct("ID")).scalar().alias("n_samples"),
        edges.agg(F.countDistinct("snp_id")).scalar().alias("n_snps"),
        edges.agg(F.countDistinct("block_id")).scalar().alias("n_blocks"),
    )


def calls_in_genes(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls of matched SNPs only."""
    return sized_join(calls, edges.select("snp_id").distinct(), ["snp_id"], "left_semi", salt_by=["ID"])


def sites_in_genes(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Site rows of matched SNPs only: the same on packed codes."""
    return sized_join(sites, edges.select("snp_id").distinct(), ["snp_id"], "left_semi", salt_by=["snp_id"])


def _set_bits(numbered: DataFrame, samples: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Bits of numbered site rows by sample, made last."""
    cells = F.arrays_zip(F.col("_names").alias("ID"), F.col("codes").alias("code"))
    spread = numbered.withColumn("_names", samples.scalar()).select(*keys, "snp_idx", F.inline(cells))
    spread = spread.where((F.col("code") > 0) & F.col("ID").isNotNull())
    return spread.select("ID", *keys, onehot_position(F.col("snp_idx"), F.col("code"), bits).alias("bit"))


def onehot_sites(sites: DataFrame, samples: DataFrame, index: DataFrame, bits: int = ONEHOT_BITS) -> DataFrame:
    """:func:`onehot_calls` from site rows: they are numbered before samples are told apart."""
    return _set_bits(sized_join(sites.select("snp_id", "codes"), index, ["snp_id"], salt_by=["snp_id"]), samples, [], bits)


def onehot_sites_by_block(sites: DataFrame, samples: DataFrame, edges: DataFrame, index: DataFrame, bits: int = ONEHOT_BITS) -> DataFrame:
    """:func:`onehot_calls_by_block` from site rows."""
    placed = sized_join(sites.select("snp_id", "codes"), edges.join(shuffled(index), "snp_id"), ["snp_id"], salt_by=["snp_id"])
    return _set_bits(placed, samples, ["block_id"], bits)


def onehot_calls(calls: DataFrame, index: DataFrame, bits: int = ONEHOT_BITS) -> DataFrame:
    """Set bits (ID, bit) of the one-hot genotype vectors; code 0 sets none."""
    called = calls.where(F.col("code") > 0)
    numbered = sized_join(called, index, ["snp_id"], salt_by=["ID"])
    return numbered.select("ID", onehot_position(F.col("snp_idx"), F.col("code"), bits).alias("bit"))


def onehot_calls_by_block(calls: DataFrame, edges: DataFrame, index: DataFrame, bits: int = ONEHOT_BITS) -> DataFrame:
    """Set bits (ID, block_id, bit); ``bit`` keeps its place in the whole vector."""
    placed = edges.join(shuffled(index), "snp_id")
    numbered = sized_join(calls.where(F.col("code") > 0), placed, ["snp_id"], salt_by=["ID"])
    return numbered.select("ID", "block_id", onehot_position(F.col("snp_idx"), F.col("code"), bits).alias("bit"))


def onehot_vectors(bits_set: DataFrame, size: int) -> DataFrame:
    """Sparse vector per sample: (ID, size, indices); all values are 1."""
    return bits_set.groupBy("ID").agg(F.sort_array(F.collect_list("bit")).alias("indices")).select(
        "ID", F.lit(size).cast("bigint").alias("size"), "indices"
    )


def matched_or_error(edges: DataFrame) -> DataFrame:
    return require_rows(edges, "no SNP lies in any gene")
