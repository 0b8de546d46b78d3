"""GFF3 and VCF reading, SNP-to-gene matching, genotype matrices and block embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.inputs import K_INNER, K_OUTER, N_FRAGMENTS, with_
from catalog.registry import query, r6
from traitframe.functions import genome as g
from traitframe.operators import blocks, genotypes, joint_blocks, positions
from traitframe.operators.folds import random_fragments, with_folds
from traitframe.operators.joins import shuffled, sized_join
from traitframe.session import new_path, stage
from traitframe.sources import folds as fold_files
from traitframe.sources import genome, sinks, site_store, tables

MATCHED = (i.GENES, i.SITES, i.EDGES)


def _sites(spark, sf):
    return genome.sites_from_lines(i.vcf_lines(spark, sf))


def _calls(spark, sf):
    lines = i.vcf_lines(spark, sf)
    return genome.calls_from_sites(genome.sites_from_lines(lines), genome.vcf_samples(lines))


def _calls_in_genes(spark, sf, edges):
    lines = i.vcf_lines(spark, sf)
    return genome.calls_from_sites(genotypes.sites_in_genes(genome.sites_from_lines(lines), edges), genome.vcf_samples(lines))


def _edges(spark, sf, **options):
    return genotypes.snps_in_genes(genome.site_positions(i.vcf_lines(spark, sf)), genome.genes_from_lines(i.gff_lines(spark, sf)), **options)


def _saved_edges(spark, sf):
    """Matched once, for queries that use them more than once."""
    return stage(_edges(spark, sf), "edges")


@query("s4_gff_genes", with_(i.GENES) + """SELECT gene_id, seqid, start, "end", strand, 'gene' AS feature_type, "end" - start + 1 AS len FROM genes""")
def s4(spark, sf):
    path = new_path(spark, "s4") + ".gff3"
    i.gff_lines(spark, sf).select("value").write.text(path)
    return genome.read_gff_genes(spark, path)


@query("s5_vcf_calls", with_(i.SITES, i.CALLS) + "SELECT ID, snp_id, code FROM calls")
def s5(spark, sf):
    path = new_path(spark, "s5") + ".vcf"
    i.vcf_lines(spark, sf).select("value").write.text(path)
    return genome.read_vcf_calls(spark, path).withColumn("code", F.col("code").cast("int"))


@query("s14_genotype_writer", with_(*MATCHED) + "SELECT snp_id, block_id FROM edges")
def s14(spark, sf):
    path, edges = new_path(spark, "s14"), _saved_edges(spark, sf)
    sinks.write_genotypes(_calls_in_genes(spark, sf, edges), edges, path)
    return tables.read_genotypes(spark, path)["snp_block"]


@query("s3_genotype_scan", with_(*MATCHED, i.CALLS) + "SELECT ID, snp_id, code FROM calls WHERE snp_id IN (SELECT snp_id FROM edges)")
def s3(spark, sf):
    path, edges = new_path(spark, "s3"), _saved_edges(spark, sf)
    sinks.write_genotypes(_calls_in_genes(spark, sf, edges), edges, path)
    return tables.read_genotypes(spark, path)["genotypes"].withColumn("code", F.col("code").cast("int"))


def _stored(spark, sf):
    path, lines = new_path(spark, "site-store"), i.vcf_lines(spark, sf)
    site_store.write_site_store(stage(genome.sites_from_lines(lines), "sites"), genome.vcf_samples(lines), _saved_edges(spark, sf), path, sample_block=16)
    return path


@query("s14_site_store", with_(*MATCHED, i.CALLS) + "SELECT ID, snp_id, code FROM calls WHERE snp_id IN (SELECT snp_id FROM edges)")
def s14_store(spark, sf):
    """Packed codes by site, in blocks of samples, read back as calls."""
    return site_store.site_calls(spark, _stored(spark, sf)).withColumn("code", F.col("code").cast("int"))


@query(
    "s3_site_store_range",
    with_(*MATCHED, i.CALLS) + "SELECT ID, snp_id, code FROM calls JOIN sites USING (snp_id) WHERE snp_id IN (SELECT snp_id FROM edges) AND chrom = 'chr2' AND pos BETWEEN 5000 AND 90000",
)
def s3_range(spark, sf):
    """The calls of one place; row groups beyond its bounds are skipped."""
    path = _stored(spark, sf)
    return site_store.site_calls(spark, path, site_store.read_sites(spark, path, ("2", 5000, 90000))).withColumn("code", F.col("code").cast("int"))


@query("p3_feature_type", "SELECT 'G' || p_partkey AS gene_id, count(*) + CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END AS n FROM part GROUP BY p_partkey")
def p3(spark, sf):
    return genome.parse_genes(i.gff_lines(spark, sf)).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))


SEQ_NAMES = "CASE c_custkey % 4 WHEN 0 THEN 'Chr' || c_nationkey WHEN 1 THEN 'CHR' || c_nationkey || '_chrUn' WHEN 2 THEN 'Scaffold' || c_nationkey ELSE c_mktsegment END"


@query(
    "p4_sequence_name",
    f"SELECT c_custkey, CASE WHEN contains(lower(n), 'chr') THEN replace(lower(n), 'chr', '') ELSE n END AS seqid FROM (SELECT c_custkey, {SEQ_NAMES} AS n FROM customer)",
)
def p4(spark, sf):
    return i.table(spark, sf, "customer").select("c_custkey", g.sequence_name(F.expr(SEQ_NAMES)).alias("seqid"))


@query(
    "p5_bad_records",
    """SELECT 'gff' AS kind, sum(2 + CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END)::BIGINT + 1 AS n_lines,
      sum(1 + CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_kept FROM part
    UNION ALL SELECT 'vcf', sum(3 + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END)::BIGINT + 2,
      sum(3 + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END - CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END)::BIGINT FROM part""",
)
def p5(spark, sf):
    def both(kind, lines, kept):
        return lines.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_lines")).withColumn("n_kept", kept.agg(F.count(F.lit(1))).scalar())

    gff, vcf = i.gff_lines(spark, sf), i.vcf_lines(spark, sf)
    return both("gff", gff, genome.parse_genes(gff)).unionByName(both("vcf", vcf, genome.parse_sites(vcf)))


@query(
    "p5_reasons",
    """SELECT 'gff' AS kind, 'position' AS reason, count(*) AS n FROM part WHERE p_partkey % 19 = 0
    UNION ALL SELECT 'vcf', 'position', count(*) FROM part WHERE p_partkey % 13 = 0""",
)
def p5_reasons(spark, sf):
    """Malformed records by what is wrong with them."""
    gff = genome.malformed_genes(i.gff_lines(spark, sf)).select(F.lit("gff").alias("kind"), "reason")
    vcf = genome.malformed_sites(i.vcf_lines(spark, sf)).select(F.lit("vcf").alias("kind"), "reason")
    return gff.unionByName(vcf).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("p6_strand", with_(*MATCHED) + "SELECT snp_id, block_id FROM edges JOIN genes ON gene_id = block_id WHERE strand = '-'")
def p6(spark, sf):
    return _edges(spark, sf, strand="-")


@query("p7_snp_id", with_(i.SITES) + "SELECT chrom, pos, chrom || '-' || pos AS snp_id FROM sites")
def p7(spark, sf):
    return _sites(spark, sf).select("chrom", "pos", g.snp_name(F.col("chrom"), F.col("pos")).alias("snp_id"))


FIELD = f"element_at(array({', '.join(repr(t) for t in i.GT_TEXTS)}), CAST((l_orderkey + l_linenumber * 3) % 10 + 1 AS INT))"


@query(
    "p8_gt_code",
    f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {i.GT_TEXTS!r}[(l_orderkey + l_linenumber * 3) % 10 + 1] AS gt,
        substr('ACGTaN', CAST(l_partkey % 6 + 1 AS INT), 1) || 'T' AS ref, substr('GTCAcA', CAST(l_suppkey % 6 + 1 AS INT), 1) AS alt FROM lineitem),
      s AS (SELECT *, split_part(replace(gt, '|', '/'), '/', 1) AS a, split_part(replace(gt, '|', '/'), '/', 2) AS b FROM f),
      bases AS (SELECT *, CASE a WHEN '0' THEN substr(ref, 1, 1) WHEN '1' THEN alt END AS one, CASE b WHEN '0' THEN substr(ref, 1, 1) WHEN '1' THEN alt END AS two FROM s)
      SELECT l_orderkey, l_linenumber, l_partkey, gt, CAST(CASE WHEN one IS NULL OR two IS NULL THEN 0 ELSE
        coalesce(list_position(['AA','CC','GG','TT','AC','AG','AT','CG','CT','GT'], least(one, two) || greatest(one, two)), 0) END AS INT) AS code FROM bases""",
)
def p8(spark, sf):
    rows = i.table(spark, sf, "lineitem")
    ref = F.concat(F.substr(F.lit("ACGTaN"), (F.col("l_partkey") % 6 + 1).cast("int"), F.lit(1)), F.lit("T"))
    alt = F.substr(F.lit("GTCAcA"), (F.col("l_suppkey") % 6 + 1).cast("int"), F.lit(1))
    gt = F.expr(FIELD)
    code = g.genotype_code(F.concat(gt, F.lit(":12,3")), ref, F.array(alt))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", gt.alias("gt"), code.cast("int").alias("code"))


@query("p9_onehot", with_(*MATCHED, i.CALLS, i.INDEX) + "SELECT ID, snp_idx * 10 + code - 1 AS bit FROM calls JOIN snp_idx USING (snp_id) WHERE code > 0")
def p9(spark, sf):
    lines = i.vcf_lines(spark, sf)
    return genotypes.onehot_sites(genome.sites_from_lines(lines), genome.vcf_samples(lines), genotypes.snp_index(_edges(spark, sf)))


@query(
    "p9_onehot_by_gene",
    with_(*MATCHED, i.CALLS, i.INDEX)
    + "SELECT ID, block_id, count(*) AS n_bits, CAST(sum(snp_idx * 10 + code - 1) AS BIGINT) AS bit_sum FROM calls JOIN snp_idx USING (snp_id) JOIN edges USING (snp_id) WHERE code > 0 GROUP BY ALL",
)
def p9_gene(spark, sf):
    edges, lines = _saved_edges(spark, sf), i.vcf_lines(spark, sf)
    bits = genotypes.onehot_sites_by_block(genome.sites_from_lines(lines), genome.vcf_samples(lines), edges, genotypes.snp_index(edges))
    return bits.groupBy("ID", "block_id").agg(F.count(F.lit(1)).alias("n_bits"), F.sum("bit").alias("bit_sum"))


@query("p10_index_expansion", with_(*MATCHED, i.INDEX) + "SELECT snp_id, snp_idx * 10 + b AS bit FROM snp_idx, range(10) t(b)")
def p10(spark, sf):
    index = genotypes.snp_index(_edges(spark, sf))
    return index.select("snp_id", F.explode(g.onehot_positions(F.col("snp_idx"))).alias("bit"))


@query("p16_gene_length", with_(i.GENES) + """SELECT gene_id, "end" - start + 1 AS len FROM genes""")
def p16(spark, sf):
    return genome.genes_from_lines(i.gff_lines(spark, sf)).select("gene_id", "len")


@query("j4_snp_gene", with_(*MATCHED) + "SELECT snp_id, block_id FROM edges")
def j4(spark, sf):
    return _edges(spark, sf)


@query("j4_snp_gene_salted", with_(*MATCHED) + "SELECT snp_id, block_id FROM edges")
def j4_salted(spark, sf):
    """The way taken when the gene table is too large to broadcast."""
    return _edges(spark, sf, max_rows=0, salts=4, bin_width=1000)


@query("w5_snp_index", with_(*MATCHED, i.INDEX) + "SELECT snp_id, snp_idx FROM snp_idx")
def w5_snp(spark, sf):
    return genotypes.snp_index(_edges(spark, sf))


@query(
    "a10_block_snps",
    with_(*MATCHED, i.INDEX) + "SELECT block_id, string_agg(CAST(snp_idx AS VARCHAR), ',' ORDER BY snp_idx) AS snps FROM edges JOIN snp_idx USING (snp_id) GROUP BY block_id, snp_idx // 4096",
)
def a10(spark, sf):
    edges = _saved_edges(spark, sf)
    lists = genotypes.block_snp_lists(edges, genotypes.snp_index(edges))
    return lists.select("block_id", F.array_join(F.col("snp_idx").cast("array<string>"), ",").alias("snps"))


@query("a11_last_wins", with_(i.SITES) + "SELECT snp_id, ref, alt FROM sites")
def a11(spark, sf):
    return genotypes.latest_sites(genome.parse_sites(i.vcf_lines(spark, sf))).select("snp_id", "ref", F.array_join("alts", ",").alias("alt"))


@query("a12_distinct_blocks", with_(*MATCHED) + "SELECT DISTINCT block_id FROM edges")
def a12(spark, sf):
    return genotypes.block_ids(_edges(spark, sf))


@query(
    "a13_counts",
    with_(*MATCHED) + """SELECT (SELECT count(*) FROM genes) AS n_genes, (SELECT count(*) FROM nation) AS n_samples,
    count(DISTINCT snp_id) AS n_snps, count(DISTINCT block_id) AS n_blocks FROM edges""",
)
def a13(spark, sf):
    genes, edges = genome.genes_from_lines(i.gff_lines(spark, sf)), genotypes.matched_or_error(_saved_edges(spark, sf))
    return genotypes.counts(genes, _calls(spark, sf), edges)


EMBEDDED = """embedded AS (
  SELECT c.ID, e.block_id, sum(coalesce(w.w, 0)) AS value FROM calls c JOIN edges e ON e.snp_id = c.snp_id
  LEFT JOIN weights w ON w.snp_id = c.snp_id AND w.block_id = e.block_id AND w.code = c.code GROUP BY ALL)"""
EMBED = (*MATCHED, i.CALLS, i.WEIGHTS, EMBEDDED)


def _embedded(spark, sf):
    edges, lines = _saved_edges(spark, sf), i.vcf_lines(spark, sf)
    return joint_blocks.block_embed_sites(genome.sites_from_lines(lines), genome.vcf_samples(lines), edges, i.weights(edges))


@query("m3_block_embed_calls", with_(*EMBED) + "SELECT ID, block_id, round(value, 6) + 0e0 AS value FROM embedded")
def m3_calls(spark, sf):
    """From a table of calls in long form, as another reader may give it."""
    edges = _saved_edges(spark, sf)
    return blocks.block_embed(_calls(spark, sf), edges, i.weights(edges)).select("ID", "block_id", r6("value").alias("value"))


@query("m3_block_embed", with_(*EMBED) + "SELECT ID, block_id, round(value, 6) + 0e0 AS value FROM embedded")
def m3(spark, sf):
    return _embedded(spark, sf).select("ID", "block_id", r6("value").alias("value"))


@query(
    "j9_snp_block_weight",
    with_(*MATCHED, i.WEIGHTS) + "SELECT snp_id, block_id, round(sum(w * code), 6) + 0e0 AS checksum FROM weights GROUP BY ALL",
)
def j9(spark, sf):
    edges = _saved_edges(spark, sf)
    listed = blocks.weights_per_edge(edges, i.weights(edges))
    total = F.aggregate(F.transform("w", lambda w, k: w * (k + 1)), F.lit(0.0), lambda a, b: a + b)
    return listed.select("snp_id", "block_id", r6(total).alias("checksum"))


@query("a6_block_sum", with_(*EMBED) + "SELECT block_id, count(*) AS n, round(sum(value), 6) + 0e0 AS total FROM embedded GROUP BY ALL")
def a6(spark, sf):
    return _embedded(spark, sf).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


TARGETS = """samples AS (SELECT n_name AS ID FROM nation)""", i.FRAGMENTS, i.ROLES, """targets AS (
  SELECT f.ID, f.fragment, n.n_regionkey * 1.5e0 + n.n_nationkey % 7 AS y FROM fragments f JOIN nation n ON n.n_name = f.ID)"""
FITTED = """level AS (SELECT r.x_outer, r.x_inner, avg(y) AS mean FROM targets t JOIN roles r USING (fragment) WHERE r.split = 'trn' GROUP BY ALL),
fitted AS (
  SELECT r.x_outer, r.x_inner, c.snp_id, c.code, (sum(t.y) - count(*) * any_value(l.mean)) / (count(*) + 1) AS w
  FROM calls c JOIN targets t USING (ID) JOIN roles r USING (fragment) JOIN level l ON l.x_outer = r.x_outer AND l.x_inner = r.x_inner
  WHERE r.split = 'trn' AND c.code > 0 GROUP BY ALL),
fitted_weights AS (
  SELECT f.x_outer, f.x_inner, e.block_id, f.snp_id, f.code, f.w / (SELECT count(*) FROM edges x WHERE x.block_id = e.block_id) AS w
  FROM fitted f JOIN edges e USING (snp_id))"""
FIT = (*MATCHED, i.CALLS, *TARGETS, FITTED)


def _targets(spark, sf):
    nation = i.table(spark, sf, "nation").select(F.col("n_name").alias("ID"), (F.col("n_regionkey") * 1.5 + F.col("n_nationkey") % 7).alias("y"))
    return random_fragments(nation, N_FRAGMENTS).select("ID", "fragment", "y")


@query("m2_block_weight_fit", with_(*FIT) + "SELECT x_outer, x_inner, block_id, snp_id, code, round(w, 6) + 0e0 AS w FROM fitted_weights")
def m2(spark, sf):
    fitted = blocks.fit_block_weights(_calls(spark, sf), _saved_edges(spark, sf), _targets(spark, sf), K_OUTER, K_INNER)
    return fitted.select("x_outer", "x_inner", "block_id", "snp_id", F.col("code").cast("int").alias("code"), r6("w").alias("w"))


@query(
    "s12_block_embedding_writer",
    with_(*FIT) + """SELECT r.x_outer, r.x_inner, r.split, c.ID, e.block_id, round(sum(coalesce(w.w, 0)), 6) + 0e0 AS value
    FROM calls c JOIN edges e ON e.snp_id = c.snp_id JOIN fragments f ON f.ID = c.ID JOIN roles r ON r.fragment = f.fragment
    LEFT JOIN fitted_weights w ON w.snp_id = c.snp_id AND w.block_id = e.block_id AND w.code = c.code AND w.x_outer = r.x_outer AND w.x_inner = r.x_inner
    GROUP BY ALL""",
)
def s12(spark, sf):
    lines = i.vcf_lines(spark, sf)
    sites, edges, targets = stage(genome.sites_from_lines(lines), "sites"), _saved_edges(spark, sf), _targets(spark, sf)
    names = genome.vcf_samples(lines)
    fitted = blocks.fit_block_weights(genome.calls_from_sites(sites, names), edges, targets, K_OUTER, K_INNER)
    embedded = joint_blocks.block_embed_sites(sites, names, edges, fitted)
    split = with_folds(targets.select("ID", "fragment"), K_OUTER, K_INNER).drop("fragment")
    path = new_path(spark, "s12")
    sinks.write_block_embedding(sized_join(embedded, split, ["ID", "x_outer", "x_inner"], salt_by=["block_id"]), path)
    return fold_files.read_folds(spark, path).select("x_outer", "x_inner", "split", "ID", "block_id", r6("value").alias("value"))


# The weights of a joint fit are not SQL's to tell, but what makes them right is: at the least of a ridge regression the
# gradient is zero for every bit that a training row has, and those bits SQL can list.
JOINT_BITS = """FROM calls c JOIN edges e USING (snp_id) JOIN targets t USING (ID) JOIN roles r USING (fragment)
  WHERE r.split = 'trn' AND c.code > 0 GROUP BY ALL"""


def _gradients(spark, sf, classes=0, l2=1.0):
    """Gradient of the fitted weights, from embeddings and calls, with the intercept at its best."""
    lines = i.vcf_lines(spark, sf)
    sites, edges = stage(genome.sites_from_lines(lines), "sites"), _saved_edges(spark, sf)
    names, targets = genome.vcf_samples(lines), _targets(spark, sf)
    if classes:
        region = i.table(spark, sf, "nation").select(F.col("n_name").alias("ID"), F.col("n_regionkey").cast("double").alias("y"))
        targets = targets.drop("y").join(shuffled(region), "ID")
    weights = stage(joint_blocks.fit_joint_block_weights(sites, names, edges, targets, K_OUTER, K_INNER, l2, classes), "joint-weights")
    fold = ["x_outer", "x_inner"]
    train = with_folds(targets, K_OUTER, K_INNER).where("split = 'trn'").withColumn("omega", F.lit(1.0))
    if classes:
        sizes = train.groupBy(*fold, "y").agg(F.count(F.lit(1)).alias("n"))
        total = sizes.groupBy(*fold).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        share = sizes.join(F.broadcast(total), fold).select(*fold, "y", (F.col("all") / F.col("kinds") / F.col("n")).alias("omega"))
        train = train.drop("omega").join(F.broadcast(share), [*fold, "y"])
    rows = []
    for c in range(max(classes, 1)):
        own = weights.where(F.col("class") == c).drop("class") if classes else weights
        goal = (F.col("y") == c).cast("double") if classes else F.col("y")
        value = joint_blocks.block_embed_sites(sites, names, edges, own)
        left = value.join(F.broadcast(train.select(*fold, "ID", "omega", goal.alias("goal"))), [*fold, "ID"]).withColumn("left", F.col("goal") - F.col("value"))
        base = left.groupBy(*fold, "block_id").agg((F.sum(F.col("omega") * F.col("left")) / F.sum("omega")).alias("base"))
        left = left.join(shuffled(base), [*fold, "block_id"]).select(*fold, "block_id", "ID", (F.col("omega") * (F.col("left") - F.col("base"))).alias("pull"))
        at = genome.calls_from_sites(sites, names).where("code > 0").join(shuffled(edges), "snp_id").withColumn("code", F.col("code").cast("int"))
        pulls = left.join(shuffled(at), ["ID", "block_id"]).groupBy(*fold, "block_id", "snp_id", "code").agg(F.sum("pull").alias("pull"))
        keys = [*fold, "block_id", "snp_id", "code"]
        rows.append(pulls.join(shuffled(own), keys, "full").select(F.lit(c).alias("class"), *keys, r6(F.col("pull") - l2 * F.col("w")).alias("gradient")))
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    return found


@query("m2_joint_block_weights", with_(*MATCHED, i.CALLS, *TARGETS) + f"SELECT r.x_outer, r.x_inner, e.block_id, c.snp_id, c.code, 0e0 AS gradient {JOINT_BITS}")
def m2_joint(spark, sf):
    return _gradients(spark, sf).drop("class")


@query(
    "m2_joint_block_weights_classes",
    with_(*MATCHED, i.CALLS, *TARGETS)
    + f"SELECT CAST(k AS INT) AS class, g.* FROM range(5) x(k), (SELECT r.x_outer, r.x_inner, e.block_id, c.snp_id, c.code, 0e0 AS gradient {JOINT_BITS}) g",
)
def m2_joint_classes(spark, sf):
    return _gradients(spark, sf, classes=5)
