"""Input tables of the queries, derived from the test tables; in Spark and as SQL ``WITH`` parts.

Nothing is sampled: each derivation reads its whole table, so its size grows
with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.functions.genome import sequence_name

K_OUTER, K_INNER = 4, 3
N_FRAGMENTS = K_OUTER * K_INNER


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small file over all cores before each of them becomes many.

    One Parquet row group is one task; the text lines and cells made from it
    stand for large inputs of many splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


# --- feature tables: 64 dimensions in two omics tables, with gaps and a constant ---


def omics_long(spark: SparkSession, sf: str) -> DataFrame:
    cells = spread(table(spark, sf, "embeddings")).select("vec_id", F.posexplode("embedding").alias("i", "v"))
    value = F.when((F.col("vec_id") * 31 + F.col("i")) % 17 == 0, None).when(F.col("i") == 31, 1.0).otherwise(F.col("v").cast("double"))
    return cells.select(
        F.col("vec_id").cast("string").alias("ID"),
        F.when(F.col("i") < 32, "a").otherwise("b").alias("omics"),
        (F.col("i") % 32).cast("int").alias("feature_idx"),
        F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("feature"),
        value.alias("value"),
    )


# stored once: the filter on the statistics must not change the order of the joins
OMICS = """omics AS MATERIALIZED (
  SELECT CAST(vec_id AS VARCHAR) AS ID, CASE WHEN i < 32 THEN 'a' ELSE 'b' END AS omics, CAST(i % 32 AS INT) AS feature_idx,
         'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature,
         CASE WHEN (vec_id * 31 + i) % 17 = 0 THEN NULL WHEN i = 31 THEN 1.0 ELSE CAST(embedding[i + 1] AS DOUBLE) END AS value
  FROM embeddings, range(64) t(i))"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("ID"))


SAMPLES = "samples AS (SELECT CAST(vec_id AS VARCHAR) AS ID FROM embeddings)"


def wide_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in (0, 40, 10)]
    height = e[0] * 20 - e[1] * 10 + e[2] * 5 + 100
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("ID"),
        F.when(F.col("vec_id") % 23 == 0, None).otherwise(height).alias("height"),
        F.col("label").cast("double").alias("grade"),
    )


WIDE_LABELS = """wide_labels AS (
  SELECT CAST(vec_id AS VARCHAR) AS ID,
         CASE WHEN vec_id % 23 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) * 20 - CAST(embedding[41] AS DOUBLE) * 10
              + CAST(embedding[11] AS DOUBLE) * 5 + 100 END AS height,
         CAST(label AS DOUBLE) AS grade
  FROM embeddings)"""

LABELS = """labels_long AS (
  SELECT ID, 'height' AS label, height AS y FROM wide_labels UNION ALL SELECT ID, 'grade', grade FROM wide_labels)"""

# --- folds --------------------------------------------------------------------

FRAGMENTS = f"""fragments AS (
  SELECT ID, CAST(ntile({N_FRAGMENTS}) OVER (ORDER BY md5('42|' || ID), ID) - 1 AS INT) AS fragment FROM samples)"""

# the oracle numbers the fragments outside the test part and cuts them with ntile
ROLES = f"""grid AS (SELECT CAST(o AS INT) AS x_outer, CAST(i AS INT) AS x_inner FROM range({K_OUTER}) a(o), range({K_INNER}) b(i)),
rest AS (
  SELECT CAST(o AS INT) AS x_outer, CAST(f AS INT) AS fragment, CAST(ntile({K_INNER}) OVER (PARTITION BY o ORDER BY f) - 1 AS INT) AS part
  FROM range({K_OUTER}) a(o), range({N_FRAGMENTS}) c(f) WHERE NOT (f >= o * {K_INNER} AND f < (o + 1) * {K_INNER})),
roles AS (
  SELECT g.x_outer, g.x_inner, CAST(f AS INT) AS fragment,
         CASE WHEN r.part IS NULL THEN 'tst' WHEN r.part = g.x_inner THEN 'val' ELSE 'trn' END AS split
  FROM grid g CROSS JOIN range({N_FRAGMENTS}) c(f) LEFT JOIN rest r ON r.x_outer = g.x_outer AND r.fragment = f)"""

# statistics of training rows, fitted directly on every fold's rows
STATS = """trained AS (
  SELECT r.x_outer, r.x_inner, t.omics, t.feature, t.value
  FROM omics t JOIN fragments f ON f.ID = t.ID JOIN roles r ON r.fragment = f.fragment WHERE r.split = 'trn'),
stats AS MATERIALIZED (
  SELECT x_outer, x_inner, omics, feature, count(*) AS n_rows, count(value) AS n, avg(value) AS mean,
         var_pop(value) * count(value) / count(*) AS variance, min(value) AS lo, max(value) AS hi
  FROM trained GROUP BY ALL)"""

PREPARED = [OMICS, SAMPLES, FRAGMENTS, ROLES, STATS]

# --- genes and variants --------------------------------------------------------


def gff_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    start, size = p * 100 + 1, F.col("p_size") * 40 + 60

    def record(j: int, kind: str, first, last, when=None):
        text = F.concat_ws(
            "\t", F.concat(F.lit("Chr"), p % 5), F.lit("maker"), F.lit(kind), first, last, F.lit("."),
            F.when(p % 2 == 0, "+").otherwise("-"), F.lit("."), F.concat(F.lit("Name=g;ID=G"), p, F.lit(";note=ID of gene")),
        )
        row = F.struct((p * 10 + j).alias("line_no"), text.alias("value"))
        return row if when is None else F.when(when, row)

    rows = F.array(
        record(1, "gene", start.cast("string"), (start + size).cast("string")),
        record(2, "mRNA", start.cast("string"), (start + size).cast("string")),
        record(3, "gene", F.lit("x1"), (start + size).cast("string"), p % 19 == 0),
        record(4, "gene", start.cast("string"), (start + size + 500).cast("string"), p % 29 == 0),
    )
    lines = spread(table(spark, sf, "part")).select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.line_no", "r.value")
    head = spark.range(1).select(F.lit(-1).cast("bigint").alias("line_no"), F.lit("##gff-version 3").alias("value"))
    return head.unionByName(lines)


GENES = """genes AS (
  SELECT 'G' || p_partkey AS gene_id, CAST(p_partkey % 5 AS VARCHAR) AS seqid, p_partkey * 100 + 1 AS start,
         p_partkey * 100 + 1 + p_size * 40 + 60 + CASE WHEN p_partkey % 29 = 0 THEN 500 ELSE 0 END AS "end",
         CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM part)"""


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """The gene table the GFF text stands for."""
    p = F.col("p_partkey")
    start = p * 100 + 1
    end = start + F.col("p_size") * 40 + 60 + F.when(p % 29 == 0, 500).otherwise(0)
    return table(spark, sf, "part").select(
        F.concat(F.lit("G"), p).alias("gene_id"), sequence_name(F.concat(F.lit("Chr"), p % 5)).alias("seqid"), start.alias("start"),
        end.alias("end"), F.when(p % 2 == 0, "+").otherwise("-").alias("strand"), F.lit("gene").alias("feature_type"), (end - start + 1).alias("len"),
    )


GT_TEXTS = ["0/0", "0/1", "1|1", "./.", "1|0", "1", ".", "0/2", "10/0", "0|."]
N_SAMPLES = 25  # rows of nation at every scale
TEN_ALTS = "C,G,T,A,C,G,T,A,C,G"


def _site(spark: SparkSession, sf: str) -> DataFrame:
    """Three positions per part, and a later record for some of them (j = 3)."""
    p = F.col("p_partkey")
    sites = spread(table(spark, sf, "part")).select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    sites = sites.where((F.col("j") < 3) | (p % 17 == 0)).withColumn("k", F.col("j") % 3)
    letters = F.lit("ACGT")
    ref = F.substr(letters, (p % 4 + 1).cast("int"), F.lit(1))
    alt = F.substr(letters, ((p + F.col("k") + 1) % 4 + 1).cast("int"), F.lit(1))
    alt = F.when(p % 37 == 0, TEN_ALTS).when(p % 11 == 0, "GT,C").when(p % 11 == 1, F.lower(alt)).otherwise(alt)
    return sites.select("p_partkey", "j", "k", ref.alias("ref"), alt.alias("alt"), (p * 100 + 1 + F.col("k") * 40).alias("pos"))


def vcf_lines(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    texts = F.array(*[F.lit(t) for t in GT_TEXTS])
    calls = F.transform(
        F.sequence(F.lit(0), F.lit(N_SAMPLES - 1)),
        lambda i: F.concat(F.get(texts, ((p * 7 + F.col("j") * 3 + i * 5) % 10).cast("int")), F.lit(":35")),
    )
    pos = F.when((F.col("j") == 1) & (p % 13 == 0), "x7").otherwise(F.col("pos").cast("string"))
    records = _site(spark, sf).select(
        (p * 10 + F.col("j")).alias("line_no"),
        F.concat_ws("\t", F.concat(F.lit("chr"), p % 5), pos, F.lit("."), "ref", "alt", F.lit("50"), F.lit("PASS"), F.lit("."), F.lit("GT:DP"), F.array_join(calls, "\t")).alias("value"),
    )
    names = table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))["n_name"].alias("names"))
    fixed = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"])
    head = names.select(F.lit(-1).cast("bigint").alias("line_no"), F.concat(F.lit(fixed + "\t"), F.array_join("names", "\t")).alias("value"))
    top = spark.range(1).select(F.lit(-2).cast("bigint").alias("line_no"), F.lit("##fileformat=VCFv4.2").alias("value"))
    return top.unionByName(head).unionByName(records)


SITES = f"""sites AS (
  SELECT p_partkey, j, j % 3 AS k, 'chr' || (p_partkey % 5) AS chrom, p_partkey * 100 + 1 + (j % 3) * 40 AS pos,
         'chr' || (p_partkey % 5) || '-' || (p_partkey * 100 + 1 + (j % 3) * 40) AS snp_id,
         substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS ref,
         CASE WHEN p_partkey % 37 = 0 THEN '{TEN_ALTS}' WHEN p_partkey % 11 = 0 THEN 'GT,C'
              WHEN p_partkey % 11 = 1 THEN lower(substr('ACGT', CAST((p_partkey + j % 3 + 1) % 4 + 1 AS INT), 1))
              ELSE substr('ACGT', CAST((p_partkey + j % 3 + 1) % 4 + 1 AS INT), 1) END AS alt
  FROM part, range(4) t(j)
  WHERE (j < 3 OR p_partkey % 17 = 0) AND NOT (j = 1 AND p_partkey % 13 = 0)
  QUALIFY row_number() OVER (PARTITION BY p_partkey, j % 3 ORDER BY j DESC) = 1)"""

# genotype codes by spelling out each text's two bases
CALLS = f"""texts AS (SELECT i AS t, {GT_TEXTS!r}[i + 1] AS gt FROM range(10) x(i)),
alleles AS (
  SELECT t, gt, regexp_extract(gt, '^([0-9]+)[/|]([0-9]+)$', 1) AS a, regexp_extract(gt, '^([0-9]+)[/|]([0-9]+)$', 2) AS b FROM texts),
bases AS (
  SELECT s.snp_id, n.n_name AS ID,
         CASE WHEN al.a = '0' THEN s.ref WHEN al.a <> '' THEN substr(split_part(s.alt, ',', CAST(al.a AS INT)), 1, 1) END AS one,
         CASE WHEN al.b = '0' THEN s.ref WHEN al.b <> '' THEN substr(split_part(s.alt, ',', CAST(al.b AS INT)), 1, 1) END AS two
  FROM sites s CROSS JOIN nation n JOIN alleles al ON al.t = (s.p_partkey * 7 + s.j * 3 + n.n_nationkey * 5) % 10),
calls AS (
  SELECT ID, snp_id, CASE least(one, two) || greatest(one, two)
      WHEN 'AA' THEN 1 WHEN 'CC' THEN 2 WHEN 'GG' THEN 3 WHEN 'TT' THEN 4 WHEN 'AC' THEN 5
      WHEN 'AG' THEN 6 WHEN 'AT' THEN 7 WHEN 'CG' THEN 8 WHEN 'CT' THEN 9 WHEN 'GT' THEN 10 ELSE 0 END AS code
  FROM bases)"""

EDGES = """edges AS (
  SELECT s.snp_id, g.gene_id AS block_id FROM sites s JOIN genes g
  ON g.seqid = replace(s.chrom, 'chr', '') AND s.pos BETWEEN g.start AND g."end")"""

INDEX = """snp_idx AS (
  SELECT snp_id, row_number() OVER (ORDER BY snp_id) - 1 AS snp_idx FROM (SELECT DISTINCT snp_id FROM edges))"""

WEIGHTS = """weights AS (
  SELECT e.block_id, e.snp_id, c AS code, ((length(e.snp_id) * 7 + length(e.block_id) * 3 + c * 5) % 11 - 5) / 10.0e0 AS w
  FROM edges e, range(1, 11) t(c))"""


def weights(edges: DataFrame) -> DataFrame:
    """Made-up weights per (block, SNP, code)."""
    rows = edges.withColumn("code", F.explode(F.sequence(F.lit(1), F.lit(10))))
    w = ((F.length("snp_id") * 7 + F.length("block_id") * 3 + F.col("code") * 5) % 11 - 5) / F.lit(10.0)
    return rows.select("block_id", "snp_id", "code", w.alias("w"))


# --- trial log ------------------------------------------------------------------


def trial_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 10).cast("int").alias("x_outer"),
        (F.col("event_id") % 5).cast("int").alias("x_inner"),
        F.round(F.col("value") * 0.9 + F.col("event_id") % 7, 4).alias("test_loss"),
        F.col("value").alias("val_loss"),
        F.concat(F.lit("t"), F.col("event_id")).alias("trial_tag"),
        F.col("event_type").alias("study_tag"),
    )


TRIALS = """trials AS (
  SELECT CAST(user_id % 10 AS INT) AS x_outer, CAST(event_id % 5 AS INT) AS x_inner, round(value * 0.9e0 + event_id % 7, 4) AS test_loss,
         value AS val_loss, 't' || event_id AS trial_tag, event_type AS study_tag FROM events)"""

# --- predictions ------------------------------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ID"),
        (F.col("l_suppkey") % 4).cast("int").alias("x_outer"),
        (F.col("l_partkey") % 3).cast("int").alias("x_inner"),
        F.element_at(F.array(F.lit("trn"), F.lit("val"), F.lit("tst")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("split"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_quantity") * 1.5).alias("y_pred"),
    )


PREDICTIONS = """predictions AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ID, CAST(l_suppkey % 4 AS INT) AS x_outer, CAST(l_partkey % 3 AS INT) AS x_inner,
         ['trn', 'val', 'tst'][l_orderkey % 3 + 1] AS split, l_extendedprice / 1000 AS y, l_quantity * 1.5e0 AS y_pred FROM lineitem)"""


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    scores = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 40)
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("int").alias("x_outer"),
        y.alias("y"),
        ((F.col("l_linenumber") + F.when(F.col("l_quantity") > 25, 1).otherwise(0)) % 3).cast("int").alias("y_pred"),
        scores.alias("scores"),
    )


CLASS_PREDICTIONS = """class_predictions AS (
  SELECT CAST(l_suppkey % 4 AS INT) AS x_outer, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
         CAST((l_linenumber + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) % 3 AS INT) AS y_pred,
         [l_discount * 10, l_tax * 10, l_quantity / 40] AS scores FROM lineitem)"""


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings of three outer folds; not every feature is in each."""
    rows = table(spark, sf, "lineitem").groupBy(
        (F.col("l_linenumber") % 3).cast("int").alias("x_outer"), F.col("l_linestatus").alias("omics"), F.concat(F.lit("p"), "l_partkey").alias("feature")
    )
    return rows.agg(F.max("l_extendedprice").alias("importance"))


RANKINGS = """rankings AS (
  SELECT CAST(l_linenumber % 3 AS INT) AS x_outer, l_linestatus AS omics, 'p' || l_partkey AS feature, max(l_extendedprice) AS importance
  FROM lineitem GROUP BY ALL)"""


def with_(*parts: str) -> str:
    """``WITH`` clause of the parts."""
    flat: list[str] = []
    for part in parts:
        if part not in flat:
            flat.append(part)
    return "WITH " + ",\n".join(flat) + "\n"
