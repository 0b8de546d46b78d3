"""Scans, projections, joins of samples, folds, padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.inputs import K_INNER, K_OUTER, N_FRAGMENTS, with_
from catalog.registry import query, r6
from traitframe.functions.folds import even_part
from traitframe.functions.scoring import argmax, float32
from traitframe.functions.tags import model_path_fields, study_name_fields, time_tag
from traitframe.operators import folds, positions, samples
from traitframe.operators.preprocess import attach
from traitframe.session import new_path
from traitframe.sources import folds as fold_files
from traitframe.sources import sinks, tables

# --- scans --------------------------------------------------------------------

CUSTOMERS = "SELECT CAST(c_custkey AS VARCHAR) AS ID, CAST(c_nationkey AS INT) AS nation, c_acctbal AS balance FROM customer"


def _customers(spark, sf):
    return i.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("ID"), F.col("c_nationkey").cast("int").alias("nation"), F.col("c_acctbal").alias("balance")
    )


@query("s1_csv_scan", CUSTOMERS)
def s1(spark, sf):
    path = new_path(spark, "s1") + ".CSV"
    _customers(spark, sf).withColumnRenamed("ID", "").write.option("header", True).csv(path)
    return tables.read_omics(spark, path)


@query("s2_parquet_scan", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS INT) AS s_nationkey, s_acctbal FROM supplier")
def s2(spark, sf):
    return tables.read_omics(spark, f"{sf}/supplier.parquet").select("s_suppkey", "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


@query("s6_label_scan", f"SELECT ID, balance, CAST(1 AS INT) AS n_labels FROM ({CUSTOMERS})")
def s6(spark, sf):
    path = new_path(spark, "s6") + ".csv"
    _customers(spark, sf).withColumnRenamed("ID", "sample").write.option("header", True).csv(path)
    table, dim = tables.read_labels(spark, path, ["balance"])
    return table.withColumn("n_labels", F.lit(dim))


def _fold_rows(spark, sf):
    cut = folds.random_fragments(i.samples(spark, sf), N_FRAGMENTS)
    return folds.with_folds(cut.select("ID", "fragment"), K_OUTER, K_INNER)


FOLD_ROWS = "fold_rows AS (SELECT f.ID, f.fragment, r.x_outer, r.x_inner, r.split FROM fragments f JOIN roles r USING (fragment))"
ROWS = (i.SAMPLES, i.FRAGMENTS, i.ROLES, FOLD_ROWS)


@query("s7_fold_tagged_scan", with_(*ROWS) + "SELECT ID, fragment, x_outer, x_inner, split FROM fold_rows")
def s7(spark, sf):
    path = new_path(spark, "s7")
    fold_files.write_fold_tagged(_fold_rows(spark, sf), path, "omics")
    return fold_files.read_fold_tagged(spark, path, prefix="omics").select("ID", "fragment", "x_outer", "x_inner", "split")


@query("s8_fold_writer", with_(*ROWS) + "SELECT x_outer, x_inner, split, count(*) AS n_rows, min(ID) AS first_id FROM fold_rows GROUP BY ALL")
def s8(spark, sf):
    path = new_path(spark, "s8")
    fold_files.write_folds(_fold_rows(spark, sf), path)
    back = fold_files.read_folds(spark, path)
    return back.groupBy("x_outer", "x_inner", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ID").alias("first_id"))


@query("s15_fold_reader", with_(*ROWS) + "SELECT ID, fragment FROM fold_rows WHERE x_outer = 1 AND x_inner = 2 AND split = 'val'")
def s15(spark, sf):
    path = new_path(spark, "s15")
    fold_files.write_folds(_fold_rows(spark, sf), path)
    return fold_files.read_folds(spark, path, 1, 2, "val").select("ID", "fragment")


@query(
    "s10_metadata",
    with_(i.OMICS, i.SAMPLES, i.FRAGMENTS, i.ROLES, FOLD_ROWS)
    + """SELECT 'ids' AS kind, split AS name, count(*) AS n FROM fold_rows GROUP BY ALL
    UNION ALL SELECT 'dim', omics, count(DISTINCT feature) FROM omics GROUP BY ALL
    UNION ALL SELECT 'feature', feature, 1 FROM (SELECT DISTINCT omics, feature FROM omics)
    UNION ALL SELECT 'label', l, 1 FROM (VALUES ('height'), ('grade')) v(l)
    UNION ALL SELECT 'output_dim', '', 2""",
)
def s10(spark, sf):
    path = new_path(spark, "s10")
    labels = samples.melt_labels(i.wide_labels(spark, sf))
    sinks.write_metadata(i.omics_long(spark, sf), labels, _fold_rows(spark, sf), path)
    read = spark.read.parquet
    one = F.lit(1).cast("bigint")
    return samples.stack(
        read(f"{path}/sample_ids").groupBy(F.lit("ids").alias("kind"), F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("n")),
        read(f"{path}/omics_dims").select(F.lit("dim").alias("kind"), F.col("omics").alias("name"), F.col("omics_dim").alias("n")),
        read(f"{path}/omics_features").select(F.lit("feature").alias("kind"), F.col("feature").alias("name"), one.alias("n")),
        read(f"{path}/label_names").select(F.lit("label").alias("kind"), F.col("label").alias("name"), one.alias("n")),
        read(f"{path}/output_dim").select(F.lit("output_dim").alias("kind"), F.lit("").alias("name"), F.col("model_output_dim").alias("n")),
    )


# --- projections ----------------------------------------------------------------


@query("p1_column_choice", f"SELECT ID, balance FROM ({CUSTOMERS})")
def p1(spark, sf):
    return samples.choose_columns(_customers(spark, sf), [2])


@query("p2_id_rename", "SELECT CAST(c_custkey AS VARCHAR) AS ID, c_name, c_acctbal FROM customer")
def p2(spark, sf):
    return samples.name_id_column(i.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"))


MODEL_PATHS = """paths AS (
  SELECT event_id, '/logs/study_' || event_type || '/log_fold_' || (user_id % 10) || '_' || (event_id % 5) || '/t' || event_id
         || '/best-model-epoch=0007-val_loss=' || CAST(event_id % 97 AS VARCHAR) || '.25.ckpt' AS path,
         'S_log_' || (user_id % 10) || '_' || (event_id % 5) || '_20240101' AS study FROM events)"""


@query(
    "p13_tag_parsing",
    with_(MODEL_PATHS)
    + """SELECT event_id, CAST(regexp_extract(path, '_([0-9]+)_[0-9]+/t', 1) AS INT) AS x_outer,
      CAST(regexp_extract(path, '_([0-9]+)/t', 1) AS INT) AS x_inner, CAST(regexp_extract(path, 'val_loss=(.*)\\.ckpt', 1) AS DOUBLE) AS val_loss,
      split_part(path, '/', 5) AS trial_tag, regexp_extract(path, '/study_([a-z]+)/', 1) AS study_tag,
      CAST(split_part(study, '_', 3) AS INT) AS s_outer, CAST(split_part(study, '_', 4) AS INT) AS s_inner, split_part(study, '_', 5) AS x_time FROM paths""",
)
def p13(spark, sf):
    outer, inner = F.col("user_id") % 10, F.col("event_id") % 5
    fold = F.concat_ws("_", outer, inner)
    path = F.concat(
        F.lit("/logs/study_"), "event_type", F.lit("/log_fold_"), fold, F.lit("/t"), "event_id",
        F.lit("/best-model-epoch=0007-val_loss="), F.col("event_id") % 97, F.lit(".25.ckpt"),
    )
    rows = i.table(spark, sf, "events").select("event_id", path.alias("path"), F.concat(F.lit("S_log_"), fold, F.lit("_20240101")).alias("study"))
    s = study_name_fields(F.col("study"))
    return rows.select(
        "event_id", *[c.alias(n) for n, c in model_path_fields(F.col("path")).items()],
        s["x_outer"].alias("s_outer"), s["x_inner"].alias("s_inner"), s["x_time"].alias("x_time"),
    )


@query("f_time_tag", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS tag FROM events")
def f_time(spark, sf):
    return i.table(spark, sf, "events").select("event_id", time_tag(F.col("ts")).alias("tag"))


@query(
    "p14_argmax_class",
    "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS cls FROM embeddings",
)
def p14(spark, sf):
    return i.table(spark, sf, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("cls"))


@query("p15_float32", "SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(CAST(l_tax * l_extendedprice AS FLOAT) AS DOUBLE), 3) + 0e0 AS v FROM lineitem")
def p15(spark, sf):
    v = float32(F.col("l_tax") * F.col("l_extendedprice")).cast("double")
    return i.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.round(v, 3) + F.lit(0.0)).alias("v"))


@query("p17_omics_choice", with_(i.OMICS) + "SELECT ID, omics, feature, value, CAST(1 AS INT) AS omics_idx FROM omics WHERE omics = 'b'")
def p17(spark, sf):
    long = i.omics_long(spark, sf)
    index = samples.omics_index(long)
    return samples.choose_omics(long, 1).join(F.broadcast(index), "omics").select("ID", "omics", "feature", "value", "omics_idx")


# --- shared samples ---------------------------------------------------------------


def _totals(spark, sf):
    return i.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("ID")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders")
    )


@query(
    "j1_shared_samples",
    with_("totals AS (SELECT CAST(o_custkey AS VARCHAR) AS ID, sum(o_totalprice) AS total FROM orders GROUP BY 1)", i.SAMPLES)
    + f"SELECT c.ID, c.balance, round(t.total, 2) + 0e0 AS total FROM ({CUSTOMERS}) c JOIN totals t USING (ID) JOIN samples USING (ID)",
)
def j1(spark, sf):
    customers, totals, vectors = _customers(spark, sf), _totals(spark, sf), i.samples(spark, sf)
    ids = samples.shared_ids(vectors, customers, i.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("ID")))
    rows = samples.join_on_id(ids, customers, totals)
    return rows.select("ID", "balance", (F.round("total", 2) + F.lit(0.0)).alias("total"))


@query(
    "j1_first_occurrence",
    """SELECT CAST(o_custkey AS VARCHAR) AS ID, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def j1_first(spark, sf):
    rows = i.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("ID"), "o_orderkey", "o_totalprice")
    return samples.first_rows(rows, F.col("o_orderkey"))


@query("j1_duplicate_ids_prepared", with_(i.OMICS) + "SELECT ID, omics, count(*) AS n_rows, round(max(value), 6) + 0e0 AS largest FROM omics GROUP BY ALL")
def j1_prepared(spark, sf):
    """Every tenth sample comes a second time with other values; its first rows count."""
    from traitframe.plans.ncv import assemble

    omics = i.omics_long(spark, sf)
    again = omics.where(F.col("ID").cast("long") % 10 == 0).withColumn("value", F.col("value") + 1000)
    rows = assemble(omics.unionByName(again), None)[0]
    return rows.groupBy("ID", "omics").agg(F.count(F.lit(1)).alias("n_rows"), (F.round(F.max("value"), 6) + F.lit(0.0)).alias("largest"))


@query(
    "j2_samples_with_labels",
    with_(i.OMICS, i.WIDE_LABELS)
    + f"""SELECT o.ID, o.omics, count(o.value) AS n_values, any_value(c.balance) AS y FROM omics o JOIN ({CUSTOMERS}) c USING (ID) GROUP BY ALL""",
)
def j2(spark, sf):
    from traitframe.plans.ncv import assemble

    labels = samples.melt_labels(_customers(spark, sf).select("ID", F.col("balance").alias("y")))
    omics, labels = assemble(i.omics_long(spark, sf), labels)
    rows = omics.groupBy("ID", "omics").agg(F.count("value").alias("n_values"))
    return rows.join(labels.select("ID", "y"), "ID")


@query(
    "j3_fold_aligned",
    with_(*ROWS) + f"""SELECT r.ID, r.x_outer, r.x_inner, r.split FROM fold_rows r JOIN ({CUSTOMERS}) c USING (ID)
    WHERE r.fragment <> 5 OR r.x_outer <> 2""",
)
def j3(spark, sf):
    one = _fold_rows(spark, sf)
    # the second table disagrees about one fragment in one outer fold
    other = one.withColumn("split", F.when((F.col("fragment") == 5) & (F.col("x_outer") == 2), "none").otherwise(F.col("split")))
    existing = one.withColumn("omics", F.lit("blocks")).unionByName(other.withColumn("omics", F.lit("genes")))
    return samples.align_with_folds(existing, _customers(spark, sf)).select("ID", "x_outer", "x_inner", "split")


@query("u1_intersection", with_(i.SAMPLES) + f"SELECT ID FROM samples INTERSECT SELECT ID FROM ({CUSTOMERS}) INTERSECT SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def u1(spark, sf):
    orders = i.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("ID"))
    return samples.intersect_ids(i.samples(spark, sf), _customers(spark, sf), orders)


@query(
    "u1_shared_in_long",
    with_(i.OMICS) + "SELECT ID FROM (SELECT ID, omics FROM omics WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ID HAVING count(*) = 2",
)
def u1_long(spark, sf):
    return samples.shared_omics_ids(i.omics_long(spark, sf).where("value is not null"), 2)


@query("u2_row_union", with_(*ROWS) + "SELECT split, count(*) AS n FROM fold_rows GROUP BY ALL")
def u2(spark, sf):
    rows = _fold_rows(spark, sf)
    return samples.stack(*[rows.where(F.col("split") == s) for s in ("trn", "val", "tst")]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("u3_difference", with_(i.ROLES) + "SELECT x_outer, x_inner, fragment FROM roles WHERE split <> 'tst'")
def u3(spark, sf):
    # every fragment that holds a sample
    held = folds.random_fragments(i.samples(spark, sf), N_FRAGMENTS).select("fragment").distinct()
    return folds.fragments_outside(spark, K_OUTER, K_INNER, "tst").join(held, "fragment", "left_semi").select("x_outer", "x_inner", "fragment")


@query("u4_fold_grid", with_(*ROWS) + "SELECT x_outer, x_inner, count(*) AS n_samples FROM fold_rows GROUP BY ALL")
def u4(spark, sf):
    grid = folds.fold_grid(spark, K_OUTER, K_INNER)
    sizes = _fold_rows(spark, sf).groupBy("x_outer", "x_inner").agg(F.count(F.lit(1)).alias("n_samples"))
    return grid.join(sizes, ["x_outer", "x_inner"])


# --- folds and padding --------------------------------------------------------------


@query("w1_random_order", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS position FROM orders")
def w1(spark, sf):
    return positions.hash_positions(i.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 42)


@query(
    "w2_even_fragments",
    "SELECT o_orderkey, CAST(ntile(12) OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1 AS INT) AS fragment FROM orders",
)
def w2(spark, sf):
    placed = positions.hash_positions(i.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 42, total="n")
    return placed.select("o_orderkey", even_part(F.col("position"), F.col("n"), N_FRAGMENTS).alias("fragment"))


@query("w3_fold_roles", with_(*ROWS) + "SELECT ID, fragment, x_outer, x_inner, split FROM fold_rows")
def w3(spark, sf):
    return _fold_rows(spark, sf).select("ID", "fragment", "x_outer", "x_inner", "split")


@query("w5_sorted_position", "SELECT c_name, row_number() OVER (ORDER BY c_name DESC) - 1 AS rest, row_number() OVER (ORDER BY c_name) - 1 AS position FROM customer")
def w5(spark, sf):
    rows = positions.sorted_positions(i.table(spark, sf, "customer").select("c_name"), "c_name", total="n")
    return rows.select("c_name", (F.col("n") - 1 - F.col("position")).alias("rest"), "position")


PAD = """draws AS (
  SELECT d, CAST(('0x' || substr(md5('43|' || d), 1, 12)) AS UBIGINT) % (SELECT count(*) FROM samples) AS position FROM range(100000) t(d)
  WHERE d < {extra}),
ordered AS (SELECT ID, row_number() OVER (ORDER BY md5('43|' || ID), ID) - 1 AS position FROM samples),
padded AS (
  SELECT ID, CAST(0 AS INT) AS copy_no FROM samples
  UNION ALL SELECT o.ID, CAST(row_number() OVER (PARTITION BY o.ID ORDER BY d) AS INT) FROM draws JOIN ordered o ON o.position = draws.position)"""


@query("n6_pad_to_multiple", with_(i.SAMPLES, PAD.format(extra="(12 - (SELECT count(*) FROM samples) % 12) % 12")) + "SELECT ID, copy_no FROM padded")
def n6(spark, sf):
    return samples.pad_samples(i.samples(spark, sf), multiple_of=N_FRAGMENTS)


@query("n6_pad_to_target", with_(i.SAMPLES, PAD.format(extra="(SELECT count(*) FROM samples) * 2")) + "SELECT ID, copy_no FROM padded")
def n6_target(spark, sf):
    rows = i.samples(spark, sf)
    return samples.pad_samples(rows, target=rows.count() * 3)


@query(
    "n7_given_fragments",
    with_(i.ROLES) + """SELECT CAST(vec_id AS VARCHAR) AS ID, x_outer, x_inner, split FROM embeddings JOIN roles ON roles.fragment = (vec_id * 5 + label) % 12""",
)
def n7(spark, sf):
    given = i.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("ID"), ((F.col("vec_id") * 5 + F.col("label")) % 12).alias("fragment"))
    cut = folds.given_fragments(i.samples(spark, sf), given, N_FRAGMENTS)
    return folds.with_folds(cut, K_OUTER, K_INNER).select("ID", "x_outer", "x_inner", "split")


@query("n8_single_fold", with_(*ROWS) + "SELECT ID, x_outer, x_inner, split FROM fold_rows WHERE x_outer = 2 AND x_inner = 1")
def n8(spark, sf):
    cut = folds.random_fragments(i.samples(spark, sf), N_FRAGMENTS)
    return folds.with_folds(cut, K_OUTER, K_INNER, (2, 1)).select("ID", "x_outer", "x_inner", "split")


@query("t1_sort_by_id", f"SELECT ID, balance FROM ({CUSTOMERS}) ORDER BY ID")
def t1(spark, sf):
    return _customers(spark, sf).select("ID", "balance").orderBy("ID")


@query("a14_dimensions", with_(i.OMICS) + "SELECT omics, count(DISTINCT feature) AS omics_dim FROM omics GROUP BY 1")
def a14(spark, sf):
    return samples.omics_dims(i.omics_long(spark, sf))


@query(
    "f_sample_record",
    with_(i.OMICS, i.WIDE_LABELS) + """SELECT o.ID, count(*) FILTER (omics = 'a') AS n_a, count(*) FILTER (omics = 'b') AS n_b,
    round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 4) + 0e0 AS total, CAST(CAST(any_value(l.grade) AS FLOAT) AS DOUBLE) AS grade
    FROM omics o JOIN wide_labels l USING (ID) GROUP BY ALL""",
)
def record(spark, sf):
    rows = samples.sample_records(i.omics_long(spark, sf), samples.melt_labels(i.wide_labels(spark, sf)))
    total = F.aggregate(
        F.flatten(F.map_values("omics")), F.lit(0.0), lambda acc, v: acc + F.coalesce(v.cast("double"), F.lit(0.0))
    )
    return rows.select(
        "ID", F.size(F.col("omics")["a"]).cast("bigint").alias("n_a"), F.size(F.col("omics")["b"]).cast("bigint").alias("n_b"),
        (F.round(total, 4) + F.lit(0.0)).alias("total"), F.col("label")["grade"].cast("double").alias("grade"),
    )


@query(
    "p11_fit_rows",
    with_(i.OMICS, *ROWS) + "SELECT o.ID, r.x_outer, r.x_inner, count(*) AS n FROM omics o JOIN fold_rows r USING (ID) WHERE split = 'trn' GROUP BY ALL",
)
def p11(spark, sf):
    cut = folds.random_fragments(i.samples(spark, sf), N_FRAGMENTS).select("ID", "fragment")
    rows = folds.with_folds(attach(i.omics_long(spark, sf), cut), K_OUTER, K_INNER)
    return rows.where(F.col("split") == "trn").groupBy("ID", "x_outer", "x_inner").agg(F.count(F.lit(1)).alias("n"))
