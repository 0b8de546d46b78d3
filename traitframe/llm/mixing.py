"""Mixing sources to target weights: blocks of equal length, apportioned by highest quotients."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitframe.llm.common import SPACE, SPACES, WORD, boxed, save, ship_package
from traitframe.operators.joins import sized_join

SEED = 20
SHARD_WORDS = 1 << 20
MAX_SHARDS = 1024
MAX_BLOCK = 1024
MAX_SOURCES = 100_000
# Weights of the sources in code point order, again and again
WEIGHTS = (3, 1, 2)
SHARE, MAX_REPEATS = 1.5, 2


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.regexp_count(bare, F.lit(SPACE)) + 1).cast("long")


def capped_targets(sizes: list[int], weights: list[float], total: float, repeats: float) -> list[float]:
    """``total`` shared by weight, none above ``repeats`` times its size; what a cap cuts off is shared again among the others.

    Rounds end when no target is above its cap: each fixes a source or more.
    """
    target = [float(repeats * s) for s in sizes]
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = min(float(total), float(sum(target)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > target[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        left -= sum(target[i] for i in over)
        shut = set(over)
        open_ = [i for i in open_ if i not in shut]
    return target


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / 1, / 3, / 5 ..., at most ``most`` each; ties go to the one that comes first.

    Equal to handing out seats one by one. A common divisor, found by bisection, gives all seats
    whose quotient is clearly among the highest at once; the few around the limit are dealt by quotient.
    """
    votes = np.asarray(votes, float)
    most = np.where(votes > 0, most, 0).astype(np.int64)
    seats = min(int(seats), int(most.sum()))

    def given(limit: float) -> np.ndarray:  # seats with a quotient of ``limit`` or more
        return np.minimum(most, np.floor((votes / limit + 1) / 2)).astype(np.int64)

    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    low, high = votes[votes > 0].min() / (2 * float(most.max()) + 1), votes.max() * 2
    for _ in range(200):
        middle = math.sqrt(low * high)
        if not low < middle < high:
            break
        low, high = (middle, high) if given(middle).sum() >= seats else (low, middle)
    won = given(high)  # fewer than ``seats``; quotients between low and high are equal but for rounding, one a source
    quotient = np.where(won < most, votes / (2 * won + 1), -1.0)
    won[np.argsort(-quotient, kind="stable")[: seats - int(won.sum())]] += 1
    return won


def _number(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def place_of(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = MAX_REPEATS,
    seed: int = SEED,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, whole, cut_from, cut_words, taken)``: one row per document.

    Sources in code point order, null last, weigh ``weights`` by turns and share
    ``share`` times all words; a target stops at ``repeats`` times its source's
    size. Documents of a source are dealt to shards by a hash of their id and
    text, a shard's documents stand in hash order, and their words make up blocks of
    equal length, the same for all sources. Blocks go to the sources, then to
    the shards of each source, by highest quotients of the targets
    (Sainte-Laguë), which gives whole quotas. A shard takes all its blocks as
    often as its quota covers them (``whole``), and of the rest a run of
    neighbouring blocks from a seeded one on, so documents but for those
    at the ends of the run stay whole: ``cut_words`` words from word ``cut_from`` on, past the document's
    end going on at its first word. ``taken`` is all words of a document, repeats counted.

    Null and empty texts have no words and are never taken; sources without words
    have target 0. Repeated rows are documents each; rows that can't be told
    apart stand side by side and share what falls on them in any order. Rows without an id are hashed by text alone. No
    rows give no rows; columns other than the three named are not read.

    Sizes are saved once without texts. The table of sources is summed before
    it is read by the driver; more than ``MAX_SOURCES`` raise ValueError, and a
    source has at most ``MAX_SHARDS`` shards, so what the driver deals with is bounded.
    """
    spark = docs.sparkSession
    place = place_of(F.col(doc_id), F.col(text), seed)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), place.alias("place"))
    sized = save(sized, "sizes")
    sources = save(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    rows = sorted(sources.limit(MAX_SOURCES + 1).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix by a coarser column")
    sizes = [int(r["source_size"]) for r in rows]
    total = sum(sizes)
    target = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * total, repeats)
    some = [t for t in target if t > 0]
    block = min(MAX_BLOCK, max(1, int(min(some) // 256))) if some else 1
    quota = sainte_lague(np.array(target), round(sum(target) / block), np.array([repeats * math.ceil(s / block) for s in sizes]))

    shards = [min(MAX_SHARDS, max(1, math.ceil(s / shard_words))) for s in sizes]
    table = [(r["source"], s, t, n) for r, s, t, n in zip(rows, sizes, target, shards, strict=True)]
    sources = spark.createDataFrame(table, "source string, source_size long, target double, shards int")
    keyed = sized.withColumn("_key", _key()).drop("source")
    sources = sources.withColumn("_key", _key())
    dealt = sized_join(keyed, sources, ["_key"], salt_by=["place"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "place"), F.col("shards")).cast("int"))
    dealt = save(dealt.drop("shards"), "dealt")
    sums = dealt.groupBy("_key", "shard").agg(F.sum("size").alias("n")).collect()  # MAX_SHARDS for each source at most
    of: dict[str, list] = {}
    for r in sums:
        of.setdefault(r["_key"], []).append((r["shard"], int(r["n"])))
    plan = []
    for r, q in zip(rows, quota.tolist(), strict=True):
        key = "" if r["source"] is None else "s" + r["source"]
        own = sorted(of.get(key, []))
        blocks = np.array([math.ceil(n / block) for _, n in own], np.int64)
        won = sainte_lague(np.array([float(n) for _, n in own]), q, repeats * blocks)
        for (shard, n), b, w in zip(own, blocks.tolist(), won.tolist(), strict=True):
            if b:
                start = _number(seed, key, shard) % b * block
                plan.append((key, shard, n, w // b, start, min(w % b * block, n)))
    plan = spark.createDataFrame(plan, "_key string, shard int, shard_words long, whole int, run_start long, run_words long")
    before = F.sum("size").over(Window.partitionBy("_key", "shard").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = sized_join(dealt.withColumn("_from", before), plan, ["_key", "shard"], "left")
    end = F.col("_from") + F.col("size")
    run_end = F.col("run_start") + F.col("run_words")
    over = lambda a, b: F.greatest(F.least(end, b) - F.greatest(F.col("_from"), a), F.lit(0).cast("long"))
    straight = over(F.col("run_start"), F.least(run_end, F.col("shard_words")))
    wrapped = over(F.lit(0).cast("long"), F.greatest(run_end - F.col("shard_words"), F.lit(0).cast("long")))
    cut = F.when(F.col("size") > 0, straight + wrapped).otherwise(F.lit(0).cast("long"))
    cut_from = F.when(straight > 0, F.greatest(F.col("run_start") - F.col("_from"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    out = placed.select(
        "doc_id",
        F.when(F.col("_key") != "", F.substr("_key", F.lit(2))).alias("source"),
        "size",
        "source_size",
        "target",
        F.coalesce(F.when(F.col("size") > 0, F.col("whole")), F.lit(0)).alias("whole"),
        F.coalesce(cut_from, F.lit(0)).alias("cut_from"),
        F.coalesce(cut, F.lit(0)).alias("cut_words"),
        "place",
    )
    return out.withColumn("taken", F.col("whole") * F.col("size") + F.col("cut_words"))


def _key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))


def cut_words(text: str, first: int, count: int) -> list[str]:
    """The part of a text with ``count`` words from word ``first`` on; past the last word a second part begins at the first."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    parts = [spans[first : first + count], spans[: max(0, first + count - len(spans))]]
    return [text[p[0][0] : p[-1][1]] for p in parts if p]


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", seed: int = SEED, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy of a document, and one for a part.

    A part has the words that its shard's run of blocks takes, from the first to
    the last character of them, and its own ``n_chars`` if there is such a column. Documents without words are not in it.
    Rows alike in id, text and source are numbered, so that each finds a plan of its own.
    """
    keys = ["_id", "_place", "_source"]
    plan = mix_sources(docs, doc_id, text, source, seed=seed, **settings)
    full = F.col("cut_words") == F.col("size")
    plan = save(
        plan.filter("size > 0").select(
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
            F.col("place").alias("_place"),
            F.coalesce("source", F.lit("")).alias("_source"),
            (F.col("whole") + F.when(full, 1).otherwise(0)).alias("_whole"),
            F.col("cut_from").alias("_cut_from"),
            F.when(full, 0).otherwise(F.col("cut_words")).alias("_cut_words"),
        ),
        "mix-plan",
    )
    repeated = save(plan.groupBy(*keys).count().filter("count > 1").select(*keys), "repeated-rows")
    rows = boxed(
        docs,
        _id=F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
        _place=place_of(F.col(doc_id), F.col(text), seed),
        _source=F.coalesce(F.col(source).cast("string"), F.lit("")),
        _text=F.col(text),
    )
    taken = plan.filter("_whole + _cut_words > 0")
    if repeated.isEmpty():
        met = rows.join(taken, keys)
    else:
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))).alias("_number")
        many = [x.join(repeated, keys, "left_semi").select("*", number) for x in (rows, plan)]
        met = rows.join(repeated, keys, "left_anti").join(taken, keys)
        met = met.unionByName(many[0].join(many[1], [*keys, "_number"]).drop("_number"))

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series, first: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, a, n) for t, a, n in zip(texts, first, count, strict=True)], dtype=object)

    ship_package(docs.sparkSession)
    whole = met.filter("_whole > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_whole")))).select("row.*")
    cut = met.filter("_cut_words > 0").withColumn("_part", F.explode(parts("_text", "_cut_from", "_cut_words")))
    row = F.col("row").withField(text, F.col("_part"))
    if n_chars in docs.columns:
        row = row.withField(n_chars, F.length("_part").cast(docs.schema[n_chars].dataType))
    return whole.unionByName(cut.select(row.alias("row")).select("row.*"))
