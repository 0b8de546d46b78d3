"""Quality rules of documents, judged again by the failure rates of their hosts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import SPACE, SPACES, save
from traitframe.operators.joins import sized_join

WINDOW = 5
MAX_HOST_RATE = 0.5
# Characters counted as symbols
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def _repeated_words(hashes: Column, repeats: Column, places: Column) -> Column:
    """Words covered by windows that are found again: ``places`` holds their first words in ascending order."""
    last = F.size(places) - 1
    own = F.transform(places, lambda p, i: F.when(i == last, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(places, i + 1) - p)))
    return F.when(repeats, F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))


def text_measures(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every whole text.

    Windows are compared by a 64-bit hash. Texts without a repeated window, seen
    by a hash set, are done; only the others sort their windows, so the work is
    n log n however long the text and however often a window comes back.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, whole.alias("_text"), words(F.col(text)).alias("_words"))
    window = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    names = [c for c in df.columns if c not in ("_text", "_words")]
    df = df.select(
        *names,
        F.size("_words").cast("bigint").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE[:-1]))).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_words") > WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    df = df.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_sorted", lambda x, i: ((i > 0) & (F.get("_sorted", i - 1)["h"] == x["h"])) | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    return df.select(
        *names,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("_windows"), F.col("_repeats"), F.col("_places")).alias("n_repeat_words"),
    )


#: Rule failures that are added up by host. The first two fail a document by themselves.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words AND n_words > 0",
    "lines": "n_dup_lines > 0 AND 100 * n_repeat_words > 10 * n_words",
}


def host_rates(rated: DataFrame, rules: list[str]) -> DataFrame:
    """``(_host, n, rate_<rule>...)``: failure rates of each host, shrunk towards the rate of all hosts.

    Each rule has a Beta(m * s, (1 - m) * s) prior whose mean m is the rate over
    all documents, and whose strength s comes from how much the hosts' raw rates
    differ beyond what counts of their sizes would by chance (moments, weighted
    by size). A host of few documents so keeps close to m, a large one shows its
    own rate. Hosts that do not differ give a strong prior.
    """
    hosts = save(rated.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("bigint")).alias(r) for r in rules]), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("nn"), *[F.sum(r).alias(r) for r in rules]).first()
    if not total["n"]:
        return hosts.select("_host", "n", *[F.lit(0.0).alias(f"rate_{r}") for r in rules])
    n, k = total["n"], total["hosts"]
    mean = {r: total[r] / n for r in rules}
    around = hosts.agg(*[F.sum(F.col("n") * (F.col(r) / F.col("n") - F.lit(mean[r])) * (F.col(r) / F.col("n") - F.lit(mean[r]))).alias(r) for r in rules]).first()
    spread = n - total["nn"] / n  # as if all hosts had one size: n * (1 - 1 / hosts)
    rates = []
    for r in rules:
        m = mean[r]
        between = (around[r] - (k - 1) * m * (1 - m)) / spread if spread > 0 else 0.0
        s = min(max(m * (1 - m) / between - 1, 1.0), 1e6) if between > 1e-12 else 1e6
        rates.append(((F.col(r) + F.lit(m * s)) / (F.col("n") + F.lit(s))).alias(f"rate_{r}"))
    return hosts.select("_host", "n", *rates)


def judge_hosts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: its measures, ``base_failed``, the shrunk rates of its host, ``host_failed`` and ``kept``.

    A host fails when any rule's shrunk rate is above ``max_rate``: documents are
    then more likely than not to break it. Documents without a host form one host of their own.
    Null and empty texts have no words and fail the base rules. Repeated rows and
    repeated ids count as documents each. No rows give no rows; columns other
    than the three named are not read.

    The measures are saved once, without texts. Sums by host are taken before the
    shuffle; verdicts come back by a join that broadcasts a counted table of
    hosts, or beyond that bound salts, so a host with a third of all rows is spread.
    """
    rules = list(RULES)
    key = F.when(F.col(host).isNull(), F.lit("")).otherwise(F.concat(F.lit("h"), F.col(host).cast("string")))
    measured = text_measures(docs, [F.col(doc_id).alias("doc_id"), key.alias("_host")], text)
    measured = save(measured.select("*", *[F.expr(RULES[r]).alias(r) for r in rules]), "measures")
    judged = host_rates(measured, rules)
    judged = judged.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in rules]) > max_rate).drop("n")
    out = sized_join(measured, judged, ["_host"], salt_by=["doc_id"], staged=True)
    out = out.withColumn("base_failed", F.col("short") | F.col("repeats"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("_host", *rules)
