"""Secrets in texts, found through an inverted index of trigrams. DataFrame functions only."""

from __future__ import annotations

import re._parser as regex_tree  # the standard library's parse tree of a regex
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitframe.llm.common import save
from traitframe.operators.joins import sized_join

MAX_BRANCHES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex``, leftmost and non-overlapping, whose ``group`` has ``min_length`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    min_length: int = 1


# The base rules in their order. [0-9a-f]{24,} finds the runs of
# [0-9a-f]+ that have 24 characters or more.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosted_git", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("login_url", r"[a-z][a-z0-9+]{1,20}://[A-Za-z0-9_.-]{1,64}:[^\x20\x09-\x0D/@:]{6,64}@[A-Za-z0-9-]"),
)


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The Boolean trigram query of a regex: any of these sets, all trigrams of it. None if no trigram must occur.

    Literal runs are followed through groups, alternatives, optional parts and
    small character classes; anything else ends a run. Letters are taken in lower
    case, so the query holds for either case.
    """
    gap = "\0"

    def joined(parts: list[list[str]]) -> list[str]:
        out = [""]
        for options in parts:
            out = ["".join(x) for x in product(out, options)] if len(out) * len(options) <= MAX_BRANCHES else [x + gap for x in out]
        return out

    def of(node) -> list[str]:
        parts: list[list[str]] = []
        for kind, value in node:
            name = str(kind)
            if name == "LITERAL":
                parts.append([chr(value).lower()])
            elif name == "SUBPATTERN":
                parts.append(of(value[-1]))
            elif name == "BRANCH":
                parts.append([x for branch in value[1] for x in of(branch)])
            elif name == "IN" and len(value) <= 8 and all(str(k) == "LITERAL" for k, _ in value):
                parts.append(sorted({chr(v).lower() for _, v in value}))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and (value[0], value[1]) == (0, 1):
                parts.append(["", *of(value[2])])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] == value[1] <= 8:
                parts.extend([of(value[2])] * value[0])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
                parts.append([x + gap + x for x in of(value[2])])
            elif name != "AT":
                parts.append([gap])
        return joined(parts)

    found = set()
    for text in of(regex_tree.parse(regex)):
        grams = frozenset(run[i : i + 3] for run in text.split(gap) for i in range(len(run) - 2))
        if not grams:
            return None
        found.add(grams)
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def trigram_postings(docs: DataFrame, trigrams: list[str], doc_id: str, text: str) -> DataFrame:
    """The inverted index ``(doc_id, trigram)`` of the trigrams that some rule asks for, saved.

    The text is read in lower case, once; each trigram is looked for in the row,
    so nothing but postings is written.
    """
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low")).filter("doc_id is not null")
    hits = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return save(low.select("doc_id", F.explode(hits).alias("trigram")), "trigram-postings")


def candidates(postings: DataFrame, rules: dict[int, list[frozenset[str]]]) -> DataFrame:
    """``(doc_id, _rules)``: a bit for each rule whose trigram query the document meets.

    Postings of the trigrams of one conjunction are intersected by counting them
    for each document; conjunctions of a rule are united by or-ing bits. The
    query table has a row for each trigram of each rule: its size is that of the rules.
    """
    wanted = [(gram, 1 << rule, i, len(grams)) for rule, query in rules.items() for i, grams in enumerate(query) for gram in grams]
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("trigram", "rule", "part", "need"), row, strict=True)]) for row in wanted]
    asked = postings.sparkSession.range(1).select(F.inline(F.array(*rows)))
    met = postings.dropDuplicates(["doc_id", "trigram"]).join(F.broadcast(asked), "trigram").groupBy("doc_id", "rule", "part", "need").count().filter("count = need")
    return met.groupBy("doc_id").agg(F.bit_or(F.col("rule").cast("bigint")).alias("_rules"))


def _lengths(rule: Rule, text: Column) -> Column:
    """For each match in a text: characters between it and the match before, its own, and those of the group that counts."""
    before = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    found = F.transform(F.arrays_zip(before.alias("b"), whole.alias("w"), group.alias("g")), lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("own"), F.length(x["g"]).alias("part")))
    return F.when(F.regexp_like(text, F.lit(rule.regex)), F.filter(found, lambda x: x["own"].isNotNull()))


_MARKED = "array<struct<rank:int,k:int,x:struct<gap:int,own:int,part:int>>>"


def _marked(rank: int) -> Column:
    return F.transform(f"_{rank}", lambda x, k: F.struct(F.lit(rank).alias("rank"), k.alias("k"), x.alias("x")))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (start, rank, kind, end) by start, then rank of the rule.

    Rules are found one by one, so spans of different kinds may overlap. Ends are
    exclusive; positions are code points. Null and empty texts have no spans.
    Rows without an id skip the index and are scanned by all rules. Rows that
    share an id are candidates together and verified each. No rows give no rows;
    columns other than the two named are not read.

    Rules with mandatory trigrams are verified only on the documents whose
    postings meet their query; the other rules scan every text. Positions are
    running sums over the matches of one text, taken on rows without text.
    """
    queries = {i: trigram_query(r.regex) for i, r in enumerate(rules)}
    indexed = {i: q for i, q in queries.items() if q}
    trigrams = sorted({g for q in indexed.values() for grams in q for g in grams})
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if indexed:
        postings = trigram_postings(docs, trigrams, doc_id, text)
        source = sized_join(source, candidates(postings, indexed), ["doc_id"], "left")
    else:
        source = source.withColumn("_rules", F.lit(0).cast("bigint"))
    asked = F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("_rules", F.lit(0)))
    source = source.select("doc_id", "_text", asked.cast("bigint").alias("_rules"))
    none = F.lit(None).cast("array<struct<gap:int,own:int,part:int>>")
    lengths = [F.coalesce(F.when(F.col("_rules").bitwiseAND(1 << i) != 0, _lengths(r, F.col("_text"))) if i in indexed else _lengths(r, F.col("_text")), none).alias(f"_{i}") for i, r in enumerate(rules)]
    found = save(source.select(F.monotonically_increasing_id().alias("_row"), "doc_id", *lengths), "secret-lengths")
    any_match = F.coalesce(*[F.col(f"_{i}") for i in range(len(rules))]).isNotNull()
    marked = F.concat(*[F.coalesce(_marked(i), F.array().cast(_MARKED)) for i in range(len(rules))])
    rows = found.filter(any_match).select("_row", "doc_id", F.explode(marked).alias("m")).select("_row", "doc_id", "m.rank", "m.k", "m.x.*")
    upto = F.sum(F.col("gap") + F.col("own")).over(Window.partitionBy("_row", "rank").orderBy("k"))
    kinds = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    least = F.element_at(F.array(*[F.lit(r.min_length) for r in rules]), F.col("rank") + 1)
    spans = rows.withColumn("end", upto).filter(F.col("part") >= least)
    spans = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("own")).alias("start"), "rank", kinds.alias("kind"), "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return sized_join(found.select("_row", "doc_id"), spans, ["_row"], "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))
