"""Roles of transcript lines by a hidden Markov model, and their turns in one format."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import map_arrow, save
from traitframe.operators.joins import sized_join

ROLES = ("system", "user", "assistant", "tool")
# Names that open a line of a role, before a colon or between marks
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompt"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a", "response"),
    "tool": ("tool", "function", "observation", "result"),
}
_ROLE_OF = {name: role for role, names in MARKERS.items() for name in names}
_MARKER = re.compile(r"\s*(?:[#>*\[<|_-]{0,4}\s*)(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(?:[\]>|*_]{0,3}\s*:|[\]>|]{1,3})[\]>|*_]{0,3}\s*", re.IGNORECASE)
MARKER_WEIGHT = 200.0
CHUNK_TURNS = 256
_S = len(ROLES)


def marker(line: str) -> tuple[str, int]:
    """Role that a line's opening names, or none, and where its content begins."""
    found = _MARKER.match(line)
    return (_ROLE_OF[found[1].lower()], found.end()) if found else ("none", 0)


def line_features(lines: list[str]) -> list[list[tuple[str, str]]]:
    """Features of each line of a text; the first line also carries the size of the whole."""
    out = []
    words = sum(len(x.split()) for x in lines)
    for i, line in enumerate(lines):
        bare, n = line.strip(), len(line.split())
        shape = "code" if bare.startswith(("```", "    ", "$ ", "{", "<")) else "list" if re.match(r"([-*•]|\d+[.)])\s", bare) else "blank" if not bare else "plain"
        own = [("marker", marker(line)[0]), ("words", str(min(10, n.bit_length()))), ("end", bare[-1:] if bare[-1:] in "?.!:" else "other"), ("shape", shape)]
        if i == 0:
            own += [("lines", str(min(7, len(lines).bit_length()))), ("all", str(min(14, words.bit_length())))]
        out.append(own)
    return out


@dataclass
class Model:
    """Log probabilities: of the first role, of the role after a turn, of the role after a line of the same turn, of features."""

    first: np.ndarray
    turn: np.ndarray
    line: np.ndarray
    features: dict[tuple[str, str], np.ndarray]
    unseen: dict[str, np.ndarray]

    def emissions(self, lines: list[str]) -> np.ndarray:
        return np.array([sum(self.features.get(f, self.unseen[f[0]]) for f in own) for own in line_features(lines)])


def fit(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Smoothed counts over all turns with a known role: features by role, first roles, and roles of neighbouring turns.

    Counts are added up in the tasks; the driver gets a row for each role and feature value, and for each pair of roles.
    Markers name their role by ``MARKER_WEIGHT`` counts to begin with, so that they count where no turn has them.
    """
    known = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.lower(F.col(role)).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).filter(F.col("r").isin(*ROLES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for own, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                features = line_features(x.split("\n"))
                found[own, "line", str(len(features) > 1)] += len(features)
                for f in features:
                    found.update((own, *value) for value in f)
            rows = [(*k, n) for k, n in found.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()], strict=True)], ["r", "f", "v", "n"])

    counts = map_arrow(known.select("r", "x"), count, "r string, f string, v string, n long").groupBy("r", "f", "v").agg(F.sum("n").alias("n")).collect()
    steps = save(known.groupBy("c", "t").agg(F.min("r").alias("r")), "known-roles")
    after = steps.select("c", (F.col("t") - 1).alias("t"), F.col("r").alias("r2"))
    pairs = steps.join(after, ["c", "t"]).groupBy("r", "r2").count().collect()
    begin = steps.groupBy("c").agg(F.min_by("r", "t").alias("r")).groupBy("r").count().collect()
    at = {r: i for i, r in enumerate(ROLES)}
    first, step = np.full(_S, 0.5), np.full((_S, _S), 0.5)
    for r in begin:
        first[at[r["r"]]] += r["count"]
    for r in pairs:
        step[at[r["r"]], at[r["r2"]]] += r["count"]
    tables: dict[str, dict[str, np.ndarray]] = {"marker": {r: np.zeros(_S) for r in (*ROLES, "none")}}
    for r in ROLES:
        tables["marker"][r][at[r]] = MARKER_WEIGHT
    tables["marker"]["none"] += MARKER_WEIGHT
    for name in ("words", "end", "shape", "lines", "all"):
        tables[name] = {}
    for r in counts:
        if r["f"] in tables:
            tables[r["f"]].setdefault(r["v"], np.zeros(_S))[at[r["r"]]] += r["n"]
    unknown = [at[r] for r in ROLES if not any(c["r"] == r for c in counts)]
    for name, values in tables.items():  # a role that was never seen looks like the others, but for its marker
        for n in values.values() if name != "marker" else ():
            n[unknown] = n.sum() / max(1, _S - len(unknown))
    features, unseen = {}, {}
    for name, values in tables.items():
        least = 0.001 if name == "marker" else 0.5  # a line hardly ever names another role than its own
        total = sum(values.values(), np.zeros(_S)) + least * (len(values) + 1)
        unseen[name] = np.log(least / total)
        features |= {(name, v): np.log((n + least) / total) for v, n in values.items()}
    stay = np.full((_S, _S), 0.01 / (_S - 1))
    np.fill_diagonal(stay, 0.99)
    return Model(np.log(first / first.sum()), np.log(step / step.sum(axis=1, keepdims=True)), np.log(stay), features, unseen)


def _follow(model: Model, scores: np.ndarray, lines: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Best scores (entry role x role) after the lines of a text, which begins with a new turn; ``scores`` before it."""
    for i, own in enumerate(lines):
        step = scores[:, :, None] + (model.line if i else model.turn)[None]
        if trace is not None:
            trace.append(step[0].argmax(axis=0))
        scores = step.max(axis=1) + own
    return scores


def _open(model: Model, own: np.ndarray) -> np.ndarray:
    return (model.first + own)[None]


def decode(model: Model, texts: list[list[str]], entry: int | None = None, exit_: int | None = None) -> list[np.ndarray]:
    """Most likely roles of all lines of neighbouring turns; ``entry``, the role before them (None: they open the conversation), and ``exit_`` are held."""
    lines = [model.emissions(x) for x in texts]
    trace: list[np.ndarray] = []
    scores = np.full((1, _S), -np.inf)
    for k, own in enumerate(lines):
        if k == 0 and entry is None:
            trace.append(np.zeros(_S, int))
            scores = _open(model, own[0])
            for x in own[1:]:
                step = scores[:, :, None] + model.line[None]
                trace.append(step[0].argmax(axis=0))
                scores = step.max(axis=1) + x
        else:
            if k == 0:
                scores[0, entry] = 0
            scores = _follow(model, scores, own, trace)
    state = int(scores[0].argmax()) if exit_ is None else exit_
    path = [state]
    for back in trace[:0:-1]:
        path.append(int(back[path[-1]]))
    return np.split(np.array(path[::-1]), np.cumsum([len(x) for x in lines])[:-1])


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of neighbouring equal keys ``names``, one key after the other."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[n] for n in names)
            if rows and own != key:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def _transfer(model: Model):
    """For each chunk the best scores from any role before it to any role at its end, as ``_S * _S`` numbers."""

    def run(batches):
        for (conv, chunk), rows in _runs(batches, ["conv_id", "chunk"]):
            scores = np.where(np.eye(_S, dtype=bool), 0.0, -np.inf)
            for k, row in enumerate(rows):
                own = model.emissions(row["text"].split("\n"))
                if row["opens"] and k == 0:
                    scores = np.repeat(_open(model, own[0]), _S, axis=0)
                    for x in own[1:]:
                        scores = (scores[:, :, None] + model.line[None]).max(axis=1) + x
                else:
                    scores = _follow(model, scores, own)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([chunk], pa.int64()), pa.array([scores.ravel().tolist()], pa.list_(pa.float64()))], ["conv_id", "chunk", "best"])

    return run


def _borders(batches):
    """Roles before and at the end of each chunk on the best path through all chunks of a conversation."""
    for (conv,), rows in _runs(batches, ["conv_id"]):
        scores, trace = np.zeros(_S), []
        for row in rows:
            step = scores[:, None] + np.array(row["best"]).reshape(_S, _S)
            trace.append(step.argmax(axis=0))
            scores = step.max(axis=0)
        state, out = int(scores.argmax()), []
        for row, back in zip(rows[::-1], trace[::-1], strict=True):
            out.append((conv, row["chunk"], int(back[state]), state))
            state = int(back[state])
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["conv_id", "chunk", "entry", "leave"])


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def _write_turns(model: Model):
    names = ["conv_id", "turn", "segment", "role", "n_lines", "rendered"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def run(batches):
        out: list[tuple] = []
        for (conv, _), rows in _runs(batches, ["conv_id", "chunk"]):
            texts = [r["text"].split("\n") for r in rows]
            found = decode(model, texts, None if rows[0]["opens"] else rows[0]["entry"], rows[0]["leave"])
            for row, lines, roles in zip(rows, texts, found, strict=True):
                cuts = [0, *(np.flatnonzero(np.diff(roles)) + 1).tolist(), len(lines)]
                for segment, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    own = [line[marker(line)[1] :] if ROLES[roles[a]] == marker(line)[0] else line for line in lines[a:b]]
                    out.append((conv, row["turn"], segment, ROLES[roles[a]], b - a, render(ROLES[roles[a]], "\n".join(own).strip())))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def parse_transcripts(
    turns: DataFrame, model: Model | None = None, conv_id: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role", learn: Column | None = None, chunk_turns: int = CHUNK_TURNS
) -> DataFrame:
    """``(conv_id, turn, segment, role, n_lines, rendered)``: the turns of all conversations with the roles that their lines tell.

    The role column is only read to fit a model, from turns that meet ``learn``; without a model and without any
    known role, markers alone decide. Lines of one text change the role at a marker at most; each run of
    lines of one role is a segment, rendered without its marker. Text without lines is an empty turn. Rows alike in conversation, turn and
    text are one turn; several texts of one turn follow each other by a hash. Null turns come first, as turn -1;
    rows without a conversation are conversations of one turn each, told by their text. No rows give no rows;
    columns other than the named are not read.

    A long conversation is cut into chunks of ``chunk_turns`` turns. Each chunk is first summed up
    as best scores from role to role, the chunks' sums (a few numbers each) are
    followed through the conversation, and then each chunk is decoded between the roles at its borders: the path is the
    best of the whole, and no task reads a whole long conversation. Turns of one chunk are read as a stream.
    """
    if model is None:
        model = fit(turns if learn is None else turns.filter(learn), conv_id, turn, role, text)
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit(""))))).alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).dropDuplicates()
    rows = save(rows.withColumn("chunk", F.floor(F.col("turn") / chunk_turns)), "turns")
    chunks = save(rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n")), "chunks")
    heads = chunks.groupBy("conv_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    chunks = chunks.join(heads, "conv_id").select("conv_id", "chunk", (F.col("chunk") == F.col("first")).alias("opens"), (F.col("first") < F.col("last")).alias("long"))
    long_chunks = save(chunks.filter("long").select("conv_id", "chunk", "opens"), "long-chunks")
    order = F.xxhash64("text")

    def streamed(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", order)

    long_rows = sized_join(rows, long_chunks, ["conv_id", "chunk"], staged=True)
    sums = map_arrow(streamed(long_rows), _transfer(model), "conv_id string, chunk long, best array<double>")
    borders = map_arrow(sums.repartition("conv_id").sortWithinPartitions("conv_id", "chunk"), _borders, "conv_id string, chunk long, entry int, leave int")
    borders = save(borders.join(long_chunks, ["conv_id", "chunk"]), "borders")
    known = sized_join(rows, borders, ["conv_id", "chunk"], "left", staged=True).withColumn("opens", F.coalesce("opens", F.lit(True)))
    found = map_arrow(streamed(known), _write_turns(model), "conv_id string, turn long, segment int, role string, n_lines int, rendered string")
    conv = F.when(F.substr("conv_id", F.lit(1), F.lit(1)) == "c", F.substr("conv_id", F.lit(2)))
    return found.withColumn("conv_id", conv.cast(turns.schema[conv_id].dataType))
