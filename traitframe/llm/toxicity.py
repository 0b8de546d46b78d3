"""Toxicity scores of texts by a convolutional classifier over hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitframe.llm.common import boxed, map_arrow, save
from traitframe.llm.words import Texts, lower_case, mix, ranges_hash, text_chunks, words_of
from traitframe.operators.joins import sized_join

BUCKETS = 1 << 18
PREFIXES = (4, 6)
ROWS = 1 + len(PREFIXES)
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS, MAX_EPOCHS, MIN_STEPS = 6, 40, 1200
BATCH = 32
RATE = 0.01
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 24 << 20
MIN_PRECISION = 0.9
MIN_POSITIVES = 20


@dataclass
class Model:
    embedding: np.ndarray  # buckets x dimensions; the last row pads
    filters: list[np.ndarray]  # one of (width * dimensions) x filters for each width
    bias: np.ndarray  # of the filters
    weight: np.ndarray  # of the pooled filters, with the constant last
    scale: float = 1.0
    shift: float = 0.0


def bucket_ids(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets for each word, and the words of each text.

    A word's vector is the sum of a row for the word and one for each of its
    beginnings of ``PREFIXES`` bytes. Forms of one stem so share what was learned, and a word
    that meets another in one row is still told apart by the rest. Marks next to a word are words of their own.
    """
    words = words_of(texts, pieces=True)
    data = lower_case(texts.data)
    begins = [ranges_hash(data, words.start, np.minimum(words.end, words.start + n)) + np.uint64(n) for n in PREFIXES]
    return np.stack([mix(h) % np.uint64(BUCKETS) for h in (words.hash, *begins)]).astype(np.int32), words.counts


def padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts end to end, each text followed by as many pads as the widest filter has words; first places."""
    pad = max(WIDTHS)
    out = np.full((ROWS, int(counts.sum()) + pad * (len(counts) + 1)), BUCKETS, np.int32)
    out[:, np.arange(ids.shape[1]) + np.repeat(np.arange(len(counts)) * pad, counts)] = ids
    return out, np.concatenate(([0], np.cumsum(counts + pad)[:-1]))


def response_tables(model: Model) -> list[list[np.ndarray]]:
    """What a row of the embedding adds to each filter, for each word of a filter."""
    return [[model.embedding @ f[k * DIMENSIONS : (k + 1) * DIMENSIONS] for k in range(w)] for w, f in zip(WIDTHS, model.filters, strict=True)]


def logits(model: Model, tables: list[list[np.ndarray]], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Scores before the sigmoid of whole texts laid end to end. Windows begin at a text's words or at its first pad."""
    if not len(counts):
        return np.zeros(0)
    seq, first = padded(ids, counts)
    n = seq.shape[1] - max(WIDTHS) + 1
    spans = np.stack((first, first + counts + 1), axis=1).ravel()
    pooled = []
    for own in tables:
        value = sum(t[seq[row, k : k + n]] for k, t in enumerate(own) for row in range(ROWS))
        pooled.append(np.maximum.reduceat(value, spans[:-1] if spans[-1] >= n else spans, axis=0)[::2])
    hidden = np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0)
    return hidden @ model.weight[:-1] + model.weight[-1]


def train(ids: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam on mini batches; only the places that won the max pooling pass a gradient down.

    Labels are weighed so that both classes count alike, and a text without words is taught as label 0. One class alone gives a constant model.
    """
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    model = Model(
        np.vstack((rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), np.zeros((1, DIMENSIONS)))).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w), (w * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        np.concatenate((rng.normal(0, 0.3, total), [0.0])).astype(np.float32),
    )
    positive = float(labels.mean()) if len(labels) else 0.0
    if positive in (0.0, 1.0):
        model.weight[:] = 0
        model.weight[-1] = 4.0 if positive else -4.0
        return model
    ids, labels = [*ids, np.zeros((ROWS, 0), np.int32)], np.append(labels, 0.0)  # the last, without words, is in every batch
    share = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
    dense = [*model.filters, model.bias, model.weight]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    second = np.zeros(BUCKETS + 1, np.float32)
    step, epochs = 0, min(MAX_EPOCHS, max(EPOCHS, -(-MIN_STEPS * BATCH // len(ids))))
    for epoch in range(epochs):
        order = rng.permutation(len(ids) - 1)
        rate = RATE * (1 - 0.8 * epoch / epochs)
        for at in range(0, len(order), BATCH):
            rows = np.append(order[at : at + BATCH], len(ids) - 1)
            counts = np.array([ids[r].shape[1] for r in rows])
            seq, first = padded(np.concatenate([ids[r] for r in rows], axis=1), counts)
            vectors = model.embedding[seq].sum(axis=0)
            n = seq.shape[1] - max(WIDTHS) + 1
            pooled, places = [], []
            for width, filters in zip(WIDTHS, model.filters, strict=True):
                value = sum(vectors[k : k + n] @ filters[k * DIMENSIONS : (k + 1) * DIMENSIONS] for k in range(width))
                won = np.array([a + value[a : a + c + 1].argmax(axis=0) for a, c in zip(first, counts, strict=True)])
                pooled.append(value[won, np.arange(FILTERS)])
                places.append(won)
            raw = np.concatenate(pooled, axis=1) + model.bias
            hidden = np.maximum(raw, 0)
            z = hidden @ model.weight[:-1] + model.weight[-1]
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * share[rows] / len(rows)).astype(np.float32)
            down = (error[:, None] * model.weight[:-1]) * (raw > 0)
            grads, rows_of, parts = [], [], []
            for i, (width, filters) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                own = down[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(filters)
                for k in range(width):
                    where = places[i] + k
                    piece = slice(k * DIMENSIONS, (k + 1) * DIMENSIONS)
                    grad[piece] = np.einsum("bfd,bf->df", vectors[where], own)
                    part = (own[:, :, None] * filters[piece].T[None]).reshape(-1, DIMENSIONS)
                    for row in range(ROWS):
                        rows_of.append(seq[row, where.ravel()])
                        parts.append(part)
                grads.append(grad)
            grads += [down.sum(axis=0), np.concatenate((hidden.T @ error, [error.sum()])) + 1e-4 * model.weight]
            step += 1
            for p, g, (m, v) in zip(dense, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            touched, inverse = np.unique(np.concatenate(rows_of), return_inverse=True)
            gradient = np.zeros((len(touched), DIMENSIONS), np.float32)
            np.add.at(gradient, inverse, np.concatenate(parts))
            real = touched < BUCKETS
            touched, gradient = touched[real], gradient[real]
            second[touched] += (gradient * gradient).mean(axis=1)
            model.embedding[touched] -= 5 * rate * gradient / (np.sqrt(second[touched])[:, None] + 1e-6)
    return model


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column(0)):
            ids, counts = bucket_ids(chunk)
            cuts = np.concatenate(([0], np.cumsum(counts)))
            blobs = [ids[:, a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(int(chunk.rows[0]), len(chunk.rows)), pa.array(blobs, pa.binary())], ["label", "ids"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, seed: int = 7) -> Model:
    """Train on whole labelled texts of ``docs(_id, text)`` and ``labels(_id, label)``, half of them of either label where there are as many.

    The sample is bounded: at most ``sample_rows`` rows, those of the lowest hash of their
    text in each class, and of them as many as fit into ``sample_bytes`` of text. Rows without a
    label or text are left out; equal texts count once. The raw scores are then
    calibrated on every fifth row of the sample, kept out of training, and moved to the share of
    labels in all labelled rows, so that label 1 is likelier from 0.5 on. Labels meet hashes
    of texts, and only the texts of the sample move.
    """
    place = F.xxhash64(F.lit(seed), "text")
    thin = docs.filter("text is not null").select("_id", place.alias("place"), F.octet_length("text").alias("bytes"))
    thin = save(thin.join(labels, "_id").select("label", "place", "bytes").distinct(), "labelled")
    chosen, spent = [], {0: 0, 1: 0}
    for own in (0, 1):
        for r in thin.filter(F.col("label") == own).orderBy("place").limit(sample_rows // 2).collect():
            if spent[own] + r["bytes"] <= sample_bytes // 2:
                spent[own] += r["bytes"]
                chosen.append((r["place"], own))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "place long, label int"))  # sample_rows at most
    sample = docs.filter("text is not null").select("text", place.alias("place")).join(wanted, "place").dropDuplicates(["place", "label"])
    found = sorted((r["label"], bytes(r["ids"])) for r in map_arrow(sample.select("text", "label"), _sample_words, "label int, ids binary").collect())
    ids, labels = [np.frombuffer(b, np.int32).reshape(ROWS, -1) for _, b in found], np.array([k for k, _ in found], float)
    check = np.arange(len(ids)) % 5 == 0
    model = train([x for x, c in zip(ids, check, strict=True) if not c], labels[~check], seed)
    share = {r["label"]: r["count"] for r in thin.groupBy("label").count().collect()}
    _calibrate(model, ids, labels, check, (share.get(1, 0) + 1) / (sum(share.values()) + 2))
    return model


def _calibrate(model: Model, ids: list[np.ndarray], labels: np.ndarray, check: np.ndarray, share: float) -> None:
    """Scale raw scores to meet the labels kept out of training (two-parameter logistic fit), then move them to the ``share`` of label 1."""
    own, y = [x for x, c in zip(ids, check, strict=True) if c], labels[check]
    if len(y) < 20 or y.min() == y.max():
        return
    tables = response_tables(model)
    z = np.concatenate([logits(model, tables, x, np.array([x.shape[1]])) for x in own])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        slope = np.array([((p - target) * z).sum(), (p - target).sum()])
        bend = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(bend, slope)
        a, b = a - step[0], b - step[1]
    if a > 0:
        odds = lambda q: np.log(q / (1 - q))
        model.scale, model.shift = float(a), float(b + odds(share) - odds(y.mean()))


def score(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score``, 0 to 1, of every whole text. The model, of a fixed size, goes with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = response_tables(model)
        for batch in batches:
            found = []
            for chunk in text_chunks(batch.column(0), limit=1 << 20):
                z = logits(model, tables, *bucket_ids(chunk))
                found.append(1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30))))
            scores = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], [*batch.schema.names[1:], "score"])

    rows = docs.select(F.col(text).alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_arrow(rows, run, f"{schema}, score double")


def thresholds(scored: DataFrame, min_precision: float = MIN_PRECISION, bins: int = 1000) -> tuple[DataFrame, float]:
    """``(lang, threshold)`` and the limit of all languages, from ``scored(lang, score, label)`` of training rows: a score limit for each language.

    The least limit, 0.5 or higher, at which ``min_precision`` of the labelled documents
    above are toxic. A language with fewer than ``MIN_POSITIVES`` toxic documents borrows the counts of all
    languages. Scores are counted in ``bins`` steps, so a language gives a fixed number of rows; the
    sums over them are windows by language.
    """
    rows = scored.filter("label is not null").select("lang", F.floor(F.col("score") * bins).cast("int").alias("bin"), F.col("label").cast("int").alias("label"))
    counts = rows.groupBy("lang", "bin").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = save(counts, "score-counts")
    every = counts.groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()  # bins rows at most
    languages = counts.groupBy("lang").agg(F.sum("pos").alias("pos"))
    pos, n = np.zeros(bins + 1), np.zeros(bins + 1)
    for r in every:
        pos[r["bin"]], n[r["bin"]] = r["pos"], r["n"]
    above = np.cumsum(pos[::-1])[::-1], np.cumsum(n[::-1])[::-1]
    good = [k for k in range(bins // 2, bins + 1) if above[1][k] and above[0][k] >= min_precision * above[1][k]]
    common = good[0] / bins if good else 0.5
    over = Window.partitionBy("lang").orderBy(F.col("bin").desc())
    own = counts.withColumn("above_pos", F.sum("pos").over(over)).withColumn("above_n", F.sum("n").over(over))
    own = own.filter((F.col("bin") >= bins // 2) & (F.col("above_pos") >= min_precision * F.col("above_n")))
    own = own.groupBy(F.col("lang").alias("_lang")).agg((F.min("bin") / bins).alias("own"))
    out = languages.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.when(F.col("pos") >= MIN_POSITIVES, F.coalesce("own", F.lit(common))).otherwise(F.lit(common))
    return out.select("lang", limit.alias("threshold")), common


def judge(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
    **settings,
) -> DataFrame:
    """``(doc_id, lang, text_hash, score, threshold, rejected)``: one row per document.

    The classifier and the limits of each language learn from the documents with a label that meet
    ``learn``, a condition on the column ``_id``. Only the text enters a score; the language only chooses the
    limit that a score must reach to be rejected. Null and empty texts are scored as texts without words. Languages not
    seen with labels, and null, take the limit of all. Documents labelled several times count with each label;
    rows without an id are scored but not learned from. Without labels nothing is rejected by more than the
    constant model's score. No rows give no rows; columns other than the named are not read.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label")).filter("_id is not null and label is not null")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    chosen = learn if learn is not None else F.lit(True)
    model = fit(texts, known.filter(chosen), **settings)
    scored = save(score(docs, model, [F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")], text), "scores")
    trained = scored.withColumnRenamed("doc_id", "_id").join(known, "_id").filter(chosen)
    limits, common = thresholds(trained.select("lang", "score", "label"))
    limits = limits.withColumn("_key", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit(""))).drop("lang")
    keyed = scored.withColumn("_key", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("")))
    out = sized_join(keyed, limits, ["_key"], "left", salt_by=["doc_id"]).drop("_key")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(common)))
    return out.withColumn("rejected", F.col("score") >= F.col("threshold"))


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **settings) -> DataFrame:
    """``docs``, all columns, without those that :func:`judge` rejects. A verdict hangs on text and language alone, so rows with and without id are treated alike."""
    judged = judge(docs, labels, doc_id=doc_id, text=text, lang=lang, **settings)
    gone = judged.filter("rejected").select(F.col("text_hash").alias("_hash"), F.coalesce("lang", F.lit("")).alias("_lang")).distinct()
    keyed = boxed(docs, _hash=F.xxhash64(F.coalesce(F.col(text), F.lit(""))), _lang=F.coalesce(F.col(lang).cast("string"), F.lit("")))
    return sized_join(keyed, gone, ["_hash", "_lang"], "left_anti").select("row.*")
