"""Katz backoff language model: Good-Turing discounted word pairs over single words, with exactly normalised backoff weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import map_arrow, save
from traitframe.llm.exchange import Batch, by_part, meet, n_parts, pack, pack_texts, read_batch, send, unpack, with_answers
from traitframe.llm.words import mix, words_of

DISCOUNTED = 5
BATCH_BYTES = 12 << 20
END, START = np.uint64(0x5EED0E0D5EED0E0D), np.uint64(0x5EED57A25EED57A2)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Discounts:
    """What is left of a count: ``kept[r]`` of r for r up to ``DISCOUNTED``, all of it above."""

    kept: np.ndarray

    @staticmethod
    def good_turing(of_counts: np.ndarray) -> Discounts:
        """From how many n-grams have each count 1, 2, ... ``DISCOUNTED`` + 1.

        Katz' discounts ``(r* / r - a) / (1 - a)`` with ``r* = (r + 1) n[r + 1] / n[r]`` and
        ``a = (k + 1) n[k + 1] / n[1]`` for the largest k for which all of them lie between 0 and 1; if there is none, half a
        count is taken from each of the counts up to ``DISCOUNTED``.
        """
        n = np.concatenate(([0.0], of_counts.astype(float)))
        for k in range(DISCOUNTED, 0, -1):
            if (n[1 : k + 2] <= 0).any():
                continue
            r = np.arange(1, k + 1)
            a = (k + 1) * n[k + 1] / n[1]
            if a >= 1:
                continue
            kept = ((r + 1) * n[2 : k + 2] / n[1 : k + 1] / r - a) / (1 - a)
            if ((kept > 0) & (kept < 1)).all():
                return Discounts(np.concatenate(([1.0], kept, np.ones(DISCOUNTED - k))))
        return Discounts(np.concatenate(([1.0], 1 - 0.5 / np.arange(1, DISCOUNTED + 1))))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """The discounted counts."""
        return counts * np.where(counts <= DISCOUNTED, self.kept[np.minimum(counts, DISCOUNTED)], 1.0)


@dataclass
class Model:
    """Numbers of the whole corpus: tokens, different tokens, and the discounts of words and pairs."""

    tokens: int
    types: int
    words: Discounts
    pairs: Discounts
    freed: float  # what the discounts of words leave to the unknown word

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their count; zero stands for any unknown word. All add up to one."""
        total = self.tokens + (self.freed == 0)  # nothing discounted: the unknown word takes one count
        unknown = (self.freed or 1.0) / max(total, 1)
        return np.where(counts > 0, self.words(counts) / max(total, 1), unknown)

    def pair(self, counts: np.ndarray, before: np.ndarray, weight: np.ndarray, scale: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of a word after another: its own if the pair was seen, else what the weight leaves of the word's.

        ``word`` is the probability one order lower, so the recursion ends at :meth:`word`.
        """
        seen = self.pairs(counts) / np.maximum(before, 1) * scale
        return np.where(counts > 0, seen, np.where(before > 0, weight, 1.0) * word)


class _Tokens:
    """Tokens of a batch: words and an end for each text, with the word before, as hashes, and their different kinds."""

    def __init__(self, batch: Batch):
        token, counts = [], []
        for chunk in batch.chunks():
            words = words_of(chunk)
            ends = np.full(len(words.hash) + len(chunk.rows), END)
            ends[np.arange(len(words.hash)) + np.repeat(np.arange(len(chunk.rows)), words.counts)] = words.hash
            token.append(ends)
            counts.append(words.counts + 1)
        self.token = np.concatenate(token) if token else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        first = np.cumsum(self.counts) - self.counts
        self.before = np.concatenate(([START], self.token[:-1])) if len(self.token) else self.token
        self.before[first] = START
        self.learned = np.repeat(batch.flags, self.counts)
        self.pair = mix(self.before * _PAIR + self.token)
        self.batch = batch

    def kinds(self, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part its words and pairs with their counts in learned texts, in a fixed order."""
        found = []
        for key in (self.token, self.pair):
            kind, count = unique_counts(key, self.learned)
            found.append({p: own for p, own in by_part((kind % np.uint64(parts)).astype(np.int64), parts, kind, count)})
        none = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for p in sorted(found[0].keys() | found[1].keys()):
            yield p, *found[0].get(p, none), *found[1].get(p, none)


def unique_counts(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, and how often each is counted."""
    order = np.argsort(keys)
    fresh = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[order][fresh], np.add.reduceat(counted[order].astype(np.int64), fresh) if len(fresh) else np.zeros(0, np.int64)


_KINDS = (np.uint64, np.uint32, np.uint64, np.uint32)


def _send_counts(parts: int):
    def emit(batch: Batch, _) -> Iterator[tuple[int, bytes]]:
        for p, words, n_words, pairs, n_pairs in _Tokens(batch).kinds(parts):
            yield p, pack(words, n_words.astype(np.uint32), pairs, n_pairs.astype(np.uint32))

    return emit


def _add_counts(part: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Tell each batch the counts over all batches where they differ from its own, and which of them the batch stands for.

    What every n-gram of the part counts goes into one more row, under a negative number, as numbers of n-grams by count.
    """
    own = [unpack(blob, *_KINDS) for _, blob in rows]
    told: list[list[np.ndarray]] = [[] for _ in rows]
    stats = []
    for at in (0, 2):
        sizes = [len(o[at]) for o in own]
        source = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(source)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        count = np.concatenate([o[at + 1] for o in own]).astype(np.int64)
        order = np.argsort(np.concatenate([o[at] for o in own]), kind="stable")
        key = np.concatenate([o[at] for o in own])[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        group = np.cumsum(fresh) - 1
        total = np.add.reduceat(count[order], np.flatnonzero(fresh)) if len(key) else count
        stats.append(np.concatenate(([total.sum(), (total > 0).sum()], np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2])))
        # the first batch that counts an n-gram stands for it
        counts_it = count[order] > 0
        running = np.cumsum(counts_it) - counts_it
        stands = counts_it & (running == running[np.flatnonzero(fresh)][group]) if len(key) else counts_it
        differs = total[group] != count[order]
        for b, (i, t, s) in by_part(source[order][differs], len(rows), place[order][differs], total[group][differs], stands[differs]):
            told[b] += [i.astype(np.uint32), t, s.astype(np.uint8)]
        for b in range(len(rows)):
            if len(told[b]) < (3 if at == 0 else 6):
                told[b] += [np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint8)]
    for (batch, _), answer in zip(rows, told, strict=True):
        yield batch, pack(np.array([part]), *answer)
    yield -1 - part, pack(*(s.astype(np.int64) for s in stats))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f"{kind}{i}" for kind in ("w", "p") for i in range(DISCOUNTED + 3)]
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            numbers = np.concatenate(unpack(blob, np.int64, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int64()) for n in numbers], names)


class _Counts:
    """Counts over all batches of the words and pairs of one batch, from its own and the answers."""

    def __init__(self, tokens: _Tokens, answers: list[bytes], parts: int):
        told = {int(x[0][0]): x[1:] for x in (unpack(a, np.int64, *(np.uint32, np.int64, np.uint8) * 2) for a in answers)}
        found: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for p, words, n_words, pairs, n_pairs in tokens.kinds(parts):
            for k, (kind, count) in enumerate(((words, n_words), (pairs, n_pairs))):
                index, total, stands = told[p][3 * k : 3 * k + 3]
                whole, mine = count.copy(), count > 0
                whole[index], mine[index] = total, stands == 1
                for x, out in zip((kind, whole, mine), found[3 * k : 3 * k + 3], strict=True):
                    out.append(x)
        kinds = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]
        self.word, self.word_count, _ = self._sorted(*kinds[:3])
        self.pair, self.pair_count, self.pair_mine = self._sorted(*kinds[3:])

    @staticmethod
    def _sorted(kind, *rest):
        order = np.argsort(kind)
        return kind[order], *(x[order] for x in rest)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        return self.word_count[np.searchsorted(self.word, hashes)]

    def before(self, hashes: np.ndarray) -> np.ndarray:
        """How often a word was followed by another; a text's start as often as there are texts, so ends."""
        return self.words(np.where(hashes == START, END, hashes))


def _histories(tokens: _Tokens, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    kind = np.unique(tokens.before)
    yield from ((p, own[0]) for p, own in by_part((kind % np.uint64(parts)).astype(np.int64), parts, kind))


def _send_freed(parts: int, model: Model):
    """For each word before another: its count, what the discounts of its pairs leave, and the probabilities of the words seen after it."""

    def emit(batch: Batch, answers) -> Iterator[tuple[int, bytes]]:
        tokens = _Tokens(batch)
        counts = _Counts(tokens, answers[0], parts)
        order = np.argsort(tokens.pair)
        first = order[np.flatnonzero(np.concatenate(([True], tokens.pair[order][1:] != tokens.pair[order][:-1])))] if len(order) else order
        mine = counts.pair_mine & (counts.pair_count > 0)  # pairs in the order of their hash, as in ``first``
        n, before, word = counts.pair_count[mine], tokens.before[first[mine]], tokens.token[first[mine]]
        freed, seen = n - model.pairs(n), model.word(counts.words(word))
        kind = np.unique(tokens.before)
        at = np.searchsorted(kind, before)
        sums = [np.bincount(at, x, len(kind)) for x in (freed, seen)]
        for p, own in by_part((kind % np.uint64(parts)).astype(np.int64), parts, kind, counts.before(kind), *sums):
            yield p, pack(*own)

    return emit


def _weigh(model: Model):
    def answer(part: int, rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        """Backoff weight of each word before another, and the scale of its seen pairs, in the order a batch asked."""
        own = [unpack(blob, np.uint64, np.int64, np.float64, np.float64) for _, blob in rows]
        kind, back = np.unique(np.concatenate([o[0] for o in own]), return_inverse=True)
        count = np.zeros(len(kind), np.int64)
        count[back] = np.concatenate([o[1] for o in own])
        freed, seen = (np.bincount(back, np.concatenate([o[i] for o in own]), len(kind)) for i in (2, 3))
        none = freed < 1e-9  # nothing discounted after this word: unseen words take one count
        left = np.where(none, 1.0, freed) / np.maximum(count + none, 1)
        scale = np.where(none, count / np.maximum(count + 1, 1), 1.0)
        weight = left / np.maximum(1 - seen, model.word(np.zeros(1, np.int64))[0])
        at = 0
        for (batch, _), o in zip(rows, own, strict=True):
            mine = back[at : at + len(o[0])]
            at += len(o[0])
            yield batch, pack(np.array([part]), weight[mine], scale[mine])

    return answer


def _score(parts: int, model: Model):
    names = ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for k in range(row.num_rows):  # one at a time: a row holds a batch of texts and all answers to it
                texts, answers, weights = (row.column(c)[k].as_py() or [] for c in ("texts", "counts", "weights"))
                batch = read_batch(row.column("batch")[k].as_py(), texts)
                tokens = _Tokens(batch)
                batch.data = texts = None
                counts = _Counts(tokens, answers, parts)
                pairs = counts.pair_count[np.searchsorted(counts.pair, tokens.pair)]
                answers = tokens.pair = counts.pair = counts.pair_count = counts.pair_mine = None
                told = {int(x[0][0]): x[1:] for x in (unpack(a, np.int64, np.float64, np.float64) for a in weights)}
                asked = list(_histories(tokens, parts))
                kind = np.concatenate([own for _, own in asked])
                weight, scale = (np.concatenate([told[p][i] for p, _ in asked]) for i in (0, 1))
                told = asked = weights = None
                order = np.argsort(kind)
                at = order[np.searchsorted(kind[order], tokens.before)].astype(np.uint32)
                before = counts.before(tokens.before)
                n = counts.words(tokens.token)
                tokens.before = tokens.token = None
                chance = np.log10(model.pair(pairs, before, weight[at], scale[at], model.word(n)))
                pairs = before = at = None
                first = np.cumsum(tokens.counts) - tokens.counts
                score = np.add.reduceat(chance, first)
                chance = None
                base = np.add.reduceat(np.log10((n + 1) / (model.tokens + model.types + 1)), first)
                known = np.add.reduceat((n > 0).astype(np.int64), first)
                columns = [pa.array(x) for x in (batch.id_column(), batch.flags, tokens.counts, known, np.full(len(first), model.tokens), base, score)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def score_texts(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score)``: one row per document.

    The model learns from the documents that meet ``learn``, a condition on the column ``id``, and scores all. Tokens are words,
    A-Z as a-z, and an end; ``n_known`` counts tokens that were learned. ``base_score`` sums log10 of add-one word probabilities,
    ``score`` log10 of the backoff model's: a word's probability after the one before it, or after the text's start.
    Pairs and words seen up to ``DISCOUNTED`` times are discounted by Good-Turing; what that frees after a word goes to
    words not seen after it, by their own probability, so that all probabilities after any word add up to one. Unknown words share
    what discounts free over all words.

    Null and empty texts are an end alone. Rows without an id are scored, not learned from. Repeated rows count
    as documents each. With nothing to learn from all words are unknown. No rows give no rows; columns other than the two named are not read.

    Texts are packed once. Counts are kept in saved tables by batch and part of the key space: a batch sends its different words and
    pairs, gets back the counts where others have them too, then asks for the weights of the words before. All words and
    pairs of the corpus are counted, and what moves grows with them.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    batches = pack_texts(rows.select("id", F.coalesce(F.col("id").isNotNull() & learn, F.lit(False)).alias("flag"), "text"), batch_bytes)
    parts = n_parts(batches)
    told = save(meet(send(batches, _send_counts(parts)), parts, _add_counts), "ngram-counts")
    names = [f"{kind}{i}" for kind in ("w", "p") for i in range(DISCOUNTED + 3)]
    sums = map_arrow(told.filter("batch < 0").select("blob"), _totals, ", ".join(f"{n} long" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
    numbers = np.array([n or 0 for n in sums], np.int64).reshape(2, -1)
    words, pairs = (Discounts.good_turing(n[2:]) for n in numbers)
    each = np.arange(1, DISCOUNTED + 1)
    model = Model(int(numbers[0][0]), int(numbers[0][1]), words, pairs, float((numbers[0][2 : 2 + DISCOUNTED] * (each - words(each))).sum()))
    counted = with_answers(batches, told.filter("batch >= 0"), "counts")
    weights = save(meet(send(counted, _send_freed(parts, model), ("counts",)), parts, _weigh(model)), "backoff-weights")
    ready = with_answers(counted, weights, "weights").select("batch", "texts", "counts", "weights")
    return map_arrow(ready, _score(parts, model), "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
