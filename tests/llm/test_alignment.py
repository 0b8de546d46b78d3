"""Alignment of two tokenizers against whole texts encoded at once and compared byte by byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import SCHEMA, sentence
from traitframe.llm.alignment import Aligner, Fragment, align_tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), Aligner(A, B)


def whole(tools, text):
    """Ids and byte ends of both tokenizers, from the whole text; None if it has no tokens."""
    a, b, known = tools
    if not text:
        return None
    sides = []
    for ids, table in ((a.encode(" " + text, add_special_tokens=False).ids, known.a_bytes), (b.encode(text), known.b_bytes)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        sides.append((ids, np.cumsum([len(table[i]) for i in ids]).tolist()))
    return sides


def brute(tools, rows):
    linked, shown = [], []
    for _, text in rows:
        found = whole(tools, text)
        if found is None:
            linked.append([])
            shown.append(None)
            continue
        (a, a_ends), (b, b_ends) = found
        spans = [[(0 if k == 0 else e[k - 1], e[k]) for k in range(len(e))] for e in (a_ends, b_ends)]
        pairs, j = [], 0
        for i, (low, high) in enumerate(spans[0]):
            while spans[1][j][1] <= low:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < high:
                pairs.append((a[i], b[k]))
                k += 1
        linked.append(pairs)
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            x, y = [], []
            while i < len(a) and a_ends[i] <= cut:
                x.append(a[i])
                i += 1
            while j < len(b) and b_ends[j] <= cut:
                y.append(b[j])
                j += 1
            groups.append((x, y))
        shown.append((len(a), len(b), groups))
    counts = Counter(p for pairs in linked for p in set(pairs))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, _), pairs, item in zip(rows, linked, shown, strict=True):
        if item is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups = item
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best, total = sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs)
        out.append((doc, n_a, n_b, len(groups), len(pairs), best, total, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(edge_rows):
    rng = random.Random(11)
    rows = [(r[0], r[1]) for r in edge_rows]
    odd = ["a▁b", " lead", "two  spaces", "x \n\n  y", "tab\tand space x", "　wide 中文 字 text", "<s> </s> <unk> <0x41>", "emoji 👩‍👩‍👧 x\n🎈", "it's we'll I'd", "\n", "\n\nx\n", "...\r\nnext", " "]
    odd += ["é è\u0085 x", "nul\x00 byte", "a" * 700, "中文" * 400 + " x", "end ", "� replaced", "1234567890 12 3", "don't<|endoftext|>stop ▁ x", "– dash —  em"]
    long = ["\n".join(sentence(rng, rng.randint(1, 12)) for _ in range(60)), sentence(rng, 300) + "▁" + sentence(rng, 200), "z" * 5000 + " " + "é" * 900 + sentence(rng, 90), "word " * 400, "q" * 3000]
    return rows + [(10_000 + i, t) for i, t in enumerate(odd + long)] + [(10_000, long[0]), (None, long[0])]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, "w", 2, "r", 3, "i", 0.5) for d, t in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("limits", [{}, {"chunk_bytes": 61}, {"chunk_bytes": 500, "count_rows": 0}])
def test_alignment_equals_whole_texts(spark, tools, edge_rows, limits):
    rows = odd_rows(edge_rows)
    found = align_tokenizers(frame(spark, rows), A, B, **limits).collect()
    want = brute(tools, rows)
    assert sorted(map(tuple, found), key=str) == want
    assert sum(r[1] == 0 for r in want) > 5


def test_empty_table(spark, nothing):
    assert align_tokenizers(nothing, A, B).collect() == []


@given(st.lists(st.text(alphabet="ab é\n 　中. ", max_size=9), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_fragments_compose_in_any_tree(tools, parts):
    """Left to right and right to left give the same ends, and the closed parts in place give the text."""
    data = [p.encode() for p in parts]
    made = [Fragment.of(d, tools[2].safe) for d in data]

    def text(fragment, closed):
        return fragment.prefix + closed + (fragment.suffix or b"")

    left, inner = made[0]
    for fragment, own in made[1:]:
        left, between = left.then(fragment)
        inner = inner + between + own
    right, rest = made[-1]
    for fragment, own in made[-2::-1]:
        right, between = fragment.then(right)
        rest = own + between + rest
    assert (left, inner) == (right, rest)
    assert text(left, inner) == b"".join(data)


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,-0aAzé  　中▁"), st.characters(codec="utf-8")), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_units_give_the_ids_of_whole_texts(tools, text):
    data = np.frombuffer((" " + text).encode(), np.uint8)
    fine, ids, counts = tools[2].encode(data, np.array([0, len(data)]))
    want = whole(tools, text)
    if want is None:
        assert not fine[0] and counts["a"][0] == 0
    else:
        assert (ids["a"].tolist(), ids["b"].tolist()) == (want[0][0], want[1][0])
