"""Ranked search and vector codes against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talus.llm import codes, ranking
from talus.llm.common import shipped

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in _TERM.findall(text or "")]


def brute_ranks(docs, items, top=10):
    held = [(d, collections.Counter(words(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return collections.Counter(out)


DOCS = [(i, t) for i, t in enumerate([None, "", " .,;", "one two three", "One TWO three", "one two three", "été Été ÉTÉ naïve_x", "a\x85b a", "word " * 5000 + "rare", "two " * 40, "7 seven 7"])]
DOCS += [(100 + i, f"one common{i % 3} text of number {i}") for i in range(40)] + [(None, "one two three"), (3, "one two three"), (-5, "two one")]
ITEMS = [(1, "one two TWO"), (2, None), (3, "..."), (4, "absent"), (5, "rare word été"), (5, "7"), (None, "common1 common2 of"), (8, "b")]


@pytest.mark.parametrize("window, block", [(4096, 1 << 20), (3, 10)])
def test_ranks_equal_brute_force(spark, monkeypatch, window, block):
    shipped(spark)
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in DOCS], "doc_id long, text string, score int, item_id string").repartition(4)
    items = spark.createDataFrame([(i, t, "r") for i, t in ITEMS], "item_id long, text string, rank string")
    plain = ranking.windows
    monkeypatch.setattr(ranking, "windows", lambda *a, **k: plain(*a, **k, window=window))
    got = collections.Counter(tuple(r) for r in ranking.ranked(docs, items, block=block).collect())
    assert got == brute_ranks(DOCS, ITEMS)


def test_ranks_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(3), items)):
        out = ranking.ranked(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and not out.collect()


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "alpha beta, gamma " * 400_000
    assert ranking._counted(text, {b"alpha": 0, b"gamma": 1})[0] == 1_200_000
    assert ranking._counted(text, {b"alpha": 0, b"gamma": 1})[2].tolist() == [400_000] * 2


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 70), st.integers(1, 5), st.integers(0, 2**32 - 1), st.sampled_from([2, 30, 10**7]))
def test_annulus_holds_the_nearest(n, width, seed, most):
    rng = np.random.default_rng(seed)
    entries, queries = rng.integers(-most, most + 1, (n, width)), rng.integers(-most, most + 1, (50, width))
    at, far = codes.nearest(queries, entries, room=256)
    every = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    good = [(k, [math.floor(scale * x) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v, _ in good) // parts))
    good = [(k, v + [0] * (parts * width - len(v)), lab) for k, v, lab in good]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in good[:entries]] for p in range(parts)]
    near = lambda q, p: min((sum((a - b) ** 2 for a, b in zip(q, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = collections.defaultdict(list)
        for (_, v, _), p in itertools.product(good, range(parts)):
            moved[p, near(cut(v, p), p)[1]].append(cut(v, p))
        for (p, e), own in moved.items():
            books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [(k, [near(cut(v, p), p) for p in range(parts)], lab) for k, v, lab in good]
    total = collections.Counter()
    for _, f, lab in found:
        total[lab] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((k, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), total[lab], digest) for k, f, lab in found)


def test_codes_equal_brute_force(spark):
    shipped(spark)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=32)], int(rng.integers(3)) if i % 5 else None) for i in range(150)]
    rows += [(None, [0.5] * 32, 1), (3, [0.25] * 32, 2), (3, [0.25] * 32, 2), (500, None, 1), (501, [1.0, None], 1), (502, [math.nan] * 32, 1), (503, [math.inf] + [0.0] * 31, 1), (504, [], 2), (505, [1.0] * 7, None)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, k int").repartition(3)
    assert collections.Counter(tuple(r) for r in codes.encoded(df).collect()) == brute_codes(rows)
    few = [r for r in rows if r[0] in (1, 2, 3)]
    assert collections.Counter(tuple(r) for r in codes.encoded(df.filter("vec_id in (1, 2, 3)")).collect()) == brute_codes(few)
    assert codes.encoded(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not codes.encoded(df.filter("vec_id = 500")).collect()


def test_vectors_are_scaled_whole():
    lists = pa.array([[0.1, -0.1], [], [1e30]], pa.list_(pa.float32()))
    assert codes.scaled(lists, 2).tolist() == [[25, -26], [0, 0], [1 << 26, 0]]
