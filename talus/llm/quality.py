"""Quality rules: gradient-boosted trees over document statistics.

The statistics of a batch of whole texts are computed together on its bytes with numpy.
The trees are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``), with
monotonic constraints on chosen features, and flattened into node arrays, so scoring a
batch walks all trees at once.

Defined results: a null text has no words and fails the base rules; without labelled rows
of both classes the verdict is the base rules' alone; repeated rows score alike; an empty
table gives an empty result; only doc_id and text (and the labels' doc_id and quality)
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, mixed, prefix_hash, sliced, span_hash, table, word_spans

SAMPLE_ROWS, TREES, DEPTH, RATE, BINS, WINDOW = 20_000, 60, 3, 0.2, 32, 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and the direction in which they may move the score (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "stop_share": 0, "line_words": 0, "distinct_share": 0}


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _STOP = _class(b"#*$%&|<>"), _class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b".!?")


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """BASE and the counts behind FEATURES, one entry a text."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    stops = np.cumsum(sizes + 1) - 1  # each text ends before a newline
    starts = stops - sizes
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    n = len(texts)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[stops] - total[starts]

    first, last = word_spans(buf)
    doc = np.searchsorted(stops, first, "right")
    words = np.bincount(doc, minlength=n)
    prefix = prefix_hash(buf)
    salt = mixed(np.arange(1, n + 1, dtype=np.uint64))
    in_word = np.zeros(len(buf) + 1, np.int8)
    in_word[first] += 1
    in_word[last] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).view(bool)

    ends = np.flatnonzero(buf == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    filled = np.searchsorted(first, ends) > np.searchsorted(first, begins)
    begins, ends = begins[filled], ends[filled]
    line_doc = np.searchsorted(stops, begins, "right")
    _, kept = np.unique(span_hash(prefix, begins, ends) ^ salt[line_doc], return_index=True)
    lines = np.bincount(line_doc, minlength=n)

    names = span_hash(prefix, first, last)
    _, distinct = np.unique(names ^ salt[doc], return_index=True)
    cover = np.zeros(len(first) + 1, np.int64)
    if len(first) >= WINDOW:
        at = np.arange(len(first) - WINDOW + 1)
        at = at[doc[at] == doc[at + WINDOW - 1]]
        _, which, count = np.unique(span_hash(prefix_hash(names), at, at + WINDOW) ^ salt[doc[at]], return_inverse=True, return_counts=True)
        at = at[count[which] > 1]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": words,
        "word_chars": per_text(in_word & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[buf]),
        "n_dup_lines": lines - np.bincount(line_doc[kept], minlength=n),
        "n_repeat_words": np.bincount(doc[covered], minlength=n),
        "lines": lines,
        "upper": per_text(_UPPER[buf]),
        "digits": per_text(_DIGIT[buf]),
        "stops": per_text(_STOP[buf]),
        "distinct": np.bincount(doc[distinct], minlength=n),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(s[k], 1).astype(float) for k in ("n_words", "word_chars", "lines"))
    return np.column_stack([np.log1p(s["n_words"]), chars / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["upper"] / chars, s["digits"] / chars, s["stops"] / words, words / lines, s["distinct"] / words])


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


@dataclass
class Forest:
    """Trees as node arrays: node i goes to left[i] if its feature is at most cut[i], else left[i] + 1; leaves stay."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            leaf = self.left[at] < 0
            at = np.where(leaf, at, self.left[at] + (x[rows, self.feature[at]] > self.cut[at]))
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(axis=1))))


def boost(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = 1.0) -> Forest | None:
    """Newton boosting of the logistic loss on binned features; None unless both classes are there.

    Under a constraint a split whose leaves would be out of order isn't taken, and the
    mean of the two bounds what stands below either side.
    """
    if not 0 < y.sum() < len(y):
        return None
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), bias)
    feature, cut, left, value, roots = [], [], [], [], []

    def node(v: float) -> int:
        for a, b in ((feature, 0), (cut, 0.0), (left, -1), (value, v)):
            a.append(b)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(node(0.0))
        open_ = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_:
            at, rows, low, high, level = open_.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, 0, 0, 0.0, 0.0)
            for f in range(x.shape[1]) if level < depth else ():
                b = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(cuts[f]) + 1))[:-1] for w in (g[rows], h[rows], None))
                gr, hr = gs - gl, hs - hl
                wl, wr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                gain = gl * wl - (hl + ridge) * wl**2 / 2 + gr * wr - (hr + ridge) * wr**2 / 2 - gs**2 / (hs + ridge) / 2
                gain[(nl < 5) | (len(rows) - nl < 5) | (monotone[f] * (wr - wl) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], f, k, wl[k], wr[k])
            if best[0] <= 1e-6:
                value[at] = rate * float(np.clip(gs / (hs + ridge), low, high))
                margin[rows] += value[at]
                continue
            _, f, k, wl, wr = best
            feature[at], cut[at], left[at] = f, float(cuts[f][k]), node(0.0)
            node(0.0)
            mid, down = (wl + wr) / 2, binned[rows, f] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[f]]
            open_ += [(left[at], rows[down], *bounds[0], level + 1), (left[at] + 1, rows[~down], *bounds[1], level + 1)]
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots), bias)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Fits on at most about ``sample_rows`` labelled documents; of repeated ids the first text and the largest label count once."""
    rows = bounded_sample(labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), sample_rows, "doc_id")
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # sample_rows bounds what is broadcast and collected
    found = found.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s in sliced(texts):
                x = features(statistics(texts[s]))
                yield pa.RecordBatch.from_arrays([batch.column("quality")[s.start : s.stop].cast(pa.float64()), *(pa.array(x[:, f]) for f in range(x.shape[1]))], names=["y", *FEATURES])

    got = found.mapInArrow(measured, "y double, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    x = got[list(FEATURES)].to_numpy(float)
    order = np.lexsort((*x.T, got["y"].to_numpy()))  # the same trees whatever order rows come in
    return boost(x[order], got["y"].to_numpy()[order], list(FEATURES.values())) if len(got) else None


def judged(docs: DataFrame, forest: Forest | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, BASE, base_failed, kept, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in sliced(texts):
                stats = statistics(texts[s])
                failed = base_failed(stats)
                quality = shared.value.score(features(stats)) if shared.value else np.ones(len(failed))
                yield pa.RecordBatch.from_arrays([batch.column(0)[s.start : s.stop], *(pa.array(stats[b].astype(np.int64)) for b in BASE), pa.array(failed), pa.array(~failed & (quality >= 0.5)), pa.array(quality)], names=[key, *BASE, "base_failed", "kept", "score"])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(judge, f"`{key}` {kind}, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, kept boolean, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
