"""Language identification by words first, then ever shorter character n-grams.

A known word scores its log frequency in each language. An unseen word is cut from left to
right into the longest known n-grams, from ``LONGEST`` characters down to one, and scores
their log frequencies; a character that no n-gram knows is passed over. The model is fitted
on a sample of about ``SAMPLE_ROWS`` labelled rows and keeps every word seen twice there and
every n-gram, so it is as large as those rows ask for and doesn't grow with the corpus.
Tokens are held as sorted 64-bit hashes and their frequencies by language, only where they
occur. Scoring reads whole texts, in pieces of ``PIECE`` characters that end between words.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
labelled rows every text is ``und``; repeated rows score alike; an empty table gives an
empty result; ties between languages go to the first in alphabetical order; only
the id, text and (in training) lang columns are read, and other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, prefix_hash, span_hash, table, unused

SAMPLE_ROWS, LONGEST, PIECE = 20_000, 5, 1 << 19
_OUTSIDE = re.compile(r"[\W\d_]")


def held_out():
    """The split of the contract: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for what else may stand in a word, 0 for the rest."""
    chars = [chr(i) for i in range(0x110000)]
    return np.array([2 if c.isalpha() else c.isalnum() and not c.isdecimal() for c in chars], np.uint8)


def pieces(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of texts, lower-case texts or parts of them), about ``size`` characters at a time."""
    owners, held, room = [], [], size
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            end = len(t)
            if end - at > size:
                cut = _OUTSIDE.search(t, at + size)
                end = cut.end() if cut else end
            owners.append(i)
            held.append(t[at:end].lower())
            room -= end - at
            at = end
            if room <= 0:
                yield owners, held
                owners, held, room = [], [], size
    if held:
        yield owners, held


class Words:
    """The words of some texts: ``name`` and, by place, ``text``; each distinct one's place in ``first``."""

    def __init__(self, texts: list[str]):
        self.chars = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds()[self.chars]
        edge = np.diff(np.concatenate(([0], kind > 0, [0])).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        stops = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(stops, self.start, "right")
        self.letters = np.bincount(np.searchsorted(stops, np.flatnonzero(kind == 2), "right"), minlength=len(texts)) > 0
        self.prefix = prefix_hash(self.chars)
        self.name, self.first, self.which = np.unique(span_hash(self.prefix, self.start, self.end), return_index=True, return_inverse=True)

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place of a character in the distinct words given, and the number of its word among them."""
        start, size = self.start[self.first[words]], (self.end - self.start)[self.first[words]]
        owner = np.repeat(np.arange(len(words)), size)
        return np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size), owner

    def ends(self, words: np.ndarray) -> np.ndarray:
        return self.end[self.first[words]]


class Lookup:
    """Places of hashes in a sorted array, by a table of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, min(26, max(1, len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        found, top = np.full(len(hashes), -1, np.int64), (hashes >> self.shift).astype(np.int64)
        at, stop = self.begin[top], self.begin[top + 1]
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            same = self.keys[at[open_]] == hashes[open_]
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return found


class Model:
    """Log frequencies by language: of words (length 0), and of n-grams by length."""

    def __init__(self, langs: list[str], length: np.ndarray, name: np.ndarray, code: np.ndarray, count: np.ndarray):
        """A row for each length, token and language that occur together."""
        self.langs, self.keys, self.size = langs, {}, 0
        self.rows: list[list[np.ndarray]] = [[] for _ in langs]
        self.logs: list[list[np.ndarray]] = [[] for _ in langs]
        self.floors: list[tuple[int, np.ndarray]] = []
        for n in np.unique(length).tolist():
            own = length == n
            self.keys[n], row = np.unique(name[own], return_inverse=True)
            c, lang = count[own], code[own]
            floor = 0.5 / (np.bincount(lang, c, len(langs)) + 0.5 * len(self.keys[n]) + 1)
            for k in range(len(langs)):
                self.rows[k].append((row[lang == k] + self.size).astype(np.int32))
                self.logs[k].append(np.log(floor[k] * (1 + 2 * c[lang == k])).astype(np.float32))
            self.floors.append((len(self.keys[n]), np.log(floor)))
            self.size += len(self.keys[n])
        self.rows, self.logs = [np.concatenate(r) if r else r for r in self.rows], [np.concatenate(x) if x else x for x in self.logs]

    def opened(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with what is built once a task: lookup tables, and room for one language's scores."""

    def __init__(self, model: Model):
        self.model, self.table, self.base, at = model, {}, {}, 0
        for n, keys in model.keys.items():
            self.table[n], self.base[n] = Lookup(keys), at
            at += len(keys)
        self.room = np.zeros(model.size)

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(distinct word, token) for each part of each distinct word, in no fixed order."""
        none = np.zeros(0, np.int64)
        whole = self.table[0].find(words.name) if 0 in self.table else np.full(len(words.name), -1)
        known, new = np.flatnonzero(whole >= 0), np.flatnonzero(whole < 0)
        place, owner = words.grams(new)
        word, token = [known], [whole[known] + self.base.get(0, 0)]
        end = words.ends(new)
        found, step = np.full(len(place), -1, np.int64), np.ones(len(place), np.int64)
        open_ = np.arange(len(place))
        for n in range(LONGEST, 0, -1):
            if n in self.table:
                some = open_[place[open_] + n <= end[owner[open_]]]
                hit = self.table[n].find(span_hash(words.prefix, place[some], place[some] + n))
                some, hit = some[hit >= 0], hit[hit >= 0]
                found[some], step[some] = hit + self.base[n], n
                open_ = open_[found[open_] < 0]
        size = np.bincount(owner, minlength=len(new)) if len(new) else none
        at = np.cumsum(size) - size
        stop = at + size
        which = np.arange(len(new))
        while len(at):
            some = found[at] >= 0
            word.append(new[which[some]])
            token.append(found[at[some]])
            at = at + step[at]
            more = at < stop[which]
            at, which = at[more], which[more]
        return np.concatenate(word), np.concatenate(token)

    def score(self, texts: list[str | None], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers (-1: no letter) and the posterior of the best language."""
        langs = self.model.langs
        sums, letters = np.zeros((len(texts), len(langs))), np.zeros(len(texts), bool)
        for owners, held in pieces(texts, piece) if langs else ():
            words, owners = Words(held), np.array(owners)
            letters[owners[words.letters]] = True
            word, token = self.tokens(words)
            owner = owners[words.text]
            for k in range(len(langs)):
                at = 0
                for size, floor in self.model.floors:
                    self.room[at : at + size] = floor[k]
                    at += size
                self.room[self.model.rows[k]] = self.model.logs[k]
                each = np.bincount(word, self.room[token], len(words.name))
                sums[:, k] += np.bincount(owner, each[words.which], len(texts))
        if not langs:
            return np.full(len(texts), -1), np.zeros(len(texts))
        share = np.exp(sums - sums.max(axis=1, keepdims=True))
        return np.where(letters, share.argmax(axis=1), -1), np.where(letters, share.max(axis=1) / share.sum(axis=1), 0.0)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on (doc_id, text, lang); rows without a lang or text teach nothing."""
    sample = bounded_sample(labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang"), sample_rows, "doc_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                by.setdefault(lang.as_py(), []).append(text.as_py())
            for lang, own in by.items():
                for _, held in pieces(own, 8 * PIECE):
                    words = Words(held)
                    often = np.bincount(words.which, minlength=len(words.name))
                    place, owner = words.grams(np.arange(len(words.name)))
                    end = words.ends(np.arange(len(words.name)))[owner]
                    found = [(0, words.name, often)]
                    for n in range(1, LONGEST + 1):
                        some = place + n <= end
                        name, which = np.unique(span_hash(words.prefix, place[some], place[some] + n), return_inverse=True)
                        found.append((n, name, np.bincount(which, often[owner[some]], len(name)).astype(np.int64)))
                    for n, name, c in found:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(name), pa.string()), pa.array(np.full(len(name), n, np.int32)), pa.array(name.view(np.int64)), pa.array(c)], names=["lang", "n", "name", "c"])

    sums = sample.mapInArrow(counted, "lang string, n int, name long, c long").groupBy("lang", "n", "name").agg(F.sum("c").alias("c"))
    found = sums.filter((F.col("n") > 0) | (F.col("c") > 1)).toArrow()  # the tokens of sample_rows rows; a word seen once is left to its n-grams
    lang = found["lang"].combine_chunks().dictionary_encode()
    known = lang.dictionary.to_pylist()
    langs = sorted(known)
    code = np.array([langs.index(k) for k in known], np.int64)[lang.indices.to_numpy()] if known else np.zeros(0, np.int64)
    return Model(langs, found["n"].to_numpy(), found["name"].to_numpy().view(np.uint64), code, found["c"].to_numpy())


def _scored(docs: DataFrame, model: Model, schema: str, made):
    """A function of a text column: ``made(names of languages, numbers, scores)`` of its texts, batch by batch."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as SAMPLE_ROWS rows ask for

    @F.arrow_udf(schema)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = shared.value.opened()
        names = np.array([*scorer.model.langs, "und"])
        for batch in batches:
            done = [scorer.score(batch.slice(at, 500).to_pylist()) for at in range(0, len(batch), 500)] or [(np.zeros(0, int), np.zeros(0))]
            yield made(names, *(np.concatenate(x) for x in zip(*done)))

    return score


def identified(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of docs with lang_pred and score."""

    def made(names: np.ndarray, best: np.ndarray, score: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    by, cols = _scored(docs, model, "lang_pred string, score double", made), [c for c in docs.columns if c in keep]
    told = unused(docs, "_told")
    return docs.select(*cols, by(F.col(text)).alias(told)).select(*cols, f"{told}.lang_pred", f"{told}.score")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows that have no language: ``und``, or a score below ``least``.

    Only the texts go to Python, and only a verdict comes back.
    """
    by = _scored(docs, model, "boolean", lambda names, best, score: pa.array((best >= 0) & (score >= least)))
    return docs.filter(by(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identified(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
