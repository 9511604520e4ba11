"""Best-fit packing of token sequences by exact-complement hashing.

The plan is made on the histogram of piece lengths (at most ``capacity`` entries, however
many documents there are): combinations of two, three and four lengths that fill a
sequence exactly are looked up through single, pair and triple sums and used as often as
the counts allow; what is left is packed best fit, longest first. Pieces are then numbered
within their length and look their sequence and offset up in the plan.

Defined results: a null or empty text is one piece holding the end token; repeated rows
are packed one by one; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, stored, table

CAPACITY, END = 4096, 1
_ODD = re.compile("[\x1c-\x1f]").search  # white space to str.split(), but not to the pre-tokenizer
_LATIN = re.compile("[!-~\xa1-\xac\xae-\xff]+").fullmatch  # lower() is then all that normalising does


class _Words(dict):
    """ids of the pre-tokenizer's words, from the model alone."""

    def __init__(self, tokenize):
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
        rest = (b for b in range(256) if b not in plain)
        self.letters = ({b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}).__getitem__
        self.tokenize = tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(1 << 16)]

    def __missing__(self, word: str) -> bytes:
        got = self[word] = b"".join([self.packed[t.id] for t in self.tokenize(word if word.isascii() else "".join(map(self.letters, word.encode())))])
        return got


class _Parts(dict):
    """ids of the parts of texts between white space."""

    def __init__(self, tokenizer, pattern: str):
        import regex

        self.words, self.cut, self.normal = _Words(tokenizer.model.tokenize), regex.compile(pattern).findall, tokenizer.normalizer.normalize_str
        self.tokenizer = tokenizer

    def full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if _LATIN(part):
            low = part.lower()
            got = self.words[low] if low.isalpha() else b"".join([self.words[w] for w in self.cut(low)])
        elif part.isprintable():
            got = b"".join([self.words[w] for w in self.cut(self.normal(part))])
        else:
            got = self.full(part)
        self[part] = got
        return got


class CachedTokenizer:
    """ids of whole texts, put together from the ids of their parts between white space.

    The vocabulary's pre-tokenizer never joins what white space parts, so the ids are
    those of the whole text. A new printable part is cut by the pre-tokenizer's own pattern
    and its words go to the model alone, without the offsets that a full encoding
    tracks; any other part is encoded in full. Both caches are emptied at ``limit`` entries.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.limit, self.known = limit, _Parts(tokenizer, steps[0]["pattern"]["Regex"])

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        for text in texts:
            if text and _ODD(text):
                yield known.full(text)
                continue
            if len(known) > self.limit or len(known.words) > self.limit:
                known.clear()
                known.words.clear()
            yield b"".join(map(known.__getitem__, (text or "").split()))


_tokenizers: dict[str, CachedTokenizer] = {}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end token, cut only beyond capacity."""
    kind = dict(docs.select(key).dtypes)[key]
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = _tokenizers.get(vocabulary) or _tokenizers.setdefault(vocabulary, CachedTokenizer(vocabulary))
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tokenize(x.as_py() for x in batch.column(1))):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, times in each)]) that use up all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[int, list[tuple[int, int]]]] = []

    def use(*lengths: int) -> bool:
        need = Counter(lengths)
        n = min(int(left[k]) // m for k, m in need.items())
        if n:
            for k, m in need.items():
                left[k] -= n * m
            made.append((n, sorted(need.items(), reverse=True)))
        return n > 0

    def pairs(total: int, most: int) -> Iterator[tuple[int, int]]:
        """Pairs of lengths at hand with this sum, neither above most, the most even first."""
        low, high = max(1, total - most), total // 2
        if low <= high:
            both = (left[low : high + 1] > 0) & (left[total - high : total - low + 1][::-1] > 0)
            for b in (low + np.flatnonzero(both))[::-1].tolist():
                yield b, total - b

    use(capacity)
    for a in range(capacity - 1, (capacity - 1) // 2, -1):
        use(a, capacity - a)
    for a in range(capacity - 2, (capacity - 1) // 3, -1):
        while left[a] and any(use(a, *p) for p in pairs(capacity - a, a)):
            pass
    sums = np.zeros(capacity + 1, bool)  # sums of two lengths that may still be at hand
    there = left > 0
    for b in np.flatnonzero(there).tolist():
        sums[b:] |= there[: capacity + 1 - b]

    def triple(a: int) -> bool:
        gap = capacity - a
        first = np.arange(min(a, gap - 2), 0, -1)
        first = first[(left[first] > 0) & sums[gap - first]]
        for b in first.tolist():
            dead = True
            for p in pairs(gap - b, gap):
                dead = False
                if p[1] <= b and use(a, b, *p):
                    return True
            if dead:
                sums[gap - b] = False
        return False

    for a in range(capacity - 3, (capacity - 1) // 4, -1):
        while left[a] and triple(a):
            pass

    bins: dict[int, list[list]] = {}  # by room left: [how many, {length: times}]
    room = np.zeros(capacity + 1, np.int64)

    def put(n: int, space: int, held: dict[int, int]) -> None:
        if n:
            bins.setdefault(space, []).append([n, held])
            room[space] += 1

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fit = np.flatnonzero(room[length:])
            if not len(fit):
                each = min(capacity // length, n)
                put(n // each, capacity - each * length, {length: each})
                n -= n // each * each
                continue
            space = length + int(fit[0])
            have, held = bins[space].pop()
            room[space] -= 1
            each = min(space // length, n)
            filled = min(have, n // each)
            put(filled, space - each * length, held | {length: each})
            put(have - filled, space, held)
            n -= filled * each
    made += [(n, sorted(held.items(), reverse=True)) for rest in bins.values() for n, held in rest]
    return made


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length from 1 to capacity."""
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    rows, next_id, used = [], 0, Counter()
    for n, held in plan(counts, capacity):
        at = 0
        for length, times in held:
            rows.append((length, used[length], next_id, times, at))
            used[length] += n * times
            at += length * times
        next_id += n
    lookup = np.array(sorted(rows), np.int64).reshape(-1, 5)
    lookup = cut.sparkSession.sparkContext.broadcast(lookup)  # bounded by the number of lengths, not of documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = lookup.value
        keys = (spans[:, 0] << 48) + spans[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            found = spans[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - found[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found[:, 2] + nth // found[:, 3]), pa.array(found[:, 4] + nth % found[:, 3] * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = numbered(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "_rank", sum(counts.values()))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank")
    kinds = ", ".join(f"{c} {t}" for c, t in ranked.dtypes[:-1])
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return placed(stored(pieces(docs, vocabulary, capacity, key, text)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
