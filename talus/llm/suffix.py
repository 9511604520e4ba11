"""Exact removal of repeated 50-byte strings, by threshold-bounded interval expansion.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts in a document
with a smaller id. Every such string has a minimizer, the smallest hash of its
``GRAM``-byte parts, and equal strings have equal ones, so strings meet at their minimizer,
and neighbouring strings with one minimizer travel as one segment.

1. Chunks of documents tell their minimizers, each with the digest of a text that has it,
   and the texts' digests. What comes back is which minimizers different texts have, and
   the smallest id of each text.
2. Chunks send the segments of shared minimizers, each distinct one once, with the
   smallest id there. Where segments of a minimizer differ, its task builds the
   Burrows-Wheeler transform of them and extends intervals backwards, breadth first: level
   by level this fixes the borders between suffixes with common prefixes of 0, 1, 2 ...
   bytes. It stops at ``LENGTH``; suffixes with no border between them share a string.
   The answer is the smallest id at each string of a segment.
3. Chunks mark what is covered by strings with an answer smaller than their own id.

A minimizer with over ``FAMILY`` segments, as a common line with ever different text around
it has, would bring them all to one task: its strings travel alone, by their own hash. So
no task sees more than FAMILY different segments of a minimizer, and an equal one only
once a chunk. A document whose whole text equals one with a smaller id is removed whole
in step 1 and sends no segment. Texts are told apart by 128-bit digests, and minimizers
found in one text only by 64 bits of them: of 10^11 pairs of texts that alone share a
minimizer, one is overlooked with probability 10^-8.

Defined results: a null text is empty; texts below LENGTH bytes lose nothing, copies too; a
null id counts as larger than any other; rows with equal ids don't remove from each other;
an empty table gives an empty result; a very long text is a chunk of its own; only id and
text are read, and other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import NO_ID, among, chunked, opened, resumed, shared
from .common import prefix_hash, span_hash, stored, table

LENGTH, GRAM = 50, 24
TASK_BYTES, SHARED_BYTES = 6 << 20, 18 << 20  # of text, for each task that answers with ids, and with shared minimizers
FAMILY = 50_000
PORTION = 1 << 18  # bytes of segments whose suffixes are sorted at a time, small enough for the processor's cache


_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes (8 to 24), from the unaligned 8-byte words they begin, hold and end with."""
    words = np.ndarray(len(buf) - 7, "<u8", np.ascontiguousarray(buf), 0, (1,)).copy()
    n = len(buf) - gram + 1
    h = words[:n] * _FACTORS[0]
    h += words[(gram - 8) // 2 : (gram - 8) // 2 + n] * _FACTORS[1]
    h ^= h >> np.uint64(29)
    h += words[gram - 8 : gram - 8 + n] * _FACTORS[2]
    h *= _FACTORS[1]
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    return h


class Segments:
    """The runs of strings with one minimizer in the texts of a chunk."""

    BLOCK = 1 << 17  # strings at a time, so that arrays stay in the cache

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.stops = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.length = length
        strings = max(0, len(self.buf) - length + 1)
        across = (self.stops[:, None] - np.arange(1, length)).ravel()  # would end in the next text
        across = across[(across >= 0) & (across < strings)]
        whole = np.ones(strings, bool)
        whole[across] = False
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for at in range(0, strings, self.BLOCK):
            here = whole[at : at + self.BLOCK]
            hashes = _gram_hashes(self.buf[at : at + len(here) + length - 1], gram)
            order = hashes & np.uint64(0xFFFFFFFF00000000)
            order |= np.arange(len(order), dtype=np.uint64)
            place = _window_min(order, length - gram + 1).astype(np.uint32)
            turn = np.append(True, place[1:] != place[:-1])
            turn[1:] |= here[1:] != here[:-1]
            begin = np.flatnonzero(turn)
            end = np.append(begin[1:], len(here)) - 1
            begin, end = begin[here[begin]], end[here[begin]]
            found.append((begin + at, end + at, hashes[place[begin]]))
        self.first, self.last, self.minimizer = (np.concatenate(x) for x in zip(*found))  # last: where a run's last string starts
        self.doc = np.searchsorted(self.stops, self.first, "right")

    def keep(self, some: np.ndarray) -> None:
        self.first, self.last, self.doc, self.minimizer = self.first[some], self.last[some], self.doc[some], self.minimizer[some]

    def alone(self, some: np.ndarray) -> None:
        """Makes each string of the runs chosen a run of its own, with its own hash for a minimizer."""
        size = (self.last - self.first + 1)[some]
        at = np.repeat(self.first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        doc, name = np.repeat(self.doc[some], size), span_hash(prefix_hash(self.buf), at, at + self.length)
        self.keep(~some)
        self.first, self.last = np.concatenate((self.first, at)), np.concatenate((self.last, at))
        self.doc, self.minimizer = np.concatenate((self.doc, doc)), np.concatenate((self.minimizer, name))

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A run for each distinct segment, the number of each run's segment, the segments' smallest ids."""
        names = span_hash(prefix_hash(self.buf), self.first, self.last + self.length)
        _, one, which = np.unique(names, return_index=True, return_inverse=True)
        least = np.full(len(one), NO_ID, np.int64)
        np.minimum.at(least, which, ids[self.doc])
        return one, which, least

    def bytes_of(self, runs: np.ndarray) -> pa.Array:
        """The runs' segments, one after another."""
        size = self.last[runs] + self.length - self.first[runs]
        raw = self.buf[np.repeat(self.first[runs] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(raw)])


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from minima over powers of two."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def suffix_order(x: np.ndarray) -> np.ndarray:
    """Start of each suffix of x in order; x ends with its only 0 and has values below 512."""
    n, step = len(x), 6
    wide = np.concatenate((x, np.zeros(step, x.dtype))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << 9 | wide[i : i + n]
    rank = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key)
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        step *= 2


def same_prefix(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes of x in order, and the number of each one's set of equal ``length``-prefixes.

    border[i] becomes true when the common prefix of suffixes i - 1 and i is known to be
    below the current level. Intervals of suffixes that begin with one string are extended
    by each symbol before them: their images under the LF mapping fall into runs, one for
    each symbol. An image is followed further only if its right border is new.
    """
    order = suffix_order(x)
    n = len(x)
    before = x[order - 1]
    to = np.empty(n, np.int64)  # the LF mapping
    to[np.argsort(before.astype(np.uint16), kind="stable")] = np.arange(n)
    head = x[order]
    border = np.zeros(n + 1, bool)
    border[[0, n]] = True
    ranks, owner, spot = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for _ in range(length):
        image = to[ranks]
        if 20 * len(image) < n:
            by = np.argsort(image)
            image, owner = image[by], owner[by]
        else:  # in order without sorting
            spot[image] = owner + 1
            image = np.flatnonzero(spot)
            owner = spot[image] - 1
            spot[image] = 0
        new = np.append(True, (np.diff(image) != 1) | (np.diff(owner) != 0) | (np.diff(head[image]) != 0))
        begin = np.flatnonzero(new)
        right = image[np.append(begin[1:], len(image)) - 1] + 1
        fresh = ~border[right]
        border[right[fresh]] = True
        number = np.cumsum(new) - 1
        live = fresh[number]
        ranks, owner = image[live], number[live]
        if not len(ranks):
            break
    return order, np.cumsum(border[:n]) - 1


def least_ids(segments: list[bytes], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct segment the smallest id of the segments that hold each of its strings."""
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = np.concatenate((np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 2, [0]))
    x[starts + sizes] = 1  # between segments
    order, group = same_prefix(x, length)
    owner = np.append(np.repeat(ids, sizes + 1), NO_ID)[order]
    least = np.minimum.reduceat(owner, np.flatnonzero(np.append(True, np.diff(group) != 0)))
    at = np.empty(len(x), np.int64)
    at[order] = least[group]
    return [at[s : s + n - length + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


def _digests(texts: list[bytes]) -> np.ndarray:
    """128 bits of each text, as two numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)


def _firsts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the texts, the place of each distinct text, and which of these each text is."""
    digests = _digests(texts)
    _, first, which = np.unique(digests, axis=0, return_index=True, return_inverse=True)
    return digests, first, which.ravel()


def _answers(names: list[bytes], keys: np.ndarray, low: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id at each string of each distinct segment, one after another, and where each segment's begin."""
    width = np.array([len(n) - length + 1 for n in names], np.int64)
    value, start = np.repeat(low, width), np.cumsum(width) - width
    order = np.argsort(keys, kind="stable")
    family = np.concatenate(([0], np.cumsum(np.diff(keys[order]) != 0)))
    mixed = order[np.bincount(family)[family] > 1]
    for at in _portions([len(names[k]) for k in mixed.tolist()], keys[mixed].tolist(), PORTION):
        part = mixed[at]
        for k, found in zip(part.tolist(), least_ids([names[k] for k in part.tolist()], low[part], length)):
            value[start[k] : start[k] + len(found)] = found
    return value, start


def _expanded(length: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, kind, a, b): for each segment whose strings have smaller ids elsewhere the runs of equal ids, a: segment, from and to, b: id."""
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        every = pa.Table.from_batches(got).combine_chunks()
        coded = every["segment"].combine_chunks().dictionary_encode()
        own, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        key, ids, chunk, number = (every[c].to_numpy() for c in ("key", "id", "chunk", "number"))
        del got, every, coded
        low, keys = np.full(len(names), NO_ID, np.int64), np.zeros(len(names), np.int64)
        np.minimum.at(low, own, ids)
        keys[own] = key
        value, start = _answers(names, keys, low, length)
        width = np.diff(np.append(start, len(value)))
        for at in range(0, len(own), 1 << 14):
            mine = own[at : at + (1 << 14)]
            size = width[mine]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            seen, row = value[np.repeat(start[mine], size) + nth], np.repeat(np.arange(len(mine)), size)
            cut = np.flatnonzero((nth == 0) | np.append(True, seen[1:] != seen[:-1]))
            to = nth[np.append(cut[1:], len(nth)) - 1] + 1
            new = seen[cut] != ids[at : at + (1 << 14)][row[cut]]
            cut, to = cut[new], to[new]
            i = at + row[cut]
            a = number[i].astype(np.int64) << 16 | nth[cut] << 8 | to
            yield pa.RecordBatch.from_arrays([pa.array(chunk[i]), pa.array(np.full(len(i), 2, np.int32)), pa.array(a), pa.array(seen[cut])], names=["chunk", "kind", "a", "b"])

    return answer


def _portions(sizes: list[int], family: list[int], limit: int):
    """Slices of about ``limit`` bytes that keep a minimizer's segments together."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held + n > limit and i > start and family[i] != family[i - 1]:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


_TOLD = "chunk long, kind int, a long, b long"


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES, family: int = FAMILY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans): kept bytes, and the removed spans as (start, end)."""
    if not (8 <= gram <= 24 and gram <= length <= 100):
        raise ValueError("gram is 8 to 24 bytes, and length at least that and at most 100, as places in a segment are sent as bytes")
    chunks = chunked(docs, key, text)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, -(-total // task_bytes))

    def told(chunk, ids, texts) -> tuple[np.ndarray, np.ndarray]:
        digests, first, _ = _firsts(texts)
        runs = Segments([texts[i] for i in first.tolist()], length, gram)
        return runs.minimizer, digests[first, 0][runs.doc]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, texts = opened(body.as_py())
                digests, first, which = _firsts(texts)
                least = np.full(len(first), NO_ID, np.int64)
                np.minimum.at(least, which, ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), chunk)), pa.array(first.astype(np.int64)), pa.array(least), *(pa.array(np.ascontiguousarray(digests[first, i])) for i in (0, 1))], names=["chunk", "first", "id", "d0", "d1"])

    minimizers = shared(chunks, told, max(1, -(-total // SHARED_BYTES))).select("chunk", F.lit(0).alias("kind"), F.col("hash").alias("a"), F.col("n").alias("b"))
    texts = chunks.select("chunk", "body").mapInArrow(named, "chunk long, first long, id long, d0 long, d1 long")
    # a text has a row a chunk; its group needs one number
    texts = texts.select("chunk", F.lit(1).alias("kind"), F.col("first").alias("a"), F.min("id").over(Window.partitionBy("d0", "d1")).alias("b"))
    heard = stored(minimizers.unionByName(texts))

    def sent(ids, texts, rows: pd.DataFrame) -> tuple[Segments, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs of shared minimizers in texts that are nobody's copy; the same in both later steps."""
        kind, a, b = (rows[c].to_numpy() for c in ("kind", "a", "b"))
        _, first, which = _firsts(texts)
        least = np.zeros(len(texts), np.int64)
        least[a[kind == 1]] = b[kind == 1]
        copy = least[first][which] < ids
        runs = Segments(texts, length, gram)
        order = np.argsort(a[kind == 0])
        names, often = a[kind == 0][order], b[kind == 0][order]
        short = (runs.minimizer >> np.uint64(16)).view(np.int64)
        runs.keep(among(short, names) & ~copy[runs.doc])
        hot = among((runs.minimizer >> np.uint64(16)).view(np.int64), names[often > family])
        if hot.any():
            runs.alone(hot)
        return (runs, copy, *runs.distinct(ids))

    def send(chunk, ids, texts, rows) -> pd.DataFrame:
        runs, _, one, _, least = sent(ids, texts, rows)
        return pd.DataFrame({"key": runs.minimizer[one].view(np.int64), "segment": pd.Series(runs.bytes_of(one).to_pylist(), dtype=object), "id": least, "chunk": np.full(len(one), chunk), "number": np.arange(len(one), dtype=np.int64)})

    segments = resumed(chunks, heard, send, "key long, segment binary, id long, chunk long, number long")
    answers = stored(segments.repartition(tasks, "key").mapInArrow(_expanded(length), _TOLD))

    def mark(chunk, ids, texts, rows) -> pd.DataFrame:
        runs, copy, one, which, least = sent(ids, texts, rows)
        size = runs.last - runs.first + 1
        width = size[one]
        start = np.cumsum(width) - width
        value = np.repeat(least, width)  # of each string of each distinct segment
        rows = rows[rows["kind"] == 2]
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        span = (a & 255) - (a >> 8 & 255)
        value[np.repeat(start[a >> 16] + (a >> 8 & 255) - (np.cumsum(span) - span), span) + np.arange(span.sum())] = np.repeat(b, span)
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = np.repeat(np.arange(len(size)), size)
        gone = runs.first[own] + nth
        gone = gone[value[start[which[own]] + nth] < ids[runs.doc[own]]]
        edge = np.zeros(len(runs.buf) + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + length, -1)
        removed = np.cumsum(edge[:-1]) > 0
        out, at = [], 0
        for i, t in enumerate(texts):
            off = removed[at : at + len(t)]
            if copy[i] and len(t) >= length:
                off = np.ones(len(t), bool)
            turn = np.flatnonzero(np.diff(np.concatenate(([False], off, [False])).view(np.int8)))
            kept = np.frombuffer(t, np.uint8)[~off].tobytes()
            out.append((None if ids[i] == NO_ID else int(ids[i]), len(t), int(off.sum()), len(turn) // 2, kept, turn.reshape(-1, 2).tolist()))
            at += len(t)
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]).astype({"doc_id": "Int64"})

    return resumed(chunks, heard.unionByName(answers), mark, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), p AS (
  SELECT doc_id, n, b, substr(h, 512 * b + 1, {512 + 2 * LENGTH}) AS part FROM (SELECT *, unnest(range(0, (greatest(n - {LENGTH - 1}, 0) + 255) // 256)) AS b FROM d)
), w AS (
  SELECT doc_id, 256 * b + j AS i, md5_number(substr(part, 2 * j + 1, {2 * LENGTH})) AS g FROM (SELECT *, unnest(range(0, least(256, n - {LENGTH - 1} - 256 * b))) AS j FROM p)
), s AS (
  SELECT w.doc_id, i FROM w JOIN (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)) f ON f.g = w.g WHERE m < w.doc_id
), r AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, true) AS new FROM s
), q AS (
  SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT doc_id, i, sum(new::int) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k
), e AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM q
), k AS (
  SELECT e.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id
)
SELECT d.doc_id, n AS n_bytes, cast(coalesce(gone, 0) AS bigint) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
