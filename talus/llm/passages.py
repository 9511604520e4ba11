"""Substring dedup by MinHash banding of paragraphs, and of passages within long ones.

Units are, in words: each paragraph (a line) of ``SHINGLE`` to ``WORDS`` - 1 words; of longer
paragraphs the first and the last WORDS words; and passages of WORDS words that start at
anchors: in each stretch of WORDS + 1 possible starts of a text the one with the smallest
hash of its first two words. So a longer paragraph that repeats is covered from end to end,
and a passage that begins and ends anywhere is found as well: equal text has equal
anchors, so any 2 * WORDS words that repeat hold a unit that repeats exactly, and what is left
uncovered at either edge is less than WORDS + 1 words.

Each unit has ``BANDS`` keys of ``ROWS`` MinHash values over its five-word shingles: at
Jaccard similarity 0.8 a pair meets with probability 1 - (1 - 0.8 ** 2) ** 4 = 98 %, and
the many units that share anchors with a copy raise that for a document. Chunks learn which of
their keys other documents have; only units with such a key go on. Distinct units
with a common key are compared by exact Jaccard similarity of 32-bit shingle hashes, and the links' components are
the clusters. A cluster within one document isn't a repeat across documents and is left
out. The first unit of a cluster (smallest doc_id, then row, then position) is kept, the
others are removals.

Words are the runs between white space, A-Z in lower case. Defined results: a null or
empty text and paragraphs below SHINGLE words have no unit, unless a longer passage spans them;
a null id counts as larger than any other and is returned as null; rows are documents, so
repeated rows repeat each other's units, whatever their ids; an empty table gives an
empty result; a very long text is a chunk of its own; only id and text are read, and other
columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import NO_ID, among, chunked, place, resumed, shared
from .common import components, local_roots, mixed, prefix_hash, span_hash, stored, table, unite, word_spans
from .suffix import _window_min

WORDS, SHINGLE, BANDS, ROWS, SIMILARITY = 25, 5, 4, 2, 0.8
TASK_BYTES, KEY_ROWS, FEW = 12 << 20, 2000, 16
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


class Passages:
    """The units of some texts: owner, first word, size, name, shingle hashes and band keys."""

    def __init__(self, texts: list[bytes], words: int = WORDS):
        buf = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
        stops = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        first, last = word_spans(buf)
        names = span_hash(prefix_hash(buf), first, last)
        bound = np.searchsorted(first, np.concatenate(([0], stops)))
        prefix = prefix_hash(names)
        pair = span_hash(prefix, np.arange(max(0, len(names) - 1)), np.arange(1, len(names)) + 1) if len(names) > 1 else np.zeros(0, np.uint64)
        order = (pair >> np.uint64(32) << np.uint64(32)) | np.arange(len(pair), dtype=np.uint64)
        line = np.searchsorted(np.flatnonzero(buf == 10), first)
        begin = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(line)))
        short, long = (size >= SHINGLE) & (size < words), size >= words
        at, n = [begin[short], begin[long], (begin + size)[long] - words], [size[short], np.full(2 * long.sum(), words)]
        for i in np.flatnonzero(np.diff(bound) >= words).tolist():
            a, b = int(bound[i]), int(bound[i + 1]) - words + 1
            at.append(np.unique(_window_min(order[a:b], min(words + 1, b - a)) & np.uint64(0xFFFFFFFF)).astype(np.int64))
            n.append(np.full(len(at[-1]), words))
        spans = np.unique(np.stack((np.concatenate(at), np.concatenate(n)), axis=1).astype(np.int64), axis=0)
        at, self.size = spans[:, 0], spans[:, 1]
        self.owner = np.searchsorted(bound, at, "right") - 1
        self.start = at - bound[self.owner]
        self.name = span_hash(prefix, at, at + self.size)
        shingle = span_hash(prefix, np.arange(max(0, len(names) - SHINGLE + 1)), np.arange(max(0, len(names) - SHINGLE + 1)) + SHINGLE)
        # a short unit's last shingle is repeated, which changes no set
        nth = np.minimum(np.arange(words - SHINGLE + 1), self.size[:, None] - SHINGLE)
        self.shingles = shingle[at[:, None] + nth] if len(at) else np.zeros((0, words - SHINGLE + 1), np.uint64)
        low = np.stack([mixed(self.shingles ^ s).min(axis=1) for s in _SEEDS], axis=1) if len(at) else np.zeros((0, len(_SEEDS)), np.uint64)
        keys = [np.full(len(at), band, np.uint64) for band in range(BANDS)]
        for band in range(BANDS):
            for row in range(ROWS):
                keys[band] = mixed(keys[band] * np.uint64(0x9E3779B97F4A7C15) + low[:, band * ROWS + row])
        self.keys = np.stack(keys, axis=1)


def similar(sets: np.ndarray, sizes: np.ndarray, least: float, side: np.ndarray, block: int = 512):
    """Index pairs (a < b) of rows of shingles at or above ``least``, by products of incidence blocks."""
    flat = np.unique(sets, return_inverse=True)[1].reshape(sets.shape)
    for a in range(0, len(sets), block):
        for b in range(a, len(sets), block):
            named = np.unique(np.concatenate((flat[a : a + block], flat[b : b + block])))
            hit = []
            for start in (a, b):
                rows = np.searchsorted(named, flat[start : start + block])
                hit.append(np.zeros((len(rows), len(named)), np.float32))
                hit[-1][np.arange(len(rows))[:, None], rows] = 1
            common = hit[0] @ hit[1].T
            x, y = np.nonzero(common >= least * (sizes[a : a + block, None] + sizes[b : b + block] - common) - 1e-6)
            x, y = x + a, y + b
            good = (x < y) & (side[x] != side[y])
            yield x[good], y[good]


def all_pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b) with a < b < size[group]."""
    count = size * size
    group = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    a, b = nth // size[group], nth % size[group]
    return group[a < b], a[a < b], b[a < b]


def linked(distinct: DataFrame, similarity: float = SIMILARITY, key_rows: int = KEY_ROWS) -> DataFrame:
    """(u, v): edges that connect the distinct units (name, shingles, keys) which exact similarity links."""
    spread = distinct.select("name", F.explode("keys").alias("key"))
    several = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = several.select("key", F.ceil(F.col("n") / key_rows).cast("int").alias("parts"))
    spread = spread.join(stored(several), "key").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    # a key with more units is dealt out in parts, and every two parts meet in one bucket
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("name", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), F.when(F.col("part") != F.col("other"), F.col("part")).otherwise(-1).alias("side"))
    spread = spread.join(distinct.select("name", "shingles"), "name")

    def compare(batches):
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        frame = pd.concat(rows).sort_values("bucket", ignore_index=True)
        names, one, local = np.unique(frame["name"].to_numpy(), return_index=True, return_inverse=True)
        sets = np.frombuffer(b"".join(frame["shingles"].iloc[one]), np.uint32).reshape(len(names), -1).astype(np.uint64)
        sets.sort(axis=1)
        again = np.zeros(sets.shape, bool)
        again[:, 1:] = sets[:, 1:] == sets[:, :-1]
        sizes = (~again).sum(axis=1)
        sets[again] = np.flatnonzero(again.ravel()).astype(np.uint64) + np.uint64(1 << 32)  # equal to nothing else
        parent = local_roots(len(names))
        bucket, side = frame["bucket"].to_numpy(), frame["side"].to_numpy()
        side = np.where(side >= 0, side, -1 - np.arange(len(side)))  # all pairs of a whole bucket count
        begin = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
        size = np.diff(np.append(begin, len(bucket)))
        for at in range(0, len(begin), 2000):
            few = size[at : at + 2000] <= FEW
            group, a, b = all_pairs(size[at : at + 2000][few])
            a, b = begin[at : at + 2000][few][group] + a, begin[at : at + 2000][few][group] + b
            a, b = a[side[a] != side[b]], b[side[a] != side[b]]
            a, b = local[a], local[b]
            both = np.sort(np.concatenate((sets[a], sets[b]), axis=1), axis=1)
            common = (both[:, 1:] == both[:, :-1]).sum(axis=1)
            good = common >= similarity * (sizes[a] + sizes[b] - common) - 1e-9
            unite(parent, a[good], b[good])
        for k in np.flatnonzero(size > FEW).tolist():
            own = slice(begin[k], begin[k] + size[k])
            for x, y in similar(sets[local[own]], sizes[local[own]], similarity, side[own]):
                unite(parent, local[own][x], local[own][y])
        moved = np.flatnonzero(parent != np.arange(len(names)))
        yield pd.DataFrame({"u": names[moved], "v": names[parent[moved]]})

    return spread.repartition("bucket").mapInPandas(compare, "u long, v long")


def repeated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES, key_rows: int = KEY_ROWS) -> DataFrame:
    """(doc_id, start_word, n_words, cluster_doc, cluster_word, kept) of each unit that repeats."""
    chunks = chunked(docs, key, text)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0

    def told(chunk, ids, texts) -> tuple[np.ndarray, np.ndarray]:
        own = Passages(texts, words)
        return own.keys.ravel(), np.repeat(place(chunk, own.owner), BANDS)

    heard = stored(shared(chunks, told, max(1, -(-total // task_bytes))).select("chunk", "hash"))

    def candidates(chunk, ids, texts, rows) -> pd.DataFrame:
        own = Passages(texts, words)
        some = np.flatnonzero(among((own.keys >> np.uint64(16)).view(np.int64), np.sort(rows["hash"].to_numpy())).any(axis=1))
        _, first = np.unique(own.name[some], return_index=True)
        short = (own.shingles >> np.uint64(32)).astype(np.uint32)
        whole = np.zeros(len(some), bool)  # a unit is described once a chunk
        whole[first] = True
        return pd.DataFrame({
            "name": own.name[some].view(np.int64), "doc": ids[own.owner[some]], "row": place(chunk, own.owner[some]), "start": own.start[some], "size": own.size[some],
            "shingles": pd.Series([short[i].tobytes() if w else None for i, w in zip(some.tolist(), whole.tolist())], dtype=object),
            "keys": pd.Series([own.keys[i].view(np.int64).tolist() if w else None for i, w in zip(some.tolist(), whole.tolist())], dtype=object),
        })

    found = stored(resumed(chunks, heard, candidates, "name long, doc long, row long, start long, size long, shingles binary, keys array<long>"))
    distinct = stored(found.filter("shingles is not null").groupBy("name").agg(F.first("shingles").alias("shingles"), F.first("keys").alias("keys")))
    roots = components(linked(distinct, similarity, key_rows)).withColumnRenamed("node", "name")
    named = stored(found.select("name", "doc", "row", "start", "size").join(roots, "name", "left").select(F.coalesce("root", "name").alias("cluster"), "doc", "row", "start", "size"))
    clusters = named.groupBy("cluster").agg(F.min(F.struct("doc", "row", "start", "size")).alias("head"), F.min("row").alias("low"), F.max("row").alias("high")).filter("low <> high")
    # a stored table with a row a cluster, so that Spark can split a cluster's rows among tasks
    out = named.join(stored(clusters.select("cluster", "head")), "cluster")
    unless = lambda c: F.when(c != NO_ID, c)
    return out.select(
        unless(F.col("doc")).alias("doc_id"),
        F.col("start").alias("start_word"),
        F.col("size").alias("n_words"),
        unless(F.col("head.doc")).alias("cluster_doc"),
        F.col("head.start").alias("cluster_word"),
        (F.struct("doc", "row", "start", "size") == F.col("head")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
