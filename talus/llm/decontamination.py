"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``TILE`` words that a document shares with a benchmark item; they are
joined through a sorted array of the benchmark's seed hashes. Where the seeds could cover
enough of an item, the pair is tiled: running Karp-Rabin hashes find the longest match
among unmarked words, all matches of that length are marked one to one, and so on down to
``TILE`` words. The share of the item's words under tiles is compared with ``COVERAGE``,
so a passage whose parts were reordered counts as much as one in order.

The benchmark is sent to the tasks in blocks of at most ``BLOCK`` characters, which bounds
what one lookup holds; a larger benchmark takes more lookups of each document, and its
blocks stay broadcast until the result is computed. Seeds of an item can't be sampled, as
tiles of TILE words may be all that covers it, so documents aren't shuffled by seed, which
would send a row for each of their words.

Words are runs of letters and digits (all non-ASCII characters count as such), compared
in lower case. Defined results: null and empty texts match nothing; an item of fewer than
TILE words has no seed and matches nothing; repeated rows are judged one by one; empty
tables give an empty result; of equal long matches the first in the item, then the first
in the document, is marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_hash, sliced, span_hash, table

TILE, COVERAGE, BLOCK = 5, 0.8, 4_000_000
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts in turn, and the number of its text."""
    raw = [(t or "").lower().encode() for t in texts]
    stops = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.diff(np.concatenate(([True], _BREAK[buf], [True])).view(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return span_hash(prefix_hash(buf), first, last), np.searchsorted(stops, first, "right")


def seeds(names: np.ndarray, owner: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of ``tile`` words within one text starts, and its hash."""
    at = np.arange(max(0, len(names) - tile + 1))
    at = at[owner[at] == owner[at + tile - 1]] if len(at) else at
    return at, span_hash(prefix_hash(names), at, at + tile)


class Block:
    """Part of a benchmark, ready to be looked up."""

    def __init__(self, ids: list, texts: list[str | None], tile: int):
        self.ids, self.tile, self.kind = ids, tile, pa.array(ids).type
        self.names, owner = words(texts)
        self.first = np.searchsorted(owner, np.arange(len(ids) + 1))
        at, hashes = seeds(self.names, owner, tile)
        order = np.argsort(hashes, kind="stable")
        self.seed, start = np.unique(hashes[order], return_index=True)
        self.start = np.append(start, len(order))
        self.at, self.item = at[order], owner[at[order]]
        self.sieve = np.zeros(1 << 20, bool)  # most seeds of a document stop here
        self.sieve[self.seed & np.uint64(0xFFFFF)] = True

    def matches(self, texts: list[str | None], coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(text, item, share covered, tiles) for each pair at or above coverage."""
        names, owner = words(texts)
        at, hashes = seeds(names, owner, self.tile)
        some = self.sieve[hashes & np.uint64(0xFFFFF)]
        at, hashes = at[some], hashes[some]
        place = np.searchsorted(self.seed, hashes)
        hit = np.flatnonzero(place < len(self.seed))
        hit = hit[self.seed[place[hit]] == hashes[hit]]
        at, place = at[hit], place[hit]
        if not len(at):
            return
        # one row for each place of the seed in the benchmark
        count = self.start[place + 1] - self.start[place]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(self.start[place], count) + nth
        q = np.repeat(at, count)
        p, item, doc = self.at[entry], self.item[entry], owner[q]
        order = np.lexsort((p, item, doc))
        p, item, doc, q = p[order], item[order], doc[order], q[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
        begin = np.flatnonzero(new)
        gap = np.append(np.diff(p), self.tile)
        gap[np.append(begin[1:], len(p)) - 1] = self.tile
        covered = np.add.reduceat(np.minimum(gap, self.tile), begin)
        size = self.first[item[begin] + 1] - self.first[item[begin]]
        end = np.append(begin[1:], len(p))
        for k in np.flatnonzero(covered >= coverage * size - 1e-9).tolist():
            rows = slice(begin[k], end[k])
            i, d = int(item[begin[k]]), int(doc[begin[k]])
            near = np.unique(np.unique(q[rows])[:, None] + np.arange(self.tile))  # no other word can be in a tile
            tiles = tiled(self.names[self.first[i] : self.first[i + 1]], names[near], np.append(np.diff(near) == 1, False), self.tile)
            share = sum(t[2] for t in tiles) / int(size[k])
            if share >= coverage - 1e-9:
                base = int(np.searchsorted(owner, d))
                yield d, i, share, [(a, int(near[b]) - base, n) for a, b, n in tiles]


def tiled(item: np.ndarray, doc: np.ndarray, joined: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words). joined[i]: word i + 1 of doc follows word i in its text."""
    hashes = [prefix_hash(item), prefix_hash(doc)]
    breaks = np.concatenate(([0], np.cumsum(~joined[:-1]))) if len(doc) else np.zeros(0, int)
    used = [np.zeros(len(item), bool), np.zeros(len(doc), bool)]
    made: list[tuple[int, int, int]] = []

    def runs(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(0, len(used[side]) - n + 1))
        marks = np.concatenate(([0], np.cumsum(used[side])))
        at = at[marks[at + n] == marks[at]]
        if side:
            at = at[breaks[at + n - 1] == breaks[at]]
        return at, span_hash(hashes[side], at, at + n)

    most = min(len(item), len(doc))
    while most >= tile:
        low, high = tile - 1, most  # a match of n words holds one of n - 1
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if np.isin(runs(0, n)[1], runs(1, n)[1]).any() else (low, n - 1)
        if low < tile:
            break
        (a, ha), (b, hb) = runs(0, low), runs(1, low)
        places: dict[int, list[int]] = {}
        for y, h in zip(b.tolist(), hb.tolist()):
            places.setdefault(h, []).append(y)
        for x, h in zip(a.tolist(), ha.tolist()):
            if used[0][x : x + low].any():
                continue
            for y in places.get(h, ()):
                if not used[1][y : y + low].any():
                    used[0][x : x + low] = used[1][y : y + low] = True
                    made.append((x, y, low))
                    break
        most = low
    return made


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", tile: int = TILE, size: int = BLOCK) -> Iterator[Block]:
    """The benchmark as blocks of about ``size`` characters, one in memory at a time."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(item, text).filter(F.col(text).isNotNull()).orderBy(item, text).toLocalIterator():
        if ids and held + len(row[1]) > size:
            yield Block(ids, texts, tile)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
    if ids:
        yield Block(ids, texts, tile)


_TILES = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, tile: int = TILE, size: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, tiles): documents that hold an item, with the tiles as evidence."""
    rows = docs.select(F.col(key), F.col(text))
    kinds = f"`{key}` {dict(rows.dtypes)[key]}, item_id {dict(benchmark.dtypes)['item_id']}, coverage double, tiles array<struct<item_at int, doc_at int, words int>>"
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark, tile=tile, size=size):
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for s in sliced(texts):
                    found = list(shared.value.matches(texts[s], coverage))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([s.start + d for d, *_ in found], pa.int64())), pa.array([shared.value.ids[i] for _, i, *_ in found], shared.value.kind), pa.array([c for _, _, c, _ in found], pa.float64()), pa.array([[dict(zip(("item_at", "doc_at", "words"), t)) for t in ts] for *_, ts in found], _TILES)], names=[key, "item_id", "coverage", "tiles"])

        part = rows.mapInArrow(find, kinds)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kinds)


def cleaned(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, tile: int = TILE, size: int = BLOCK, text: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item; a filter inside the scan."""
    for block in blocks(benchmark, tile=tile, size=size):
        docs = docs.filter(_clean(docs.sparkSession.sparkContext.broadcast(block), coverage)(F.col(text)))
    return docs


def _clean(shared, coverage: float):
    """A function of a text column: true where no item of the block is held."""

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            good = np.ones(len(batch), bool)
            for at in range(0, len(batch), 500):
                texts = batch.slice(at, 500).to_pylist()
                for s in sliced(texts):
                    for d, *_ in shared.value.matches(texts[s], coverage):
                        good[at + s.start + d] = False
            yield pa.array(good)

    return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 4).alias("coverage"), F.size("tiles").alias("n_tiles"))
