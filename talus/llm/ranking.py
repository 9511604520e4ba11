"""Ranked lexical search: items scored against every document by windowed bucket scoring.

Documents get internal numbers in the order of the scan, and a window is a fixed range of
them. The scan writes a row a window: the postings of the items' terms, term by term, as
places within the window with their counts, beside the documents' lengths. Scoring reads
the windows again: an item's postings are traversed inside one window at a time and added
into an array with a bucket for each of its documents, small enough for a core's cache; a
bitset tells which buckets were touched, and those that beat the least of an item's ten
best so far are harvested into its heap. Each task hands on ten documents an item.

A text is read once, and never shuffled; document frequencies and lengths are sums over
windows. The items' terms are broadcast in blocks of at most ``BLOCK`` characters of
items, a pass over the documents each.

Defined results: a null text, or one without terms, is no document of the counts; an item
without text or terms has no rows. Equal scores go by ascending doc_id (null last, then
in any order). Each row of either table counts on its own, repeated ones too, so a
repeated item returns its rows as often. Texts of any length are read whole. Empty tables
give an empty result. Other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

TOP, WINDOW, BLOCK = 10, 4096, 4 << 20
_WINDOW_POSTINGS = 2 << 20  # a window ends early with so many postings, which bounds its row

# Bytes that are in no term become spaces; of the others only A to Z are lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_WINDOWS = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, sizes binary, places binary, counts binary"
_KINDS = "<i8", "<i8", "<u4", "<u4", "<u2", "<u4"


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split(b" ") if text else []


def _counted(text: str, number: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms, and the known ones with their counts. Read in slices, cut between terms."""
    raw, n, known = text.encode().translate(_FOLD), 0, []
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= 1 << 22 else raw.find(b" ", at + (1 << 22))
        end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        n += len(words)
        known.append(np.array([i for i in map(number.get, words) if i is not None], np.int64))
        at = end
    found, counts = np.unique(np.concatenate(known), return_counts=True) if known else (np.zeros(0, np.int64),) * 2
    return n, found, counts


def windows(docs: DataFrame, number: dict[bytes, int], key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """A row a window of documents: ids and lengths, then postings sorted by term, then place."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, found, counts, held = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            place = np.repeat(np.arange(len(found)), [len(f) for f in found])
            term, count = np.concatenate(found), np.concatenate(counts)
            order = np.argsort(term, kind="stable")
            term, size = np.unique(term[order], return_counts=True)
            # ids: a flag for null, then the number
            numbers = np.array([[i is None, i or 0] for i in ids], np.int64)
            parts = [numbers, np.array(lengths, np.int64), term.astype("<u4"), size.astype("<u4"), place[order].astype("<u2"), count[order].astype("<u4")]
            return pa.RecordBatch.from_arrays(
                [pa.array([sum(n > 0 for n in lengths)]), pa.array([sum(lengths)]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                names=["n_docs", "n_terms", "ids", "lengths", "terms", "sizes", "places", "counts"],
            )

        for batch in batches:
            for one, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, which, times = _counted(t.as_py() or "", known.value)
                if not n:
                    continue
                if ids and (len(ids) >= window or held + len(which) > _WINDOW_POSTINGS):
                    yield row()
                    ids, lengths, found, counts, held = [], [], [], [], 0
                ids.append(one)
                lengths.append(n)
                found.append(which)
                counts.append(times)
                held += len(which)
        if ids:
            yield row()

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(built, _WINDOWS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _scored(index: DataFrame, items: list[tuple[int, dict[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's ``top`` best of each item."""
    sent = index.sparkSession.sparkContext.broadcast((items, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, w = sent.value
        heaps: list[list] = [[] for _ in wanted]
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                ids, lengths, term, size, place, count = (np.frombuffer(x.as_py(), kind).astype(np.int64) for x, kind in zip(row[2:], _KINDS))
                null, number = ids.reshape(-1, 2).T
                m = 25 + (75 * lengths * n_docs) // n_terms
                end = np.cumsum(size)
                gain = np.repeat(w[term], size) * ((1_000_000_000 * count) // (1000 * count + 8 * m[place]))
                at = {t: (b - s, b) for t, s, b in zip(term.tolist(), size.tolist(), end.tolist())}
                bucket, touched = np.zeros(len(lengths), np.int64), np.zeros(-(-len(lengths) // 8) * 8, bool)
                for heap, (_, need) in zip(heaps, wanted):
                    for t, times in need.items():
                        if t in at:
                            a, b = at[t]
                            bucket[place[a:b]] += times * gain[a:b]
                            touched[place[a:b]] = True
                    hit = np.flatnonzero(np.unpackbits(np.packbits(touched))[: len(lengths)])
                    if not len(hit):
                        continue
                    got = bucket[hit]
                    bucket[hit], touched[hit] = 0, False
                    least = heap[0][0] if len(heap) == top else 1  # equal scores may still win by their id
                    good = got >= least
                    hit, got = hit[good], got[good]
                    if len(hit) > top:  # only those that are among the window's own ten can be among all
                        best = np.lexsort((number[hit], null[hit], -got))[:top]
                        hit, got = hit[best], got[best]
                    for s, z, d in zip(got.tolist(), null[hit].tolist(), number[hit].tolist()):
                        (heapq.heappushpop if len(heap) == top else heapq.heappush)(heap, (s, -z, -d))
        rows = [(i, None if z else -d, s) for heap, (i, _) in zip(heaps, wanted) for s, z, d in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return index.mapInArrow(score, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_key, rank, doc_id, score): the ``top`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).filter("t is not null")
    size = asked.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks, parts, kind = max(1, -(-size // block)), [], dict(items.dtypes)[item_key]
    for n in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == n).collect() if size else []
        number: dict[bytes, int] = {}
        wanted = [(i, Counter(number.setdefault(x, len(number)) for x in terms(r.t) if x)) for i, r in enumerate(rows)]
        if not number:
            continue
        index = stored(windows(docs, number, key, text))
        n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        if not n_docs:
            continue
        weights = np.zeros(len(number), np.int64)
        for term, df in _frequencies(index, len(number)):
            weights[term] = weight(n_docs, df)
        found = _scored(index, [(i, dict(need)) for i, need in wanted], weights, n_docs, n_terms, top)
        names = spark.createDataFrame([(i, r.k) for i, r in enumerate(rows)], f"item long, k {kind}")
        parts.append(_best(found, top).join(F.broadcast(names), "item"))  # names: a block's items
    if not parts:
        return spark.createDataFrame([], f"`{item_key}` {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("k").alias(item_key), "rank", "doc_id", "score")


def _frequencies(index: DataFrame, n: int) -> list[tuple[int, int]]:
    """In how many documents each of the block's n terms is; a row a term and task is shuffled."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for term, size in zip(batch.column(0), batch.column(1)):
                total[np.frombuffer(term.as_py(), "<u4")] += np.frombuffer(size.as_py(), "<u4")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return [tuple(r) for r in index.select("terms", "sizes").mapInArrow(told, "term long, df long").groupBy("term").agg(F.sum("df")).collect()]


def _best(found: DataFrame, top: int) -> DataFrame:
    """The best of all tasks, in two steps: no task gets more than a part of what the tasks handed on for an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(32)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top).drop("part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH word AS MATERIALIZED (SELECT doc_id, unnest({_TERMS.format("text")}) AS t FROM documents),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM word GROUP BY doc_id, t),
length AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM length),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS t FROM benchmark) GROUP BY item_id, t),
weighed AS (SELECT item_id, t, times, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (t), total),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM weighed JOIN tf USING (t) JOIN length USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= {TOP}
"""
