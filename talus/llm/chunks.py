"""Documents packed into chunks, for operators whose tasks ask which hashes others have.

A chunk is one row with some megabytes of texts. It tells its distinct hashes as narrow
rows, which Spark deals out by hash; the hashes that different owners have come back to
the chunks as narrow rows again. Rows grow in proportion to the text, and a hash has at
most two rows a chunk however often it occurs there.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

NO_ID = (1 << 63) - 1  # a null id: larger than all others
_PLACES, _SEQ = 20, 22  # bits: documents of a chunk, chunks of a partition


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3 << 20) -> DataFrame:
    """(chunk, bytes, body), written to the shared folder. Null texts are empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            body = zstandard.compress(pickle.dumps((np.array(ids, np.int64), texts)), 5)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([part << _SEQ | seq], pa.int64()), "bytes": pa.array([held], pa.int64()), "body": pa.array([body], pa.binary())})

        for batch in batches:
            for one, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (t.as_py() or "").encode()
                if ids and (held + len(raw) > size or len(ids) >> _PLACES):
                    yield row()
                    seq, ids, texts, held = seq + 1, [], [], 0
                ids.append(NO_ID if one is None else one)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield row()

    return stored(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(pack, "chunk long, bytes long, body binary"))


def opened(body: bytes) -> tuple[np.ndarray, list[bytes]]:
    return pickle.loads(zstandard.decompress(body))


def place(chunk: int, doc: np.ndarray) -> np.ndarray:
    """A number of its own for each document of each chunk."""
    return np.int64(chunk << _PLACES) | doc.astype(np.int64)


def grouped_places(hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, mark, n): for each hash a row with its smallest mark and how often it occurs; a second one if another mark has it.

    Rows of a mark stand together, so that they compress.
    """
    if not len(hashes):
        return hashes, marks, np.zeros(0, np.int64)
    order = np.argsort(hashes)
    hashes, marks = hashes[order], marks[order]
    begin = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    low, high = np.minimum.reduceat(marks, begin), np.maximum.reduceat(marks, begin)
    n, more = np.diff(np.append(begin, len(hashes))), low != high
    out = np.concatenate((hashes[begin], hashes[begin][more])), np.concatenate((low, high[more])), np.concatenate((n, np.zeros(more.sum(), n.dtype)))
    order = np.argsort(out[1], kind="stable")
    return tuple(x[order] for x in out)


def shared(chunks: DataFrame, told, tasks: int) -> DataFrame:
    """(chunk, hash, n): each chunk's hashes that occur with different marks in all chunks, and how often they do.

    ``told(chunk, ids, texts)`` gives a chunk's hashes and marks. Hashes are cut to 48 bits
    on the way: two that become one are shared for nothing, which costs work and no result.
    A row carries its chunk and, up to a million, how often the chunk has the hash in one number.
    """
    most = (1 << _PLACES) - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes, marks = told(chunk, *opened(body.as_py()))
                h, mark, n = grouped_places((hashes >> np.uint64(16)).view(np.int64), marks)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(mark), pa.array(np.int64(chunk << _PLACES) | np.minimum(n, most))], names=["hash", "mark", "source"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        h, mark, source = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(3))
        del got
        order = np.argsort(h)
        h, mark, source = h[order], mark[order], source[order]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        several = np.minimum.reduceat(mark, begin) != np.maximum.reduceat(mark, begin)
        size, n = np.diff(np.append(begin, len(h))), source & most
        some = np.flatnonzero(np.repeat(several, size) & (n > 0))
        total = np.repeat(np.add.reduceat(n, begin), size)
        for at in range(0, len(some), 1 << 16):
            i = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(source[i] >> _PLACES), pa.array(h[i]), pa.array(total[i])], names=["chunk", "hash", "n"])

    asked = chunks.select("chunk", "body").mapInArrow(ask, "hash long, mark long, source long")
    return asked.repartition(tasks, "hash").mapInArrow(answer, "chunk long, hash long, n long")


def resumed(chunks: DataFrame, told: DataFrame, do, schema: str) -> DataFrame:
    """do(chunk, ids, texts, rows of told) for each chunk; told has a column chunk. Yields data frames."""

    def work(key: tuple, own: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        return do(int(own["chunk"].iloc[0]), *opened(own["body"].iloc[0]), heard)

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(work, schema)


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are in ``some``, which is sorted."""
    if not len(some):
        return np.zeros(values.shape, bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values
