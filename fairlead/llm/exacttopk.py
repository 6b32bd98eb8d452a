"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import stable

#: Queries of a block, candidates of a cell, candidates in one score array, and queries that a term is scattered to at once.
BLOCK, CELL, CHUNK, STRIP = 2048, 4096, 2048, 16


def grid(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    """Not null, and no component null, infinite or NaN."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each query by score down, id up."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    keep = place < k
    return q[keep], score[keep], ids[keep]


def _score(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of sparse query rows with all candidates, a term at a time into dense arrays.

    A term's postings are the candidates that hold it; their weights are scattered to the rows of all queries in a strip
    that hold the term at once. Rows are vectors of one length.
    """
    postings = []
    for t in range(queries.shape[1]):
        at = np.flatnonzero(candidates[:, t])
        # Most hold it: the whole column, zeros too, needs no list of places.
        common = 2 * len(at) > len(candidates)
        postings.append((None, np.ascontiguousarray(candidates[:, t])) if common else (at, candidates[at, t]))
    scores, room = np.zeros((len(queries), len(candidates))), np.empty(STRIP * len(candidates))
    for i in range(0, len(queries), STRIP):
        part, strip = queries[i : i + STRIP], scores[i : i + STRIP]
        for t, (at, held) in enumerate(postings):
            weights = part[:, t]
            rows = np.flatnonzero(weights)
            if not len(rows) or not len(held):
                continue
            if 2 * len(rows) > len(part):
                rows = np.arange(len(part))
            added = room[: len(rows) * len(held)].reshape(len(rows), len(held))
            np.multiply(weights[rows, None], held, out=added)
            if at is not None:
                strip[np.ix_(rows, at)] += added
            elif len(rows) == len(part):
                strip += added
            else:
                strip[rows] += added
    return scores


def _dense(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``width``."""
    ends = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width))
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one chunk for each query of one block."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    asks, vectors = (x.column("v").combine_chunks() for x in (queries, candidates))
    own, ids = (x.column("vec_id").to_numpy() for x in (queries, candidates))
    width = max([0, *(x.value_lengths().to_numpy(zero_copy_only=False).max() for x in (asks, vectors) if len(x))])
    q_rows = _dense(asks, width)
    best = (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))
    for i in range(0, len(ids), CHUNK if len(own) else 1 << 62):
        part = ids[i : i + CHUNK]
        scores = _score(q_rows, _dense(vectors.slice(i, CHUNK), width))
        order = np.argsort(part, kind="stable")
        low, high = (np.searchsorted(part, own, side, sorter=order) for side in ("left", "right"))
        for q in np.flatnonzero(high > low):
            scores[q, order[low[q] : high[q]]] = -np.inf
        if len(part) > k:
            least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
            q, c = np.nonzero((scores >= least) & (scores > -np.inf))
        else:
            q, c = np.nonzero(scores > -np.inf)
        found = _best(q, scores[q, c], part[c], k)
        best = _best(*(np.concatenate(x) for x in zip(best, found)), k)
    return pa.table([pa.array(own[best[0]]), pa.array(best[2]), pa.array(best[1].astype(np.int64))], schema=schema)


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK, chunk: int = CELL) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of each query row with every other row.

    ``queries`` says which rows are queries. Queries are dealt into blocks of about ``block`` rows and candidates into
    chunks of about ``chunk``; each pair of block and chunk meets in one group of a keyed shuffle, whose size these two
    numbers bound, and gives k rows a query, which are merged. No row reaches the driver, only two counts. Chunks go by
    row and not by id, so that an id of many rows is in many chunks.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; absent
    trailing components count as zero. Rows that share an id are never each other's neighbours; a repeated row is
    a candidate as often as it stands and one query. Ties go to the smaller id. Sums are exact below 2**53; components
    of 2**63 / scale or more stand for the largest long.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    rows = stable(rows.select("vec_id", grid(F.col("e"), scale).alias("v"), "asks"))
    asked = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    n, asks = rows.agg(F.count("*"), F.approx_count_distinct(F.when(F.col("asks"), F.col("vec_id")))).first()
    blocks, chunks = max(1, -(-asks // block)), max(1, -(-n // chunk))
    left = asked.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "chunk": _every(chunks)})
    right = rows.select("vec_id", "v", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"))
    right = right.withColumn("block", _every(blocks))
    grouped = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    merged = grouped.applyInArrow(lambda q, c: _cell(q, c, k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
