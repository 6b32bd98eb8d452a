"""Hard negatives by rotated one-bit codes: deterministic intervals filter, integer scores decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import stored
from fairlead.llm.exacttopk import grid, usable

#: Rotations whose signs are a code, bits of a rotated anchor's components, anchors of a block, candidates of a chunk.
ROTATIONS, PLANES, BLOCK, CHUNK = 4, 7, 2048, 4096


@lru_cache(maxsize=2)
def rotations(width: int, seed: int = 11) -> np.ndarray:
    """Random rotations above one another, as one matrix with orthonormal columns."""
    draw = np.random.default_rng(seed)
    turned = [np.linalg.qr(draw.standard_normal((width, width)))[0] for _ in range(ROTATIONS)]
    return np.vstack(turned) / np.sqrt(ROTATIONS)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    whole = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    whole[:, : packed.shape[1]] = packed
    return whole.view("<u8")


def encoded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rows and ``(norm, alignment, residual)``.

    A code is the signs of the rotated row; turned back, it is a code vector. ``norm`` is that vector's length, ``alignment`` the part of the
    row along it and ``residual`` the length of the rest, which is at right angles to it.
    """
    turn = rotations(vectors.shape[1])
    signs = vectors @ turn.T >= 0
    back = np.where(signs, 1.0, -1.0) @ turn
    norm = np.linalg.norm(back, axis=1)
    alignment = (vectors * back).sum(axis=1) / np.maximum(norm, 1e-300)
    rest = vectors - back * (alignment / np.maximum(norm, 1e-300))[:, None]
    return _words(signs), np.stack([norm, alignment, np.linalg.norm(rest, axis=1)], axis=1)


class Anchor:
    """An anchor's rotated components in ``PLANES`` bits each, as planes of bits; what that rounds away is bounded."""

    def __init__(self, vector: np.ndarray):
        turned = rotations(len(vector)) @ vector
        self.low, high = turned.min(), turned.max()
        self.step = max((high - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - self.low) / self.step).astype(np.uint64)
        self.planes = _words(np.stack([(level >> np.uint64(k)) & np.uint64(1) for k in range(PLANES)]).astype(np.uint8))
        self.total, self.bits = float(level.sum()), len(turned)
        self.lost = np.abs(turned - (self.low + self.step * level)).sum()
        self.square = float(vector @ vector)

    def intervals(self, codes: np.ndarray, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between what values the inner product with each coded row lies, for certain.

        Popcounts give the anchor's product with the code vector but for ``lost``; along the code vector the row's part is known, and by
        Cauchy-Schwarz the rest is at most the residual times the anchor's part at right angles to the code vector.
        """
        held = np.zeros(len(codes))
        ones = np.zeros(len(codes))
        for w in range(codes.shape[1]):
            ones += np.bitwise_count(codes[:, w])
            for k, plane in enumerate(self.planes[:, w]):
                held += np.bitwise_count(codes[:, w] & plane) * float(1 << k)
        along = 2 * (self.low * ones + self.step * held) - (self.low * self.bits + self.step * self.total)
        norm, alignment, residual = np.maximum(facts[:, 0], 1e-300), facts[:, 1], facts[:, 2]
        along, lost = along / norm, self.lost / norm
        across = np.sqrt(np.maximum(0, self.square - np.maximum(0, np.abs(along) - lost) ** 2))
        middle, reach = alignment * along, np.abs(alignment) * lost + residual * across
        slack = 1e-9 * (np.abs(middle) + reach + 1)
        return middle - reach - slack, middle + reach + slack


def packed(vector: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them, behind a byte that says how many."""
    size = next((s for s in (2, 4) if not len(vector) or np.abs(vector).max() < 1 << (8 * s - 1)), 8)
    return bytes([size]) + vector.astype(f"<i{size}").tobytes()


def unpacked(data: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(data), width))
    for k, x in enumerate(data):
        own = np.frombuffer(x, dtype=f"<i{x[0]}", offset=1)
        out[k, : len(own)] = own
    return out


def _coded(rows: DataFrame, width: int) -> DataFrame:
    """``(vec_id, label, asks, vector, code, facts, slot)`` of ``rows(vec_id, label, asks, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [packed(np.array(x, dtype=np.float64)) for x in batch.column(3).to_pylist()]
            codes, facts = encoded(unpacked(data, width))
            columns = [*(batch.column(k) for k in range(3)), pa.array(data, pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array([x.tobytes() for x in facts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "asks", "vector", "code", "facts"])

    coded = rows.mapInArrow(run, "vec_id long, label long, asks boolean, vector binary, code binary, facts binary")
    return coded.withColumn("slot", F.xxhash64(F.monotonically_increasing_id()))


class Candidates:
    """A chunk of coded rows."""

    def __init__(self, table: pa.Table, width: int):
        self.ids, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        self.vectors = unpacked(table.column("vector").to_pylist(), width)
        self.codes, self.facts = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=kind).reshape(len(self.ids), -1) for c, kind in (("code", "<u8"), ("facts", "<f8")))

    def scores(self, at: np.ndarray, vector: np.ndarray) -> np.ndarray:
        return (self.vectors[at] @ vector).astype(np.int64)

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` of the candidates ``at`` by score down and id up, as places in ``at``."""
        return np.lexsort((self.ids[at], -scores))[:k]


def _least_of(lower: np.ndarray, sure: np.ndarray, k: int) -> float:
    """What the k-th greatest of the certain rows has at least."""
    own = lower[sure]
    return -np.inf if len(own) < k else np.partition(own, len(own) - k)[len(own) - k]


def _positives(anchors: pa.Table, rows: pa.Table, width: int, k: int) -> pa.Table:
    """The first k of a chunk that share each anchor's label."""
    out: list[tuple] = []
    if len(anchors) and len(rows):
        own = Candidates(rows, width)
        for vec_id, label, vector in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), unpacked(anchors.column("vector").to_pylist(), width)):
            at = np.flatnonzero((own.labels == label) & (own.ids != vec_id))
            low, high = Anchor(vector).intervals(own.codes[at], own.facts[at])
            at = at[high >= _least_of(low, np.ones(len(at), bool), k)]
            scores = own.scores(at, vector)
            for x in own.first(at, scores, k):
                out.append((vec_id, int(own.ids[at[x]]), int(scores[x])))
    return _table(out, ["anchor_id", "positive_id", "positive_score"])


def _negatives(anchors: pa.Table, rows: pa.Table, width: int, k: int, share: tuple[int, int]) -> pa.Table:
    """For each anchor and positive score, the first k of a chunk with other labels whose score lies between the shares of it."""
    out: list[tuple] = []
    if len(anchors) and len(rows):
        own = Candidates(rows, width)
        for vec_id, label, vector, wanted in zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), unpacked(anchors.column("vector").to_pylist(), width), anchors.column("wanted").to_pylist()):
            at = np.flatnonzero((own.labels != label) & (own.ids != vec_id))
            low, high = Anchor(vector).intervals(own.codes[at], own.facts[at])
            asked, known = [], {}
            for score in wanted:
                least, most = share[0] * score, share[1] * score
                near = (100 * high >= least) & (100 * low <= most)
                sure = (100 * low >= least) & (100 * high <= most)
                near &= high >= _least_of(low, sure, k)
                asked.append((score, least, most, np.flatnonzero(near)))
            every = np.unique(np.concatenate([x[3] for x in asked])) if asked else np.empty(0, int)
            exact = np.zeros(len(at), dtype=np.int64)
            exact[every] = own.scores(at[every], vector)
            for score, least, most, near in asked:
                fits = near[(100 * exact[near] >= least) & (100 * exact[near] <= most)]
                for x in own.first(at[fits], exact[fits], k):
                    known[score, int(own.ids[at[fits[x]]]), int(fits[x])] = int(exact[fits[x]])
            out += [(vec_id, score, neg, n) for (score, neg, _), n in known.items()]
    return _table(out, ["anchor_id", "positive_score", "negative_id", "negative_score"])


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names)


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95),
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: hard negatives of each row that ``anchors`` chooses.

    Scores are inner products of vectors on the grid ``floor(scale * x)``. An anchor's positives are its first rows of its label; a positive's negatives the
    first rows of other labels whose score is from ``share[0]`` to ``share[1]`` hundredths of its own. Higher scores come first, ties by id.

    Every row has a code: signs under random rotations, with what the row is along its code vector and across it. Blocks of anchors meet
    chunks of rows in a keyed shuffle, once for positives and once for negatives. There popcounts of code and anchor give an interval that
    holds the score for certain; rows whose interval can't reach the first few are left out, the others get their integer score. So the
    result is exact. The first of each chunk are merged. Only counts and one width reach the driver.

    Rows whose id, label or vector is null, or whose vector has a null or non-finite component, take no part; absent trailing components are zero.
    Rows of an anchor's own id are none of its positives or negatives; a repeated row stands as often as it comes, but as anchor once.
    Sums are exact below 2**53. ``label`` replaces the column of that name.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), anchors.alias("asks"), F.col(vector_col).alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("e")))
    width = rows.agg(F.max(F.size("e"))).first()[0] or 1
    width = max(1, width)
    rows, _ = stored(_coded(rows.select("vec_id", "label", F.coalesce("asks", F.lit(False)).alias("asks"), grid(F.col("e"), scale).alias("v")), width), "codes", passing=True)
    asked = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own")).select("vec_id", "own.label", "own.vector")
    n, asks = rows.agg(F.count("*"), F.approx_count_distinct(F.when(F.col("asks"), F.col("vec_id")))).first()
    blocks, chunks = max(1, -(-asks // block)), max(1, -(-n // chunk))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    right = rows.select("vec_id", "label", "vector", "code", "facts", F.pmod("slot", F.lit(chunks)).cast("int").alias("chunk")).withColumn("block", every(blocks))

    def met(left: DataFrame, found, schema: str) -> DataFrame:
        left = left.select(*[F.col(c).alias(c) for c in left.columns]).withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "chunk": every(chunks)})
        return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(found, schema)

    first = lambda keys, score, other: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other))
    pairs = met(asked, lambda a, c: _positives(a, c, width, positives), "anchor_id long, positive_id long, positive_score long")
    pairs = pairs.withColumn("place", first(["anchor_id"], "positive_score", "positive_id")).where(F.col("place") <= positives)
    pairs, _ = stored(pairs.select("anchor_id", "positive_id", "positive_score", "place"), "positives", passing=True)
    wanted = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("wanted"))
    near = met(asked.join(wanted, "vec_id"), lambda a, c: _negatives(a, c, width, negatives, share), "anchor_id long, positive_score long, negative_id long, negative_score long")
    near = near.withColumn("rank", first(["anchor_id", "positive_score"], "negative_score", "negative_id")).where(F.col("rank") <= negatives)
    return pairs.join(near, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
