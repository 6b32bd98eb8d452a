"""Marginal document likelihood over all subword segmentations."""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import stable, words
from fairlead.llm.unigram import DoubleArrayTrie
from fairlead.llm.vocabulary import MARK, Vocabulary

#: Words whose figures are broadcast: the most frequent ones of at most 64 bytes; all others are joined.
HEAD_WORDS, HEAD_BYTES = 100_000, 64
#: Distinct words a counting task holds before it hands them on, and bytes of them.
MOST_COUNTED, MOST_COUNTED_BYTES = 300_000, 32 << 20
#: Steps of a histogram of word frequencies for each doubling; it has some 4,000 rows at most.
STEPS = 64
#: Words of up to this many bytes are scored side by side in arrays, SIDE_BY_SIDE of them at once.
ARRAY_BYTES, SIDE_BY_SIDE = 96, 4096
#: Mass of the existing scores against one corpus token each.
PRIOR_MASS = 1_000.0


@dataclass(frozen=True)
class LatticeModel:
    """Natural-log weights by piece and byte, and of the end of a text; all together sum to one."""

    pieces: dict[str, float]
    bytes: tuple[float, ...]
    end: float


def existing_weights(vocabulary: Vocabulary) -> LatticeModel:
    """The vocabulary's scores as probabilities (``Vocabulary.log_shares``)."""
    logs, n = vocabulary.log_shares().tolist(), len(vocabulary.pieces)
    return LatticeModel(dict(zip(vocabulary.pieces, logs[:n])), tuple(logs[n:-1]), logs[-1])


class Lattice:
    """Segmentations of single words; no piece crosses from one word to the next."""

    def __init__(self, model: LatticeModel):
        self.model = model
        self.steps: dict[str, float | None] = {}
        for p in model.pieces:
            for i in range(1, len(p)):
                self.steps.setdefault(p[:i], None)
        self.steps |= model.pieces

    def ways(self, text: str, i: int) -> Iterator[tuple[int, str | None, float]]:
        """``(end, piece or None for bytes, log weight)`` of what may start at ``i`` in the marked word."""
        steps, single = self.steps, False
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            weight = steps.get(piece, 0.0)
            if weight is None:
                continue
            if weight == 0.0:
                break
            single |= j == i + 1
            yield j, piece, weight
        if not single:
            yield i + 1, None, sum([self.model.bytes[b] for b in text[i].encode()])

    def forward(self, text: str) -> array:
        """Log of the summed weight of all segmentations up to each place; nothing else is held, however long the word."""
        reach = array("d", [float("-inf")]) * (len(text) + 1)
        reach[0] = 0.0
        for i in range(len(text)):
            here = reach[i]
            for j, _, weight in self.ways(text, i):
                reach[j] = _log_sum(reach[j], here + weight)
        return reach

    def log_probability(self, word: str) -> float:
        return self.forward(MARK + word)[-1]

    def expect(self, word: str, times: float, into_counts: dict) -> None:
        """Add the expected uses of each piece (and byte) in ``times`` occurrences of the word."""
        text = MARK + word
        reach = self.forward(text)
        n = len(text)
        rest = array("d", [float("-inf")]) * n + array("d", [0.0])  # log weight from each place to the end
        for i in range(n - 1, -1, -1):
            for j, piece, weight in self.ways(text, i):
                onward = weight + rest[j]
                rest[i] = _log_sum(rest[i], onward)
                share = times * math.exp(reach[i] + onward - reach[n])
                for key in (piece,) if piece is not None else text[i].encode():
                    into_counts[key] = into_counts.get(key, 0.0) + share


def _log_sum(a: float, b: float) -> float:
    """log(exp a + exp b)."""
    if a < b:
        a, b = b, a
    return a if b == float("-inf") else a + math.log1p(math.exp(b - a))


class TrieArrays:
    """The pieces' byte trie as arrays, built once and broadcast; values are positions in ``pieces``."""

    def __init__(self, pieces: list[str]):
        trie = DoubleArrayTrie([(p.encode(), i) for i, p in enumerate(pieces)])
        self.pieces = pieces
        self.base, self.check = np.array(trie.base, dtype=np.int64), np.array(trie.check, dtype=np.int64)


class BatchLattice:
    """``Lattice`` for many words at once: the same sums, a start place at a time over an array of words."""

    def __init__(self, model: LatticeModel, trie: TrieArrays):
        self.single, self.trie = Lattice(model), trie
        self.weights = np.array([model.pieces[p] for p in trie.pieces])
        self.byte_weights = np.array(model.bytes)

    def _arrays(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(t) for t in texts])
        wide = int(n.max()) + 4
        return np.frombuffer(b"".join([t.ljust(wide, b"\0") for t in texts]), dtype=np.uint8).reshape(len(texts), wide), n

    def _forward(self, bytes_: np.ndarray, n: np.ndarray, keep: list | None) -> np.ndarray:
        base, check, weights = self.trie.base, self.trie.check, self.weights
        reach = np.full(bytes_.shape, -np.inf)
        reach[:, 0] = 0.0
        for i in range(int(n.max())):
            rows = np.flatnonzero((n > i) & ((bytes_[:, i] & 0xC0) != 0x80))
            if not len(rows):
                continue
            lead = bytes_[rows, i]
            width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(bytes_), dtype=bool)
            alive, node, j, wide = rows, np.zeros(len(rows), dtype=np.int64), i, width
            while len(alive) and j < bytes_.shape[1]:
                to = base[node] + bytes_[alive, j] + 1
                ok = check[to] == node
                alive, node, wide = alive[ok], to[ok], wide[ok]
                j += 1
                end = base[node]
                value = base[end]
                hit = (check[end] == node) & (value < 0)
                if hit.any():
                    at, piece = alive[hit], -value[hit] - 1
                    w = weights[piece]
                    single[at[wide[hit] == j - i]] = True
                    reach[at, j] = np.logaddexp(reach[at, j], reach[at, i] + w)
                    if keep is not None:
                        keep.append((at, i, j, piece, w))
            bare = ~single[rows]
            for k in np.unique(width[bare]).tolist():
                at = rows[bare & (width == k)]
                w = self.byte_weights[bytes_[at, i : i + k]].sum(axis=1)
                reach[at, i + k] = np.logaddexp(reach[at, i + k], reach[at, i] + w)
                if keep is not None:
                    keep.append((at, i, i + k, None, w))
        return reach

    def _groups(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        order = np.argsort([len(t) for t in texts], kind="stable")
        for i in range(0, len(order), SIDE_BY_SIDE):
            yield order[i : i + SIDE_BY_SIDE]

    def log_probabilities(self, found: list[str]) -> np.ndarray:
        texts = [(MARK + w).encode() for w in found]
        out = np.empty(len(texts))
        short = [i for i, t in enumerate(texts) if len(t) <= ARRAY_BYTES]
        for i in {*range(len(texts))} - {*short} if len(short) < len(texts) else ():
            out[i] = self.single.log_probability(found[i])
        for group in self._groups([texts[i] for i in short]):
            own = [short[g] for g in group]
            bytes_, n = self._arrays([texts[i] for i in own])
            out[own] = self._forward(bytes_, n, None)[np.arange(len(own)), n]
        return out

    def expect(self, found: list[str], times: np.ndarray, pieces: np.ndarray, bytes_sum: np.ndarray) -> None:
        """Add the expected uses of pieces and bytes in ``times`` occurrences of each word."""
        texts = [(MARK + w).encode() for w in found]
        short = [i for i, t in enumerate(texts) if len(t) <= ARRAY_BYTES]
        if len(short) < len(texts):
            place = {p: i for i, p in enumerate(self.trie.pieces)}
            for i in {*range(len(texts))} - {*short}:
                more: dict = {}
                self.single.expect(found[i], float(times[i]), more)
                for k, m in more.items():
                    if isinstance(k, str):
                        pieces[place[k]] += m
                    else:
                        bytes_sum[k] += m
        for group in self._groups([texts[i] for i in short]):
            own = [short[g] for g in group]
            bytes_, n = self._arrays([texts[i] for i in own])
            edges: list = []
            reach = self._forward(bytes_, n, edges)
            rest = np.full(bytes_.shape, -np.inf)
            rest[np.arange(len(own)), n] = 0.0
            whole, often = reach[np.arange(len(own)), n], times[own]
            for at, i, j, piece, w in reversed(edges):  # starts from the last to the first
                onward = w + rest[at, j]
                rest[at, i] = np.logaddexp(rest[at, i], onward)
                share = often[at] * np.exp(reach[at, i] + onward - whole[at])
                if piece is not None:
                    pieces += np.bincount(piece, weights=share, minlength=len(pieces)) if len(piece) > 500 else 0
                    if len(piece) <= 500:
                        np.add.at(pieces, piece, share)
                else:
                    for k in range(i, j):
                        np.add.at(bytes_sum, bytes_[at, k], share)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n_train, n_all)`` over all rows of ``docs(text, learns)``; tasks sum before they shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()
        read = 0

        def done() -> pa.RecordBatch:
            keys = list(train.keys() | rest.keys())
            learnt, others = (np.fromiter(map(x.get, keys, repeat(0)), np.int64, len(keys)) for x in (train, rest))
            out = [pa.array(keys, pa.binary()).cast(pa.string()), pa.array(learnt), pa.array(learnt + others)]
            train.clear(), rest.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "n_train", "n_all"])

        for batch in batches:
            for text, learns in zip(batch.column(0), batch.column(1).to_pylist()):
                own = words(text.as_py())
                (train if learns else rest).update(own)
                if max(map(len, own), default=0) > HEAD_BYTES:
                    read += sum([len(w) for w in own if len(w) > HEAD_BYTES])
                if len(train) + len(rest) > MOST_COUNTED or read > MOST_COUNTED_BYTES:
                    read = 0
                    yield done()
        yield done()

    return docs.mapInArrow(count, "word string, n_train long, n_all long").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def fit(counts: DataFrame, ends: int, vocabulary: Vocabulary, trie: TrieArrays, rounds: int = 3) -> LatticeModel:
    """Re-estimate the existing weights on ``(word, n_train)`` by expectation maximisation.

    Tasks sum the expected uses of pieces; at most one row a piece and byte reaches the driver. The existing
    scores decide which pieces there are, where the search starts, and stay in with PRIOR_MASS tokens: a piece that
    training uses m times has weight (m + PRIOR_MASS * share) / total, so for a corpus of many tokens its own counts say
    nearly all and the existing scores order only what training never uses. ``rounds=0`` scores by them alone.
    """
    prior = model = existing_weights(vocabulary)
    spark = counts.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((model, trie))

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            model, trie = shared.value
            lattice = BatchLattice(model, trie)
            pieces, bytes_sum = np.zeros(len(trie.pieces)), np.zeros(256)
            for batch in batches:
                if len(batch):
                    lattice.expect(batch["word"].tolist(), batch["n_train"].to_numpy(float), pieces, bytes_sum)
            at, bytes_at = np.flatnonzero(pieces), np.flatnonzero(bytes_sum)
            yield pd.DataFrame({"piece": [*(trie.pieces[i] for i in at), *(f"\n{b}" for b in bytes_at)], "mass": [*pieces[at], *bytes_sum[bytes_at]]})

        rows = counts.where("n_train > 0").select("word", "n_train").mapInPandas(expect, "piece string, mass double").groupBy("piece").agg(F.sum("mass").alias("mass")).collect()
        mass = {r["piece"]: r["mass"] for r in rows}
        total = math.fsum(mass.values()) + ends + PRIOR_MASS
        share = lambda m, old: math.log((m + PRIOR_MASS * math.exp(old)) / total)  # noqa: E731,B023
        model = LatticeModel({p: share(mass.get(p, 0.0), w) for p, w in prior.pieces.items()}, tuple(share(mass.get(f"\n{b}", 0.0), w) for b, w in enumerate(prior.bytes)), share(ends, prior.end))
    return model


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The most frequent words of ``table(word, n_all, ..)`` of up to HEAD_BYTES, at most ``most`` of them, whatever the number of partitions.

    The cut comes from a histogram of frequencies in steps of a 64th of a doubling; the step in which ``most`` are passed stays out.
    """
    short = table.where(F.octet_length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("n_all") * STEPS).cast("int"))
    held, cut = 0, None
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > most:
            break
        cut = r["step"]
    return short.where(F.col("step") >= cut if cut is not None else F.lit(False)).drop("step")


def learns(id_col: str) -> "F.Column":
    """Rows whose CRC-32 of the id as text leaves no remainder 1 by 5; rows without an id learn too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 1, F.lit(True))


def score_documents(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``base_score`` is the smoothed word model's log10 probability of the text's words and its end, ``score`` the
    lattice's: the product over words of the summed weight of all their segmentations, times the end's weight.
    Both learn from all rows that aren't held out. Figures of the ``head_words`` most frequent words are broadcast
    (a fixed bound); the rest is summed over a join with the word table, so no vocabulary is held in one place.
    Null and empty texts are one end. Repeated rows count and come back as often as they stand; with no training
    row, N and V are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learns(id_col).alias("learns"))
    counts = stable(word_counts(rows.select("text", "learns")))
    ends = rows.where("learns").count()
    n, v = counts.agg(F.sum("n_train"), F.count_if(F.col("n_train") > 0)).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    scale = n + 0.5 * (v + 1)
    trie = TrieArrays(list(vocabulary.pieces))
    model = fit(counts, ends, vocabulary, trie, rounds)
    shared = spark.sparkContext.broadcast((model, trie))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = BatchLattice(*shared.value)
        for batch in batches:
            logs = lattice.log_probabilities(batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], names=["word", "n_train", "n_all", "log_p"])

    table = stable(counts.mapInArrow(weigh, "word string, n_train long, n_all long, log_p double"))
    top = most_frequent(table, head_words).collect()
    # Places of the words, and their figures with a row of zeros behind for all others.
    places = {r["word"].encode(): i for i, r in enumerate(top)}
    figures = np.array([*((r["n_train"] > 0, math.log10((r["n_train"] + 0.5) / scale), r["log_p"]) for r in top), (0, 0, 0)], dtype=float)
    head = spark.sparkContext.broadcast((places, figures))
    end = np.array([ends > 0, math.log10((ends + 0.5) / scale), model.end / math.log(10)])
    names = ["n_tokens", "known", "base", "score", "rare", "times"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, figures = head.value
        for batch in batches:
            tokens, sums, rare, times = [], [], [], []
            for text in batch.column(1):
                own = words(text.as_py())
                at = np.fromiter(map(places.get, own, repeat(len(places))), np.int64, len(own))
                tokens.append(len(own) + 1)
                sums.append(figures[at].sum(axis=0) + end)
                others = Counter([own[i] for i in np.flatnonzero(at == len(places)).tolist()])
                rare.append(list(others))
                times.append(list(others.values()))
            known, base, score = np.array(sums).reshape(-1, 3).T
            columns = [pa.array(tokens, pa.int64()), pa.array(np.rint(known).astype(np.int64)), pa.array(base.copy()), pa.array(score.copy())]
            columns += [pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "learns", *names])

    summed = stable(rows.mapInArrow(total, "doc_id long, learns boolean, n_tokens long, known long, base double, score double, rare array<string>, times array<long>"))
    summed = summed.withColumn("row", F.monotonically_increasing_id())
    others = summed.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    per_row = others.join(table, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("n_train") + 0.5) / scale)).alias("more_base"),
        F.sum(F.col("times") * F.col("log_p")).alias("more_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return summed.join(per_row, "row", "left").select(
        "doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", plus("known", "more_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "more_base").cast("double").alias("base_score"), plus("score", "more_score").cast("double").alias("score"),
    )
