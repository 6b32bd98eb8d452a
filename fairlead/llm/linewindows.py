"""Line deduplication by overlapping three-line windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import redealt

#: Bytes in front of a word's end that decide about a cut behind it.
CONTEXT = 16
#: A part of a line that is so many times the wrap without a place to cut repeats itself; it is cut at fixed distances.
LONGEST = 4
#: Odd factors that mix the two halves of a window's hash.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


@cache
def _spaces() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[32, 9, 10, 11, 12, 13]] = True
    return out


def _places(ends: np.ndarray, data: np.ndarray, line: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """Words (their numbers) behind which content cuts: the hash of the bytes in front of the word's end is less than that of
    ``reach`` words on either side, all in one line. Ties go to the first."""
    n = len(ends)
    if n <= 2 * reach:
        return np.empty(0, dtype=np.int64)
    padded = np.concatenate([np.full(CONTEXT, 10, dtype=np.uint8), data])
    near = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[ends]
    short = np.flatnonzero(ends - starts < CONTEXT)  # bytes of the line before don't count
    near[short] = np.where(np.arange(CONTEXT) < CONTEXT - (ends - starts)[short, None], np.uint8(10), near[short])
    near = near.view("<u8")
    mixed = near[:, 0] * np.uint64(0x9E3779B97F4A7C15) + (near[:, 1] ^ (near[:, 1] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    inner = mixed[reach : n - reach]
    fits = line[: n - 2 * reach] == line[2 * reach :]
    for k in range(1, reach + 1):
        fits &= (inner < mixed[reach - k : n - reach - k]) & (inner <= mixed[reach + k : n - reach + k])
    return np.flatnonzero(fits) + reach


def split_lines(text: str, wrap: int | None) -> list[str]:
    """The text cut after line ends, and with ``wrap`` long lines into pieces of at most so many words.

    Within a line, cuts fall first where the words around them say so, at least half a ``wrap`` from the next such place
    and from the line's ends: alike wherever a passage starts. What is longer between them is divided evenly; so
    pieces between two such places are the same in every line. Pieces without a word stay with the line before them
    (in front of the first line: with it). Joined, the pieces are the text.
    """
    return next(iter(split_all([text], wrap)))


def split_all(texts: list[str], wrap: int | None) -> Iterator[list[str]]:
    """``split_lines`` of each text."""
    for group in in_groups(texts, wrap):
        for i in range(len(group.raws)):
            yield [x.decode() for x in group.slices(i)]


def in_groups(texts: Iterable[str], wrap: int | None) -> Iterator[Pieces]:
    """Texts in their order, about a megabyte of them at once; there is always a group."""
    own, held = [], 0
    for text in texts:
        own.append(text)
        held += len(text)
        if held > 1 << 20:
            yield Pieces(own, wrap)
            own, held = [], 0
    yield Pieces(own, wrap)


def _breaks(firsts: np.ndarray, places: np.ndarray, n: int, wrap: int) -> np.ndarray:
    """Words that pieces begin with: at line starts, at the places that content gives, and evenly between them."""
    marks = np.union1d(firsts, places)
    lengths = np.diff(np.append(marks, n))
    parts = -(-lengths // wrap)
    k = np.repeat(np.arange(len(marks)), parts)
    i = np.arange(len(k)) - np.repeat(np.cumsum(parts) - parts, parts)
    return marks[k] + np.where(lengths[k] > LONGEST * wrap, i * wrap, lengths[k] * i // parts[k])


class Pieces:
    """Lines of several texts, or what long lines are cut into, as places in their joined bytes.

    Piece k begins at ``at[k]``; its words reach from ``first[k]`` to ``last[k]``; text i has the pieces from
    ``bounds[i]`` to ``bounds[i + 1]``, none if it has no word.
    """

    def __init__(self, texts: list[str], wrap: int | None):
        self.raws = [x.encode() for x in texts]
        self.joined = joined = b"\n".join(self.raws)
        data = np.frombuffer(joined, dtype=np.uint8)
        blank = np.append(_spaces()[data], True)
        turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            turns = np.insert(turns, 0, 0)
        begins, ends = turns[::2], turns[1::2]
        news = np.insert(np.flatnonzero(data == 10) + 1, 0, 0)
        line = np.searchsorted(news, begins, "right") - 1
        firsts = np.flatnonzero(np.insert(line[1:] != line[:-1], 0, True)) if len(line) else line
        breaks = firsts if wrap is None or not len(ends) else _breaks(firsts, _places(ends, data, line, news[line], max(1, wrap // 2)) + 1, len(ends), wrap)
        # A piece begins with its first word; the first of a line, with the line.
        self.at = np.where(np.isin(breaks, firsts), news[line[breaks]], begins[breaks])
        self.first, self.last = begins[breaks], ends[np.append(breaks[1:], len(ends)) - 1] if len(ends) else ends
        sizes = np.array([len(x) for x in self.raws], dtype=np.int64)
        self.opens = np.cumsum(sizes + 1) - sizes - 1
        self.bounds = np.searchsorted(self.at, np.append(self.opens, len(joined) + 1))

    def count(self, i: int) -> int:
        """Pieces of a text; one without a word is one, an empty one none."""
        return int(self.bounds[i + 1] - self.bounds[i]) or int(len(self.raws[i]) > 0)

    def slices(self, i: int) -> list[bytes]:
        raw = self.raws[i]
        cuts = [0, *(self.at[self.bounds[i] + 1 : self.bounds[i + 1]] - self.opens[i]).tolist(), len(raw)]
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every ``width`` pieces of a text in a row: 128 bits of their words as they stand (rows of two longs), text, number of the first."""
        digest, joined = xxhash.xxh3_128_digest, self.joined
        own = np.frombuffer(b"".join([digest(joined[x:y]) for x, y in zip(self.first.tolist(), self.last.tolist())]), dtype="<u8").reshape(-1, 2)
        text = np.repeat(np.arange(len(self.raws)), np.diff(self.bounds))
        n = max(0, len(own) - width + 1)
        whole = np.flatnonzero(text[:n] == text[width - 1 :])
        mixed = own[whole]
        for k in range(1, width):
            mixed = ((mixed ^ (mixed >> np.uint64(32))) * FACTORS + own[whole + k]) ^ (mixed[:, ::-1] >> np.uint64(29))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * FACTORS
        return (mixed ^ (mixed >> np.uint64(33))).view("<i8"), text[whole], whole - self.bounds[text[whole]]


def first_places(hashes: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window (as ``Pieces.windows`` gives them), where the same stands first in its text."""
    order = np.lexsort((at, hashes[:, 1], hashes[:, 0], text))
    if not len(order):
        return at
    h, t = hashes[order], text[order]
    new = np.insert((t[1:] != t[:-1]) | (h[1:] != h[:-1]).any(axis=1), 0, True)
    out = np.empty_like(at)
    out[order] = at[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def place_in_order(doc_id: Column, copy: Column) -> Column:
    """One number for the order by id (none: last), then by 62 bits of the text's hash: sums by hash take it, rows of both don't."""
    number = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(Decimal(1 << 63)))
    return (number * F.lit(Decimal(1 << 62))).cast("decimal(38,0)") + F.shiftrightunsigned(copy, 2).cast("decimal(19,0)")


def repeated_spans(docs: DataFrame, width: int, wrap: int | None, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, copy, spans array<struct<first, last>>)``: line ranges that an earlier occurrence already holds.

    ``copy`` is a hash of the text, so that rows are named by id and text. Windows are summed to their first
    document by (id, copy) in the map tasks before they shuffle; where a window stands first inside its own document
    its row says itself. Repeated windows alone are joined back, on a key under an expression, so that both sides
    shuffle for the join and a window that a third of the documents hold may be split.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            for group in in_groups([text.as_py() or "" for text in batch.column(1)], wrap):
                hashes, text, at = group.windows(width)
                row = pa.array(text + before)
                places = at << 32 | first_places(hashes, text, at)
                columns = [pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), batch.column(0).take(row), batch.column(2).take(row), pa.array(places)]
                before += len(group.raws)
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id", "copy", "places"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("copy"))
    found = read.mapInArrow(windows, "h1 long, h2 long, doc_id long, copy long, places long")
    order = place_in_order(F.col("doc_id"), F.col("copy"))
    firsts = found.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(redealt("h1").alias("k1"), F.col("h2").alias("k2"), "first")
    at, own = F.shiftright("places", 32).cast("int"), F.col("places").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    met = found.withColumn("k1", redealt("h1")).withColumn("k2", F.col("h2")).join(firsts, ["k1", "k2"])
    met = met.select("doc_id", "copy", at.alias("at"), own.alias("own"), (order == F.col("first")).alias("same"))
    later = met.where(~F.col("same") | (F.col("at") != F.col("own")))
    # A window that overlaps its own first occurrence leaves that one whole.
    begin = F.when(F.col("same"), F.greatest("at", F.col("own") + width)).otherwise(F.col("at"))
    spans = later.select("doc_id", "copy", begin.alias("first"), (F.col("at") + width).alias("last")).where(F.col("first") < F.col("last")).distinct()
    return spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def drop_repeated_lines(docs: DataFrame, width: int = 3, wrap: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated windows cut from the text, and ``n_lines``, ``n_removed`` (long; columns of these
    names are replaced).

    A window is ``width`` lines in a row; with ``wrap``, of the pieces of at most so many words that ``split_lines``
    cuts long lines into, so that a passage inside a line is found too. The first occurrence by (id, hash of the text, position) stays; the lines
    that later ones cover are merged and removed, also within one text. Rows equal in id and text are one document:
    each gets its result. Rows without an id come last in the order. Null texts stay null with no lines, a text may
    become empty, texts of fewer lines than ``width`` stay whole. No row is dropped.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    spans = repeated_spans(docs, width, wrap, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("hash"))
    joined = rows.join(spans, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("copy")), "left")

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(texts, spans):
        import pandas as pd

        out, rows = [], zip(texts, spans)
        for group in in_groups([x or "" for x in texts], wrap):
            for i, (text, found) in enumerate(islice(rows, len(group.raws))):
                n, gone = group.count(i), set()
                for s in found if found is not None else ():
                    gone.update(range(s["first"], s["last"]))
                out.append((b"".join([x for k, x in enumerate(group.slices(i)) if k not in gone]).decode() if gone else text, n, len(gone)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    done = joined.select("row", cut(F.col("row")[text_col], F.col("spans")).alias("cut"))
    return done.select(*[F.col("cut.text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names], "cut.n_lines", "cut.n_removed")
