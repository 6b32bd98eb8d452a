"""Removal of byte strings that occur twice, by distributed prefix doubling over places that content chooses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import redealt, remove, stored

#: Bytes that a place is chosen by, and window starts that are looked at together.
GRAM, CHUNK = 8, 1 << 20
#: Blocks that the strings of one place are dealt into; a shape holds a level of four bits for each, and then the place's own.
BLOCKS, NEVER = 4, 15


def window_of(length: int) -> int:
    """Window starts among which one place is chosen: so many that a string of ``length`` bytes holds two places at least."""
    if length < 3 * BLOCKS + GRAM:
        raise ValueError(f"strings have {3 * BLOCKS + GRAM} bytes at least")
    return (length - GRAM + 2) // 3 // BLOCKS * BLOCKS


def places(raw: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(at, since)``: the places of a text, and of each the first window that chooses it.

    A window of so many starts chooses the one whose eight bytes have the least mixed value, the first of equals. So what
    a string chooses depends on nothing outside it.
    """
    data, windows = np.frombuffer(raw, dtype=np.uint8), len(raw) - window - GRAM + 2
    at, since = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for c in range(0, windows, CHUNK):
        part = data[c : min(c + CHUNK, windows) + window + GRAM - 2]
        mixed = np.ndarray(len(part) - GRAM + 1, "<u8", part, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        least = mixed & np.uint64(0xFFFFFFFF00000000) | np.arange(len(mixed), dtype=np.uint64)
        wide = 1
        while wide < window:
            step = min(wide, window - wide)
            least, wide = np.minimum(least[:-step], least[step:]), wide + step
        chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turns = np.insert(np.flatnonzero(chosen[1:] != chosen[:-1]) + 1, 0, 0)
        at.append(chosen[turns] + c)
        since.append(turns + c)
    at, since = np.concatenate(at), np.concatenate(since)
    new = np.diff(at, prepend=-1) != 0
    return at[new], since[new]


def _shapes(at: np.ndarray, since: np.ndarray, size: np.ndarray, length: int, window: int) -> np.ndarray:
    """Of each place, the level that each of its blocks needs (``NEVER``: it holds no string) and, above them, that of the place itself.

    A string's first place lies d bytes behind its start, and block b holds those of d from b * width on. All phrases that
    end ``length - window - GRAM + 1 - d`` bytes behind the place lie inside the string; the level is the power of two below their number.
    Texts stand behind one another, ``length`` bytes apart; ``size`` says where each place's text ends. The last place of a text has no phrase.
    """
    wide = window // BLOCKS
    far, order = at - since, np.arange(len(at))
    near = at - np.minimum(np.append(since[1:], 0) - 1, size - length)
    shape = np.zeros(len(at), dtype=np.int64)
    for b in range(BLOCKS):
        reach = length - window - GRAM + 1 - (b + 1) * wide + 1
        phrases = np.searchsorted(at, at + reach, "right") - 1 - order
        level = np.log2(np.maximum(phrases, 1)).astype(np.int64)
        held = (near <= far) & (near < (b + 1) * wide) & (far >= b * wide)
        shape |= np.where(held, level, NEVER) << 4 * b
        if not b:
            shape |= level << 4 * BLOCKS
    return shape


def _phrases(docs: DataFrame, length: int, window: int) -> DataFrame:
    """``(rank, loc, i, at, shape)``: each phrase, from one place of a text ``docs(loc, text)`` to the end of the next one's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ats, sinces, bases, sizes, ranks, base = [], [], [], [], [], 0
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes()
                at, since = places(raw, window)
                ends = at.tolist()
                ranks += [digest(raw[x : y + GRAM]) for x, y in zip(ends, ends[1:])]
                ats.append(at + base)
                sinces.append(since + base)
                bases.append(base)
                sizes.append(len(raw))
                base += len(raw) + length
            if not ats:
                continue
            n = np.array([len(x) for x in ats])
            at, since, text = np.concatenate(ats), np.concatenate(sinces), np.repeat(np.arange(len(n)), n)
            first = np.array(bases)[text]
            kept = np.flatnonzero(np.append(text[1:] == text[:-1], False))
            shape = _shapes(at, since, first + np.array(sizes)[text], length, window)[kept]
            number = np.arange(len(at)) - (np.cumsum(n) - n)[text]
            columns = [pa.array(np.array(ranks, dtype=np.uint64).view(np.int64)), batch.column(0).take(pa.array(text[kept])), *(pa.array(x.astype(np.int32)) for x in (number[kept], (at - first)[kept], shape))]
            yield pa.RecordBatch.from_arrays(columns, names=["rank", "loc", "i", "at", "shape"])

    return docs.where(F.octet_length("text") >= length).mapInArrow(run, "rank long, loc long, i int, at int, shape int")


def _place(number: str) -> F.Column:
    return F.xxhash64("loc", number)


def _reranked(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Rows whose ``keys`` stand at two places (text and ``number``) or more, with ``rank``: the least place of their class.

    Classes are summed in the map tasks first and joined back on a key under an expression, so that a hot one may be
    split. Copies of a text are one place.
    """
    least, most = F.min(_place(number)).alias("leader"), F.max(_place(number)).alias("other")
    classes = rows.groupBy(*keys).agg(least, most).where("leader < other").drop("other")
    classes = classes.select(redealt(keys[0]).alias("_key"), *keys[1:], F.col("leader").alias("_rank"))
    return rows.withColumn("_key", redealt(keys[0])).join(classes, ["_key", *keys[1:]]).drop("_key", "rank").withColumnRenamed("_rank", "rank")


def _pairs(texts: DataFrame, offset: int) -> DataFrame:
    """``(loc, i, shape, x, y)``: ranks of phrase i and of the one ``offset`` further on, of ``texts(loc, own array<struct<i, shape, rank>>)``."""
    level = (2 * offset).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            text = np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy(zero_copy_only=False))
            i, shape, rank = (own.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            key = text << 32 | i.astype(np.int64)
            order = np.argsort(key)
            found = np.searchsorted(key, key + offset, sorter=order)
            partner = order[np.minimum(found, max(0, len(order) - 1))] if len(order) else order
            kept = np.flatnonzero((key[partner] == key + offset) & (shape >> 4 * BLOCKS >= level))
            loc = batch.column(0).take(pa.array(text[kept]))
            yield pa.RecordBatch.from_arrays([loc, pa.array(i[kept]), pa.array(shape[kept]), pa.array(rank[kept]), pa.array(rank[partner[kept]])], names=["loc", "i", "shape", "x", "y"])

    return texts.mapInArrow(run, "loc long, i int, shape int, x long, y long")


def doubled(docs: DataFrame, length: int) -> DataFrame:
    """``(loc, own array<struct<i, at, shape>>, levels array<struct<i, level>>)`` of texts ``docs(loc, text)``: phrases that occur
    at two places, and how far they do: 2**level of them in a row.

    Prefix doubling: phrases get ranks, then pairs of ranks at offsets 1, 2, 4, ... get ranks, each round among those that
    the one before it found twice, until all are unique or no string of ``length`` bytes can hold a longer row. A rank names its
    class by its least place; which of two different strings is the lesser one doesn't matter here.
    """
    spark, window, gone = docs.sparkSession, window_of(length), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name)
        gone.append(path)
        return df

    phrases, first = stored(_phrases(docs, length, window), "phrases")
    rows = kept(_reranked(phrases, ["rank"], "at"), "ranks")
    remove(spark, first)
    texts = kept(rows.groupBy("loc").agg(F.collect_set(F.struct("i", "at", "shape", "rank")).alias("own")), "texts")
    highest = texts.select(F.max(F.array_max(F.transform("own", lambda x: F.shiftright(x["shape"], 4 * BLOCKS))))).first()[0] or 0
    at_level = texts.select("loc", F.transform("own", lambda x: F.struct(x["i"], x["shape"], x["rank"])).alias("own"))
    levels = []
    for level in range(1, highest + 1):
        rows = kept(_reranked(_pairs(at_level, 1 << (level - 1)), ["x", "y"], "i").select("loc", "i", "shape", "rank"), "ranks")
        levels.append(rows.select("loc", F.struct("i", F.lit(level).alias("level")).alias("one")))
        at_level = rows.groupBy("loc").agg(F.collect_list(F.struct("i", "shape", "rank")).alias("own"))
    out = texts.select("loc", F.transform("own", lambda x: F.struct(x["i"].alias("i"), x["at"].alias("at"), x["shape"].alias("shape"))).alias("own"))
    if levels:
        every = levels[0]
        for x in levels[1:]:
            every = every.union(x)
        out = out.join(every.groupBy("loc").agg(F.collect_list("one").alias("levels")), "loc", "left")
    else:
        out = out.withColumn("levels", F.lit(None).cast("array<struct<i:int,level:int>>"))
    out, _ = stored(out, "doubled", passing=True)
    for path in gone:
        remove(spark, path)
    return out


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return [pa.array(both[:, k].copy()) for k in (0, 1)]


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """``(c1, c2, f, loc, p)``: blocks of strings that may occur twice, of ``texts(loc, text, own, levels)``.

    The block's strings begin at p and the bytes before it; c1 and c2 are a hash of what they have in common, f one of all they
    reach (of the place alone where the text ends first).
    """
    wide = window_of(length) // BLOCKS
    shared = length - wide + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, full = xxhash.xxh3_128_digest, xxhash.xxh3_64_digest
        for batch in batches:
            for loc, text, own, levels in zip(*(batch.column(k) for k in range(4))):
                i, at, shape = (own.values.field(k).to_numpy() for k in range(3))
                level, order = np.zeros(len(i), dtype=np.int64), np.argsort(i)
                if levels.is_valid:
                    np.maximum.at(level, order[np.searchsorted(i, levels.values.field(0).to_numpy(), sorter=order)], levels.values.field(1).to_numpy())
                raw = text.as_buffer().to_pybytes()
                starts = [at[(shape >> 4 * b & 15) <= level].astype(np.int64) - b * wide for b in range(BLOCKS)]
                p, own_loc, last = np.concatenate(starts), loc.as_py(), len(raw) - length
                at_p = p.tolist()
                cores = [core(raw[x : x + shared]) for x in at_p]
                fulls = [full(raw[x - wide + 1 : x + length] if wide - 1 <= x <= last else b"%d %d" % (own_loc, x)) for x in at_p]
                columns = [*_halves(cores), pa.array(np.frombuffer(b"".join(fulls), dtype="<i8")), pa.array(np.full(len(p), own_loc)), pa.array(p.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["c1", "c2", "f", "loc", "p"])

    return texts.mapInArrow(run, "c1 long, c2 long, f long, loc long, p int")


def _strings(texts: DataFrame, length: int) -> DataFrame:
    """``(g1, g2, loc, q)``: each string of the blocks at ``p`` of ``texts(loc, text, p array<int>)``."""
    wide = window_of(length) // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for loc, text, p in zip(*(batch.column(k) for k in range(3))):
                raw = text.as_buffer().to_pybytes()
                q = np.unique((p.values.to_numpy()[:, None].astype(np.int64) - np.arange(wide)).ravel())
                q = q[(q >= 0) & (q <= len(raw) - length)]
                columns = [*_halves([digest(raw[x : x + length]) for x in q.tolist()]), pa.array(np.full(len(q), loc.as_py())), pa.array(q.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["g1", "g2", "loc", "q"])

    return texts.mapInArrow(run, "g1 long, g2 long, loc long, q int")


def _with_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with its texts; a text of many copies may be split."""
    keyed = found.withColumn("_key", redealt("loc")).drop("loc")
    return docs.withColumn("_key", redealt("loc")).join(keyed, "_key").drop("_key")


def repeated_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """``(loc, ranges array<struct<start, stop>>)``: what strings that occur twice cover in texts ``docs(loc, text)``; ranges may overlap.

    Doubling (``doubled``) leaves the places whose surroundings occur twice. Around these, strings are compared in blocks by
    what all of a block share and by all that they reach: where the whole is found twice, every string is. Only where that
    differs, at the ends of a repeated passage, is each string compared itself, and of equal blocks only one.
    """
    spark, wide = docs.sparkSession, window_of(length) // BLOCKS
    near = doubled(docs, length)
    blocks, blocks_path = stored(_blocks(_with_texts(docs, near).select("loc", "text", "own", "levels"), length), "blocks")
    wholes = blocks.groupBy("c1", "c2", "f").agg(F.min(_place("p")).alias("leader"), F.max(_place("p")).alias("other"))
    wholes = wholes.select("c1", "c2", "f", "leader", (F.col("leader") < F.col("other")).alias("twice"))
    mixed = wholes.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("twice").alias("all_twice")).where("n > 1 and not all_twice")
    mixed = mixed.select(redealt("c1").alias("_key"), "c2", F.lit(True).alias("mixed"))
    known = wholes.withColumn("_key", redealt("c1")).join(mixed, ["_key", "c2"], "left").where("twice or mixed").drop("_key")
    known = known.select(redealt("c1").alias("_key"), "c2", "f", "leader", "twice", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    met = blocks.withColumn("_key", redealt("c1")).join(known, ["_key", "c2", "f"])
    met, met_path = stored(met.select("loc", "p", "twice", (F.col("mixed") & (_place("p") == F.col("leader"))).alias("asks")).where("twice or asks"), "met")
    remove(spark, blocks_path)
    whole = met.where("twice").select("loc", (F.col("p") - wide + 1).alias("start"), (F.col("p") + length).alias("stop"))
    asks = met.where("asks").groupBy("loc").agg(F.collect_set("p").alias("p"))
    strings, strings_path = stored(_strings(_with_texts(docs, asks).select("loc", "text", "p"), length), "strings")
    single = _reranked(strings, ["g1", "g2"], "q").select("loc", F.col("q").alias("start"), (F.col("q") + length).alias("stop"))
    ranges = whole.union(single).groupBy("loc").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    ranges, _ = stored(ranges, "ranges", passing=True)
    for path in (met_path, strings_path):
        remove(spark, path)
    return ranges


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges with those that overlap or touch made one, in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order]) if len(order) else stop
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(order) else order
    return start[first], reach[np.r_[first[1:] - 1, len(reach) - 1]] if len(order) else reach


def drop_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (long), ``spans array<struct<start long, stop long>>`` and ``kept`` (binary); columns of these names are replaced.

    Texts are UTF-8 bytes, null is the empty text. Every byte goes that is covered by a string of ``length`` bytes that also
    starts at another place: of the same row or another, overlaps included, all judged on the input. So of a text
    that two rows have in full nothing is left, if it is that long. ``spans`` are the runs removed, in order, ``kept`` the rest (it may
    end inside a character). No row is dropped; ids only go along and may be null or repeated.

    Texts and ranks have names of 64 bits, the strings themselves of 128.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "spans", "kept")]
    own = docs.select(F.xxhash64(text_col).alias("loc"), F.col(text_col).alias("text")).where(F.octet_length("text") >= length)
    copies = own.groupBy("loc").agg(F.count("*").alias("n")).where("n > 1").select("loc", F.array(F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("stop"))).alias("ranges"))
    ranges = repeated_ranges(own, length)
    ranges = ranges.join(copies.select("loc"), "loc", "left_anti").union(copies)
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), redealt_text(text_col).alias("_key"))
    joined = rows.join(ranges.select(redealt("loc").alias("_key"), "ranges"), "_key", "left")

    @F.pandas_udf("n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
    def cut(texts, ranges):
        import pandas as pd

        out = []
        for text, found in zip(texts, ranges):
            raw = (text or "").encode()
            found = [] if found is None or len(raw) < length else found
            start, stop = merged(*(np.array([min(r[k], len(raw)) for r in found], dtype=np.int64) for k in ("start", "stop")))
            spans = list(zip(start.tolist(), stop.tolist()))
            ends = [0, *(x for s in spans for x in s), len(raw)]
            out.append((len(raw), [{"start": a, "stop": b} for a, b in spans], b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])

    done = joined.select("row", cut(F.col("row")[text_col], F.col("ranges")).alias("cut"))
    return done.select(*[F.col("row")[c].alias(c) for c in names], "cut.n_bytes", "cut.spans", "cut.kept")


def redealt_text(text_col: str) -> F.Column:
    return F.xxhash64(text_col).bitwiseXOR(F.lit(0).cast("long"))
