"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import redealt, stable, words
from fairlead.llm.components import connected_components

BITS = 64


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``width`` words in a row; fewer words make one shingle, no word makes none."""
    own = words(text)
    if not own:
        return np.empty(0, dtype="<u8")
    joined, wide = b" ".join(own), min(width, len(own))
    ends = [x + i for i, x in enumerate(accumulate(map(len, own)))]
    starts = [0, *(x + 1 for x in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[wide - 1 :])], dtype="<u8")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is set if more than half of the shingles' XXH64 have it.

    Fewer than ``width`` words make one shingle; no word gives zero.
    """
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """``fingerprint`` of a text's shingle hashes, repeats included."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, width: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, width, seed) for x in texts], dtype="int64")

    return of(text)


def hex_fingerprint(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def hamming_links(prints: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs ``(a, b)`` of different fingerprints (column ``fp``, distinct) that differ in at most ``distance`` bits.

    Two such fingerprints agree up to ``distance // segments`` bits in some segment. The table holds each
    fingerprint under each segment's value; a probe enumerates the Hamming ball around its own segment values,
    fetches what the table holds there and compares whole fingerprints. Few long segments keep the buckets short:
    two of 32 bits give one chance match in 2**32 for each of 66 probes.
    """
    width = BITS // segments
    radius = distance // segments
    table, probes = [], []
    for s in range(segments):
        bits = width if s < segments - 1 else BITS - width * (segments - 1)
        value = F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit(_signed((1 << bits) - 1)))
        ball = [sum(1 << i for i in flips) for r in range(radius + 1) for flips in combinations(range(bits), r)]
        # One long holds segment number and value; a segment of all 64 bits needs no number.
        mark = s << bits if segments > 1 else 0
        table.append(value.bitwiseXOR(F.lit(_signed(mark))))
        probes += [value.bitwiseXOR(F.lit(_signed(mark ^ m))) for m in ball]
    stored = prints.select(F.col("fp").alias("a"), F.explode(F.array(*table)).alias("bucket"))
    asked = prints.select(F.col("fp").alias("b"), F.explode(F.array(*probes)).alias("bucket"))
    return stored.join(asked, "bucket").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: the least id reachable over links of at most ``distance`` bits.

    Null or word-less texts have fingerprint zero and link like any other. Rows with a null id get a component
    but never name it (it is null where no member has an id). Repeated rows come back as often as they stand;
    other columns of ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    Equal fingerprints are one node, so copies never meet pair by pair.
    """
    own = stable(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), width).alias("fp")))
    nodes = stable(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    return named_components(own, nodes, hamming_links(nodes.select("fp"), distance))


def named_components(own: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for rows ``own(doc_id, fp)``, ``nodes(fp, first_id)`` and links of nodes."""
    roots = connected_components(links)
    linked = roots.join(nodes, F.col("node") == F.col("fp"))
    named = linked.groupBy("root").agg(F.min("first_id").alias("component"))
    of = linked.select("node", "root").join(named, "root").select("node", "component")
    known = nodes.join(of, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "first_id").alias("component_id"))
    known = stable(known).select(redealt("fp").alias("key"), "component_id")
    return own.withColumn("key", redealt("fp")).join(known, "key", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each near-duplicate group.

    Rows that repeat such an id come down to one, the least by the hash of its text. Rows without an id stay
    only if no member of their group has one; one of them then stays.
    """
    return first_of_each(docs, near_duplicates(docs, id_col, text_col, distance), fingerprint_column, id_col, text_col)


def first_of_each(docs: DataFrame, groups: DataFrame, print_of: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """One row of each of ``groups(doc_id, fp, component_id)``; ``print_of`` a text gives its ``fp``."""
    groups = stable(groups)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("key"), F.xxhash64(text_col).alias("hash"))
    stay = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    # Repeated ids are rare; what decides between their texts is settled on (id, hash) rows before texts move.
    least = rows.select("key", "hash").join(stay, F.col("key") == F.col("doc_id")).groupBy("doc_id").agg(F.min("hash").alias("least"))
    kept = rows.join(least, (F.col("key") == F.col("doc_id")) & (F.col("hash") == F.col("least")), "left_semi").dropDuplicates(["key", "hash"])
    lone = groups.where("component_id is null").groupBy("fp").agg(F.count("*").alias("n"))
    if not lone.isEmpty():
        nameless = rows.where("key is null").withColumn("print", print_of(F.col("row")[text_col]))
        kept = kept.union(nameless.join(lone, F.col("print") == F.col("fp"), "left_semi").dropDuplicates(["print"]).drop("print"))
    return kept.select("row.*")
