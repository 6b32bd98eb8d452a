"""Shards of near-equal bytes by k-d tree partitioning; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.common import stable, unsigned_crc32_text

#: Bits of a key that one round of the median search settles: it sums at most 2**DIGIT rows a node.
DIGIT = 16
#: Rows of one ranking group, while there are fewer than MOST_GROUPS groups a shard.
GROUP_ROWS, MOST_GROUPS = 20_000, 1024
DIMENSIONS = ("d0", "d1", "d2", "d3")


def document_metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, text_crc32, d0..d3, place)``, checkpointed; the splits never see the texts.

    Dimensions: text size, id, source, language (names by their CRC-32; null as -1). place is unique.
    """
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        unsigned_crc32_text(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(unsigned_crc32_text(F.col(source_col)), F.lit(-1)).cast("long").alias("d2"),
        F.coalesce(unsigned_crc32_text(F.col(lang_col)), F.lit(-1)).cast("long").alias("d3"),
    )
    rows = narrow.withColumns({"d0": F.col("size"), "d1": F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))})
    return stable(rows).withColumn("place", F.monotonically_increasing_id())


def with_uid(rows: DataFrame, most_inside: int) -> DataFrame:
    """``uid``, which settles ties: the partition and the row in it (``place``), with no unused bits between."""
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("uid", F.shiftright("place", 33) * (most_inside + 1) + inside)


def _at(values: list, kind: str) -> Column:
    """The value for a row's node: an array literal indexed by it."""
    return F.array(*[F.lit(x).cast(kind) for x in values])[F.col("node")]


def _unsigned(key: Column) -> Column:
    """Longs in an order that unsigned digits follow."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def _weighted_medians(rows: DataFrame, key: Column, low: dict[int, int], high: dict[int, int], below: dict[int, int], goal: dict[int, float], nodes: int, digit: int = DIGIT) -> dict[int, tuple[int, int, int, int, int]]:
    """For each node in ``low``: (value, bytes below it, bytes of it, rows below it, rows of it) of the key at which bytes reach ``goal``.

    A search by digits: each round sums bytes by (node, digit) among the rows that share the digits found, in a
    window over at most 2**digit sums a node, and one row a node reaches the driver. Rows below are counted from
    the rows given, bytes below from ``below``.
    """
    mask = (1 << 64) - 1
    flip = lambda x: (x ^ (1 << 63)) & mask  # noqa: E731  signed long -> unsigned order
    back = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    shift = max([0, *((flip(low[n] & mask) ^ flip(high[n] & mask)).bit_length() for n in low)])
    found = {n: flip(low[n] & mask) >> shift if shift < 64 else 0 for n in low}
    below, before_n, own = dict(below), dict.fromkeys(low, 0), {}
    while True:
        step = min(digit, shift)
        before, shift = shift, shift - step
        unsigned = _unsigned(key)
        prefix = F.shiftrightunsigned(unsigned, before) if before < 64 else F.lit(0).cast("long")
        place = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
        chosen = rows.where(_at([n in low for n in range(nodes)], "boolean") & (prefix == _at([back(found.get(n, 0)) for n in range(nodes)], "long")))
        sums = chosen.groupBy("node", place.alias("digit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        upto = W.partitionBy("node").orderBy("digit")
        total = F.sum("bytes").over(upto) + _at([below.get(n, 0) for n in range(nodes)], "long")
        reached = sums.withColumns({"to": total, "to_n": F.sum("n").over(upto)}).where(F.col("to") >= _at([goal.get(n, 0.0) for n in range(nodes)], "double"))
        for r in reached.groupBy("node").agg(F.min(F.struct("digit", "bytes", "to", "n", "to_n")).alias("x")).select("node", "x.*").collect():
            n = r["node"]
            found[n], below[n], before_n[n] = (found[n] << step) | r["digit"], r["to"] - r["bytes"], before_n[n] + r["to_n"] - r["n"]
            own[n] = r["bytes"], r["n"]
        if shift == 0:
            return {n: (back(found[n] ^ (1 << 63)), below[n], own[n][0], before_n[n], own[n][1]) for n in low}


def _cut(goal: float, below: int, own: int, n_below: int, n: int) -> bool:
    """Whether the row at the median (``own`` bytes) goes left: what leaves the sides nearer to their shares, and neither empty."""
    return n_below == 0 or (n_below + 1 < n and below + own - goal <= goal - below)


def kd_leaves(rows: DataFrame, shards: int, most_uid: int, dimensions: tuple[str, ...] = DIMENSIONS) -> tuple[DataFrame, int]:
    """Rows with their leaf (``shard`` from 0) and the number of leaves, at most ``shards``.

    A node is worth as many leaves as its bytes are times the target (all bytes by ``shards``). One that is worth more than
    one is split at the weighted median, or the share of half its leaves rounded down, of the dimension that is widest
    in it (range over the table's range; ties to the first), rows of equal value in order of uid. Both sides then get
    leaves by their bytes, but no more than they have rows, so that a text larger than a leaf leaves none empty. All
    nodes of a level are searched together; the driver holds a few numbers a node.
    """
    rows = rows.withColumn("node", F.lit(0))
    worth, tree, level = {0: shards}, 1, 0
    whole: dict[str, float] = {}
    while any(w > 1 for w in worth.values()):
        spans = [f(d).alias(f"{d}_{k}") for d in dimensions for k, f in (("lo", F.min), ("hi", F.max))]
        open_ = rows.where(_at([worth.get(n, 1) > 1 for n in range(tree)], "boolean"))
        grow = {r["node"]: r for r in open_.groupBy("node").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *spans).collect() if r["n"] > 1}
        if not grow:
            break
        whole = whole or {d: max(grow[0][f"{d}_hi"] - grow[0][f"{d}_lo"], 1) for d in dimensions}
        dim = {n: max(range(len(dimensions)), key=lambda i, r=r: ((r[f"{dimensions[i]}_hi"] - r[f"{dimensions[i]}_lo"]) / whole[dimensions[i]], -i)) for n, r in grow.items()}
        pick = _at([dim.get(n, 0) for n in range(tree)], "int")
        key = F.coalesce(*[F.when(pick == i, F.col(d)) for i, d in enumerate(dimensions)])
        goal = {n: r["bytes"] * (worth[n] // 2) / worth[n] for n, r in grow.items()}
        span = lambda k: {n: r[f"{dimensions[dim[n]]}_{k}"] for n, r in grow.items()}  # noqa: E731,B023
        value = _weighted_medians(rows, key, span("lo"), span("hi"), dict.fromkeys(grow, 0), goal, tree)
        tied = {n: v for n, v in value.items() if v[4] > 1}
        cut: dict[int, int] = {}  # greatest uid that goes left, of rows at the median
        left: dict[int, tuple[int, int]] = {}
        if tied:
            same = rows.where(key == _at([tied[n][0] if n in tied else 0 for n in range(tree)], "long"))
            at = _weighted_medians(same, F.col("uid"), dict.fromkeys(tied, 0), dict.fromkeys(tied, most_uid), {n: v[1] for n, v in tied.items()}, goal, tree)
        for n, v in value.items():
            uid, below, own, more, _ = at[n] if n in tied else (most_uid, v[1], v[2], 0, 1)
            goes = _cut(goal[n], below, own, v[3] + more, grow[n]["n"])
            cut[n] = uid if goes else uid - 1 if n in tied else -1
            left[n] = below + goes * own, v[3] + more + goes
        v, u = _at([value[n][0] if n in value else 0 for n in range(tree)], "long"), _at([cut.get(n, 0) for n in range(tree)], "long")
        right = _at([n in grow for n in range(tree)], "boolean") & ((key > v) | ((key == v) & (F.col("uid") > u)))
        numbers = {n: tree + k for k, n in enumerate(sorted(grow))}
        rows = rows.withColumn("node", F.when(right, _at([numbers.get(n, 0) for n in range(tree)], "int")).otherwise(F.col("node")))
        for n in [n for n in worth if n not in grow]:
            worth[n] = 1
        for n, to in numbers.items():
            share = round(worth[n] * left[n][0] / grow[n]["bytes"])
            least, most = max(1, worth[n] - (grow[n]["n"] - left[n][1])), min(worth[n] - 1, left[n][1])
            here = min(max(share, least), most) if least <= most else most
            worth[n], worth[to] = here, min(worth[n] - here, grow[n]["n"] - left[n][1])
        tree, level = tree + len(numbers), level + 1
        if level % 2 == 0:
            rows = stable(rows)  # or the plan would hold the rules of all levels
    return rows.withColumnRenamed("node", "shard"), tree


def gapless(rows: DataFrame, group: str, leaves: int, n: int) -> DataFrame:
    """``slot`` from 0 without gaps within each group: counts of hashed subgroups give offsets, a window the place inside."""
    parts = min(MOST_GROUPS, max(1, n // max(leaves, 1) // GROUP_ROWS + 1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
    counts = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.sum("n").over(W.partitionBy(group).orderBy("part")) - F.col("n")).drop("n")
    placed = rows.withColumn("inside", F.row_number().over(W.partitionBy(group, "part").orderBy("uid")) - 1)
    # At most MOST_GROUPS rows a leaf.
    return placed.join(F.broadcast(offsets), [group, "part"]).withColumn("slot", (F.col("before") + F.col("inside")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 8, **columns: str) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row, in at most ``shards`` shards.

    Law ``bytes``: the leaves' sizes are near equal. Null texts count one byte and have the checksum of the empty
    text; null ids, names and repeated rows are ordinary rows; an empty table gives an empty result; a text larger
    than a shard's share fills a leaf of its own, and the rest share the others. Fewer rows than shards get one each.
    """
    rows = document_metadata(docs, **columns)
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    n, most_inside, parts = rows.agg(F.count("*"), F.max(inside), F.max(F.shiftright("place", 33))).first()
    rows = with_uid(rows, most_inside or 0)
    placed, leaves = kd_leaves(rows, shards, ((parts or 0) + 1) * ((most_inside or 0) + 1))
    done = gapless(placed, "shard", leaves, n)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
