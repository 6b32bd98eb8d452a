"""Repair of conversations: depth-first branch-and-bound over edits of their turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import unsigned_crc32_text

#: Rows of a conversation that are searched together.
SEGMENT = 8
#: What a repaired beginning ends with: nothing yet, a system turn, a user's, an assistant's. It may end a conversation at the first or last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NOTHING, ASSISTANT)
#: Whose turn may follow: name and state that it leads to.
NEXT = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
GOOD, CUT, BAD = 0, 1, 2
WHITE = " \t\n\v\f\r"


def search(rows: list[tuple[str, int]], entries: dict[int, tuple[int, int]], last: bool) -> dict[int, tuple[int, int, str]]:
    """The cheapest edits of some rows in a row, ``(role initial, fault)``, from each way in to each way out.

    ``entries`` says of each state before them what its beginning costs and its rank among the beginnings' audits; the
    result, of each state behind them (``last``: that may end a conversation, after inserts), cost, rank and audit of these rows, least in
    this order. Depth first with an explicit stack: the children that cost least are looked at first, a node is cut where its cost
    with the least that the rows after it cost exceeds every way out found so far, or where the table of its row and
    state holds a beginning that is no worse. The stack runs empty: what is left is proved best.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (0, TRUNCATED, DELETE)[rows[k][1]]
    best: list[dict[int, tuple[int, int, str]]] = [{} for _ in range(n + 1)]
    found: dict[int, tuple[int, int, str]] = {}
    goals = FINAL if last else range(4)
    stack = [(0, state, cost, rank, "", False) for state, (cost, rank) in sorted(entries.items(), key=lambda x: x[1], reverse=True)]
    while stack:
        k, state, cost, rank, audit, inserted = stack.pop()
        # A way out that is still open, or dearer than this node's bound, keeps it.
        if last:
            if found and cost + ahead[k] > min(x[0] for x in found.values()):
                continue
        elif len(found) == len(goals) and cost + ahead[k] > max(x[0] for x in found.values()):
            continue
        mine, known = (cost, rank, audit), best[k].get(state)
        if known is not None and known <= mine and (known < mine or k < n or not inserted):
            continue
        # Behind the last row, a beginning with inserts is a way out of the last rows alone.
        if k == n:
            if inserted and not last:
                continue
            best[k][state] = mine
            if state in goals and (state not in found or mine < found[state]):
                found[state] = mine
            if not last:
                continue
        else:
            best[k][state] = mine
        name, following = NEXT[state]
        children = [(INSERT, "I", k, following, True)]
        if k < n:
            initial, fault = rows[k]
            children.append((DELETE, "D", k + 1, state, False))
            if fault != BAD:
                more = TRUNCATED if fault == CUT else 0
                children.append((REROLE + more, "R", k + 1, following, False))
                if initial == name[0]:
                    children.append((more, "K", k + 1, following, False))
                elif initial == "s" and state == NOTHING:
                    children.append((more, "K", k + 1, SYSTEM, False))
        children.sort(key=lambda x: x[:2], reverse=True)
        for added, letter, at, to, new in children:
            stack.append((at, to, cost + added, rank, audit + letter, new))
    return found


class Repair:
    """One conversation, a row at a time: ``add`` its rows in order, then ``end``; ``out`` gets role and text of each repaired row.

    Rows are searched in segments. Of each, the best edits to every state behind it are kept, until all of them go back to
    the same state in front of a segment: what is before it is decided and goes to ``out``. So memory follows what is undecided.
    """

    def __init__(self, out: Callable[[str, str], None]):
        self.out, self.held, self.segments, self.audit = out, [], [], []
        self.front = {NOTHING: (0, 0)}
        self.state, self.cost = NOTHING, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.before = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        bare = text.rstrip(WHITE)
        again = self.before is not None and self.before == (turn, role, text)
        if not bare:
            fault, self.blank = BAD, self.blank + 1
        elif seen or again:
            fault, self.duplicate = BAD, self.duplicate + 1
        elif bare[-1] not in ".!?":
            fault, self.truncated = CUT, self.truncated + 1
        else:
            fault = GOOD
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and (self.before is None or self.before[0] != turn):
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.before = (turn, role, text)
        if len(self.held) == SEGMENT:
            self._close(False)
        self.held.append((role, text, fault))

    def _close(self, last: bool) -> None:
        ways = {}
        for state, entry in self.front.items():
            for to, way in search([(r[:1], f) for r, _, f in self.held], {state: entry}, last).items():
                if to not in ways or way < ways[to][1]:
                    ways[to] = (state, way)
        self.segments.append((self.held, {to: (state, way[2]) for to, (state, way) in ways.items()}))
        self.held = []
        # Ranks of whole beginnings: rank of the state they came by, then their own audit.
        order = sorted({(way[1], way[2]) for _, way in ways.values()})
        self.front = {to: (way[0], order.index((way[1], way[2]))) for to, (_, way) in ways.items()}
        if last:
            end = min(FINAL, key=lambda s: self.front.get(s, (float("inf"), 0)))
            self.cost, self.front = self.front[end][0], {end: self.front[end]}
        self._decide()

    def _decide(self) -> None:
        """Hand on the segments in front of which all ways meet."""
        at, keep = set(self.front), len(self.segments)
        paths = [at]
        while keep:
            keep -= 1
            at = {self.segments[keep][1][s][0] for s in at}
            paths.append(at)
        paths.reverse()
        done = 0
        for k, (rows, ways) in enumerate(self.segments):
            if len(paths[k + 1]) > 1:
                break
            self._apply(rows, ways[next(iter(paths[k + 1]))][1])
            done = k + 1
        del self.segments[:done]

    def _apply(self, rows: list[tuple[str, str, int]], audit: str) -> None:
        self.audit.append(audit)
        left = iter(rows)
        for letter in audit:
            name, following = NEXT[self.state]
            role, text = ("", "") if letter == "I" else next(left)[:2]
            if letter == "D":
                continue
            system = letter == "K" and role[:1] == "s"
            self.state = SYSTEM if system else following
            self.out(role if letter == "K" else name, text)

    def end(self) -> dict:
        if self.held:
            self._close(True)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit)}


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, dropped)``: conversations with faults put in by the checksum of ``conv_id:turn``, modulo 20: 0 drops the row,
    1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it the user's. Null roles and texts are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.col("_kind")
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (unsigned_crc32_text(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("_kind"))
    rows = rows.withColumns({
        "role": F.when(kind == 4, "user").otherwise(F.col("role")),
        "text": F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "_times": F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))),
    })
    return rows.select("conv_id", "turn", "role", "text", (kind == 0).alias("dropped"))


def _marked(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, dropped, seen)``, dealt by conversation and in order: ``seen`` where an earlier turn says the same in the same role."""
    rows = rows.withColumn("_said", F.md5("text"))
    firsts = rows.where("not dropped").groupBy("conv_id", "role", "_said").agg(F.max(F.col("turn").isNull()).alias("early"), F.min("turn").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_said").alias("_key"), "early", "first")
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.concat("_said", F.lit("")) == F.col("_key"))
    seen = F.coalesce(F.when(F.col("early"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))
    joined = rows.join(firsts, on, "left").select("conv_id", "turn", "role", "text", "dropped", seen.alias("seen"))
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _folded(batches: Iterator[pa.RecordBatch], begin: Callable, end: Callable) -> Iterator:
    """Give each conversation's rows to what ``begin(conv_id)`` makes; ``end`` gets that and yields what comes of it."""
    open_, own = None, None
    for batch in batches:
        for conv, turn, role, text, dropped, seen in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if open_ is None or conv != own:
                if open_ is not None:
                    yield from end(open_)
                open_, own = begin(conv), conv
            if not dropped:
                open_[1].add(turn, role, text, seen)
    if open_ is not None:
        yield from end(open_)


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _rows(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, dropped: Column | None) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), (F.lit(False) if dropped is None else dropped).alias("dropped"))


def repair_summary(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", dropped: Column | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for every conversation.

    A repaired conversation is empty, or user and assistant in turns, the assistant last, perhaps behind a system turn.
    Edits: keep a row, give it the role of user or assistant (3), delete it (4; blank and duplicate rows must go), insert an
    empty one (3); a truncated row that stays costs 3. The cheapest edits are found by branch-and-bound (``search``); of equal ones the
    least audit (initials of the edits). Counts are of the rows as they come.

    Rows go by turn (null first), then role and text; null roles and texts are one space, a null id is a conversation of its own.
    ``dropped`` rows count for nothing, but their conversation is told: all zeros if it has no other. Repeated rows are duplicates.
    Other columns are ignored. Each conversation streams through one task, since one SHA-256 of all its repaired rows can't be cut;
    that task keeps what is undecided and the audit, a letter a row.
    """
    rows = _marked(_rows(turns, id_col, turn_col, role_col, text_col, dropped))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def begin(conv):
        digest = hashlib.sha256()
        first = [True]

        def out(role: str, text: str) -> None:
            digest.update(("" if first[0] else "\n").encode() + f"{role}:{text}".encode())
            first[0] = False

        return conv, Repair(out), digest

    def end(one) -> Iterator[tuple]:
        said = one[1].end()
        yield (one[0], *(said[c] for c in SUMMARY), said["audit"], one[2].hexdigest())

    names = ["conv_id", *SUMMARY, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(_folded(batches, begin, end), names, conv_type)

    conv_type = _arrow(rows, "conv_id")
    return rows.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in SUMMARY) + ", audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)``: the repaired rows themselves, with turns from 0; conversations as in ``repair_summary``."""
    rows = _marked(_rows(turns, id_col, turn_col, role_col, text_col, None))
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv_type = _arrow(rows, "conv_id")

    def begin(conv):
        made: list[tuple[str, str]] = []
        return conv, Repair(lambda role, text: made.append((role, text))), made

    def end(one) -> Iterator[tuple]:
        one[1].end()
        yield from ((one[0], k, role, text) for k, (role, text) in enumerate(one[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(_folded(batches, begin, end), ["conv_id", "turn", "role", "text"], conv_type)

    return rows.mapInArrow(run, f"conv_id {kind}, turn long, role string, text string")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _in_batches(rows: Iterator[tuple], names: list[str], first: pa.DataType, most: int = 2000) -> Iterator[pa.RecordBatch]:
    kinds = [first, *(pa.string() if c in ("audit", "repaired_sha256", "role", "text") else pa.int64() for c in names[1:])]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held.clear()
    if held:
        yield batch()
