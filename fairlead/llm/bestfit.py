"""Packing documents into sequences by best fit decreasing."""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairlead.llm.common import stable

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words, and as many parts of words, that a worker remembers with their ids, in two halves: the older half goes when the newer is full.
#: Only those of up to KNOWN_BYTES stay, so that both bounds together bound the bytes.
MOST_KNOWN, KNOWN_BYTES = 400_000, 64
#: Marks that stand around a word as parts of their own, where the tokenizer keeps letters and marks apart.
EDGES = b'.,;:!?()[]{}"'
#: Letters A-Z, a-z and those from U+00C0 to U+017F (but for U+0130, whose lower case is two characters), in UTF-8.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+").fullmatch
#: Ranking groups hold GROUP_ROWS pieces of one length, or more where there would be over MOST_GROUPS of them.
GROUP_ROWS, MOST_GROUPS = 20_000, 100_000

_tokenizers: dict = {}


class Remembered:
    """Ids by text, about ``most`` of them; what was met again lately stays."""

    def __init__(self, most: int):
        self.half, self.newer, self.older = most // 2, {}, {}

    def missing(self, keys: Iterable[bytes]) -> list[bytes]:
        """Those that aren't known; all others are in ``newer`` now, up to the next call."""
        if len(self.newer) > self.half:
            self.newer, self.older = {}, self.newer
        newer, older, out = self.newer, self.older, []
        for k in keys:
            if k not in newer:
                found = older.get(k)
                if found is None:
                    out.append(k)
                else:
                    newer[k] = found
        return out

    def forget(self, keys: Iterable[bytes]) -> None:
        """Of ``keys``, the long ones go."""
        for k in keys:
            if len(k) > KNOWN_BYTES:
                self.newer.pop(k, None)


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins text over ASCII white space.

    Such a tokenizer's ids of a text are those of its words in a row. A word of letters with marks around it goes
    as its parts if the tokenizer keeps them apart, and letters go straight to its model if what stands before that
    works on each letter for itself; other words go whole. Words and parts are tokenized when a worker first meets them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.parts = Remembered(MOST_KNOWN), Remembered(MOST_KNOWN)
        own = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        marks = EDGES.decode()
        self.apart = all(own(f"{m}{w}{m}") == own(m) + own(w) + own(m) for m in [*marks, marks] for w in ("a", "word", "s", "Élan"))
        letters = [c for c in map(chr, range(0x180)) if LETTERS(c.encode())]
        self.table = {ord(c): self._before_model(c) for c in letters}
        #: ASCII letters reach the model in lower case and nothing else happens to them.
        self.lowers = all(self.table[ord(c)] == c.lower() for c in string.ascii_letters)
        self.direct = all(own(w) == self._letters(w.encode()) for w in [*letters, *(f"x{c}" for c in letters), *(f"{c}e" for c in letters), "".join(letters), "word", "WORD"])

    def _before_model(self, text: str) -> str:
        normal, parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normal.normalize_str(text) if normal else text
        return "".join([p for p, _ in parts.pre_tokenize_str(text)]) if parts else text

    def _letters(self, word: bytes) -> list[int]:
        text = word.lower().decode() if self.lowers and word.isascii() else word.decode().translate(self.table)
        return [t.id for t in self.model.tokenize(text)]

    def _split(self, word: bytes) -> tuple[bytes, ...]:
        if not self.apart or word.isalpha():  # of ASCII letters alone
            return (word,)
        core = word.strip(EDGES)
        if len(core) == len(word) or not (core.isalpha() or LETTERS(core)):
            return (word,)
        front = len(word) - len(word.lstrip(EDGES))
        return tuple([x for x in (word[:front], core, word[front + len(core) :]) if x])

    def _learn(self, parts: list[bytes]) -> None:
        known, rest = self.parts.newer, []
        for p in parts:
            if self.direct and (p.isalpha() or LETTERS(p)):
                known[p] = array("I", self._letters(p)).tobytes()
            else:
                rest.append(p)
        for p, e in zip(rest, self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False) if rest else ()):
            known[p] = array("I", e.ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids (array's order of bytes is the machine's: little-endian ones are meant)."""
        words = text.encode().split()
        new = self.words.missing(set(words))
        if new:
            longest = max(map(len, new))
            split = [self._split(w) for w in new]
            self._learn(self.parts.missing({p for ps in split for p in ps}))
            parts = self.parts.newer
            self.words.newer.update(zip(new, [parts[ps[0]] if len(ps) == 1 else b"".join([parts[p] for p in ps]) for ps in split]))
        out = b"".join(map(self.words.newer.__getitem__, words))
        if new and longest > KNOWN_BYTES:
            self.words.forget(new)
            self.parts.forget([p for ps in split for p in ps])
        return out


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each row's ids and ``end_id``, cut after every ``capacity`` ids."""
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_at(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.ids(text.as_py() or "") + end
                for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[i : i + 4 * capacity]
                    out.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


class Capacities:
    """Segment tree over remaining capacities 0..most: which have open bins, and the least one that fits."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.tree = [False] * (2 * self.width)

    def set(self, capacity: int, open_: bool) -> None:
        i = self.width + capacity
        self.tree[i] = open_
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def least_from(self, capacity: int) -> int | None:
        """The least open capacity of at least this, by climbing and descending one path."""
        i = self.width + capacity
        if self.tree[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit decreasing over pieces by length: rows ``(length, first rank, per bin, first bin, offset)``.

    Pieces of one length are interchangeable, and so are open bins of one remaining capacity. In best fit the next
    piece of the same length goes on into the bin just used while that still holds one, as it is now the tightest.
    So each step takes the tightest capacity that fits and puts a run of pieces into a run of its bins, exactly as
    piece-by-piece placing would. The state depends on the number of lengths, not of documents: at most
    ``capacity`` lengths, and no more rows than pairs of length and capacity.
    """
    tree, runs, out, bins = Capacities(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n:
            if not runs.get(room):
                tree.set(room, True)
            runs.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least_from(length)
            if room is None:
                room, first, have = capacity, bins, -(-left // (capacity // length))
                bins += have
            else:
                first, have = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            each = room // length
            full = min(have, left // each)
            if full:
                out.append((length, rank, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = have - full
            if rest and left:
                # Fewer pieces than one bin of this capacity takes.
                out.append((length, rank, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                left, rest, full = 0, rest - 1, full + 1
            put(room, first + full, rest)
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, by one best-fit-decreasing packing of all of them.

    The driver gets the counts by length (at most ``capacity``) and the sizes of ranking groups (at most about
    MOST_GROUPS), both bounded, and broadcasts the plan. Every piece finds its place from its rank among the
    pieces of its length; no task sees all of a length.
    """
    spark = pieces.sparkSession
    rows = stable(pieces).withColumn("uid", F.monotonically_increasing_id())
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    size = max(GROUP_ROWS, sum(counts.values()) // MOST_GROUPS)
    groups = [-(-counts.get(n, 0) // size) or 1 for n in range(capacity + 1)]
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("uid"), F.array(*[F.lit(x) for x in groups])[F.col("length").cast("int")]).cast("int"))
    plan = best_fit_plan(counts, capacity)
    sizes = sorted((r["length"], r["grp"], r["n"]) for r in rows.groupBy("length", "grp").agg(F.count("*").alias("n")).collect())
    before, last, total = {}, None, 0
    for length, group, n in sizes:
        total = 0 if length != last else total
        before[length, group], last, total = total, length, total + n
    shared = spark.sparkContext.broadcast((plan, before))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("length", "grp").orderBy("uid")) - 1)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before = shared.value
        key = plan[:, 0] * (1 << 48) + plan[:, 1] if len(plan) else np.zeros(0, np.int64)
        for batch in batches:
            length = batch.column("length").to_numpy()
            start = np.array([before[x] for x in zip(length.tolist(), batch.column("grp").to_pylist())], dtype=np.int64)
            rank = start + batch.column("place").to_numpy()
            run = plan[np.searchsorted(key, length * (1 << 48) + rank, "right") - 1] if len(rank) else plan[:0]
            inside = rank - run[:, 1]
            bins, offset = run[:, 3] + inside // np.maximum(run[:, 2], 1), run[:, 4] + inside % np.maximum(run[:, 2], 1) * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bins), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "grp", "place").mapInArrow(seat, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize every row and pack it: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they stand, rows without an id
    too; other columns are ignored. An empty table gives an empty result.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
