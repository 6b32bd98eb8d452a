"""Text files of tag lines and VDM sentences as packets (columns of ``schema.PACKET``)."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.schema import PACKET

#: Undefined values of position reports.
NO_LON, NO_LAT = 181.0, 91.0
# Where messages hold their fields, as (types, first bit, bits) and for positions the parts of a degree.
POSITIONS = {
    "lon": [((1, 2, 3, 9), 61, 28, 600_000), ((18, 19), 57, 28, 600_000), ((4,), 79, 28, 600_000), ((21,), 164, 28, 600_000), ((27,), 44, 18, 600)],
    "lat": [((1, 2, 3, 9), 89, 27, 600_000), ((18, 19), 85, 27, 600_000), ((4,), 107, 27, 600_000), ((21,), 192, 27, 600_000), ((27,), 62, 17, 600)],
}
NUMBERS = {
    "sog": [((1, 2, 3), 50, 10), ((18, 19), 46, 10)],
    "cog": [((1, 2, 3, 9), 116, 12), ((18, 19), 112, 12)],
    "hdg": [((1, 2, 3), 128, 9), ((18, 19), 124, 9)],
    "acc": [((1, 2, 3, 9), 60, 1), ((18, 19), 56, 1), ((4,), 78, 1), ((21,), 163, 1), ((27,), 38, 1)],
    "navstat": [((1, 2, 3), 38, 4), ((27,), 40, 4)],
    "imo": [((5,), 40, 30)],
    "shiptype": [((5,), 232, 8), ((19,), 263, 8)],
}
TEXTS = {"name": [((5,), 112, 120), ((19,), 143, 120), ((21,), 43, 120)], "callsign": [((5,), 70, 42)]}
#: Type 24 says in two bits which of its parts it is: 0 has the name, 1 the ship's type and call sign.
PART_NAME, PART_TYPE, PART_CALLSIGN = (40, 120), (40, 8), (90, 42)
#: Six-bit characters by value.
SIX_BIT = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_ !\"#$%&'()*+,-./0123456789:;<=>?"


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*", recursive: bool = True, tag: str | None = None) -> DataFrame:
    """``(path, text, src_id)``: texts of whole messages, several rows a file.

    Plain files are read by Spark's text source, which splits them at any line; what a split begins or ends with and can't be
    told alone (a tag without its sentence, sentences of a message on both sides) is put together by file afterwards, so that the
    messages are those of the whole file. Zip archives are unpacked, member by member, one archive a task; they hold less than 2 GB.
    """
    find = {"pathGlobFilter": glob, "recursiveFileLookup": str(recursive).lower()}
    split = spark.read.options(**find).text(path).where(~F.lower(F.col("_metadata.file_name")).endswith(".zip"))
    lines = split.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    parts = lines.mapInArrow(cut_splits, "path string, start long, text string, open boolean")
    sound = parts.where("not open").select("path", "text")
    joined = parts.where("open").groupBy("path").applyInArrow(_stitched, "path string, text string")
    archives = spark.read.format("binaryFile").options(**find).load(path).where(F.lower(F.substring_index("path", "/", -1)).endswith(".zip")).select("path", "content")
    return sound.union(joined).union(archives.mapInArrow(_unpacked, "path string, text string")).withColumn("src_id", F.lit(tag).cast("string"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z.read(i).decode("latin-1")])], names=["path", "text"])


#: Line that ends an open message of a key in what splits leave over.
_ENDED = "\x02"
#: Behind the talker, a sentence that is a message of one part says so.
_ALONE = ",1,"
_LINE = re.compile(r"(?:\\[^\\]*\\)?(![A-Z]{5},.*)")


def _fields(sentence: str) -> tuple[int, int, tuple]:
    """Total and number of a sentence's message parts, and what its parts have in common."""
    f = [*sentence.split(","), "", "", "", ""]
    total, number = (int(x) if x.isascii() and x.isdigit() else 1 for x in f[1:3])
    return total, number, (f[0], str(total), *f[3:5])


class Cut:
    """Lines of a split, told apart: ``sound`` ones are messages whatever stands before and behind; ``left`` ones need the splits around.

    Units are a sentence with the tag line in front. A part of a message whose first part this split doesn't hold is left over, and so are
    messages that it doesn't end. Each key (talker, total, number, channel) keeps the order of its units.
    """

    def __init__(self, whole: bool):
        self.whole, self.sound, self.left, self.apart = whole, [], [], []
        self.waiting: dict[tuple, tuple[int, list[str]]] = {}
        self.begun: set[tuple] = set()
        self.tag: str | None = None
        self.first = not whole

    def add(self, line: str) -> None:
        first, self.first = self.first, False
        if line.startswith(_ENDED):
            held = self.waiting.pop(tuple(line[1:].split(",")), None)
            self.apart += ["\n".join(held[1])] if held else []  # nothing that follows may join it
            return
        found = _LINE.match(line)
        if first and found:
            self.left.append(line)  # its tag may stand in the split before
            return
        if first:
            self.left.append("")  # no sentence follows a tag that ends the split before
        tag, self.tag = self.tag, line if line.startswith("$PGHP,") else None
        unit = [tag, line] if found and tag is not None else [line]
        found = found or _LINE.search(line)
        if found and self.tag is None:
            self._take(unit, *_fields(found[1]))

    def _take(self, unit: list[str], total: int, number: int, key: tuple) -> None:
        if total <= 1:
            self._give(unit)
            return
        held = self.waiting.pop(key, None)
        if held is not None and number == held[0] + 1:
            unit = held[1] + unit
        else:
            if held is not None:
                self._give(held[1])
            elif key not in self.begun and not self.whole:
                if number != 1:
                    self.left += unit
                    return
                self.begun.add(key)
                self.left.append(_ENDED + ",".join(key))
            if number != 1:
                self._give(unit)
                return
        if number == total:
            self._give(unit)
        else:
            self.waiting[key] = (number, unit)

    def _give(self, unit: list[str]) -> None:
        self.sound += unit

    def end(self) -> None:
        for _, unit in self.waiting.values():
            (self.sound if self.whole else self.left).extend(unit)
        if self.tag is not None and not self.whole:
            self.left.append(self.tag)


def cut_splits(batches: Iterator[pa.RecordBatch], alone: bool = True) -> Iterator[pa.RecordBatch]:
    """Splits ``(path, start, value)``, one behind the other, as texts that are sound and texts that are open.

    A file stands ``alone``, or goes on where another one ended.
    """
    at, cut = None, None

    def told(done: bool) -> pa.RecordBatch:
        if done:
            cut.end()
        texts = [("\n".join(x), is_open) for x, is_open in ((cut.sound, False), (cut.left if done else [], True)) if x]
        cut.sound = []
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array([t for t, _ in texts], pa.string()), pa.array([o for _, o in texts], pa.bool_())], names=["path", "start", "text", "open"])

    for batch in batches:
        for path, start, line in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (path, start) != at:
                if cut is not None:
                    yield told(True)
                at, cut = (path, start), Cut(whole=False)
                cut.first = start > 0 or not alone
            # Most lines are tags and sentences that are whole messages.
            if line[6:9] == _ALONE and line[0] == "!" and not cut.first:
                if cut.tag is not None:
                    cut.sound.append(cut.tag)
                    cut.tag = None
                cut.sound.append(line)
            else:
                cut.add(line)
        if cut is not None:
            yield told(False)
    if cut is not None:
        yield told(True)


def _stitched(parts: pa.Table) -> pa.Table:
    """What the splits of one file left over, in their order, as messages."""
    ordered = parts.sort_by("start")
    cut = Cut(whole=True)
    for text in ordered.column("text").to_pylist():
        for line in text.split("\n"):
            cut.add(line)
    cut.end()
    texts = ["\n".join(cut.sound), *cut.apart]
    return pa.table({"path": pa.array(ordered.column("path")[:1].to_pylist() * len(texts)), "text": pa.array(texts)})


_SENTENCE = re.compile(r"((?:\$PGHP,[^\r\n]*\r?\n)?(?:\\[^\\\r\n]*\\)?)(![A-Z]{5},[^\r\n]*)")
#: So many messages may wait for their other sentences at once; the oldest then goes as it is.
MOST_OPEN = 1000


def messages(text: str) -> list[tuple[str, str | None]]:
    """``(lines, payload)`` of every message of a text, in the order of first sentences.

    Sentences of one talker, total, sequence number and channel that follow in number are one message, others may stand
    between them. Its lines are all of theirs with their tags; the payloads are joined. A message that lacks a sentence
    has no payload, so that nothing is made up from a part of it.
    """
    out: list[list] = []
    waiting: dict[tuple, list] = {}
    for tag, sentence in _SENTENCE.findall(text):
        f = sentence.split(",", 6)
        if sentence[6:9] == _ALONE:
            out.append([tag + sentence, f[5] if len(f) > 5 else ""])
            continue
        payload = f[5] if len(f) > 5 else ""
        total, number, key = _fields(sentence)
        if total <= 1:
            out.append([tag + sentence, payload])
            continue
        held = waiting.pop(key, None)
        if held is not None and number == held[2] + 1:
            held[0] += "\n" + tag + sentence
            held[2], held[3] = number, held[3] + payload
        else:
            held = [tag + sentence, None, number, payload]
            out.append(held)
            if number != 1:
                continue
        if number == total:
            held[1] = held[3]
        else:
            waiting[key] = held
            if len(waiting) > MOST_OPEN:
                waiting.pop(next(iter(waiting)))
    return [(x[0], x[1]) for x in out]


_LETTERS = np.frombuffer(SIX_BIT.encode(), dtype=np.uint8)
_UNREAD = 255


class Payloads:
    """Payloads of an Arrow batch as six-bit values side by side; fields are read from all rows of a type at once.

    A payload with a character that none of the six-bit values has can't be read.
    """

    def __init__(self, payloads: list[str | None]):
        raw = [(p or "").encode("latin-1", "replace") for p in payloads]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        value = np.full(256, _UNREAD, dtype=np.uint8)
        value[48:88], value[96:120] = np.arange(40), np.arange(40, 64)
        self.starts = np.cumsum(sizes) - sizes
        self.values = np.append(value[codes], np.zeros(32, dtype=np.uint8)).astype(np.int64)
        broken = np.add.reduceat(np.append(self.values[: len(codes)] == _UNREAD, False).astype(np.int64), np.minimum(self.starts, len(codes))) if len(raw) else sizes
        self.bits = np.where((broken > 0) & (sizes > 0), 0, 6 * sizes)
        self.type = np.where(self.bits >= 38, self.unsigned(np.arange(len(raw)), 0, 6), -1)

    def unsigned(self, rows: np.ndarray, start: int, length: int) -> np.ndarray:
        """A field of up to 58 bits of the rows, which are long enough."""
        first, last = start // 6, (start + length - 1) // 6
        out = np.zeros(len(rows), dtype=np.int64)
        for k in range(first, last + 1):
            out = out << 6 | self.values[np.minimum(self.starts[rows] + k, len(self.values) - 1)]
        return out >> (6 * (last + 1) - start - length) & ((1 << length) - 1)

    def signed(self, rows: np.ndarray, start: int, length: int) -> np.ndarray:
        found = self.unsigned(rows, start, length)
        return found - (found >> (length - 1) << length)

    def text(self, rows: np.ndarray, start: int, length: int) -> list[str | None]:
        """Six-bit text up to its first ``@``, without spaces at its end; null if none is left."""
        letters = np.stack([_LETTERS[self.unsigned(rows, start + 6 * i, 6)] for i in range(length // 6)], axis=1) if len(rows) else np.empty((0, 1), np.uint8)
        return [x.tobytes().split(b"@")[0].decode().rstrip(" ") or None for x in letters]

    def having(self, types: tuple[int, ...], start: int, length: int) -> np.ndarray:
        return np.flatnonzero(np.isin(self.type, types) & (self.bits >= start + length))


def decoded(payloads: list[str | None]) -> dict[str, pa.Array]:
    """Fields of the messages by name, null where a message doesn't say one."""
    p, n = Payloads(payloads), len(payloads)
    out: dict[str, pa.Array] = {}

    def column(kind, places: list[tuple], read) -> pa.Array:
        values, known = np.zeros(n, dtype=kind), np.zeros(n, dtype=bool)
        for types, start, length, *more in places:
            rows = p.having(types, start, length)
            values[rows], known[rows] = read(rows, start, length, *more), True
        return pa.array(values, mask=~known)

    part = {k: rows[p.unsigned(rows, 38, 2) == k] for rows in [np.flatnonzero((p.type == 24) & (p.bits >= 160))] for k in (0, 1)}
    out["msgtype"] = pa.array(p.type.astype(np.int32), mask=p.type < 0)
    out["mmsi"] = pa.array(p.unsigned(np.arange(n), 8, 30).astype(np.int32), mask=p.type < 0)
    for name, places in NUMBERS.items():
        out[name] = column(np.int32, places, p.unsigned)
    for name, places in POSITIONS.items():
        at = column(np.float64, places, lambda rows, start, length, parts: p.signed(rows, start, length) / float(parts))
        none = NO_LAT if name == "lat" else NO_LON
        out[name] = pc.if_else(pc.equal(at, none), None, at)
    out["imo"] = pc.if_else(pc.greater(out["imo"], 0), out["imo"], None)
    for name, places in TEXTS.items():
        found: list[str | None] = [None] * n
        for rows, start, length in [*((p.having(*x), *x[1:]) for x in places), *([(part[0], *PART_NAME)] if name == "name" else [(part[1], *PART_CALLSIGN)])]:
            for row, said in zip(rows.tolist(), p.text(rows, start, length)):
                found[row] = said
        out[name] = pa.array(found, pa.string())
    kinds = np.asarray(out["shiptype"].fill_null(0)).copy()
    known = np.asarray(out["shiptype"].is_valid()).copy()
    kinds[part[1]], known[part[1]] = p.unsigned(part[1], *PART_TYPE), True
    out["shiptype"] = pa.array(kinds, mask=~known)
    return out


_SAID = [f for f in PACKET if f.name in {"mmsi", "msgtype", "lat", "lon", *NUMBERS, *TEXTS}]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, own = [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            new = messages(text or "")
            found += new
            own += [k] * len(new)
        for i in range(0, max(1, len(found)), 1 << 14):
            part, rows = found[i : i + (1 << 14)], pa.array(own[i : i + (1 << 14)], pa.int64())
            said = decoded([m[1] for m in part])
            columns = [batch.column(0).take(rows), batch.column(2).take(rows), pa.array([m[0] for m in part], pa.string()), *(said[f.name] for f in _SAID)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "src_id", "aisdata", *(f.name for f in _SAID)])


def packets_of(lines: DataFrame, source_type: str | None = None) -> DataFrame:
    """Packets of ``(path, text, src_id)``, with ``path``: a tag line belongs to the sentence after it, and sentences of one
    message are one packet with the tag of its first.

    The tag gives time, country (its number), region and base station; without one, the time may stand in a comment block
    in front of the sentence (``c:`` and seconds or milliseconds since the epoch, between backslashes). ``source_type`` is what the caller knows of the
    source. Position reports give position, speed, course, heading and status; static reports (types 5, 19 and 24) give
    IMO number, name, call sign and ship type. A payload that can't be read, or is too short for a field, leaves it null,
    and a packet without a tag has no time. Messages are decoded by Arrow batches, a field of all rows of a type at once.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _SAID)
    tagged = lines.select("path", "text", "src_id").mapInArrow(_read, f"path string, src_id string, aisdata string, {kinds}")
    tag = F.split(F.regexp_extract("aisdata", r"\$PGHP,([^\r\n]*)", 1), ",")
    rows = tagged.withColumn("_tag", tag)
    part = lambda i: F.nullif(F.try_element_at("_tag", F.lit(i)), F.lit(""))
    number = lambda i: part(i).try_cast("int")
    when = F.try_make_timestamp(number(2), number(3), number(4), number(5), number(6), number(7).cast("decimal(8,6)"))
    noted = F.regexp_extract("aisdata", r"^\\[^\\]*?\bc:(\d{1,13})\b", 1)
    noted_ms = noted.try_cast("long") * F.when(F.length(noted) > 10, 1).otherwise(1000)
    told = {
        "time_ms": F.coalesce(F.unix_millis(when) + F.coalesce(number(8), F.lit(0)), noted_ms), "digest": F.md5("aisdata"), "source_id": F.col("src_id"),
        "source_type": F.lit(source_type).cast("string"), "source_country": part(9), "region": part(10), "base_station": part(11),
    }
    return rows.select("path", *[told.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PACKET])


def decodable(packets: DataFrame) -> DataFrame:
    """Packets whose message could be read."""
    return packets.where("msgtype is not null")
