"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.vocabulary import MARK, Vocabulary

#: Chunks of text a worker remembers with their ids, in two halves: the older half goes when the newer is full.
#: Only chunks of up to KNOWN_BYTES are remembered, so that both bounds together bound the bytes.
MOST_KNOWN, KNOWN_BYTES = 400_000, 64
#: Chunks of more bytes than this are searched in arrays of numbers, which take 16 bytes a byte of text.
LONG_CHUNK = 1 << 14
#: Chunks of up to ARRAY_BYTES are searched side by side in arrays, SIDE_BY_SIDE of them at once; texts are taken in groups of about GROUP_CHARS.
ARRAY_BYTES, SIDE_BY_SIDE, GROUP_CHARS = 64, 4096, 1 << 20
#: Cells of the double array that are tried at once.
WINDOW = 2048


class DoubleArrayTrie:
    """Byte trie in two arrays: the child of node s by byte b is t = base[s] + b + 1 if check[t] = s.

    Code 0 ends a key; the ending cell's base is -(value + 1).
    """

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 2 * sum(len(k) + 1 for k, _ in keys) + 2 * WINDOW
        base, check, free = np.zeros(size, dtype=np.int64), np.full(size, -1, dtype=np.int64), np.ones(size, dtype=bool)
        check[0], free[0], first_free = 0, False, 1
        level = [(0, 0, len(keys), 0)]  # node, first key, last key, depth
        while level:
            later = []
            for node, a, z, depth in level:
                codes, spans = [], []
                i = a
                while i < z:
                    code = keys[i][0][depth] + 1 if depth < len(keys[i][0]) else 0
                    j = i + 1
                    while j < z and (keys[j][0][depth] + 1 if depth < len(keys[j][0]) else 0) == code:
                        j += 1
                    codes.append(code)
                    spans.append((i, j))
                    i = j
                if not codes:
                    continue
                at = first_free
                while True:
                    # Free cells for the first code, of which those stay where the other codes are free too.
                    fits = np.flatnonzero(free[at : at + WINDOW]) + at
                    if at == first_free and len(fits):
                        first_free = int(fits[0])
                    elif at == first_free:
                        first_free += WINDOW
                    fits = fits[fits > codes[0]] - codes[0]
                    for c in codes[1:]:
                        fits = fits[free[fits + c]]
                    if len(fits):
                        b = int(fits[0])
                        break
                    at += WINDOW
                    if at + 2 * WINDOW > len(free):
                        base, check, free = np.append(base, np.zeros_like(base)), np.append(check, np.full_like(check, -1)), np.append(free, np.ones_like(free))
                base[node] = b
                for c, (i, j) in zip(codes, spans):
                    check[b + c], free[b + c] = node, False
                    if c:
                        later.append((b + c, i, j, depth + 1))
                    else:
                        base[b] = -(keys[j - 1][1] + 1)
            level = later
        end = int(np.flatnonzero(~free)[-1]) + 300
        self.base, self.check = base[:end].tolist(), check[:end].tolist()

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """``(end, value)`` of every key that starts at ``start``, shortest first."""
        base, check, node = self.base, self.check, 0
        for i in range(start, len(text)):
            t = base[node] + text[i] + 1
            if t < 0 or t >= len(check) or check[t] != node:
                return
            node = t
            e = base[node]
            if e >= 0 and check[e] == node and base[e] < 0:
                yield i + 1, -base[e] - 1


class UnigramCodec:
    """Encoder and decoder of one vocabulary.

    Spaces become the white-space mark, with one more in front of a text; a mark in the text itself goes by its
    bytes, so that decoding gives back any text. A character without a piece costs 10 below the lowest score and
    becomes its byte pieces. Of equally good segmentations the one whose last piece begins first wins, from the
    end backwards.

    The scores are taken as log probabilities. A file of merge ranks has none; ``Vocabulary.with_log_shares`` gives it
    some, and then the ids are those of the best segmentation by these shares, which merging step by step as the file's
    own encoder does need not find: the same text comes back from either, in about as many ids.
    """

    def __init__(self, vocabulary: Vocabulary, dummy_prefix: bool = True):
        self.vocabulary, self.dummy_prefix = vocabulary, dummy_prefix
        pieces = vocabulary.pieces
        self.trie = DoubleArrayTrie([(p.encode(), i) for i, p in enumerate(pieces)])
        self.unknown = min(vocabulary.scores, default=0.0) - 10.0
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A piece may hold marks only in front, and no line end: then no piece crosses from one chunk to the next.
        apart = all(MARK not in p.lstrip(MARK) and "\n" not in p for p in pieces)
        self.chunks = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n|" if apart else "(?s).+").findall
        self.table = {i: p.replace(MARK, " ").encode() for i, p in zip(vocabulary.ids, pieces)}
        self.table |= {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        self.arrays = tuple(np.array(x) for x in (self.trie.base, self.trie.check, vocabulary.scores, vocabulary.ids, vocabulary.byte_ids))
        self.no_nul = all("\0" not in p for p in pieces) and len(vocabulary.byte_ids) == 256

    def _side_by_side(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of short chunks as ``_viterbi`` finds them, a start place at a time over an array of chunks; order as given."""
        base, check, scores, ids, byte_ids = self.arrays
        out: list[bytes] = [b""] * len(chunks)
        order = sorted(range(len(chunks)), key=lambda k: len(chunks[k]))
        for a in range(0, len(order), SIDE_BY_SIDE):
            own = order[a : a + SIDE_BY_SIDE]
            n = np.array([len(chunks[k]) for k in own])
            wide = int(n[-1]) + 4
            text = np.frombuffer(b"".join([chunks[k].ljust(wide, b"\0") for k in own]), dtype=np.uint8).reshape(len(own), wide)
            best, begun, chosen = np.full(text.shape, -np.inf), np.zeros(text.shape, dtype=np.int16), np.full(text.shape, -1, dtype=np.int32)
            best[:, 0] = 0.0
            lead = (text & 0xC0) != 0x80
            width = 1 + (text >= 0xC0).astype(np.int8) + (text >= 0xE0) + (text >= 0xF0)

            def offer(rows: np.ndarray, i: int, j, score: np.ndarray, value, best=best, begun=begun, chosen=chosen) -> None:
                better = score > best[rows, j]
                rows, j = rows[better], j[better] if isinstance(j, np.ndarray) else j
                best[rows, j], begun[rows, j] = score[better], i
                chosen[rows, j] = value[better] if isinstance(value, np.ndarray) else value

            for i in range(int(n[-1])):
                rows = np.flatnonzero((n > i) & lead[:, i])
                if not len(rows):
                    continue
                bare = np.ones(len(own), dtype=bool)
                alive, node, j = rows, np.zeros(len(rows), dtype=np.int64), i
                while len(alive):
                    to = base[node] + text[alive, j] + 1
                    ok = check[to] == node
                    alive, node, j = alive[ok], to[ok], j + 1
                    cell = base[node]
                    value = base[cell]
                    hit = (check[cell] == node) & (value < 0)
                    if hit.any():
                        at, piece = alive[hit], -value[hit] - 1
                        bare[at[width[at, i] == j - i]] = False
                        offer(at, i, j, best[at, i] + scores[piece], piece)
                left = rows[bare[rows]]
                if len(left):
                    offer(left, i, i + width[left, i].astype(np.int64), best[left, i] + self.unknown, -1)
            # Back from the ends: each piece's id, or each byte's, stands where it begins.
            found = np.full(text.shape, -1, dtype=np.int32)
            rows, end = np.arange(len(own)), n.copy()
            while len(rows):
                i, value = begun[rows, end].astype(np.int64), chosen[rows, end]
                known = value >= 0
                found[rows[known], i[known]] = ids[value[known]]
                for k in range(4):
                    more = ~known & (i + k < end)
                    found[rows[more], i[more] + k] = byte_ids[text[rows[more], i[more] + k]]
                rows, end = rows[i > 0], i[i > 0]
            held = found >= 0
            flat, stops = found[held].astype("<i4").tobytes(), 4 * np.cumsum(held.sum(axis=1))
            for k, x, y in zip(own, [0, *stops.tolist()], stops.tolist()):
                out[k] = flat[x:y]
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode_bytes`` of each text; what a group of texts has that isn't known is searched together."""
        own: list[str] = []
        held = 0
        for text in texts:
            own.append(text)
            held += len(text)
            if held > GROUP_CHARS:
                yield from self._group(own)
                own, held = [], 0
        yield from self._group(own)

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.newer) > MOST_KNOWN // 2:
            self.newer, self.older = {}, self.newer
        cut = [self.chunks(self._marked(t, True)) if t and MARK not in t else None for t in texts]
        if self.no_nul:
            new, raws = [], []
            for c in set().union(*filter(None, cut)).difference(self.newer):
                known = self.older.get(c)
                if known is not None:
                    self.newer[c] = known
                    continue
                raw = c.encode()
                if len(raw) <= ARRAY_BYTES:
                    new.append(c)
                    raws.append(raw)
            self.newer.update(zip(new, self._side_by_side(raws)))
        return [self._ids(chunks) if chunks is not None else self.encode_bytes(t, turn=False) for t, chunks in zip(texts, cut)]

    def _marked(self, text: str, front: bool) -> str:
        return (MARK if front and self.dummy_prefix else "") + text.replace(" ", MARK)

    def _viterbi(self, chunk: bytes) -> list[int]:
        n, scores, ids = len(chunk), self.vocabulary.scores, self.vocabulary.ids
        base, check = self.trie.base, self.trie.check
        best, begun, chosen = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        if n > LONG_CHUNK:
            best, begun, chosen = array("d", best), array("i", begun), array("i", chosen)
        best[0] = 0.0
        i = 0
        while i < n:
            first = chunk[i]
            single = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            here, bare, node = best[i], True, 0
            for end in range(i + 1, n + 1):  # the same walk as DoubleArrayTrie.prefixes; the arrays have room for any byte
                to = base[node] + chunk[end - 1] + 1
                if check[to] != node:
                    break
                node, cell = to, base[to]
                if check[cell] == node and base[cell] < 0:
                    value = -base[cell] - 1
                    score = here + scores[value]
                    if end == single:
                        bare = False
                    if score > best[end]:
                        best[end], begun[end], chosen[end] = score, i, value
            if bare and here + self.unknown > best[single]:
                best[single], begun[single], chosen[single] = here + self.unknown, i, -1
            i = single
        out: list[int] = []
        while n:
            i, value = begun[n], chosen[n]
            out += [ids[value]] if value >= 0 else [self.vocabulary.byte_ids[b] for b in reversed(chunk[i:n])]
            n = i
        return out[::-1]

    def encode_bytes(self, text: str, turn: bool = True) -> bytes:
        """Little-endian 32-bit ids (array's order of bytes is the machine's: little-endian ones are meant).

        ``turn`` lets the older half of the known chunks go when it is time.
        """
        if not text:
            return b""
        if turn and len(self.newer) > MOST_KNOWN // 2:
            self.newer, self.older = {}, self.newer
        if MARK in text:
            # Parts between marks; each mark goes by its bytes.
            mark = np.array([self.vocabulary.byte_ids[b] for b in MARK.encode()], dtype="<i4").tobytes()
            parts = text.split(MARK)
            return mark.join([self._encoded(p, k == 0) for k, p in enumerate(parts)])
        return self._encoded(text, True)

    def _encoded(self, text: str, front: bool) -> bytes:
        return self._ids(self.chunks(self._marked(text, front)))

    def _ids(self, chunks: list[str]) -> bytes:
        try:
            return b"".join(map(self.newer.__getitem__, chunks))
        except KeyError:
            pass
        known, older, long = self.newer, self.older, {}
        for c in set(chunks):
            if c not in known:
                raw = c.encode()
                (known if len(raw) <= KNOWN_BYTES else long)[c] = older.get(c) or array("i", self._viterbi(raw)).tobytes()
        if long:
            return b"".join([known[c] if c in known else long[c] for c in chunks])
        return b"".join(map(known.__getitem__, chunks))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; byte pieces in a row are read as UTF-8 (else U+FFFD), unknown ids are passed over."""
        table = self.table
        joined = b"".join([table.get(i, b"") for i in ids])
        if self.dummy_prefix and joined[:1] == b" " and ids and self.table.get(ids[0], b"")[:1] == b" ":
            joined = joined[1:]
        return joined.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, n_ids long, round_trip boolean)``: ids of whole texts, and whether decoding gives the text back.

    Null and empty texts have no ids. Repeated rows and rows without an id come back as they stand; other columns
    are ignored. Each worker builds its trie from the broadcast vocabulary once and remembers chunks it has met.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column(1)]
            parts = list(codec.encode_all(texts))
            trips = [codec.decode(np.frombuffer(part, dtype="<i4").tolist()) == text for part, text in zip(parts, texts)]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.diff(ends), pa.int64()), pa.array(trips)], names=["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


_codecs: dict = {}


def codec_of(shared) -> UnigramCodec:
    """A worker's codec for a broadcast vocabulary; the last one stays for the next tasks."""
    vocabulary = shared.value
    if _codecs.get("of") != vocabulary:
        _codecs.update({"of": vocabulary, "codec": UnigramCodec(vocabulary)})
    return _codecs["codec"]


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
