"""Hard negatives, conversation repair and repeated byte strings against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.llm import conversations, hardnegatives, queries, suffixes

# Hard negatives: the query itself is compared with SQL in tests/test_oracles.py.


def test_intervals_hold_the_score_and_cut_most_rows():
    draw = np.random.default_rng(4)
    rows = np.floor(256 * draw.standard_normal((500, 64)))
    rows[:5] = 0
    codes, facts = hardnegatives.encoded(rows)
    for x in (rows[7], rows[0], rows[20] * 50):
        low, high = hardnegatives.Anchor(x).intervals(codes, facts)
        assert ((low <= rows @ x) & (rows @ x <= high)).all()
    low, high = hardnegatives.Anchor(rows[7]).intervals(codes, facts)
    assert (high >= np.sort(low)[-1]).sum() < 50  # only what may beat the row itself


def plain_negatives(rows, anchors, positives, negatives):
    """Rows are (id, label, vector of integers)."""
    out, first = [], {}
    for r in sorted(x for x in rows if anchors(x[0])):
        first.setdefault(r[0], r)
    for a, label, vector in first.values():
        scored = sorted((-sum(p * q for p, q in zip(vector, v)), i, lab) for i, lab, v in rows if i != a)
        for score, pos, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(s, i) for s, i, lab in scored if lab != label and 50 * -score <= 100 * -s <= 95 * -score][:negatives]
            out += [(a, pos, k + 1, i, -score, -s) for k, (s, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block, chunk", [(2048, 4096), (2, 7)])
def test_negatives_match_brute_force(spark, block, chunk):
    draw = random.Random(8)
    rows = [(i, draw.randrange(3), [draw.randrange(-4, 9) for _ in range(5)]) for i in range(60)]
    rows += [(60 + k, k % 3, rows[5][2]) for k in range(12)]
    frame = spark.createDataFrame([(i, lab, [x / 256 for x in v]) for i, lab, v in rows], "vec_id long, label int, embedding array<double>")
    got = hardnegatives.mine(frame, F.col("vec_id") % 4 == 0, block=block, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 4 == 0, 5, 3)


def test_negatives_awkward(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 2, [0.75, 0.5]), (2, 2, [0.75, 0.5]), (3, 2, [0.5, None]), (4, None, [0.9, 0.0]), (5, 2, None), (None, 2, [0.8, 0.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 0.0]), (8, 3, []), (0, 1, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, label int, embedding array<double>, code string, slot int, place string")
    got = sorted(map(tuple, hardnegatives.mine(frame, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 2, 65536, 49152)]
    assert hardnegatives.mine(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert hardnegatives.mine(frame, F.lit(None).cast("boolean")).count() == 0


# Conversations.


def cheapest(rows):
    """(cost, audit) by trying, row after row, every edit from every state; rows are (role initial, fault)."""

    def put(ways, state, way):
        if state not in ways or way < ways[state]:
            ways[state] = way

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit) in list(ways.items()):
                put(ways, conversations.NEXT[state][1], (cost + 3, audit + "I"))
        return ways

    ways = {0: (0, "")}
    for initial, fault in rows:
        following = {}
        for state, (cost, audit) in inserted(ways).items():
            put(following, state, (cost + 4, audit + "D"))
            if fault == 2:
                continue
            name, to = conversations.NEXT[state]
            put(following, to, (cost + 3 + 3 * fault, audit + "R"))
            if initial == name[0]:
                put(following, to, (cost + 3 * fault, audit + "K"))
            if initial == "s" and state == 0:
                put(following, 1, (cost + 3 * fault, audit + "K"))
        ways = following
    return min(way for state, way in inserted(ways).items() if state in (0, 3))


def exhaustive(rows):
    """(cost, audit) over all edits with up to two inserts at each place, by the pattern itself."""
    inserts = [("", 0, ""), *(("I", 3, x) for x in "ua"), *(("II", 6, x + y) for x in "ua" for y in "ua")]
    edits = [[("D", 4, "")] + ([] if fault == 2 else [("K", 3 * fault, r), ("R", 3 + 3 * fault, "u"), ("R", 3 + 3 * fault, "a")]) for r, fault in rows]
    found = []
    for chosen in itertools.product(*edits):
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            steps = [more[0], *(x for pair in zip(chosen, more[1:]) for x in pair)]
            if re.fullmatch("(s?(ua)+)?", "".join(x[2] for x in steps)):
                found.append((sum(x[1] for x in steps), "".join(x[0] for x in steps)))
    return min(found)


ROLES = {"s": "system", "u": "user", "a": "assistant", " ": " "}


@pytest.mark.parametrize("segment", [1, 3, 8])
def test_search_is_optimal(monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    draw = random.Random(segment)
    for n in [1, 2, 3] * 6 + [5, 8, 20, 70] * 60:
        rows = [(draw.choice("suuuaaa "), draw.choice([0, 0, 0, 1, 2])) for _ in range(n)]
        if n <= 3 and segment == 3:
            assert cheapest(rows) == exhaustive(rows)
        made = []
        repair = conversations.Repair(lambda role, text: made.append((role, text)))
        for k, (initial, fault) in enumerate(rows):
            repair.add(k, ROLES[initial], (f"t{k}.", f"t{k}", " ")[fault], False)
        said = repair.end()
        assert (said["cost"], said["audit"]) == cheapest(rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))


def plain_repair(rows):
    """The whole contract for one conversation of (turn, role, text) after damage, in order."""
    said, faults, seen = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, [], set()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            said[fault] += 1
    said["illegal"] = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    said["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest([(r[1][:1], {None: 0, "truncated": 1}.get(f, 2)) for r, f in zip(rows, faults)])
    out, left, last = [], iter(rows), ""
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter != "D":
            role = row[1] if letter == "K" else "assistant" if last == "u" else "user"
            out.append(f"{role}:{row[2] if row else ''}")
            last = role[0]
    return (*said.values(), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_op12(rows):
    convs = {r[0] for r in rows}
    left = sorted(plain_damage(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    return sorted(((c, *plain_repair([r[1:] for r in left if r[0] == c])) for c in convs), key=str)


def test_conversation_query_matches_brute_force(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").collect()]
    assert sorted(map(tuple, queries.op12_conversation_repair(spark, tiny).collect()), key=str) == plain_op12(rows)


def test_conversations_awkward(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i % 40, draw.choice([None, *range(8)]), draw.choice(["system", "user", "assistant", None, "", "other"]), draw.choice(["Yes.", "No", "", None, "  \t", "Why?\n", "x" * 50_000 + "!"])) for i in range(300)]
    rows += [(None, 1, "user", "hello."), (None, None, None, None), (77, None, None, None), *[(78, 3, "user", "again.")] * 30]
    rows += [(79, k, "user" if k % 2 else "assistant", f"{k % 50}.") for k in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seen", "'x' AS dropped", "2 AS _kind").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, queries.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str) == plain_op12(rows)
    frame = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    assert conversations.repair_summary(frame.limit(0)).count() == 0
    whole = conversations.repaired_turns(frame.where("conv_id = 79")).orderBy("turn").collect()
    assert [r["turn"] for r in whole] == list(range(len(whole))) and re.fullmatch("(ua)+", "".join(r["role"][0] for r in whole))


# Repeated byte strings.


def plain_spans(rows, length):
    raws = [(text or "").encode() for _, text in rows]
    times = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if times[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((str(doc), len(raw), [m.span() for m in re.finditer(b"\1+", gone)], kept))
    return sorted(out)


def spans_of(frame, length):
    found = suffixes.drop_repeated_bytes(frame, length).collect()
    return sorted((str(r["doc_id"]), r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in found)


@pytest.mark.parametrize("length", [20, 53, 400])
def test_repeated_bytes_match_brute_force(spark, length):
    """Passages of about the length cut at random places, in texts of few letters; periods, one letter, nulls, copies, repeated rows."""
    draw, rows = random.Random(length), []
    base = ["".join(draw.choice("abcd é") for _ in range(draw.randrange(length // 2, 6 * length))) for _ in range(12)]
    for k in range(60):
        text = "".join(draw.choice("abcdefgh ij") for _ in range(draw.randrange(length)))
        for _ in range(draw.randrange(4)):
            whole, start = (b := draw.choice(base)), draw.randrange(len(b))
            text += whole[start : start + draw.choice([length - 2, length - 1, length, length + 1, length + 5, 2 * length, 4 * length])] + "".join(draw.choice("klm") for _ in range(draw.randrange(9)))
        rows.append((k if k % 13 else None, text if k % 17 else None))
    rows += [rows[3], (99, "a" * (3 * length)), (98, "ab" * (2 * length)), (97, "ab" * length + "c" * (length - 1)), (96, "")]
    assert spans_of(spark.createDataFrame(rows, "doc_id long, text string"), length) == plain_spans(rows, length)


def test_suffix_query_matches_brute_force(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((int(d), n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in plain_spans(rows, 400))
    assert any(w[2] for w in want)
    assert sorted(map(tuple, queries.op13_suffix_dedup(spark, tiny).collect())) == want


def test_repeated_bytes_awkward(spark):
    long = "".join(chr(97 + zlib.crc32(b"%d" % i) % 26) for i in range(2_500_000))
    rows = [(1, long), (2, "x" + long[1_048_000:1_049_500]), (None, None), (3, ""), (3, ""), (4, "short")]
    frame = spark.createDataFrame([(*r, "own", 5, "z") for r in rows], "doc_id long, text string, spans string, loc int, rank string")
    found = {r["doc_id"]: r for r in suffixes.drop_repeated_bytes(frame).collect()}
    assert [tuple(s) for s in found[1]["spans"]] == [(1_048_000, 1_049_500)] and bytes(found[2]["kept"]) == b"x"
    assert found[None]["n_bytes"] == 0 and found[4]["loc"] == 5 and found[4]["rank"] == "z" and bytes(found[4]["kept"]) == b"short"
    assert suffixes.drop_repeated_bytes(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.drop_repeated_bytes(frame, 10)
