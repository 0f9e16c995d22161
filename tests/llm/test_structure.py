"""Conversation repair against a search through every sequence of edits."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from tabkit.llm import queries, structure

SPACE = " \t\n\x0b\x0c\r"
RULE = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(SPACE)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


@functools.lru_cache(maxsize=None)
def brute(rows):
    """(cost, audit, repaired lines): the least of all edits with at most two insertions in a row. What is new must be
    an assistant after a user and a user elsewhere, or the roles cannot fit the rule."""
    faults, best = faults_of(rows), None
    steps = [["D"] if f in ("blank", "duplicate") else ["D", "K", "R"] for f in faults]
    for way in itertools.product(*[[i + s for i in ("", "I", "II") for s in step] for step in steps], ("", "I", "II")):
        audit, at, cost, made = "".join(way), 0, 0, []
        for letter in audit:
            due = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if letter == "I":
                made.append((due, ""))
                cost += 3
                continue
            _, role, text = rows[at]
            cost += {"D": 4, "K": 0, "R": 3}[letter] + (3 if letter != "D" and faults[at] == "truncated" else 0)
            if letter != "D":
                made.append((role if letter == "K" else due, text))
            at += 1
        if all(m[0] for m in made) and RULE.fullmatch("".join(m[0][:1] for m in made)) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, "\n".join(map(":".join, made))
    return best


def plain(rows):
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, turns = faults_of(rows), [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, lines = brute(tuple(rows))
    return (len(rows), gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())


def conversations(seed=3, n=50):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "a"], ["Yes.", "no", "", " \t", None, "Why?", "ok!", "end. ", "Ü"]
    out = {i: [(rnd.choice([None, *range(5)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(rnd.randint(1, 4))] for i in range(n)}
    out[None] = [(0, "user", "Who?"), (0, "user", "Who?"), (7, "assistant", "me")]
    out[n] = [(2, "system", "Be kind.")]
    return out


@pytest.mark.parametrize(("segment", "size"), [(1, 4_000_000), (2, 4_000_000), (1024, 4_000_000), (1024, 5)])
def test_equals_search_through_all_edits(spark, segment, size):
    cases = conversations()
    rows = [(conv, *row, "x") for conv, given in cases.items() for row in given]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string")
    made = structure.repair(df, segment=segment, segment_bytes=size)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in structure.digests(made.pieces).collect()}
    names = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    got = {r["conv_id"]: (*[r[n] for n in names], hashes[r["conv_id"]]) for r in made.reports.collect()}
    assert got == {conv: plain(given) for conv, given in cases.items()}


def test_long_conversation_is_cut_and_stays_exact(spark):
    rnd = random.Random(5)
    rows = [(1, t, rnd.choice(["user", "assistant", "user", "assistant", "system"]), rnd.choice([f"t{t}.", f"t{t}", "again.", ""])) for t in range(700)]
    df = spark.createDataFrame(rows + [(2, 0, "user", "x" * 300_000 + "."), (2, 1, "assistant", "y.")], "conv_id long, turn long, role string, text string")
    one, many = structure.repair(df), structure.repair(df, segment=16)
    assert many.pieces.filter("conv_id = 1").count() >= 44
    assert {tuple(r) for r in one.reports.collect()} == {tuple(r) for r in many.reports.collect()}
    assert {tuple(r) for r in structure.digests(one.pieces).collect()} == {tuple(r) for r in structure.digests(many.pieces).collect()}


def test_weights_are_one_integer():
    weights = structure.Weights(3)
    keep = weights.ahead(weights.ahead(0, structure.K, 0), structure.K, 0)
    drop = weights.ahead(weights.ahead(0, structure.K, 0), structure.D, 0)
    longer = weights.ahead(weights.ahead(weights.ahead(0, structure.I, 0), structure.K, 0), structure.K, 0)
    dear = weights.ahead(0, structure.D, 1)
    assert drop < keep < longer < dear
    assert [weights.audit(w) for w in (drop, keep, longer, dear)] == ["DK", "KK", "KKI", "D"]


def test_empty_table(spark):
    made = structure.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert made.reports.count() == 0 and structure.digests(made.pieces).count() == 0


def test_query_returns_every_conversation(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "gone."), (None, None, None, None), (5, None, "user", "Hi.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in queries.op12_structure(spark, str(tmp_path)).collect()}
    assert set(found) == {lost, None, 5}
    assert (found[lost]["cost"], found[lost]["audit"], found[lost]["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    turns = spark.createDataFrame([(c, t, "assistant", "a. b! c?") for c in range(40) for t in range(5)], "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in queries._damaged(turns).collect())
    expected = []
    for c in range(40):
        for t in range(5):
            kind = zlib.crc32(f"{c}:{t}".encode()) % 20
            row = (c, t, "user" if kind == 4 else "assistant", "" if kind == 1 else "a b c" if kind == 2 else "a. b! c?")
            expected += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(expected)
