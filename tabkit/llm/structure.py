"""Conversation structure repair by a shortest path whose weights are single big integers.

Roles must read ``(s?(ua)+)?``: nothing, or an optional system turn and then user and assistant in turn. Each row is
kept (K), given the role that is due (R), or deleted (D), and rows without text may be inserted anywhere (I). The
graph has a layer per row and four nodes per layer: nothing so far, after the system turn, after a user, after an
assistant. The weight of a path is one integer: its cost in the high digits, below them the letters of its edits, one
digit of three bits per position, first letter highest, and zeros after the last one. The smaller integer is the
cheaper path, and among equally cheap ones that with the ASCII-least audit, so an ordinary minimum per node decides
everything, and the digits of the last minimum say which edits to make. Paths grow from the end: a row in front of a
path shifts the digits by one place, and the positions of a path depend on nothing before it.

Rows are range-partitioned and sorted by conversation, turn, role and text, so each task streams its rows and holds
one conversation of at most ``segment`` rows. A conversation that is longer, or that may reach into a neighbouring
task, is cut into segments. A segment yields the lightest path for every pair of nodes at its two ends. Such paths
end with a row's own letter, so of two with one beginning neither is the start of the other: costs and ranks are
enough to choose among segments, which one small row per segment does, and texts stay where they are. Only the digest
of a whole conversation, if asked for, streams its texts through one task.

Faults: a row is blank without a character but ASCII white space, else a duplicate if role and text stand in an
earlier row, else truncated if its last such character is none of ``.!?``. Blank and duplicate rows must go;
truncated ones that stay cost more.

Defined cases: a null role or text is one space. Rows without a turn come first; equal turns are ordered by role and
text. Rows without a conversation id are one conversation. Only roles that begin with s, u or a can be kept. Rows
that are repeated are rows of their own, the later ones duplicates. An empty table gives none; a conversation without
rows has no report. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import arrow_schema, stored

SEGMENT = 1024
#: Bytes of text in a segment; a longer row is a segment of its own.
SEGMENT_BYTES = 4_000_000

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Digits in ASCII order of the letters.
D, I, K, R = 1, 2, 3, 4
LETTERS = str.maketrans("1234", "DIKR")
DIGIT = 3

#: Nodes of a layer; the node that the role due leads to, and that role.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row leads, by its initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What is inserted at the end to close a path.
CLOSING = ("", "II", "I", "")

WELL, BLANK, DUPLICATE, CUT = range(4)
SPACE = " \t\n\x0b\x0c\r"


class Weights:
    """Integers with room for the letters of ``rows`` rows: two insertions before each, its own, and two at the end."""

    def __init__(self, rows: int) -> None:
        self.width = 3 * rows + 2
        self.bits = DIGIT * self.width
        self.mask = (1 << self.bits) - 1
        self.top = [letter << (self.bits - DIGIT) for letter in range(5)]
        self.none = 1 << (self.bits + 60)

    def ahead(self, path: int, letter: int, cost: int) -> int:
        """A path with one more edit in front."""
        letters = path & self.mask
        return path - letters + (cost << self.bits) + self.top[letter] + (letters >> DIGIT)

    def closing(self, node: int) -> int:
        path = 0
        for _ in CLOSING[node]:
            path = self.ahead(path, I, INSERT)
        return path

    def cost(self, path: int) -> int:
        return path >> self.bits

    def audit(self, path: int) -> str:
        return f"{path & self.mask:0{self.width}o}".rstrip("0").translate(LETTERS)

    def lightest(self, rows: list[tuple[str, int]], ends: list[int]) -> list[int]:
        """The lightest path from each first node, given the weights behind the last layer."""
        ahead = self.ahead
        for initial, fault in reversed(rows):
            kept, more = KEPT.get(initial, {}), TRUNCATED if fault == CUT else 0
            own = []
            for node in range(4):
                path = ahead(ends[node], D, DELETE)
                if fault in (WELL, CUT):
                    path = min(path, ahead(ends[DUE[node]], R, REROLE + more))
                    if node in kept:
                        path = min(path, ahead(ends[kept[node]], K, more))
                own.append(path)
            once = [ahead(own[DUE[node]], I, INSERT) for node in range(4)]
            ends = [min(own[node], once[node], ahead(once[DUE[node]], I, INSERT)) for node in range(4)]
        return ends


def replayed(rows: list[tuple], audit: str, node: int = START) -> list[tuple[str, str]]:
    """The repaired (role, text) rows that the edits of an audit make of (turn, role, text) rows."""
    made, waiting = [], iter(rows)
    for letter in audit:
        if letter == "I":
            node = DUE[node]
            made.append((ROLE[node], ""))
            continue
        _, role, text = next(waiting)
        if letter == "K":
            node = KEPT[role[:1]][node]
            made.append((role, text))
        elif letter == "R":
            node = DUE[node]
            made.append((ROLE[node], text))
    return made


def fault(text: str, duplicate: bool) -> int:
    solid = text.rstrip(SPACE)
    return BLANK if not solid else DUPLICATE if duplicate else WELL if solid[-1] in ".!?" else CUT


def facts(rows: list[tuple], faults: list[int]) -> dict:
    """What a stretch of rows adds to its conversation's report."""
    turns = [turn for turn, _, _ in rows if turn is not None]
    initials = [role[:1] for _, role, _ in rows]
    return {
        "n_rows": len(rows), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
        "first": initials[0], "last": initials[-1], "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
    }


def merged(a: dict, b: dict) -> dict:
    """The facts of two neighbouring stretches, the first with the lower turns."""
    meet = a["high"] is not None and a["high"] == b["low"]
    out = {name: a[name] + b[name] for name in ("n_rows", "illegal", "blank", "duplicate", "truncated")}
    out["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    return out | {
        "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
        "turns": a["turns"] + b["turns"] - meet, "first": a["first"], "last": b["last"],
    }


def report(found: dict, cost: int, audit: str) -> dict:
    """The columns of a conversation's report."""
    gaps = 0 if found["low"] is None else found["high"] - found["low"] + 1 - found["turns"]
    return {"gaps": gaps, "cost": cost, "audit": audit} | {n: found[n] for n in ("n_rows", "blank", "duplicate", "truncated", "illegal")}


FACTS = "n_rows long, low long, high long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long"
REPORT = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "array<struct<turn: long, role: string, text: string>>"


def _segments(batches: Iterator[pa.RecordBatch], limit: int, limit_bytes: int) -> Iterator[tuple]:
    """(conversation, task, number, whole, rows): sorted rows as stretches; ``whole`` where a conversation begins and
    ends inside the task in one stretch."""
    held, size, conversation, task, number, begun = [], 0, None, 0, 0, False
    first = True  # whether the stretch belongs to the task's first conversation
    for batch in batches:
        names = ("conv_id", "turn", "role", "text", "task")
        for conv, turn, role, text, at in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            if held and conv != conversation:
                yield conversation, task, number, not first and not begun, held
                held, size, number, begun, first = [], 0, number + 1, False, False
            elif held and (len(held) >= limit or size + len(text) > limit_bytes):
                yield conversation, task, number, False, held
                held, size, number, begun = [], 0, number + 1, True
            conversation, task = conv, at
            held.append((turn, role, text))
            size += len(text)
    if held:
        yield conversation, task, number, False, held


def _solved(rows: list[tuple]) -> tuple[dict, list]:
    """The report and the repaired rows of a whole conversation."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append(fault(text, (role, text) in seen))
        seen.add((role, text))
    weights = Weights(len(rows))
    path = weights.lightest([(role[:1], f) for (_, role, _), f in zip(rows, faults, strict=True)], [weights.closing(n) for n in range(4)])[START]
    audit = weights.audit(path)
    return report(facts(rows, faults), weights.cost(path), audit), replayed(rows, audit)


def _turns(rows: list[tuple]) -> list[dict]:
    return [{"turn": turn, "role": role, "text": text} for turn, role, text in rows]


def _stretches(sorted_rows: DataFrame, limit: int, limit_bytes: int) -> DataFrame:
    """Whole conversations with report and repaired rows; of others, every stretch with its rows as they are."""
    key = sorted_rows.schema["conv_id"]
    schema = T.StructType([key, *T._parse_datatype_string(f"task int, number long, whole boolean, report struct<{REPORT.replace(' ', ': ').replace(',:', ',')}>, rows {TURNS}").fields])
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conversation, task, number, whole, rows in _segments(batches, limit, limit_bytes):
            told, made = _solved(rows) if whole else (None, _turns(rows))
            made = [{"turn": None, "role": role, "text": text} for role, text in made] if whole else made
            out.append({"conv_id": conversation, "task": task, "number": number, "whole": whole, "report": told, "rows": made})
            size += len(rows)
            if size >= 4 * limit:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return sorted_rows.mapInArrow(run, schema)


def _marked(parts: DataFrame) -> DataFrame:
    """Stretches with ``duplicates``, the places of rows that an earlier row of the conversation equals."""
    rows = parts.select("conv_id", "task", "number", F.posexplode("rows").alias("at", "r"))
    same = F.sha2(F.concat(F.length("r.role").cast("string"), F.lit(":"), F.col("r.role"), F.col("r.text")), 256)
    keyed = stored(rows.select("conv_id", "task", "number", "at", same.alias("same")), "structure-keys")
    place = F.struct("task", "number", "at")
    firsts = keyed.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeats = keyed.join(firsts, keyed["conv_id"].eqNullSafe(firsts["c"]) & (keyed["same"] == firsts["s"])).filter(place > F.col("first"))
    places = repeats.groupBy(F.col("task").alias("t"), F.col("number").alias("k")).agg(F.collect_list("at").alias("duplicates"))
    return parts.join(places, (parts["task"] == places["t"]) & (parts["number"] == places["k"]), "left").drop("t", "k")


def _ways(marked: DataFrame) -> DataFrame:
    """Stretches with their facts, and for each pair of nodes (16) the cost of the lightest way (null: none), its
    audit, and the rank of that audit among those from the same node."""
    schema = T.StructType([*marked.drop("duplicates").schema.fields, *T._parse_datatype_string(f"{FACTS}, costs array<long>, ranks array<int>, audits array<string>").fields])
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                gone = set(row.pop("duplicates") or [])
                rows = [(r["turn"], r["role"], r["text"]) for r in row["rows"]]
                faults = [fault(text, at in gone) for at, (_, _, text) in enumerate(rows)]
                weights = Weights(len(rows))
                steps = [(role[:1], f) for (_, role, _), f in zip(rows, faults, strict=True)]
                paths = [weights.lightest(steps, [0 if n == end else weights.none for n in range(4)]) for end in range(4)]
                ways = [[paths[end][node] for end in range(4)] for node in range(4)]
                open_ = [[w < weights.none for w in from_node] for from_node in ways]
                audits = [[weights.audit(w) if o else None for w, o in zip(*x, strict=True)] for x in zip(ways, open_, strict=True)]
                order = [sorted({a for a in from_node if a is not None}) for from_node in audits]
                row |= facts(rows, faults)
                row["costs"] = [weights.cost(w) if o else None for x in zip(ways, open_, strict=True) for w, o in zip(*x, strict=True)]
                row["ranks"] = [order[n].index(a) if a is not None else None for n in range(4) for a in audits[n]]
                row["audits"] = [a for from_node in audits for a in from_node]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return marked.mapInArrow(run, schema)


CHOSEN = "start int, end int, closing string, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _choose(group: pa.Table, types: pa.Schema) -> pa.Table:
    """The nodes at both ends of each stretch on the conversation's lightest path; costs and ranks decide."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["task"], r["number"]))
    behind, choices = [INSERT * len(letters) for letters in CLOSING], []
    for row in reversed(rows):
        costs, ranks = row["costs"], row["ranks"]
        best = []
        for node in range(4):
            ways = [(costs[at] + behind[end], ranks[at], end) for end, at in enumerate(range(4 * node, 4 * node + 4)) if costs[at] is not None]
            best.append(min(ways))
        behind = [cost for cost, _, _ in best]
        choices.append([end for _, _, end in best])
    told = report(reduce(merged, rows), behind[START], "")
    del told["audit"]
    node, out = START, []
    for row, choice in zip(rows, reversed(choices), strict=True):
        end = choice[node]
        out.append({"conv_id": row["conv_id"], "task": row["task"], "number": row["number"], "start": node, "end": end, "closing": ""} | told)
        node = end
    out[-1]["closing"] = CLOSING[node]
    return pa.Table.from_pylist(out, schema=types)


def _replay(chosen: DataFrame) -> DataFrame:
    """Each stretch with the audit that was chosen for it, and its repaired rows."""
    keep = ["conv_id", "task", "number", "n_all", "gaps", "blanks", "duplicates", "truncateds", "illegals", "cost"]
    narrow = chosen.select(*keep, "rows", "start", "end", "closing", F.element_at("audits", F.col("start") * 4 + F.col("end") + 1).alias("own"))
    schema = T.StructType([*narrow.select(*keep).schema.fields, *T._parse_datatype_string(f"audit string, rows {TURNS}").fields])
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows = [(r["turn"], r["role"], r["text"]) for r in row["rows"]]
                made = replayed(rows, row["own"], row["start"])
                node = row["end"]
                for _ in row["closing"]:
                    node = DUE[node]
                    made.append((ROLE[node], ""))
                out.append({k: row[k] for k in keep} | {"audit": row["own"] + row["closing"], "rows": [{"turn": None, "role": r, "text": t} for r, t in made]})
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return narrow.mapInArrow(run, schema)


@dataclass
class Repaired:
    """``reports``: one row per conversation; ``pieces``: (conv_id, task, number, n_pieces, rows), the repaired rows
    of each conversation in bounded pieces, in the order of task and number."""

    reports: DataFrame
    pieces: DataFrame


def repair(
    df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    segment: int = SEGMENT, segment_bytes: int = SEGMENT_BYTES,
) -> Repaired:
    """Repair every conversation at the least cost. ``reports`` has conv_id, n_rows, gaps (turn numbers that are
    missing between the lowest and the highest), blank, duplicate, truncated, illegal (neighbouring roles that cannot
    follow one another), cost and audit."""
    space = F.lit(" ")
    rows = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
    )
    # the head of a text orders as the text does, and is enough to part a crowd of equal turns
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 40)).withColumn("task", F.spark_partition_id())
    made = stored(_stretches(ranged.sortWithinPartitions("conv_id", "turn", "role", "text"), segment, segment_bytes), "structure")
    names = [f.split()[0] for f in REPORT.split(", ")]
    whole = made.filter("whole")
    ways = stored(_ways(_marked(made.filter("NOT whole").drop("whole", "report"))), "structure-ways")
    picked = T.StructType([made.schema["conv_id"], *T._parse_datatype_string(f"task int, number long, {CHOSEN}").fields])
    types = arrow_schema(picked)
    facts_of = [f.split()[0] for f in FACTS.split(", ")]
    narrow = ways.select("conv_id", "task", "number", *facts_of, "costs", "ranks")
    choice = narrow.groupBy("conv_id").applyInArrow(lambda group: _choose(group, types), picked).select(
        F.col("task").alias("t"), F.col("number").alias("k"), "start", "end", "closing", F.col("n_rows").alias("n_all"), "gaps", F.col("blank").alias("blanks"),
        F.col("duplicate").alias("duplicates"), F.col("truncated").alias("truncateds"), F.col("illegal").alias("illegals"), "cost",
    )
    held = ways.select("conv_id", "task", "number", "rows", "audits")
    cut = stored(_replay(held.join(choice, (held["task"] == choice["t"]) & (held["number"] == choice["k"]))), "structure-cut")
    in_order = F.sort_array(F.collect_list(F.struct("task", "number", "audit")))
    told = cut.groupBy("conv_id").agg(
        *[F.first(c).alias(n) for c, n in (
            ("n_all", "n_rows"), ("gaps", "gaps"), ("blanks", "blank"), ("duplicates", "duplicate"), ("truncateds", "truncated"), ("illegals", "illegal"), ("cost", "cost"),
        )],
        F.array_join(F.transform(in_order, lambda x: x["audit"]), "").alias("audit"), F.count("*").alias("n_pieces"),
    )
    reports = whole.select("conv_id", "report.*").select("conv_id", *names).union(told.select("conv_id", *names))
    counts = told.select(F.col("conv_id").alias("c"), "n_pieces")
    parts = cut.join(counts, cut["conv_id"].eqNullSafe(counts["c"])).select("conv_id", "task", "number", "n_pieces", "rows")
    return Repaired(reports, whole.select("conv_id", "task", "number", F.lit(1).cast("long").alias("n_pieces"), "rows").union(parts))


def lines(rows: Column) -> Column:
    """Repaired rows as ``role:text`` lines; null where there is none."""
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the SHA-256 of each conversation's repaired lines, joined by line breaks. That of a
    conversation in several pieces is fed piece by piece."""
    one = pieces.filter("n_pieces = 1").select("conv_id", F.sha2(F.coalesce(lines(F.col("rows")), F.lit("")), 256).alias("repaired_sha256"))
    many = pieces.filter("n_pieces > 1").select("conv_id", "task", "number", lines(F.col("rows")).alias("lines"))
    types = arrow_schema(one.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, conversation, any_line, begun = hashlib.sha256(), None, False, False
        for batch in batches:
            done = []
            for conv, made in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if begun and conv != conversation:
                    done.append({"conv_id": conversation, "repaired_sha256": sha.hexdigest()})
                    sha, any_line = hashlib.sha256(), False
                conversation, begun = conv, True
                if made is not None:
                    sha.update(b"\n" * any_line + made.encode())
                    any_line = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=types)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": conversation, "repaired_sha256": sha.hexdigest()}], schema=types)

    streamed = many.repartition("conv_id").sortWithinPartitions("conv_id", "task", "number")
    return one.union(streamed.mapInArrow(run, one.schema))
