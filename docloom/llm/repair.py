"""Conversation structure repair: cheapest edits by Dial's bucket-queue shortest paths.

A conversation is good if its roles' initials read ``(s?(ua)+)?``. Its rows and the states of that
grammar span a graph: node (i, state) is after i rows, arcs keep, rerole or delete a row or
insert an empty turn, and their costs are small whole numbers, so Dial's queue of a
few buckets finds every node's distance to the end in linear time. Then tight arcs
(those that lie on a cheapest path) are walked from the start, of several the one whose
letter is least, which gives the ASCII-least of the cheapest audits.

Rows are sorted over all conversations by ranges, so a conversation of any length is
spread over tasks. What a task holds whole it repairs at once. A conversation that
reaches over a task's end is solved in segments, one a task: for each pair of states, the cheapest way
through a segment and its least audit; a chain of segments, of which there are no more than
tasks, gives the rest. Only the SHA-256 of a conversation's text, which can't be put together
from parts, is taken by one task that streams its segments in order.

Defined results: null conversations are one group; other nulls are one space; empty
texts are blank; texts of any length are handled row by row; rows of one turn go by role and then the SHA-256 of the text, and rows equal in all these are alike;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.common import staged

#: Costs of edits, and their letters in order.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; ends are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state that an inserted or reroled turn leads to, and those that it may come from.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {START: (), SYSTEM: (), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: Where a kept turn of each initial leads, by the state before.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
GOOD, BLANK, DUPLICATE, CUT = range(4)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
DONE = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
ROW = "part int, place long, turn long, role string, text string, dropped boolean, fault int"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults put in by their key's CRC-32; dropped rows stay, marked ``dropped``."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return own.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def fault_of(text: str, known: bool) -> int:
    kept = text.rstrip(SPACE)
    return BLANK if not kept else DUPLICATE if known else GOOD if kept[-1] in ".!?" else CUT


class Segment:
    """Rows in order (role's initial, fault), and the cheapest ways through them."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.rows = [(initial, fault in (BLANK, DUPLICATE), TRUNCATED * (fault == CUT)) for initial, fault in rows]

    def arcs(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter, cost, rows passed, state) of the edits at a node, by letter."""
        inside = i < len(self.rows)
        if inside:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, FOLLOWS[state]
        if inside:
            initial, must_go, more = self.rows[i]
            if not must_go:
                if (to := KEPT.get(initial, {}).get(state)) is not None:
                    yield "K", KEEP + more, i + 1, to
                yield "R", REROLE + more, i + 1, FOLLOWS[state]

    def distances(self, ends: tuple[int, ...]) -> list[int]:
        """Each node's distance to the nearest of the states ``ends`` after the last row (node i * 4 + state), by a bucket queue from there."""
        n = len(self.rows)
        out: list[int] = [-1] * (4 * (n + 1))
        buckets: list[list[int]] = [[] for _ in range(REROLE + TRUNCATED + 1)]
        buckets[0] = [4 * n + e for e in ends]
        now, waiting = 0, len(ends)
        while waiting:
            bucket = buckets[now % len(buckets)]
            while bucket:
                node = bucket.pop()
                waiting -= 1
                if out[node] >= 0:
                    continue
                out[node] = now
                i, state = divmod(node, 4)
                reached = [(INSERT, 4 * i + s) for s in BEFORE[state]]
                if i:
                    initial, must_go, more = self.rows[i - 1]
                    back = 4 * (i - 1)
                    reached.append((DELETE, back + state))
                    if not must_go:
                        reached += [(KEEP + more, back + s) for s, to in KEPT.get(initial, {}).items() if to == state]
                        reached += [(REROLE + more, back + s) for s in BEFORE[state]]
                for cost, other in reached:
                    if out[other] < 0:
                        buckets[(now + cost) % len(buckets)].append(other)
                        waiting += 1
            now += 1
        return out

    def walk(self, distance: list[int], state: int) -> str:
        """The least letters of the tight arcs from a state before the first row to where the distance is 0 after the last."""
        i, letters = 0, []
        while i < len(self.rows) or distance[4 * i + state]:
            at = distance[4 * i + state]
            for letter, cost, j, to in self.arcs(i, state):
                if 0 <= distance[4 * j + to] == at - cost:
                    letters.append(letter)
                    i, state = j, to
                    break
        return "".join(letters)

    def ways(self) -> list[dict]:
        """For each state before and after: the cheapest edits' cost and least letters."""
        out = []
        for end in range(4):
            distance = self.distances((end,))
            out += [{"first": s, "last": end, "cost": distance[s], "audit": self.walk(distance, s)} for s in range(4) if distance[s] >= 0]
        return out


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """``role:text`` of the turns that edits of (role, text) rows give, from a state on."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            role, text = rows[i]
            state = KEPT[role[:1]][state]
        else:
            state = FOLLOWS[state]
            role, text = ROLE[state], rows[i][1] if letter == "R" else ""
        i += letter != "I"
        out.append(f"{role}:{text}")
    return out


def _measures(rows: list[tuple[int | None, str, int]]) -> dict:
    """Counts of rows (turn, initial, fault) in order that neighbouring segments can be joined by."""
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "rows": len(rows), "least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": sum(a != b for a, b in pairwise(turns)) + bool(turns),
        **{name: sum(f == k for _, _, f in rows) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))},
        "illegal": sum(a + b not in LEGAL for (_, a, _), (_, b, _) in pairwise(rows)), "initial": rows[0][1] if rows else None, "final": rows[-1][1] if rows else None,
    }


def _joined(a: dict, b: dict) -> dict:
    if not a["rows"] or not b["rows"]:
        return a if a["rows"] else b
    least = a["least"] if a["least"] is not None else b["least"]
    most = b["most"] if b["most"] is not None else a["most"]
    return {
        "rows": a["rows"] + b["rows"], "least": least, "most": most, "turns": a["turns"] + b["turns"] - (a["most"] is not None and a["most"] == b["least"]),
        **{k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}, "illegal": a["illegal"] + b["illegal"] + (a["final"] + b["initial"] not in LEGAL), "initial": a["initial"], "final": b["final"],
    }


def _answer(m: dict, cost: int, audit: str, digest: str | None) -> dict:
    gaps = m["most"] - m["least"] + 1 - m["turns"] if m["turns"] else 0
    return {"gaps": gaps, "blank": m["blank"], "duplicate": m["duplicate"], "truncated": m["truncated"], "illegal": m["illegal"], "cost": cost, "audit": audit, "repaired_sha256": digest}


def solved(rows: list[dict]) -> dict:
    """The answer of a whole conversation; rows (turn, role, text, fault) in order."""
    segment = Segment([(r["role"][:1], r["fault"]) for r in rows])
    distance = segment.distances(ENDS)
    audit = segment.walk(distance, START)
    text = "\n".join(repaired([(r["role"], r["text"]) for r in rows], audit, START))
    return _answer(_measures([(r["turn"], r["role"][:1], r["fault"]) for r in rows]), distance[START], audit, hashlib.sha256(text.encode()).hexdigest())


def _arrow(schema: str, convs: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([("conv_id", convs), *((c.split()[0], kinds[c.split()[1]]) for c in schema.split(", "))])


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def taken(rows: DataFrame) -> DataFrame:
    """Answers of conversations that one task holds whole (``part`` null), and the rows of others (``ROW``), stored."""
    convs = rows.schema["conv_id"].dataType
    both = f"{ROW}, {DONE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema, part, held, first = [], None, TaskContext.get().partitionId(), [], True

        def open_rows(own: list[dict]) -> list[dict]:
            return [r | {"part": part, "place": k} for k, r in enumerate(own)]

        for batch in batches:
            schema = schema or _arrow(both, batch.schema.field("conv_id").type)
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[-1]["conv_id"]:
                    if first:
                        out += open_rows(held)  # the one before may have begun it
                    else:
                        out.append({"conv_id": held[0]["conv_id"], **solved(_judged([r for r in held if not r["dropped"]]))})
                    held, first = [], False
                held.append(row)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out or held:
            yield pa.RecordBatch.from_pylist(out + open_rows(held), schema)

    spec = ", ".join([f"conv_id {convs.simpleString()}", both])
    return staged(rows.select("conv_id", "turn", "role", "text", "dropped").mapInArrow(run, spec), "taken")


def _judged(rows: list[dict]) -> list[dict]:
    """The rows of a whole conversation with their faults."""
    known: set[tuple[str, bytes]] = set()
    out = []
    for r in rows:
        key = (r["role"], hashlib.sha256(r["text"].encode()).digest())
        out.append(r | {"fault": fault_of(r["text"], key in known)})
        known.add(key)
    return out


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows of conversations in segments with their ``fault``; a row's equals before it are found by an aggregate and a join, so a row repeated very often is no single task's."""
    live = rows.where(~F.col("dropped"))
    keyed = live.withColumn("key", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    firsts = keyed.groupBy(F.col("conv_id").alias("of"), F.col("key").alias("same")).agg(F.min(F.struct("part", "place")).alias("first"))
    known = keyed.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same"))).withColumn("known", F.struct("part", "place") != F.col("first"))
    kept = F.rtrim("text", F.lit(SPACE))
    fault = F.when(kept == "", BLANK).when(F.col("known"), DUPLICATE).when(F.substring(kept, -1, 1).isin(".", "!", "?"), GOOD).otherwise(CUT)
    return known.select("conv_id", "part", "place", "turn", "role", "text", fault.alias("fault"))


SUMMARY = "part int, measures string, ways string"
CHAIN = f"part int, first int, audit_part string, {DONE}"


def joined_segments(rows: DataFrame) -> DataFrame:
    """Answers, without the text's hash, of conversations in segments, and of each segment the state before it and its edits (``CHAIN``)."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        own = table.sort_by("place").to_pylist()
        segment = Segment([(r["role"][:1], r["fault"]) for r in own])
        measures = _measures([(r["turn"], r["role"][:1], r["fault"]) for r in own])
        return pa.table([[own[0]["conv_id"]], [own[0]["part"]], [json.dumps(measures)], [json.dumps(segment.ways())]], schema=_arrow(SUMMARY, table.schema.field("conv_id").type))

    def chained(key: tuple, table: pa.Table) -> pa.Table:
        own = table.sort_by("part").to_pylist()
        total, best = None, {START: (0, "", None)}  # by state: cost, audit, and the chain so far as (way, rest)
        for r in own:
            measures = json.loads(r["measures"])
            total = measures if total is None else _joined(total, measures)
            reached: dict[int, tuple] = {}
            for way in json.loads(r["ways"]):
                if way["first"] in best:
                    cost, audit, rest = best[way["first"]]
                    new = (cost + way["cost"], audit + way["audit"])
                    if way["last"] not in reached or new < reached[way["last"]][:2]:
                        reached[way["last"]] = (*new, (way, rest))
            best = reached
        cost, audit, chain = min((best[e] for e in ENDS if e in best), key=lambda x: x[:2])
        ways = []
        while chain:
            ways.append(chain[0])
            chain = chain[1]
        out = [{"conv_id": r["conv_id"], "part": r["part"], "first": w["first"], "audit_part": w["audit"]} for r, w in zip(own, reversed(ways), strict=True)]
        return pa.Table.from_pylist([*out, {"conv_id": own[0]["conv_id"], **_answer(total, cost, audit, None)}], schema=_arrow(CHAIN, table.schema.field("conv_id").type))

    summary = rows.select("conv_id", "part", "place", "turn", "role", "fault").groupBy("conv_id", "part").applyInArrow(summed, f"conv_id {kind}, {SUMMARY}")
    return staged(summary.groupBy("conv_id").applyInArrow(chained, f"conv_id {kind}, {CHAIN}"), "chains")


def hashed(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations in segments: segments' repaired texts, streamed in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    spec = f"conv_id {kind}, part int, n long, lines string"

    def mended(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own, way = left.sort_by("place").to_pylist(), right.to_pylist()[0]
        lines = repaired([(r["role"], r["text"]) for r in own], way["audit_part"], way["first"])
        return pa.table([[own[0]["conv_id"]], [own[0]["part"]], [len(lines)], ["\n".join(lines)]], schema=_arrow("part int, n long, lines string", left.schema.field("conv_id").type))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in groupby(_sorted_rows(batches), lambda r: r["conv_id"]):
            sha, begun = hashlib.sha256(), False
            for r in own:
                if r["n"]:
                    sha.update((b"\n" if begun else b"") + r["lines"].encode())
                    begun = True
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": sha.hexdigest()}], _arrow("repaired_sha256 string", batches_type))

    batches_type = to_arrow_type(rows.schema["conv_id"].dataType)
    ways = chains.where("part IS NOT NULL").select(F.col("conv_id").alias("of"), F.col("part").alias("at"), "first", "audit_part")
    texts = rows.groupBy("conv_id", "part").cogroup(ways.groupBy("of", "at")).applyInArrow(mended, spec)
    return texts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows sorted over all tasks by conversation and turn, however many are of one conversation, turn or text."""
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha"), F.col("near")]
    own = rows.withColumns({"sha": F.sha2("text", 256), "near": F.monotonically_increasing_id()})
    return own.repartitionByRange(*keys).sortWithinPartitions(*keys)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, dropped): its faults, and its cheapest repair (``DONE``)."""
    own = taken(in_order(rows))
    names = ["conv_id", *(c.split()[0] for c in DONE.split(", "))]
    whole = own.where("part IS NULL").select(names)
    parts = own.where("part IS NOT NULL").select("conv_id", *(c.split()[0] for c in ROW.split(", ")))
    judged = staged(with_faults(parts), "judged")
    chains = joined_segments(judged)
    digests = hashed(judged, chains)
    answers = chains.where("part IS NULL").drop("repaired_sha256").join(digests.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").select(names)
    gone = parts.groupBy("conv_id").agg(F.bool_and("dropped").alias("gone")).where("gone")
    zeros = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    empty = gone.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return whole.unionByName(answers).unionByName(empty)
