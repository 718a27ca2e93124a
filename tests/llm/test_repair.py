import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import repair
from docloom.llm.queries import op13_bucket_queue

SPACE = "\x20\x09-\x0d"
TYPES = {"conv_id": "bigint", **dict.fromkeys(repair.COUNTS, "bigint"), "audit": "string", "repaired_sha256": "string"}


def cheapest(rows):
    """(cost, audit) by a search over whole audits; rows of (role, fault)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        into = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, into))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1]))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, into))


def brute(table):
    """Answers by conv_id, one row after the other; rows of one turn must be alike or of different roles or texts."""
    by = {}
    for conv, turn, role, text in table:
        own = by.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        faults = []
        for k, (_, role, text) in enumerate(own):
            solid = re.findall(f"[^{SPACE}]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in {r[1:] for r in own[:k]} else "" if solid[-1] in ".!?" else "truncated")
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = cheapest([(r[1], f) for r, f in zip(own, faults, strict=True)])
        lines, i, last = [], 0, ""
        for letter in audit:
            role = {"K": own[i][1] if i < len(own) else "", "D": None}.get(letter, "assistant" if last == "u" else "user")
            if letter != "D":
                lines.append(role + ":" + ("" if letter == "I" else own[i][2]))
                last = role[:1]
            i += letter != "I"
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return out


def answers(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in TYPES if c != "conv_id") for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n, longest=12):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", None, "tool", ""], ["Fine.", "Is it?", "no end", "", " \t\x0b", None, "a.b", "é!", "x.  \n", "nb.\xa0"]
    rows = []
    for c in range(n):
        rows += [(None if c == 3 else c, rng.choice([None, t, t, t, t + 2]), rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(1, longest))]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_matches_plain_search(spark, table, tmp_path):
    rows = conversations(1, 300)
    table(rows, SCHEMA, "conversations", parts=3)
    df = op13_bucket_queue(spark, str(tmp_path))
    assert dict(df.dtypes) == TYPES and answers(df) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_long_conversations_reach_over_tasks(spark, table, partitions):
    rows = conversations(2, 30) + [(500, None if t % 3 else t, r, x) for t, (_, _, r, x) in enumerate(conversations(3, 40))] + [(600, 7, "user", "the same.")] * 120 + [(700, t, "user", "the same.") for t in range(100)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = answers(repair.repair(repair.damaged(table(rows, SCHEMA, parts=4))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows)


def test_hot_conversation_is_spread(spark, table):
    rows = [(1, 7, "user", "the same.")] * 4000
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = repair.in_order(repair.damaged(table(rows, SCHEMA, parts=8))).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 0.5 * sum(r["count"] for r in sizes)


def test_distances_and_segments_agree_with_whole(spark):
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.randrange(4)) for _ in range(rng.randint(0, 14))]
        whole = repair.Segment(rows)
        distance = whole.distances(repair.ENDS)
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        assert (distance[repair.START], whole.walk(distance, repair.START)) == cheapest([(r, names[f]) for r, f in rows])
        cut = rng.randint(0, len(rows))
        best = min((a["cost"] + b["cost"], a["audit"] + b["audit"]) for a in repair.Segment(rows[:cut]).ways() for b in repair.Segment(rows[cut:]).ways() if a["first"] == repair.START and a["last"] == b["first"] and b["last"] in repair.ENDS)
        assert best == (distance[repair.START], whole.walk(distance, repair.START))


def test_edges(spark, table):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    long = "word " * 200_000
    rows = [(None, None, None, None), (1, 0, "user", long), (1, 1, "assistant", long + "."), (2, 3, "user", "a."), (2, 3, "user", "a."), (2, 3, "user", "b.")]
    clashing = spark.createDataFrame([(*r, 1, "x", 2, False) for r in rows], SCHEMA + ", part int, audit string, place int, dropped boolean")
    assert answers(repair.repair(repair.damaged(clashing))) == brute(rows)
