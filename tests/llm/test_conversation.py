"""Repair against the plainest search over all edits, the automaton's nodes, chunks, and odd tables."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quadrat.llm import conversation as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, edits string, chunk string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)


def fault(text, role, seen):
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return None if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else "truncated"


def cheapest(rows):
    """(cost, edits, repaired rows) of (role, text, fault): every order of edits is tried, whole edits are compared."""
    allowed = re.compile(r"(s?(ua)+)?$")
    start = re.compile(r"(s?(ua)*u?)?$")

    @lru_cache(None)
    def best(i, state, inserted):
        # The state is the initials kept so far, of which the last two and the length tell all that counts.
        found = []
        if i == len(rows) and allowed.match(state):
            found.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if start.match(state + role[0]):
                    c, a, t = best(i, short(state + role[0]), inserted + 1)
                    found.append((c + 5, "I" + a, ((role, ""), *t)))
        if i < len(rows):
            role, text, wrong = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, t))
            if wrong not in ("blank", "duplicate"):
                more = 5 * (wrong == "truncated")
                for edit, cost, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if new and start.match(state + new[0]):
                        c, a, t = best(i + 1, short(state + new[0]), 0)
                        found.append((c + cost + more, edit + a, ((new, text), *t)))
        return min(found, default=(10**9, "", ()))

    def short(state):
        body = state.lstrip("s")
        return "s" * (state != body) + ("" if not body else "ua" if len(body) % 2 == 0 else "uau" if len(body) > 1 else "u")

    return best(0, "", 0)


def brute(rows, ids):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv in ids:
        own = sorted(groups.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in own:
            marked.append((role, text, fault(text, role, seen)))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for r, _, _ in marked]
        cost, audit, kept = cheapest(tuple(marked))
        n = lambda f: sum(x == f for _, _, x in marked)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(conv, turn, "user" if hit == 4 else role, text)] * (1 + (hit == 3))
    return out


def sample(seed, convs, longest):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(r.randint(0, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "sage"])
            text = r.choice(["Yes.", "No!", "What?", "so on", "", " \t\n", None, f"{r.random()}.", f"é {r.random()}", "end. \n", "\u00a0", "\u2003."])
            rows.append((conv, r.choice([turn, turn, turn, turn + 2, None]), role, text))
    return rows


def found(rows):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows.collect()}


@pytest.mark.parametrize("chunk", [1, 3, 65536])
def test_against_all_edits(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rows = sample(chunk, 60, 9)
    got = found(C.repair(frame(spark, rows)))
    want = brute(rows, {r[0] for r in rows})
    assert got == want


def test_query_damages_first(spark):
    rows = sample(11, 80, 8)
    all_rows = frame(spark, rows)
    got = found(C.repair(C.damaged(all_rows), all_rows))
    assert got == brute(damage(rows), {r[0] for r in rows})
    assert len(damage(rows)) != len(rows)


def test_a_node_is_solved_once(spark):
    r = random.Random(5)
    words = {"".join(r.choice("suaxUA") for _ in range(r.randint(1, 7))) for _ in range(400)}
    nodes = {w[k:] for w in words for k in range(len(w))}
    table = spark.createDataFrame([(list(C.END), w[::-1]) for w in sorted(words)] * 3, "ends array<int>, letters string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        solved = C.solve(table, 1, True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(solved) == len(words) and sum(r.nodes for r in solved) == len(nodes)


def test_long_conversation_and_edge_tables(spark, monkeypatch):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(3000)]
    want = ("K" * 3000, 0)
    one = C.repair(frame(spark, rows)).first()
    monkeypatch.setattr(C, "CHUNK", 700)
    parts = C.repair(frame(spark, rows)).first()
    assert (one.audit, one.cost) == (parts.audit, parts.cost) == want and one.repaired_sha256 == parts.repaired_sha256
    none = frame(spark, [])
    assert C.repair(none).count() == 0
    (lost,) = C.repair(none, frame(spark, rows[:1])).collect()
    assert tuple(lost) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    wide = frame(spark, [(7, 1, "user", "word " * 100_000 + "."), (7, 2, "assistant", "ok.")])
    assert C.repair(wide).first().audit == "KK"
    assert C.repair(frame(spark, rows).withColumn("conv_id", F.col("conv_id").cast("string"))).schema["conv_id"].dataType.simpleString() == "string"
