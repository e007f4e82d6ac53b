"""Repair of the turn structure of conversations by an automaton of shared suffixes.

A row's signature is one letter: its role's initial (``o`` for all but system, user and assistant), in capitals where the
text breaks off, or ``x`` where it must go (blank, or a copy of an earlier row of the conversation).  Signatures are read from
their ends, so conversations that end alike share nodes: a node of the automaton is one distinct suffix.  For each node
and each of the grammar's four states the cheapest edits of what is left are found once, from the node behind it: their
cost and first edit, whose successors lead down the same path.  Distinct signatures, reversed and sorted by ranges, bring
shared suffixes together, and a task keeps just the path to the current one.

Edits: K keeps a row (0), R gives it the role that the grammar wants (1), D deletes it (2), I puts an empty row of the role
that the grammar wants in front (5); a row that breaks off and stays costs 5 more.  The roles that result are
``(s?(ua)+)?``.  Of equally cheap edits the least in the order D, I, K, R of the first that differs is taken.  In each state
just one role can follow, so the edits determine the rows.

Long conversations are cut into chunks of ``CHUNK`` rows, counted from the end, and a chunk's end costs are those at
the next chunk's begin, so a group of letters is bounded.  The whole text of a conversation goes through one SHA-256,
which no two tasks can share: rows are sorted and streamed for that, and none are kept.

Cases: a null role or text is one space; a null conversation is one of its own; null turns come first, and rows of one turn
stand in the order of role and text; a conversation without rows has zeros, no edits and the digest of the empty string;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.shared import written

#: Rows of a chunk.
CHUNK = 1 << 16

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
# States of the grammar: begin, after system, after user, after assistant (the first and the last may end).
NEXT = (2, 2, 3, 2)  # the state that the wanted role leads to
WANTED = ("user", "user", "assistant", "user")
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: Costs at the end and the edits that they stand for.
END, END_EDITS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")

BLANK = r"^[\x20\x09-\x0D]*$"
BREAKS_OFF = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"


def step(letter: str, after: tuple) -> tuple[tuple, str, int]:
    """Costs in each state before a row with ``after`` behind it: (costs less their least, first edits, the least)."""
    more = BROKEN * letter.isupper()
    best = []
    for q in range(4):
        found = [(DELETE + after[q], "D")]
        if letter != "x":
            found.append((REROLE + more + after[NEXT[q]], "R"))
            if q in KEPT[letter.lower()]:
                found.append((KEEP + more + after[KEPT[letter.lower()][q]], "K"))
        best.append(min(found))
    # An insertion leads to state 2 or 3, and from each of these to the other.
    for q in (2, 3):
        other = 5 - q
        if (INSERT + best[other][0], "I") < best[q] and best[other][1] != "I":
            best[q] = (INSERT + best[other][0], "I")
    for q in (0, 1):
        best[q] = min(best[q], (INSERT + best[2][0], "I"))
    least = min(c for c, _ in best)
    return tuple(c - least for c, _ in best), "".join(e for _, e in best), least


def walk(letters: list[str], edits: list[str], state: int) -> tuple[str, int]:
    """(edits, state behind the last row) from ``state`` in front of the rows ``letters``, whose last is first here."""
    out, depth = [], len(letters)
    while depth:
        edit = edits[depth - 1][state]
        out.append(edit)
        if edit == "I":
            state = NEXT[state]
            continue
        if edit == "R":
            state = NEXT[state]
        elif edit == "K":
            state = KEPT[letters[depth - 1].lower()][state]
        depth -= 1
    return "".join(out), state


def solve(signatures: DataFrame, states: int, last: bool) -> DataFrame:
    """Costs and edits of distinct (ends array<int>, letters string, from the end): costs, least, edits, exits, nodes.

    ``edits`` and ``exits`` are for the first ``states`` states; ``last`` adds the insertions at the very end; ``nodes`` is
    the number of nodes that no signature before it in the task has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        ends, path = None, ""
        costs, edits, least = [], [], []  # of the nodes on the path, from the end
        for batch in batches:
            out = []
            for new_ends, letters in zip(batch.column("ends").to_pylist(), batch.column("letters").to_pylist()):
                shared = _shared(path, letters) if new_ends == ends else 0
                del costs[shared:], edits[shared:], least[shared:]
                ends, path = new_ends, letters
                for letter in letters[shared:]:
                    after = costs[-1] if costs else tuple(ends)
                    if (letter, after) not in known:
                        known[letter, after] = step(letter, after)
                    before, first, low = known[letter, after]
                    costs.append(before)
                    edits.append(first)
                    least.append(low + (least[-1] if least else 0))
                ways = [walk(letters, edits, q) for q in range(states)]
                done = [way + END_EDITS[state] for way, state in ways] if last else [way for way, _ in ways]
                out.append((new_ends, letters, list(costs[-1]), least[-1], done, [s for _, s in ways], len(letters) - shared))
            if out:
                ints = pa.list_(pa.int32())
                kinds = (ints, pa.string(), ints, pa.int64(), pa.list_(pa.string()), ints, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["ends", "letters", "costs", "least", "edits", "exits", "nodes"])

    kinds = "ends array<int>, letters string, costs array<int>, least long, edits array<string>, exits array<int>, nodes int"
    return signatures.distinct().orderBy("ends", "letters").mapInArrow(run, kinds)


def _shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def turns(rows: DataFrame) -> DataFrame:
    """Rows with their conversation's key, place from the end, fault, letter and whether they ill follow the row before."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    out = rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).repartition("conv")
    out = out.withColumn("copy", F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())))
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(F.col("copy") > 1, "duplicate").when(F.col("text").rlike(BREAKS_OFF), "truncated")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    back = Window.partitionBy("conv").orderBy(F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("copy").desc())
    pair = F.concat(F.lead(initial).over(back), initial)  # null on the first row
    before = F.lead("turn").over(back)
    return out.withColumn("fault", fault).select(
        "conv", "turn", "role", "text", "fault", letter.alias("letter"), (F.row_number().over(back) - 1).alias("back"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))).alias("new_turn"),
    )


def edits(rows: DataFrame, chunk: int | None = None) -> DataFrame:
    """conv, chunk, edits (of the chunk, in order), cost (of the conversation) of rows that ``turns`` made."""
    chunk = chunk or CHUNK
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("back", "letter"))), lambda x: x["letter"]), "")
    parts = written(rows.groupBy("conv", F.floor(F.col("back") / chunk).cast("int").alias("chunk")).agg(letters.alias("letters")), "letters")
    rounds = (parts.agg(F.max("chunk")).first()[0] or 0) + 1
    ends, solved = F.array(*[F.lit(c) for c in END]), []
    below = None
    for k in range(rounds):  # from the last rows of all conversations to their first
        here = parts.where(F.col("chunk") == k)
        here = here.withColumn("ends", ends).withColumn("base", F.lit(0).cast("long")) if below is None else here.join(below, "conv")
        found = written(solve(here.select("ends", "letters"), 1 if rounds == 1 else 4, k == 0).drop("nodes"), "nodes")
        here = here.join(found, ["ends", "letters"]).select("conv", "chunk", "costs", (F.col("base") + F.col("least")).alias("base"), "edits", "exits")
        solved.append(written(here, "solved"))
        below = solved[-1].select("conv", F.col("costs").alias("ends"), "base")
    out, entry = [], None
    for k in reversed(range(rounds)):  # and back, from the state that the chunk before leaves
        here = solved[k]
        state = F.lit(0) if entry is None else F.coalesce("state", F.lit(0))
        here = here if entry is None else here.join(entry, "conv", "left")
        top = F.lit(True) if entry is None else F.col("state").isNull()
        here = here.select("conv", "chunk", F.get("edits", state).alias("edits"), F.when(top, F.get("costs", F.lit(0)) + F.col("base")).alias("cost"), F.get("exits", state).alias("state"))
        here = here if rounds == 1 else written(here, "edits")
        out.append(here.drop("state"))
        entry = here.select("conv", "state")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def repaired(rows: DataFrame, ways: DataFrame, chunk: int | None = None) -> DataFrame:
    """conv, audit and repaired_sha256: rows stream in order behind their chunk's edits; nothing but a digest is kept."""
    own = rows.select("conv", F.floor(F.col("back") / (chunk or CHUNK)).cast("int").alias("chunk"), "back", F.lit(None).cast("string").alias("edits"), "role", "text")
    none = F.lit(None).cast("string")
    both = own.unionByName(ways.select("conv", "chunk", F.lit(None).cast("int").alias("back"), "edits", none.alias("role"), none.alias("text")))
    order = ["conv", F.col("chunk").desc(), F.col("back").desc_nulls_first()]
    dealt = both.repartition("conv").sortWithinPartitions(*order).select("conv", "edits", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for conv, way, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.end())
                    now = _Stream(conv)
                if way is not None:
                    now.edit(way)
                else:
                    now.row(role, text)
            if out:
                yield _ended(out)
        if now is not None:
            yield _ended([now.end()])

    return dealt.mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], ["conv", "audit", "repaired_sha256"])


class _Stream:
    """The digest of one conversation's repaired rows, fed row by row."""

    def __init__(self, conv: str):
        self.conv, self.digest, self.ways, self.way, self.at, self.state, self.any = conv, hashlib.sha256(), [], "", 0, 0, False

    def _put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def _insert(self) -> None:
        while self.at < len(self.way) and self.way[self.at] == "I":
            self._put(WANTED[self.state], "")
            self.state = NEXT[self.state]
            self.at += 1

    def edit(self, way: str) -> None:
        self._insert()
        self.ways.append(way)
        self.way, self.at = way, 0

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.way[self.at]
        self.at += 1
        if edit == "R":
            self._put(WANTED[self.state], text)
            self.state = NEXT[self.state]
        elif edit == "K":
            self._put(role, text)
            self.state = KEPT[role[0]][self.state]

    def end(self) -> tuple[str, str, str]:
        self._insert()
        return self.conv, "".join(self.ways), self.digest.hexdigest()


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """A row a conversation of ``rows`` (conv_id, turn, role, text) and, if given, of ``conversations`` (conv_id).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    marked = written(turns(rows), "turns")
    ways = written(edits(marked), "ways")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - one(F.col("new_turn")), F.lit(0)).alias("gaps"),
        *[one(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")],
        one(F.col("illegal")).alias("illegal"),
    )
    kind = rows.schema["conv_id"].dataType
    ids = rows.select("conv_id") if conversations is None else conversations.select("conv_id").unionByName(rows.select("conv_id"))
    ids = ids.distinct().withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    costs = ways.groupBy("conv").agg(F.max("cost").alias("cost"))
    full = ids.join(counts, "conv", "left").join(costs, "conv", "left").join(repaired(marked, ways), "conv", "left")
    longs = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return full.select(F.col("conv_id").cast(kind), *longs, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn: dropped, emptied, cut off, repeated or of another role."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), n.alias("hit")).where("hit <> 0")
    broken = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), broken.alias("text"), copies.alias("copy")).drop("copy")


def oracle() -> str:
    """DuckDB's SQL of the query: the cheapest edits by recursion from each conversation's end, row by row."""
    # A state's best way is one string, its cost in nine digits and its edits, so that the least string is the best way.
    least = lambda *ways: "least(" + ", ".join(ways) + ")"
    way = lambda cost, edit, s: f"printf('%09d', ({cost} + left({s}, 9)::BIGINT)::BIGINT) || '{edit}' || substr({s}, 10)"
    when = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    row = lambda q: least(
        way("2", "D", f"s{q}"), when("NOT gone", way("1 + more", "R", f"s{NEXT[q]}")),
        *[when(f"NOT gone AND ini = '{r}'", way("more", "K", f"s{to[q]}")) for r, to in KEPT.items() if q in to],
    )
    ins = lambda e: way("5", "I", e)
    ends = ", ".join(f"'{c:09d}{a}' AS s{q}" for q, (c, a) in enumerate(zip(END, END_EDITS)))
    return f"""
        WITH RECURSIVE poly AS (
            SELECT list_transform(range(256), lambda x: list_reduce([x::BIGINT] || [0::BIGINT for i in range(8)], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
        h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                                     lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS hit
              FROM conversations, poly),
        d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                     CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM h, range(2) c(copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
        f AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS old,
                     CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                          WHEN right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
        g AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f),
        e AS (
            SELECT conv_id, max(n) + 1 AS pos, {ends} FROM g GROUP BY conv_id
            UNION ALL
            SELECT conv_id, pos, {least("e0", ins("f2"))}, {least("e1", ins("f2"))}, f2, f3
            FROM (SELECT *, {least("e2", ins("e3"))} AS f2, {least("e3", ins("e2"))} AS f3
                  FROM (SELECT g.conv_id, g.pos, {row(0)} AS e0, {row(1)} AS e1, {row(2)} AS e2, {row(3)} AS e3
                        FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.pos = e.pos - 1))),
        a AS (SELECT conv_id, left(s0, 9)::BIGINT AS cost, substr(s0, 10) AS audit FROM e WHERE pos = 1),
        -- The edits letter by letter: the row each one is for, and the state of the grammar before it.
        w AS (
            SELECT conv_id, audit, 1 AS i, 0 AS pos, 0 AS st, NULL::VARCHAR AS piece FROM a
            UNION ALL
            SELECT w.conv_id, audit, i + 1, w.pos + (audit[i] <> 'I')::INT,
                   CASE WHEN audit[i] = 'D' THEN st WHEN audit[i] = 'K' AND g.ini = 's' THEN 1 WHEN audit[i] = 'K' THEN CASE g.ini WHEN 'u' THEN 2 ELSE 3 END WHEN st = 2 THEN 3 ELSE 2 END,
                   CASE audit[i] WHEN 'K' THEN g.role || ':' || g.text WHEN 'D' THEN NULL ELSE CASE WHEN st = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN audit[i] = 'R' THEN g.text ELSE '' END END
            FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.pos = w.pos + 1 WHERE i <= len(audit)),
        r AS (SELECT conv_id, sha256(coalesce(string_agg(piece, chr(10) ORDER BY i), '')) AS repaired_sha256 FROM w GROUP BY conv_id),
        k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
                     count_if(fault = 'truncated') AS truncated, count_if(old || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
    """
