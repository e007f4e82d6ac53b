"""Merkle manifest of a dataset, kept as concatenated levels.

Every row is a leaf; the leaves of a group (a language) stand in the order of their ids, and every two neighbours become
one parent until one node, the group's subroot, is left.  The subroots in group order likewise give the root.

A group is cut into aligned blocks of 2^BLOCK_LEVELS leaves.  A block keeps each of its levels as one hex string: parents
are digests of substrings of two digests' width, and the siblings on the way up from a leaf are the substrings that flank
its own at each level.  The blocks' roots are the leaves of the next round of blocks, which recurses until every group is
one block.  Blocks of all rounds are written tables (the manifest); on the way down each block hands its members their
siblings with those of its own root behind them.

No step sees a group as a whole: rows are numbered by ranges, blocks hold at most 256 members, and the joins between
rounds are on (group, block).  ``H`` is the lowercase hex SHA-256 of its inputs' text, one after the other.

Cases: a null group is a group of its own and comes first; null ids come first in their group; rows of one id stand in the
order of their leaves (equal ones are interchangeable); nulls and empty texts have different leaves; columns that are
not among ``FIELDS`` are ignored; an empty table gives no rows; texts of any length are hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import numbered, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 8
WIDTH = 64
#: Stands in a segment where a node has no sibling.
ALONE = "-" * WIDTH


def leaf(values: list[Column]) -> Column:
    """H of the values, each '-' if null, else its UTF-8 byte count, ':' and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _parents(level: Column) -> Column:
    """The level above: digests of each two neighbours' text, the last one's own where it has no neighbour."""
    starts = F.sequence(F.lit(1), F.length(level), F.lit(2 * WIDTH))
    return F.array_join(F.transform(starts, lambda i: F.sha2(level.substr(i, F.lit(2 * WIDTH)), 256)), "").cast("binary")


def _levels(first: Column, height: Column) -> Column:
    """The level ``first`` and ``height`` levels above it, each one hex string."""
    step = lambda kept, j: F.when(j <= height, F.concat(kept, F.array(_parents(F.element_at(kept, -1))))).otherwise(kept)
    return F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK_LEVELS)), F.array(first.cast("binary")), step)


def _segment(levels: Column, place: Column) -> Column:
    """Siblings of the node at ``place`` of a block's first level, from below, of fixed width."""

    def flank(level: Column, j: Column) -> Column:
        other = F.call_function("shiftright", place, j).bitwiseXOR(F.lit(1))
        found = level.substr(other * WIDTH + 1, F.lit(WIDTH)).cast("string")
        return F.when(F.length(found) == 0, ALONE).otherwise(found)

    return F.array_join(F.transform(F.slice(levels, 1, F.size(levels) - 1), flank), "")


def fold(node: Column, segment: Column, place: Column) -> Column:
    """The root that ``node`` at ``place`` of its group gives with the siblings of ``segment``."""

    def up(node: Column, i: Column) -> Column:
        other = segment.substr(i, F.lit(WIDTH))
        right = F.call_function("shiftright", place, ((i - 1) / WIDTH).cast("int")).bitwiseAND(F.lit(1)) == 1
        return F.sha2(F.when(other == ALONE, node).when(right, F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.when(F.length(segment) == 0, node).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(segment), F.lit(WIDTH)), node, up))


def siblings(segment: Column) -> Column:
    """The siblings' digests of a segment, one after the other."""
    return F.replace(segment, F.lit("-"), F.lit(""))


@dataclass
class Forest:
    """Block tables by round (tree, block, n, members, levels) over numbered nodes."""

    rounds: list[DataFrame] = field(default_factory=list)

    @classmethod
    def of(cls, nodes: DataFrame, longest: int) -> Forest:
        """Blocks over ``nodes``: tree, place (from 0 in its tree), n (nodes of the tree), node and other columns.

        ``longest`` is the number of nodes of the largest tree.
        """
        made = cls()
        size = 1 << BLOCK_LEVELS
        while True:
            extra = [c for c in nodes.columns if c not in ("tree", "place", "n", "node")]
            member = F.struct((F.col("place") % size).cast("int").alias("at"), "node", *extra)
            blocks = nodes.groupBy("tree", F.floor(F.col("place") / size).alias("block")).agg(F.any_value("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
            height = F.when(F.col("n") == 1, 0).otherwise(F.least(F.lit(BLOCK_LEVELS), F.length(F.bin(F.col("n") - 1))))
            first = F.array_join(F.col("members.node"), "")
            made.rounds.append(written(blocks.withColumn("levels", _levels(first, height)), "blocks"))
            if longest <= size:
                return made
            longest = -(-longest // size)
            nodes = made.rounds[-1].select("tree", F.col("block").alias("place"), F.ceil(F.col("n") / size).alias("n"), F.element_at("levels", -1).cast("string").alias("node"))

    def roots(self) -> DataFrame:
        """tree and root."""
        return self.rounds[-1].select("tree", F.element_at("levels", -1).cast("string").alias("root"))

    def members(self, known: DataFrame | None = None) -> DataFrame:
        """Every node of the first round: tree, place, segment (its siblings up to the tree's root), node and its other columns.

        ``known`` has further columns of a tree; they join its last block, one row, and go down with the segments.
        """
        size, names, tails = 1 << BLOCK_LEVELS, [c for c in known.columns if c != "tree"] if known is not None else [], None
        for blocks in reversed(self.rounds):
            if tails is not None:
                blocks_and_tails = blocks.join(tails, ["tree", "block"])
            else:
                blocks_and_tails = (blocks.join(known, "tree") if known is not None else blocks).withColumn("tail", F.lit(""))
            own = F.transform("members", lambda m: F.struct(m.alias("m"), F.concat(_segment(F.col("levels"), m["at"]), F.col("tail")).alias("segment")))
            rows = blocks_and_tails.select("tree", "block", *names, F.explode(own).alias("x"))
            rows = rows.select("tree", (F.col("block") * size + F.col("x.m.at")).alias("place"), *names, "x.segment", "x.m.*").drop("at")
            if blocks is not self.rounds[0]:
                tails = written(rows.select("tree", F.col("place").alias("block"), *names, F.col("segment").alias("tail")), "tails")
        return rows


@dataclass
class Manifest:
    """Blocks over the leaves of every group, and over the groups' subroots."""

    groups: Forest
    top: Forest

    def root(self) -> DataFrame:
        """One row: the root.  None for an empty table."""
        return self.top.roots().select("root")

    def proofs(self) -> DataFrame:
        """A row a leaf: doc_id, leaf, other, place, subroot, group_place, segment, group_segment, root.

        ``segment`` goes up to the subroot and ``group_segment`` from there to the root; ``other`` is the leaf to verify.
        """
        tops = self.top.members(self.top.roots()).select(
            F.col("group").alias("tree"), F.col("node").alias("subroot"), F.col("place").alias("group_place"), F.col("segment").alias("group_segment"), "root"
        )
        return self.groups.members(tops).withColumnRenamed("node", "leaf")


def manifest(docs: DataFrame, group: str = "lang", now: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``.  ``now`` gives columns of today's rows, whose leaves are to be verified against it."""
    values = docs.select(*[F.col(c) for c in FIELDS], F.monotonically_increasing_id().alias("row"), *[c.alias(f"now_{k}") for k, c in (now or {}).items()])
    stored = leaf([F.col(c) for c in FIELDS])
    today = leaf([F.col(f"now_{c}") if c in (now or {}) else F.col(c) for c in FIELDS])
    same = F.lit(True)
    for c in now or {}:
        same = same & F.col(c).eqNullSafe(F.col(f"now_{c}"))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    # Hashed once and written; equal rows are told apart by where they were read, so that they can lie in several ranges.
    leaves = written(values.select(tree.alias("tree"), "doc_id", stored.alias("node"), F.when(~same, today).alias("other"), "row"), "leaves")
    nodes = numbered(leaves, "tree", ["doc_id", "node", "row"]).select("tree", "place", "n", "node", "doc_id", "other")
    longest = leaves.groupBy("tree").count().agg(F.max("count"), F.count("*")).first()
    groups = Forest.of(nodes, longest[0] or 0)
    subroots = groups.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("node"))
    top = numbered(subroots, "tree", ["group"]).select("tree", "place", "n", "node", "group")
    return Manifest(groups, Forest.of(top, longest[1]))


def verify(made: Manifest) -> DataFrame:
    """Every row's proof folded again: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = made.proofs()
    lower = rows.withColumn("up", fold(F.coalesce("other", "leaf"), F.col("segment"), F.col("place")))
    folded = lower.withColumn("folded_root", fold(F.col("up"), F.col("group_segment"), F.col("group_place")))
    proof = F.sha2(siblings(F.concat("segment", "group_segment")), 256)
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle() -> str:
    """DuckDB's SQL of the query: levels and paths by recursion over whole levels."""
    named = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    text = lambda n: "sha256(" + " || ".join(named(n if c == "n_chars" else c) for c in FIELDS) + ")"
    levels = lambda name, first: f"""
        {name} AS (
            SELECT grp, 0 AS lev, place, node, n FROM {first}
            UNION ALL
            SELECT grp, lev + 1, place // 2, sha256(node || coalesce(nxt, '')), (n + 1) // 2
            FROM (SELECT *, lead(node) OVER (PARTITION BY grp ORDER BY place) AS nxt FROM {name} WHERE n > 1) WHERE place % 2 = 0)"""  # noqa: E731
    up = lambda name, first, tree: f"""
        {name} AS (
            SELECT id, grp, 0 AS lev, place, hash, '' AS sibs FROM {first}
            UNION ALL
            SELECT p.id, p.grp, p.lev + 1, p.place // 2,
                   sha256(CASE WHEN s.node IS NULL THEN p.hash WHEN p.place % 2 = 1 THEN s.node || p.hash ELSE p.hash || s.node END),
                   p.sibs || coalesce(s.node, '')
            FROM {name} p JOIN {tree} o ON o.grp = p.grp AND o.lev = p.lev AND o.place = p.place AND o.n > 1
            LEFT JOIN {tree} s ON s.grp = p.grp AND s.lev = p.lev AND s.place = xor(p.place, 1))"""  # noqa: E731
    return f"""
        WITH RECURSIVE poly AS (
            SELECT list_transform(range(256), lambda x: list_reduce([x::BIGINT] || [0::BIGINT for i in range(8)], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
        d AS (SELECT coalesce('=' || lang, '') AS grp, doc_id, {text("n_chars")} AS leaf, {text("(n_chars + 1)")} AS other,
                     xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                                     lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0 AS hit
              FROM documents, poly),
        l AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY grp) AS n, leaf AS node,
                     row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, leaf) AS id,
                     CASE WHEN hit THEN other ELSE leaf END AS hash
              FROM d WINDOW w AS (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf)),
        {levels("tree", "l")},
        sub AS (SELECT 0 AS grp, grp AS lang, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n, node FROM tree WHERE n = 1),
        {levels("top", "sub")},
        {up("path", "l", "tree")},
        mid AS (SELECT p.id, 0 AS grp, s.place, p.hash, p.sibs AS low, s.node AS subroot FROM path p
                JOIN tree t ON t.grp = p.grp AND t.lev = p.lev AND t.n = 1 JOIN sub s ON s.lang = p.grp),
        {up("high", "mid", "top")}
        SELECT l.doc_id, l.leaf, m.subroot, r.node AS root, sha256(m.low || h.sibs) AS proof_sha256, h.hash AS folded_root, h.hash = r.node AS verified
        FROM high h JOIN top r ON r.n = 1 AND r.lev = h.lev JOIN mid m USING (id) JOIN l USING (id)
    """
