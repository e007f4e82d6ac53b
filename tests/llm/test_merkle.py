"""The manifest against a tree built in plain Python, by several rounds of blocks and on odd tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from test_llm import ODD, odd

from quadrat.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    values = [row.doc_id, row.source, row.lang, n_chars, row.text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def paths(nodes):
    """(root, siblings of each node as (place of the parent's child, digest or None) a level)."""
    own = [[] for _ in nodes]
    at, level = list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            own[i].append((p % 2, level[p ^ 1] if p ^ 1 < len(level) else None))
            at[i] = p // 2
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], own


def folded(node, path):
    for right, other in path:
        node = h(node) if other is None else h(other, node) if right else h(node, other)
    return node


def brute(rows):
    hit = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r, leaf(r, r.n_chars), leaf(r, r.n_chars + 1 if hit(r) and r.n_chars is not None else r.n_chars)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, out = [], []
    for g in order:
        groups[g].sort(key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        subs.append(paths([x[1] for x in groups[g]]))
    root, tops = paths([s for s, _ in subs])
    for g, (subroot, own), top in zip(order, subs, tops):
        for (r, stored, now), path in zip(groups[g], own):
            up = folded(now, path + top)
            out.append((r.doc_id, stored, subroot, root, h(*[d for _, d in path + top if d]), up, up == root))
    return out


def found(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.verify(merkle.manifest(docs, now={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}))


def table(spark, n, langs):
    r = random.Random(n)
    rows = [(r.choice([None, *range(n)]), r.choice(["", "a", None, "ü-x"]), langs[int(len(langs) * r.random() * r.random())], r.choice([None, "s"]), r.choice([None, 5]), "x", None, "y") for _ in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, tree string, place string")


@pytest.mark.parametrize("levels, n", [(1, 23), (2, 70), (8, 300), (3, 1)])
def test_against_plain_tree(spark, monkeypatch, levels, n):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    docs = table(spark, n, [None, "de", "é", "z", "en"])
    key = lambda x: str(x)
    assert sorted(map(tuple, found(docs).collect()), key=key) == sorted(brute(docs.collect()), key=key)


def test_odd_rows(spark):
    docs = odd(spark, ODD)
    assert sorted(map(str, map(tuple, found(docs).collect()))) == sorted(map(str, brute(docs.collect())))
    assert found(docs.limit(0)).count() == 0


def test_only_changed_rows_fail(spark):
    docs = odd(spark, [(i, f"text {i}") for i in range(40)])
    rows = merkle.verify(merkle.manifest(docs, now={"text": F.when(F.col("doc_id") == 13, "other").otherwise(F.col("text"))})).collect()
    assert [r.doc_id for r in rows if not r.verified] == [13] and len(rows) == 40


def test_query_has_a_row_a_document(spark):
    from compare import DATA

    assert queries.op11_merkle_manifest(spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
