"""Small cases with known results, invariances and refusals."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quadrat.functions import features as E
from quadrat.functions import geo as G
from quadrat.functions.text import id_digest, raster_path
from quadrat.operators import labels as L
from quadrat.operators import metrics as M
from quadrat.operators import occurrence as O
from quadrat.operators import policy as Y
from quadrat.operators import ranking as R
from quadrat.operators import spatial as P
from quadrat.operators import splits as S
from quadrat.operators import stats as Z
from quadrat.sources import files, sinks


def km(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(2 * G.EARTH_KM * math.asin(math.sqrt(min(1, x))), 6)


def points(spark, n, seed):
    r = random.Random(seed)
    edge = [(90.0, 0.0), (-90.0, 10.0), (89.99, 170.0), (0.0, 180.0), (0.0, -180.0), (0.05, -179.99), (60.0, 179.95), (60.0, -179.95)]
    return edge + [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(n)] + [(r.uniform(-0.5, 0.5), r.choice([-1, 1]) * r.uniform(179.5, 180)) for _ in range(n)]


@pytest.mark.parametrize("radius", [20.0, 500.0, 9000.0, 20100.0])
def test_within_is_brute_force(spark, radius):
    a, b = points(spark, 40, 1), points(spark, 40, 2)
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "l long, lat double, lon double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "r long, rlat double, rlon double")
    got = {(x.l, x.r) for x in P.within_km(left, right, radius).collect()}
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if km(p, q) <= radius}
    assert len(got) == P.within_km(left, right, radius).count()


def test_nearest_is_brute_force(spark):
    a, b = points(spark, 30, 3), points(spark, 30, 4)
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "l long, lat double, lon double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "r long, rlat double, rlon double")
    got = {}
    for x in P.nearest(left, right, 3, "r").collect():
        got.setdefault(x.l, []).append((x.km, x.r))
    for i, p in enumerate(a):
        assert sorted(got[i]) == sorted((km(p, q), j) for j, q in enumerate(b))[:3]


def test_haversine(spark):
    d = spark.range(1).select(G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert abs(d - 111.195) < 0.01


def test_buffer_keeps_distance(spark):
    r = random.Random(811)
    rows = [(i, r.uniform(38, 58), r.uniform(-5, 25)) for i in range(1500)]
    places = spark.createDataFrame(rows, "site long, lat double, lon double")
    for fold in S.two_folds(places, "t", 1, 12, 6, 6, 20, "site"):
        got = {x.site: x.role for x in fold.collect()}
        train = [x for x in rows if got[x[0]] == 0]
        other = [x for x in rows if got[x[0]] > 0]
        assert train and other and min(km(a[1:], b[1:]) for a in train for b in other) >= 20


def test_digests(spark):
    ids = [3, 1, 2**40, 0]
    row = spark.createDataFrame([(ids,)], "ids array<long>").select(id_digest(F.col("ids")), G.sha_bucket(F.lit("abc"), 97)).first()
    assert row[0] == hashlib.sha256(b"".join(i.to_bytes(8, "little") for i in ids)).hexdigest()
    assert row[1] == int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "little") % 97


def test_raster_path(spark):
    assert spark.range(1).select(raster_path(F.lit("PA-test"), F.lit(1001507))).first()[0] == "PA-test/07/15/1001507.tiff"


def test_dense_index(spark):
    rows = spark.createDataFrame([(x,) for x in [5, 3, 3, None, 9, -1]], "v long")
    assert sorted(map(tuple, L.dense_index(rows, "v", "i").collect())) == [(-1, 0), (3, 1), (5, 2), (9, 3)]


def test_alignment_refuses(spark):
    ids = spark.createDataFrame([(2,), (1,)], "k long")
    good = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k long, v long")
    assert {x.k: x.v for x in L.aligned(ids, good, "k").collect()} == {1: 10, 2: 20}
    for bad in ([(1, 10)], [(1, 10), (2, 20), (2, 21)]):
        with pytest.raises(ValueError):
            L.aligned(ids, spark.createDataFrame(bad, "k long, v long"), "k")


def test_capped_shares(spark):
    def shares(masses, cap):
        rows = spark.createDataFrame([(k, float(m)) for k, m in masses.items()], "publisher long, weight double")
        out = {r.publisher: r.weight for r in O.cap_publishers(rows, cap).collect()}
        assert abs(sum(out.values()) - sum(masses.values())) < 1e-9
        return {k: w / sum(masses.values()) for k, w in out.items()}

    got = shares({0: 90, 1: 3, 2: 3, 3: 2, 4: 2}, 0.3)
    assert abs(got[0] - 0.3) < 1e-9 and abs(got[1] - 0.21) < 1e-9 and abs(got[3] - 0.14) < 1e-9
    got = shares({0: 50, 1: 40, 2: 5, 3: 5}, 0.3)  # a second publisher passes the cap, at 1/n none is free to fall
    assert all(abs(got[k] - v) < 1e-9 for k, v in {0: 0.3, 1: 0.3, 2: 0.2, 3: 0.2}.items())
    assert all(abs(x - 0.5) < 1e-9 for x in shares({0: 99, 1: 1}, 0.1).values())


def test_greedy_roles_are_sequential(spark):
    import hashlib
    import random

    r = random.Random(3)
    blocks = {f"+{i:03d}:+{i:03d}": r.randint(1, 9) for i in range(40)}
    wanted = {0: 0.5, 1: 0.3, 2: 0.2}
    total, want = dict.fromkeys(wanted, 0), {}
    for b in sorted(blocks, key=lambda b: (-blocks[b], hashlib.sha256(b.encode()).hexdigest())):
        role = min(wanted, key=lambda k: ((total[k] + blocks[b]) / wanted[k], k))
        want[b] = role
        total[role] += blocks[b]
    got = S.greedy_roles(spark.createDataFrame(list(blocks.items()), "block string, n long"), wanted)
    assert {x.block: x.role for x in got.collect()} == want


def test_latent_space_is_numpy(spark):
    """Distances in the whitened space of leading components are those of a plain decomposition."""
    import numpy as np

    from quadrat.operators import vectors as V

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    x[3, 1], x[7, 0] = np.nan, np.inf
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, e array<double>")
    fit = np.arange(60) % 5 != 0
    own = np.where(np.isfinite(x), x, np.nan)
    mean = np.nanmean(own[fit], 0)
    own = np.where(np.isfinite(own), own, mean)
    z = np.clip((own - mean) / np.maximum(own[fit].std(0), 0.01), -6, 6)
    values, axes = np.linalg.eigh(np.cov(z[fit].T))
    y = (z - z[fit].mean(0)) @ axes[:, ::-1][:, :3] / np.maximum(values[::-1][:3], 0.05) ** 0.25
    got = {r.id: np.array(r.v) for r in V.latent(rows, "id", "e", F.col("id") % 5 != 0, 3).collect()}
    for a, b in ((0, 1), (3, 7), (10, 59), (4, 30)):
        assert abs(np.linalg.norm(got[a] - got[b]) - np.linalg.norm(y[a] - y[b])) < 1e-6


def test_nearest_vectors_are_brute_force(spark):
    import numpy as np

    from quadrat.operators import vectors as V

    x = np.random.default_rng(4).integers(0, 4, (50, 3)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    q, r = rows.where("id % 5 = 0").withColumnRenamed("id", "query"), rows.where("id % 5 <> 0").withColumnRenamed("id", "ref")
    got = sorted((a.query, a.rank, a.ref) for a in V.nearest(q, r, 6, block=7).collect())
    want = []
    for i in range(0, 50, 5):
        near = sorted((round(float(np.linalg.norm(x[i] - x[j])), 6), j) for j in range(50) if j % 5)[:6]
        want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_rows_without_coordinates_have_no_neighbours(spark):
    left = spark.createDataFrame([(1, 48.0, 2.0), (2, None, 2.0), (3, float("nan"), 1.0)], "site long, lat double, lon double")
    right = spark.createDataFrame([(9, 48.1, 2.0), (8, 48.0, None)], "ref long, rlat double, rlon double")
    assert [(r.site, r.ref) for r in P.nearest(left, right, 3, "ref").collect()] == [(1, 9)]


def test_set_editor_follows_the_list(spark):
    """Swaps are paired and stop at the margin, one-sided edits go one way, the first three fifths stay."""
    from quadrat.operators import compose as C

    base = spark.createDataFrame([(1, 100 + i, i + 1) for i in range(10)], "survey long, species long, rank int")
    gains = {109: 0.4, 108: -0.1, 107: -0.2, 100: 0.9, 200: 0.5, 201: 0.3, 202: 0.01, 203: -0.3}
    table = spark.createDataFrame([(1, k, v) for k, v in gains.items()], "survey long, species long, gain double")
    run = lambda *a, **k: [r.species for r in C.edited(base, table, *a, **k).orderBy("rank").collect()]
    own = [100 + i for i in range(10)]
    assert run(2, 0, 0.0) == [x for x in own if x not in (109, 108)] + [200, 201]  # the third pair would lose
    assert run(1, 0, 1.0) == own
    assert run(0, 2, 0.0) == own + [200, 201] and run(0, 2, 0.0, high=11) == own + [200] and run(0, 2, 0.35) == own + [200]
    assert run(0, 2, 0.0, high=10) == [x for x in own if x != 109]
    assert all(all(r[1:]) for r in C.contract(base, C.edited(base, table, 2, 2, 0.0), 2, 2, 8, 40).collect())


def test_pseudo_surveys_ignore_density(spark):
    rows = [(1, 1, 7, 0, 5, 11), (1, 1, 7, 0, 6, 12), (1, 2, 7, 1, 5, 13)]
    schema = "row_cell long, col_cell long, publisher long, stratum long, species long, survey long"
    once = O.pseudo_surveys(spark.createDataFrame(rows, schema)).drop("raw")
    many = O.pseudo_surveys(spark.createDataFrame((rows * 3)[::-1], schema)).drop("raw")
    assert sorted(once.collect()) == sorted(many.collect())


def ranking(spark, lists):
    return spark.createDataFrame([(s, x, i + 1, v) for s, xs in lists.items() for i, (x, v) in enumerate(xs)], "survey long, species long, rank int, score double")


def test_residual_edit(spark):
    base = ranking(spark, {1: [(i, 1 - i / 20) for i in range(10)]})
    others = ranking(spark, {1: [(100 + i, 2 - i / 20) for i in range(10)]}).drop("rank")
    got = R.residual_edit(base, others, 0.6, 2).orderBy("rank").collect()
    assert [x.species for x in got] == [0, 1, 2, 3, 4, 5, 6, 7, 100, 101]
    same = R.residual_edit(base, others, 0.6, 0).orderBy("rank").collect()
    assert [x.species for x in same] == list(range(10))


def test_quotas_are_greedy(spark):
    r = random.Random(5)
    lists = {s: [(i, 0.0) for i in range(30)] for s in range(20)}
    flags = {(s, i): (r.random() < 0.5, r.random() < 0.3, r.random() < 0.6) for s in lists for i in range(30)}
    df = spark.createDataFrame([(s, i, i + 1, *flags[s, i]) for s in lists for i in range(30)], "survey long, species long, rank int, rare boolean, zero boolean, fresh boolean")
    got = {}
    for x in R.with_quotas(df, {"rare": 4, "zero": 2}, "fresh").orderBy("survey", "rank").collect():
        got.setdefault(x.survey, []).append(x.species)
    for s in lists:
        kept, rare = [], 0
        for i in range(30):
            if flags[s, i][0] and flags[s, i][2]:
                rare += 1
                if rare > 4:
                    continue
            kept.append(i)
        out, zero = [], 0
        for i in kept:
            if flags[s, i][1] and flags[s, i][2]:
                zero += 1
                if zero > 2:
                    continue
            out.append(i)
        assert got[s] == out


def test_counts_and_mix(spark):
    row = spark.createDataFrame([(1.0,), (10.0,), (100.0,)], "n double").select(R.adaptive_count(F.log1p("n"), 1.2, 4, 50)).collect()
    assert [r[0] for r in row] == [4, 12, 50]
    base = F.lit(0.25)
    assert R.mixed(base, F.lit(0.8), 0.0, F.lit(1.0)) is base
    got = spark.range(1).select(R.mixed(F.lit(0.2), F.lit(0.8), 0.2, F.lit(1.0))).first()[0]
    assert abs(got - 0.32) < 1e-12


def test_sample_f1(spark):
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "survey long, species long")
    said = spark.createDataFrame([(1, 1), (2, 3), (2, 1), (2, 2)], "survey long, species long")
    surveys = spark.createDataFrame([(1,), (2,), (3,)], "survey long")
    got = {x.survey: x.f1 for x in M.survey_f1(surveys, truth, said).collect()}
    assert got[3] == 0 and abs((got[1] + got[2]) / 2 - (2 / 3 + 1 / 2) / 2) < 1e-12


def test_gate_fails_closed(spark):
    row = spark.createDataFrame([(1.0, None)], "a double, b double")
    got = Y.gate(row, {"a": F.col("a") > 0, "b": F.col("b") > 0}).first()
    assert got["a"] is True and got["b"] is False and got["promoted"] is False


def test_registered(spark):
    grid = spark.createDataFrame([(0.0, 4), (0.5, 6)], "w double, k long")
    with pytest.raises(ValueError):
        Y.registered(spark.createDataFrame([(0.9, 4)], "w double, k long"), grid, ["w", "k"])
    assert Y.registered(grid, grid, ["w", "k"]).count() == 2


def test_fill_and_parse(spark):
    x = spark.createDataFrame([([0.0, 12345.0, float("inf"), float("-inf"), float("nan"), 3.4e38],)], "a array<double>")
    assert x.select(E.without_fill(F.col("a"), 60000)).first()[0] == [0.0, 12345.0, 0.0, 0.0, 0.0, 0.0]
    got = spark.createDataFrame([("1.5",), (" NaN",), ("none",), ("",), ("x",), ("inf",)], "t string").select(E.parsed(F.col("t"))).collect()
    assert [r[0] for r in got] == [1.5, None, None, None, None, None]


def test_permute(spark):
    flat = list(range(24))
    got = spark.createDataFrame([(flat,)], "a array<int>").select(E.permuted(F.col("a"), (2, 3, 4), (2, 1, 0))).first()[0]
    assert got == [flat[(k * 3 + j) * 4 + i] for i in range(4) for j in range(3) for k in range(2)]


def test_platt(spark):
    r = random.Random(3)
    rows = []
    for _ in range(4000):
        p = r.random()
        z = 2.0 * math.log(p / (1 - p)) - 0.5
        rows.append((p, r.random() < 1 / (1 + math.exp(-z))))
    a, b = Z.platt_fit(Z.logit_histogram(spark.createDataFrame(rows, "p double, y boolean"), F.col("p"), F.col("y"), -8, 8, 256))
    assert abs(a - 2.0) < 0.25 and abs(b + 0.5) < 0.2


def test_weighted_draw(spark):
    rows = spark.createDataFrame([(f"k{i}", float(i)) for i in range(5)], "key string, weight double")
    got = Z.draw_weighted(rows, "key", "weight", 4000, 1).groupBy("key").count().collect()
    n = {x.key: x["count"] for x in got}
    assert sum(n.values()) == 4000 and n.get("k0", 0) == 0 and abs(n["k4"] / 4000 - 0.4) < 0.04


def test_submission(spark, tmp_path):
    template = spark.createDataFrame([(2, 0), (1, 1)], "survey long, place int")
    rows = sinks.submission(template, ranking(spark, {1: [(10, 1.0), (30, 0.5)], 2: [(20, 1.0), (30, 0.5)]}))
    vocabulary = spark.createDataFrame([(10,), (20,), (30,)], "species long")
    sinks.check_submission(rows, template, vocabulary, 1, 2)
    with pytest.raises(ValueError):
        sinks.check_submission(rows, template, vocabulary, 3, 4)
    sinks.write_submission(rows, str(tmp_path / "out"), "place")
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_bytes() == b"survey,predictions\r\n2,20 30\r\n1,10 30\r\n"
    gate = spark.createDataFrame([(True, False)], "a boolean, b boolean")
    assert sinks.publish(rows, None, gate, str(tmp_path / "no"), "place") == "NO_SUBMISSION"


def test_sinks_publish_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "10 30", 1), (2, "20 30", 0)], "survey long, predictions string, place int")
    gate = spark.createDataFrame([(True, True)], "a boolean, b boolean")
    digest = sinks.publish(rows, None, gate, str(tmp_path / "yes"), "place")
    assert digest != "NO_SUBMISSION" and spark.read.option("header", True).csv(str(tmp_path / "yes")).count() == 2
    assert sinks.publish(rows, digest, gate, str(tmp_path / "again"), "place") == "NO_SUBMISSION"  # nothing new
    assert sinks.report(gate) == '{"a": true, "b": true}'
    frame = spark.createDataFrame([(2, 0.5), (1, 0.25)], "survey long, f1 double")
    sinks.write_assessment(frame, str(tmp_path / "frame"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "frame")).collect()] == [("1", "0.25"), ("2", "0.5")]


def test_diagnostics_are_compact(spark, tmp_path):
    scored = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.25), (1, 9, 0.25), (2, 7, 1.0)], "survey long, species long, p double")
    surveys = spark.createDataFrame([(1, 0, 2.0), (2, 1, 1.0)], "survey long, fold int, weight double")
    truth = spark.createDataFrame([(1, 9), (1, 5)], "survey long, species long")
    sinks.write_diagnostics(sinks.diagnostics(R.ranked(scored, "p"), truth, surveys, "p", 2), str(tmp_path / "d"), "fold")
    got = {r.survey: (r.fold, r.weight, r.species, r.scores, r.mass, r.truth) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert got == {1: (0, 2.0, [7, 8], [0.5, 0.25], 1.0, [5, 9]), 2: (1, 1.0, [7], [1.0], 1.0, [])}


def test_files(spark, tmp_path):
    (tmp_path / "plots-train-soil.csv").write_text("surveyId,value,other\n2,20,x\n1,10,y\n")
    (tmp_path / "plots-test-soil.csv").write_text("surveyId,value,other\n3,30,x\n")
    got = files.scan_csv(spark, str(tmp_path / "plots-train-soil.csv"), "surveyId long, value double, other string", ["surveyId", "value"])
    assert sorted(map(tuple, got.collect())) == [(1, 10.0), (2, 20.0)] and files.describe(got) == {"surveyId": "bigint", "value": "double"}
    with pytest.raises(ValueError):
        files.require(spark, str(tmp_path / "plots-test-soil.csv"), ["lat"])
    assert files.pair_by_name(files.inventory(spark, str(tmp_path))).count() == 1
    assert files.band_order(["blue", "green", "red", "nir"]) == [2, 1, 0, 3]


def test_stream_ignores_batches_and_repeats(spark, tmp_path):
    from quadrat.streaming import cells

    rows = [(i % 3, i % 2, i % 5, i % 7) for i in range(60)]
    schema = "row_cell long, col_cell long, publisher long, species long"
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20] * 2, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = cells.run(spark, source, str(tmp_path / "shared"))
    assert sorted(got.collect()) == sorted(cells.counts(spark.createDataFrame(rows, schema)).collect())


def test_edit_targets_are_single_edits(spark):
    from quadrat.operators import regress as G

    rows = spark.createDataFrame([(1, 5, 1), (1, 6, 1), (1, 7, 0), (1, 8, 0)], "survey long, species long, inside int")
    truth = spark.createDataFrame([(1, 5), (1, 7), (1, 9)], "survey long, species long")
    f1 = lambda said: 2 * len(said & {5, 7, 9}) / (len(said) + 3)
    for r in G.edit_targets(rows, "inside", truth).collect():
        after = {5, 6} ^ {r.species}
        assert abs(r.target - 100 * (f1(after) - f1({5, 6}))) < 1e-9 and r.share == 0.25


def test_regressions_beat_the_mean(spark):
    from compare import DATA

    from quadrat.plans import ranking, regressions

    best = M.oracle_counts(ranking._hits(spark, DATA), 4, 20).select("survey", F.col("k").alias("best"))
    rows = regressions.count_regression(spark, DATA).join(best, "survey").where("survey % 5 = 0").collect()
    mean = sum(r.best for r in rows) / len(rows)
    assert sum((r.k - r.best) ** 2 for r in rows) <= 1.1 * sum((mean - r.best) ** 2 for r in rows)
    gains = regressions.edit_regression(spark, DATA)
    assert gains.groupBy("survey", "species").count().where("count > 1").isEmpty() and gains.where("gain is null").isEmpty()


def test_data_card(spark, tmp_path):
    from quadrat.sources import files

    spark.createDataFrame([(1, "x")], "a long, b string").write.parquet(str(tmp_path / "in" / "t.parquet"))
    (tmp_path / "in" / "landsat_1.csv").write_text("a\n1\n")
    files.data_card(spark, str(tmp_path / "in"), str(tmp_path / "card"))
    rows = {r.name: r for r in spark.read.json(str(tmp_path / "card")).collect()}
    assert rows["landsat_1.csv"].kind == "landsat" and rows["landsat_1.csv"].bytes == 4 and rows["landsat_1.csv"].columns is None
    assert any(n.startswith("t.parquet/") and r.columns == "a bigint, b string" for n, r in rows.items())
