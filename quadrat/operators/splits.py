"""Label-blind spatial splits with buffers between roles, and their audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.geo import block_id, sha_bucket
from quadrat.operators.spatial import outside_buffer, within_km

#: Cells of one degree on the globe.
MOST_BLOCKS = 64_800
TRAIN, CHECK, CALIBRATE, ASSESS, EXCLUDED = 0, 1, 2, 3, -1


def by_bucket(bucket: Column, bounds: list[tuple[int, int]]) -> Column:
    """The role of the first (upper bound, role) above the bucket."""
    return reduce(lambda out, b: out.when(bucket < b[0], b[1]), bounds, F).otherwise(F.lit(None).cast("int"))


def buffered(places: DataFrame, role: Column, radius_km: float, key: str) -> DataFrame:
    """``places`` with a role; training places nearer than the radius to a place of another role are excluded.

    ``places`` has key, lat and lon, one row a place.
    """
    dealt = places.withColumn("role", role)
    train = dealt.where(F.col("role") == TRAIN)
    other = dealt.where(F.col("role") != TRAIN).select(F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    kept = outside_buffer(train, other, radius_km, key).select(key, F.lit(True).alias("_kept"))
    out = dealt.join(kept, key, "left")
    return out.withColumn("role", F.when((F.col("role") == TRAIN) & F.col("_kept").isNull(), EXCLUDED).otherwise(F.col("role"))).drop("_kept")


def disjointness(dealt: DataFrame, key: str, block: str, radius_km: float) -> DataFrame:
    """One row: keys and blocks that stand in several roles, and training rows nearer than the radius to another role.

    ``dealt`` has key, block, role, lat and lon, a row for each key and role; excluded rows take no part.
    """
    kept = dealt.where(F.col("role") != EXCLUDED)
    several = lambda c, n: kept.groupBy(c).agg(F.count_distinct("role").alias("_n")).agg(F.count("*").alias(f"{n}s"), F.count_if(F.col("_n") > 1).alias(f"shared_{n}s"))
    other = kept.where(F.col("role") != TRAIN).select(F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    train = kept.where(F.col("role") == TRAIN).select(key, "lat", "lon")
    close = within_km(train, other, radius_km).where(F.col("km") < radius_km).agg(F.count_distinct(key).alias("close"))
    return several(key, "key").join(F.broadcast(several(block, "block")), F.lit(True)).join(F.broadcast(close), F.lit(True))


def two_folds(places: DataFrame, salt: str, scale: int, assess: int, select: int, calibrate: int, radius_km: float, key: str) -> list[DataFrame]:
    """Two folds over salted block buckets; fold f assesses [f*assess, (f+1)*assess)."""
    bucket = sha_bucket(F.concat(F.lit(f"{salt}:"), block_id(F.col("lat"), F.col("lon"), scale)), 100)
    out = []
    for f in (0, 1):
        own = (bucket >= f * assess) & (bucket < (f + 1) * assess)
        first = 2 * assess
        role = F.when(own, ASSESS).when((bucket >= first) & (bucket < first + select), CHECK).when((bucket >= first + select) & (bucket < first + select + calibrate), CALIBRATE).otherwise(TRAIN)
        out.append(buffered(places, role, radius_km, key).withColumn("fold", F.lit(f)))
    return out


def greedy_roles(blocks: DataFrame, shares: dict[int, float]) -> DataFrame:
    """Roles for blocks (block, n), largest first, each to the role furthest below its share.

    The choice is sequential over blocks.  They are one aggregate row each and at most MOST_BLOCKS (the cells of one
    degree); more are an error, not cut off.
    """
    if blocks.count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks: choose coarser ones")
    total = {r: 0.0 for r in shares}
    dealt = []
    for block, n in blocks.orderBy(F.desc("n"), F.sha2("block", 256)).select("block", "n").collect():
        role = min(shares, key=lambda r: ((total[r] + n) / shares[r], r))
        total[role] += n
        dealt.append((block, role))
    return blocks.sparkSession.createDataFrame(dealt, "block string, role int")


def shared_keys(dealt: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one role; empty where roles are disjoint."""
    return dealt.groupBy(key).agg(F.count_distinct("role").alias("roles")).where("roles > 1")


def holdout_audit(surveys: DataFrame, pairs: DataFrame, by: str, low: float, high: float, unseen: float, wanted: float) -> DataFrame:
    """Each value of ``by`` as a hold-out: share of surveys, share of its species seen nowhere else, rank of eligibility."""
    total = surveys.agg(F.count("*").alias("total"))
    sizes = surveys.groupBy(by).agg(F.count("*").alias("n"))
    placed = pairs.join(surveys.select("survey", by), "survey").select(by, "species").distinct()
    spread = placed.groupBy("species").agg(F.count("*").alias("places"))
    own = placed.join(spread, "species").groupBy(by).agg(F.count("*").alias("species"), F.count_if(F.col("places") == 1).alias("alone"))
    out = sizes.join(own, by, "left").na.fill(0, ["species", "alone"]).join(F.broadcast(total), F.lit(True))
    out = out.select(by, "n", (F.col("n") / F.col("total")).alias("share"), (F.col("alone") / F.greatest("species", F.lit(1))).alias("unseen"))
    out = out.withColumn("eligible", F.col("share").between(low, high) & (F.col("unseen") <= unseen))
    order = Window.partitionBy("eligible").orderBy(F.abs(F.col("share") - wanted), "unseen", by)
    return out.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order)))
