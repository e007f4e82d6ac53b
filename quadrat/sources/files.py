"""Files as tables: pruned CSV scans, header checks, schema probes and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan_csv(spark: SparkSession, path: str, schema: StructType | str, columns: list[str]) -> DataFrame:
    """Only ``columns`` of a CSV with a header, parsed by an explicit schema; an absent column is an error."""
    require(spark, path, columns)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).select(*columns)


def require(spark: SparkSession, path: str, columns: list[str]) -> None:
    """Raise unless the header has all ``columns``; reads the header alone."""
    have = spark.read.option("header", True).csv(path).columns
    absent = sorted(set(columns) - set(have))
    if absent:
        raise ValueError(f"{path} has no {absent}")


def describe(df: DataFrame) -> dict[str, str]:
    """Column names and types, no values."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and kind of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.lower("path")
    kind = F.when(path.contains("landsat"), "landsat").when(path.contains("sentinel") | path.endswith(".tiff"), "raster").when(path.contains("bioclim") | path.contains("climat"), "climate").when(path.endswith(".parquet") | path.endswith(".csv"), "table").otherwise("other")
    return files.select("path", F.col("length").alias("bytes"), kind.alias("kind"))


def data_card(spark: SparkSession, folder: str, path: str) -> None:
    """Write the inventory of a folder as sorted JSON lines: path below the folder, kind, bytes, and columns and types of Parquet tables.

    Schemas are read from footers, one table at a time; no values are.
    """
    root = folder.rstrip("/") + "/"
    own = inventory(spark, folder).withColumn("name", F.element_at(F.split("path", root, 2), -1))
    tables = own.where(F.col("path").endswith(".parquet")).select(F.regexp_extract("path", r"^(.*?\.parquet)", 1).alias("table")).distinct().collect()
    columns = [(r["table"], ", ".join(f"{n} {t}" for n, t in describe(spark.read.parquet(r["table"])).items())) for r in tables]
    known = spark.createDataFrame(columns, "table string, columns string")
    card = own.withColumn("table", F.regexp_extract("path", r"^(.*?\.parquet)", 1)).join(F.broadcast(known), "table", "left")
    card.select("name", "kind", "bytes", "columns").orderBy("name").write.json(path)


def pair_by_name(files: DataFrame) -> DataFrame:
    """Train and test tables of the same family: names equal once role and separators are taken out."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.[a-z0-9]+$", "")
    role = F.when(stem.rlike(r"(^|[-_])train([-_]|$)"), "train").when(stem.rlike(r"(^|[-_])test([-_]|$)"), "test")
    family = F.regexp_replace(F.regexp_replace(stem, r"(^|[-_])(train|test)([-_]|$)", "-"), r"[^a-z0-9]", "")
    named = files.select("path", role.alias("role"), family.alias("family")).where("role is not null")
    train, test = (named.where(F.col("role") == r).select("family", F.col("path").alias(r)) for r in ("train", "test"))
    return train.join(test, "family")


def band_order(names: list[str]) -> list[int]:
    """Places of the red, green, blue and near-infrared bands among band names; raises unless each stands once."""
    keys = [n.strip().lower() for n in names]
    out = []
    for wanted in (("red", "b04", "b4"), ("green", "b03", "b3"), ("blue", "b02", "b2"), ("nir", "b08", "b8")):
        places = [i for i, k in enumerate(keys) if k in wanted]
        if len(places) != 1:
            raise ValueError(f"band {wanted[0]} stands {len(places)} times")
        out.append(places[0])
    return out
