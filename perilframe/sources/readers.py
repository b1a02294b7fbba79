"""Reading points, records, footprints and property rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "x double, y double, z double, classification int, intensity int, tile string"
RECORDS = "station string, date string, datatype string, value double, seq long"
ELEMENTS = "elements array<struct<type: string, id: long, lon: double, lat: double, nodes: array<bigint>, tags: map<string,string>>>"


def read_points(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(POINTS).format(form).load(path)


def list_tiles(spark: SparkSession, path: str, glob: str = "*.la[sz]") -> DataFrame:
    """(path, length, name) of all tile files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("name"))


def tile_manifest(spark: SparkSession, path: str, glob: str = "*", least: int = 1000) -> DataFrame:
    """(name, md5, length) of the files of more than ``least`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).where(F.col("length") > least)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("md5"), "length")


def label_of(path: Column) -> Column:
    """A file's label is its folder's name."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def labelled_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, label) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", label_of(F.col("path")).alias("label"))


def labelled_classes(manifest: DataFrame, classes: DataFrame) -> DataFrame:
    """manifest (path, label) with the class (label, class_id) of each file; files of other folders go."""
    return manifest.join(F.broadcast(classes.select("label", "class_id")), "label")  # classes are a fixed table


def class_counts(manifest: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, label, files) of every class, 0 for one without files."""
    files = labelled_classes(manifest, classes).groupBy("class_id").agg(F.count(F.lit(1)).alias("_n"))
    return classes.join(files, "class_id", "left").select("class_id", "label", F.coalesce("_n", F.lit(0)).cast("long").alias("files"))


def not_yet(index: DataFrame, have: DataFrame, key: str = "filename") -> DataFrame:
    """Index rows with an address that aren't present yet."""
    return index.where(F.coalesce("download_url", "url").isNotNull()).join(have.select(key), key, "left_anti")


def no_sentinel(z: Column, below: float = -9000.0) -> Column:
    """Sentinels, NaN and infinities as null."""
    return F.when((z < below) | F.isnan(z) | (F.abs(z) == float("inf")), F.lit(None)).otherwise(z)


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pages of records: JSON arrays, one to a file, or one to a line, so that large files are split."""
    return spark.read.schema(RECORDS).option("multiLine", not lines).json(path)


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, x, y) and ways (id, nodes, tags) of map extracts."""
    e = spark.read.schema(ELEMENTS).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    nodes = e.where("e.type = 'node'").select("e.id", F.col("e.lon").alias("x"), F.col("e.lat").alias("y"))
    return nodes, e.where("e.type = 'way'").select("e.id", "e.nodes", "e.tags")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The properties of each feature, by a schema, with ``rings``, all rings of its Polygon or MultiPolygon, and ``ring``, the first of them; null for other geometries."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    parsed = F.when(kind == "Polygon", F.from_json(text, "array<array<array<double>>>")).when(kind == "MultiPolygon", F.flatten(F.from_json(text, "array<array<array<array<double>>>>")))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    out = f.select("f.properties.*", F.transform(parsed, lambda r: F.transform(r, point)).alias("rings"))
    return out.withColumn("ring", F.get("rings", F.lit(0)))


def read_twins(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Known fields of property documents; documents that don't parse go."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(parsed.alias("r")).where("r is not null and r._bad is null").select("r.*").drop("_bad")


def first_available(candidates: list[tuple[str, DataFrame | None]], key: str) -> DataFrame:
    """Rows of the candidate that comes first for each key, with its name as ``origin``."""
    some = [df.withColumn("origin", F.lit(name)).withColumn("_p", F.lit(p)) for p, (name, df) in enumerate(candidates) if df is not None]
    out = some[0]
    for df in some[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    best = out.groupBy(key).agg(F.min("_p").alias("_p"))
    return out.join(best, [key, "_p"]).drop("_p")


def train_val_split(df: DataFrame, key: str, share: int = 85) -> DataFrame:
    """df with ``split``, by the first 32 bits of the key's md5: the same in every run and engine."""
    part = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(part < share, "train").otherwise("validation"))


def constant_layers(spark: SparkSession, rows: int, cols: int, values: dict[str, float]) -> DataFrame:
    """Layers of one value each over a grid."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return cells.select("row", "col", *(F.lit(float(v)).alias(p) for p, v in values.items())).unpivot(["row", "col"], list(values), "product", "value")


def read_config_dims(spark: SparkSession, path: str, section: str) -> DataFrame:
    """(name, setting, value string) of a section of a JSON or YAML file; settings right below it have a null name.

    Settings that are lists or have parts of their own are JSON. YAML needs its parser installed.
    """
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml

        content = yaml.safe_load(text)
    else:
        content = json.loads(text)
    said = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, default=str)
    rows = []
    for name, settings in ((content or {}).get(section) or {}).items():
        rows += [(name, k, said(v)) for k, v in settings.items()] if isinstance(settings, dict) else [(None, name, said(settings))]
    return spark.createDataFrame(rows, "name string, setting string, value string")


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, wind_mph, wind_dir, m1), as the operators of fire take them; what a scenario leaves out is null."""
    setting = lambda name: F.max(F.when(F.col("setting") == name, F.col("value").try_cast("double")))
    return read_config_dims(spark, path, "scenarios").where("name is not null").groupBy(F.col("name").alias("scenario")).agg(
        setting("wind_speed_mph").alias("wind_mph"), setting("wind_direction_deg").alias("wind_dir"), setting("fuel_moisture_1hr").alias("m1"))
