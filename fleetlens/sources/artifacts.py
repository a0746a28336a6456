"""Immutable tables with a manifest: published whole, verified before they are read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.scalar import canonical_json, stable_id
from fleetlens.sources.paging import LimitExceeded


#: Rows of a file, so that each can be hashed whole, and of an exported table.
FILE_ROWS, MOST_EXPORTED = 5_000_000, 5_000_000


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0].content).decode()


def file_hashes(spark: SparkSession, folder: str, parts: list[str] | None = None) -> dict[str, str]:
    """SHA-256 of each data file by its path below the folder, computed where the files are; of the given subfolders only, if any are given."""
    paths = [folder] if parts is None else [f"{folder}/{p}" for p in parts]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths).select("path", F.sha2("content", 256).alias("hash")).collect()
    return {r.path.rsplit(folder.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1]: r.hash for r in rows}


def publish(df: DataFrame, root: str, collection: str, identity: dict, *, keys: list[str], partition_by: list[str] | None = None) -> str:
    """Writes a table in order of its keys under an id made from its identity, with a manifest last; returns the id.

    The plan runs once, into a stage; keys are checked on what was written. The stage is renamed, so a reader sees all
    of the table or nothing; one that is there already is kept. Files hold at most FILE_ROWS rows each, so that every
    one can be hashed."""
    spark = df.sparkSession
    name = stable_id(collection, identity)
    final, stage = f"{root}/{collection}/{name}", f"{root}/{collection}/.stage-{name}"
    target, fs = _path(spark, final)
    if fs.exists(_path(spark, f"{final}/manifest.json")[0]):
        return name
    writer = df.sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{stage}/data")
    rows = spark.read.schema(df.schema).parquet(f"{stage}/data")
    null = " or ".join(f"`{k}` is null" for k in keys)
    if not rows.where(null).isEmpty() or not rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        fs.delete(_path(spark, stage)[0], True)
        raise ValueError(f"keys {', '.join(keys)} are null or repeated")
    by_part = {"/".join(f"{c}={r[c]}" for c in partition_by): r.n for r in rows.groupBy(*partition_by).agg(F.count("*").alias("n")).collect()} if partition_by else {}
    manifest = {"collection": collection, "id": name, "identity": identity, "keys": keys, "partition_by": partition_by or [], "schema": df.schema.jsonValue(), "schema_hash": schema_hash(df), "rows": sum(by_part.values()) if partition_by else rows.count(), "partitions": by_part, "files": file_hashes(spark, f"{stage}/data")}
    _write_text(spark, f"{stage}/manifest.json", canonical_json(manifest).decode())
    if not fs.rename(_path(spark, stage)[0], target):
        raise OSError(f"{final} can't be put in place")
    return name


def schema_hash(df: DataFrame) -> str:
    """An id of names and types in order."""
    return stable_id("schema", [[f.name, f.dataType.simpleString()] for f in df.schema])


def manifest_of(spark: SparkSession, root: str, collection: str, name: str) -> dict:
    return json.loads(_read_text(spark, f"{root}/{collection}/{name}/manifest.json"))


def located(spark: SparkSession, root: str, name: str) -> str:
    """The collection that holds an id; none, or several, is an error."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{name}/manifest.json")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    if len(found) != 1:
        raise KeyError(f"{name} is in {len(found)} collections")
    return found[0].getPath().getParent().getParent().getName()


def open_verified(spark: SparkSession, root: str, collection: str, name: str, *, only: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """The table, or its rows of one partition value each, after what is read has been held against the manifest.

    With `only`, files of other partitions are neither hashed nor counted. Files and hashes have to agree, the number
    of rows, which Parquet's footers tell, and the schema's hash, if one is given."""
    from pyspark.sql.types import StructType

    manifest = manifest_of(spark, root, collection, name)
    data = f"{root}/{collection}/{name}/data"
    if schema is not None and schema != manifest.get("schema_hash"):
        raise ValueError(f"{name}: the schema isn't the one asked for")
    wanted = only or {}
    if set(wanted) - set(manifest["partition_by"]):
        raise KeyError(f"{name} isn't partitioned by {', '.join(sorted(set(wanted) - set(manifest['partition_by'])))}")
    inside = lambda part: all(f"{k}={v}" in part.split("/") for k, v in wanted.items())
    parts = [p for p in manifest["partitions"] if inside(p)] if wanted else None
    files = {f: h for f, h in manifest["files"].items() if not wanted or inside(f)}
    df = spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(data)
    for k, v in wanted.items():
        df = df.where(F.col(k).cast("string") == v)
    if parts == []:
        return df
    if file_hashes(spark, data, parts) != files:
        raise ValueError(f"{name}: files differ from the manifest")
    if df.count() != (sum(manifest["partitions"][p] for p in parts) if parts is not None else manifest["rows"]):
        raise ValueError(f"{name}: the number of rows differs from the manifest")
    return df


def export(df: DataFrame, path: str, kind: str = "parquet", *, most_rows: int = MOST_EXPORTED) -> None:
    """One Parquet or CSV file of a bounded table; a larger one is an error, and nothing is written."""
    if df.limit(most_rows + 1).count() > most_rows:
        raise LimitExceeded(f"more than {most_rows} rows to export")
    one = df.coalesce(1).write.mode("overwrite")
    one.option("compression", "zstd").parquet(path) if kind == "parquet" else one.option("header", True).csv(path)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text: ids keep their zeros, and an empty field isn't null."""
    return spark.read.option("header", True).option("inferSchema", False).option("emptyValue", "").option("nullValue", "\u0000").csv(path)


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of a GeoJSON file: properties as a map, and the geometry's type and coordinates as JSON."""
    raw = spark.read.option("wholetext", True).text(path)
    feature = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
    rows = raw.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
    return rows.select("f.properties", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def feature_rows(df: DataFrame, geometry: Column, properties: list[str], *, most_features: int = 10_000, most_bytes: int = 16 << 20) -> DataFrame:
    """GeoJSON features as text, one a row, of at most so many features and bytes; more of either is an error."""
    rows = df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))
    n, size = rows.limit(most_features + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("feature")), F.lit(0))).first()
    if n > most_features or size > most_bytes:
        raise LimitExceeded(f"{n} features of {size} bytes; at most {most_features} and {most_bytes} bytes are allowed")
    return rows


def point(x: str, y: str) -> Column:
    """A GeoJSON point."""
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def line(coordinates: Column) -> Column:
    """A GeoJSON line of an array of (x, y)."""
    return F.struct(F.lit("LineString").alias("type"), F.transform(coordinates, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
