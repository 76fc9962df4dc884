"""Published versions: Parquet partitions by dataset and version, and a manifest that readers go by.

Data is written first and the manifest row last, so a reader never sees half a version. A revision writes
only what it changes and names the version that holds the rest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "dataset_id string, layout_version string, geometry_version string, status string, created_at timestamp, updated_at timestamp"


def digest(df: DataFrame) -> str:
    """A text of the contents of a table: rows are hashed where they are, so neither row order nor partitioning matters."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    rows = df.select(F.xxhash64(row).alias("h0"), F.xxhash64(F.lit(1), row).alias("h1"))
    # Pieces of 22 bits: a long holds the sum of 2^41 of them.
    folded = [F.sum(F.shiftrightunsigned(h, 22 * k).bitwiseAND(F.lit((1 << 22) - 1))) for h in ("h0", "h1") for k in range(3)]
    return ",".join(str(x) for x in rows.agg(F.count(F.lit(1)), *folded).first())


def version_of(digests: dict[str, str], options: str = "") -> str:
    """16 hex digits of the contents that the digests of tables stand for."""
    return hashlib.sha256("|".join([options, *(f"{name}:{digests[name]}" for name in sorted(digests))]).encode()).hexdigest()[:16]


def layout_version(tables: dict[str, DataFrame], options: str = "") -> str:
    """16 hex digits of the contents."""
    return version_of({name: digest(df) for name, df in tables.items()}, options)


def write_version(tables: dict[str, DataFrame], root: str, dataset_id: str, version: str) -> None:
    for name, df in tables.items():
        df.withColumns({"dataset_id": F.lit(dataset_id), "layout_version": F.lit(version)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "layout_version").parquet(f"{root}/{name}")


def publish(spark: SparkSession, root: str, dataset_id: str, version: str, status: str = "ready", geometry_version: str | None = None) -> None:
    row = spark.range(1).select(F.lit(dataset_id).alias("dataset_id"), F.lit(version).alias("layout_version"), F.lit(geometry_version or version).alias("geometry_version"), F.lit(status).alias("status"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    row.write.mode("append").parquet(f"{root}/manifest")


def is_published(spark: SparkSession, root: str, dataset_id: str, version: str) -> bool:
    """Whether the manifest has the version as ready or degraded, and not cleared since."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return False
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where((F.col("dataset_id") == dataset_id) & (F.col("layout_version") == version))
    last = rows.agg(F.max_by("status", "updated_at")).first()[0]
    return last in ("ready", "degraded")


def latest_version(manifest: DataFrame) -> DataFrame:
    """(dataset_id, layout_version) of the newest ready or degraded version of each dataset."""
    rows = manifest.where("status in ('ready', 'degraded')")
    return rows.groupBy("dataset_id").agg(F.max_by("layout_version", F.struct("updated_at", "created_at", "layout_version")).alias("layout_version"))


def read_version(spark: SparkSession, root: str, name: str, dataset_id: str, version: str, schema: str | None = None) -> DataFrame:
    """One table of a published version: Spark prunes all other partitions. A table without any row needs its schema."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, dataset_id string, layout_version string")
    return reader.parquet(f"{root}/{name}").where((F.col("dataset_id") == dataset_id) & (F.col("layout_version") == version)).drop("dataset_id", "layout_version")


def geometry_of(spark: SparkSession, root: str, dataset_id: str, version: str) -> str:
    """The version whose geometry a version shares, by its last manifest row."""
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where((F.col("dataset_id") == dataset_id) & (F.col("layout_version") == version))
    return rows.agg(F.max_by("geometry_version", "updated_at")).first()[0]


def read_geometry(spark: SparkSession, root: str, name: str, dataset_id: str, version: str) -> DataFrame:
    """A geometry table of a version, from the version that its manifest row names."""
    return read_version(spark, root, name, dataset_id, geometry_of(spark, root, dataset_id, version))


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    """Whether any version under root has written the table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def clear(spark: SparkSession, root: str, tables: list[str], dataset_id: str, version: str | None = None) -> None:
    """Drops the partitions of a dataset, or of one version; its manifest rows are marked as gone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in tables:
        at = f"{root}/{name}/dataset_id={dataset_id}" + (f"/layout_version={version}" if version else "")
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where(F.col("dataset_id") == dataset_id)
    rows = rows.where(F.col("layout_version") == version) if version else rows
    for r in rows.select("layout_version").distinct().collect():
        publish(spark, root, dataset_id, r["layout_version"], status="cleared")


def replace_annotations(spark: SparkSession, root: str, dataset_id: str, version: str, annotations: DataFrame) -> str:
    """Publishes annotations (node_id, key, value) under a new version that shares the geometry of the old one; the same contents give the same version."""
    nodes = read_geometry(spark, root, "nodes", dataset_id, version)
    if annotations.groupBy("node_id", "key").count().where("count > 1").limit(1).count():
        raise ValueError("a node has two values of one key")
    if not annotations.join(nodes, "node_id", "left_semi").limit(1).count():
        raise ValueError("no annotation matches a node")
    new = layout_version({"annotations": annotations}, f"{dataset_id}/{version}")
    known = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where((F.col("dataset_id") == dataset_id) & (F.col("layout_version") == new) & (F.col("status") == "ready"))
    if not known.limit(1).count():
        row = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where((F.col("dataset_id") == dataset_id) & (F.col("layout_version") == version)).first()
        write_version({"annotations": annotations}, root, dataset_id, new)
        publish(spark, root, dataset_id, new, geometry_version=row["geometry_version"])
    return new


def read_annotations(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV or TSV table with a header; without sep, a tab in the first line means TSV."""
    if sep is None:
        first = spark.read.text(path).first()
        sep = "\t" if first is not None and "\t" in first[0] else ","
    return spark.read.csv(path, header=True, sep=sep, escape='"', multiLine=True)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(isolate_id, input_pos, alleles) of a TSV matrix with a header: ids unique, no cell empty, rows as wide as the header, at least one locus and row.

    input_pos grows along each file; over several files it is no order of the whole.
    """
    head = spark.read.csv(path, header=True, sep="\t", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).columns
    schema = ", ".join(f"`{k}` string" for k in range(len(head)))
    raw = spark.read.csv(path, header=True, sep="\t", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema=f"{schema}, _corrupt string", enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    names = [c.lstrip("﻿").strip() for c in head]
    if len(names) < 2 or len(set(names)) < len(names) or not all(names):
        raise ValueError("a matrix has an id column and uniquely named loci")
    rows = raw.toDF(*names, "_corrupt").withColumn("input_pos", F.monotonically_increasing_id())
    out = rows.select(F.trim(F.col(f"`{names[0]}`")).alias("isolate_id"), "input_pos", F.array(*(F.trim(F.col(f"`{c}`")) for c in names[1:])).alias("alleles"), "_corrupt")
    bad = out.agg(F.count("_corrupt").alias("ragged"), F.count(F.lit(1)).alias("n"), F.count_if(F.exists("alleles", lambda a: a.isNull() | (a == ""))).alias("empty"), (F.count("isolate_id") - F.count_distinct("isolate_id")).alias("twice")).first()
    if not bad["n"] or bad["empty"] or bad["twice"] or bad["ragged"]:
        raise ValueError(f"rows {bad['n']}, rows with empty cells {bad['empty']}, repeated ids {bad['twice']}, rows of another width {bad['ragged']}")
    return out.drop("_corrupt")


def read_observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """Grouped statistics or an edge list as CSV with a header, or as JSON lines."""
    (df.write.mode("overwrite").option("header", "true").option("escape", '"').csv if form == "csv" else df.write.mode("overwrite").json)(path)
