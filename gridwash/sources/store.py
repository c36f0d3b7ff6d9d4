"""A store of original and cleaned tables with their metadata.

Every table has a folder of its own, dataset=/sheet=/stage=/id=, and its own columns;
reading one table lists and reads that folder only. Metadata is an append-only JSON log; the latest
record per table wins.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridwash.functions import cells

STAGES = ("uploads", "cleaned")
_META = "dataset string, sheet string, id string, kind string, ts timestamp, body string"


def sanitize_name(c) -> Column:
    """Drop .xlsx / .xls, other characters to ``_``, squeeze and strip ``_``."""
    text = F.regexp_replace(cells.column(c), r"(\.xlsx|\.xls)$", "")
    text = F.regexp_replace(text, r"(?U)[^\w\-]", "_")
    return F.regexp_replace(F.regexp_replace(text, r"_+", "_"), r"^_+|_+$", "")


def _sheet_folder(sheet: Column) -> Column:
    return F.when(sheet.isNull() | (sheet == ""), "default_sheet").otherwise(sanitize_name(sheet))


def stage_path(dataset, sheet, stage: str, id_) -> Column:
    """``dataset/sheet/stage/id.ext`` of one stored object."""
    ext = ".json" if stage == "metadata" else ".xlsx"
    return F.concat(
        sanitize_name(dataset), F.lit("/"), _sheet_folder(cells.column(sheet)), F.lit(f"/{stage}/"), cells.column(id_), F.lit(ext)
    )


def clean_name(name: str) -> str:
    """:func:`sanitize_name` of one name; a clean name stays as it is."""
    text = re.sub(r"[^\w\-]", "_", re.sub(r"(\.xlsx|\.xls)$", "", name))
    return re.sub(r"^_+|_+$", "", re.sub(r"_+", "_", text))


def _folder(root: str, dataset: str, sheet: str | None, stage: str, id_: str | None = None) -> str:
    sheet = clean_name(sheet) if sheet else "default_sheet"
    path = f"{root}/tables/dataset={clean_name(dataset)}/sheet={sheet}/stage={stage}"
    return path if id_ is None else f"{path}/id={quote(id_, safe='')}"


def write_stage(df: DataFrame, root: str, dataset: str, sheet: str, stage: str, id_: str) -> None:
    """Store a table; the same (dataset, sheet, stage, id) is replaced, others stay.

    A cleaned table also stamps ``last_cleaned`` in the metadata.
    """
    df.write.mode("overwrite").parquet(_folder(root, dataset, sheet, stage, id_))
    if stage == "cleaned":
        stamp = df.sparkSession.range(1).select(
            F.to_json(F.struct(F.current_timestamp().alias("last_cleaned"))).alias("body")
        )
        write_metadata(stamp, root, dataset, sheet, id_, "stamp")


def _table_folders(spark: SparkSession, stage: str) -> list[str]:
    """Folders of the tables in a stage: names only, on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stage}/id=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [] if f.isDirectory())


def read_stage(
    spark: SparkSession, root: str, dataset: str, sheet: str, stage: str, id_: str | None = None
) -> DataFrame:
    """One stored table with its own columns, by raw or clean names.

    Without ``id_`` all tables of the stage together: columns that a table lacks are
    null, and a column that has different types in them is read as text. Tables of equal
    columns are one scan; names are compared without regard to case.
    """
    if id_ is not None:
        return spark.read.parquet(_folder(root, dataset, sheet, stage, id_))
    base = _folder(root, dataset, sheet, stage)
    alike: dict[tuple, tuple] = {}
    for folder in _table_folders(spark, base):
        schema = spark.read.parquet(folder).schema
        key = tuple((f.name, f.dataType.simpleString()) for f in schema)
        alike.setdefault(key, (schema, []))[1].append(folder)
    if not alike:
        raise FileNotFoundError(f"no table in {base}")
    kinds: dict[str, set] = {}
    names: dict[str, str] = {}
    for key in alike:
        for name, kind in key:
            kinds.setdefault(name.lower(), set()).add(kind)
            names.setdefault(name.lower(), name)
    out = None
    for schema, folders in alike.values():
        table = spark.read.schema(schema).parquet(*folders)
        own = {f.name.lower(): f.name for f in schema}
        chosen = [
            (cells.column(own[n]).cast("string") if len(kinds[n]) > 1 else cells.column(own[n])).alias(names[n]) for n in own
        ]
        part = table.select(*chosen)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_metadata(body: DataFrame, root: str, dataset: str, sheet: str, id_: str, kind: str = "document") -> None:
    """Append one JSON document (a one-column ``body`` table) for a stored table."""
    body.select(
        sanitize_name(F.lit(dataset)).alias("dataset"),
        _sheet_folder(F.lit(sheet)).alias("sheet"),
        F.lit(id_).alias("id"),
        F.lit(kind).alias("kind"),
        F.current_timestamp().alias("ts"),
        "body",
    ).write.mode("append").json(f"{root}/metadata")


def latest(log: DataFrame, keys, ts: str = "ts") -> DataFrame:
    """The newest record per key; each task keeps one row per key before the shuffle.

    Of records of one instant the one that is last as JSON text is taken.
    """
    tie = F.to_json(F.struct(*[cells.column(c) for c in log.columns])).desc()
    w = Window.partitionBy(*[cells.column(k) for k in keys]).orderBy(cells.column(ts).desc(), tie)
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_metadata(spark: SparkSession, root: str) -> DataFrame:
    """dataset, sheet, id, body, last_cleaned: the latest document and stamp per table."""
    log = latest(spark.read.schema(_META).json(f"{root}/metadata"), ["dataset", "sheet", "id", "kind"])
    stamp = F.get_json_object("body", "$.last_cleaned")
    return log.groupBy("dataset", "sheet", "id").agg(
        F.max(F.when(F.col("kind") == "document", F.col("body"))).alias("body"),
        F.max(F.when(F.col("kind") == "stamp", stamp)).alias("last_cleaned"),
    )


def parse_objects(objects: DataFrame, path: str = "path") -> DataFrame:
    """Add dataset, sheet, stage and id (extension dropped) from object paths."""
    parts = F.split(cells.column(path), "/")
    return objects.select(
        "*",
        F.get(parts, F.lit(0)).alias("dataset"),
        F.get(parts, F.lit(1)).alias("sheet"),
        F.get(parts, F.lit(2)).alias("stage"),
        F.regexp_replace(F.get(parts, F.lit(3)), r"\.[^.]*$", "").alias("id"),
    )


def list_datasets(objects: DataFrame) -> DataFrame:
    """id, dataset, sheet, path of every table with a metadata object."""
    found = parse_objects(objects).where(
        (F.col("stage") == "metadata") & F.col("path").endswith(".json")
    )
    return (
        found.select("id", "dataset", "sheet")
        .distinct()
        .withColumn("path", F.concat_ws("/", "dataset", "sheet"))
    )


def dataset_info(objects: DataFrame) -> DataFrame:
    """Per (dataset, sheet, id): which stages exist and their sizes."""
    parsed = parse_objects(objects)

    def size(stage):
        return F.sum(F.when(F.col("stage") == stage, F.col("length")))

    out = parsed.groupBy("dataset", "sheet", "id").agg(
        size("uploads").alias("original_file_size"),
        size("cleaned").alias("cleaned_file_size"),
        size("metadata").alias("_meta"),
    )
    return out.select(
        "id",
        "dataset",
        "sheet",
        F.col("original_file_size").isNotNull().alias("original_file_exists"),
        F.col("cleaned_file_size").isNotNull().alias("cleaned_file_exists"),
        F.col("_meta").isNotNull().alias("metadata_exists"),
        "original_file_size",
        "cleaned_file_size",
    )


def object_listing(spark: SparkSession, root: str, depth: int = 4) -> DataFrame:
    """path (relative to the root) and length of stored files, without reading them."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )
    return files.withColumn(
        "path", F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/")
    )


def upload_records(uploads: DataFrame, file: str, sheet: str) -> DataFrame:
    """id, filename, sheets, n_sheets, uploaded_at: one record per uploaded file."""
    return (
        uploads.groupBy(cells.column(file).alias("filename"))
        .agg(F.array_sort(F.collect_set(cells.column(sheet))).alias("sheets"))
        .select(
            F.uuid().alias("id"),
            "filename",
            "sheets",
            F.size("sheets").alias("n_sheets"),
            F.current_timestamp().alias("uploaded_at"),
        )
    )
