"""File readers and writers of the item domain."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import dealt, latest

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "heic")
PROVENANCE = ("file", "title", "page_url", "license", "license_url", "artist", "credit", "restrictions", "date", "width", "height", "sha1", "seed")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of the folder's image files, by suffix in any case, sorted by path; the content is read only if it is used.

    A folder that is missing or has no image is an error.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = spark.read.format("binaryFile").load(folder).where(suffix.isin(*IMAGE_SUFFIXES)).select("path", "length", "content")
    if not found.select("path").limit(1).count():
        raise FileNotFoundError(f"no image in {folder}")
    return found.orderBy("path")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): the whole numbers of a text file, apart by white space."""
    words = F.explode(F.split("value", r"\s+")).alias("w")
    return spark.read.text(path).select(words).where("w <> ''").select(F.col("w").cast("long").alias("id"))


def labels(spark: SparkSession, folder: str, value: str) -> DataFrame:
    """(item, station, labels, front, back, fields of value) of station*/**/labels_<item>.json below a folder; the pictures lie beside the labels."""
    rows = spark.read.schema(value).option("recursiveFileLookup", "true").option("pathGlobFilter", "labels_*.json").json(folder, multiLine=True)
    at = F.col("_at")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_at"))
    item, near = F.regexp_extract(at, r"/labels_([^/]*)\.json$", 1), F.regexp_replace(at, "/[^/]*$", "")
    station = F.regexp_extract(at, r"/(station[^/]*)/", 1)
    fields = [c for c in rows.columns if c != "_at"]
    out = rows.select(item.alias("item"), station.alias("station"), at.alias("labels"), *(F.concat(near, F.lit(f"/{side}_"), item, F.lit(".jpg")).alias(side) for side in ("front", "back")), *fields)
    return out.where("station <> ''")


def is_jpeg(content: Column) -> Column:
    return F.substring(content, 1, 2) == F.lit(b"\xff\xd8")


def coco(spark: SparkSession, path: str, schema: T.StructType | str) -> dict[str, DataFrame]:
    """The arrays of one document as tables."""
    doc = spark.read.schema(schema).json(path, multiLine=True)
    tables = [f.name for f in doc.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return {name: doc.select(F.explode(name).alias("r")).select("r.*" if isinstance(doc.schema[name].dataType.elementType, T.StructType) else "r") for name in tables}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def coco_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str) -> dict[str, DataFrame]:
    """The arrays of the documents of all splits as tables with a column split; a split whose file is absent is left out."""
    out: dict[str, DataFrame] = {}
    for split, path in paths.items():
        if _exists(spark, path):
            for name, rows in coco(spark, path, schema).items():
                rows = rows.withColumn("split", F.lit(split))
                out[name] = out[name].unionByName(rows, allowMissingColumns=True) if name in out else rows
    return out


def annotation_store(tables: dict[str, DataFrame]) -> DataFrame:
    """(file, ann_id, category, annotation columns): annotations by file and id, as ids alone are not unique over splits."""
    by = ["split"] if "split" in tables["annotations"].columns else []
    names = tables["images"].select(*by, F.col("id").alias("image_id"), F.col("file_name").alias("file"))
    kinds = tables["categories"].select(*by, F.col("id").alias("category_id"), F.col("name").alias("category"))
    return tables["annotations"].withColumnRenamed("id", "ann_id").join(names, [*by, "image_id"]).join(kinds, [*by, "category_id"])


def garments(store: DataFrame, wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """The store's annotations of the wanted files (file) whose category is a garment."""
    return store.where(F.col("category").isin(*names)).join(wanted.select("file").distinct(), "file", "left_semi")


def url_base_name(url: Column) -> Column:
    return F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)


def filter_coco(tables: dict[str, DataFrame], license_ids: Sequence[int], category_ids: Sequence[int], drop_empty: bool = False) -> dict[str, DataFrame]:
    """Images of allowed licences, wanted categories, annotations of both; drop_empty: only images that keep an annotation."""
    found = tables["images"].where(F.col("license").isin(*license_ids))
    kinds = tables["categories"].where(F.col("id").isin(*category_ids))
    # wanted annotations are dealt out by image before they meet images; a join and not a semi-join, which would go below whatever the annotations are made of
    wanted = dealt(tables["annotations"].where(F.col("category_id").isin(*category_ids)), "image_id")
    notes = wanted.join(found.select(F.col("id").alias("image_id")).distinct(), "image_id").select(*tables["annotations"].columns)
    if drop_empty:
        found = found.join(notes.select(F.col("image_id").alias("id")), "id", "left_semi")
    if "coco_url" in found.columns:
        found = found.withColumn("file_name", F.coalesce(F.nullif(url_base_name(F.col("coco_url")), F.lit("")), F.col("file_name") if "file_name" in found.columns else F.lit(None)))
    for ids in ("neg_category_ids", "not_exhaustive_category_ids"):
        if ids in found.columns:
            found = found.withColumn(ids, F.filter(ids, lambda x: x.isin(*category_ids)))
    return {**tables, "images": found, "categories": kinds, "annotations": notes}


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, split: str | None = None) -> DataFrame:
    """JSON lines; unknown keys are ignored, missing ones null, blank lines dropped."""
    rows = spark.read.schema(schema).json(path)
    return rows if split is None else rows.where(F.col("split") == split)


def text_csv(spark: SparkSession, path: str, key: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, all columns text, a byte order mark accepted; with key, the last row of a key wins."""
    rows = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    if key is None:
        return rows
    # by file, then by place within it: rows of a file keep their order, parts of one come in the order of their blocks
    at = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return latest(at, list(key), [F.col("_file"), F.col("_block"), F.col("_at")]).select(*rows.columns)


def segment_rows(spark: SparkSession, path: str, classes: dict[str, tuple[str, str]], key: str = "LabelName") -> DataFrame:
    """CSV rows of known classes with label and coarse. classes: code -> (label, coarse), a short fixed table."""
    known = spark.createDataFrame([(k, *v) for k, v in classes.items()], f"{key} string, label string, coarse string")
    return text_csv(spark, path).join(F.broadcast(known), key)


def info_rows(spark: SparkSession, path: str, ids: DataFrame, key: str = "ImageID") -> DataFrame:
    """CSV rows whose key is among ids (key), the last of each."""
    return text_csv(spark, path, [key]).join(ids.select(key).distinct(), key, "left_semi")


def human_review(spark: SparkSession, path: str) -> DataFrame:
    """(file, item, verdict) of a review sheet: verdicts 0 and 1 only, the last of each item."""
    return text_csv(spark, path, ["file", "item"]).where(F.col("verdict").isin("0", "1"))


def labels_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """An object of objects as rows (key, fields of value); a missing file has none."""
    if not _exists(spark, path):
        empty = spark.createDataFrame([], f"key string, v {value}")
        return empty.select("key", "v.*")
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v")).select("key", "v.*")


def states(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Saved states below a folder, sorted by path; a corrupt file, and one without a field that may not be null, counts as none."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(wide).option("recursiveFileLookup", "true").option("pathGlobFilter", "state.json").json(path, multiLine=True, mode="PERMISSIVE")
    whole = F.col("_corrupt_record").isNull()
    for f in schema.fields:
        if not f.nullable:
            whole = whole & F.col(f.name).isNotNull()
    return rows.select("*", F.col("_metadata.file_path").alias("path")).where(whole).drop("_corrupt_record").orderBy("path")


def zip_members(archives: DataFrame, wanted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, content) of the members of zip files (path, content) whose base name is in wanted (name) and not in existing (name).

    An archive is one value of a row, so it must fit a task; its members are taken out one at a time.
    """
    if existing is not None:
        wanted = wanted.select("name").join(existing.select("name"), "name", "left_anti")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"name": [posixpath.basename(info.filename)], "content": [z.read(info)]})

    return archives.select("content").mapInPandas(read, "name string, content binary").join(wanted.select("name").distinct(), "name", "left_semi")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Every part file has its header, as parts are read alone; text_csv takes each once."""
    rows.write.mode("append").csv(path, header=True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file systems, so that any store will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_report(spark: SparkSession, folder: str, title: str, data: dict, body: str) -> None:
    """report.json and report.md: a summary's few values, not rows."""
    _write_text(spark, f"{folder}/report.json", json.dumps(data, ensure_ascii=False, indent=2))
    _write_text(spark, f"{folder}/report.md", f"# {title}\n\n{body}\n")


def label_template(files: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A sheet for people: file and empty columns, with the byte order mark that office programs want. One file, so that it is one sheet."""
    listed = [r["file"] for r in files.select("file").orderBy("file").toLocalIterator()]
    out = io.StringIO(newline="")
    sheet = csv.writer(out)
    sheet.writerow(columns)
    sheet.writerows([f, *[""] * (len(columns) - 1)] for f in listed)
    _write_text(files.sparkSession, path, "\ufeff" + out.getvalue())


def coco_document(tables: dict[str, DataFrame], coarse: dict[str, str], note: str) -> DataFrame:
    """(section, body): the filtered star as JSON, a row for each element, with coarse in the categories and the note as info.

    The rows of a section are the elements of its array: written as lines they are read as such, whatever their number.
    """
    from ..functions.rules import lookup

    kinds = tables["categories"].withColumn("coarse", lookup(F.col("name"), coarse))
    sections = {**tables, "categories": kinds}
    out = tables["categories"].sparkSession.createDataFrame([("info", json.dumps({"note": note}, ensure_ascii=False))], "section string, body string")
    for name in ("licenses", "categories", "images", "annotations"):
        if name in sections:
            rows = sections[name]
            out = out.unionAll(rows.select(F.lit(name), F.to_json(F.struct(*rows.columns))))
    return out


#: Fields of an exported item and its schema's version.
SCHEMA_VERSION = 1


def item_metadata(items: DataFrame, cases: dict[str, str]) -> DataFrame:
    """(id, metadata): the JSON of each item. items: id, category, source, width, height, case, bbox, score, area_ratio, occlusion and what else there is."""
    from ..functions.rules import lookup

    fixed = [
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("id"), F.col("category"), F.col("source").alias("source_image"), F.array("width", "height").alias("source_size"), F.col("case"),
        F.coalesce(lookup(F.col("case"), cases), F.lit("")).alias("case_desc"), F.col("bbox"), F.bround("score", 4).alias("score"), F.bround("area_ratio", 5).alias("area_ratio"), F.bround("occlusion", 4).alias("occlusion"),
    ]
    used = {"id", "category", "source", "width", "height", "case", "bbox", "score", "area_ratio", "occlusion"}
    return items.select("id", F.to_json(F.struct(*fixed, *(F.col(c) for c in items.columns if c not in used)), {"ignoreNullFields": "false"}).alias("metadata"))


def write_pairs(pairs: DataFrame, path: str, palette: str | None = None, limit: float | None = None) -> dict[str, int]:
    """Append training pairs with an id of their own; two of one id fail, within the pairs and with what is there. Pairs over the palette limit are skipped and counted."""
    from ..functions.checks import over_limit
    from ..operators.relational import unique_or_fail

    over = over_limit(F.col(palette), limit) if palette else F.lit(False)
    spark, kept = pairs.sparkSession, unique_or_fail(pairs.where(~over), "id")
    if _exists(spark, path):
        there = spark.read.json(path).select(F.col("id").alias("_there")).distinct()
        kept = kept.join(there, F.col("id") == F.col("_there"), "left").where(F.assert_true(F.col("_there").isNull(), F.lit("an id is written already")).isNull()).drop("_there")
    kept.write.mode("append").json(path)
    return {"skipped": pairs.where(over).count()}


def write_scores(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    """scores as lines, and the summary beside them."""
    rows.write.mode("overwrite").json(f"{folder}/scores")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def create_if_absent(rows: DataFrame, path: str) -> None:
    rows.write.mode("ignore").csv(path, header=True)


def rewrite_with_backup(spark: SparkSession, path: str, rows: DataFrame, flag: str, fmt: str = "json") -> dict[str, int]:
    """Write rows beside the log, move the log to path_v0 (once) and the new one into its place; flag's counts before and after."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old, backup = fs_path(f"{path}_new"), fs_path(path), fs_path(f"{path}_v0")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    count = lambda at: spark.read.format(fmt).load(at).agg(F.count_if(F.col(flag))).first()[0]
    before = count(path)
    rows.write.mode("overwrite").format(fmt).save(f"{path}_new")
    if fs.exists(backup):
        fs.delete(old, True)
    else:
        fs.rename(old, backup)
    fs.rename(new, old)
    return {"before": before, "after": count(path)}


def relative_path(path: Column, root: str) -> Column:
    """A path below root without it; others unchanged."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def write_index(rows: DataFrame, path: str, key: str = "file") -> None:
    """Rows as JSON lines, sorted by key over all part files."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def latest_checkpoint(files: DataFrame, weights: str = "weights.bin", by: Sequence[str] = ()) -> DataFrame:
    """Of paths like dir/step-12/name the directory of the largest step that holds its weights file, for each of ``by``."""
    step = F.regexp_extract("path", r"step-(\d+)/", 1)
    complete = files.where(F.col("path").endswith(f"/{weights}") & (step != "")).select(step.cast("long").alias("step"), F.regexp_replace("path", "/[^/]+$", "").alias("dir"), *by)
    return complete.groupBy(*by).agg(F.max("step").alias("step"), F.max_by("dir", "step").alias("dir")).where("step is not null")
