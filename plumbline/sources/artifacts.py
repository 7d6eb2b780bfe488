"""JSON documents around an evaluation: read with what is missing said, indexed, and written."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import IMAGE_EXTENSIONS, extension, is_mask
from plumbline.tables import written


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of one schema; a corrupt one gives a row of nulls, a missing path no rows."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def availability(registry: DataFrame, artifacts: DataFrame, hint: str) -> DataFrame:
    """(name, available, document, message): every registered name with its artifact(name, document), or how to make it."""
    joined = registry.select("name").distinct().join(artifacts.select("name", "document"), "name", "left")
    ok = F.col("document").isNotNull()
    return joined.select("name", ok.alias("available"), "document", F.when(~ok, F.concat(F.lit("not available; "), F.lit(hint))).alias("message"))


def file_names(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(name) of matching files in order; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).orderBy("name")


def evaluated_models(spark: SparkSession, folder: str) -> DataFrame:
    return file_names(spark, folder, "*.json").select(F.regexp_replace("name", r"\.json$", "").alias("model_name"))


def described(registry: DataFrame) -> DataFrame:
    """All that is known of every model, in order of name, but for its configuration."""
    return registry.drop("config").orderBy("name")


def report_rows(df: DataFrame, drop: tuple[str, ...] = ("properties",)) -> DataFrame:
    """(document): each row as a JSON object, without the columns in drop."""
    return df.select(F.to_json(F.struct(*(F.col(c) for c in df.columns if c not in drop)), {"ignoreNullFields": "false"}).alias("document"))


def write_reports(bundle: dict[str, DataFrame], folder: str, drop: tuple[str, ...] = ("properties",)) -> list[str]:
    """Write every relation of a bundle as JSON lines below the folder, one subfolder each, over what is there.

    Rows stay distributed: a report of many cases is many files. Returns the subfolders in order of name.
    """
    for name, df in bundle.items():
        report_rows(df, drop).write.mode("overwrite").text(f"{folder}/{name}")
    return [f"{folder}/{name}" for name in sorted(bundle)]


def file_system(spark: SparkSession, path: str):
    """The file system that holds path, as Spark sees it, and what makes its paths."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """Write one small document (an index, a manifest) as indented JSON, by way of the file system Spark sees."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(json.dumps(document, indent=2, ensure_ascii=False, default=str).encode("utf-8")))
    finally:
        out.close()


def copied(files: DataFrame, target: str) -> DataFrame:
    """(class_name, path, size, sha256, same) of files (class_name, path, content), copied by tasks to target/class/name.

    target is a URI that workers reach. A copy is written under a name of its own, read again, and then takes its name, so
    tasks may run twice; same says whether what was read again is what the source held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = pafs.FileSystem.from_uri(target)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                folder = f"{root}/{r.class_name}"
                files.create_dir(folder, recursive=True)
                name = f"{folder}/{r.path.rsplit('/', 1)[-1]}"
                own = f"{folder}/.{uuid.uuid4().hex}"
                with files.open_output_stream(own) as out:
                    out.write(r.content)
                with files.open_input_stream(own) as back:
                    read = hashlib.sha256(back.read()).hexdigest()
                wanted = hashlib.sha256(r.content).hexdigest()
                files.move(own, name)
                rows.append((r.class_name, r.path, len(r.content), read, read == wanted))
            yield pd.DataFrame(rows, columns=["class_name", "path", "size", "sha256", "same"])

    return files.select("class_name", "path", "content").mapInPandas(run, "class_name string, path string, size long, sha256 string, same boolean")


def ingested(spark: SparkSession, source: str, target: str, folders: DataFrame, files: DataFrame, expected: dict[str, int], force: bool = False) -> dict:
    """Copy the images and masks of class folders (class_name, folder) into target and write its manifest.json, which is
    returned.

    Refuses a target that is not empty, unless force is set, which replaces the classes' folders, and a source without class
    folders. The source is never changed. files is the listing of the source: the manifest holds images, masks and the
    expected number of each class; checksums.parquet holds every copy's. Tasks copy the files into a folder that is not yet
    part of the set; only if every copy is there and is what the source held do the classes' folders take their places, and
    the manifest comes last. Otherwise it is an OSError, and target stays as it was.
    """
    fs, place = file_system(spark, target)
    if not force and fs.exists(place(target)) and len(fs.listStatus(place(target))):
        raise FileExistsError(f"{target} is not empty")
    found = [r["class_name"] for r in folders.select("class_name").distinct().orderBy("class_name").collect()]  # a row a class
    if not found:
        raise FileNotFoundError(f"no class folders below {source}")
    of_class = F.broadcast(folders.select(F.col("class_name"), F.regexp_replace("folder", "^file:/+", "/").alias("folder")))  # a row a class
    inside = lambda rows: rows.where(extension(F.col("path")).isin(*IMAGE_EXTENSIONS)).withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).join(of_class, "folder")
    images = written(inside(files.select("path", "stem", "length")).select("class_name", "path", "stem", "length"), "listing")
    counts = {r["class_name"]: r for r in images.groupBy("class_name").agg(F.count_if(~is_mask(F.col("stem"))).alias("images"), F.count_if(is_mask(F.col("stem"))).alias("masks")).collect()}
    arriving = f"{target.rstrip('/')}/_arriving-{uuid.uuid4().hex}"
    fs.mkdirs(place(arriving))
    uri = fs.makeQualified(place(arriving)).toString()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    try:
        done = written(copied(inside(raw), uri), "copies")
        short = images.join(done.where("same").select("path", F.col("size").alias("length")), ["path", "length"], "left_anti")
        if (bad := short.limit(3).collect()) or done.count() != images.count():
            raise OSError(f"not copied soundly: {', '.join(r['path'] for r in bad) or 'files were listed twice'}")
    except Exception as fault:
        fs.delete(place(arriving), True)
        raise fault if isinstance(fault, OSError) else OSError(f"{target} stays as it was: a copy failed") from fault
    for name in found:
        fs.mkdirs(place(f"{arriving}/{name}"))
        fs.delete(place(f"{target}/{name}"), True)
        fs.rename(place(f"{arriving}/{name}"), place(f"{target}/{name}"))
    fs.delete(place(arriving), True)
    done.select("class_name", F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256").write.mode("overwrite").parquet(f"{target}/checksums.parquet")
    said = {n: {"images": counts[n]["images"] if n in counts else 0, "masks": counts[n]["masks"] if n in counts else 0, "expected": expected.get(n)} for n in found}
    manifest = {"source": source, "classes": said, "as_expected": all(c["expected"] in (None, c["images"]) for c in said.values())}
    write_document(spark, manifest, f"{target}/manifest.json")
    return manifest


def model_catalog(files: DataFrame, metadata: DataFrame, legacy_name: str | None = None) -> DataFrame:
    """(name, legacy, ...metadata): model files with their metadata, and the legacy model if no file bears its name."""
    known = files.select("name").distinct().join(metadata, "name", "left").withColumn("legacy", F.coalesce(F.col("legacy"), F.lit(False)))
    if legacy_name is None:
        return known
    old = files.sparkSession.createDataFrame([(legacy_name, True)], "name string, legacy boolean").join(files.select("name"), "name", "left_anti")
    return known.unionByName(old, allowMissingColumns=True)


def merged_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """(model_name, place): names of both, once and in order; models are few, and one window ranks them."""
    names = old.select("model_name").unionByName(new.select("model_name")).distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy("model_name")))


def write_back(registry: DataFrame, results: DataFrame) -> DataFrame:
    """registry with test_metrics and, if its target was met, operating_threshold of results; other rows as they were."""
    r = results.select("name", F.col("test_metrics").alias("new_metrics"), F.when(F.col("target_met"), F.col("threshold")).alias("new_threshold"))
    return registry.join(r, "name", "left").withColumns({"test_metrics": F.coalesce("new_metrics", "test_metrics"), "operating_threshold": F.coalesce("new_threshold", "operating_threshold")}).drop("new_metrics", "new_threshold")


def load_config(folder: str, name: str) -> dict:
    """A configuration laid over base.json: objects are merged deep down, everything else is replaced."""

    def over(base: dict, top: dict) -> dict:
        return base | {k: over(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in top.items()}

    path = Path(name) if name.endswith(".json") else Path(folder) / f"{name}.json"
    own = json.loads(path.read_text())
    base = Path(folder) / "base.json"
    return own if path.name == "base.json" or not base.exists() else over(json.loads(base.read_text()), own)
