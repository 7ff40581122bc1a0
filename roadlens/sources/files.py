"""Raw files: quoted CSV and JSON documents, in any store Spark reads, resolved and checked by a manifest."""

from __future__ import annotations

import json
import time
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.functions.scalars import blank_to_null, sha256_mark

MANIFEST_FILE = T.StructType([T.StructField("name", T.StringType()), T.StructField("key", T.StringType()), T.StructField("size", T.LongType()), T.StructField("checksum", T.StringType())])


class ChecksumMismatch(RuntimeError):
    """A file is not the one that the manifest describes."""


def read_csv(spark: SparkSession, paths: str | list[str], *, drop_uneven: bool = False) -> DataFrame:
    """All columns as text under lower-case names; empty and NA are null, and ``source_file`` tells the file.

    Rows shorter than the header are filled with null and longer ones cut; ``drop_uneven`` drops both instead.
    No schema is inferred: that would read every file twice.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "DROPMALFORMED" if drop_uneven else "PERMISSIVE")
    # A line is only known to be uneven if all of its columns are parsed.
    reader = reader.option("columnPruning", not drop_uneven).option("ignoreLeadingWhiteSpace", drop_uneven).option("ignoreTrailingWhiteSpace", drop_uneven)
    raw = reader.csv(paths)
    lowered = raw.toDF(*[c.lower() for c in raw.columns])
    return lowered.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in lowered.columns], F.input_file_name().alias("source_file"))


def read_years(spark: SparkSession, folder: str, *, drop_uneven: bool = False) -> DataFrame:
    """The yearly files of a folder as one table, with ``file_year`` of each file's name. Years may be missing."""
    rows = read_csv(spark, f"{folder.rstrip('/')}/mortes_transito_*.csv", drop_uneven=drop_uneven)
    return rows.withColumn("file_year", F.regexp_extract(F.element_at(F.split("source_file", "/"), -1), r"(\d{4})", 1).try_cast("int"))


def read_documents(spark: SparkSession, path: str, schema: T.StructType | None = None, *, lines: bool = False) -> DataFrame:
    """The documents of JSON arrays, or with ``lines`` one of each line, with ``position``, which orders them: by the
    names of their files, and as they stand in each.

    Without a schema a document is one text column ``document``, whatever its shape. An array is read whole, by
    one task a file and up to 2 GB; more comes in several files, or as lines, which are split like any text.
    """
    raw = spark.read.text(path, wholetext=not lines)
    found = sorted(raw.inputFiles())
    kind = T.StringType() if schema is None else schema
    text = raw.select("value", F.input_file_name().alias("file"))
    if lines:
        each = text.filter(F.trim("value") != "")
    else:
        each = text.select(F.explode(F.from_json("value", T.ArrayType(kind))).alias("value"), "file")
    each = each.select(F.monotonically_increasing_id().alias("position"), "value", "file")
    if len(found) > 1:
        each = _by_file(spark, each, found)
    document = F.from_json("value", kind) if lines and schema is not None else F.col("value")
    each = each.select("position", document.alias("document"))
    return each if schema is None else each.select("position", "document.*")


def _by_file(spark: SparkSession, rows: DataFrame, found: list[str]) -> DataFrame:
    """``position`` with the place of the row's ``file`` among those found in its upper bits: Spark reads long files
    first. A position that doesn't fit in what is left is an error, and so is a file that wasn't found. The names are
    told as one value: rows made from Python objects would start Python workers beside the JVM of each executor."""
    room = 1 << 63 - len(found).bit_length()
    names = F.from_json(F.lit(json.dumps(found)), "array<string>")
    places = spark.range(0, 1, 1, 1).select(F.posexplode(names).alias("place", "found")).withColumn("place", F.col("place").cast("long"))
    joined = rows.join(F.broadcast(places), F.col("file") == F.col("found"), "left")
    fits = F.when(F.col("position") < room, F.col("place") * room + F.col("position"))
    return joined.withColumn("position", F.coalesce(fits, F.raise_error(F.lit("a document's position can't be told from its file")).cast("long")))


def object_store(endpoint: str, region: str, key: str, secret: str) -> dict[str, str]:
    """Settings under which s3a:// paths reach an S3-compatible store by path-style addresses."""
    base = "spark.hadoop.fs.s3a."
    return {base + "endpoint": endpoint, base + "endpoint.region": region, base + "access.key": key, base + "secret.key": secret, base + "path.style.access": "true"}


@dataclass(frozen=True)
class DatasetFile:
    name: str
    path: str
    size: int | None
    checksum: str | None


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """dataset, storage, bucket, name, key, size, checksum of every file that a manifest lists."""
    described = T.StructType([T.StructField("storage", T.StringType()), T.StructField("local", T.StructType([T.StructField("path", T.StringType()), T.StructField("files", T.ArrayType(MANIFEST_FILE))])), T.StructField("s3", T.StructType([T.StructField("bucket", T.StringType()), T.StructField("prefix", T.StringType()), T.StructField("files", T.ArrayType(MANIFEST_FILE))]))])
    schema = T.StructType([T.StructField("version", T.StringType()), T.StructField("datasets", T.MapType(T.StringType(), described))])
    entries = spark.read.option("multiLine", True).schema(schema).json(path).select("version", F.explode("datasets").alias("dataset", "d"))
    files = F.coalesce(F.col("d.s3.files"), F.col("d.local.files"))
    return entries.select("version", "dataset", "d.storage", F.col("d.s3.bucket").alias("bucket"), F.explode(files).alias("f")).select("version", "dataset", "storage", "bucket", "f.*")


def resolve(listing: DataFrame, dataset: str, *, remote: bool, folder: str = "") -> list[DatasetFile]:
    """The files of a dataset, in the object store or in a local folder. A manifest lists a handful of files."""
    rows = listing.filter(F.col("dataset") == dataset).orderBy("name").collect()
    return [DatasetFile(r["name"], f"s3a://{r['bucket']}/{r['key']}" if remote else f"{folder.rstrip('/')}/{r['name']}", r["size"], r["checksum"]) for r in rows]


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size, checksum (``sha256:`` and hex) of whole files, each hashed where it is read."""
    found = spark.read.format("binaryFile").load(paths)
    return found.select("path", F.col("length").alias("size"), sha256_mark(F.col("content")).alias("checksum"))


def verify(spark: SparkSession, files: list[DatasetFile], *, warn_only: bool = False) -> DataFrame:
    """The files' checksums, if all are as listed; ChecksumMismatch otherwise, or a warning, as for files that are
    taken from a cache. Unlisted ones are not compared."""
    found = checksums(spark, [f.path for f in files])
    wanted = spark.createDataFrame([(f.path.rsplit("/", 1)[-1], f.checksum) for f in files], "wanted_name string, wanted string")
    held = found.join(wanted, F.element_at(F.split("path", "/"), -1) == F.col("wanted_name"))
    bad = held.filter(F.col("wanted").isNotNull() & (F.col("wanted") != F.col("checksum"))).select("path").collect()
    if bad and not warn_only:
        raise ChecksumMismatch(", ".join(r["path"] for r in bad))
    if bad:
        warnings.warn("not as listed: " + ", ".join(r["path"] for r in bad), stacklevel=2)
    return found


@dataclass
class TableCache:
    """Tables kept for a while under a name; a stale one is dropped when it is next asked for."""

    ttl_seconds: float = 24 * 3600
    held: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    def get(self, name: str, load) -> DataFrame:  # noqa: ANN001
        then, df = self.held.get(name, (0.0, None))
        if df is not None and time.time() - then < self.ttl_seconds:
            return df
        if df is not None:
            df.unpersist()
        df = load().persist()
        self.held[name] = (time.time(), df)
        return df

    def clear(self) -> None:
        for _, df in self.held.values():
            df.unpersist()
        self.held.clear()

    def stats(self) -> dict[str, float]:
        """Age of each table in seconds."""
        return {name: time.time() - then for name, (then, _) in self.held.items()}

    def sizes(self) -> dict[str, int]:
        """Bytes of each table: what the optimizer knows of it, which is exact once it has been read."""
        return {name: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for name, (_, df) in self.held.items()}
