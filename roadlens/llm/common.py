"""What the operators of this package share: the shared folder, whole-text maps."""

from __future__ import annotations

import operator
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that they need not have it installed.

    To be called before a Python function is put into a plan, as functions note what was sent by then.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='roadlens-')}/roadlens", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all tasks run in this process
    (tests, one machine) a temporary folder is made and set; on a cluster that is an error, as each executor
    would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="roadlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; runs of one application lie together."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it again.

    The files outlive lost executors, and what is nondeterministic above them is settled.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Removes all that this application wrote in the shared folder. Tables that were read from there are gone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def fresh(columns: Iterable[str], name: str) -> str:
    """``name`` with as many underscores before it as make it none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: A group with more than this share of all rows is hot; there are fewer of them than its inverse.
HOT_SHARE = 0.005
#: Rows told by their keys that are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, stats: tuple | None = None) -> DataFrame:
    """``rows`` with the columns of ``groups``, one row for each key, of which ``size`` (dropped here) of ``rows`` are.

    Groups of more than HOT_SHARE of the rows are few, whatever the data, and are broadcast, so that the rows of
    none are gathered in one task; the others are joined by a shuffle. Both sides are read twice. ``stats``: the sum
    and the maximum of ``size``, if they are known.
    """
    keys = [key] if isinstance(key, str) else key
    total, most = stats or groups.agg(F.sum(size), F.max(size)).first()
    if not total or most <= HOT_SHARE * total:
        return rows.join(groups.drop(size), keys)
    hot = F.broadcast(groups.filter(F.col(size) > HOT_SHARE * total).drop(size))
    cold = groups.filter(F.col(size) <= HOT_SHARE * total).drop(size)
    others = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(cold, keys))


def drop_rows(rows: DataFrame, told: DataFrame, by: dict[str, Column], *, anti: bool = True) -> DataFrame:
    """``rows`` without those (or, if not ``anti``, only those) whose expressions ``by`` equal the columns of a row of
    ``told``; nulls equal nulls.

    ``told`` is written and counted first: up to BROADCAST_ROWS of it are broadcast, so that ``rows`` are not shuffled.
    """
    told = write_out(told.select(*by).distinct(), "told-rows")
    if told.isEmpty():
        return rows if anti else rows.limit(0)
    names = {}
    for name in by:
        names[name] = fresh([*rows.columns, *names.values()], f"t_{name}")
    told_named = told.select(*[F.col(n).alias(x) for n, x in names.items()])
    small = told.count() <= BROADCAST_ROWS
    same = reduce(operator.and_, [by[n].eqNullSafe(F.col(quoted(x))) for n, x in names.items()])
    return rows.join(F.broadcast(told_named) if small else told_named, same, "left_anti" if anti else "left_semi")


def by_position(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[str], str]]:
    """``docs`` with columns c0, c1, ..., which clash with no added ones; what gives them their names back and drops
    all others; and the new name of a column."""
    names = list(docs.columns)
    place = {name: f"c{i}" for i, name in enumerate(names)}
    back = lambda df: df.select(*[F.col(p).alias(n) for n, p in place.items()])
    return docs.toDF(*place.values()), back, place.__getitem__


def with_text_columns(
    docs: DataFrame,
    text_col: str,
    fields: T.StructType,
    make: Callable[[], Callable[[list], list[list]]],
    *,
    as_bytes: bool = False,
) -> DataFrame:
    """``docs`` with the columns ``fields``, computed batch by batch from its whole texts.

    ``make()`` is called once in each Python worker's task and returns a function from a list of texts
    (None for null; UTF-8 bytes if ``as_bytes``) to one list of values for each field. Columns of
    ``docs`` that clash with ``fields`` are replaced; all others pass through as they are.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in fields.names]
    columns = [F.col(quoted(c)) for c in kept]
    # A text that passes through anyway is not sent twice.
    if text_col in kept and docs.schema[text_col].dataType == T.StringType():
        at = kept.index(text_col)
    else:
        at = len(kept)
        columns.append(F.col(quoted(text_col)).cast("string").alias("__text"))
    carried = docs.select(*columns)
    names = kept + fields.names
    kinds = [to_arrow_type(f.dataType) for f in fields.fields]
    out = nullable(T.StructType(carried.schema.fields[: len(kept)] + fields.fields))
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()) if as_bytes else batch.column(at)
            columns = compute(texts.to_pylist())
            arrays = [*batch.columns[:n_kept], *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return carried.mapInArrow(run, out)
