"""Benchmark decontamination: a broadcast set of hashed word windows against every window of the corpus.

DataFrame functions only. The set grows with the benchmark, never with the corpus; its size is checked, and
beyond the bound the same plan runs as a shuffled join on the window's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import drop_rows, quoted

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words: ASCII but digits and letters (applied after lower-casing).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark up to which the set is broadcast: about 200 bytes each.
BROADCAST_WINDOWS = 2_000_000


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else; plain lower() does that where all of the text is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, width, window (array of words), key: each distinct window of each item once."""
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("width", F.least(F.size("words"), F.lit(n)))
    starts = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)))
    windows = starts.select("item_id", "width", F.slice("words", F.col("at"), F.col("width")).alias("window"))
    return windows.distinct().withColumn("key", F.xxhash64("window"))


def _windows_met(rows: DataFrame, benchmark: DataFrame, n: int, broadcast_windows: int, *, whole: bool) -> DataFrame:
    """A row for each window of ``rows`` (__words, ...) that is one of the benchmark, with __at and __width, and __items;
    if ``whole``, also one row with a null __at for each of ``rows``.

    Every window of the corpus meets the set through its hash, and a hit is then compared word by word. Windows
    leave the scan only if they hit.
    """
    windows = benchmark_windows(benchmark, n)
    # Of all items of a window one row: at most as many rows as the benchmark has windows.
    found = windows.groupBy("width", "window", "key").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    sizes = {r["width"]: r["n"] for r in windows.groupBy("width").agg(F.count("*").alias("n")).collect()}  # n rows at most
    small = sum(sizes.values()) <= broadcast_windows
    found = found.select(F.col("width").alias("__width"), F.col("window").alias("__set"), F.col("key").alias("__set_key"), F.col("items").alias("__items"))
    # Beyond the bound a sort-merge join: it can spill.
    found = F.broadcast(found) if small else found.hint("merge")
    # A place is stride * start + width, and -1 stands for the document itself, so that one without windows stays.
    # Sequences alone keep the scan, both projections, the explosion and the join in one generated loop, where
    # a window is ten references and no row is copied before it hits.
    bits = max(4, n.bit_length())
    stride, kind = 1 << bits, "int" if bits == 4 else "bigint"
    places = F.array(*[F.lit(-1).cast(kind)] * whole).cast(f"array<{kind}>")
    for width in sorted(sizes):
        n_starts = F.size("__words") - (width - 1)
        here = F.sequence(F.lit(width).cast(kind), F.greatest(n_starts, F.lit(1)).cast(kind) * stride - stride + width, F.lit(stride).cast(kind))
        places = F.concat(places, F.when(n_starts > 0, here).otherwise(F.array().cast(f"array<{kind}>")))
    spread = rows.withColumn("__place", F.explode(places))
    spread = spread.withColumn("__at", F.expr(f"if(__place < 0, null, cast(shiftright(__place, {bits}) as int))"))
    spread = spread.withColumn("__window", F.expr(f"if(__place < 0, null, slice(__words, __at + 1, cast(__place & {stride - 1} as int)))"))
    spread = spread.withColumn("__key", F.expr("if(__place < 0, null, xxhash64(__window))"))
    met = spread.join(found, F.col("__key") == F.col("__set_key"), "left" if whole else "inner")
    return met.filter((F.col("__place") < 0) | (F.col("__window") == F.col("__set")))


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, carry: list[str] | None = None, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with n_words, n_hit, item_ids (sorted as strings), hit_words (places from 0), contaminated.

    A window is ``n`` consecutive words of an item; an item of fewer, but not none, is one window. A document's
    word inside any occurrence of a window is hit. Null and empty texts have no words and hit nothing; null
    item ids are left out of item_ids, while their windows count. Repeated rows give repeated results; an
    empty benchmark hits nothing, and an empty table gives no rows. Columns of ``docs`` that clash with the
    added ones are replaced; texts are read whole, however long.

    The shuffle carries one row a document, with the columns that are carried, besides the hits.
    """
    added = ["n_words", "n_hit", "item_ids", "hit_words", "contaminated"]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in added]
    # Carried columns go under names of ours, so that none can clash.
    rows = docs.select(*[F.col(quoted(c)).alias(f"own_{i}") for i, c in enumerate(kept)], words_of(F.col("text")).alias("__words"), F.monotonically_increasing_id().alias("__row"))
    met = _windows_met(rows, benchmark, n, broadcast_windows, whole=True).select(
        F.col("__row").alias("row"),
        F.when(F.col("__at").isNull(), F.struct(F.lit(1).alias("is_row"), F.size("__words").alias("n_words"), *[F.col(f"own_{i}") for i in range(len(kept))])).alias("own"),
        F.when(F.col("__at").isNotNull(), F.struct(F.col("__at").alias("at"), F.col("__width").alias("width"))).alias("hit"),
        F.col("__items").alias("w_items"),
    )
    per_doc = met.groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"),
        F.collect_set("hit").alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("w_items"))).alias("items"),
    )
    per_doc = per_doc.withColumn("hit_words", F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["width"] - 1))))))
    return per_doc.select(
        *[F.col(f"own.own_{i}").alias(c) for i, c in enumerate(kept)],
        F.col("own.n_words").cast("long").alias("n_words"),
        F.size("hit_words").cast("long").alias("n_hit"),
        F.array_sort("items").alias("item_ids"),
        "hit_words",
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with the columns of ``docs``, repeated rows and all.

    What is contaminated is its text, so texts go by length and two hashes of theirs; only those of texts with a hit
    leave the scan. Null and empty texts have no words and stay; an empty benchmark removes nothing; an empty
    table gives an empty one; no column can clash.
    """
    by = {"size": F.length("text"), "h": F.xxhash64("text"), "k": F.xxhash64(F.lit(7), F.reverse("text"))}
    rows = docs.select(*[c.alias(name) for name, c in by.items()], words_of(F.col("text")).alias("__words"))
    hit = _windows_met(rows, benchmark, n, broadcast_windows, whole=False).select(*by).distinct()
    return drop_rows(docs, hit, by)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with the words that are hit taken out of ``text``, and n_chars, if there is one, counted anew.

    A text with a hit becomes its other words, lower-cased and joined by blanks, as they were compared; texts
    without one, null and empty ones, and all other columns stay as they are. Repeated rows stay repeated.
    """
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    places = {c: i for i, c in enumerate(docs.columns)}
    carried = docs.toDF(*[f"c{i}" for i in places.values()]).withColumn("text", F.col(f"c{places['text']}"))
    found = contamination(carried, benchmark, n, [*(f"c{i}" for i in places.values()), "text"], broadcast_windows)
    words = F.filter(words_of(F.col("text")), lambda w, i: ~F.array_contains("hit_words", i))
    cleaned = found.withColumn("__text", F.when(F.col("contaminated"), F.array_join(words, " ")).otherwise(F.col("text")))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return cleaned.select(*[(F.col(f"c{places[c]}") if c in names else F.when(F.col("contaminated"), new[c]).otherwise(F.col(f"c{places[c]}"))).alias(c) for c in docs.columns])


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns; nulls, empty and long texts, ties and repeated rows as in ``contamination``."""
    found = contamination(docs, benchmark, carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


OP6_SQL = """
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
b as (
  select item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark),
bs as (select item_id, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from b where len(w) > 0),
bw as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as g from bs),
ks as (select distinct k from bw),
ds as (select rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d cross join ks where len(w) >= k),
dw as (select rid, p, k, array_to_string(w[p:p + k - 1], ' ') as g from ds),
hits as (select dw.rid, dw.p, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
hw as (select rid, unnest(range(p, p + k)) as q from hits),
nh as (select rid, count(distinct q) as n from hw group by rid),
it as (select rid, cast(item_id as varchar) as i from hits group by rid, item_id),
ni as (select rid, count(*) as n, string_agg(i, ',' order by i) as s from it group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(nh.n, 0) as bigint) as n_hit, cast(coalesce(ni.n, 0) as bigint) as n_items,
       sha256(coalesce(ni.s, '')) as items_sha256, coalesce(nh.n, 0) > 0 as contaminated
from d left join nh on d.rid = nh.rid left join ni on d.rid = ni.rid
"""
