"""Repeated substrings by content-defined chunks.

A gear hash rolls over a document's bytes and ends a chunk wherever its value is small. A boundary depends on
the last sixteen bytes only, so an insertion moves no boundary but those next to it, and a passage that two
documents share is cut alike in both. What is deduplicated by digest is a chunk with the one after it, so that
common phrases, each in a chunk of its own, don't add up to a passage by chance; runs of repeated chunks that
are long enough are repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import fresh, join_groups, quoted, ship, write_out

#: Bytes that a boundary depends on: a 16-bit gear hash shifts older ones out.
WINDOW = 16
#: Mean bytes of a chunk, and least and most bytes of one.
MEAN = 24
LEAST = 8
MOST = 256
#: Bytes from which a run of repeated chunks is a repeated passage. A shared passage loses a chunk and a
#: window at its ends, so this finds passages of about twice the length all but surely.
RUN = 120


def gear_table() -> np.ndarray:
    """256 numbers of 16 bits, from a rule: a hash of each byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 1) & 0xFFFF for b in range(256)], dtype=np.uint16)


def boundaries(data: bytes, gear: np.ndarray, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of ``data``, the last one its length."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    # h[i] = sum of gear[data[i - k]] << k over the window, by doubling the number of bytes summed.
    h = gear[np.frombuffer(data, np.uint8)]
    k = 1
    while k < WINDOW:
        moved = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += moved
        k *= 2
    found = np.flatnonzero(h < np.uint16(65536 // mean)) + 1
    if len(found) and (np.diff(found) < least).any():
        # Of boundaries that follow closely one stays for each ``least`` bytes, counted from the first.
        kept, last = [], -least
        for end in found.tolist():
            if end - last >= least:
                kept.append(end)
                last = end
        found = np.array(kept)
    ends = found if len(found) and found[-1] == n else np.r_[found, n]
    sizes = np.diff(np.r_[0, ends])
    if (sizes > most).any():  # where nothing ends a chunk for long, it ends at multiples of the most
        ends = np.unique(np.concatenate([ends, *(np.arange(end - size + most, end, most) for end, size in zip(ends[sizes > most].tolist(), sizes[sizes > most].tolist(), strict=True))]))
    return ends


def units(data: bytes, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, middle, end, 64-bit digest (signed) and place among equal ones (0: alone, 1: the first, 2: a later one) of
    each chunk with its successor. A single chunk is a unit by itself, with its end for a middle."""
    ends = boundaries(data, gear)
    starts = np.r_[0, ends[:-1]]
    if len(ends) > 1:
        starts, middles, ends = starts[:-1], ends[:-1], ends[1:]
    else:
        middles = ends
    digest = xxhash.xxh3_64_intdigest
    digests = np.fromiter((digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)
    place = np.zeros(len(digests), np.int8)
    _, first, group, n = np.unique(digests, return_index=True, return_inverse=True, return_counts=True)
    place[n[group] > 1] = 2
    place[first[n > 1]] = 1
    return starts, middles, ends, digests, place


def identity() -> Column:
    """What tells documents apart: doc_id, or the text's hash where that is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


UNITS = T.StructType(
    [
        T.StructField("digest", T.LongType()),
        T.StructField("who", T.LongType()),
        T.StructField("h", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("middle", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("place", T.ByteType()),
    ]
)
#: Units that leave a task at once.
HELD = 200_000


def _units(docs: DataFrame) -> DataFrame:
    """The units of every document: who it is, and the hash of its text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int8()]

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=UNITS.names)

        for batch in batches:
            out, held = [], 0
            for who, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not text:
                    continue
                starts, middles, ends, digests, place = units(text, gear)
                n = len(starts)
                out.append((digests, np.full(n, who), np.full(n, h), starts, middles, ends, place))
                held += n
                if held > HELD:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    rows = docs.select(identity().alias("who"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, UNITS)


RUNS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("n_chunks", T.IntegerType()),
            T.StructField("first_doc", T.LongType()),
            T.StructField("is_first", T.BooleanType()),
        ]
    )
)


def split(who: int, run: list[tuple[int, int, bool, int]], run_bytes: int) -> list[tuple[int, int, int, int, bool]]:
    """The parts (start, end, n_chunks, first_doc, is_first) of ``who``'s run of adjoining chunks (start, end, whether
    they stand in an earlier place, least document)."""
    if not run or run[-1][1] - run[0][0] < run_bytes:
        return []
    parts: list[tuple[int, int, int, int, bool]] = []
    for later, group in groupby(run, key=lambda c: c[2]):
        chunk = list(group)
        start, end, n = chunk[0][0], chunk[-1][1], len(chunk)
        if later and end - start >= run_bytes:
            parts.append((start, end, n, min(c[3] for c in chunk), False))
        elif parts and parts[-1][4]:
            parts[-1] = (parts[-1][0], end, parts[-1][2] + n, who, True)
        else:
            parts.append((start, end, n, who, True))
    return parts


def passages(who: int, found: list[tuple[int, int, int, int, int | None]], run_bytes: int) -> list[tuple[int, int, int, int, bool]]:
    """The parts of all runs of a document, from its repeated units (start, middle, end, place, least document or null)
    in order. A chunk stands in an earlier place if one of the units it is in does."""
    chunks: dict[tuple[int, int], tuple[bool, int]] = {}
    for start, middle, end, place, least in found:
        first = who if least is None else least
        later = first < who or place == 2
        for chunk in ((start, middle), (middle, end)):
            if chunk[0] < chunk[1]:
                was, before = chunks.get(chunk, (False, first))
                chunks[chunk] = (was or later, min(before, first))
    out, run = [], []
    for (start, end), (later, first) in sorted(chunks.items()):
        if run and start != run[-1][1]:
            out += split(who, run, run_bytes)
            run = []
        run.append((start, end, later, first))
    return out + split(who, run, run_bytes)


def repeated_runs(docs: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """who, h (the text's hash), and start, end (bytes), n_chunks, first_doc, is_first of each repeated passage: a longest
    run of adjoining chunks that are repeated, with a neighbour, in this document or others, split where it passes
    from chunks that stand nowhere before to chunks that do.

    A part of chunks that stand before, too short to be a passage, stays with its neighbours: it isn't cut out of
    a passage that is first here. So a chunk that is in a later part anywhere also stands in an earlier place.

    Texts are cut once, and their units written. Of a digest only the least and the greatest document are kept,
    which combine before the shuffle, so a passage that a third of all documents share costs a row a task; the few
    digests that a large share of the units have are broadcast for the join back.
    """
    placed = write_out(_units(docs), "chunks")
    spread = placed.groupBy("digest").agg(F.min("who").alias("least"), F.max("who").alias("most"), F.count("*").alias("n"))
    shared = write_out(spread.filter("least < most").select("digest", "least", "n"), "repeated-chunks")
    here = placed.filter("place > 0")
    met = join_groups(placed, shared, "digest", "n")
    parts = met.unionByName(here.withColumn("least", F.lit(None).cast("long")))
    # At most a document's own chunks. Rows that repeat a document repeat its chunks: one of each stays.
    per_doc = parts.groupBy("who", "h").agg(F.collect_set(F.struct("start", "middle", "end", "place", "least")).alias("parts"))

    @F.udf(RUNS, useArrow=True)
    def runs(who: int, parts: list) -> list:
        # Of a unit that is repeated both here and elsewhere, the row with the least document comes last and counts.
        found = sorted(((p["start"], p["middle"], p["end"], p["place"], p["least"]) for p in parts), key=lambda u: (u[0], u[4] is not None))
        return passages(who, list({u[0]: u for u in found}.values()), run_bytes)

    return per_doc.select("who", "h", F.explode(runs("who", "parts")).alias("r")).select("who", "h", "r.*")


def repeats(docs: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """doc_id, start_byte, end_byte, n_chunks, first_doc, is_first of each passage repeated in or across documents.

    Places are in the UTF-8 bytes of the text, end exclusive. A run of repeated chunks of ``run_bytes`` or more
    comes in parts: ``is_first`` ones, of chunks that stand nowhere before (and shorter stretches between them), with
    this doc_id as ``first_doc``, and others, each of whose chunks stands in a smaller doc_id or before in this
    one; the smallest such document is ``first_doc``. Documents without such a passage don't occur. Null and empty
    texts have no chunk; a row without doc_id is told by its text, and comes with a null doc_id and is compared by
    the text's hash in place of an id; rows of the same doc_id don't repeat each other, and rows repeated whole are
    one. An empty table gives no rows; texts are read whole, however long; other columns are not looked at.
    """
    found = repeated_runs(docs, run_bytes)
    unnamed = docs.filter(F.col("doc_id").isNull()).select(F.xxhash64("text").alias("u_who")).distinct()
    marked = found.join(unnamed, F.col("who") == F.col("u_who"), "left")
    return marked.select(
        F.when(F.col("u_who").isNull(), F.col("who")).alias("doc_id"),
        F.col("start").alias("start_byte"),
        F.col("end").alias("end_byte"),
        "n_chunks",
        "first_doc",
        "is_first",
    )


def remove_repeats(docs: DataFrame, run_bytes: int = RUN) -> DataFrame:
    """``docs`` without the repeated passages, but for those in the first place that has them.

    Cuts fall on chunk boundaries, moved inwards to the next full character. A column n_chars is counted anew;
    other columns pass through, and so do documents without repeats, null and empty texts and repeated rows. A
    table with columns of any name may be given; an empty one gives an empty one.
    """
    who, h, cut, made = [fresh(docs.columns, n) for n in ("c_who", "c_h", "c_cuts", "c_text")]
    later = repeated_runs(docs, run_bytes).filter("not is_first")
    cuts = later.groupBy(F.col("who").alias(f"{who}_"), F.col("h").alias(f"{h}_")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cut))
    cuts = write_out(cuts, "cuts")

    @F.udf(T.StringType(), useArrow=True)
    def without(text: str | None, found: list | None) -> str | None:
        if not text or not found:  # a Python function sees all rows, whatever stands around it
            return text
        data, out, done = text.encode(), [], 0
        for c in found:
            start, end = c["start"], c["end"]
            while start < end and data[start] & 0xC0 == 0x80:
                start += 1
            while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(data[done:start])
            done = max(done, end)
        return b"".join([*out, data[done:]]).decode()

    marked = docs.withColumns({who: identity(), h: F.xxhash64("text")})
    joined = marked.join(cuts, (F.col(who) == F.col(f"{who}_")) & (F.col(h) == F.col(f"{h}_")), "left")
    cleaned = joined.withColumn(made, without("text", cut))
    new = {"text": F.col(made), "n_chars": F.length(made).cast("long")}
    return cleaned.select(*[new.get(c, F.col(quoted(c))).alias(c) for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    """All repeated passages; nulls, empty and long texts, ties and repeated rows as in ``repeats``."""
    return repeats(docs)
