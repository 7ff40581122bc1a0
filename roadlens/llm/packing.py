"""Best-fit packing of tokenized documents by length patterns.

Only the histogram of piece lengths is planned on the driver; it has as many entries as a sequence has tokens,
whatever the corpus. Patterns of few lengths that fill a sequence are fitted to it by non-negative least
squares, repeat counts are rounded by largest remainder, and what is left is packed best fit first. The plan then gives the n-th
piece of a length its place, and pieces are numbered without gathering those of a length anywhere.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from roadlens.llm.common import ship, write_out

CAPACITY = 2048
#: Id after each document.
CLOSING = 0
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, which a faster library reads; the ids are the same.
RANKS = "byte_bpe_50k.tiktoken"
#: Three-document patterns tried for each first length, and rounds of the fit.
THIRDS = 12
ROUNDS = 12

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("nth", T.LongType()),
    ]
)


@functools.cache
def _encoding(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _tokenizer(path: str) -> tuple[tokenizers.Tokenizer, re.Pattern[str] | None]:
    """The tokenizer, and what finds its special tokens' names in a text."""
    found = tokenizers.Tokenizer.from_file(path)
    names = sorted(t.content for t in found.get_added_tokens_decoder().values())
    return found, re.compile("|".join(map(re.escape, names))) if names else None


def encode(text: str, path: str, ranks_path: str) -> np.ndarray:
    """The ids that the tokenizer gives ``text``, where the name of a special token is that token.

    A faster library that reads the same vocabulary as ranks gives the same ids for every other text (a test
    holds all code points against each other), so it reads those. Its pattern engine gives up on, say, a million
    blanks in a row: such a text goes to the tokenizer too.
    """
    tokenizer, special = _tokenizer(path)
    if special is None or not special.search(text):
        try:
            return _encoding(ranks_path).encode_to_numpy(text, disallowed_special=())
        except ValueError:
            pass
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` ids start: whole sequences, but for the first piece, which takes the rest."""
    first = (n - 1) % capacity + 1
    return [0, *range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its task (part) and its place there among
    the pieces of its length (nth). A null text is empty and has the closing id only; repeated rows repeat."""
    ship(docs.sparkSession)
    path, ranks_path = tokenizer or public_tokenizers.path(TOKENIZER), ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", path, ranks_path), CLOSING).astype("<u4")
                starts = cuts(len(ids), capacity)
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    nth = seen.get(b - a, 0)
                    seen[b - a] = nth + 1
                    rows.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, nth))
            columns = list(zip(*rows, strict=True)) or [()] * len(PIECES)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, PIECES)


# The plan


def patterns(lengths: np.ndarray, capacity: int, thirds: int = THIRDS) -> list[tuple[int, ...]]:
    """Patterns of up to three of ``lengths`` (descending, distinct), each as full as its last length allows."""
    up = np.sort(lengths)

    def largest(room: np.ndarray) -> np.ndarray:
        at = np.searchsorted(up, room, side="right") - 1
        return np.where(at >= 0, up[at], 0)

    found = {(int(a), int(b)) for a, b in zip(up, largest(capacity - up), strict=True) if b and a >= b}
    for a in up.tolist():
        rest = capacity - a
        second = np.unique(largest(np.linspace(rest / 2, max(rest / 2, min(rest - 1, a)), thirds).astype(np.int64)))
        second = second[second > 0]
        third = largest(rest - second)
        found |= {tuple(sorted((a, int(b), int(c)), reverse=True)) for b, c in zip(second, third, strict=True) if c > 0}
    whole = [p for p in found if sum(p) <= capacity]
    # Full patterns first, and of these the ones with the longest lengths, which fit fewest others.
    return sorted(whole, key=lambda p: (capacity - sum(p), [-x for x in p]))


def fit(found: list[tuple[int, ...]], counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that make least squares of (pieces used - pieces there), by coordinate
    descent. Unused room weighs against a pattern a little, so that of equal fits the fuller one wins."""
    rest = np.zeros(capacity + 1)
    for length, n in counts.items():
        rest[length] = n
    x = [0.0] * len(found)
    left = rest.tolist()
    uses = [[(length, p.count(length)) for length in sorted(set(p))] for p in found]
    norms = [float(sum(m * m for _, m in u)) for u in uses]
    waste = [0.5 * (capacity - sum(p)) / capacity for p in found]
    for _ in range(rounds):
        moved = 0.0
        for j, u in enumerate(uses):
            step = (sum(m * left[length] for length, m in u) - waste[j]) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved += abs(step)
                for length, m in u:
                    left[length] -= m * step
        if moved < 1e-3 * max(1.0, sum(x)):
            break
    return np.array(x)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of the longest first, over all pieces of a length and all sequences of one content at once."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(capacity + 1, bool)
    done: list[tuple[tuple[int, ...], int]] = []

    def put(content: tuple[int, ...], left: int, n: int) -> None:
        if n:
            if left:
                open_bins.setdefault(left, []).append((content, n))
                room[left] = True
            else:
                done.append((content, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            tight = int(np.argmax(room[length:])) + length if room[length:].any() else 0
            if tight:
                content, k = open_bins[tight].pop()
                if not open_bins[tight]:
                    room[tight] = False
            else:
                tight, content, k = capacity, (), n
            each = tight // length
            full = min(k, n // each)
            put((*content, *[length] * each), tight - each * length, full)
            n -= full * each
            k -= full
            if k and 0 < n < each:
                put((*content, *[length] * n), tight - n * length, 1)
                n, k = 0, k - 1
            if content:
                put(content, tight, k)
    return done + [b for found in open_bins.values() for b in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold just the pieces counted, by length.

    The fit's repeats are rounded by largest remainder: whole parts first, the most repeated pattern before the
    others, then one more of each pattern in the order of the parts cut off, as long as its pieces are there.
    What no pattern takes is packed best fit.
    """
    left = {length: n for length, n in counts.items() if n and length < capacity}
    out = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    if left:
        found = patterns(np.array(sorted(left)), capacity)
        x = fit(found, left, capacity)
        whole = np.floor(x)
        steps = [(j, int(whole[j])) for j in np.argsort(-whole, kind="stable").tolist() if whole[j]]
        steps += [(j, 1) for j in np.argsort(whole - x, kind="stable").tolist() if x[j] > whole[j]]
        for j, wanted in steps:
            pattern = found[j]
            n = min(wanted, *(left[length] // pattern.count(length) for length in set(pattern)))
            if n > 0:
                out.append((pattern, n))
                for length in pattern:
                    left[length] -= n
    return out + best_fit({length: n for length, n in left.items() if n}, capacity)


class Slots:
    """For each length: runs of pieces, in order, that one pattern takes up."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int, list[int]]]] = {}
        used: dict[int, int] = {}
        base = 0
        for pattern, n in planned:
            places: dict[int, list[int]] = {}
            at = 0
            for length in pattern:
                places.setdefault(length, []).append(at)
                at += length
            for length, offsets in places.items():
                first = used.get(length, 0)
                runs.setdefault(length, []).append((first, base, len(offsets), offsets))
                used[length] = first + n * len(offsets)
            base += n
        self.n_sequences = base
        self.runs = {
            length: (
                np.array([r[0] for r in found]),
                np.array([r[1] for r in found]),
                np.array([r[2] for r in found]),
                np.cumsum([0] + [r[2] for r in found])[:-1],
                np.array([o for r in found for o in r[3]]),
            )
            for length, found in runs.items()
        }

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the pieces with these lengths and places among their length."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0, True]) if len(order) else []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = order[a:b]
            first, base, per, start, offsets = self.runs[int(length[at[0]])]
            run = np.searchsorted(first, rank[at], side="right") - 1
            t = rank[at] - first[run]
            sequence[at] = base[run] + t // per[run]
            offset[at] = offsets[start[run] + t % per[run]]
        return sequence, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    A document's ids are closed by id 0; only one longer than ``capacity`` is cut, its first piece taking the
    rest. Sequences are gapless from 0. Null doc_ids and repeated rows are packed like any other row; an empty
    table gives no rows; other columns are not looked at.
    """
    cut = write_out(pieces(docs, capacity, tokenizer, ranks), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # A row for each task and length; a window over one length has a row for each task.
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_part.select(F.col("part").alias("o_part"), F.col("length").alias("o_length"), F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = Slots(plan(counts, capacity))
    ranked = cut.join(offsets, (F.col("part") == F.col("o_part")) & (F.col("length") == F.col("o_length")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("nth") + F.col("before")).alias("rank"))
    out = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=out.names)

    return ranked.mapInArrow(run, out)


def op7(docs: DataFrame) -> DataFrame:
    """``pack`` with the contract's capacity and tokenizer: a null text is a piece of the closing id, a row without
    doc_id or a repeated row is packed like any other, an empty table gives no rows."""
    return pack(docs)
