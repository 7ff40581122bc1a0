"""SimHash near-duplicates with a Gray-ordered hierarchical index.

Fingerprints within few bits of each other agree in some pair of six bit blocks (pigeonhole: four differing
bits spoil four blocks at most). For each of the fifteen pairs, the distinct fingerprints are dealt by those
two blocks, which are the top of the index: below it, the fingerprints of a group are sorted by Gray rank, so that
neighbours share most bits, and each node above them holds the bits that all fingerprints below it share. A
search starts at its group, adds up the differences on the way down and drops a node, with all that hangs on it,
once they exceed the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import drop_rows, fresh, join_groups, quoted, ship, with_text_columns, write_out
from roadlens.llm.components import components

SEED = 42
BLOCKS = 6
#: A group with more fingerprints is searched in chunks of this many, pair of chunks by pair of chunks.
CHUNK = 8192
FANOUT = 8
#: Comparisons that one step of a search makes at most, but for those of a single query.
STEP = 1 << 20

PAIRS = list(combinations(range(BLOCKS), 2))

#: Of the documents that the index of the words' fingerprints links, those are near copies whose five-word shingles
#: have a similarity of 0.8 or more: so large a share of the 128 bits of their fingerprints is equal. Sets that
#: overlap by 0.8 differ in 19 bits in the mean, those that overlap by 0.7 in 25, and unlike ones in 64.
SHINGLE = 5
WIDE = 2
WIDE_LIMIT = 25
#: Bits of the words' fingerprint: the fewer, the fewer of them a changed word turns.
WORD_BITS = 48


# Fingerprints


def fingerprint(text: bytes | None, width: int) -> int:
    """Of the lower-cased words' ``width``-shingles; bit set if in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    rows = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def copy_prints(text: bytes | None) -> tuple[int, ...]:
    """What near copies are told by: a fingerprint of the distinct words, and WIDE ones, of hashes of their own, of the
    distinct SHINGLE-word shingles. All zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return (0,) * (1 + WIDE)
    digest = xxhash.xxh64_intdigest
    single = np.fromiter((digest(w, SEED) for w in set(words)), np.uint64)
    shingles = {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x, SEED) for x in shingles), np.uint64).reshape(-1, WIDE)
    return _majority(single) >> 64 - WORD_BITS, *(_majority(np.ascontiguousarray(both[:, i])) for i in range(WIDE))


def _fingerprinter(width: int) -> Callable[[], Callable[[list], list[list]]]:
    def make() -> Callable[[list], list[list]]:
        def compute(texts: list) -> list[list]:
            return [[(f := fingerprint(t, width)) - (1 << 64) * (f >> 63) for t in texts]]

        return compute

    return make


def fingerprints(docs: DataFrame, width: int = 4, text_col: str = "text") -> DataFrame:
    """``docs`` with fingerprint: 64 bits as a signed long. Null and empty texts have fingerprint zero."""
    fields = T.StructType([T.StructField("fingerprint", T.LongType())])
    return with_text_columns(docs, text_col, fields, _fingerprinter(width), as_bytes=True)


# The index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over each group of codes: levels from the leaves up, where a node has the mask of the bits all leaves
    below it share, their value, and the first of its FANOUT or fewer children. No node reaches over groups."""

    def __init__(self, codes: np.ndarray, group: np.ndarray | None = None) -> None:
        group = np.zeros(len(codes), np.int64) if group is None else group
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, group = codes[self.order], group[self.order]
        owner = np.cumsum(np.r_[False, group[1:] != group[:-1]]) if len(codes) else group
        self.root, self.n_groups = owner, int(owner[-1]) + 1 if len(codes) else 0
        ones, zeros = self.codes, ~self.codes
        self.levels = [(np.full(len(codes), ~np.uint64(0)), self.codes, np.empty(0, np.int64))]
        while len(owner) > self.n_groups:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            starts = np.flatnonzero((np.arange(len(owner)) - first[owner]) % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones | zeros, ones, np.r_[starts, len(owner)]))
            owner = owner[starts]

    def search(self, queries: np.ndarray, root: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``queries``, place in ``self.codes``) at ``limit`` differing bits at most, of each query
        within the group ``root``."""
        mask, value, _ = self.levels[-1]
        q, node = np.arange(len(queries)), root
        gone = np.bitwise_count((queries ^ value[node]) & mask[node]).astype(np.int64)
        keep = gone <= limit
        q, node, gone = q[keep], node[keep], gone[keep]
        for (mask, _, bounds), (lower, value, _) in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            n = bounds[node + 1] - bounds[node]
            up = np.repeat(np.arange(len(node)), n)
            child = bounds[node][up] + np.arange(len(up)) - np.repeat(np.cumsum(n) - n, n)
            q = q[up]
            # Only the bits that the parent did not settle yet can add to the difference.
            gone = gone[up] + np.bitwise_count((queries[q] ^ value[child]) & lower[child] & ~mask[node][up])
            keep = gone <= limit
            q, node, gone = q[keep], child[keep], gone[keep]
        return q, node


class Forest:
    """Union-find over the nodes that were linked; only links that join two trees are kept."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        r = x
        while (up := parent.get(r, r)) != r:
            r = up
        while x != r:
            parent[x], x = r, parent.get(x, x)
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.links.append((x, y))


class Rows:
    """Rows of the index: group, code, node (what is linked), and the wide fingerprints, if there are any."""

    def __init__(self, key: np.ndarray, code: np.ndarray, node: np.ndarray, wide: np.ndarray) -> None:
        self.key, self.code, self.node, self.wide = key, code, node, wide

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, at) -> Rows:  # noqa: ANN001
        return Rows(self.key[at], self.code[at], self.node[at], self.wide[at])

    @staticmethod
    def of(batch, names: list[str], n_wide: int) -> Rows:  # noqa: ANN001
        """From the columns ``names`` (group, code, node) of a batch or table, and those of the wide ones."""
        key, code, node = (batch.column(n).to_numpy() if isinstance(batch, pa.Table) else batch.column(n).to_numpy(zero_copy_only=False) for n in names)
        wide = np.stack([np.asarray(batch.column(f"w{i}")).view(np.uint64) for i in range(n_wide)], axis=1) if n_wide else np.empty((len(key), 0), np.uint64)
        return Rows(key, code.view(np.uint64), node, wide)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("key", "code", "node", "wide")))


def search(rows: Rows, limit: int, wide_limit: int, forest: Forest, others: Rows | None = None) -> None:
    """Links the rows of a group to each other, or to ``others``, which are of the same single group."""
    index = GrayIndex(rows.code, rows.key)
    held = rows[index.order]
    sizes = np.bincount(index.root, minlength=max(1, index.n_groups))
    if others is None:
        asks, root = held, index.root
        at = np.flatnonzero(sizes[root] > 1)
    else:
        asks, root = others, np.zeros(len(others), np.int64)
        at = np.arange(len(others)) if len(rows) else np.empty(0, np.int64)
    cost = np.cumsum(sizes[root[at]])
    done = 0
    while done < len(at):
        stop = max(done + 1, int(np.searchsorted(cost, (cost[done - 1] if done else 0) + STEP, side="right")))
        some = at[done:stop]
        q, found = index.search(asks.code[some], root[some], limit)
        q = some[q]
        if others is None:  # a pair is found from both sides
            q, found = q[q < found], found[q < found]
        near = np.bitwise_count(asks.wide[q] ^ held.wide[found]).sum(axis=1) <= wide_limit
        forest.link(asks.node[q][near], held.node[found][near])
        done = stop


# Links over all partitions


def _links_type(n_wide: int) -> T.StructType:
    kinds = [("kind", T.StringType()), ("key", T.LongType()), ("chunk", T.IntegerType()), ("a", T.LongType()), ("b", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in [*kinds, *((f"w{i}", T.LongType()) for i in range(n_wide))]])


def _batch(kind: str, chunk: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, wide: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([kind] * len(a), pa.string()), pa.array(key, pa.int64()), pa.array(np.full(len(a), chunk, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    arrays += [pa.array(np.ascontiguousarray(wide[:, i]).view(np.int64)) for i in range(wide.shape[1])]
    return pa.RecordBatch.from_arrays(arrays, names=_links_type(wide.shape[1]).names)


def _grown(forest: Forest, n_wide: int) -> Iterator[pa.RecordBatch]:
    if forest.links:
        a, b = np.array(forest.links, dtype=np.int64).T
        yield _batch("link", 0, np.zeros(len(a), np.int64), a, b, np.zeros((len(a), n_wide), np.uint64))


def _search_sorted(limit: int, chunk: int, n_wide: int, wide_limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (key, code, node) sorted by key. Holds the groups of a batch at a time, and of a large group one chunk:
    such a group's rows leave as they are, marked with their chunk, for the pairs of chunks to be searched apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_chunks = 0
        open_key = None  # of the large group that is being passed on

        def passed(rows: Rows) -> Iterator[pa.RecordBatch]:
            nonlocal n_chunks
            for i in range(0, len(rows), chunk):
                part = rows[i : i + chunk]
                yield _batch("row", n_chunks, part.key, part.code.view(np.int64), part.node, part.wide)
                n_chunks += 1

        def whole(rows: Rows) -> Iterator[pa.RecordBatch]:
            nonlocal n_chunks
            if not len(rows):
                return
            starts = np.flatnonzero(np.r_[True, rows.key[1:] != rows.key[:-1]])
            sizes = np.diff(np.r_[starts, len(rows)])
            for start, n in zip(starts[sizes > chunk].tolist(), sizes[sizes > chunk].tolist(), strict=True):
                n_chunks = 0
                yield from passed(rows[start : start + n])
            forest = Forest()
            search(rows[np.repeat(sizes <= chunk, sizes)], limit, wide_limit, forest)
            yield from _grown(forest, n_wide)

        held: Rows | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = Rows.of(batch, ["key", "code", "node"], n_wide)
            held = new if held is None else Rows.joined([held, new])
            if open_key is not None:
                n = int(np.searchsorted(held.key, open_key, side="right"))
                if n < len(held) or n >= chunk:
                    yield from passed(held[:n])
                    held = held[n:]
                if not len(held):
                    continue
                if held.key[0] != open_key:
                    open_key = None
            if open_key is None:
                cut = int(np.searchsorted(held.key, held.key[-1], side="left"))  # the last group may go on
                yield from whole(held[:cut])
                held = held[cut:]
                if len(held) > chunk:
                    open_key, n_chunks = held.key[-1], 0
                    yield from passed(held)
                    held = held[:0]
        if held is not None and len(held):
            yield from passed(held) if open_key is not None else whole(held)

    return run


def _search_tile(limit: int, n_wide: int, wide_limit: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        left = rows.column("left").to_numpy().astype(bool)
        held = Rows.of(rows, ["key", "code", "node"], n_wide)
        forest = Forest()
        search(held[left], limit, wide_limit, forest, None if left.all() else held[~left])
        empty = _batch("link", 0, *(np.empty(0, np.int64) for _ in range(3)), np.empty((0, n_wide), np.uint64))
        return pa.Table.from_batches(list(_grown(forest, n_wide)), schema=empty.schema)

    return run


def _block(code: Column, i: int, bits: int) -> Column:
    """Block ``i`` of BLOCKS, as even as can be, of a code of ``bits`` bits."""
    sizes = [bits // BLOCKS + (j < bits % BLOCKS) for j in range(BLOCKS)]
    return F.shiftrightunsigned(code, sum(sizes[:i])).bitwiseAND(F.lit((1 << sizes[i]) - 1))


def links(codes: DataFrame, limit: int = 4, chunk: int = CHUNK, wide_limit: int = 0, bits: int = 64) -> DataFrame:
    """Links a, b that span, for every class of ``codes``, the pairs at ``limit`` differing bits at most: two have a
    path of links if and only if they have one of such pairs.

    ``codes`` has a column code (long, of which the lower ``bits`` bits count) and, if codes are not distinct, node (long: distinct), which is then what
    is linked; and columns w0, w1, ... (long) of wide fingerprints, if pairs must also differ in ``wide_limit`` of
    their bits at most. ``limit`` must be at most BLOCKS - 2 for the pigeonhole to hold. Hot groups, whose codes
    agree in two blocks, are dealt out by pairs of chunks.
    """
    if not 0 <= limit <= BLOCKS - 2:
        raise ValueError(f"limit must be from 0 to {BLOCKS - 2}")
    ship(codes.sparkSession)
    code = F.col("code")
    wide = [c for c in codes.columns if c.startswith("w")]
    kept = [code, (F.col("node") if "node" in codes.columns else code).alias("node"), *wide]
    keys = [_block(code, i, bits) * (1 << 11) + _block(code, j, bits) + F.lit(k << 22) for k, (i, j) in enumerate(PAIRS)]
    dealt = codes.select(F.explode(F.array(*keys)).alias("key"), *kept).repartition("key").sortWithinPartitions("key")
    schema = _links_type(len(wide))
    found = write_out(dealt.mapInArrow(_search_sorted(limit, chunk, len(wide), wide_limit), schema), "simhash-links")

    # Large groups: their chunks' shared bits say which pairs of chunks can hold a link; only those are searched.
    rows = found.filter(F.col("kind") == "row").select("key", "chunk", F.col("a").alias("code"), F.col("b").alias("node"), *wide)
    shared = rows.groupBy("key", "chunk").agg(F.expr("bit_and(code)").alias("ones"), F.expr("bit_and(~code)").alias("zeros"))
    one, two = (shared.select("key", F.col("chunk").alias(f"c{s}"), F.col("ones").alias(f"ones{s}"), F.col("zeros").alias(f"zeros{s}")) for s in (1, 2))
    differ = F.bit_count(F.col("ones1").bitwiseAND(F.col("zeros2"))) + F.bit_count(F.col("zeros1").bitwiseAND(F.col("ones2")))
    tiles = one.join(two, "key").filter((F.col("c1") <= F.col("c2")) & (differ <= limit)).select("key", "c1", "c2")
    body = ["c1", "c2", "code", "node", *wide]
    left = tiles.join(rows, (tiles["key"] == rows["key"]) & (F.col("c1") == F.col("chunk"))).select(tiles["key"], *body, F.lit(True).alias("left"))
    right = tiles.filter("c1 < c2").join(rows, (tiles["key"] == rows["key"]) & (F.col("c2") == F.col("chunk"))).select(tiles["key"], *body, F.lit(False).alias("left"))
    more = left.unionByName(right).groupBy("key", "c1", "c2").applyInArrow(_search_tile(limit, len(wide), wide_limit), schema)
    return found.filter(F.col("kind") == "link").select("a", "b").unionByName(more.select("a", "b"))


def near_duplicates(docs: DataFrame, limit: int = 4, width: int = 4, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with fingerprint (signed long) and component_id: the smallest doc_id reachable over links.

    Rows of the same fingerprint are one class and are never paired. A row without doc_id takes part with its
    fingerprint, and gets the smallest id of its component, which is null if no row of it has one. Null and
    empty texts have fingerprint zero, which links like any other. Every row gives a row, repeated ones too; an empty
    table gives none; texts are read whole, however long. Clashing columns are replaced.
    """
    kept = [c for c in docs.columns if c not in ("fingerprint", "component_id")]
    packed = docs.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    printed = fingerprints(packed, width).select("doc", "doc_id", "fingerprint")
    return _grouped(printed, limit, chunk).select("doc.*", "fingerprint", "component_id")


def _labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``classes`` (node, ...; written) with component: the least node reachable over the links ``found``, or node."""
    comps = write_out(components(found), "components")
    joined = classes.join(comps.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").drop("c_node")
    return write_out(joined.withColumn("component", F.coalesce("component", "node")), "classes")


def _grouped(printed: DataFrame, limit: int, chunk: int) -> DataFrame:
    """``printed`` (doc_id, fingerprint, ...) with component_id; it is read more than once and written first."""
    printed = write_out(printed, "fingerprints")
    classes = write_out(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    labelled = _labelled(classes.withColumnRenamed("fingerprint", "node"), links(classes.select(F.col("fingerprint").alias("code")), limit, chunk))
    firsts = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    labels = write_out(join_groups(labelled, firsts, "component", "size").select(F.col("node").alias("fingerprint"), "component_id", "n"), "labels")
    return join_groups(printed, labels, "fingerprint", "n").drop("n")


def copies(docs: DataFrame, limit: int = 4, wide_limit: int = WIDE_LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, h (hash of the text) of the distinct rows of near copies that another row of their component stands for.

    Documents are linked where the fingerprints of their distinct words differ in ``limit`` bits at most, which
    the Gray index finds, and those of their five-word shingles in ``wide_limit`` of 128. The row that stands for
    a component has the smallest doc_id, and of rows with that id the least hash. Rows without doc_id take no part.
    Only ids, hashes and fingerprints are written, shuffled and grouped.
    """
    names = ["code", *(f"w{i}" for i in range(WIDE))]
    fields = T.StructType([T.StructField(n, T.LongType()) for n in names])
    signed = lambda x: x - (1 << 64) * (x >> 63)

    def make() -> Callable[[list], list[list]]:
        def compute(texts: list) -> list[list]:
            found = [copy_prints(t) for t in texts]
            return [[signed(f[i]) for f in found] for i in range(len(names))]

        return compute

    hashed = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    printed = write_out(with_text_columns(hashed, "text", fields, make, as_bytes=True).drop("text"), "fingerprints")
    least = F.min(F.struct("doc_id", "h")).alias("least")
    classes = printed.groupBy(*names).agg(least, F.count_distinct("doc_id", "h").alias("n")).withColumn("node", F.monotonically_increasing_id())
    classes = write_out(classes, "classes")
    labelled = _labelled(classes, links(classes.select("node", *names), limit, chunk, wide_limit, WORD_BITS))
    firsts = labelled.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("size"), F.sum("n").alias("rows"))
    # What is alone in its component stays.
    several = firsts.filter("rows > 1").select("component", "first", "size")
    labels = write_out(join_groups(labelled, several, "component", "size").select(*names, "first", "n"), "labels")
    met = join_groups(printed, labels, names, "n")
    return met.filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("h") != F.col("first.h"))).select("doc_id", "h").distinct()


def keep_one(docs: DataFrame, limit: int = 4, wide_limit: int = WIDE_LIMIT) -> DataFrame:
    """One row of each component of near copies (see ``copies``), with the columns of ``docs``.

    Texts stay where they are: rows that another one stands for are dropped by id and text hash, as rows that
    share an id may differ in text. Of rows repeated whole, or in both of these, one stays. Rows without doc_id
    can't be told apart by it and are kept as they are. Null and empty texts, which have no words, are copies of each
    other. An empty table gives an empty one.
    """
    h = fresh(docs.columns, "h")
    marked = docs.withColumn(h, F.xxhash64("text"))
    kept = drop_rows(marked, copies(docs, limit, wide_limit), {"doc_id": F.col("doc_id").cast("long"), "h": F.col(h)})
    # Rows that share both id and hash: only these are shuffled.
    twice = docs.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).count().filter("count > 1").select("doc_id", "h")
    twice = write_out(twice, "repeated-rows")
    key = {"doc_id": F.col("doc_id").cast("long"), "h": F.col(h)}
    if not twice.isEmpty():
        repeated = drop_rows(kept, twice, key, anti=False).dropDuplicates(["doc_id", h])
        kept = drop_rows(kept, twice, key).unionByName(repeated)
    return kept.drop(h)


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns; nulls, empty and long texts, ties and repeated rows as in ``near_duplicates``."""
    printed = fingerprints(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint")
    found = _grouped(printed, 4, CHUNK)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
