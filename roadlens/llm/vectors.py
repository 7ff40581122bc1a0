"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within squared distance 2 - 2c. After a rotation, which spreads the
variance evenly, the coordinates are split into blocks; in one block at least the pair lies within the block's
proportional share of that squared distance. Each block is range-joined by itself: a grid over its first two
coordinates deals the vectors, and in a task the vectors lie in orthants of the block, of which a vector visits those
within its reach. Candidates of a block are verified on the whole vectors at once, exactly, and counted by the first
block that yields them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlens.llm.common import fresh, join_groups, quoted, ship, write_out
from roadlens.llm.components import components

COSINE = 0.9
BLOCKS = 4
#: Vectors of a cell that one task takes, and vectors it compares them with; more are dealt out over tasks.
LEFT = 16_384
RIGHT = 65_536
#: Rows of the left side whose orthants are found at once, and those that are compared at once with as many of the
#: right side. Orthants are split as long as they hold LEAF vectors or more in the mean.
STRIP = 2048
TILE = 4096
LEAF = 64
#: Slack for rounding in the blocks' distances; what they let through is verified exactly.
SLACK = 1e-9


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random rotation of ``dim`` coordinates."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def split(dim: int, blocks: int) -> list[tuple[int, int]]:
    """Bounds of the blocks, of equal width but for one coordinate."""
    at = [dim * i // blocks for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def budget(dim: int, bounds: tuple[int, int], cosine: float) -> float:
    return (2 - 2 * cosine) * (bounds[1] - bounds[0]) / dim + SLACK


DEALT = T.StructType(
    [
        T.StructField("block", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("rep", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("vector", T.BinaryType()),
    ]
)
FOUND = T.StructType([T.StructField("rep", T.LongType()), T.StructField("other", T.LongType()), T.StructField("n", T.LongType())])


def units(vectors: list[np.ndarray]) -> np.ndarray:
    """Unit vectors. Each is scaled by its largest component first, so that no square is too large or too small."""
    m = np.stack(vectors).astype(np.float64)
    m = m / np.abs(m).max(axis=1)[:, None]
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _deal(cosine: float, blocks: int):
    """A row for each vector and block, with the block's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            rep, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            by_dim: dict[int, list[int]] = {}
            lists = batch.column(2)
            raw = [np.frombuffer(b, np.float64) for b in lists.to_pylist()]
            for i, v in enumerate(raw):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                turn = turns.setdefault(dim, rotation(dim))
                turned = units([raw[i] for i in rows]) @ turn
                for k, (a, b) in enumerate(split(dim, blocks)):
                    width = np.sqrt(budget(dim, (a, b), cosine))
                    x = np.floor(turned[:, a] / width).astype(np.int32)
                    y = np.floor(turned[:, a + 1] / width).astype(np.int32) if b - a > 1 else np.zeros(len(rows), np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), k, np.int32)), pa.array(x), pa.array(y), pa.array(rep[rows]), pa.array(n[rows]),
                            pa.array(np.full(len(rows), dim, np.int32)), lists.take(pa.array(rows)),
                        ],
                        names=DEALT.names,
                    )

    return run


def compare(dim: int, block: int, blocks: int, cosine: float, left: tuple, right: tuple, *, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """All links between ``left`` and ``right`` (rep, n, unit vectors): what each vector gained, and a forest.

    A pair counts in the first block whose budget it keeps, so it is counted once over all blocks; ``same``:
    both sides are one, and a pair counts once within it.
    """
    (l_rep, l_n, l_unit), (r_rep, r_n, r_unit) = left, right
    bounds = split(dim, blocks)
    turn = rotation(dim)
    l_turn, r_turn = l_unit @ turn, r_unit @ turn
    a, b = bounds[block]
    most = budget(dim, bounds[block], cosine)
    # A cell is one of the grid, split by the signs of further coordinates.
    width, planes = np.sqrt(most), min(2, b - a)
    depth = min(b - a - planes, max(0, int(np.log2(max(1, len(r_rep)) / LEAF))))
    l_code, r_code = (np.c_[np.floor(t[:, a : a + planes] / width), t[:, a + planes : a + planes + depth] > 0].astype(np.int32) for t in (l_turn, r_turn))
    order = np.lexsort(r_code.T[::-1])
    r_turn, r_rep, r_n, r_unit, r_code = r_turn[order], r_rep[order], r_n[order], r_unit[order], r_code[order]
    starts = np.flatnonzero(np.r_[True, (r_code[1:] != r_code[:-1]).any(axis=1)])
    stops, cells = np.r_[starts[1:], len(r_code)], r_code[starts]
    if same:  # a pair of cells is compared once
        both = np.unique(np.r_[cells, l_code], axis=0, return_inverse=True)[1].ravel()
        c_rank, l_rank = both[: len(cells)], both[len(cells) :]
        r_rank = np.repeat(c_rank, stops - starts)
    low = (cells[:, :planes] * width).astype(np.float32)
    signs = np.where(cells[:, planes:], 1, -1).astype(np.float32)
    l_gain, r_gain = np.zeros(len(l_rep), np.int64), np.zeros(len(r_rep), np.int64)
    parent: dict[int, int] = {}
    forest: list[tuple[int, int]] = []

    def root(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            parent[v] = parent.get(up, up)
            v = up
        return v

    # Single precision, with room for its rounding, only narrows the candidates.
    reach = np.float32(most + 1e-5)
    l_sub, r_sub = l_turn[:, a:b].astype(np.float32), r_turn[:, a:b].astype(np.float32)
    l_sq, r_sq = (l_sub**2).sum(1), (r_sub**2).sum(1)

    def candidates(s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x = l_sub[s : s + STRIP, planes : planes + depth]
        # The squared distance to a cell: to its part of the grid, and of the coordinates on whose other side it lies.
        away = ((x**2).sum(1)[:, None] - (x * np.abs(x)) @ signs.T) / 2
        for k in range(planes):
            y = l_sub[s : s + STRIP, k][:, None]
            away += np.maximum(0, np.maximum(low[:, k] - y, y - low[:, k] - np.float32(width))) ** 2
        visits = away <= reach
        if same:
            visits &= l_rank[s : s + STRIP, None] <= c_rank
        for cell in np.flatnonzero(visits.any(0)).tolist():
            rows = np.flatnonzero(visits[:, cell]) + s
            for t in range(starts[cell], stops[cell], TILE):
                u = min(stops[cell], t + TILE)
                near = l_sub[rows] @ r_sub[t:u].T
                near *= -2
                near += l_sq[rows][:, None]
                near += r_sq[t:u]
                i, j = np.nonzero(near <= reach)
                if len(i):
                    yield rows[i], j + t

    for s in range(0, len(l_rep), STRIP):
        for i, j in candidates(s):
            keep = (l_rank[i] != r_rank[j]) | (l_rep[i] < r_rep[j]) if same else l_rep[i] != r_rep[j]
            i, j = i[keep], j[keep]
            for p in range(0, len(i), 1 << 16):
                x, y = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
                linked = np.einsum("ij,ij->i", l_unit[x], r_unit[y]) >= cosine
                x, y = x[linked], y[linked]
                if not len(x):
                    continue
                gap = (l_turn[x] - r_turn[y]) ** 2
                first = gap[:, a:b].sum(1) <= most
                for k in range(block):
                    c, d = bounds[k]
                    first &= gap[:, c:d].sum(1) > budget(dim, bounds[k], cosine)
                x, y = x[first], y[first]
                np.add.at(l_gain, x, r_n[y])
                np.add.at(r_gain, y, l_n[x])
                for v, w in zip(l_rep[x].tolist(), r_rep[y].tolist(), strict=True):
                    f, g = root(v), root(w)
                    if f != g:
                        parent[max(f, g)] = min(f, g)
                        forest.append((v, w))
    reps = np.concatenate([l_rep, r_rep])
    gains = np.concatenate([l_gain, r_gain])
    return reps[gains > 0], gains[gains > 0], forest


def _search(blocks: int, cosine: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block, dim = key[0].as_py(), key[1].as_py()
        side = rows.column("side").to_numpy()
        rep, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
        reps, gains, forest = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        if (side == 0).any():
            raw = rows.column("vector")
            unit = units([np.frombuffer(v.as_py(), np.float64) for v in raw])
            # Side 0 is the cell's own share; 1 is of the same cell; 2 is of a neighbour on the larger side.
            own = tuple(c[side == 0] for c in (rep, n, unit))
            for s in (1, 2):
                if (side == s).any():
                    other = tuple(c[side == s] for c in (rep, n, unit))
                    r, g, f = compare(dim, block, blocks, cosine, own, other, same=s == 1)
                    reps.append(r)
                    gains.append(g)
                    forest += f
        a = np.array(forest, np.int64).reshape(-1, 2)
        gained = sum(map(len, reps))
        return pa.table(
            {
                "rep": pa.array(np.concatenate([*reps, a[:, 0]])),
                "other": pa.array([None] * gained + a[:, 1].tolist(), pa.int64()),
                "n": pa.array(np.concatenate([*gains, np.zeros(len(a), np.int64)])),
            }
        )

    return run


def links(classes: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """From classes of equal vectors (rep, n, vector: doubles as bytes): rows (rep, null, n), the number of other
    rows linked to a class, in parts to be summed, and rows (a, b, 0), links that span each set of linked ones.

    A cell's vectors meet those of the cell itself and of its four neighbours on the larger side. A cell with
    more vectors than ``left``, or more to meet than ``right``, is dealt out over several tasks; how many comes from
    exact counts, of which there are as many as cells, and they are bounded by the grid.
    """
    if cosine <= 0:
        raise ValueError("cosine must be over 0")
    ship(classes.sparkSession)
    dealt = write_out(classes.select("rep", "n", "vector").mapInArrow(_deal(cosine, blocks), DEALT), "vector-cells")
    at = ["block", "dim", "x", "y"]
    counts = dealt.groupBy(*at).agg(F.count("*").alias("k"))
    # Cells with whose vectors the vectors of a cell are compared: itself and half of those around it.
    steps = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]
    meets = F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(1 if (dx, dy) == (0, 0) else 2).alias("side")) for dx, dy in steps]))
    met = counts.select("block", "dim", meets.alias("c"), "k").groupBy("block", "dim", F.col("c.x").alias("x"), F.col("c.y").alias("y")).agg(F.sum("k").alias("m"))
    shares = counts.join(met, at).select(*at, F.ceil(F.col("k") / left).cast("int").alias("n_left"), F.ceil(F.col("m") / right).cast("int").alias("n_right"))

    body = ["rep", "n", "vector"]
    hashed = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)).cast("int")
    # The cell's own vectors: each belongs to one left share, and meets every right share.
    own = dealt.join(shares, at).select(*at, *body, F.lit(0).alias("side"), (hashed % F.col("n_left")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"))
    sent = dealt.select("block", "dim", meets.alias("c"), *body).select("block", "dim", F.col("c.x").alias("x"), F.col("c.y").alias("y"), *body, F.col("c.side").alias("side"))
    # What they meet: each in one right share, with every left share. Where a cell is empty nothing meets.
    other = sent.join(shares, at).select(*at, *body, "side", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), (hashed % F.col("n_right")).alias("j"))
    return own.unionByName(other).groupBy(*at, "i", "j").applyInArrow(_search(blocks, cosine), FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """``vectors`` (vec_id, embedding, ...) with n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without vec_id, link with
    nothing: n_links 0, and each is its own component (kept, unless vec_id is null). Vectors of different
    length don't link. Equal vectors are one class and are never paired; rows with the same vec_id count as
    different vectors. Every row gives a row; an empty table gives none; clashing columns are replaced.
    """
    ship(vectors.sparkSession)
    added = ["n_links", "component_id", "kept"]
    rows = vectors.select(*[F.col(quoted(c)) for c in vectors.columns if c not in added])
    exact, h = fresh([*rows.columns, *added], "exact"), fresh([*rows.columns, *added], "h")
    values = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fit = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists(values, lambda v: v != 0), F.lit(False))
    # Rows meet their class by all values; their hash only comes first in the comparison. Adding 0 makes -0 one with 0.
    keyed = rows.withColumn(exact, F.when(fit, F.transform(values, lambda v: v + F.lit(0.0)))).withColumn(h, F.xxhash64(exact))
    usable = keyed.filter(F.col(exact).isNotNull())
    classes = usable.groupBy(h, exact).agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("n"))
    # Numbers that stay what they are once they are written tell classes apart, whatever ids and hashes do.
    classes = write_out(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    found = write_out(links(classes.select(F.col("node").alias("rep"), "n", _packed(F.col(exact)).alias("vector")), cosine, blocks, left, right), "vector-links")
    gained = found.filter(F.col("other").isNull()).groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("gained"))
    comps = write_out(components(found.filter(F.col("other").isNotNull()).select(F.col("rep").alias("a"), F.col("other").alias("b"))), "components")
    labelled = classes.drop(exact, h).join(comps, "node", "left").join(gained, "node", "left")
    labelled = write_out(labelled.select("node", "least", "n", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links")), "classes")
    firsts = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    of_class = join_groups(labelled, firsts, "component", "size").select("node", "n_links", "component_id")
    labels = write_out(classes.select("node", h, exact, "n").join(of_class, "node").drop("node"), "labels")
    joined = join_groups(usable, labels, [h, exact], "n").drop(h, exact)
    alone = keyed.filter(F.col(exact).isNull()).drop(h, exact).withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id").cast("long")})
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _packed(values):
    """The doubles' bytes, little-endian: made in Python batches, as no built-in function does it."""

    @F.udf(T.BinaryType(), useArrow=True)
    def pack(v: list) -> bytes:
        return np.asarray(v, np.float64).tobytes()

    return pack(values)


def op2(vectors: DataFrame) -> DataFrame:
    """The contract's columns; nulls, odd vectors, repeats and ties as in ``near_duplicates``."""
    return near_duplicates(vectors.select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


OP2_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, seen) as (
  select vec_id, vec_id from v
  union
  select l.b, r.seen from r join l on l.a = r.node where r.seen < l.b),
n as (select a, count(*) as k from l group by a),
c as (select node, min(seen) as m from r group by node)
select e.vec_id, cast(coalesce(n.k, 0) as bigint) as n_links, coalesce(c.m, e.vec_id) as component_id,
       coalesce(e.vec_id = coalesce(c.m, e.vec_id), false) as kept
from embeddings e left join n on e.vec_id = n.a left join c on e.vec_id = c.node
"""
