"""Connected components of a graph of links, without gathering the links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from roadlens.llm.common import join_groups, write_out


def _stars(edges: DataFrame, *, large: bool) -> DataFrame:
    """One star step. Large: each node hangs its larger neighbours on its least one; small: a node hangs
    itself and its smaller neighbours on the least. The least of a hub is a map-side minimum, and hubs, which are
    few, are broadcast for the join back to their links."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    sizes = Observation()
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = write_out(least.observe(sizes, F.sum("n").alias("total"), F.max("n").alias("most")), "least")
    hubs = least.select("a", F.least("a", "m").alias("m"), "n")
    joined = join_groups(near, hubs, "a", "n", (sizes.get["total"], sizes.get["most"]))
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return write_out(moved.filter(F.col("a") != F.col("b")).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node that has a link in ``edges`` (a, b: long).

    Links from or to null, and of a node to itself, are ignored; repeated and reversed links are allowed; no
    links give no rows. Alternating large and small stars take a number of rounds that grows with the
    logarithm of the longest chain. Each step is written to the shared folder, so that neither lineage nor a
    lost executor reaches back over rounds.
    """
    links = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = write_out(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = links.select(mark.alias("m")).first()["m"]
    while before[0]:
        links = _stars(_stars(links, large=True), large=False)
        after = links.select(mark.alias("m")).first()["m"]
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
