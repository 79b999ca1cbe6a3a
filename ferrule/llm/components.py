"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each id of edges(a, b) but the roots; root is its component's lowest id.

    An edge points from the higher id to the lower. Every round hangs an edge's ends on the lowest neighbour known of
    its lower end (large star), then all lower neighbours of an id on the lowest of them (small star), after Kiveris
    and others, "Connected Components in MapReduce and Beyond". Lowest neighbours are minima that are combined on the
    map side and joined back, broadcast where they are few; no task holds a star's whole neighbourhood. Rounds grow
    with the logarithm of the longest chain; each is written to the shared folder and the one before deleted.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        down = stored(edges.groupBy(F.col("u").alias("__of")).agg(F.min("v").alias("__low")), "down")
        large = stored(edges.join(small(down), F.col("v") == F.col("__of"), "left").select("u", F.coalesce("__low", "v").alias("v")).distinct(), "large")
        low = stored(large.groupBy(F.col("u").alias("__of")).agg(F.min("v").alias("__low")), "low")
        both = large.join(small(low), F.col("u") == F.col("__of"))
        hung = F.when(F.col("v") == F.col("__low"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", F.col("__low").alias("v")), F.struct(F.col("v").alias("u"), F.col("__low").alias("v"))))
        after = stored(both.select(F.explode(hung).alias("e")).select("e.*").distinct(), "edges")
        release(edges, down, large, low)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            out._ferrule_path = edges._ferrule_path
            return out
        before = now
