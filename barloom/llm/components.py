"""Connected components of a stored edge list, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import Stored


def components(edges: DataFrame, store: Stored) -> DataFrame:
    """(_node, _component) for the nodes of ``edges`` (_a, _b); a component is named by its smallest node.

    Each round hangs the larger neighbours of a node on its smallest one, then
    the node itself; the edges become stars after about log n rounds. The extremes of
    each node's neighbours tell whether they are, and then name the components; only
    that answer reaches the driver. Isolated nodes do not appear.
    """
    now, stored = edges.where("_a <> _b").select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")), None
    while True:
        back = now.select(F.col("_v").alias("_u"), F.col("_u").alias("_v"))
        low = now.unionByName(back).groupBy("_u").agg(F.least("_u", F.min("_v")).alias("_m"), F.max("_v").alias("_top"))
        # In a star, a node with a smaller neighbour has no other one.
        if not low.agg(F.max((F.col("_m") < F.col("_u")) & (F.col("_m") < F.col("_top")))).first()[0]:
            break
        large = back.join(low.select("_u", "_m"), "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        hung = F.when(F.col("_v") == F.col("_m"), F.col("_u")).otherwise(F.col("_v"))  # the node itself, or another neighbour
        now = store.keep(large.join(least, "_u").select(hung.alias("_u"), F.col("_m").alias("_v")).distinct())
        if stored is not None:
            store.drop(stored)
        stored = now
    found = store.keep(low.select(F.col("_u").alias("_node"), F.col("_m").alias("_component")))
    if stored is not None:
        store.drop(stored)
    return found


def merged(found: DataFrame, more: DataFrame, store: Stored) -> DataFrame:
    """Components ``found`` before, after further edges ``more``: only the components that these join are gone through again."""
    of = lambda x: found.select(F.col("_node").alias(x), F.col("_component").alias(f"_c{x}"))
    ends = more.join(of("_a"), "_a", "left").join(of("_b"), "_b", "left")
    joined = components(store.keep(ends.select(F.coalesce("_c_a", "_a").alias("_a"), F.coalesce("_c_b", "_b").alias("_b")).distinct()), store)
    renamed = joined.select(F.col("_node").alias("_component"), F.col("_component").alias("_new"))
    old = found.join(renamed, "_component", "left").select("_node", F.coalesce("_new", "_component").alias("_component"))
    return store.keep(old.unionByName(joined.join(found.select("_node"), "_node", "left_anti")))
