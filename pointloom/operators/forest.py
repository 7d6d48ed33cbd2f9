"""A minimum spanning forest over all tasks that knows whether two nodes' signs agree.

Rounds as Boruvka's: every component takes its cheapest link to another one, the chosen
links' pointers are doubled until all point to a root, and links are carried over to the
roots, of equal ends the cheapest.  Each pointer carries the parity of the flips on its way,
so in the end every node knows its root and whether its sign must be turned against it.
A round at least halves the components that still have links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import stored


def _jumped(pointers: DataFrame) -> DataFrame:
    """Each pointer (model_id, c, p, flip) moved on to where its end points."""
    ahead = pointers.select("model_id", F.col("c").alias("p"), F.col("p").alias("pp"), F.col("flip").alias("more"))
    return pointers.join(ahead, ["model_id", "p"]).select("model_id", "c", F.col("pp").alias("p"), (F.col("flip") != F.col("more")).alias("flip"), (F.col("p") != F.col("pp")).alias("moved"))


def _roots(best: DataFrame) -> DataFrame:
    """Pointers from components to the roots of the trees that their cheapest links make."""
    back = best.select("model_id", F.col("d").alias("c"), F.col("c").alias("d"), F.lit(True).alias("mutual"))
    # Two that chose each other: the smaller is the root.
    root = F.col("mutual").isNotNull() & (F.col("c") < F.col("d"))
    pointers = best.join(back, ["model_id", "c", "d"], "left")
    pointers = stored(pointers.select("model_id", "c", F.when(root, F.col("c")).otherwise(F.col("d")).alias("p"), (F.col("flip") & ~root).alias("flip")), "pointers")
    while True:
        pointers = stored(_jumped(_jumped(pointers)), "pointers")
        if pointers.where("moved").isEmpty():
            return pointers.drop("moved")


def spanning_forest(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Adds to nodes (model_id, point_id) root, the same for all of a component, and flip, its parity against the root.

    links: model_id, a, b, cost, flip, in any direction; of equal costs that of the least ends is cheaper.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    weight = F.struct("cost", low.alias("a"), high.alias("b"))
    live = links.where("a <> b").select("model_id", low.alias("ca"), high.alias("cb"), weight.alias("w"), "flip")
    live = stored(live.groupBy("model_id", "ca", "cb").agg(F.min(F.struct("w", "flip")).alias("m")).select("model_id", "ca", "cb", "m.w", "m.flip"), "links")
    found = nodes.select("model_id", "point_id", F.col("point_id").alias("root"), F.lit(False).alias("flip"))
    while not live.isEmpty():
        both = live.select("model_id", F.col("ca").alias("c"), F.col("cb").alias("d"), "w", "flip").unionByName(live.select("model_id", F.col("cb").alias("c"), F.col("ca").alias("d"), "w", "flip"))
        best = both.groupBy("model_id", "c").agg(F.min(F.struct("w", "d", "flip")).alias("m")).select("model_id", "c", "m.d", "m.flip")
        roots = _roots(stored(best, "best"))
        to = lambda c: roots.select("model_id", F.col("c").alias(c), F.col("p").alias(f"{c}_p"), F.col("flip").alias(f"{c}_flip"))
        moved = live.join(to("ca"), ["model_id", "ca"]).join(to("cb"), ["model_id", "cb"]).where("ca_p <> cb_p")
        flip = (F.col("flip") != F.col("ca_flip")) != F.col("cb_flip")
        moved = moved.select("model_id", F.least("ca_p", "cb_p").alias("ca"), F.greatest("ca_p", "cb_p").alias("cb"), F.struct("w", flip.alias("flip")).alias("m"))
        live = stored(moved.groupBy("model_id", "ca", "cb").agg(F.min("m").alias("m")).select("model_id", "ca", "cb", "m.w", "m.flip"), "links")
        found = found.join(to("root"), ["model_id", "root"], "left").select(
            "model_id", "point_id", F.coalesce("root_p", "root").alias("root"), (F.col("flip") != F.coalesce("root_flip", F.lit(False))).alias("flip")
        )
        found = stored(found, "found")
    return found
