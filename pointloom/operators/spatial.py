"""Neighbourhood joins, connected components and neighbourhood features.

Neighbours are met block by block (``blocks``); where points are sparse, a distance join is an
equi-join on grid cells: a point is in one cell and looks in the 27 around it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

#: Radii of the five feature scales, as parts of a model's radius.
SCALES = (0.1, 0.2, 0.3, 0.4, 0.5)
NEAR = ["model_id", "src", "dst", "d2", "dx", "dy", "dz"]


def radius_join(points: DataFrame, radius: float, places: bool = True, digits: int | None = None, models: bool = True) -> DataFrame:
    """All (src, dst) of a model within ``radius``, itself included: model_id (if ``models``), src, dst, d2 (rounded if ``digits`` are given) and, if wanted, the neighbour's place."""
    from . import blocks

    return blocks.near_pairs(points, radius, places, digits, models)


def grid_join(points: DataFrame, radius: float, others: DataFrame | None = None) -> DataFrame:
    """``radius_join`` as an equi-join on grid cells, each point looking in 27: for sparse clouds."""
    cell = lambda c, k=0: F.floor(F.col(c) / radius) + k
    left = points.select("model_id", F.col("point_id").alias("src"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    left = left.withColumn("o", F.explode(offsets)).select("model_id", "src", "sx", "sy", "sz", *[(cell(f"s{c}") + F.col(f"o.{n}")).alias(f"c{c}") for c, n in zip("xyz", "ijk", strict=True)])
    right = (others if others is not None else points).select("model_id", F.col("point_id").alias("dst"), *[F.col(c).alias(f"d{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    d2 = G.sum_of((F.col(f"s{c}") - F.col(f"d{c}")) * (F.col(f"s{c}") - F.col(f"d{c}")) for c in "xyz")
    return left.join(right, ["model_id", "cx", "cy", "cz"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select(*NEAR)


def knn(points: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """The k nearest others, ties by id: model_id, src, dst, d2, rank.  How far to look follows from the points; ``radius`` is not needed."""
    from . import blocks

    return blocks.k_nearest(points, k)


def shared_dir(spark) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine may go without: it gets a temporary folder.
    """
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not given:
        import tempfile

        given = tempfile.mkdtemp(prefix="pointloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(given)
    return given.rstrip("/")


def checkpointed(spark, df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_dir(spark)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pointloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id; edges: src, dst (any direction).  Adds ``component``, its smallest id.

    Each round takes the least label of all neighbours, then the label's own label (pointer
    jumping), so long chains need few rounds.
    """
    spark = nodes.sparkSession
    both = checkpointed(spark, edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct())
    labels = checkpointed(spark, nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        least = both.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("least"))
        hooked = labels.join(least, F.col("id") == F.col("src"), "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("was"))
        top = hooked.select(F.col("id").alias("top"), F.col("component").alias("further"))
        jumped = checkpointed(spark, hooked.join(top, F.col("component") == F.col("top"), "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "was"))
        labels = jumped.select("id", "component")
        if jumped.where("component <> was").isEmpty():
            return labels


def radius_components(points: DataFrame, radius: float) -> DataFrame:
    """model_id, point_id, component: its model's smallest point_id that links of at most ``radius`` lead to.

    Points of a grid cell whose diagonal is shorter than the radius are linked in any case, so
    cells are the nodes.  Boxes of two cells' points mostly tell whether they link; points
    are compared only where boxes do not and links of other cells do not join both already.
    """
    from . import blocks

    side, r2 = radius / 3**0.5 * (1 - 1e-6), radius * radius
    at = ["cx", "cy", "cz"]
    placed = blocks.whole(points.select("model_id", "point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    placed = placed.withColumns({f"c{c}": F.floor(F.col(c) / side) for c in "xyz"})
    cells = placed.groupBy("model_id", *at).agg(F.min("point_id").alias("cell"), *[f(c).alias(f"{e}_{c}") for c in "xyz" for e, f in (("low", F.min), ("high", F.max))], *[f(F.struct("x", "y", "z"), c).alias(f"{e}est_{c}") for c in "xyz" for e, f in (("low", F.min_by), ("high", F.max_by))])
    cells = stored(cells, "cells")
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(ijk, "ijk", strict=True)]) for ijk in steps])
    bounds = [f"{e}_{c}" for c in "xyz" for e in ("low", "high", "lowest", "highest")]
    a = cells.select("model_id", F.col("cell").alias("a"), *[F.col(b).alias(f"a_{b}") for b in bounds], *at, F.explode(steps).alias("o"))
    a = a.withColumns({c: F.col(c) + F.col(f"o.{o}") for c, o in zip(at, "ijk", strict=True)}).drop("o")
    both = a.join(cells.withColumnRenamed("cell", "b"), ["model_id", *at])
    gap = [F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"a_high_{c}"), F.col(f"a_low_{c}") - F.col(f"high_{c}")) for c in "xyz"]
    far = [F.greatest(F.col(f"high_{c}") - F.col(f"a_low_{c}"), F.col(f"a_high_{c}") - F.col(f"low_{c}")) for c in "xyz"]
    # Outermost points that face each other along an axis: full cells side by side link there.
    outer = [(f"a_{e}est_{c}", f"{o}est_{c}") for c in "xyz" for e, o in (("low", "high"), ("high", "low"))]
    sure = G.sum_of(f * f for f in far) <= r2
    for one, other in outer:
        sure = sure | (G.sum_of((F.col(f"{one}.{c}") - F.col(f"{other}.{c}")) * (F.col(f"{one}.{c}") - F.col(f"{other}.{c}")) for c in "xyz") <= r2)
    both = both.where(G.sum_of(g * g for g in gap) <= r2).select("model_id", "a", "b", sure.alias("sure"))
    both = stored(both, "cell-pairs")
    node = lambda c: F.struct(F.col("model_id").alias("m"), F.col(c).alias("v"))
    ends = lambda df: df.select(node("a").alias("src"), node("b").alias("dst"))
    known = components(cells.select(node("cell").alias("id")), ends(both.where("sure")))
    label = lambda c: known.select(F.col("id.m").alias("model_id"), F.col("id.v").alias(c), F.col("component.v").alias(f"{c}_of"))
    doubtful = both.where("NOT sure").join(label("a"), ["model_id", "a"]).join(label("b"), ["model_id", "b"]).where("a_of <> b_of")
    doubtful = stored(doubtful.select("model_id", "a", "b", "a_of", "b_of"), "doubtful")
    if not doubtful.isEmpty():
        own = placed.join(cells.select("model_id", *at, "cell"), ["model_id", *at]).select("model_id", "cell", "x", "y", "z")
        sides = [doubtful.join(own.withColumnRenamed("cell", c), ["model_id", c]).select("model_id", "a", "b", F.lit(c).alias("end"), "x", "y", "z") for c in "ab"]
        met = blocks.touching(sides[0].unionByName(sides[1]), r2)
        links = doubtful.join(met, ["model_id", "a", "b"]).select("model_id", F.col("a_of").alias("a"), F.col("b_of").alias("b"))
        joined = components(known.select(F.col("component").alias("id")), ends(links)).select(F.col("id").alias("component"), F.col("component").alias("top"))
        known = known.join(joined, "component").select("id", F.col("top").alias("component"))
    of_cell = cells.select("model_id", *at, node("cell").alias("id")).join(known, "id").select("model_id", *at, F.col("component.v").alias("component"))
    found = placed.join(of_cell, ["model_id", *at]).select("model_id", "point_id", "component")
    # Points without a whole place are alone.
    return points.select("model_id", "point_id").join(found, ["model_id", "point_id"], "left").select("model_id", "point_id", F.coalesce("component", "point_id").alias("component"))


#: Points that thinning deals with first, about, and how much more of all points each next turn.
FIRST_THINNED, MORE_THINNED = 2000, 8


def thinned(points: DataFrame, distance: float) -> DataFrame:
    """Points no two of which are nearer than ``distance``, while every point left out has a kept one nearer.

    In order of their ids' hashes a point is kept unless a nearer one is kept already.  A
    share of that order is dealt with at a time, eight times the last: points near those kept
    are gone before they are linked to others, so links stay few however dense the cloud is.
    """
    from . import blocks

    distance = float(distance)
    hash_ = F.md5(F.col("point_id").cast("string").cast("binary"))
    share = F.conv(F.substring(hash_, 1, 8), 16, 10).cast("double") / 2.0**32
    live = blocks.whole(points.select("model_id", "point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    live = stored(live.select("*", share.alias("share"), F.struct(hash_.alias("hash"), F.col("point_id").alias("id")).alias("at")), "live")
    upto, out = FIRST_THINNED / max(live.count(), 1), None
    while True:
        some = live if upto >= 1 else live.where(F.col("share") < upto)
        kept = stored(_thinned_links(some, distance), "kept")
        out = kept if out is None else out.unionByName(kept)
        if upto >= 1:
            break
        cell = lambda c, k=0: F.floor(F.col(c) / distance) + k
        around = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
        wide = kept.select(F.col("model_id").alias("k_model"), *[F.col(c).alias(f"k{c}") for c in "xyz"], F.explode(around).alias("o"))
        wide = wide.withColumns({f"k_cell{c}": cell(f"k{c}") + F.col(f"o.{n}") for c, n in zip("xyz", "ijk", strict=True)}).drop("o")
        rest = live.where(F.col("share") >= upto).withColumns({f"cell{c}": cell(c) for c in "xyz"})
        d2 = G.sum_of((F.col(c) - F.col(f"k{c}")) * (F.col(c) - F.col(f"k{c}")) for c in "xyz")
        same = F.col("model_id").eqNullSafe(F.col("k_model")) & (d2 < distance * distance)
        for c in "xyz":
            same = same & (F.col(f"cell{c}") == F.col(f"k_cell{c}"))
        live = stored(rest.join(wide, same, "left_anti").select(*live.columns), "live")
        upto *= MORE_THINNED
    # Points without a whole place are near nothing.
    gone = blocks.whole(points).select("model_id", "point_id").join(out.select("model_id", "point_id"), ["model_id", "point_id"], "left_anti")
    return points.join(gone, ["model_id", "point_id"], "left_anti")


def _thinned_links(points: DataFrame, distance: float) -> DataFrame:
    """``thinned`` of few points, by all their links: in each round those that come before all their neighbours are kept and those neighbours left out."""
    order = lambda c: points.select("model_id", F.col("point_id").alias(c), F.col("at").alias(f"{c}_at"))
    near = grid_join(points, distance).where((F.col("src") != F.col("dst")) & (F.col("d2") < distance * distance)).select("model_id", "src", "dst")
    links = stored(near.join(order("src"), ["model_id", "src"]).join(order("dst"), ["model_id", "dst"]), "links")
    out = points.select("model_id", "point_id").where("false")
    while not links.isEmpty():
        first = links.groupBy("model_id", "src", "src_at").agg(F.min("dst_at").alias("other")).where("src_at < other").select("model_id", "src")
        gone = stored(links.join(first, ["model_id", "src"], "left_semi").select("model_id", F.col("dst").alias("point_id")).distinct(), "gone")
        out = out.unionByName(gone)
        for c in ("src", "dst"):
            links = links.join(gone.withColumnRenamed("point_id", c), ["model_id", c], "left_anti")
        links = stored(links, "links")
    return points.join(out, ["model_id", "point_id"], "left_anti")


def moments(points: DataFrame, radius: float, centered: bool = False) -> DataFrame:
    """Per point (src) n and the 3 x 3 second moment (xx, xy, ...) of its neighbours: about the origin, or centred."""
    from . import blocks

    found, own = blocks.around(points, [radius * radius], raw=not centered, mid=centered), "mid0" if centered else "raw0"
    return found.select("model_id", "src", F.col("n0").alias("n"), *[F.col(f"{own}{c}").alias(c) for c in G.SIX])


def multiscale(points: DataFrame, model_radius: float = 1.0, scales=SCALES, centered: bool = False) -> DataFrame:
    """The five numbers of every scale, all scales in one pass over blocks.

    Eigenvalue quotients and gravity projections come from the raw (or centred) second
    moment, curvature from the centred one; n0, n1 ... count the neighbours, the point included.
    """
    from . import blocks

    sums = blocks.around(points, [(c * model_radius) ** 2 for c in scales], raw=not centered)
    sets, out = {}, []
    for s in range(len(scales)):
        for name in (f"mid{s}",) if centered else (f"mid{s}", f"raw{s}"):
            sets[name] = [F.col(f"{name}{c}") for c in G.SIX]
        own = f"mid{s}" if centered else f"raw{s}"
        q = G.quotients(own)
        grav = [-F.get(f"{own}_e{e}", F.lit(1)) for e in (1, 3)]
        out += [q[0].alias(f"evqu{s}0"), q[1].alias(f"evqu{s}1"), grav[0].alias(f"grav{s}0"), grav[1].alias(f"grav{s}1"), G.curvature(f"mid{s}").alias(f"curvature{s}")]
    solved = G.with_eigen(sums, sets, tuple(n for n in sets if n.startswith("mid" if centered else "raw")))
    return solved.select("model_id", F.col("src").alias("point_id"), *[f"n{s}" for s in range(len(scales))], *out)


#: Points of a model up to which ``point_sdf`` compares all pairs, as choosing them would take longer.
ALL_PAIRS = 2500


def point_sdf(points: DataFrame, cone: float = 30.0, leaf: int | None = None, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """Shape diameter of each point: what lies opposite, inside a cone around its inward normal.

    Only points of blocks that some cone of a block may hold are compared, inside tasks
    (``cones.diameters``), unless all models are small.  Kept distances lie within one standard deviation of their median
    and are weighted by one over the angle; without hits it is 0.
    """
    from . import cones

    given = stored(cones.unit_normals(points.select("model_id", "point_id", "x", "y", "z", "nx", "ny", "nz")), "points")
    if (given.groupBy("model_id").count().agg(F.max("count")).collect()[0][0] or 0) > all_pairs:
        return _with_zeros(points, cones.diameters(given, cone, leaf or cones.LEAF))
    own = given.select("model_id", F.col("point_id").alias("src"), *[F.col(c).alias(f"s{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    other = given.select("model_id", F.col("point_id").alias("dst"), *[F.col(c).alias(f"d{c}") for c in ("x", "y", "z", "nx", "ny", "nz")])
    v = [F.col(f"d{c}") - F.col(f"s{c}") for c in "xyz"]
    sn, dn = [F.col(f"sn{c}") for c in "xyz"], [F.col(f"dn{c}") for c in "xyz"]
    d = F.sqrt(G.dot(v, v))
    cosine = -G.dot(v, sn) / F.nullif(d * F.sqrt(G.dot(sn, sn)), F.lit(0.0))
    hits = own.join(other, "model_id").where("src <> dst").where(G.dot(sn, dn) <= 0)
    hits = hits.select("model_id", "src", d.alias("d"), F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))).alias("angle"))
    hits = hits.where((F.col("angle") > 0) & (F.col("angle") <= cone))
    middle = hits.groupBy("model_id", "src").agg(F.median("d").alias("med"), F.stddev_pop("d").alias("sd"))
    kept = hits.join(middle, ["model_id", "src"]).where(F.abs(F.col("d") - F.col("med")) <= F.col("sd") + 1e-8)
    sdf = kept.groupBy("model_id", "src").agg((F.sum(F.col("d") / F.col("angle")) / F.sum(1 / F.col("angle"))).alias("sdf"))
    return _with_zeros(points, sdf)


def _with_zeros(points: DataFrame, sdf: DataFrame) -> DataFrame:
    return points.select("model_id", "point_id").join(sdf.withColumnRenamed("src", "point_id"), ["model_id", "point_id"], "left").withColumn("sdf", F.coalesce("sdf", F.lit(0.0)))
