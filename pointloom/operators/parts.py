"""Oriented boxes, part relations, candidates and energies."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from .spatial import radius_components

UNARY_WEIGHT, PAIR_WEIGHT = 0.0025, 1e-4
#: Energies that stand for infinity.
INF, HARD_INF = 1e9, 3.3e33
NULL_PROB = 0.1
CONFIDENT = 0.7
BOX = "rot array<double>, trans array<double>, scale array<double>, height array<double>, axes array<double>"

#: The 24 frames: which eigenvector (0, 1, 2) and sign each axis takes.
FRAMES = [
    (n, ix, sx, iy, sy, 3 - ix - iy, sx * sy, int(round(np.linalg.det(np.array([np.eye(3)[ix] * sx, np.eye(3)[iy] * sy, np.eye(3)[3 - ix - iy] * sx * sy])))))
    for n, (ix, sx, iy, sy) in enumerate(x for x in itertools.product(range(3), (1, -1), range(3), (1, -1)) if x[0] != x[2])
]


#: What a set's points add up to: the covariance's six entries in order.
_SIX = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def principal_axes(cov: np.ndarray) -> np.ndarray:
    """Rows of each: eigenvectors of the covariances (n, 3, 3), largest first, largest component positive."""
    axes = np.linalg.eigh(cov)[1][:, :, ::-1].transpose(0, 2, 1)
    top = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[:, :, None], axis=2)
    return axes * np.where(top < 0, -1.0, 1.0)


def upright_axes(axes: np.ndarray) -> np.ndarray:
    """For each world axis the signed eigenvector that points most along it, each used once."""
    each, free, out = np.arange(len(axes)), np.ones(axes.shape[:2], bool), np.empty_like(axes)
    for w in range(3):
        best = np.where(free, np.abs(axes[:, :, w]), -1.0).argmax(axis=1)
        free[each, best] = False
        out[:, w] = axes[each, best] * np.where(axes[each, best, w] < 0, -1.0, 1.0)[:, None]
    return out


def set_extents(points: DataFrame, by: list[str], axes: list | None = None, upright: bool = False) -> DataFrame:
    """Of each set of points: ``by``, its mean, axes (row-major), the least and largest place along each, and whether they are right-handed.

    Moments are sums that merge, axes follow from a set's own row, and extents are minima and
    maxima of one projection: no task needs to see all points of a set.
    """
    mean = F.array(*[F.avg(c) for c in "xyz"]).alias("mean")
    moments = points.groupBy(*by).agg(mean, F.array(*[F.covar_pop(a, b) for a, b in _SIX]).alias("cov"))
    kinds = dict(points.dtypes)
    names = ", ".join(f"{k} {kinds[k]}" for k in by)

    def turn(batches):
        for batch in batches:
            six = batch.column(len(by) + 1).flatten().to_numpy().reshape(-1, 6)
            if axes is None:
                # Rounded, so that axes of a round or square set do not follow the order of its sums.
                size = six[:, [0, 3, 5]].sum(axis=1, keepdims=True)
                six = np.round(six / np.where(size > 0, size, 1), 10)
                own = principal_axes(six[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
                own = upright_axes(own) if upright else own
            else:
                own = np.broadcast_to(np.array(axes, float), (len(six), 3, 3))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(six) + 1) * 9, pa.int32()), pa.array(np.ascontiguousarray(own).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], flat, pa.array(np.linalg.det(own) > 0)], [*by, "mean", "axes", "right_handed"])

    turned = moments.mapInArrow(turn, f"{names}, mean array<double>, axes array<double>, right_handed boolean")
    own = points.select(*by, "x", "y", "z").join(turned, by)
    local = [G.sum_of((F.col(c) - F.get("mean", F.lit(w))) * F.get("axes", F.lit(3 * i + w)) for w, c in enumerate("xyz")) for i in range(3)]
    ends = [agg(local[i]).alias(f"{end}{i}") for i in range(3) for end, agg in (("low", F.min), ("high", F.max))]
    found = own.groupBy(*by).agg(*ends).join(turned, by)
    return found.select(*by, "mean", "axes", "right_handed", F.array("low0", "low1", "low2").alias("low"), F.array("high0", "high1", "high2").alias("high"))


def _boxed(df: DataFrame, axes, mean, middle: list, lengths: list) -> DataFrame:
    """Adds rot (row-major, columns are axes), trans, scale, height and axes of boxes whose middle is given along their axes."""
    axes = [F.get(axes, F.lit(k)) for k in range(9)]
    centre = [F.get(mean, F.lit(w)) + G.sum_of(middle[i] * axes[3 * i + w] for i in range(3)) for w in range(3)]
    out = df.withColumns({"trans": F.array(*centre), "scale": F.array(*lengths), "rot": F.array(*[axes[3 * i + w] for w in range(3) for i in range(3)]), "axes": F.array(*axes)})
    return out.withColumn("height", G.height_vector(F.col("rot"), F.col("trans"), F.col("scale")))


def part_boxes(points: DataFrame, axes=None) -> DataFrame:
    """One oriented box per model and part label (null labels have none): upright, or along given ``axes`` (rows)."""
    by = ["model_id", "part_label"]
    found = set_extents(points.where("part_label IS NOT NULL"), by, axes, upright=True)
    low, high = ([F.get(c, F.lit(i)) for i in range(3)] for c in ("low", "high"))
    boxed = _boxed(found, F.col("axes"), F.col("mean"), [(a + b) / 2 for a, b in zip(low, high, strict=True)], [b - a for a, b in zip(low, high, strict=True)])
    return boxed.select(*by, "rot", "trans", "scale", "height", "axes")


def box_corners(boxes: DataFrame) -> DataFrame:
    """Eight corners a box: centre plus or minus half of each axis."""
    signs = F.array(*[F.struct(F.lit(n).alias("corner"), *[F.lit(v).alias(c) for v, c in zip(s, "ijk", strict=True)]) for n, s in enumerate(itertools.product((-1, 1), repeat=3))])
    place = [F.get("trans", F.lit(w)) + G.sum_of(F.col(f"s.{c}") * 0.5 * F.get("scale", F.lit(a)) * F.get("axes", F.lit(3 * a + w)) for a, c in enumerate("ijk")) for w in range(3)]
    return boxes.withColumn("s", F.explode(signs)).select(*[c for c in boxes.columns if c not in ("rot", "trans", "scale", "height", "axes")], F.col("s.corner"), *[p.alias(n) for p, n in zip(place, "xyz", strict=True)])


#: Corner numbers of a box's twelve triangles, two a face.
TRIANGLES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def box_triangles(boxes: DataFrame) -> DataFrame:
    """Twelve triangles a box: triangle, a, b, c (places) and the unit normal of its face, outward."""
    rows = F.array(*[F.struct(F.lit(n).alias("triangle"), F.array(*[F.lit(v) for v in t]).alias("corners")) for n, t in enumerate(TRIANGLES)])
    keep = [c for c in boxes.columns if c not in ("rot", "trans", "scale", "height", "axes")]
    half = lambda bit, a: (F.when(bit == 1, 0.5).otherwise(-0.5)) * F.get("scale", F.lit(a))

    def place(corner):
        bits = [F.floor(corner / 4) % 2, F.floor(corner / 2) % 2, corner % 2]
        return F.array(*[F.get("trans", F.lit(w)) + G.sum_of(half(b, a) * F.get("axes", F.lit(3 * a + w)) for a, b in enumerate(bits)) for w in range(3)])

    out = boxes.withColumn("t", F.explode(rows)).withColumns({n: place(F.get("t.corners", F.lit(i))) for i, n in enumerate("abc")})
    side = lambda n: [F.get(n, F.lit(i)) - F.get("a", F.lit(i)) for i in range(3)]
    normal = G.cross(side("b"), side("c"))
    middle = [(F.get("a", F.lit(i)) + F.get("b", F.lit(i)) + F.get("c", F.lit(i))) / 3 - F.get("trans", F.lit(i)) for i in range(3)]
    size = F.nullif(F.sqrt(G.dot(normal, normal)), F.lit(0.0)) * F.when(G.dot(normal, middle) < 0, -1.0).otherwise(1.0)
    return out.select(*keep, F.col("t.triangle").alias("triangle"), "a", "b", "c", F.array(*[x / size for x in normal]).alias("normal"))


def as_obb(boxes: DataFrame) -> DataFrame:
    """A part as an oriented box: its three axes, centroid and full side lengths."""
    keep = [c for c in boxes.columns if c not in ("rot", "trans", "scale", "height", "axes")]
    return boxes.select(*keep, *[F.slice("axes", 3 * i + 1, 3).alias(f"axis_{c}") for i, c in enumerate("xyz")], F.col("trans").alias("centroid"), F.col("scale").alias("lengths"))


def as_part(obb: DataFrame) -> DataFrame:
    """An oriented box as a part: the columns of its rotation are the axes."""
    keep = [c for c in obb.columns if c not in ("axis_x", "axis_y", "axis_z", "centroid", "lengths")]
    rot = F.array(*[F.get(f"axis_{c}", F.lit(w)) for w in range(3) for c in "xyz"])
    out = obb.select(*keep, rot.alias("rot"), F.col("centroid").alias("trans"), F.col("lengths").alias("scale"), F.concat("axis_x", "axis_y", "axis_z").alias("axes"))
    return out.withColumn("height", G.height_vector(F.col("rot"), F.col("trans"), F.col("scale")))


def pair_relations(boxes: DataFrame) -> DataFrame:
    """All ordered pairs of differently labelled parts of a model with their 32 numbers."""
    side = lambda n: boxes.select("model_id", *[F.col(c).alias(f"{c}{n}") for c in ("part_label", "rot", "trans", "scale", "height")])
    both = side(1).join(side(2), "model_id").where("part_label1 <> part_label2")
    feat = G.relation(*[F.col(f"{c}1") for c in ("rot", "trans", "scale", "height")], *[F.col(f"{c}2") for c in ("rot", "trans", "scale", "height")])
    return both.select("model_id", F.col("part_label1").alias("label1"), F.col("part_label2").alias("label2"), feat.alias("feat"))


def _sketched(batches):
    """Of each label pair in a batch: count, means and centred products of all pairs of numbers, in long form."""
    for batch in batches:
        label1, label2 = (c.to_numpy() for c in batch.columns[:2])
        feat = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
        i, j = np.triu_indices(feat.shape[1] if len(batch) else 0)
        keys, which = np.unique(np.stack([label1, label2], axis=1), axis=0, return_inverse=True)
        for k, (a, b) in enumerate(keys.tolist()):
            own = feat[which.ravel() == k]
            mean = own.mean(axis=0)
            cross = (own - mean).T @ (own - mean)
            cells = [np.full(len(i), v) for v in (a, b)] + [i, j, np.full(len(i), len(own)), mean[i], mean[j], cross[i, j]]
            kinds = [batch.schema.types[0], batch.schema.types[1], pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], ["label1", "label2", "i", "j", "n", "mean_i", "mean_j", "m2"])


def priors(relations: DataFrame) -> DataFrame:
    """Mean and sample covariance of the relation vectors by label pair, in long form.

    Each Arrow batch gives one matrix product a label pair, so what is shuffled follows the
    pairs and batches, not the relations.  Relations without a vector or a label are left out.
    """
    whole = relations.where("feat IS NOT NULL AND label1 IS NOT NULL AND label2 IS NOT NULL").select("label1", "label2", "feat")
    kinds = dict(whole.dtypes)
    found = whole.mapInArrow(_sketched, f"label1 {kinds['label1']}, label2 {kinds['label2']}, i int, j int, n long, mean_i double, mean_j double, m2 double")
    keys = ["label1", "label2", "i", "j"]
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"all_{c}")
    whole = found.groupBy(*keys).agg(F.sum("n").alias("all_n"), mean("mean_i"), mean("mean_j"))
    # About the common mean: each batch's products and how far its own mean is off.
    off = F.col("n") * (F.col("mean_i") - F.col("all_mean_i")) * (F.col("mean_j") - F.col("all_mean_j"))
    sums = found.join(whole, keys).groupBy(*keys, "all_n", "all_mean_i", "all_mean_j").agg(F.sum(F.col("m2") + off).alias("m2"))
    cov = F.when(F.col("all_n") > 1, F.col("m2") / (F.col("all_n") - 1))
    return sums.select(*keys, F.col("all_mean_i").alias("mean_i"), F.col("all_mean_j").alias("mean_j"), cov.alias("cov"), F.col("all_n").alias("n"))


def prior_inverses(cells: DataFrame, ridge: float = 0.0) -> DataFrame:
    """label1, label2, mean and pseudo-inverse covariance (row-major), once per label pair."""

    def invert(pdf):
        size = int(pdf.j.max()) + 1
        cov, mean = np.zeros((size, size)), np.zeros(size)
        i, j = pdf.i.to_numpy(), pdf.j.to_numpy()
        cov[i, j] = cov[j, i] = pdf["cov"].fillna(0).to_numpy()
        mean[i], mean[j] = pdf.mean_i.to_numpy(), pdf.mean_j.to_numpy()
        inverse = np.linalg.pinv(cov + ridge * np.eye(size))
        return pdf.iloc[:1][["label1", "label2"]].assign(mean=[mean.tolist()], inverse=[inverse.ravel().tolist()])

    return cells.groupBy("label1", "label2").applyInPandas(invert, "label1 int, label2 int, mean array<double>, inverse array<double>")


def assign_clouds(dist: DataFrame, symmetry: DataFrame) -> DataFrame:
    """Part cloud of each point: model_id, point_id, part.

    dist: model_id, point_id, label, prob; symmetry: group_id, label, rep_label.  The first
    symmetry group whose probabilities sum to more than 0.7 wins, else the first confident
    label outside all groups; other points have none.
    """
    sure = lambda c: F.col(c) > CONFIDENT - 1e-6
    with_groups = dist.join(symmetry, "label", "left")
    groups = with_groups.where("group_id IS NOT NULL").groupBy("model_id", "point_id", "group_id", "rep_label").agg(F.sum("prob").alias("p")).where(sure("p"))
    first = groups.groupBy("model_id", "point_id").agg(F.min_by("rep_label", "group_id").alias("by_group"))
    single = with_groups.where("group_id IS NULL").where(sure("prob")).groupBy("model_id", "point_id").agg(F.min("label").alias("by_label"))
    both = first.join(single, ["model_id", "point_id"], "full_outer")
    return both.select("model_id", "point_id", F.coalesce("by_group", "by_label").alias("part"))


def clusters(cloud: DataFrame, radius: float = 0.2, least_part: int = 4, least_cluster: int = 3) -> DataFrame:
    """Connected components (radius graph) of each part cloud: adds ``cluster``, its smallest point.

    cloud: model_id, point_id, part, x, y, z.  Small clouds and components go.
    """
    big = cloud.groupBy("model_id", "part").count().where(F.col("count") >= least_part).select("model_id", "part")
    cloud = cloud.join(big, ["model_id", "part"])
    found = radius_components(cloud.withColumn("model_id", F.struct("model_id", "part")), radius)
    found = found.select("model_id.model_id", "model_id.part", "point_id", F.col("component").alias("cluster"))
    kept = found.groupBy("model_id", "part", "cluster").count().where(F.col("count") >= least_cluster).drop("count")
    return cloud.join(found, ["model_id", "part", "point_id"]).join(kept, ["model_id", "part", "cluster"])


def candidates(clustered: DataFrame, with_points: bool = True) -> DataFrame:
    """24 boxes a cluster, numbered per model: cand_id, label, cluster_no, box, right_handed, and point_ids if wanted.

    A frame is a signed permutation of a cluster's axes, so its box has the same middle and
    permuted lengths: points are measured once a cluster.
    """
    by = ["model_id", "part", "cluster"]
    found = set_extents(clustered, by)
    frames = F.array(*[F.struct(F.lit(n).alias("frame"), F.array(F.lit(ix), F.lit(iy), F.lit(iz)).alias("of"), F.array(F.lit(float(sx)), F.lit(float(sy)), F.lit(float(sz))).alias("sign"), F.lit(det > 0).alias("even")) for n, ix, sx, iy, sy, iz, sz, det in FRAMES])
    rows = found.withColumn("f", F.explode(frames))
    of, sign = ([F.get(F.col(f"f.{c}"), F.lit(k)) for k in range(3)] for c in ("of", "sign"))
    own = {"framed": F.array(*[sign[k] * F.get("axes", 3 * of[k] + w) for k in range(3) for w in range(3)])}
    rows = rows.withColumns(own)
    middle = [sign[k] * (F.get("low", of[k]) + F.get("high", of[k])) / 2 for k in range(3)]
    rows = _boxed(rows, F.col("framed"), F.col("mean"), middle, [F.get("high", of[k]) - F.get("low", of[k]) for k in range(3)])
    rows = rows.select(*by, "f.frame", (F.col("right_handed") == F.col("f.even")).alias("right_handed"), "rot", "trans", "scale", "height", "axes")
    if with_points:
        rows = rows.join(clustered.groupBy(*by).agg(F.sort_array(F.collect_list("point_id")).alias("point_ids")), by)
    number = Window.partitionBy("model_id").orderBy("part", "cluster", "frame")
    group = Window.partitionBy("model_id").orderBy("part", "cluster")
    return rows.withColumns({"cand_id": F.row_number().over(number) - 1, "cluster_no": F.dense_rank().over(group) - 1})


def unary_energy(members: DataFrame, dist: DataFrame, weight: float = UNARY_WEIGHT) -> DataFrame:
    """Mean of -ln p over a candidate's points for every label; p under 1e-6 costs ``INF``.

    members: model_id, cand_id, point_id.
    """
    cost = F.when(F.col("prob") < 1e-6, INF).otherwise(-F.ln("prob"))
    return members.join(dist, ["model_id", "point_id"]).groupBy("model_id", "cand_id", "label").agg((weight * F.avg(cost)).alias("cost"))


def pair_costs(cands: DataFrame, labels: DataFrame, inverses: DataFrame, null_label: int, weight: float = PAIR_WEIGHT, null_cost: float = INF / 2, slices: int = 8) -> DataFrame:
    """One row a candidate pair i < j of a model: ``costs`` of all label pairs, by label1, then label2, ascending.

    Two labels other than null in one cluster are out of the question; a null label costs
    ``null_cost``; equal labels and pairs without a prior cost ``INF``; else ``weight`` times
    the Mahalanobis distance of the pair's relation.  A model's pairs are dealt into
    ``slices``.  Labels are few by the data model (0 to ``MAX_LABEL`` and null), so the priors
    sent to the workers have a fixed bound; more labels than that are refused.
    """
    names = sorted(row["label"] for row in labels.where("label IS NOT NULL").distinct().limit(G.MAX_LABEL + 3).collect())
    if len(names) > G.MAX_LABEL + 2:
        raise ValueError(f"labels run from 0 to {G.MAX_LABEL}, with one more for null")
    place, size = {v: k for k, v in enumerate(names)}, len(names)
    known = inverses.where(F.col("label1").isin(names) & F.col("label2").isin(names) & (F.col("label1") != F.col("label2")) & F.col("inverse").isNotNull())
    table = [(place[row["label1"]], place[row["label2"]], np.array(row["mean"]), np.array(row["inverse"])) for row in known.collect() if null_label not in (row["label1"], row["label2"])]
    sent = cands.sparkSession.sparkContext.broadcast(table)
    free = np.array([v == null_label for v in names])
    base = np.where(free[:, None] | free[None, :], null_cost, INF)
    alike = np.where(free[:, None] | free[None, :], 0.0, HARD_INF)

    def fill(batches):
        for batch in batches:
            n = len(batch)
            same = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            feat = batch.column(4).flatten().to_numpy().reshape(n, -1)
            out = np.tile(base, (n, 1, 1))
            for a, b, mean, inverse in sent.value:
                off = feat - mean
                out[:, a, b] = weight * np.sqrt(np.maximum(((off @ inverse.reshape(len(mean), -1).T) * off).sum(axis=1), 0.0))
            out[same] = alike
            costs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size * size, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], costs], ["model_id", "i", "j", "costs"])

    side = lambda n: cands.select("model_id", *[F.col(c).alias(f"{c}{n}") for c in ("cand_id", "cluster_no", "rot", "trans", "scale", "height")])
    left = side(1).withColumn("slice", F.pmod(F.xxhash64("cand_id1"), F.lit(slices)))
    right = side(2).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    both = left.join(right, ["model_id", "slice"]).where("cand_id1 < cand_id2")
    feat = G.relation(*[F.col(f"{c}1") for c in ("rot", "trans", "scale", "height")], *[F.col(f"{c}2") for c in ("rot", "trans", "scale", "height")])
    rows = both.select("model_id", F.col("cand_id1").alias("i"), F.col("cand_id2").alias("j"), (F.col("cluster_no1") == F.col("cluster_no2")).alias("same"), feat.alias("feat"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(fill, f"model_id {kinds['model_id']}, i {kinds['i']}, j {kinds['j']}, costs array<double>")


def pairwise_energy(cands: DataFrame, labels: DataFrame, inverses: DataFrame, null_label: int, weight: float = PAIR_WEIGHT, null_cost: float = INF / 2) -> DataFrame:
    """``pair_costs`` in long form: model_id, i, j, label1, label2, cost."""
    packed = pair_costs(cands, labels, inverses, null_label, weight, null_cost)
    names = sorted(row["label"] for row in labels.where("label IS NOT NULL").distinct().collect())
    known = F.array(*[F.lit(v).cast(dict(labels.dtypes)["label"]) for v in names])
    cells = packed.select("model_id", "i", "j", F.posexplode("costs").alias("n", "cost"))
    at = lambda n: F.get(known, n.cast("int"))
    return cells.select("model_id", "i", "j", at(F.floor(F.col("n") / len(names))).alias("label1"), at(F.col("n") % len(names)).alias("label2"), "cost")


def picked(solution: DataFrame, null_label: int) -> DataFrame:
    """Of each picked label the candidate with the lowest number; solution: model_id, node, label."""
    return solution.where(F.col("label") != null_label).groupBy("model_id", "label").agg(F.min("node").alias("node"))
