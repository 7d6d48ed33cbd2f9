"""What a user does: each action is one plan over all models at once."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning, meshes, mrf, parts, solids, spatial
from ..sources import formats


def open_models(spark: SparkSession, path: str, kind: str = "off", seg: str | None = None, sdff: str | None = None) -> DataFrame:
    """Points (model_id, point_id, x, y, z, nx, ny, nz) in the unit ball.

    With ``seg`` (face labels, files named like the meshes) also part_label, null where no
    face tells; with ``sdff`` (values by vertex) also sdf.
    """
    if kind == "xyz":
        return solids.normalize(formats.read_xyz(spark, path, rotate=True))
    vertices, faces = formats.read_off(spark, path)
    points = spatial.checkpointed(spark, vertices.withColumnRenamed("vertex_id", "point_id"))
    normals = solids.radius_normals(points) if kind == "plain" else solids.jet_normals(points)
    if kind != "plain":
        normals = solids.orient_normals(points.join(normals, ["model_id", "point_id"])).select("model_id", "point_id", "nx", "ny", "nz")
    points = solids.normalize(points.join(normals, ["model_id", "point_id"]))
    if seg:
        labels = solids.vertex_labels(faces, formats.read_seg(spark, seg)).select("model_id", F.col("vertex_id").alias("point_id"), F.col("label").alias("part_label"))
        points = points.join(labels, ["model_id", "point_id"], "left")
    if sdff:
        values = formats.read_sdff(spark, sdff).withColumnRenamed("vertex_id", "point_id")
        points = points.join(values, ["model_id", "point_id"], "left")
    return points


def save_models(points: DataFrame, path: str) -> None:
    formats.write_ply(points, path)


def estimate_features(points: DataFrame, sdf: DataFrame | None = None) -> DataFrame:
    """The 27 features of every point; shape diameters are computed unless given."""
    features = spatial.multiscale(points)
    sdf = spatial.point_sdf(points) if sdf is None else sdf
    keys = ["model_id", "point_id"]
    extra = [c for c in ("part_label",) if c in points.columns]
    return features.join(points.select(*keys, "x", "y", "z", F.col("y").alias("height"), *extra), keys).join(sdf.select(*keys, "sdf"), keys)


def extract_point_features(points: DataFrame, path: str, sdf: DataFrame | None = None) -> DataFrame:
    """Features as Parquet below ``path``, and the class's labels, sorted."""
    estimate_features(points, sdf).write.mode("overwrite").parquet(f"{path}/features")
    found = points.sparkSession.read.parquet(f"{path}/features")
    found.select("part_label").where("part_label IS NOT NULL").distinct().orderBy("part_label").write.mode("overwrite").parquet(f"{path}/labels")
    return found


def train_point_classifier(features: DataFrame, path: str | None = None, trees: int = 100) -> PipelineModel:
    model = learning.train(features, trees=trees)
    if path:
        model.write().overwrite().save(path)
    return model


def test_point_cloud(model: PipelineModel | str, features: DataFrame) -> DataFrame:
    """Label distributions with the null label."""
    model = PipelineModel.load(model) if isinstance(model, str) else model
    return learning.with_null_label(learning.distributions(model, features))


test_point_cloud.__test__ = False


def compute_sdf(spark: SparkSession, path: str) -> DataFrame:
    """Shape diameters of the vertices of valid meshes; a mesh that is none is an error that names it and its problems."""
    vertices, faces = (spatial.stored(df, "mesh") for df in formats.read_off(spark, path))
    wrong = meshes.problems(vertices, faces).groupBy("model_id").agg(F.array_sort(F.collect_set("problem")).alias("of")).orderBy("model_id").limit(20).collect()
    if wrong:
        raise ValueError("not a valid mesh: " + "; ".join(f"{r['model_id']}: {', '.join(r['of'])}" for r in wrong))
    return meshes.mesh_sdf(vertices, faces)


def normalize_meshes(spark: SparkSession, path: str, to: str) -> None:
    vertices, faces = formats.read_off(spark, path)
    formats.write_off(solids.normalize(vertices), faces, to)


def compute_obb(points: DataFrame) -> DataFrame:
    return parts.part_boxes(points)


def train_part_relations(points: DataFrame) -> DataFrame:
    """Priors of all label pairs in long form."""
    return parts.priors(parts.pair_relations(parts.part_boxes(points)))


def infer_structure(points: DataFrame, dist: DataFrame, priors: DataFrame, symmetry: DataFrame, radius: float = 0.2, iterations: int = 100) -> DataFrame:
    """Boxes that explain each model: one a picked label, model_id, label, cand_id, energy and the box.

    dist has the null label, which is its last.
    """
    spark = points.sparkSession
    dist = spatial.checkpointed(spark, dist.select("model_id", "point_id", "label", "prob"))
    labels = dist.select("label").distinct()
    null_label = labels.agg(F.max("label")).collect()[0][0]
    clouds = parts.assign_clouds(dist.where(F.col("label") < null_label), symmetry).where("part IS NOT NULL")
    clustered = parts.clusters(points.select("model_id", "point_id", "x", "y", "z").join(clouds, ["model_id", "point_id"]), radius)
    clustered = spatial.stored(clustered, "clustered")
    cands = spatial.stored(parts.candidates(clustered, with_points=False), "candidates")
    # All boxes of a cluster have its points, and so its costs.
    own = clustered.select("model_id", F.struct("part", "cluster").alias("cand_id"), "point_id")
    costs = parts.unary_energy(own, dist).select("model_id", "cand_id.part", "cand_id.cluster", "label", "cost")
    unary = cands.select("model_id", "cand_id", "part", "cluster").join(costs, ["model_id", "part", "cluster"]).select("model_id", "cand_id", "label", "cost")
    pairwise = parts.pair_costs(cands, labels, parts.prior_inverses(priors), null_label)
    solved = mrf.solve(unary.withColumnRenamed("cand_id", "node"), pairwise, iterations=iterations)
    best = parts.picked(solved, null_label).join(solved.select("model_id", "node", "energy"), ["model_id", "node"])
    return best.withColumnRenamed("node", "cand_id").join(cands.select("model_id", "cand_id", "cluster_no", "right_handed", "rot", "trans", "scale", "axes"), ["model_id", "cand_id"])
