"""Readers and writers of the text formats; every reader takes globs and keeps the file's path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import MAX_LABEL, model_name
from ..operators.learning import FEATURES


def _files(spark: SparkSession, path) -> DataFrame:
    """One row a file: these formats count lines from the top, so a file is one record."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))


def _model(path) -> Column:
    """The model a file is of: from the folder ``model_id=`` that the writers make, else from its name."""
    folder = F.regexp_extract(path, r"/model_id=([^/]*)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(model_name(path))


def _lines(spark: SparkSession, path) -> DataFrame:
    """path, model_id, line_no and line of every non-empty line."""
    rows = _files(spark, path).select("path", _model(F.col("path")).alias("model_id"), F.posexplode("lines").alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def _fields(line="line"):
    return F.split(F.trim(line), r"\s+")


def read_off(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """vertices (model_id, vertex_id, x, y, z) and faces (model_id, face_id, v0, v1, v2)."""
    files = _files(spark, path).select(_model(F.col("path")).alias("model_id"), F.filter("lines", lambda x: (F.trim(x) != "") & ~x.startswith("#")).alias("lines"))
    sizes = _fields(F.get("lines", F.lit(1)))
    files = files.select("model_id", "lines", F.get(sizes, F.lit(0)).cast("int").alias("nv"), F.get(sizes, F.lit(1)).cast("int").alias("nf")).where("nv > 0")
    part = lambda start, n: F.posexplode(F.slice("lines", start, n))
    v = files.select("model_id", part(F.lit(3), F.col("nv")).alias("vertex_id", "line"))
    f = files.select("model_id", part(F.col("nv") + 3, F.col("nf")).alias("face_id", "line"))
    number = lambda i, kind: F.get(_fields(), F.lit(i)).cast(kind)
    return v.select("model_id", "vertex_id", *[number(i, "double").alias(c) for i, c in enumerate("xyz")]), f.select("model_id", "face_id", *[number(i + 1, "int").alias(f"v{i}") for i in range(3)])


def read_xyz(spark: SparkSession, path, flip_normals: bool = True, rotate: bool = False) -> DataFrame:
    """points up to the first short line; normals are negated, ``rotate`` turns -90 degrees about x."""
    rows = _lines(spark, path).withColumn("f", _fields())
    short = rows.where(F.size("f") < 6).groupBy("path").agg(F.min("line_no").alias("stop"))
    rows = rows.join(short, "path", "left").where("stop IS NULL OR line_no < stop")
    sign = -1 if flip_normals else 1
    v = [F.get("f", F.lit(i)).cast("double") * (sign if i > 2 else 1) for i in range(6)]
    if rotate:
        v = [v[0], v[2], -v[1], v[3], v[5], -v[4]]
    return rows.select("model_id", F.col("line_no").alias("point_id"), *[c.alias(n) for c, n in zip(v, ("x", "y", "z", "nx", "ny", "nz"), strict=True)])


def read_seg(spark: SparkSession, path) -> DataFrame:
    return _lines(spark, path).select("model_id", F.col("line_no").alias("face_id"), F.trim("line").cast("int").alias("label"))


def read_sdff(spark: SparkSession, path) -> DataFrame:
    return _lines(spark, path).select("model_id", F.col("line_no").alias("vertex_id"), F.trim("line").cast("double").alias("sdf"))


def read_features(spark: SparkSession, path) -> DataFrame:
    """27 features a line and, if there, a label as the 28th."""
    f = F.split("line", ",")
    return _lines(spark, path).select("model_id", F.col("line_no").alias("point_id"), *[F.get(f, F.lit(i)).cast("double").alias(c) for i, c in enumerate(FEATURES)], F.get(f, F.lit(27)).cast("int").alias("part_label"))


def read_list(spark: SparkSession, path, longer_than: int = 0) -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > longer_than).select(F.trim("value").alias("path"))


def read_label_names(spark: SparkSession, path) -> DataFrame:
    return read_list(spark, path).select(F.col("path").cast("int").alias("label")).orderBy("label")


def read_predictions(spark: SparkSession, path) -> DataFrame:
    """``label_prob`` tokens: model_id, point_id, label, prob."""
    tokens = _lines(spark, path).select("model_id", F.col("line_no").alias("point_id"), F.explode(_fields()).alias("t"))
    return tokens.select("model_id", "point_id", F.substring_index("t", "_", 1).cast("int").alias("label"), F.substring_index("t", "_", -1).cast("double").alias("prob"))


def read_symmetry(spark: SparkSession, path) -> DataFrame:
    """group_id, label, rep_label: a line's first label stands for all of it."""
    rows = _lines(spark, path).withColumn("f", F.transform(_fields(), lambda x: x.cast("int")))
    return rows.select(F.col("line_no").alias("group_id"), F.explode("f").alias("label"), F.get("f", F.lit(0)).alias("rep_label"))


def read_priors(spark: SparkSession, path) -> DataFrame:
    """``l1 l2`` lines, each with rows of numbers after it: label1, label2, row, values."""
    rows = _lines(spark, path).withColumn("f", F.transform(_fields(), lambda x: x.cast("double")))
    heads = rows.where(F.size("f") == 2).select("path", F.col("line_no").alias("head"), F.get("f", F.lit(0)).cast("int").alias("label1"), F.get("f", F.lit(1)).cast("int").alias("label2"))
    body = rows.where(F.size("f") > 2).join(heads, "path").where("head < line_no")
    body = body.groupBy("path", "line_no").agg(F.max_by(F.struct("label1", "label2", "head", "f"), "head").alias("x"))
    return body.select("x.label1", "x.label2", (F.col("line_no") - F.col("x.head") - 1).alias("row"), F.col("x.f").alias("values"))


def read_prior_cells(spark: SparkSession, mean_path, cov_path) -> DataFrame:
    """Priors of both files in long form: label1, label2, i, j, mean_i, mean_j, cov (i <= j)."""
    long = lambda rows, *names: rows.select("label1", "label2", "row", F.posexplode("values").alias(*names))
    mean = long(read_priors(spark, mean_path).where("row = 0"), "k", "mean").select("label1", "label2", "k", "mean")
    cov = long(read_priors(spark, cov_path), "j", "cov").withColumnRenamed("row", "i").where("i <= j")
    side = lambda c: mean.withColumnsRenamed({"k": c, "mean": f"mean_{c}"})
    return cov.join(side("i"), ["label1", "label2", "i"]).join(side("j"), ["label1", "label2", "j"]).select("label1", "label2", "i", "j", "mean_i", "mean_j", "cov")


def read_candidates(spark: SparkSession, path) -> DataFrame:
    """One file a candidate: label cluster; 3 rows rot; trans; scale; height; 3 rows axes; point ids.

    Its number is the file's name or, as written here, its folder ``cand_id=``.
    """
    files = _files(spark, path).select("path", F.filter("lines", lambda x: F.trim(x) != "").alias("l"))
    nums = lambda at, n, kind="double": F.flatten(F.transform(F.slice("l", at + 1, n), lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda y: y.cast(kind))))
    folder = F.regexp_extract("path", r"/model_id=([^/]*)/cand_id=[0-9]+/", 1)
    number = F.coalesce(F.nullif(F.regexp_extract("path", r"/cand_id=([0-9]+)/[^/]*$", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"([0-9]+)\.[^.]*$", 1), F.lit("")))
    return files.select(
        F.nullif(folder, F.lit("")).alias("model_id"), number.cast("int").alias("cand_id"), F.get(nums(0, 1), F.lit(0)).cast("int").alias("label"), F.get(nums(0, 1), F.lit(1)).cast("int").alias("cluster_no"),
        nums(1, 3).alias("rot"), nums(4, 1).alias("trans"), nums(5, 1).alias("scale"), nums(6, 1).alias("height"), nums(7, 3).alias("axes"), nums(10, F.greatest(F.size("l") - 10, F.lit(0)), "int").alias("point_ids"),
    )


# ---------------------------------------------------------------- sinks


def _text(rows: DataFrame, path: str, *order) -> None:
    """Sorted lines as one folder of text files, in order of their names."""
    (rows.orderBy(*order) if order else rows).select("line").write.mode("overwrite").text(path)


def _texts(rows: DataFrame, path: str, *order: str, by=("model_id",)) -> None:
    """One text a model (or other key): ``path``/model_id=.../, its lines in order."""
    rows.repartition(*by).sortWithinPartitions(*by, *order).select(*by, "line").write.mode("overwrite").partitionBy(*by).text(path)


def write_ply(points: DataFrame, path: str) -> None:
    """One ASCII PLY a model: the header and the points (by point_id) as text."""
    names = ("x", "y", "z", "nx", "ny", "nz")
    size = points.groupBy("model_id").agg(F.count("*").alias("n"))
    head = F.array(*[F.lit(h) for h in ("ply", "format ascii 1.0")], F.format_string("element vertex %d", "n"), *[F.lit(f"property float {n}") for n in names], F.lit("end_header"))
    header = size.select("model_id", F.posexplode(head).alias("k", "line")).select("model_id", F.lit(0).alias("part"), F.col("k").cast("long").alias("k"), "line")
    rows = points.select("model_id", F.lit(1).alias("part"), F.col("point_id").cast("long").alias("k"), F.concat_ws(" ", *[F.col(n).cast("string") for n in names]).alias("line"))
    _texts(header.unionByName(rows), path, "part", "k")


def write_features(points: DataFrame, path: str) -> None:
    """One file a model: 27 features with six decimals and the label, if any; labels out of range are left out."""
    rows = points.where(F.col("part_label").isNull() | F.col("part_label").between(0, MAX_LABEL))
    line = F.concat_ws(",", *[F.format_string("%.6f", c) for c in FEATURES], F.col("part_label").cast("string"))
    _texts(rows.select("model_id", "point_id", line.alias("line")), path, "point_id")


def write_off(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One OFF text a model below ``path``/model_id=..."""
    v = vertices.select("model_id", F.lit(1).alias("k"), F.col("vertex_id").alias("n"), F.concat_ws(" ", "x", "y", "z").alias("line"))
    f = faces.select("model_id", F.lit(2).alias("k"), F.col("face_id").alias("n"), F.concat_ws(" ", F.lit("3"), "v0", "v1", "v2").alias("line"))
    sizes = v.unionByName(f).groupBy("model_id").agg(F.concat_ws(" ", F.count_if(F.col("k") == 1), F.count_if(F.col("k") == 2), F.lit("0")).alias("s"))
    heads = sizes.select("model_id", F.lit(0).alias("k"), F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("OFF").alias("line")), F.struct(F.lit(1).alias("n"), F.col("s").alias("line")))).alias("x")).select("model_id", "k", "x.n", "x.line")
    _texts(heads.unionByName(v).unionByName(f), path, "k", "n")


def write_lines(rows: DataFrame, column: str, path: str, *order: str) -> None:
    """One value a line: SDFF values, label names, path lists."""
    _text(rows.withColumn("line", F.col(column).cast("string")), path, *order)


def write_predictions(dist: DataFrame, path: str) -> None:
    """One file a model, a line a point: ``label_prob`` tokens in order of labels."""
    rows = dist.groupBy("model_id", "point_id").agg(F.array_sort(F.collect_list(F.struct("label", "prob"))).alias("d"))
    _texts(rows.withColumn("line", F.array_join(F.transform("d", lambda x: F.concat_ws("_", x["label"].cast("string"), x["prob"].cast("string"))), " ")), path, "point_id")


def write_priors(cells: DataFrame, path: str) -> None:
    """``path``/mean and ``path``/cov: an ``l1 l2`` line, then one row of means or all rows of covariances.

    Numbers keep their full precision.  Label pairs are few by the data model, so each is one file.
    """
    ends = ["label1", "label2"]
    both = cells.select(*ends, "i", "j", "cov").unionByName(cells.where("i <> j").select(*ends, F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    means = cells.where("i = j").select(*ends, F.lit(0).alias("i"), F.col("i").alias("j"), F.col("mean_i").alias("cov"))
    for name, long in (("mean", means), ("cov", both)):
        rows = long.groupBy(*ends, "i").agg(F.array_sort(F.collect_list(F.struct("j", "cov"))).alias("r"))
        rows = rows.select(*ends, "i", row_text(F.transform("r", lambda x: F.coalesce(x["cov"], F.lit(0.0)))).alias("line"))
        heads = long.select(*ends).distinct().select(*ends, F.lit(-1).alias("i"), F.concat_ws(" ", *ends).alias("line"))
        heads.unionByName(rows).repartition(1).sortWithinPartitions(*ends, "i").select("line").write.mode("overwrite").text(f"{path}/{name}")


def row_text(values) -> Column:
    """Numbers of an array, a blank between them."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


def write_candidates(cands: DataFrame, path: str) -> None:
    """One text a candidate, below ``path``/model_id=.../cand_id=...; read back by ``read_candidates``."""
    three = lambda c: [row_text(F.slice(c, 3 * i + 1, 3)) for i in range(3)]
    label = "label" if "label" in cands.columns else "part"
    fixed = F.array(F.concat_ws(" ", label, "cluster_no"), *three("rot"), row_text(F.col("trans")), row_text(F.col("scale")), row_text(F.col("height")), *three("axes"), row_text(F.col("point_ids")))
    _texts(cands.select("model_id", "cand_id", F.posexplode(fixed).alias("k", "line")), path, "k", by=("model_id", "cand_id"))


def thin(points: DataFrame, cell: float) -> DataFrame:
    """At most one point a grid cell, that with the lowest id."""
    key = [F.floor(F.col(c) / cell).alias(f"__{c}") for c in "xyz"]
    first = points.groupBy("model_id", *key).agg(F.min_by(F.struct(*points.columns), "point_id").alias("p"))
    return first.select("p.*")
