"""Registered queries over the driver's tables, with DuckDB SQL where SQL can express them.

``embeddings`` stands in for a cloud: its first three numbers are a place, the next three a
normal, ``label`` the part label.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import blocks, learning, meshes, mrf, parts, solids, spatial

QUERIES, ORACLE = {}, {}
RADIUS = 0.1


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", e.alias("e"))


def cloud(spark: SparkSession, sf_dir: str, models: int = 1) -> DataFrame:
    """model_id, point_id, x, y, z, nx, ny, nz, part_label."""
    e = [F.get("e", F.lit(i)) for i in range(6)]
    size = F.nullif(F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5]), F.lit(0.0))
    return raw(spark, sf_dir).select(
        F.pmod("vec_id", F.lit(models)).cast("int").alias("model_id"), F.col("vec_id").alias("point_id"), *[e[i].alias(c) for i, c in enumerate("xyz")], *[(e[i + 3] / size).alias(f"n{c}") for i, c in enumerate("xyz")], F.col("label").alias("part_label")
    )


def rounded(df: DataFrame, digits: int = 6, keep=()) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" and c not in keep else c for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


CLOUD = """e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT vec_id AS point_id, label AS part_label, e[1] AS x, e[2] AS y, e[3] AS z,
             e[4] / nullif(sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]), 0) AS nx, e[5] / nullif(sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]), 0) AS ny,
             e[6] / nullif(sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]), 0) AS nz FROM e)"""


def near(radius: float, also: str = "") -> str:
    return f"""near AS (SELECT a.point_id AS src, b.point_id AS dst, b.x AS dx, b.y AS dy, b.z AS dz,
    (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
    FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {radius!r} * {radius!r}{also})"""


PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def eigen(m: DataFrame, vectors=()) -> DataFrame:
    return G.with_eigen(m, {"v": [F.col(c) for c in G.SIX]}, vectors)


def moments_sql(radius: float, centered: bool, name: str = "m") -> str:
    cells = ", ".join((f"avg(d{a} * d{b}) - avg(d{a}) * avg(d{b})" if centered else f"avg(d{a} * d{b})") + f" AS {a}{b}" for a, b in PAIRS)
    return f"{name} AS (SELECT src, count(*) AS n, {cells} FROM near WHERE d2 <= {radius!r} * {radius!r} GROUP BY src)"


def eigen_sql(source: str, name: str) -> str:
    """CTEs that end in ``name`` (src, high, mid, low)."""
    return f"""{name}1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {source}),
    {name}2 AS (SELECT *, xx - q AS a, yy - q AS b, zz - q AS c FROM {name}1),
    {name}3 AS (SELECT *, sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM {name}2),
    {name}4 AS (SELECT *, acos(greatest(least(coalesce((a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / 2 / nullif(s * s * s, 0), 0), 1), -1)) / 3 AS phi FROM {name}3),
    {name}5 AS (SELECT *, q + 2 * s * cos(phi) AS high, q + 2 * s * cos(phi + 2 * pi() / 3) AS low FROM {name}4),
    {name} AS (SELECT *, 3 * q - high - low AS mid FROM {name}5)"""


CURVATURE = "coalesce(CASE WHEN low / nullif(high + mid + low, 0) BETWEEN 0 AND 1 THEN low / nullif(high + mid + low, 0) END, 100.0)"

# ---------------------------------------------------------------- neighbourhoods


@query(f"WITH {CLOUD}, {near(RADIUS)} SELECT src, dst, {r('d2', 'd2')} FROM near")
def radius_neighbors(spark, sf_dir):
    return spatial.radius_join(cloud(spark, sf_dir), RADIUS, places=False, digits=6, models=False)


@query(f"WITH {CLOUD}, {near(0.2)} SELECT src, count(*) AS n FROM near GROUP BY src")
def neighbor_counts(spark, sf_dir):
    return blocks.around(cloud(spark, sf_dir), [0.2 * 0.2], raw=False, mid=False).select("src", F.col("n0").alias("n"))


@query(f"WITH {CLOUD}, d AS (SELECT a.point_id AS src, b.point_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM p a JOIN p b ON a.point_id <> b.point_id), k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM d) SELECT src, dst, {r('d2', 'd2')}, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 16")
def knn(spark, sf_dir):
    return rounded(spatial.knn(cloud(spark, sf_dir), 16, 0.15).select("src", "dst", "d2", "rank"))


@query(f"WITH {CLOUD}, {near(0.2)}, {moments_sql(0.2, False)} SELECT src, n, " + ", ".join(r(a + b, a + b) for a, b in PAIRS) + " FROM m")
def second_moment(spark, sf_dir):
    return rounded(spatial.moments(cloud(spark, sf_dir), 0.2).drop("model_id"))


@query(f"WITH {CLOUD}, {near(0.2)}, {moments_sql(0.2, True)} SELECT src, n, " + ", ".join(r(a + b, a + b) for a, b in PAIRS) + " FROM m")
def centered_cov(spark, sf_dir):
    return rounded(spatial.moments(cloud(spark, sf_dir), 0.2, centered=True).drop("model_id"))


@query(f"WITH {CLOUD}, {near(0.2)}, {moments_sql(0.2, False)}, {eigen_sql('m', 'v')} SELECT src, {r('mid / nullif(high, 0)', 'evqu0', 4)}, {r('low / nullif(high, 0)', 'evqu1', 4)} FROM v")
def eigen_quotients(spark, sf_dir):
    m = eigen(spatial.moments(cloud(spark, sf_dir), 0.2))
    q = G.quotients("v")
    return rounded(m.select("src", q[0].alias("evqu0"), q[1].alias("evqu1")), 4)


@query(f"WITH {CLOUD}, {near(0.3)}, {moments_sql(0.3, True)}, {eigen_sql('m', 'v')} SELECT src, CASE WHEN n > 3 THEN round({CURVATURE}, 4) + 0.0 END AS curvature FROM v")
def curvature(spark, sf_dir):
    """Null with fewer than four points: up to three lie in a plane, and their smallest eigenvalue is rounding noise."""
    m = spatial.moments(cloud(spark, sf_dir), 0.3, centered=True)
    return rounded(eigen(m).select("src", F.when(F.col("n") > 3, G.curvature("v")).alias("curvature")), 4)


def vector_sql(source: str, name: str, values: dict[str, str]) -> str:
    """CTEs that end in ``name``: ``source`` and a unit eigenvector (list) of each value, as in ``with_eigen``.

    source has xx to zz; values: column of the vector -> column of its eigenvalue.
    """
    cells, longest, signed = [], [], []
    for out, value in values.items():
        rows = [(f"(xx - {value})", "xy", "xz"), ("xy", f"(yy - {value})", "yz"), ("xz", "yz", f"(zz - {value})")]
        for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            a, b = rows[i], rows[j]
            cells.append(f"[{a[1]} * {b[2]} - {a[2]} * {b[1]}, {a[2]} * {b[0]} - {a[0]} * {b[2]}, {a[0]} * {b[1]} - {a[1]} * {b[0]}] AS {out}{k}")
        size = [f"list_dot_product({out}{k}, {out}{k})" for k in range(3)]
        longest.append(f"CASE WHEN {size[0]} >= {size[1]} AND {size[0]} >= {size[2]} THEN {out}0 WHEN {size[1]} >= {size[2]} THEN {out}1 ELSE {out}2 END AS {out}b")
        top = f"CASE WHEN abs({out}b[1]) >= abs({out}b[2]) AND abs({out}b[1]) >= abs({out}b[3]) THEN {out}b[1] WHEN abs({out}b[2]) >= abs({out}b[3]) THEN {out}b[2] ELSE {out}b[3] END"
        signed.append(f"list_transform({out}b, lambda w: w * sign({top}) / sqrt(nullif(list_dot_product({out}b, {out}b), 0))) AS {out}")
    return f"{name}8 AS (SELECT *, {', '.join(cells)} FROM {source}), {name}9 AS (SELECT *, {', '.join(longest)} FROM {name}8), {name} AS (SELECT *, {', '.join(signed)} FROM {name}9)"


GRAVITY = f"WITH {CLOUD}, {near(0.2)}, {moments_sql(0.2, False)}, {eigen_sql('m', 'v')}, {vector_sql('v', 'g', {'e1': 'high', 'e3': 'low'})} SELECT src, CASE WHEN n > 2 THEN round(-e1[2], 4) + 0.0 END AS grav0, CASE WHEN n > 2 THEN round(-e3[2], 4) + 0.0 END AS grav1 FROM g"


@query(GRAVITY)
def gravity_projections(spark, sf_dir):
    """Null with fewer than two neighbours: the smallest eigenvalue has then no one direction."""
    m = eigen(spatial.moments(cloud(spark, sf_dir), 0.2), ("v",))
    return rounded(m.select("src", *[F.when(F.col("n") > 2, -F.get(f"v_e{e}", F.lit(1))).alias(n) for e, n in ((1, "grav0"), (3, "grav1"))]), 4)


def _multiscale_sql() -> str:
    ctes, cols, joins = [CLOUD, near(0.5)], [], []
    for s, c in enumerate(spatial.SCALES):
        ctes += [moments_sql(c, False, f"m{s}"), eigen_sql(f"m{s}", f"v{s}")]
        cols += [r(f"v{s}.mid / nullif(v{s}.high, 0)", f"evqu{s}0", 4), r(f"v{s}.low / nullif(v{s}.high, 0)", f"evqu{s}1", 4)]
        joins.append(f"JOIN v{s} ON v{s}.src = p.point_id")
    return f"WITH {', '.join(ctes)} SELECT p.point_id, {', '.join(cols)}, {r('p.y', 'height')} FROM p {' '.join(joins)}"


@query(_multiscale_sql())
def multiscale_quotients(spark, sf_dir):
    points = cloud(spark, sf_dir)
    out = spatial.multiscale(points).select("point_id", *[f"evqu{s}{k}" for s in range(5) for k in (0, 1)])
    return rounded(rounded(out, 4).join(points.select("point_id", F.col("y").alias("height")), "point_id"))


def features_sql(also: str = "") -> str:
    ctes, cols, joins = [CLOUD, near(0.5, also)], ["p.point_id"], []
    for s, c in enumerate(spatial.SCALES):
        ctes += [moments_sql(c, False, f"m{s}"), eigen_sql(f"m{s}", f"v{s}"), vector_sql(f"v{s}", f"g{s}", {"e1": "high", "e3": "low"}), moments_sql(c, True, f"k{s}"), eigen_sql(f"k{s}", f"c{s}")]
        cols += [f"g{s}.n AS n{s}", r(f"g{s}.mid / nullif(g{s}.high, 0)", f"evqu{s}0", 4), r(f"g{s}.low / nullif(g{s}.high, 0)", f"evqu{s}1", 4)]
        cols += [f"CASE WHEN g{s}.n > 2 THEN round(-g{s}.e{e}[2], 4) + 0.0 END AS grav{s}{k}" for k, e in ((0, 1), (1, 3))]
        share = f"c{s}.low / nullif(c{s}.high + c{s}.mid + c{s}.low, 0)"
        cols.append(f"CASE WHEN g{s}.n > 3 THEN round(coalesce(CASE WHEN {share} BETWEEN 0 AND 1 THEN {share} END, 100.0), 4) + 0.0 END AS curvature{s}")
        joins.append(f"JOIN g{s} ON g{s}.src = p.point_id JOIN c{s} ON c{s}.src = p.point_id")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(cols)} FROM p {' '.join(joins)}"


def steady(features: DataFrame) -> DataFrame:
    """Directions of up to two points and curvatures of up to three are rounding noise: null here."""
    return features.withColumns({f"{name}{s}{k}": F.when(F.col(f"n{s}") > least, F.col(f"{name}{s}{k}")) for s in range(5) for name, least, ks in (("grav", 2, "01"), ("curvature", 3, ("",))) for k in ks})


@query(features_sql())
def multiscale_features(spark, sf_dir):
    return rounded(steady(spatial.multiscale(cloud(spark, sf_dir)).drop("model_id")), 4)


def sdf_sql(also: str = "") -> str:
    return f"""WITH {CLOUD}, v AS (SELECT a.point_id AS src, b.x - a.x AS vx, b.y - a.y AS vy, b.z - a.z AS vz, a.nx, a.ny, a.nz
    FROM p a JOIN p b ON a.point_id <> b.point_id AND a.nx * b.nx + a.ny * b.ny + a.nz * b.nz <= 0{also}),
d AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS d FROM v),
h AS (SELECT src, d, degrees(acos(greatest(least(-(vx * nx + vy * ny + vz * nz) / nullif(d * sqrt(nx * nx + ny * ny + nz * nz), 0), 1), -1))) AS angle FROM d),
c AS (SELECT * FROM h WHERE angle > 0 AND angle <= 30),
m AS (SELECT src, median(d) AS med, stddev_pop(d) AS sd FROM c GROUP BY src),
s AS (SELECT c.src, sum(d / angle) / sum(1 / angle) AS sdf FROM c JOIN m ON c.src = m.src WHERE abs(d - med) <= sd + 1e-8 GROUP BY c.src)
SELECT p.point_id, {r('coalesce(s.sdf, 0)', 'sdf')} FROM p LEFT JOIN s ON s.src = p.point_id"""


@query(sdf_sql())
def point_sdf(spark, sf_dir):
    return rounded(spatial.point_sdf(cloud(spark, sf_dir)).select("point_id", "sdf"))


@query(f"""WITH RECURSIVE {CLOUD}, o AS (SELECT point_id, x, y, z, row_number() OVER (ORDER BY md5(CAST(point_id AS VARCHAR)), point_id) AS i FROM p),
walk(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[]) UNION ALL
SELECT o.i, CASE WHEN len(list_filter(kept, lambda k: (o.x - k.x) * (o.x - k.x) + (o.y - k.y) * (o.y - k.y) + (o.z - k.z) * (o.z - k.z) < 0.15 * 0.15)) = 0
    THEN list_append(kept, {{'id': o.point_id, 'x': o.x, 'y': o.y, 'z': o.z}}) ELSE kept END FROM walk JOIN o ON o.i = walk.i + 1)
SELECT unnest(list_transform(kept, lambda k: k.id)) AS point_id FROM walk WHERE i = (SELECT max(i) FROM o)""")
def thinned_points(spark, sf_dir):
    return spatial.thinned(cloud(spark, sf_dir), 0.15).select("point_id")


@query(f"""WITH RECURSIVE {CLOUD}, {near(RADIUS)}, reach(id, seen) AS (SELECT point_id, point_id FROM p UNION SELECT reach.id, near.dst FROM reach JOIN near ON near.src = reach.seen)
SELECT id, min(seen) AS component FROM reach GROUP BY id""")
def components(spark, sf_dir):
    return spatial.radius_components(cloud(spark, sf_dir), RADIUS).select(F.col("point_id").alias("id"), "component")


# ---------------------------------------------------------------- scalars


@query(f"WITH {CLOUD} SELECT point_id, {r('y', 'height')} FROM p")
def height_projection(spark, sf_dir):
    return rounded(cloud(spark, sf_dir).select("point_id", F.col("y").alias("height")))


@query("SELECT vec_id, CASE label + 5 " + " ".join(f"WHEN {i} THEN {c[0]!r}" for i, c in enumerate(G.COLORS)) + f" ELSE {G.COLORS[10][0]!r} END * 1e0 AS red FROM embeddings")
def label_color(spark, sf_dir):
    return raw(spark, sf_dir).select("vec_id", F.get(G.label_color(F.col("label") + 5), F.lit(0)).alias("red"))


@query("""SELECT page_id, split_part(regexp_extract(url, '([^/\\\\]*)$', 1), '.', 1) AS name,
regexp_replace(url, '[^/\\\\]+([/\\\\])([^/\\\\]*)...$', 'gt\\1\\2seg') AS seg FROM pages""")
def model_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", G.model_name(F.col("url")).alias("name"), G.seg_path(F.col("url")).alias("seg"))


@query("SELECT n_nationkey, CAST(factorial(12) / (factorial(n_regionkey) * factorial(12 - n_regionkey)) AS BIGINT) AS ways, abs(n_regionkey * 1e-9 - 1e-9) < 1e-8 AS near FROM nation")
def combinations(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select("n_nationkey", G.n_choose_k(F.lit(12), F.col("n_regionkey")).cast("long").alias("ways"), G.nearly_equal(F.col("n_regionkey") * 1e-9, F.lit(1e-9)).alias("near"))


MATRIX = (0.0, 2.0, 0.0, 1.0, -1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.5, -1.0, 0.0, 0.0, 0.0, 1.0)


@query(f"WITH {CLOUD} SELECT point_id, {r('2 * y + 1', 'x')}, {r('2 - x', 'y')}, {r('0.5 * z - 1', 'z')}, {r('2 * ny', 'nx')} FROM p")
def affine_transform(spark, sf_dir):
    p = cloud(spark, sf_dir)
    place = G.transform([F.col(c) for c in "xyz"], MATRIX)
    normal = G.transform([F.col(c) for c in ("nx", "ny", "nz")], MATRIX, 0.0)
    return rounded(p.select("point_id", *[v.alias(c) for v, c in zip(place, "xyz", strict=True)], normal[0].alias("nx")))


@query(f"WITH {CLOUD}, b AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p), d AS (SELECT p.*, cx, cy, cz FROM p, b), g AS (SELECT max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) AS radius FROM d) SELECT point_id, {r('(x - cx) / radius', 'x')}, {r('(y - cy) / radius', 'y')}, {r('(z - cz) / radius', 'z')} FROM d, g")
def normalize_given_ball(spark, sf_dir):
    p = cloud(spark, sf_dir)
    mean = p.groupBy("model_id").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    d2 = G.sum_of((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz")
    found = p.join(F.broadcast(mean), "model_id").groupBy("model_id", "cx", "cy", "cz").agg(F.max(F.sqrt(d2)).alias("radius"))
    return rounded(solids.normalize(p, found).select("point_id", "x", "y", "z"))


# ---------------------------------------------------------------- meshes

FACES = "f AS (SELECT vec_id AS face_id, vec_id AS v0, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS v1, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS v2, label, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings), c AS (SELECT face_id, label, value, unnest([v0, v1, v2]) AS vertex_id FROM f)"


def faces(spark, sf_dir) -> DataFrame:
    e = raw(spark, sf_dir)
    n = e.count()
    return e.select(F.lit(0).alias("model_id"), F.col("vec_id").alias("face_id"), F.col("vec_id").alias("v0"), ((F.col("vec_id") + 1) % n).alias("v1"), ((F.col("vec_id") * 7 + 3) % n).alias("v2"), "label", F.get("e", F.lit(0)).alias("value"))


@query(f"WITH {FACES} SELECT vertex_id, arg_max(label, face_id) AS label FROM c GROUP BY vertex_id")
def vertex_label_last_face(spark, sf_dir):
    f = faces(spark, sf_dir)
    return solids.vertex_labels(f.drop("label", "value"), f.select("model_id", "face_id", "label")).select("vertex_id", "label")


@query(f"WITH {FACES} SELECT vertex_id, {r('avg(value)', 'value')} FROM c GROUP BY vertex_id")
def vertex_sdf_mean(spark, sf_dir):
    f = faces(spark, sf_dir)
    return rounded(solids.vertex_means(f.drop("label", "value"), f.select("model_id", "face_id", "value")).select("vertex_id", "value"))


@query()
def mesh_sdf(spark, sf_dir):
    v = cloud(spark, sf_dir).select("model_id", F.col("point_id").alias("vertex_id"), "x", "y", "z")
    return meshes.mesh_sdf(v, faces(spark, sf_dir).drop("label", "value"))


NEAR_FACETS = """s AS (SELECT face_id, unnest([v0, v1, v2]) AS a, unnest([v1, v2, v0]) AS b FROM f),
e AS (SELECT DISTINCT face_id, least(a, b) AS low, greatest(a, b) AS high FROM s WHERE a <> b),
near AS (SELECT DISTINCT e.face_id, o.face_id AS near FROM e JOIN e o USING (low, high) WHERE e.face_id <> o.face_id)"""


@query(f"WITH {FACES}, {NEAR_FACETS} SELECT face_id, near FROM near")
def facet_neighbors(spark, sf_dir):
    return meshes.neighbors(faces(spark, sf_dir)).select("face_id", "near")


@query(f"""WITH RECURSIVE {FACES}, {NEAR_FACETS}, w AS (SELECT CAST(floor(sqrt(count(*) / 2000.0)) AS INTEGER) + 1 AS w FROM f),
reach(face_id, near, edges) AS (SELECT face_id, face_id, 0 FROM f UNION SELECT r.face_id, n.near, r.edges + 1 FROM reach r JOIN near n ON n.face_id = r.near WHERE r.edges < (SELECT w FROM w)),
d AS (SELECT face_id, near, min(edges) AS edges FROM reach GROUP BY face_id, near),
v AS (SELECT d.face_id, d.edges, o.value AS other, o.value - f.value AS off FROM d JOIN f ON f.face_id = d.face_id JOIN f o ON o.face_id = d.near),
g AS (SELECT face_id, sqrt(avg(off * off)) AS deviation FROM v GROUP BY face_id),
k AS (SELECT v.*, exp(-0.5 * pow(edges / ((SELECT w FROM w) / 2.0), 2)) * coalesce(exp(-0.5 * pow(off / nullif(1.5 * deviation, 0), 2)), 1) AS weight FROM v JOIN g USING (face_id))
SELECT face_id, {r("sum(other * weight) / sum(weight)", "value")} FROM k GROUP BY face_id""")
def smoothed_facets(spark, sf_dir):
    f = faces(spark, sf_dir)
    return rounded(meshes.smoothed(f.select("model_id", "face_id", "value"), meshes.neighbors(f)).select("face_id", "value"))


# ---------------------------------------------------------------- labels

DIST = """t AS (SELECT vec_id AS point_id, label AS l0, list_sum(list_transform(embedding[1:5], lambda v: abs(CAST(v AS DOUBLE)))) AS s, embedding FROM embeddings),
dist AS (SELECT point_id, CAST(i - 1 AS INTEGER) AS label, abs(CAST(embedding[i] AS DOUBLE)) / s AS prob FROM t, unnest([1, 2, 3, 4, 5]) AS u(i))"""


def distribution(spark, sf_dir) -> DataFrame:
    five = F.transform(F.slice("e", 1, 5), lambda v: F.abs(v))
    total = F.aggregate(five, F.lit(0.0), lambda a, b: a + b)
    return raw(spark, sf_dir).select(F.lit(0).alias("model_id"), F.col("vec_id").alias("point_id"), F.posexplode(F.transform(five, lambda v: v / total)).alias("label", "prob"))


@query(f"WITH {DIST} SELECT point_id, arg_max(label, prob) AS label, {r('max(prob)', 'prob')} FROM dist GROUP BY point_id")
def argmax_label(spark, sf_dir):
    return rounded(learning.best_label(distribution(spark, sf_dir)).select("point_id", "label", "prob"))


@query(f"WITH {DIST} SELECT point_id, label, {r('prob', 'prob')} FROM dist UNION ALL SELECT DISTINCT point_id, 5, 0.1 FROM dist")
def null_label_append(spark, sf_dir):
    return rounded(learning.with_null_label(distribution(spark, sf_dir)).select("point_id", "label", "prob"))


SYMMETRY = [(0, 1, 1), (0, 2, 1), (1, 3, 3), (1, 4, 3)]


def symmetry(spark) -> DataFrame:
    return spark.createDataFrame(SYMMETRY, "group_id int, label int, rep_label int")


@query(f"""WITH {DIST}, sym(g, label, rep) AS (VALUES (0, 1, 1), (0, 2, 1), (1, 3, 3), (1, 4, 3)),
a AS (SELECT point_id, g, rep, sum(prob) AS s FROM dist JOIN sym USING (label) GROUP BY ALL HAVING sum(prob) > 0.7 - 1e-6),
b AS (SELECT point_id, arg_min(rep, g) AS part FROM a GROUP BY point_id),
c AS (SELECT point_id, min(label) AS part FROM dist WHERE label NOT IN (SELECT label FROM sym) AND prob > 0.7 - 1e-6 GROUP BY point_id)
SELECT coalesce(b.point_id, c.point_id) AS point_id, coalesce(b.part, c.part) AS part FROM b FULL JOIN c ON b.point_id = c.point_id""")
def symmetry_assign(spark, sf_dir):
    return parts.assign_clouds(distribution(spark, sf_dir), symmetry(spark)).select("point_id", "part")


@query("SELECT DISTINCT label FROM embeddings WHERE label IS NULL OR label BETWEEN 0 AND 10")
def distinct_labels(spark, sf_dir):
    return raw(spark, sf_dir).where(F.col("label").isNull() | F.col("label").between(0, G.MAX_LABEL)).select("label").distinct()


@query("SELECT count(*) AS elements, count(DISTINCT label) AS classes FROM embeddings")
def dataset_counts(spark, sf_dir):
    return raw(spark, sf_dir).agg(F.count("*").alias("elements"), F.count_distinct("label").alias("classes"))


# ---------------------------------------------------------------- parts

RELATIONS = "e AS (SELECT vec_id, label AS label1, (label + 1) % 10 AS label2, list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE)) AS feat FROM embeddings), x AS (SELECT vec_id, label1, label2, unnest(range(0, 32)) AS i, unnest(feat) AS v FROM e)"


@query(f"WITH {RELATIONS} SELECT label1, label2, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {r('avg(a.v)', 'mean_i')}, {r('avg(b.v)', 'mean_j')}, {r('covar_samp(a.v, b.v)', 'cov')}, count(*) AS n FROM x a JOIN x b USING (vec_id, label1, label2) WHERE a.i <= b.i GROUP BY ALL")
def pair_priors(spark, sf_dir):
    rel = raw(spark, sf_dir).select(F.col("label").alias("label1"), ((F.col("label") + 1) % 10).alias("label2"), F.slice("e", 1, 32).alias("feat"))
    return rounded(parts.priors(rel))


@query("WITH m AS (SELECT DISTINCT vec_id % 5 AS model_id, label FROM embeddings) SELECT a.label AS label1, b.label AS label2, count(*) AS n FROM m a JOIN m b USING (model_id) WHERE a.label <> b.label GROUP BY ALL")
def part_pair_counts(spark, sf_dir):
    return parts.pair_relations(parts.part_boxes(cloud(spark, sf_dir, 5))).groupBy("label1", "label2").agg(F.count("*").alias("n"))


def boxes(spark, sf_dir) -> DataFrame:
    """Twelve boxes: means of numbers by vec_id modulo 12 (their axes are no rotation)."""
    return _mean_boxes(raw(spark, sf_dir).groupBy(F.lit(0).alias("model_id"), F.pmod("vec_id", F.lit(12)).cast("int").alias("cand_id")))


def _mean_boxes(grouped) -> DataFrame:
    means = grouped.agg(F.array(*[F.avg(F.get("e", F.lit(i))) for i in range(15)]).alias("m"))
    cut = lambda a, n: F.slice("m", a, n)
    out = means.select("model_id", "cand_id", F.floor(F.col("cand_id") / 3).cast("int").alias("cluster_no"), cut(1, 9).alias("rot"), cut(10, 3).alias("trans"), cut(13, 3).alias("scale"))
    return out.withColumn("height", G.height_vector(F.col("rot"), F.col("trans"), F.col("scale")))


def _relation_sql(a: str, b: str) -> list[str]:
    def seen(o, n):
        rot = [f"({' + '.join(f'{n}.m[{3 * k + i + 1}] * {o}.m[{3 * k + j + 1}]' for k in range(3))}) * {o}.m[{13 + j}]" for j in range(3) for i in range(3)]
        return rot + [" + ".join(f"{n}.m[{3 * k + i + 1}] * ({o}.m[{10 + k}] - {n}.m[{10 + k}])" for k in range(3)) for i in range(3)]

    def height(o):
        return [f"-{o}.m[{4 + i}] * {o}.m[{13 + i}]" for i in range(3)] + [f"-{o}.m[11]"]

    return seen(a, b) + height(a) + seen(b, a) + height(b)


BOXES = f"w AS (SELECT CAST(vec_id % 12 AS INTEGER) AS cand_id, [{', '.join(f'avg(CAST(embedding[{i}] AS DOUBLE))' for i in range(1, 16))}] AS m FROM embeddings GROUP BY 1)"


@query(f"""WITH {BOXES}, s AS (SELECT CAST(row_number() OVER (ORDER BY ix, sx DESC, iy, sy DESC) - 1 AS INTEGER) AS frame, ix, sx, iy, sy, 3 - ix - iy AS iz, sx * sy AS sz,
CASE WHEN (ix + 1) % 3 = iy THEN 1 ELSE -1 END AS det FROM (VALUES (0), (1), (2)) a(ix), (VALUES (1), (-1)) b(sx), (VALUES (0), (1), (2)) c(iy), (VALUES (1), (-1)) d(sy) WHERE ix <> iy)
SELECT cand_id, s.*, {", ".join(r(f"m[13 + i{c}]", f"length_{c}", 8) for c in "xyz")} FROM w, s""")
def candidate_frames(spark, sf_dir):
    """The 24 frames of every box: which of its axes, and which way, each axis of a frame is, and its length along it."""
    names = ("frame", "ix", "sx", "iy", "sy", "iz", "sz", "det")
    frames = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, f, strict=True)]) for f in parts.FRAMES])
    each = boxes(spark, sf_dir).select("cand_id", "scale", F.explode(frames).alias("f"))
    return rounded(each.select("cand_id", "f.*", *[F.get("scale", F.col(f"f.i{c}")).alias(f"length_{c}") for c in "xyz"]), 8)


@query(f"WITH {BOXES} SELECT cand_id, " + ", ".join(r(h, f"h{i}", 8) for i, h in enumerate(["-m[4] * m[13]", "-m[5] * m[14]", "-m[6] * m[15]", "-m[11]"])) + " FROM w")
def height_vector(spark, sf_dir):
    return rounded(boxes(spark, sf_dir).select("cand_id", *[F.get("height", F.lit(i)).alias(f"h{i}") for i in range(4)]), 8)


@query(f"WITH {BOXES} SELECT a.cand_id AS i, b.cand_id AS j, " + ", ".join(r(x, f"f{n}", 8) for n, x in enumerate(_relation_sql("a", "b"))) + " FROM w a JOIN w b ON a.cand_id <> b.cand_id")
def relation_vector(spark, sf_dir):
    side = lambda n: boxes(spark, sf_dir).select(*[F.col(c).alias(f"{c}{n}") for c in ("cand_id", "rot", "trans", "scale", "height")])
    both = side(1).join(side(2), F.col("cand_id1") != F.col("cand_id2"))
    feat = G.relation(*[F.col(f"{c}1") for c in ("rot", "trans", "scale", "height")], *[F.col(f"{c}2") for c in ("rot", "trans", "scale", "height")])
    return rounded(both.select(F.col("cand_id1").alias("i"), F.col("cand_id2").alias("j"), feat.alias("f")).select("i", "j", *[F.get("f", F.lit(n)).alias(f"f{n}") for n in range(32)]), 8)


@query(f"WITH {DIST} SELECT CAST(point_id % 7 AS INTEGER) AS cand_id, label, {r('0.0025 * avg(CASE WHEN prob < 1e-6 THEN 1e9 ELSE -ln(prob) END)', 'cost')} FROM dist GROUP BY ALL")
def unary_energy(spark, sf_dir):
    d = distribution(spark, sf_dir)
    members = d.select("model_id", F.pmod("point_id", F.lit(7)).cast("int").alias("cand_id"), "point_id").distinct()
    return rounded(parts.unary_energy(members, d).drop("model_id"))


@query(f"""WITH {BOXES}, l(label) AS (VALUES (0), (1), (2), (3)),
c AS (SELECT a.cand_id AS i, b.cand_id AS j, floor(a.cand_id / 3) = floor(b.cand_id / 3) AS same, l1.label AS label1, l2.label AS label2,
      {' + '.join(f'pow({x} - 0.1 * l1.label, 2)' for x in _relation_sql('a', 'b'))} AS square
      FROM w a JOIN w b ON a.cand_id < b.cand_id, l l1, l l2)
SELECT i, j, label1, label2, {r('CASE WHEN same THEN CASE WHEN label1 <> 3 AND label2 <> 3 THEN 3.3e33 ELSE 0.0 END WHEN label1 = 3 OR label2 = 3 THEN 5e8 WHEN label1 = label2 OR (label1 = 0 AND label2 = 2) THEN 1e9 ELSE 1e-4 * sqrt(square) END', 'cost', 9)} FROM c""")
def pairwise_energy(spark, sf_dir):
    labels = spark.createDataFrame([(i,) for i in range(4)], "label int")
    unit = [float(i == j) for i in range(32) for j in range(32)]
    inverses = spark.createDataFrame([(a, b, [0.1 * a] * 32, unit) for a in range(3) for b in range(3) if a != b and (a, b) != (0, 2)], "label1 int, label2 int, mean array<double>, inverse array<double>")
    return rounded(parts.pairwise_energy(boxes(spark, sf_dir), labels, inverses, 3).drop("model_id"), 9)


@query(f"WITH {CLOUD} SELECT part_label, " + ", ".join(f"{r(f'min({c})', f'low_{c}')}, {r(f'max({c})', f'high_{c}')}" for c in "xyz") + " FROM p GROUP BY part_label")
def box_extents(spark, sf_dir):
    boxes = parts.part_boxes(cloud(spark, sf_dir), axes=[[float(i == j) for j in range(3)] for i in range(3)])
    end = lambda i, sign: F.get("trans", F.lit(i)) + sign * F.get("scale", F.lit(i)) / 2
    return rounded(boxes.select("part_label", *itertools.chain(*[(end(i, -1).alias(f"low_{c}"), end(i, 1).alias(f"high_{c}")) for i, c in enumerate("xyz")])))


@query(f"WITH {CLOUD}, b AS (SELECT part_label, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM p GROUP BY part_label) SELECT part_label, CAST(4 * i + 2 * j + k AS INTEGER) AS corner, {r('CASE WHEN i = 0 THEN ax ELSE bx END', 'x')}, {r('CASE WHEN j = 0 THEN ay ELSE by_ END', 'y')}, {r('CASE WHEN k = 0 THEN az ELSE bz END', 'z')} FROM b, (VALUES (0), (1)) a(i), (VALUES (0), (1)) c(j), (VALUES (0), (1)) d(k)")
def box_corners(spark, sf_dir):
    b = cloud(spark, sf_dir).groupBy("part_label").agg(F.array(*[(F.min(c) + F.max(c)) / 2 for c in "xyz"]).alias("trans"), F.array(*[F.max(c) - F.min(c) for c in "xyz"]).alias("scale"))
    b = b.withColumns({"axes": F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(9)]), "rot": F.lit(None), "height": F.lit(None)})
    return rounded(parts.box_corners(b))


@query(f"WITH {CLOUD} SELECT part_label, count(*) AS n FROM p WHERE abs(x) <= 0.1 AND abs(y) <= 0.1 AND abs(z) <= 0.1 GROUP BY part_label")
def points_in_box(spark, sf_dir):
    zero, unit = [F.lit(0.0)] * 3, [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    inside = G.in_box([F.col(c) for c in "xyz"], zero, unit, [F.lit(0.2)] * 3)
    return cloud(spark, sf_dir).where(inside).groupBy("part_label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- whole-model solvers


@query()
def miniball(spark, sf_dir):
    return solids.balls(cloud(spark, sf_dir, 5))


def _set_axes_sql(points: str, key: str) -> str:
    """CTEs that end in ``a``: ``key``, e1, e2, e3 (principal axes, signed as in ``principal_axes``) and the mean."""
    cells = ", ".join(f"avg({a} * {b}) - avg({a}) * avg({b}) AS {a}{b}" for a, b in PAIRS)
    moment = f"m AS (SELECT {key}, count(*) AS n, [avg(x), avg(y), avg(z)] AS mean, {cells} FROM {points} GROUP BY {key})"
    middle = "[e1[2] * e3[3] - e1[3] * e3[2], e1[3] * e3[1] - e1[1] * e3[3], e1[1] * e3[2] - e1[2] * e3[1]]"
    top = "CASE WHEN abs(e2[1]) >= abs(e2[2]) AND abs(e2[1]) >= abs(e2[3]) THEN e2[1] WHEN abs(e2[2]) >= abs(e2[3]) THEN e2[2] ELSE e2[3] END"
    return f"{moment}, {eigen_sql('m', 'v')}, {vector_sql('v', 'g', {'e1': 'high', 'e3': 'low'})}, h AS (SELECT {key}, mean, e1, e3, {middle} AS e2 FROM g), a AS (SELECT {key}, mean, e1, e3, list_transform(e2, lambda w: w * sign({top})) AS e2 FROM h)"


def _along_sql(framed: str, points: str, key: str, more: str) -> str:
    """CTEs that end in ``box``: a box along the axes u0, u1, u2 of each row of ``framed``."""
    join = " AND ".join(f"f.{k} IS NOT DISTINCT FROM p.{k}" for k in key.split(", "))
    local = ", ".join(f"{fn}(list_dot_product(f.u{i}, [p.x - f.mean[1], p.y - f.mean[2], p.z - f.mean[3]])) AS {fn}{i}" for i in range(3) for fn in ("min", "max"))
    centre = [f"mean[{w}] + " + " + ".join(f"(min{i} + max{i}) / 2 * u{i}[{w}]" for i in range(3)) for w in (1, 2, 3)]
    rot = ", ".join(f"u{i}[{w}]" for w in (1, 2, 3) for i in range(3))
    own = ", ".join(f"f.{k}" for k in [*key.split(", "), *more.split(", ")] if k)
    names = ", ".join(k for k in [*key.split(", "), *more.split(", ")] if k)
    return f"""ends AS (SELECT {own}, any_value(f.mean) AS mean, any_value(f.u0) AS u0, any_value(f.u1) AS u1, any_value(f.u2) AS u2, {local} FROM {framed} f JOIN {points} p ON {join} GROUP BY {own}),
    box AS (SELECT {names}, [{rot}] AS rot, [{', '.join(centre)}] AS trans, [max0 - min0, max1 - min1, max2 - min2] AS scale,
            [-u0[2] * (max0 - min0), -u1[2] * (max1 - min1), -u2[2] * (max2 - min2), -({centre[1]})] AS height, list_concat(u0, u1, u2) AS axes FROM ends)"""


def listed(names, digits: int = 4) -> str:
    return ", ".join(f"list_transform({n}, lambda w: round(w, {digits}) + 0.0) AS {n}" for n in names)


BOX_COLUMNS = ("rot", "trans", "scale", "height", "axes")


def rounded_boxes(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.transform(c, lambda w: F.round(w, digits) + F.lit(0.0)) for c in BOX_COLUMNS})


FIVE = f"{CLOUD}, q AS (SELECT point_id % 5 AS model_id, point_id, part_label, x, y, z FROM p)"
#: The signed axis most along each world axis, each axis used once: first x, then y of the two left, then z.
_SIGNED = "list_transform({v}, lambda w: w * sign({v}[{k}]))"
UPRIGHT = f"""w0 AS (SELECT model_id, part_label, mean, [e1, e2, e3] AS es, CASE WHEN abs(e1[1]) >= abs(e2[1]) AND abs(e1[1]) >= abs(e3[1]) THEN 1 WHEN abs(e2[1]) >= abs(e3[1]) THEN 2 ELSE 3 END AS i0 FROM a),
w1 AS (SELECT *, list_filter([1, 2, 3], lambda i: i <> i0) AS free FROM w0),
w2 AS (SELECT *, CASE WHEN abs(es[free[1]][2]) >= abs(es[free[2]][2]) THEN free[1] ELSE free[2] END AS i1 FROM w1),
w3 AS (SELECT *, 6 - i0 - i1 AS i2, es[i0] AS v0, es[i1] AS v1, es[6 - i0 - i1] AS v2 FROM w2),
f AS (SELECT model_id, part_label, mean, {", ".join(_SIGNED.format(v=f"v{k}", k=k + 1) + f" AS u{k}" for k in range(3))} FROM w3)"""


@query(f"WITH {FIVE}, {_set_axes_sql('q', 'model_id, part_label')}, {UPRIGHT}, {_along_sql('f', 'q', 'model_id, part_label', '')} SELECT CAST(model_id AS INTEGER) AS model_id, part_label, {listed(BOX_COLUMNS)} FROM box")
def part_boxes(spark, sf_dir):
    return rounded_boxes(parts.part_boxes(cloud(spark, sf_dir, 5)))


@query()
def jet_normals(spark, sf_dir):
    return solids.jet_normals(cloud(spark, sf_dir))


@query()
def mst_orient(spark, sf_dir):
    return solids.orient_normals(cloud(spark, sf_dir, 5))


@query()
def rf_predict(spark, sf_dir):
    p = cloud(spark, sf_dir)
    return learning.with_null_label(learning.distributions(learning.train(p, ["x", "y", "z", "nx", "ny", "nz"]), p))


FRAME_ROWS = ", ".join(f"({n}, {ix + 1}, {sx}, {iy + 1}, {sy}, {iz + 1}, {sz}, {det})" for n, ix, sx, iy, sy, iz, sz, det in parts.FRAMES)
CANDIDATES = f"""WITH RECURSIVE {FIVE}, big AS (SELECT model_id, part_label AS part FROM q GROUP BY ALL HAVING count(*) >= 4), b AS (SELECT q.model_id, q.point_id, big.part, x, y, z FROM q JOIN big ON big.model_id = q.model_id AND big.part = q.part_label),
link AS (SELECT s.model_id, s.part, s.point_id AS src, t.point_id AS dst FROM b s JOIN b t ON s.model_id = t.model_id AND s.part = t.part AND (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z) <= 0.2 * 0.2),
reach(id, seen) AS (SELECT point_id, point_id FROM b UNION SELECT reach.id, link.dst FROM reach JOIN link ON link.src = reach.seen),
own AS (SELECT id, min(seen) AS cluster FROM reach GROUP BY id), c0 AS (SELECT b.*, own.cluster FROM b JOIN own ON own.id = b.point_id), c AS (SELECT * FROM c0 WHERE cluster IN (SELECT cluster FROM c0 GROUP BY cluster HAVING count(*) >= 3)),
{_set_axes_sql('c', 'model_id, part, cluster')}, s(frame, ix, sx, iy, sy, iz, sz, det) AS (VALUES {FRAME_ROWS}),
f AS (SELECT model_id, part, cluster, mean, frame, list_dot_product(e1, [e2[2] * e3[3] - e2[3] * e3[2], e2[3] * e3[1] - e2[1] * e3[3], e2[1] * e3[2] - e2[2] * e3[1]]) * det > 0 AS right_handed,
      list_transform([e1, e2, e3][ix], lambda w: w * sx) AS u0, list_transform([e1, e2, e3][iy], lambda w: w * sy) AS u1, list_transform([e1, e2, e3][iz], lambda w: w * sz) AS u2 FROM a, s),
{_along_sql('f', 'c', 'model_id, part, cluster', 'frame, right_handed')},
members AS (SELECT model_id, part, cluster, list(point_id ORDER BY point_id) AS point_ids FROM c GROUP BY ALL)
SELECT CAST(box.model_id AS INTEGER) AS model_id, part, cluster, CAST(frame AS INTEGER) AS frame, right_handed, point_ids, {listed(BOX_COLUMNS)},
       CAST(row_number() OVER (PARTITION BY box.model_id ORDER BY part, cluster, frame) - 1 AS INTEGER) AS cand_id, CAST(dense_rank() OVER (PARTITION BY box.model_id ORDER BY part, cluster) - 1 AS INTEGER) AS cluster_no
FROM box JOIN members USING (model_id, part, cluster)"""


@query(CANDIDATES)
def candidate_boxes(spark, sf_dir):
    p = cloud(spark, sf_dir, 5).withColumn("part", F.col("part_label"))
    return rounded_boxes(parts.candidates(parts.clusters(p.select("model_id", "point_id", "part", "x", "y", "z"))))


def energies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A model for every hundred points, of twelve nodes with five labels, the last of them null: label costs, and costs of all pairs."""
    model = F.floor(F.col("point_id") / 100).cast("int")
    d = distribution(spark, sf_dir).withColumn("model_id", model)
    means = raw(spark, sf_dir).withColumn("point_id", F.col("vec_id")).groupBy(model.alias("model_id"), F.pmod("vec_id", F.lit(12)).cast("int").alias("cand_id"))
    members = d.select("model_id", F.pmod("point_id", F.lit(12)).cast("int").alias("cand_id"), "point_id").distinct()
    unary = parts.unary_energy(members, d).withColumnRenamed("cand_id", "node")
    labels = d.select("label").distinct()
    unit = [float(i == j) for i in range(32) for j in range(32)]
    inverses = spark.createDataFrame([(a, b, [0.1 * a] * 32, unit) for a in range(4) for b in range(4) if a != b and (a, b) != (0, 2)], "label1 int, label2 int, mean array<double>, inverse array<double>")
    return unary, parts.pair_costs(_mean_boxes(means), labels, inverses, 4)


@query()
def trws(spark, sf_dir):
    return mrf.solve(*energies(spark, sf_dir), "trws")


@query()
def belief_propagation(spark, sf_dir):
    return mrf.solve(*energies(spark, sf_dir), "bp")


@query()
def structure_inference(spark, sf_dir):
    """Features, forest, part relations and the boxes that explain five clouds."""
    from . import actions

    p = cloud(spark, sf_dir, 5)
    features = spatial.checkpointed(spark, actions.estimate_features(p))
    dist = actions.test_point_cloud(actions.train_point_classifier(features), features)
    sharp = dist.withColumn("prob", F.when(F.col("prob") > 0.2, 0.8).otherwise(F.col("prob")))
    return actions.infer_structure(p, sharp, actions.train_part_relations(p), symmetry(spark))
