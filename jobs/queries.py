"""The jobs as registered queries: each runs twice into one new folder and returns what stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import model_intake, training_set
from pointloom.operators.spatial import shared_dir
from pointloom.plans import queries as Q


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "training_set")
    for _ in range(2):
        found = training_set.run(spark, f"{sf_dir}/embeddings.parquet", f"{out}/set")
    return Q.rounded(Q.rounded(Q.steady(found), 4, keep=("sdf",)), 6)


def job2_model_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "model_intake")
    for _ in range(2):
        found = model_intake.run(spark, f"{sf_dir}/pages.parquet*", f"{out}/models", f"{out}/checkpoint")
    return found


QUERIES = {f.__name__: f for f in (job1_training_set, job2_model_intake)}

SAME = " AND a.point_id % 5 = b.point_id % 5"
FOLDERS = r"string_split_regex(path, '[/\\]')"
NAME = r"split_part(regexp_extract(path, '([^/\\]*)$', 1), '.', 1)"

ORACLE = {
    "job1_training_set": f"""
        WITH feat AS ({Q.features_sql(SAME)}), sdf AS ({Q.sdf_sql(SAME)}),
        own AS (SELECT label, count(*) AS own FROM embeddings WHERE label IS NOT NULL GROUP BY label)
        SELECT feat.*, {Q.r("sdf.sdf", "sdf")}, {Q.r("CAST(e.embedding[2] AS DOUBLE)", "height", 4)}, e.label AS part_label, {Q.r("(SELECT sum(own) FROM own) / ((SELECT count(*) FROM own) * own.own)", "weight", 4)}, CAST(e.vec_id % 5 AS INTEGER) AS model_id
        FROM feat JOIN sdf USING (point_id) JOIN embeddings e ON e.vec_id = feat.point_id JOIN own ON own.label = e.label""",
    "job2_model_intake": rf"""
        WITH f AS (SELECT page_id AS id, rtrim(regexp_replace(coalesce(url, ''), '(?s)[?#].*$', ''), '/') AS path, coalesce(html, '') AS c FROM pages),
        d AS (SELECT id, path, c, coalesce(nullif({FOLDERS}[-2], ''), '-') AS class, {NAME} AS model, concat_ws('_', {FOLDERS}[-3], {NAME}) AS name FROM f),
        m AS (SELECT class, model, min(name) AS name, count(*) AS files, min(id) AS first_id, max(id) AS last_id,
                     CAST(sum(length(c) - length(replace(c, chr(10), '')) + CASE WHEN c = '' THEN 0 ELSE 1 END) AS BIGINT) AS lines, CAST(sum(octet_length(encode(c))) AS BIGINT) AS bytes, arg_max(path, id) AS path
              FROM d GROUP BY class, model)
        SELECT *, regexp_replace(path, '[^/\\]+([/\\])([^/\\]*)...$', 'gt\1\2seg') AS seg FROM m""",
}
