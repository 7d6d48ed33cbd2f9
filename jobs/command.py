"""What the jobs' command lines share: a config file, a log, and a session that ends with the job."""

from __future__ import annotations

import json
import logging
import os
import sys
from contextlib import contextmanager

HERE = os.path.dirname(os.path.abspath(__file__))
FORMAT = "%(asctime)s %(name)s %(levelname)s %(message)s"


def config(path: str, defaults: dict) -> dict:
    """``defaults`` with what the JSON file at ``path`` says; unknown names are mistakes."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := set(given) - set(defaults):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return defaults | given


@contextmanager
def session(name: str):
    from pyspark.sql import SparkSession

    logging.basicConfig(level=logging.INFO, format=FORMAT, stream=sys.stderr)
    # Python workers import the package too, from whatever folder this is started in.
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (os.path.dirname(HERE), os.environ.get("PYTHONPATH"))))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        yield spark
    finally:
        spark.stop()
