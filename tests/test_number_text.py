"""Numbers in canonical JSON are those of Python and SQL, not of Java."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tideframe.functions import scalars


@pytest.mark.parametrize("v", [-9e-05, 0.0001, 0.00012345, 0.5, 0.0, 12345678.125, 1e15, 1e16, 1.5e-300, -2.25e120, 100.0])
def test_digest_of_a_number(spark, v):
    df = spark.createDataFrame([("a:1.0E5", v, 7)], "m string, w double, n long")
    got = df.select(scalars.canonical_json(F.col("m"), F.col("w"), F.col("n")).alias("j"), scalars.content_hash(F.col("m"), F.col("w"), F.col("n")).alias("h")).first()
    want = json.dumps({"m": "a:1.0E5", "w": v, "n": 7}, separators=(",", ":"))
    assert got["j"] == want and got["h"] == hashlib.sha256(want.encode()).hexdigest()


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([(None, 1.0, None)], "a string, b double, c double")
    assert df.select(scalars.canonical_json(F.col("a"), F.col("b"), F.col("c")).alias("j")).first()["j"] == '{"b":1.0}'
