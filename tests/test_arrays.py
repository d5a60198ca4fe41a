"""JSON array files read in splits (op 1): equal to Spark's multi-line reader wherever the splits fall."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.order import number_lines
from tessera.sources import io
from tessera.sources.arrays import Records, after, braces

SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType()),
                       T.StructField("deep", T.StringType())])


def nasty(rng, n):
    pieces = ["{", "}", "[", "]", '"', "\\", "\\\\", '\\"', ",", ":", " ", "\n", "é", "日本", "😀", "x" * 9, "{}", '"}', '{"a":1}', "/", "\t"]
    return "".join(rng.choices(pieces, k=rng.randrange(n)))


def records(rng, n):
    return [{"text": nasty(rng, 30), "n": i, "deep": {"k{": [nasty(rng, 5), {"z": {}}], '"': None}} for i in range(n)]


def write(name, text, folder=None):
    folder = folder or tempfile.mkdtemp(prefix="tessera-array-", dir="/tmp")
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


@pytest.mark.parametrize("split", ["61", "700", "128m"])
def test_arrays_equal_the_multi_line_reader(spark, split):
    rng = random.Random(int(split.rstrip("m")))
    folder = tempfile.mkdtemp(prefix="tessera-arrays-", dir="/tmp")
    rows = [records(rng, 40), records(rng, 1), [], records(rng, 25), [{"text": "}" * 500 + '"{' * 300, "n": 5}], [{}]]
    forms = [dict(indent=2), {}, {}, dict(separators=(",", ":"), ensure_ascii=False), {}, {}]
    paths = [write(f"f{i}.json", ("﻿" if i == 1 else "") + json.dumps(r, **f) + ("\n" if i % 2 else ""), folder)
             for i, (r, f) in enumerate(zip(rows, forms))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = io.read_samples(spark, paths, SCHEMA)
        numbered = sorted((r.pos, r.text, r.n, r.deep) for r in number_lines(got).collect())
        if split == "61":
            assert got.select("_file", "_start").distinct().count() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # (an object read as a string keeps its blanks or not, as Spark's settings have it)
    plain = lambda deep: deep and json.loads(deep)
    numbered = [(p, t, n, plain(d)) for p, t, n, d in numbered]
    whole = [(r.text, r.n, plain(r.deep)) for p in paths for r in spark.read.schema(SCHEMA).option("multiLine", True).json(p).collect()]
    assert [t[1:] for t in numbered] == whole and [t[0] for t in numbered] == list(range(len(whole)))
    assert len(whole) == sum(map(len, rows))


@pytest.mark.parametrize("text", ['[{"n": 1} {"n": 2} x {"n": 3}]', '[{"n": 1}, 5, {"n": 2}]', '[{"n": 1}, {"n": 2',
                                  '[{"n": 1}}, {"n": 2}]', '[{"n": 1}] [{"n": 2}]', '[{"n": 1}, {"n": "a}]', '["a", {"n": 1}]'])
def test_broken_arrays_fail(spark, text):
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_samples(spark, write("x.json", text), SCHEMA).collect()


def test_records_of_another_type_are_kept_aside(spark):
    path = write("x.json", '[{"n": 1, "text": "a"}, {"n": {"b": 2}, "text": "c"}]')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_samples(spark, path, SCHEMA).collect()
    got = io.read_samples(spark, path, SCHEMA, malformed="quarantine").orderBy(F.col("_corrupt").isNotNull()).collect()
    assert [(r.n, r._corrupt is None) for r in got][0] == (1, True) and got[1]._corrupt == '{"n": {"b": 2}, "text": "c"}'


def test_states_of_fragments():
    assert braces('a{"{\\"{" {') == (2, 2, 2) and braces("") == (0, 0, 0)
    assert after('{"a": "x', False, 0) == (True, 1) and after('y"', True, 1) == (False, 0)
    split = Records(inside=True, depth=1)
    assert split.add('rest" ') is None and not split.open and split.head == ['rest" }']
    assert split.add(', {"n":2') == '{"n":2}' and split.add("]") is None


def test_a_large_array_is_read_by_several_tasks(spark):
    path = write("big.json", json.dumps([{"text": "word " * 200, "n": i} for i in range(3000)]))       # 3 MB, one line
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
    try:
        got = io.read_samples(spark, path, SCHEMA)
        tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= 7 and [r.n for r in number_lines(got).orderBy("pos").collect()] == list(range(3000))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
