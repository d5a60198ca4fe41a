"""Collation (ops 40-45) and validation / length policies (10-16)."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.collate import collate_pad, last_token_index, shifted_labels, supervision_stats, unpad_offsets
from tessera.operators.validate import (
    drop_empty_pairs,
    drop_long,
    drop_long_chars,
    train_eval_split,
    truncate,
    validate_instructions,
)


def test_collate_pad_and_mask(spark):
    rows = [(0, 0, 0, [5, 0, 7], [-100, 0, 7]), (1, 1, 0, [9], [9]), (2, 2, 1, [3, 3], [3, 3])]
    df = spark.createDataFrame(rows, "pos bigint, order_idx bigint, batch_id bigint, input_ids array<int>, labels array<int>")
    out = {r.pos: r for r in collate_pad(df, 0).collect()}
    assert out[0].input_ids == [5, 0, 7] and out[0].attention_mask == [True, False, True]  # real pad-id token masked
    assert out[1].input_ids == [9, 0, 0] and out[1].labels == [9, -100, -100]
    assert out[2].input_ids == [3, 3]  # batch of one: no padding
    u = {r.pos: r for r in unpad_offsets(collate_pad(df, 0)).collect()}
    assert (u[0].seqlen, u[0].cu_offset, u[0].indices) == (2, 0, [0, 2])
    assert (u[1].seqlen, u[1].cu_offset, u[1].indices, u[1].max_seqlen) == (1, 2, [3], 2)


@pytest.mark.parametrize("ids,expect", [([4, 5, 0, 0], 1), ([4, 5, 6], 2), ([0, 1, 2], 2), ([7], 0), ([], None)])
def test_last_token_index(spark, ids, expect):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(last_token_index("ids", 0).alias("i")).first().i == expect


def test_shift_and_supervision(spark):
    df = spark.createDataFrame([([5],), ([-100, -100, -100],), ([], ), ([-100, 3, 4],)], "labels array<int>")
    got = [(list(r.s), r.n_supervised_shifted, r.fully_masked) for r in
           supervision_stats(df).select(shifted_labels("labels").alias("s"), "n_supervised_shifted", "fully_masked").collect()]
    assert got == [([], 0, True), ([-100, -100], 0, True), ([], 0, True), ([3, 4], 2, False)]


def test_length_policies(spark):
    df = spark.createDataFrame([(i, list(range(i))) for i in (3, 4, 5, 0)], "pos bigint, labels array<int>")
    df = df.withColumn("input_ids", F.col("labels"))
    assert sorted(r.pos for r in drop_long(df, 4).collect()) == [0, 3, 4]
    assert {r.pos: len(r.labels) for r in truncate(df, 4).collect()} == {3: 3, 4: 4, 5: 4, 0: 0}


def test_pair_filters(spark):
    rows = [("ab", "cd", "e"), ("ab", "c", "def"), ("", "x", "y"), ("a", "", "y"), ("😀é", "x", "y")]
    df = spark.createDataFrame(rows, "prompt string, chosen string, rejected string")
    kept = [(r.prompt, r.chosen) for r in drop_empty_pairs(drop_long_chars(df, 4)).collect()]
    assert kept == [("ab", "cd"), ("😀é", "x")]


VALUES = {
    '"text"': True, '"0"': True, '""': False, "0": False, "1": True, "0.0": False, "2.5": True, "false": False,
    "true": True, "null": False, "[]": False, "[0]": True, "{}": False, '{"a": 1}': True,
}


def test_instruction_validity_kinds(spark):
    lines = [json.dumps({"instruction": "i", "input": None}) [:-1] + f', "output": {v}}}' for v in VALUES]
    lines += ['{"instruction": "i", "output": "x"}', "not json"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "id int, value string")
    got = [r.valid for r in validate_instructions(df, mode="flag").orderBy("id").collect()]
    assert got == list(VALUES.values()) + [False, False]
    good, bad = validate_instructions(df, mode="quarantine")
    assert good.count() == sum(VALUES.values())
    with pytest.raises(Exception, match="invalid instruction"):
        validate_instructions(df, mode="fail").collect()


def test_split_is_deterministic(spark):
    df = spark.range(2000).withColumnRenamed("id", "pos")
    a = train_eval_split(df, 10.0)
    share = a.where("split = 'eval'").count() / 2000
    assert 0.07 < share < 0.13
    assert a.exceptAll(train_eval_split(df, 10.0)).count() == 0


def test_drop_unsupervised_and_marker_collisions(spark):
    from tessera.operators.validate import drop_unsupervised, marker_collisions

    df = spark.createDataFrame([(0, [5, 6]), (1, [-100, 7]), (2, [1, -100])], "pos bigint, labels array<int>")
    assert sorted(r.pos for r in drop_unsupervised(df).collect()) == [0, 1]
    t = spark.createDataFrame([("a <|im_end|> b <|endoftext|>",), ("plain",)], "text string")
    assert [r.marker_collisions for r in marker_collisions(t).collect()] == [2, 0]


def test_offsets_close_with_the_total(spark):
    from tessera.operators.collate import collate_pad, cu_seqlens

    rows = [(0, 0, [5, 6]), (0, 1, [7]), (0, 2, []), (1, 3, [9, 9, 9])]
    df = spark.createDataFrame(rows, "batch_id bigint, order_idx bigint, input_ids array<int>")
    padded = collate_pad(df.withColumn("labels", df["input_ids"]).repartition(3), 0)
    got = {r.batch_id: (r.cu_seqlens, r.max_seqlen, r.total) for r in cu_seqlens(padded).collect()}
    assert got == {0: ([0, 2, 3, 3], 2, 3), 1: ([0, 3], 3, 3)}


def test_lines_of_every_kind_are_judged_from_one_parse(spark):
    import json

    from tessera.operators.validate import instruction_valid

    outputs = ["", "x", "0", None, 0, 1, 0.0, -2.5, True, False, [], [None], {}, {"a": None}, 10 ** 30]
    lines = [json.dumps({"instruction": None, "input": "", "output": o}) for o in outputs]
    expect = [bool(o) for o in outputs]
    lines += ['{"instruction": 1, "input": 2}', '[{"instruction":1,"input":2,"output":3}]', "", "{", "null", '"output"',
              '{"input": 1, "output": 1}', None]
    expect += [False] * 8
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got = {r.i: r.v for r in df.select("i", instruction_valid("value").alias("v")).collect()}
    assert [bool(got[i]) for i in range(len(lines))] == expect
    plan = df.select(instruction_valid("value").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 1, plan
