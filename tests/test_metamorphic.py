"""Metamorphic checks: partition-count invariance, per-epoch quotas, plan-independent counts."""

from pyspark.sql import functions as F

from tessera.functions.exprs import ids_digest
from tessera.operators.mix import mix_epochs, shuffle_sources
from tessera.plans import tasks
from tests.conftest import SF001


def _packed(spark, docs):
    out = tasks.build_pretrain(docs, 32, 16, 3)
    return sorted((r.shard, r.batch, r.chunk, r.d) for r in
                  out.select("shard", "batch", "chunk", ids_digest("input_ids").alias("d")).collect())


def test_pack_invariant_under_repartition(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("pos"), "text")
    base = _packed(spark, docs)
    assert base == _packed(spark, docs.repartition(7)) == _packed(spark, docs.repartition(1))


def test_mix_quota_and_once_per_epoch(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("source", F.col("doc_id").alias("id"))
    props = docs.select("source").distinct().withColumn(
        "ratio", F.when(F.col("source") < "src1", 0.7).otherwise(F.lit(0.29)))
    mixed = mix_epochs(shuffle_sources(docs, 42), props, 6)
    per = mixed.groupBy("epoch", "source").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("id").alias("d"),
                                               F.first("num").alias("num"))
    assert per.where("k <> num OR d <> k").count() == 0
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratios = {r.source: r.ratio for r in props.collect()}
    expected = sum(int(n * ratios[s]) for s, n in sizes.items()) * 6
    assert mixed.count() == expected


def test_supervised_count_independent_of_plan(spark):
    from tessera.sources.tables import sft_conversations
    from tessera.operators.collate import supervised_count

    convs = sft_conversations(spark, SF001)
    a = tasks.build_sft(convs, "qwen", 10_000, False, 8000, None)
    b = tasks.build_sft(convs, "qwen", 10_000, False, 4, 3)
    total = lambda d: d.select(F.sum(supervised_count("labels"))).first()[0]
    assert total(a) == total(b) > 0


def test_sft_from_turns_equals_grouped_path_with_hot_conversation(spark):
    from tessera.sources.tables import flat_turns_to_conversations

    turns = spark.read.parquet(f"{SF001}/conversations.parquet")
    n_conv = turns.select("conv_id").distinct().count()
    hot = spark.createDataFrame(
        [(n_conv, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * (1 + t % 3)) for t in range(400)],
        turns.schema)
    allturns = turns.unionByName(hot)
    for discard in (True, False):
        a = tasks.build_sft(flat_turns_to_conversations(allturns), "qwen", 256, discard, 8, 2)
        b = tasks.build_sft_from_turns(allturns, "qwen", 256, discard, 8, 2)
        cols = lambda d: sorted(
            (r.pos, r.shard, r.batch, r.rank_in_batch, r.out_pos, r.n, r.i, r.l) for r in d.select(
                "pos", "shard", "batch", "rank_in_batch", "out_pos", "n",
                ids_digest("input_ids").alias("i"), ids_digest("labels").alias("l")).collect())
        ra, rb = cols(a), cols(b)
        assert ra == rb
        assert (n_conv in [r[0] for r in ra]) is (not discard)


def test_separator_adds_one_token_per_document(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("pos"), "text")
    plain = tasks.build_pretrain(docs, 10**9, 10**6, 1)  # one batch shorter than L: nothing dropped
    sep = tasks.build_pretrain(docs, 10**9, 10**6, 1, separator_id=-7)
    total = lambda d: d.select(F.sum("n_tokens")).first()[0]
    assert total(sep) == total(plain) + docs.count()
    ids = sep.first().input_ids
    assert ids[-1] == -7 and ids.count(-7) == docs.count()


def test_both_ways_of_dealing_out_texts_pack_alike(spark):
    from tessera.operators.order import assign_map_batches

    docs = spark.createDataFrame([(i, "alpha beta gamma " * (i % 7)) for i in range(60)], "pos bigint, text string")
    codec = tasks.codec_for(None).learn(tasks.task_pretokens(docs, "pt"))
    batched = assign_map_batches(docs, 9, 2, n_rows=60)
    a, b = (sorted(tuple(r) for r in tasks.pack_documents(batched, codec, 16, by_batch).collect()) for by_batch in (True, False))
    assert a == b and a
