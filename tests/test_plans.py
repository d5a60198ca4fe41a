"""Plan-shape guards for the flagship: one data exchange, pruned scan, no Python, regex once."""

import re

from tests.conftest import SF001


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_shape(spark):
    from tessera.operators.order import batch_partitioning_pays
    from tessera.plans.catalog import PACK_BATCH, PACK_WORKERS, pretrain_packed
    from tessera.sources.tables import pretrain_docs

    # enough map batches for the session's slots: texts are dealt out by (shard, batch)
    assert batch_partitioning_pays(spark, pretrain_docs(spark, SF001).count(), PACK_BATCH, PACK_WORKERS)
    plan = _final_plan(pretrain_packed(spark, SF001))
    data_exchanges = [l for l in plan.splitlines() if "Exchange hashpartitioning" in l and "_ix_part" not in l]
    assert len(data_exchanges) == 1 and "shard" in data_exchanges[0] and "batch" in data_exchanges[0], data_exchanges
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?documents\.parquet", plan)
    assert scans and all(set(s.replace(" ", "").split(",")) <= {"doc_id#0L", "text#1"} or
                         {c.split("#")[0] for c in s.split(",")} == {"doc_id", "text"} for s in scans)
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    # the split (of plain texts, and around markers) is evaluated in one place
    assert sum("regexp_extract_all(" in line for line in plan.splitlines()) == 1


def test_sft_tokens_single_data_exchange(spark):
    from tessera.plans.catalog import sft_tokens

    plan = _final_plan(sft_tokens(spark, SF001))
    data_exchanges = [l for l in plan.splitlines() if "Exchange hashpartitioning" in l and "_ix_part" not in l]
    assert len(data_exchanges) == 1 and "conv_id" in data_exchanges[0], data_exchanges
    assert "ArrowEvalPython" not in plan


def test_no_cross_joins_anywhere(spark):
    from tessera.plans.catalog import QUERIES

    for name in ("pretrain_packed", "mix_epochs", "dpo_losses", "sft_prepared", "plan_length_grouped"):
        plan = _final_plan(QUERIES[name](spark, SF001))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
