"""Driver contract: entry() runs; every query has a unique name; oracles map to queries."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_contract(spark):
    m = load()
    df = m.entry(spark)
    assert df.columns == ["shard", "batch", "chunk", "n_tokens", "ids_md5"]
    assert df.count() > 0
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) >= set(m._llm()[0])


def test_small_queries_run_at_smoke_scale(spark):
    m = load()
    for name in ("sft_rendered", "dpo_prompts", "mix_report", "token_nll"):
        assert m.queries()[name](spark, "/root/testdata/sf0.001").count() >= 1
