"""File entry points in one job: line numbers by scan split, batches by (file, line), the cache's ledger, flat turns."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.order import assign_file_batches, assign_map_batches, file_batch_count, map_batch_count, number_lines
from tessera.plans import tasks
from tessera.sources import io
from tessera.sources.tables import flat_turns_to_conversations


def folder(name):
    return tempfile.mkdtemp(prefix=f"tessera-{name}-", dir="/tmp")


def write_lines(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")


def small_splits(spark):
    """Session setting for a test: files are read in splits of a few lines."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    return old


def test_lines_are_numbered_by_split_and_not_moved(spark):
    root = folder("lines")
    sizes = {"a.json": 57, "b b.json": 0, "c+.json": 1, "d.json": 130}
    for name, n in sizes.items():
        write_lines(os.path.join(root, name), [{"text": f"{name} {i} " + "x" * (i % 50)} for i in range(n)])
    with open(os.path.join(root, "e.json"), "w") as f:
        json.dump([{"text": f"e.json {i}"} for i in range(9)], f, indent=1)
    old = small_splits(spark)
    try:
        files = [io.qualified(spark, f) for f in io.discover_files(spark, directory=root)]
        raw = io.with_file_index(io.read_samples(spark, files, io.PRETRAIN_SCHEMA), files)
        assert raw.rdd.getNumPartitions() > 4
        rows = number_lines(raw, "file_index")
        got = sorted((r.pos, r.file_index, r.in_file, r.n_file, r.text) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    order = [(i, n) for i, name in enumerate(sizes) for n in range(sizes[name])] + [(4, n) for n in range(9)]
    names = list(sizes) + ["e.json"]
    assert [(p, f, k) for p, f, k, _, _ in got] == [(p, f, k) for p, (f, k) in enumerate(order)]
    assert all(t.startswith(f"{names[f]} {k}") for _, f, k, _, t in got)
    assert all(n == (list(sizes.values()) + [9])[f] for _, f, _, n, _ in got)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan, plan


def test_batches_of_many_files_equal_those_of_each_file(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 60) for _ in range(12)]
    rows = spark.createDataFrame([(f, n, k) for f, n in enumerate(sizes) for k in range(n)],
                                 "file_index int, n_file bigint, in_file bigint")
    for batch, workers in ((7, 3), (100, 1), (4, 70)):
        got = {(r.file_index, r.in_file): (r.shard, r.batch) for r in assign_file_batches(rows, batch, workers).collect()}
        total = 0
        for f, n in enumerate(sizes):
            one = assign_map_batches(spark.range(n).withColumnRenamed("id", "pos"), batch, workers)
            assert all(got[f, r.pos] == (f * workers + r.shard, r.batch) for r in one.collect())
            total += map_batch_count(n, batch, workers)
        assert file_batch_count(rows, batch, workers) == total


def jobs_of(spark, run):
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("task", ["pt", "sft", "dpo", "reward"])
def test_jobs_do_not_grow_with_files_and_files_stay_apart(spark, task):
    def rows(name, n):
        if task == "pt":
            return [{"text": f"{name} alpha {i} beta gamma"} for i in range(n)]
        if task == "sft":
            return [{"conversations": [{"role": "user", "content": f"{name} {i}"}, {"role": "assistant", "content": "a " * i}]}
                    for i in range(n)]
        return [{"question": f"{name} {i}", "response_chosen": "good", "response_rejected": "bad"} for i in range(n)]

    jobs, outs = [], []
    for n_files in (2, 7):
        root = folder("many")
        for i in range(n_files):
            write_lines(os.path.join(root, f"f{i}.json"), rows(f"f{i}", 5 + i))
        run = lambda: outs.append(tasks.prepare_training_data(  # noqa: E731, B023
            spark, task, train_file_dir=root, max_seq_length=300 if task != "pt" else 8, batch_size=3, workers=2).collect())
        jobs.append(jobs_of(spark, run))
    # an optimiser may take a broadcast's job more or less; five more files would be five more of anything
    assert abs(jobs[1] - jobs[0]) <= 2, jobs
    out = sorted(outs[1], key=lambda r: r.pos)
    assert [r.pos for r in out] == list(range(len(out))) and sorted({r.file_index for r in out}) == list(range(7))
    assert [r.file_index for r in out] == sorted(r.file_index for r in out)


def test_pretraining_files_are_read_and_split_once(spark, monkeypatch):
    """Without a vocabulary, ids and vocabulary are those of a vocabulary counted apart, from one reading of the files,
    whose heads are looked at once; lines read in a few splits are dealt out first."""
    from tessera.operators import order, tokens

    root, rng = folder("once"), random.Random(8)
    texts = [[" ".join(rng.choice(["the", "caf\u0065\u0301", f"w{rng.randrange(90)}", "12,"]) for _ in range(rng.randrange(9)))
              for _ in range(n)] for n in (57, 0, 1, 90)]
    texts[3][5:8] = [None, "", "a<|im_end|>b <|endoftext|>"]
    for i, lines in enumerate(texts):
        write_lines(os.path.join(root, f"f{i}.json"), [{"text": t} for t in lines])
    counted = tokens.vocab_table(tasks.task_pretokens(
        spark.createDataFrame([(t,) for lines in texts for t in lines], "text string"), "pt"))
    run = lambda **more: tasks.prepare_training_data(
        spark, "pt", train_file_dir=root, max_seq_length=16, batch_size=9, workers=2, **more)
    listed = lambda df: sorted((r.file_index, r.pos, r.shard, r.batch, r.chunk, r.n_tokens, r.input_ids, r.labels)
                               for r in df.collect())
    want = listed(run(vocab=counted))
    reads, read = [], io.read_samples
    monkeypatch.setattr(io, "read_samples", lambda *a, **k: reads.append(1) or read(*a, **k))
    old = small_splits(spark)
    try:
        for slots, bucket in ((1, 10 ** 6), (1, 40), (10 ** 6, 40)):
            monkeypatch.setattr(order, "task_slots", lambda spark: slots)  # noqa: B023
            monkeypatch.setattr(tokens, "BUCKET_TOKENS", bucket)
            reads.clear()
            out, vocab = run(return_vocab=True)
            assert listed(out) == want and len(want) > 20
            assert sorted(vocab.collect()) == sorted(counted.collect())
            assert len(reads) == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_array_files_are_told_from_lines_by_one_codec_table(spark):
    import gzip

    root = folder("heads")
    for name, head in (("a.json", "[1]"), ("b.json", ' \n{"text": "x"}'), ("c.json", ""), ("d.json.gz", "\ufeff [2]")):
        data = head.encode()
        with open(os.path.join(root, name), "wb") as f:
            f.write(gzip.compress(data) if name.endswith("gz") else data)
    paths = [os.path.join(root, n) for n in sorted(os.listdir(root))]
    assert [os.path.basename(p) for p in io.array_files(spark, paths)] == ["a.json", "d.json.gz"]
    assert [io.is_array_file(spark, p) for p in paths] == [True, False, False, True]
    assert io.array_files(spark, []) == []


def test_ledger_prepares_only_what_is_not_committed(spark):
    root, cache = folder("src"), folder("cache")
    write_lines(os.path.join(root, "a.json"), [{"text": "one two three"}])
    write_lines(os.path.join(root, "c.json"), [{"text": "five"}])
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate("one two three four five".split())], "token string, id int")
    run = lambda: [(r.pos, r.file_index, r.input_ids) for r in tasks.prepare_training_data(
        spark, "pt", train_file_dir=root, max_seq_length=9, vocab=vocab, cache_dir=cache).orderBy("pos").collect()]
    assert run() == [(0, 0, [0, 1, 2]), (1, 1, [4])]
    runs = lambda: sorted(d for d in os.listdir(cache) if d.startswith("run-"))
    first = runs()
    assert run() == [(0, 0, [0, 1, 2]), (1, 1, [4])] and runs() == first
    write_lines(os.path.join(root, "b.json"), [{"text": "four"}])      # between the two: only this one is prepared
    assert run() == [(0, 0, [0, 1, 2]), (1, 1, [3]), (2, 2, [4])] and len(runs()) == len(first) + 1
    # a run that broke off before its commits is not read and its files are prepared again
    ledger = io.CacheLedger(spark, cache)
    assert len(ledger.committed()) == 3
    os.makedirs(os.path.join(cache, "run-broken"))
    write_lines(os.path.join(root, "d.json"), [{"text": "one"}])
    assert [r[2] for r in run()] == [[0, 1, 2], [3], [4], [0]]


# --- flat turns -------------------------------------------------------------------------------

def turns_frame(spark, turns, kind="bigint"):
    return spark.createDataFrame(turns, f"conv_id {kind}, turn bigint, role string, text string").repartition(5)


def both_paths(spark, turns, kind="bigint", discard=True, max_len=60, workers=2):
    flat = tasks.build_sft_from_turns(turns_frame(spark, turns, kind), "qwen", max_len, discard, 3, workers)
    keys = sorted({t[0] for t in turns if t[0] is not None})
    renamed = [(keys.index(c), t, r, x) for c, t, r, x in turns if c is not None]
    nested = tasks.build_sft(flat_turns_to_conversations(turns_frame(spark, renamed)), "qwen", max_len, discard, 3, workers)
    cols = ["pos", "shard", "batch", "rank_in_batch", "out_pos", "n", "input_ids", "labels"]
    a = [tuple(r) for r in flat.select("conv_id", *cols).orderBy("out_pos").collect()]
    b = [tuple(r) for r in nested.select(*cols).orderBy("out_pos").collect()]
    assert [r[0] for r in a] == [keys[r[1]] for r in a]
    return [r[1:] for r in a], b


@pytest.mark.parametrize("discard", [True, False])
def test_flat_turns_equal_nested_conversations(spark, discard):
    turns = [(7, 0, "user", "hello there"), (7, 1, "assistant", "general " * 12), (1007, 0, "tool", "nothing"),
             (2007, 0, "system", "be brief"), (2007, 1, "user", "why"), (2007, 2, "assistant", "so"),
             (3007, 0, "user", None), (3007, 1, "assistant", "word " * 80), (4007, 0, "user", ""), (-5, 3, "user", "x"),
             (-5, 3, "user", "a"), (-5, 3, "assistant", "z"), (-5, 4, "assistant", "b"), (None, 0, "user", "no key")]
    a, b = both_paths(spark, turns, discard=discard)
    assert a == b and [r[0] for r in sorted(a)] == list(range(6))[:len(a)] if not discard else a == b
    text_keys = [("c%s" % c if c is not None else None, t, r, x) for c, t, r, x in turns]
    a, b = both_paths(spark, text_keys, "string", discard)
    assert a == b


def test_a_conversation_without_a_token_stays(spark):
    # a template without a default system text: nothing is left of the conversation
    turns = [(3, 0, "tool", "x"), (9, 0, "user", "y"), (9, 1, "assistant", "z")]
    out = tasks.build_sft_from_turns(turns_frame(spark, turns), "yi", 50, True, 8, 1).orderBy("pos").collect()
    assert [(r.pos, r.conv_id, r.n) for r in out][0] == (0, 3, 0) and out[0].input_ids == [] and len(out) == 2


def test_repeated_turn_with_truncation_keeps_lengths(spark):
    turns = [(0, 0, "user", "a b c d"), (0, 0, "user", "a b c d"), (0, 1, "assistant", "e f g h i")]
    for discard in (True, False):
        r = tasks.build_sft_from_turns(turns_frame(spark, turns), "qwen", 28, discard, 8, 1).collect()
        full = tasks.build_sft_from_turns(turns_frame(spark, turns), "qwen", 500, discard, 8, 1).first()
        assert len(full.input_ids) == full.n
        assert [len(x.input_ids) for x in r] == ([min(28, full.n)] if not discard or full.n <= 28 else [])


def test_output_positions_are_counted_on_sizes_only(spark):
    from tessera.operators.pack import sort_by_length

    rng = random.Random(6)
    rows = [(i, i // 40, (i // 8) % 5, rng.randrange(30), "payload") for i in range(200)]
    df = spark.createDataFrame(rows, "pos bigint, shard bigint, batch bigint, n bigint, payload string").repartition(6)
    out = sort_by_length(df, "n")
    got = [(r.shard, r.batch, r.n, r.pos) for r in out.orderBy("out_pos").collect()]
    assert got == sorted((s, b, n, p) for p, s, b, n, _ in rows)
    assert sorted(r.out_pos for r in out.collect()) == list(range(200))
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert not any("payload" in line for line in exchanges) and "rangepartitioning" not in plan, plan
