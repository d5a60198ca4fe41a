"""The two entry points: task dispatch over files and the epoch-mixing job."""

import json
import os
import tempfile

import pytest

from tessera.plans.tasks import build_mixture, prepare_training_data
from tessera.sources import io


def write_lines(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")


def test_prepare_training_data_all_tasks(spark):
    root = tempfile.mkdtemp(prefix="tessera-tasks-", dir="/tmp")
    pt = os.path.join(root, "pt")
    os.makedirs(pt)
    write_lines(os.path.join(pt, "a.jsonl"), [{"text": f"alpha beta {i} gamma"} for i in range(10)])
    write_lines(os.path.join(pt, "b.json"), [{"text": "delta epsilon"}] * 3)
    sft = os.path.join(root, "sft.json")
    write_lines(sft, [{"conversations": [{"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": "a"}]}
                      for i in range(5)])
    pref = os.path.join(root, "pref.json")
    write_lines(pref, [{"question": "q", "response_chosen": "good", "response_rejected": "bad"}] * 4)

    packed = prepare_training_data(spark, "pt", train_file_dir=pt, max_seq_length=4, batch_size=100)
    assert packed.count() > 0 and sorted(r.pos for r in packed.collect()) == list(range(packed.count()))
    s = prepare_training_data(spark, "sft", train_file=sft, max_seq_length=64, cache_dir=os.path.join(root, "cache"))
    assert s.count() == 5
    again = prepare_training_data(spark, "sft", train_file=sft, max_seq_length=64, cache_dir=os.path.join(root, "cache"))
    assert again.count() == 5
    d = prepare_training_data(spark, "dpo", train_file=pref, max_seq_length=1000)
    assert d.count() == 4 and d.first().prompt.endswith("<|im_start|>assistant\n")
    r = prepare_training_data(spark, "reward", train_file=pref, max_seq_length=1000)
    assert r.count() == 4 and r.first().attention_mask_chosen == [1] * len(r.first().input_ids_chosen)
    with pytest.raises(ValueError):
        prepare_training_data(spark, "nope", train_file=pref)


def folder(name):
    return tempfile.mkdtemp(prefix=f"tessera-{name}-", dir="/tmp")


def test_files_share_one_vocabulary_and_the_cache_knows_it(spark):
    root = folder("vocab")
    write_lines(os.path.join(root, "a.json"), [{"text": "alpha beta beta beta"}])
    write_lines(os.path.join(root, "b.json"), [{"text": "beta alpha alpha alpha alpha"}])
    out, vocab = prepare_training_data(spark, "pt", train_file_dir=root, max_seq_length=64, return_vocab=True)
    ids = {r.token: r.id for r in vocab.collect()}
    words = [r.input_ids for r in out.orderBy("pos").collect()]
    assert words == [[ids["alpha"]] + [ids["beta"]] * 3, [ids["beta"]] + [ids["alpha"]] * 4]
    cache = folder("vocab-cache")
    shifted = vocab.withColumn("id", vocab["id"] + 7)
    for v, more in ((vocab, 0), (shifted, 7), (vocab, 0)):
        got = prepare_training_data(spark, "pt", train_file_dir=root, max_seq_length=64, vocab=v, cache_dir=cache)
        assert [r.input_ids for r in got.orderBy("pos").collect()] == [[i + more for i in w] for w in words]
    # a file that changes is prepared again
    write_lines(os.path.join(root, "b.json"), [{"text": "beta"}])
    got = prepare_training_data(spark, "pt", train_file_dir=root, max_seq_length=64, vocab=vocab, cache_dir=cache)
    assert [r.input_ids for r in got.orderBy("pos").collect()] == [words[0], [ids["beta"]]]


def test_pos_is_dense_after_drops_in_every_file(spark):
    root = folder("drops")
    pair = lambda q, c: {"question": q, "response_chosen": c, "response_rejected": "bad"}
    for name in ("a", "b", "c"):
        write_lines(os.path.join(root, f"{name}.json"),
                    [pair(f"{name}0", "x" * 5000), pair(f"{name}1", "good"), pair(f"{name}2", "y " * 5000),
                     pair(f"{name}3", "fine")])
    for task, column in (("dpo", "prompt"), ("reward", None)):
        rows = prepare_training_data(spark, task, train_file_dir=root, max_seq_length=400).orderBy("pos").collect()
        assert [r.pos for r in rows] == list(range(len(rows))) and len(rows) >= 6
        assert [r.file_index for r in rows] == sorted(r.file_index for r in rows)
        if column:
            names = [n for r in rows for n in ("a1", "a3", "b1", "b3", "c1", "c3") if n in r[column]]
            assert names == ["a1", "a3", "b1", "b3", "c1", "c3"]


def test_array_files_and_malformed_lines(spark):
    root = folder("arrays")
    with open(os.path.join(root, "a.json"), "w") as f:
        json.dump([{"text": "one two"}, {"text": "three"}], f, indent=2)
    write_lines(os.path.join(root, "b.json"), [{"text": "four"}])
    out = prepare_training_data(spark, "pt", train_file_dir=root, max_seq_length=64)
    assert [len(r.input_ids) for r in out.orderBy("pos").collect()] == [3, 1]
    bad = os.path.join(root, "bad.jsonl")
    with open(bad, "w") as f:
        f.write('{"text": "fine"}\n{"text": "bro\n{"text": "well"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        prepare_training_data(spark, "pt", train_file=bad)
    kept = io.read_samples(spark, bad, io.PRETRAIN_SCHEMA, malformed="quarantine").cache()
    assert sorted(r.text for r in kept.where("_corrupt is null").collect()) == ["fine", "well"]
    assert [r._corrupt for r in kept.where("_corrupt is not null").collect()] == ['{"text": "bro']


def test_null_message_leaves_its_conversation(spark):
    root = folder("nullmsg")
    path = os.path.join(root, "a.json")
    write_lines(path, [{"conversations": [{"role": "user", "content": None}, {"role": "assistant", "content": "a b c"}]}])
    out = prepare_training_data(spark, "sft", train_file=path, max_seq_length=64).collect()
    assert len(out) == 1 and len(out[0].input_ids) > 3 and max(out[0].labels) >= 0


def test_mixture_source_names_and_empty_sources(spark):
    root = folder("names")
    for s in ("web", "my src", "a+b", "50%"):
        os.makedirs(os.path.join(root, "in", s))
        write_lines(os.path.join(root, "in", s, "x.json"),
                    [{"instruction": f"{s}{i}", "input": "", "output": "o", "tag": s} for i in range(4)])
    cfg = os.path.join(root, "cfg.json")
    with open(cfg, "w") as f:
        json.dump({"web": 1.0, "my src": 0.5, "a+b": 0.5, "50%": 0.5}, f)
    out = os.path.join(root, "out")
    build_mixture(spark, os.path.join(root, "in"), cfg, 1, out)
    tags = [json.loads(r.value)["tag"] for r in spark.read.text(out).collect()]
    assert {t: tags.count(t) for t in set(tags)} == {"web": 4, "my src": 2, "a+b": 2, "50%": 2}
    os.makedirs(os.path.join(root, "in", "none"))
    open(os.path.join(root, "in", "none", "x.json"), "w").close()
    with open(cfg, "w") as f:
        json.dump({"web": 1.0, "none": 0.5}, f)
    with pytest.raises(ValueError, match="none"):
        build_mixture(spark, os.path.join(root, "in"), cfg, 1, os.path.join(root, "out2"))
    with open(cfg, "w") as f:
        f.write("{broken")
    with pytest.raises(Exception, match="proportion config"):
        build_mixture(spark, os.path.join(root, "in"), cfg, 1, os.path.join(root, "out3"))


def test_build_mixture(spark):
    root = tempfile.mkdtemp(prefix="tessera-mixjob-", dir="/tmp")
    for s, n in (("web", 10), ("code", 4)):
        os.makedirs(os.path.join(root, "in", s))
        write_lines(os.path.join(root, "in", s, "x.json"),
                    [{"instruction": f"{s}{i}", "input": "", "output": "o", "tag": s} for i in range(n)])
    cfg = os.path.join(root, "cfg.json")
    with open(cfg, "w") as f:
        json.dump({"web": 0.3, "code": 1.0}, f)
    out = os.path.join(root, "out")
    build_mixture(spark, os.path.join(root, "in"), cfg, 3, out)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert len(lines) == 3 * (3 + 4)
    assert sum(1 for x in lines if x["tag"] == "code") == 12
    # a bad record fails the job
    write_lines(os.path.join(root, "in", "code", "y.json"), [{"instruction": "i", "input": "", "output": ""}])
    with pytest.raises(Exception, match="invalid instruction"):
        build_mixture(spark, os.path.join(root, "in"), cfg, 1, os.path.join(root, "out2"))
