"""Incremental preparation (op 60) and readers/writers (ops 1-9)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.sources import io
from tessera.sources.io import PRETRAIN_SCHEMA
from tessera.streaming.incremental import prepare_stream, pretrain_preparer
from tessera.operators.tokens import pretokenise, vocab_table


def write_lines(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")


def test_stream_equals_file_by_file_batch(spark):
    root = tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")
    src = os.path.join(root, "in")
    os.makedirs(src)
    texts = [[f"doc {i} alpha beta {'gamma ' * (i % 7)}" for i in range(k, k + 9)] for k in (0, 100, 200)]
    for j, block in enumerate(texts):
        write_lines(os.path.join(src, f"part{j}.jsonl"), [{"text": t} for t in block])
    write_lines(os.path.join(src, "empty.jsonl"), [])
    all_docs = spark.createDataFrame([(t,) for b in texts for t in b], "text string")
    vocab = vocab_table(pretokenise(all_docs))
    prep = pretrain_preparer(vocab, max_seq_len=8, batch_size=4)
    out, ckpt = os.path.join(root, "out"), os.path.join(root, "ckpt")
    table = prepare_stream(spark, src, out, ckpt, prep, PRETRAIN_SCHEMA)
    got = sorted(tuple(r.input_ids) for r in table.collect())
    expect = []
    for j in range(3):
        one = io.read_samples(spark, os.path.join(src, f"part{j}.jsonl"), PRETRAIN_SCHEMA)
        expect += [tuple(r.input_ids) for r in prep(one).collect()]
    assert got == sorted(expect)
    # a second run sees no new file and adds nothing
    again = prepare_stream(spark, src, out, ckpt, prep, PRETRAIN_SCHEMA)
    assert again.count() == len(expect)


def test_readers_writers(spark):
    root = tempfile.mkdtemp(prefix="tessera-io-", dir="/tmp")
    for s, rows in {"alpha": [{"instruction": "i", "input": "", "output": "o", "extra": 1}],
                    "beta": [{"instruction": "j", "input": None, "output": "p"}] * 2}.items():
        os.makedirs(os.path.join(root, s))
        write_lines(os.path.join(root, s, "a.json"), rows)
    schema = "instruction string, input string, output string"
    df = io.read_sources(spark, root, ["alpha", "beta"], spark.createDataFrame([], schema).schema)
    assert sorted((r.source, r.instruction) for r in df.collect()) == [("alpha", "i"), ("beta", "j"), ("beta", "j")]
    os.makedirs(os.path.join(root, "gamma"))
    try:
        io.read_sources(spark, root, ["gamma"], spark.createDataFrame([], schema).schema)
        raise AssertionError("missing source must fail")
    except FileNotFoundError:
        pass
    files = io.discover_files(spark, directory=os.path.join(root, "alpha"))
    assert len(files) == 1 and files[0].endswith("a.json")
    assert io.discover_files(spark, file="x.json") == ["x.json"]
    # JSON lines out: nulls kept, non-ASCII verbatim
    out = os.path.join(root, "mixed")
    recs = spark.createDataFrame([(0, "é", None)], "pos bigint, a string, b string")
    io.write_jsonl(recs, out, ["a", "b"], order_col="pos")
    line = spark.read.text(out).first().value
    assert line == '{"a":"é","b":null}'
    props_path = os.path.join(root, "props.json")
    with open(props_path, "w") as f:
        json.dump({"alpha": 0.5, "beta": 1.0}, f)
    props = io.read_proportions(spark, props_path)
    assert sorted((r.source, r.ratio) for r in props.collect()) == [("alpha", 0.5), ("beta", 1.0)]


def test_materialise_reuses_by_fingerprint(spark):
    root = tempfile.mkdtemp(prefix="tessera-cache-", dir="/tmp")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    a = io.materialise(build, spark, root, "/data/train.v1.json", {"max_len": 8})
    b = io.materialise(build, spark, root, "/data/train.v1.json", {"max_len": 8})
    c = io.materialise(build, spark, root, "/data/train.v2.json", {"max_len": 8})
    assert a.count() == b.count() == c.count() == 5 and len(calls) == 2
    assert io.params_fingerprint("/d/a.x.json", {"k": 1}) != io.params_fingerprint("/d/a.y.json", {"k": 1})
    assert F is not None


def test_stream_files_sharing_a_name_prefix_are_both_prepared(spark):
    root = tempfile.mkdtemp(prefix="tessera-stream2-", dir="/tmp")
    src = os.path.join(root, "in")
    os.makedirs(src)
    write_lines(os.path.join(src, "data.part1.jsonl"), [{"text": "alpha beta gamma delta"}] * 3)
    write_lines(os.path.join(src, "data.part2.jsonl"), [{"text": "epsilon zeta eta theta"}] * 3)
    all_docs = spark.createDataFrame([("alpha beta gamma delta epsilon zeta eta theta",)], "text string")
    prep = pretrain_preparer(vocab_table(pretokenise(all_docs)), max_seq_len=4, batch_size=10)
    table = prepare_stream(spark, src, os.path.join(root, "out"), os.path.join(root, "ckpt"), prep, PRETRAIN_SCHEMA)
    assert table.count() == 6  # 12 tokens per file -> 3 chunks of 4, for each of the two files
    assert table.select(F.countDistinct("batch_id")).first()[0] == 2


def test_ledger_survives_a_crash_between_write_and_commit_and_a_lost_checkpoint(spark):
    import json
    import os
    import tempfile

    import pytest

    from tessera.operators.codec import PortableCodec
    from tessera.sources.io import PRETRAIN_SCHEMA
    from tessera.streaming.incremental import StreamLedger, indexed_pretrain_preparer, prepare_stream_once

    root = tempfile.mkdtemp(prefix="tessera-ledger-", dir="/tmp")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    os.makedirs(src)

    def write(name, texts):
        with open(os.path.join(src, name), "w") as f:
            f.writelines(json.dumps({"text": t}) + "\n" for t in texts)

    words = "a b c d e f g h".split()
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token string, id int")
    prepare = indexed_pretrain_preparer(3, 2, codec=PortableCodec(vocab, size=8))
    run = lambda ckpt, how=prepare: prepare_stream_once(spark, src, out, os.path.join(root, ckpt), how, PRETRAIN_SCHEMA)
    rows = lambda df: sorted((r.pos, r.in_file, r.input_ids) for r in df.collect())
    assert run("none") is None
    write("one.json", ["a b c d e f", "g h"])                     # 8 tokens: two chunks of 3, the rest dropped
    first = rows(run("ckpt"))
    assert first == [(0, 0, [0, 1, 2]), (1, 1, [3, 4, 5])]
    write("two.json", ["h g f e", "d c"])

    class Killed(Exception):
        pass

    commit = StreamLedger.prepare

    def dies_before_the_commit(self, batch, how):
        def writes_then_dies(rows_):
            how(rows_).write.parquet(f"{self.root}/run-0123456789abcdef")       # written, never committed
            raise Killed("killed between write and commit")

        commit(self, batch, writes_then_dies)

    StreamLedger.prepare = dies_before_the_commit
    try:
        with pytest.raises(Exception, match="killed between"):
            run("ckpt")
    finally:
        StreamLedger.prepare = commit
    assert rows(StreamLedger(spark, out).read()) == first         # what was not committed is not there
    both = first + [(2, 0, [7, 6, 5]), (3, 1, [4, 3, 2])]
    assert rows(run("ckpt")) == both                              # the killed file is prepared, once
    assert rows(run("fresh")) == both and rows(run("other")) == both      # a lost checkpoint repeats nothing
    write("three.json", ["a"])
    assert rows(run("fresh")) == both + [(4, 0, [0])]
    assert len(StreamLedger(spark, out).commits()) == 3


def test_ledger_prepares_the_files_of_a_trigger_in_one_job(spark):
    from tessera.operators.codec import PortableCodec
    from tessera.streaming.incremental import StreamLedger, indexed_pretrain_preparer, prepare_stream_once

    root = tempfile.mkdtemp(prefix="tessera-ledger2-", dir="/tmp")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    os.makedirs(src)
    words = "a b c d e f g h".split()
    texts = [["a b c d", "e f"], [""], ["h g", "f", "e d c b"], ["a"] * 5]
    for i, block in enumerate(texts):
        write_lines(os.path.join(src, f"part{i}.json"), [{"text": t} for t in block])
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "token string, id int")
    inner = indexed_pretrain_preparer(2, 2, codec=PortableCodec(vocab, size=8))
    calls = []
    prepare = lambda rows: calls.append(1) or inner(rows)
    run = lambda name: prepare_stream_once(spark, src, out, os.path.join(root, name), prepare, PRETRAIN_SCHEMA)
    table = run("first")
    assert len(calls) == 1
    got = [(r.pos, os.path.basename(r.file), r.in_file, r.shard, r.batch, r.chunk, r.input_ids)
           for r in sorted(table.collect(), key=lambda r: r.pos)]
    assert got == [
        (0, "part0.json", 0, 0, 0, 0, [0, 1]), (1, "part0.json", 1, 0, 0, 1, [2, 3]), (2, "part0.json", 2, 0, 0, 2, [4, 5]),
        (3, "part2.json", 0, 0, 0, 0, [7, 6]), (4, "part2.json", 1, 0, 1, 0, [4, 3]), (5, "part2.json", 2, 0, 1, 1, [2, 1]),
        (6, "part3.json", 0, 0, 0, 0, [0, 0]), (7, "part3.json", 1, 0, 1, 0, [0, 0]), (8, "part3.json", 2, 0, 2, 0, [0])]
    assert run("again").count() == 9 and len(calls) == 1
    assert sorted(r["n"] for r in StreamLedger(spark, out).commits()) == [0, 3, 3, 3]


def test_folders_of_a_stream_are_packed_apart_and_their_files_together(spark):
    from tessera.operators.codec import PortableCodec
    from tessera.streaming.incremental import folder_pretrain_preparer

    root = tempfile.mkdtemp(prefix="tessera-folders-", dir="/tmp")
    for name, texts in {"x/part-0": ["a b", "c"], "x/part-1": ["d e f"], "y/part-0": ["h g"]}.items():
        os.makedirs(os.path.dirname(os.path.join(root, "in", name)), exist_ok=True)
        write_lines(os.path.join(root, "in", f"{name}.json"), [{"text": t} for t in texts])
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate("abcdefgh")], "token string, id int")
    prepare = folder_pretrain_preparer(4, 10, codec=PortableCodec(vocab, size=8))
    table = prepare_stream(spark, os.path.join(root, "in", "*"), os.path.join(root, "out"), os.path.join(root, "ckpt"),
                           prepare, PRETRAIN_SCHEMA, "*.json", whole=True)
    rows = sorted((r.file_index, r.shard, r.batch, r.chunk, r.input_ids) for r in table.collect())
    assert rows == [(0, 0, 0, 0, [0, 1, 2, 3]), (1, 0, 0, 0, [7, 6])]
