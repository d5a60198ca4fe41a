"""The whole pipeline, and the classifier by itself, against versions in one process."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import pack, quality
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def spec_scores(rows, labels):
    """Quadratic discriminant by determinants and solved systems, from the documented shrinkage."""
    marks = defaultdict(list)
    for i, y in labels:
        if i is not None and y in (0, 1):
            marks[i].append(y)
    x = np.array([quality.statistics(t) for _, t in rows])
    train = [(k, int(np.floor(np.mean(marks[i]) + 0.5))) for k, (i, _) in enumerate(rows)
             if i in marks and zlib.crc32(str(i).encode()) % 3 != 1]
    at = {y: [k for k, c in train if c == y] for y in (0, 1)}
    n = {y: len(at[y]) for y in (0, 1)}
    mean = {y: x[at[y]].mean(axis=0) for y in (0, 1)}
    cov = {y: np.cov(x[at[y]].T, bias=True) for y in (0, 1)}
    common = (cov[0] * n[0] + cov[1] * n[1]) / (n[0] + n[1])
    spread = np.sqrt(np.maximum(np.diag(common), 1e-8))
    log = []
    for y in (0, 1):
        own = ((1 - quality.SHRINK_POOLED) * cov[y] + quality.SHRINK_POOLED * common) / np.outer(spread, spread)
        own = (1 - quality.SHRINK_DIAGONAL) * own + quality.SHRINK_DIAGONAL * np.diag(np.diag(own))
        own += quality.RIDGE * np.eye(len(own))
        d = (x - mean[y]) / spread
        log.append(np.log(n[y] / (n[0] + n[1])) - np.linalg.slogdet(own)[1] / 2 - (d * np.linalg.solve(own, d.T).T).sum(axis=1) / 2)
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]
    return read("documents", "doc_id", "text"), read("labels", "doc_id", "quality"), read("benchmark", "item_id", "text")


def test_classifier_equals_the_discriminant_formula(spark, tables):
    rows, labels, _ = tables
    docs = spark.createDataFrame([(i, t, "x", 1.0, 2) for i, t in rows + [(None, None), (None, "")]],
                                 "doc_id long, text string, f string, score double, label int")
    marks = spark.createDataFrame([(i, q, "y") for i, q in labels + [(None, 1), (3, None)]],
                                  "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality.classify(docs, marks).collect() if r.doc_id is not None}
    for (i, _), s in zip(rows, spec_scores(rows, labels)):
        assert abs(got[i].score - s) < 1e-6 and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def cut_repeats(rows, length=200):
    raws = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for b in raws:
        for k in range(len(b) - length + 1):
            seen[hashlib.md5(b[k:k + length]).digest()] += 1
    out = []
    for (i, t), b in zip(rows, raws):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[hashlib.md5(b[k:k + length]).digest()] > 1:
                gone[k:k + length] = True
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") if gone.any() else t))
    return out


def clean_of(rows, items):
    normal = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                                  re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for _, t in items:
        v = normal(t)
        k = min(10, len(v))
        for j in range(len(v) - k + 1) if v else ():
            windows[k].add(tuple(v[j:j + k]))
    return [(i, t) for i, t in rows for w in [normal(t)]
            if not any(tuple(w[a:a + k]) in ws for k, ws in windows.items() for a in range(len(w) - k + 1))]


def test_run_equals_the_stages_in_one_process(spark, tables):
    from tokenizers import Tokenizer

    rows, labels, items = tables
    kept = [r for r, s in zip(rows, spec_scores(rows, labels)) if s >= 0.5]
    classes = {i: c for i, _, c in brute_components(kept)}
    kept = [(i, t) for i, t in kept if classes[i] == i]
    kept = clean_of(cut_repeats(kept), items)
    assert 0 < len(kept) < len(rows)
    plain = Tokenizer.from_file(pack.tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, t in kept:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for p, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at:at + 4096]
            want[(i, p)] = (at, len(cut), zlib.crc32(cut.tobytes()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= 4096


def test_stages_return_the_documents_columns_and_extra_ones(spark, tables):
    rows, labels, _ = tables
    kind = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, c int, row int"
    docs = spark.createDataFrame([(i, t, "l", "s", len(t or ""), 1, "t", 2, 3) for i, t in rows[:60] + [(None, None), (9001, "")]],
                                 kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r._id for r in out.collect()} <= {1} and stage(spark, docs.limit(0), SF).collect() == [], name
