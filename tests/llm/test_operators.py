"""Dealt operators against brute force on small tables: NULLs, empty and long texts, ties, repeated rows, no rows,
columns of clashing names."""

import hashlib
import random
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import (components, decontaminate, jaccard, licenses, mtree, pack, quality, repeats, shards, shingles,
                         stages, suffixes, urls, wrappers)

DOCS = "doc_id long, text string, n long, h string, size long, _text string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Eps", "zé"]) + str(rng.randrange(60))
                    for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(0, None), (1, ""), (2, "   \n"), (3, "one two"), (4, "One  TWO"), (5, "x" * 700)]
    base = words(rng, 90)
    out += [(10 + i, base) for i in range(4)]                                  # copies
    for i in range(12):                                                        # near copies
        w = base.split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = "changed%d" % rng.randrange(1000)
        out.append((20 + i, " ".join(w)))
    passage = words(rng, 45)
    out += [(40 + i, words(rng, 30) + "\n" + passage + "\n" + words(rng, 20)) for i in range(6)]
    out += [(60 + i, words(rng, rng.randrange(1, 200))) for i in range(20)]
    out += [(90, "ab" * 400), (91, "Oneaea " * 80), (92, words(rng, 6000))]
    out += [(60, out[-20][1]), (None, words(rng, 50)), (None, base), (93, "Licensed under CC BY-NC 4.0. cc by")]
    out += [(94, "Released under the MIT License. Apache license, GNU General\nPublic License")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, "y") for d, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_repeats(rows, length=200):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + length] for _, b in raws for i in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        gone = np.cumsum(mark)[:len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            x = len(a & b)
            if a and b and 100 * x >= 80 * (len(a) + len(b) - x):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(s), (min(least[find(i)]) if least[find(i)] else None) if s else d)
            for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple((x is None, x) for x in r)


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def test_jaccard_sets_about_the_threshold(spark, monkeypatch):
    """Copies of one text with changed words: many a little under the threshold of each other."""
    rng = random.Random(5)
    base = words(rng, 120).split()
    rows = []
    for i in range(260):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.choice([1, 2, 2, 3, 3])):
            own[at] = rng.choice(["alpha", "beta", f"w{i}"])
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "BLOCK_ENTRIES", 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert 1 < len({w[2] for w in want}) < 260
    same(jaccard.join_documents(docs), want)
    # no link but those of open units
    monkeypatch.setattr(jaccard, "star_links", lambda sets: spark.createDataFrame([], "u long, v long"))
    same(jaccard.join_documents(docs), want)


def test_jaccard_small_sets_without_stars(spark, monkeypatch):
    """All small sizes and overlaps of two sets that link, by the bounds alone."""
    rows = []
    word = iter(range(10**9))
    for n in range(1, 17):
        for m in range(n, 21):
            for common in range(1, n + 1):
                if common * 100 >= 80 * (n + m - common):
                    for _ in range(4 if m < 8 else 2):
                        core = [f"w{next(word)}" for _ in range(common + 4)]
                        rows.append(" ".join([f"w{next(word)}" for _ in range(n - common)] + core))
                        rows.append(" ".join(core + [f"w{next(word)}" for _ in range(m - common)]))
    rows = list(enumerate(rows))
    monkeypatch.setattr(jaccard, "star_links", lambda sets: spark.createDataFrame([], "u long, v long"))
    want = [(d, len(shingle_set(t)), d - d % 2) for d, t in rows]
    assert {w[1] for w in want} == set(range(1, 21)) and (4, 5) in {(a[1], b[1]) for a, b in zip(want[::2], want[1::2])}
    same(jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")), want)


@pytest.mark.parametrize("expand", [jaccard.EXPAND, 0])
def test_jaccard_repeated_rows_beside_partners_under_the_threshold(spark, monkeypatch, expand):
    """Rows with one id and text, or NULL ids and one text, beside sets of Jaccard 0.3 to 0.82."""
    rng = random.Random(8)
    rows = []
    for c in range(40):
        base = [f"c{c}w{i}" for i in range(64)]
        shared = rng.randrange(30, 58)
        d = None if c % 2 else 100 * c
        rows += [(d, " ".join(base))] * rng.choice([2, 3])
        rows += [(100 * c + 1, " ".join(base[:shared] + [f"c{c}v{i}" for i in range(64 - shared)]))] * rng.choice([1, 2])
        rows += [(100 * c + 2, " ".join(base[64 - shared:] + [f"c{c}u{i}" for i in range(64 - shared)]))]
    monkeypatch.setattr(jaccard, "EXPAND", expand)
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(jaccard.join_documents(docs), want)
    monkeypatch.setattr(jaccard, "star_links", lambda sets: spark.createDataFrame([], "u long, v long"))
    same(jaccard.join_documents(docs), want)


def test_jaccard_common_counts(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [[np.unique(rng.integers(0, 60, rng.integers(1, 30))) for _ in range(n)] for n in (9, 14)]
    a, b = ((np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s]), len(s)) for s in sets)
    want = [[len(np.intersect1d(x, y)) for y in sets[1]] for x in sets[0]]
    assert jaccard.common_counts(*a, *b).tolist() == want
    monkeypatch.setattr(jaccard, "EXPAND", 0)
    monkeypatch.setattr(jaccard, "PRODUCT_CELLS", 100)
    assert jaccard.common_counts(*a, *b).tolist() == want


@pytest.mark.parametrize("most", [jaccard.BROADCAST_ROWS, 0])
def test_jaccard_components(docs, rows, most):
    same(jaccard.join_documents(docs, broadcast_rows=most), brute_components(rows))


def test_jaccard_random_clusters(spark):
    rng = random.Random(11)
    rows = []
    for c in range(25):
        base = words(rng, rng.randrange(5, 60)).split()
        for _ in range(rng.randrange(1, 10)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "c%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    same(jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")), brute_components(rows))


@pytest.mark.parametrize("most", [repeats.BROADCAST_BYTES, -1])
def test_repeats(docs, rows, most):
    same(repeats.removed(docs, broadcast_bytes=most), brute_repeats(rows))


@pytest.mark.parametrize("line", [120, 230])
def test_repeats_of_a_line_that_many_texts_hold(spark, monkeypatch, line):
    """One anchor with a context of its own in every text: no sort of more than SHARD_BYTES."""
    rng = random.Random(line)
    held = "".join(rng.choice("abcdefgh ") for _ in range(line))
    noise = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    near = [noise(90) for _ in range(9)]
    rows = [(i, noise(rng.randrange(150)) + rng.choice(near) + held + rng.choice(near) + noise(rng.randrange(150)))
            for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300, held * 4), (301, noise(60) + held + noise(60) + held)]
    rows += [(400 + i, words(rng, 90)) for i in range(20)] + [(500, "x" * 900), (501, "x" * 1300)]
    whole = repeats.repeated

    def watched(strings, length):
        assert sum(map(len, strings)) <= 4000, "too much at a time"
        return whole(strings, length)

    monkeypatch.setattr(repeats, "SHARD_BYTES", 4000)
    monkeypatch.setattr(repeats, "FOLD_WINDOWS", 2000)
    monkeypatch.setattr(repeats, "repeated", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_repeats(rows)
    assert sum(w[2] > 0 for w in want) > 60
    same(repeats.removed(docs), want)


def test_suffix_order_and_spilling_queues():
    rng = random.Random(3)
    for it in range(40):
        strings = [bytes(rng.choices(b"ab" if it % 2 else b"abcd", k=rng.randint(1, 60))) for _ in range(9)]
        length = rng.randint(1, 12)
        text, begins = suffixes.shard_text(strings)
        got = np.concatenate(list(suffixes.suffix_order(text, 10**6, most=4))).tolist()
        plain = text.tolist()
        assert got == sorted(range(len(plain)), key=lambda i: plain[i:])
        seen = Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
        want = np.zeros(len(text), bool)
        for s, at in zip(strings, begins):
            for i in range(len(s) - length + 1):
                want[at + i] = seen[s[i:i + length]] > 1
        assert (suffixes.repeated(strings, length, most=8) == want).all()


def test_anchors_hold_every_window(rows):
    for _, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, first, end, _ = repeats.anchors(data, shingles.Powers())
        assert (end - first).sum() == max(0, len(data) - repeats.LENGTH + 1)


def test_mtree_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(400 + i, x[7]) for i in range(30)] + [(20, None), (440, None), (None, x[3]), (441, [1.0, None] * 4)]
    rows += [(442, [float("nan")] * 8), (443, [float("inf")] * 8), (460, [0.5] * 3), (480, [0.25] * 3)]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, score string")
    ok = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if i is not None and v is not None and all(
        c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-sum(s * t for s, t in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    data = mtree.integer_vectors(df, "vec_id", "embedding", 64)
    queries = data.where("vec_id % 20 = 0")
    same(mtree.top_k(data, queries, 20, tree_rows=64, query_block=8, page=16), want)
    assert mtree.search_embeddings(df.limit(0)).count() == 0


def test_mtree_prunes_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 50
    x = np.floor(64 * np.concatenate([c + rng.normal(size=(100, 16)) for c in centres]))
    tree = mtree.MTree(np.arange(len(x)), x, page=32)
    q = x[5]
    got = tree.search(q, -1, 5)
    score = x @ q
    want = sorted(((int(s), i) for i, s in enumerate(score)), key=lambda p: (-p[0], p[1]))[:5]
    assert got == want and tree.computed < len(x) / 2


def test_best_fit_keeps_capacity_and_bounds_bins():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(3000)]
    where, offset = pack.best_fit(sizes, 100, 8)
    places = defaultdict(list)
    for s, b, o in zip(sizes, where, offset):
        places[b].append((o, s))
    for p in places.values():
        at = 0
        for o, s in sorted(p):
            assert o == at
            at += s
        assert at <= 100
    assert len(places) < 1.1 * sum(sizes) / 100


def test_packing_round_trip(docs, rows):
    path = pack.tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    pieces = pack.tokenise(docs, path, capacity=64)
    placed = pack.place(pieces.drop("ids"), 64, 4)
    seqs = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in pack.sequences(
        pieces.where("doc_id is not null and doc_id <> 60"), placed).collect()}
    got = defaultdict(list)
    for r in placed.where("doc_id is not null and doc_id <> 60").orderBy("piece").collect():
        assert 1 <= r.length <= 64 and r.start == 64 * r.piece
        if r.sequence_id in seqs and len(seqs[r.sequence_id]) >= r.offset + r.length:
            got[r.doc_id] += seqs[r.sequence_id][r.offset:r.offset + r.length]
    want = {d: plain.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    lone = {r.sequence_id for r in placed.where("doc_id is null or doc_id = 60").collect()}
    whole = {r.doc_id for r in placed.collect()} - {r.doc_id for r in placed.collect() if r.sequence_id in lone}
    assert whole and all(got[d] == want[d] for d in whole)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in pack.pack_documents(docs, path).collect()}
    assert digests[(3, 0)] == zlib.crc32(np.array(want[3], "<u4").tobytes())


def test_word_ids_equal_the_tokenizer():
    path = pack.tokenizer_path("word_bpe_49k.json")
    own = pack.WordIds(path)
    rng = random.Random(1)
    chars = [*"abcXYZ éÉßΣσςİıñ½²Ⅷ'’.,!#_-0123\t\n\r\x1c\x85\xa0 漢字안ㅎé<|>̊", "<|endoftext|>", "'LL", " the"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["w" * 5000]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_sharding(docs, rows):
    got = shards.shard_documents(docs).collect()
    assert len(got) == len(rows)
    by_text, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    texts = {d: t for d, t in rows if d is not None}
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        if r.doc_id not in (None, 60):           # 60 names two texts
            assert r.size == len((texts[r.doc_id] or "").encode()) + 1
            assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
            by_text[texts[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(8))


def test_best_fit_decreasing_against_a_list():
    rng = random.Random(2)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 50) for _ in range(60)), reverse=True)
        got = shards.best_fit_decreasing(sizes, 60)
        free: list[int] = []
        for s, b in zip(sizes, got):
            fits = [f for f in free if f >= s]
            if fits:
                assert free[b] == min(fits)
                free[b] -= s
            else:
                assert b == len(free)
                free.append(60 - s)
        total = Counter()
        for s, b in zip(sizes, shards.near_equal(sizes, 5)):
            total[b] += s
        assert len(total) == 5 and max(total.values()) - min(total.values()) <= max(sizes)


def test_decontamination(spark, docs, rows):
    items = [(1, " ".join(rows[30][1].split()[3:20])), (2, "one TWO"), (10, None), (11, ""), (12, rows[20][1])]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    normal = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                                  re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for d, t in rows:
        w, hit, found = normal(t), set(), set()
        for i, it in items:
            v = normal(it)
            k = min(10, len(v))
            for j in range(len(v) - k + 1) if v else ():
                for a in range(len(w) - k + 1):
                    if w[a:a + k] == v[j:j + k]:
                        hit.update(range(a, a + k))
                        found.add(str(i))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    same(decontaminate.contamination(docs, bench), want)
    same(decontaminate.contamination(docs, bench, block_bytes=64), want)       # several blocks
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    text = "Ünder: One,  two!"
    assert decontaminate.word_offsets(text, [(1, 3)]) == [(8, 17)]


def test_licenses(docs, rows):
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for p, label in phrases for i in range(len(w)) if w[i:i + len(p)] == p]
        want.append((d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
                     ",".join(sorted({x for _, x in at}))))
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    by_id = {r.doc_id: r for r in got}
    assert by_id[93].labels == "cc-by,cc-by-nc" and by_id[93].score == 1.0 and by_id[3].score == 0.0


def test_license_notice_with_changed_words(spark):
    notice = licenses.NOTICES[0][0].split()
    notice[5:6] = ["brand", "new"]
    df = spark.createDataFrame([(1, "so " + " ".join(notice) + " end")], "doc_id long, text string")
    r = licenses.scan(df).first()
    assert r.labels == "mit" and r.n_base == 0 and 0.7 <= r.score < 1


def test_quality_needs_no_held_out_label(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, 40) if i % 3 else "### " * 30 + words(rng, 5)) for i in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), None) for i in range(300)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got.values())
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} >= set(out)
    assert sum(got[i].predicted == int(bool(i % 3)) for i in out) >= 0.95 * len(out)
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(out), 1 - F.col("quality")).otherwise(
        F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(df, flipped).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}


def test_url_aliases(spark):
    pages = [
        (1, "http://A.com/x", '<link rel="canonical" href="https://b.com/de/1">'),
        (2, "https://b.com/de/1", ""), (3, "http://c.net/y", "<LINK href=/z rel=canonical>"), (4, "http://c.net/z#f", None),
        (5, None, None), (6, "no scheme", ""), (7, "http://d.net/", '<meta http-equiv="Refresh" content="0; URL=//e.org/">'),
        (8, "http://d.net", "<link rel='canonical' href='http://b.com/de/9'>"), (9, "https://x.example.org/en/1?q", ""),
        (10, "http://org/", ""), (11, "http://evilexample.org.net/es/", ""),
    ]
    df = spark.createDataFrame([(i, u, h, "r") for i, u, h in pages], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_pages(df).collect()}
    assert got[1] == ("a.com", "/x", None, "block") and got[2] == ("b.com", "/de/1", "com/de/", "block")
    assert got[3][3] == got[4][3] == "allow" and got[5] == ("", "", None, "allow") == got[6]
    assert got[7] == ("d.net", "/", None, "allow")                       # an explicit allow outweighs a block
    assert got[9] == ("x.example.org", "/en/1", "example.org/en/1", "block") and got[10][2] == "org/"
    assert got[11][2] is None
    assert urls.filter_pages(df.limit(0)).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}


def test_html_extraction(spark):
    page = ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li>Home<li>Menu</ul></nav>"
            "<div class='cookie-notice'>We use cookies</div><%s><h1>Head %d</h1><p>First <b>bold &amp; &eacute;  x<p>Second"
            "<div class=ad>Buy</div><!-- c --><div id='comments'><p>reader</p></div></%s><footer>F</footer>")
    rows = [(i, "http://h%d.com/" % (i % 2), page % (("article", i, "article") if i % 2 else ("div class='post'", i, "div")))
            for i in range(12)]
    rows += [(50, None, None), (51, "http://h1.com/", ""), (52, "http://h9.com", "<p>just < text"), (53, "x", "<article>" * 500 + "deep")]
    df = spark.createDataFrame([(i, u, h, "t") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in wrappers.extract_pages(df).collect()}
    for i in range(12):
        assert got[i] == f"Head {i}\nFirst bold & é x\nSecond", got[i]
    assert got[50] == got[51] == "" and got[52] == "just < text" and got[53] == "deep"


def test_html_constant_texts(spark):
    """Texts with one beginning differ, copies are one page, and a page of constants keeps them."""
    preface = "the same preface " * 20
    rows = [(i, "http://a.com/%d" % i, f"<body><pre>{preface}part {i}</pre></body>") for i in range(4)]
    copy = "<body><div><h2>Head</h2><p>Only paragraph, the same on every mirror of it</p></div></body>"
    rows += [(10 + i, "http://b.com/?utm=%d" % i, copy) for i in range(5)]
    rows += [(20 + i, "http://c.com/%d" % i, f"<body><div>{preface}</div><p>{'x' * i}</p></body>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract_pages(df).collect()}
    assert all(got[i] == f"{preface}part {i}" for i in range(4))
    assert all(got[10 + i] == "Head\nOnly paragraph, the same on every mirror of it" for i in range(5))
    assert got[20] == preface.strip() and [got[20 + i] for i in (1, 2, 3)] == ["x", "xx", "xxx"]


def test_html_names_of_boilerplate_around_the_main_text(spark):
    side = "<div class='sidebar'><div class='widget-content'>Side</div></div>"
    talk = "<div id='comments'><article class='comment'>one</article><article class='comment'>two</article></div>"
    body = "<h1>Head %d</h1><p>Text %d</p>"
    hosts = {
        "wrap": "<div class='content-sidebar-wrap'><main class='content'><article>" + body + "</article></main>" + side + "</div>",
        "ids": "<div id='header-footer-wrap'><nav>Menu</nav><article>" + body + "</article>" + side + "</div>",
        "main": "<main class='has-sidebar'>" + body + side + "</main>",
        "open": "<main><article class='post comments-open'>" + body + talk + "</article></main>" + side,
        "entry": "<p>Site</p><div class='content-sidebar-wrap'><div class='entry'>" + body + "</div>" + side + "</div>",
        "only": "<div class='post comments-open'>" + body + "</div>",
        "plain": "<div>" + body + "</div>" + side + "<div class='cookie-notice'><div class='content'>Cookies</div></div>",
        "post": "<div class='post'>" + body + "</div>" + talk,
        "title": "<div class='content-info'>Info</div><div class='content-sidebar-wrap'><article>" + body + "</article></div>",
    }
    rows = [(10 * h + i, f"http://{name}.com/{i}", "<body>" + page % (i, i) + "</body>")
            for h, (name, page) in enumerate(hosts.items()) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.url, r.text) for r in wrappers.extract_pages(df).collect()}
    for h in range(len(hosts)):
        for i in range(4):
            assert got[10 * h + i][1] == f"Head {i}\nText {i}", got[10 * h + i]


def test_wrapper_alignment():
    a = wrappers.expression("<body><ul><li>1<li>2</ul><p>x</p></body>")
    b = wrappers.expression("<body><ul><li>1</ul><div>new</div><p>y</p></body>")
    body = wrappers.merge(a, b)[2][0]
    assert [(c[0], c[1]) for c in body[2]] == [("ul", ""), ("div", "?"), ("p", "")]
    assert body[2][0][2][0][1] == "+" and body[2][2][2][0][2] is None


def test_stages_keep_columns_and_rows(spark, docs, rows, none):
    left = stages.one_of_each(docs)
    assert left.columns == docs.columns
    want = {c for d, _, c in brute_components(rows) if d is not None and d == c}
    assert {r.doc_id for r in left.where("doc_id is not null").collect()} == want
    cut = stages.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    clean = stages.uncontaminated(docs, bench)
    assert clean.columns == docs.columns and {3, 4}.isdisjoint(r.doc_id for r in clean.collect())


def test_no_rows(spark, none):
    path = pack.tokenizer_path("word_bpe_49k.json")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert pack.pack_documents(none, path).count() == 0
    assert shards.shard_documents(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert jaccard.join_documents(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert repeats.dedup_documents(none).count() == 0
    assert wrappers.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(none, labels).count() == 0


def test_word_ids_are_bounded(monkeypatch):
    """A full cache keeps what the texts at hand use of it, the tokenizer sees few chunks at a time, ids are its own."""
    monkeypatch.setattr(pack, "CACHED_WORDS", 300)
    monkeypatch.setattr(pack, "BATCH_CHUNKS", 128)
    own = pack.WordIds(pack.tokenizer_path("word_bpe_49k.json"))
    whole, sizes = own.whole, []

    class Counting:
        def encode_batch(self, texts, **more):
            sizes.append(len(texts))
            return whole.encode_batch(texts, **more)

    own.whole = Counting()
    rng, seen = random.Random(3), []
    for part in range(6):
        texts = ["often, seen " + " ".join("w%dx, Été%d" % (rng.randrange(9000), part) for _ in range(200))
                 for _ in range(3)]
        if part:
            assert "often," in own.chunks
        seen.append(own.chunks.get("often,"))
        got = own.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [
            whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.chunks) <= 300 + 2 * 3 * 400
    assert max(sizes) <= 128
    assert all(x is seen[1] for x in seen[1:])           # never learned again


def test_words_that_recur_are_not_learned_again(monkeypatch):
    """A word that comes in every second group outlasts a full cache, Python sees a group's distinct chunks once, and
    ids stay the tokenizer's, for words with and without marks and in texts that are not lower-cased."""
    monkeypatch.setattr(pack, "CACHED_WORDS", 500)
    own = pack.WordIds(pack.tokenizer_path("word_bpe_49k.json"))
    learned, seen = Counter(), []
    learn, known = own._learn, own._known

    def counting(chunks, *more):
        learned.update(chunks)
        return learn(chunks, *more)

    own._learn = counting
    own._known = lambda chunks: seen.append(len(chunks)) or known(chunks)
    rng = random.Random(7)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
    recur = [["often", "seen,", "\u00dcber!", "\u0130st"], ["second", "group.", "caf\u00e9;", "A\u030a"]]
    for part in range(12):
        words = recur[part % 2] * 40 + fresh(200)
        texts = [" ".join(rng.sample(words, len(words))), "", "\n".join(words), "w" * 300 + ", \u6f22 " + " ".join(words[-9:])]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [
            own.whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert seen[-1] < 2 * 200 + 40                       # of more than 700 occurrences
    assert own.encode([]) == [] and own.encode(["", ""]) == [b"", b""]
    assert all(n == 1 for c, n in learned.items() if len(c) <= pack.CACHED_CHARS), learned.most_common(5)
    assert len(own.chunks) + len(own.old) < 2 * (500 + 500)


def test_jaccard_scratch_is_narrow(spark, docs, rows, monkeypatch):
    """A set's shingles are written when found, when shared and in blocks, not once more for each look-up."""
    wide = []

    def noted(df, name, written=jaccard.written):
        if any(f in df.columns for f in ("tokens", "m")):
            wide.append(name)
        return written(df, name)

    monkeypatch.setattr(jaccard, "written", noted)
    monkeypatch.setattr(jaccard, "BLOCK_ENTRIES", 256)   # units of several blocks
    got = sorted(map(tuple, jaccard.join_documents(docs).collect()), key=repr)
    assert got == sorted(brute_components(rows), key=repr)
    assert set(wide) <= {"tokens", "sets-once", "paired", "able", "blocks"}


def test_stages_take_small_batches(spark, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        stages.packed(docs)
        assert spark.conf.get(key) == "4m"
        spark.conf.set(key, "1m")
        stages.packed(docs)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_stages_read_few_rows_at_a_time(spark, docs):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        stages.packed(docs)
        assert spark.conf.get(key) == "256"
        spark.conf.set(key, "100")
        stages.packed(docs)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)


def test_packing_stage_leaves_no_words_to_workers(spark, docs, tmp_path, monkeypatch):
    """The stage's rows are the operator's, however little is encoded and cached, and no worker keeps its caches."""
    path = str(tmp_path / "own.json")
    shutil.copy(pack.tokenizer_path("word_bpe_49k.json"), path)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = docs.repartition(8)
    want = sorted(map(tuple, pack.pack_documents(dealt, pack.tokenizer_path("word_bpe_49k.json")).select(cols).collect()), key=repr)
    monkeypatch.setattr(pack, "LEAN_WORDS", 50)
    monkeypatch.setattr(pack, "LEAN_CHARS", 300)
    got = sorted(map(tuple, stages.packed(dealt, path).select(cols).collect()), key=repr)
    assert got == want and len(got) >= docs.count()

    def kept(batches):
        from tessera.llm import pack as own

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([path in own._KEPT] * len(b))], names=["kept"])

    found = spark.range(0, 64, 1, 32).mapInArrow(kept, "kept boolean").collect()
    assert len(found) == 64 and not any(r.kept for r in found)
