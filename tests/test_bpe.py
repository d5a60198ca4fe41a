"""Byte-level BPE dictionary job (op 28) and byte decoding (op 29)."""

import random

import regex

from tessera.functions.fixed import FULL_PRETOKEN_PATTERN
from tessera.operators.bpe import byte_alphabet, decode_bytes, encode_bpe
from tessera.operators.tokens import pretokenise
from tessera.sources.tables import bpe_tables, word_counts


def spec_bpe(word, ranks):
    """Textbook greedy BPE, written independently: lowest-rank bigram first,
    all non-overlapping occurrences left to right."""
    parts = list(word)
    while True:
        cands = [(ranks[(a, b)], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in ranks]
        if not cands:
            return parts
        r = min(cands)[0]
        a, b = [p for p, q in ranks.items() if q == r][0]
        k, out = 0, []
        while k < len(parts):
            if k < len(parts) - 1 and (parts[k], parts[k + 1]) == (a, b):
                out.append(a + b)
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


def test_byte_alphabet_is_a_bijection():
    a = byte_alphabet()
    assert len(set(a.values())) == 256 and a[ord("A")] == "A" and a[32] == chr(288) and a[0] == chr(256)


TEXTS = ["hello hello world", "aaaa aaa", "", "Grüße, 東京! 😀", "it's   spaced\n\nout", "<|im_end|>tail"]


def test_encode_bpe_matches_spec_and_roundtrips(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "pos bigint, text string")
    toks = pretokenise(df, profile="full", markers=True)
    merges, vocab = bpe_tables(word_counts(toks), 40)
    ranks = {(r.left, r.right): r.rank for r in merges.collect()}
    ids = {r.token: r.id for r in vocab.collect()}
    got = {r.pos: list(r.input_ids) for r in encode_bpe(toks, ["pos"], merges, vocab).collect()}
    alpha = byte_alphabet()
    pat = regex.compile("<\\|im_end\\|>|" + FULL_PRETOKEN_PATTERN)
    for i, t in enumerate(TEXTS):
        expect = []
        for tok in pat.findall(t):
            if tok == "<|im_end|>":
                expect.append(ids[tok])
                continue
            expect += [ids[p] for p in spec_bpe("".join(alpha[b] for b in tok.encode()), ranks)]
        assert got[i] == expect, t
    enc = encode_bpe(toks, ["pos"], merges, vocab)
    back = {r.pos: r.text for r in decode_bytes(enc, ["pos"], vocab).collect()}
    assert back == dict(enumerate(TEXTS))


def test_decode_invalid_bytes_with_replacement(spark):
    alpha = byte_alphabet()
    vocab = spark.createDataFrame([(alpha[b], b) for b in range(256)], "token string, id int")
    rng = random.Random(11)
    seqs = [[rng.randrange(256) for _ in range(rng.randrange(0, 9))] for _ in range(200)]
    seqs += [[0xED, 0xA0, 0x80], [0xF0, 0x9F, 0x98], [0xC0, 0xAF], [0x61, 0xFF, 0x62]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "pos bigint, input_ids array<int>")
    got = {r.pos: r.text for r in decode_bytes(df, ["pos"], vocab).collect()}
    for i, s in enumerate(seqs):
        assert got[i] == bytes(s).decode("utf-8", errors="replace")


def test_decode_bytes_exchanges_nothing(spark):
    """Rows become texts where they are, whatever their number of ids; unknown ids and NULL arrays give nothing."""
    alpha = byte_alphabet()
    vocab = spark.createDataFrame([(alpha[b], b) for b in range(256)] + [("<|im_end|>", 300)], "token string, id int")
    rows = [(0, [104, 105, 300, 999]), (1, None), (2, []), (3, [0xC3, 0xA9])]
    dec = decode_bytes(spark.createDataFrame(rows, "pos bigint, input_ids array<int>"), ["pos"], vocab)
    assert {r.pos: r.text for r in dec.collect()} == {0: "hi<|im_end|>", 1: "", 2: "", 3: "é"}
    assert "Exchange" not in dec._jdf.queryExecution().executedPlan().toString()


def test_batches_are_encoded_and_decoded_in_bounded_slices(monkeypatch):
    import pyarrow as pa

    import tessera.operators.bpe as bpe

    rows = [["ab", "a"], None, [], ["b"] * 9, ["ab"], ["a", "b", "ab"]]
    ids = {"a": [1], "b": [2], "ab": [1, 2]}
    monkeypatch.setattr(bpe, "BATCH_ITEMS", 4)
    tokens = pa.array(rows, pa.list_(pa.string()))
    seen = list(bpe.in_slices(tokens.slice(1)))
    assert [len(x.flatten()) for x in seen] == [0, 9, 4] and sum(map(len, seen)) == 5
    parts = [bpe.encode_lists(x, ids.__getitem__) for x in bpe.in_slices(tokens)]
    assert [r for p in parts for r in p[0].to_pylist()] == [sum([ids[w] for w in row or []], []) for row in rows]
    assert [r for p in parts for r in p[1].to_pylist()] == [[len(ids[w]) for w in row or []] for row in rows]
    lists = pa.array([[1, 2, 7], None, [3, 3], [], [None, 4]], pa.list_(pa.int32()))
    pieces = {1: b"x", 2: "é".encode(), 3: b"\xff", 4: b"y"}
    texts = [t for x in bpe.in_slices(lists) for t in bpe.decode_lists(x, pieces).to_pylist()]
    assert texts == ["xé", "", "\ufffd\ufffd", "", "y"]


def test_symbols_column_equals_the_alphabet(spark):
    from tessera.operators.bpe import symbols_column, to_symbols

    words = [chr(i) for i in range(0x250)] + [" the", "\n\n", "Grüße", "東京", "😀x", "a\u0000b", "$1", "\\"]
    df = spark.createDataFrame([(w,) for w in words], "token string").select("token", symbols_column("token").alias("s"))
    alphabet = byte_alphabet()
    assert {r.token: r.s for r in df.collect()} == {w: to_symbols(w, alphabet) for w in words}


def test_pairs_of_the_fixture_are_counted_once(spark):
    words = spark.createDataFrame([("aba", 3), ("ab", 2)], "token string, c bigint")
    merges, vocab = bpe_tables(words, 2)
    assert [(r.left, r.right) for r in merges.orderBy("rank").collect()] == [("a", "b"), ("b", "a")]
    for table in (merges, vocab):            # both read the counted pairs back
        assert "explode" not in table._jdf.queryExecution().executedPlan().toString()
