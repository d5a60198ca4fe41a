"""Pre-tokenisation, vocabulary, encode/decode and NFC (ops 25-30)."""

import regex
from pyspark.sql import functions as F

from tessera.functions.fixed import FULL_PRETOKEN_PATTERN, PORTABLE_PRETOKEN_PATTERN
from tessera.operators.tokens import decode_ids, encode_tokens, normalise_nfc, pretokenise, vocab_table

ADVERSARIAL = [
    "", "hello world", "a\u0085b", "x  y", "東京　タワー", "zero​width", "line sep", "ctl\x1cchar",
    "it's IT'S ſ'S don'K", "crlf\r\n\r\n\r\nend", "trailing spaces   ", "digits ٣٤ १२ 42", "  lead",
    "tabs\t\tand\x0bvt", "punct!!! ?? ...\n\n", "emoji 😀👍🏽 ok", "mixé Ünïcödé",
]


def test_full_profile_matches_python_regex(spark):
    pat = regex.compile(FULL_PRETOKEN_PATTERN)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ADVERSARIAL)], "pos bigint, text string")
    got = {r.pos: list(r.tokens) for r in pretokenise(df, profile="full").collect()}
    for i, s in enumerate(ADVERSARIAL):
        assert got[i] == pat.findall(s), (i, s)


def test_full_profile_on_documents(spark):
    from tests.conftest import SF001

    pat = regex.compile(FULL_PRETOKEN_PATTERN)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(F.col("doc_id").alias("pos"), "text")
    rows = pretokenise(docs, profile="full").collect()
    bad = [r.pos for r in rows if list(r.tokens) != pat.findall(r.text)]
    assert not bad


def test_portable_profile_and_markers(spark):
    df = spark.createDataFrame([(0, "<|im_start|>user\nHi, 42!<|im_end|>")], "pos bigint, text string")
    t = pretokenise(df, markers=True).first().tokens
    assert t == ["<|im_start|>", "user", "Hi", ",", "4", "2", "!", "<|im_end|>"]
    t2 = pretokenise(df).first().tokens
    assert t2[:3] == ["<|", "im", "_"]
    pat = regex.compile(PORTABLE_PRETOKEN_PATTERN)
    assert pat.findall("Hi, 42!") == ["Hi", ",", "4", "2", "!"]


def test_vocab_encode_decode(spark):
    df = spark.createDataFrame([(0, "b a b"), (1, "c b"), (2, "")], "pos bigint, text string")
    toks = pretokenise(df)
    vocab = vocab_table(toks)
    assert [(r.token, r.id, r["count"]) for r in vocab.orderBy("id").collect()] == [("b", 0, 3), ("a", 1, 1), ("c", 2, 1)]
    enc = {r.pos: list(r.input_ids) for r in encode_tokens(toks, ["pos"], vocab).collect()}
    assert enc == {0: [0, 1, 0], 1: [2, 0], 2: []}
    dec = {r.pos: r.text for r in decode_ids(encode_tokens(toks, ["pos"], vocab), ["pos"], vocab, sep=" ").collect()}
    assert dec == {0: "b a b", 1: "c b", 2: ""}


def test_unknown_token_policy(spark):
    df = spark.createDataFrame([(0, "x y")], "pos bigint, text string")
    toks = pretokenise(df)
    vocab = spark.createDataFrame([("x", 0, 1)], "token string, id int, count bigint")
    assert encode_tokens(toks, ["pos"], vocab, unk_id=99).first().input_ids == [0, 99]
    import pytest

    with pytest.raises(Exception, match="not in vocabulary"):
        encode_tokens(toks, ["pos"], vocab).collect()


def test_nfc(spark):
    import unicodedata

    raw = ["café", "plain", "Å", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(raw)], "pos bigint, text string")
    got = {r.pos: r.text for r in normalise_nfc(df).collect()}
    assert got == {i: (None if s is None else unicodedata.normalize("NFC", s)) for i, s in enumerate(raw)}


def test_large_vocabulary_hot_cold_split(spark, monkeypatch):
    """Above the broadcast bound the lookup splits hot and cold keys; results are unchanged."""
    import tessera.operators.tokens as tk

    rows = [(i, " ".join(["the"] * 50 + [f"w{i}", f"w{i % 7}", "a"])) for i in range(40)]
    df = spark.createDataFrame(rows, "pos bigint, text string")
    toks = pretokenise(df)
    vocab = vocab_table(toks)
    small = {r.pos: list(r.input_ids) for r in encode_tokens(toks, ["pos"], vocab).collect()}
    small_dec = {r.pos: r.text for r in decode_ids(encode_tokens(toks, ["pos"], vocab), ["pos"], vocab, sep=" ").collect()}
    monkeypatch.setattr(tk, "BROADCAST_VOCAB_ROWS", 5)
    monkeypatch.setattr(tk, "HOT_ROWS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        big = encode_tokens(toks, ["pos"], vocab)
        plan = big._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert {r.pos: list(r.input_ids) for r in big.collect()} == small
        dec = {r.pos: r.text for r in decode_ids(big, ["pos"], vocab, sep=" ").collect()}
        assert dec == small_dec
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_nfc_unstable_class_is_sufficient(spark):
    """Strings the JVM-side check lets through unchanged must already be NFC."""
    import random
    import unicodedata

    from tessera.operators.tokens import nfc_column

    rng = random.Random(0)
    pools = [(0x20, 0x250), (0x300, 0x370), (0xAC00, 0xAC10), (0x1100, 0x11FF), (0x0900, 0x0980), (0x3040, 0x30FF),
             (0x1F000, 0x1F700), (0x2100, 0x2140), (0xF900, 0xF910), (0x0FB0, 0x0FC0)]
    strings = ["".join(chr(rng.randrange(*rng.choice(pools))) for _ in range(rng.randrange(1, 6))) for _ in range(20000)]
    strings += ["é", "Å", "가", "각", "ą́", "café ok"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(strings)], "i int, t string")
    for engine in ("jvm", "python"):
        got = {r.i: r.n for r in df.select("i", nfc_column("t", engine).alias("n")).collect()}
        assert all(got[i] == unicodedata.normalize("NFC", x) for i, x in enumerate(strings)), engine


def test_encoding_by_bucket_equals_the_broadcast_join(spark, monkeypatch):
    """Above the broadcast bound distinct pre-tokens of buckets meet the vocabulary; ids, flags, order, empty and
    NULL arrays come out as below it."""
    import pytest

    import tessera.operators.tokens as tk

    rows = [(i, i % 3, ["the"] * (i % 50) + [f"w{i}", f"w{i % 7}", "a"]) for i in range(90)]
    rows += [(90, 0, []), (91, 1, None), (92, 2, ["the"] * 3000)]
    df = spark.createDataFrame(rows, "pos bigint, k int, tokens array<string>").repartition(4)
    df = df.withColumn("sup", F.transform("tokens", lambda t: t == "the"))
    vocab = vocab_table(df)
    below = {(r.pos, r.k): (r.input_ids, r.sup) for r in encode_tokens(df, ["pos", "k"], vocab, flags_col="sup").collect()}
    monkeypatch.setattr(tk, "BROADCAST_VOCAB_ROWS", 5)
    for tokens in (10 ** 6, 400):
        monkeypatch.setattr(tk, "BUCKET_TOKENS", tokens)
        got = encode_tokens(df, ["pos", "k"], vocab, flags_col="sup")
        assert {(r.pos, r.k): (r.input_ids, r.sup or []) for r in got.collect()} == below
        plain = encode_tokens(df.select("pos", "tokens"), ["pos"], vocab, out="ids")
        assert {r.pos: r.ids for r in plain.collect()} == {p: ids for (p, _), (ids, _) in below.items()}
    some = vocab.where("token <> 'a'")
    assert {i for r in encode_tokens(df, ["pos", "k"], some, unk_id=-7).collect() for i in r.input_ids} >= {-7}
    with pytest.raises(Exception, match="not in vocabulary"):
        encode_tokens(df, ["pos", "k"], some).collect()
    assert encode_tokens(df.where("pos < 0"), ["pos", "k"], vocab).collect() == []


def test_pairs_encoded_by_bucket_equal_the_broadcast_join(spark, monkeypatch):
    """Flags that cannot be NULL (both sides of preference pairs) pass through buckets as well."""
    import tessera.operators.codec as codec
    import tessera.operators.tokens as tk
    from tessera.plans.tasks import build_reward

    rows = [(i, f"why {i}", f"since {i % 7} it is", None if i == 3 else f"no {i % 5}") for i in range(40)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, question string, response_chosen string, response_rejected string")
    collect = lambda: sorted(tuple(r) for r in build_reward(pairs)[0].collect())
    below = collect()
    assert len(below) == 40
    for module in (tk, codec):
        monkeypatch.setattr(module, "BROADCAST_VOCAB_ROWS", 5)
    assert collect() == below


def test_decoding_by_bucket_equals_the_broadcast_join(spark, monkeypatch):
    """Above the broadcast bound distinct ids of buckets meet the vocabulary, no id is exploded."""
    import tessera.operators.tokens as tk

    words = [(f"w{i}é", i, 9) for i in range(60)]
    vocab = spark.createDataFrame(words, "token string, id int, count bigint")
    rows = [(i, [(i * k) % 61 for k in range(i % 40)]) for i in range(90)] + [(90, None), (91, []), (92, [5, None, 70, 5])]
    df = spark.createDataFrame(rows, "pos bigint, input_ids array<int>").repartition(3)
    texts = lambda sep: {r.pos: r.text for r in decode_ids(df, ["pos"], vocab, sep=sep).collect()}
    below = {sep: texts(sep) for sep in ("", " ")}
    monkeypatch.setattr(tk, "BROADCAST_VOCAB_ROWS", 5)
    monkeypatch.setattr(tk, "HOT_ROWS", 20)
    for tokens in (10 ** 6, 100):
        monkeypatch.setattr(tk, "BUCKET_TOKENS", tokens)
        assert {sep: texts(sep) for sep in ("", " ")} == below
    plan = decode_ids(df, ["pos"], vocab)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(input_ids" not in plan and "FlatMapCoGroupsInArrow" in plan
