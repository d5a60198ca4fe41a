"""One tokeniser for all tasks: merging, tokeniser files, markers, flags (ops 26-32)."""

import json
import os
import random
import tempfile
import time

import pytest
import regex

from tessera.functions.fixed import FULL_PRETOKEN_PATTERN
from tessera.operators.bpe import apply_merges, byte_alphabet, to_symbols
from tessera.operators.codec import ByteLevelCodec, PortableCodec, codec_for, read_tokenizer, read_tokenizer_json
from tessera.plans import tasks
from tests.test_bpe import spec_bpe

MARKERS = ["<|endoftext|>", "<|im_start|>", "<|im_end|>"]


def random_table(rng, alphabet, n):
    symbols, ranks = list(alphabet), {}
    for _ in range(n):
        pair = (rng.choice(symbols), rng.choice(symbols))
        if pair not in ranks:
            ranks[pair] = len(ranks)
            symbols.append(pair[0] + pair[1])
    return ranks


@pytest.mark.parametrize("short", [0, 48])
def test_heap_and_list_merging_equal_whole_passes(monkeypatch, short):
    from tessera.operators import bpe

    monkeypatch.setattr(bpe, "SHORT_WORD", short)
    rng = random.Random(3)
    for trial in range(3000):
        alphabet = "abc"[:rng.randrange(1, 4)]
        ranks = random_table(rng, alphabet, rng.randrange(14))
        if trial % 2:                               # ranks out of order: a merged pair may outrank its parts
            values = list(ranks.values())
            rng.shuffle(values)
            ranks = dict(zip(ranks, values))
        word = [rng.choice(alphabet) for _ in range(rng.randrange(30))]
        assert apply_merges(word, ranks) == spec_bpe(word, ranks), (word, ranks)


def test_a_pretoken_of_a_megabyte_takes_seconds():
    rng = random.Random(4)
    ranks = random_table(rng, "abcdefgh", 400)
    long = [rng.choice("abcdefgh") for _ in range(1_000_000)]
    t0 = time.time()
    got = apply_merges(long, ranks)
    assert time.time() - t0 < 60 and "".join(got) == "".join(long)
    assert not any((a, b) in ranks for a, b in zip(got, got[1:]))      # nothing is left to merge
    assert apply_merges(["a"] * 500_001, {("a", "a"): 0}) == ["aa"] * 250_000 + ["a"]


def test_public_tokenizer_gives_the_same_pieces():
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ranks = {tuple(p) if isinstance(p, list) else tuple(p.split(" ")): i for i, p in enumerate(model["merges"])}
    reference = tokenizers.Tokenizer.from_file(path)
    rng, alphabet = random.Random(5), byte_alphabet()
    words = ["internationalisation", "Grüße", "東京都", "aaaaaaaaaaaaa", "x" * 3000]
    words += ["".join(rng.choices("etaoinshrdluéß", k=rng.randrange(1, 40))) for _ in range(500)]
    for w in words:
        pieces = apply_merges(to_symbols(w, alphabet), ranks)
        assert [model["vocab"][p] for p in pieces] == reference.encode(w, add_special_tokens=False).ids, w


TEXTS = ["hello hello world", "aaaa aaa", "", "Grüße, 東京! 😀", "it's   spaced\n\n out", "a<|im_end|>tail<|endoftext|>",
         "<|im_start|>", "not <|a marker|> but <|endoftext|", None, "nul\0 <|im_end|>\0<|im_start|> x\0", "\0", "x  <|im_end|>  y", "line\r\n\r\n  end  "]


def files(ranks, extra=(), header="#version: 0.2\n"):
    root = tempfile.mkdtemp(prefix="tessera-codec-", dir="/tmp")
    alphabet = byte_alphabet()
    vocab = {alphabet[b]: b for b in range(256)}
    for a, b in ranks:
        vocab.setdefault(a + b, len(vocab))
    vocab |= dict(extra)
    with open(os.path.join(root, "vocab.json"), "w", encoding="utf-8") as f:
        json.dump(vocab, f, ensure_ascii=False)
    with open(os.path.join(root, "merges.txt"), "w", encoding="utf-8") as f:
        f.write(header + "\n".join(f"{a} {b}" for a, b in ranks) + "\n\n")
    return root, vocab


def learned_ranks():
    alphabet = byte_alphabet()
    chars = [alphabet[b] for b in " helowrdGüßae東京🙂".encode()] + [alphabet[32]]
    return random_table(random.Random(8), sorted(set(chars)), 120)


def spec_ids(text, ranks, vocab):
    """Markers whole, then the pattern, then the textbook loop."""
    import unicodedata

    out, alphabet = [], byte_alphabet()
    for part in regex.split("(" + "|".join(regex.escape(m) for m in MARKERS) + ")", unicodedata.normalize("NFC", text)):
        if part in MARKERS:
            out.append(vocab[part])
            continue
        for token in regex.findall(FULL_PRETOKEN_PATTERN, part):
            out += [vocab[p] for p in spec_bpe([alphabet[b] for b in token.encode()], ranks)]
    return out


def test_tokenizer_files_are_read_and_texts_encoded_like_the_textbook(spark):
    ranks = learned_ranks()
    root, vocab = files(ranks)
    codec = read_tokenizer(spark, f"{root}/vocab.json", f"{root}/merges.txt")
    assert {(r.left, r.right): r.rank for r in codec.merges.collect()} == ranks
    held = {r.token: r.id for r in codec.vocab.collect()}
    # markers that the file does not have come after its largest id
    assert held == vocab | {m: max(vocab.values()) + 1 + i for i, m in enumerate(MARKERS)}
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "pos bigint, text string").repartition(3)
    ids, _ = tasks.tokenise_pretrain(docs, codec=codec)
    got = {r.pos: r.input_ids for r in ids.collect()}
    assert got == {i: spec_ids(t, ranks, held) if t is not None else [] for i, t in enumerate(TEXTS)}
    back = {r.pos: r.text for r in codec.decode(ids, ["pos"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    packed = tasks.build_pretrain(docs, 10**9, 10**6, 1, codec=codec)
    assert packed.first().input_ids == [x for i in range(len(TEXTS)) for x in got[i]]


def test_one_file_with_pairs_or_lines(spark):
    ranks = learned_ranks()
    root, vocab = files(ranks)
    added = [{"content": "<|endoftext|>", "id": 9000, "special": True}]
    for name, merges in (("pairs", [list(p) for p in ranks]), ("lines", [" ".join(p) for p in ranks])):
        path = os.path.join(root, f"{name}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "added_tokens": added}, f)
        codec = read_tokenizer_json(spark, path)
        assert {(r.left, r.right): r.rank for r in codec.merges.collect()} == ranks
        held = {r.token: r.id for r in codec.vocab.collect()}
        assert [held[m] for m in MARKERS] == [9000, 9001, 9002]


def test_tokenizer_files_that_are_broken(spark):
    root, vocab = files({("a", "b"): 0, ("c", "d"): 1, ("e", "f"): 2}, header="")
    with open(os.path.join(root, "merges.txt"), "a") as f:
        f.write("a b\n")                                  # a pair that is there again: its last place holds
    codec = read_tokenizer(spark, f"{root}/vocab.json", f"{root}/merges.txt")
    assert {(r.left, r.right): r.rank for r in codec.merges.collect()} == {("a", "b"): 3, ("c", "d"): 1, ("e", "f"): 2}
    with open(os.path.join(root, "merges.txt"), "a") as f:
        f.write("three are many\n")
    with pytest.raises(Exception, match="not a pair"):
        read_tokenizer(spark, f"{root}/vocab.json", f"{root}/merges.txt")
    root, _ = files({("a", "b"): 0})
    with open(os.path.join(root, "vocab.json"), "w") as f:
        f.write("[1, 2]")
    with pytest.raises(Exception, match="not a JSON object"):
        read_tokenizer(spark, f"{root}/vocab.json", f"{root}/merges.txt")
    twice = spark.createDataFrame([("a", 0), ("b", 0)], "token string, id int")
    with pytest.raises(ValueError, match="several tokens"):
        ByteLevelCodec.load(codec.merges, twice)
    with pytest.raises(ValueError, match="either"):
        codec_for(codec, vocab=twice)


def test_unknown_pieces_fail_or_take_the_unknown_id(spark):
    docs = spark.createDataFrame([(0, "ab?")], "pos bigint, text string")
    merges = spark.createDataFrame([("a", "b", 0)], "left string, right string, rank int")
    vocab = spark.createDataFrame([("ab", 5)], "token string, id int")
    with pytest.raises(Exception, match="not in the vocabulary"):
        tasks.tokenise_pretrain(docs, codec=ByteLevelCodec.load(merges, vocab))[0].collect()
    got = tasks.tokenise_pretrain(docs, codec=ByteLevelCodec.load(merges, vocab, unk_id=1))[0].first().input_ids
    assert got == [5, 1]


def test_markers_stay_whole_in_pretraining_text_of_the_portable_profile(spark):
    docs = spark.createDataFrame([(0, "one<|endoftext|>two <|im_end|>"), (1, "<|three")], "pos bigint, text string")
    ids, vocab = tasks.tokenise_pretrain(docs)
    names = {r.id: r.token for r in vocab.collect()}
    got = {r.pos: [names[i] for i in r.input_ids] for r in ids.collect()}
    assert got == {0: ["one", "<|endoftext|>", "two", "<|im_end|>"], 1: ["<|", "three"]}


def test_very_long_text_with_markers(spark):
    text = ("word " * 100_000 + "<|endoftext|>") * 2
    docs = spark.createDataFrame([(0, text)], "pos bigint, text string")
    ids, vocab = tasks.tokenise_pretrain(docs)
    counts = {r.token: r["count"] for r in vocab.collect()}
    assert counts == {"word": 200_000, "<|endoftext|>": 2} and len(ids.first().input_ids) == 200_002


def conversations(spark, convs):
    rows = [(i, [(r, c) for r, c in msgs]) for i, msgs in enumerate(convs)]
    return spark.createDataFrame(rows, "pos bigint, conversations array<struct<role:string,content:string>>")


def test_sft_ids_and_labels_of_a_byte_level_codec(spark):
    ranks = learned_ranks()
    root, _ = files(ranks)
    codec = read_tokenizer(spark, f"{root}/vocab.json", f"{root}/merges.txt")
    vocab = {r.token: r.id for r in codec.vocab.collect()}
    convs = [[("system", "hello"), ("user", "world <|im_end|> deal"), ("assistant", "Grüße world"), ("user", "o")],
             [("user", "hello"), ("assistant", None), ("assistant", "wo rld")], [("tool", "x")], []]
    got = tasks.build_sft(conversations(spark, convs), "qwen", 4000, True, 100, 1, codec=codec).collect()
    for r in got:
        ids, labels = [], []
        msgs = convs[r.pos]
        if not any(role == "system" for role, _ in msgs):
            msgs = [("system", "You are a helpful assistant.")] + msgs
        for role, text in msgs:
            if text is None or role == "tool":
                continue
            form = {"system": "<|im_start|>system\n{}<|im_end|>\n",
                    "user": "<|im_start|>user\n{}<|im_end|>\n<|im_start|>assistant\n", "assistant": "{}<|im_end|>\n"}[role]
            piece = spec_ids(form.format(text), ranks, vocab)
            ids += piece
            labels += piece if role == "assistant" else [-100] * len(piece)
        assert (r.input_ids, r.labels) == (ids, labels)
    assert sorted(r.pos for r in got) == [0, 1, 2, 3]


def test_lists_of_words_and_the_bounded_memo():
    import pyarrow as pa

    from tessera.operators.bpe import WordMemo, encode_lists

    ranks = learned_ranks()
    alphabet = byte_alphabet()
    ids = {alphabet[b]: b for b in range(256)} | {a + b: 300 + i for i, (a, b) in enumerate(ranks)}
    rows = [["hello", "world", "hello"], [], None, ["東京", "deal", "<|im_end|>", "x" * 300], ["world"] * 5]
    whole = WordMemo(ranks, ids, None)
    want = [[whole(w) for w in r or ()] for r in rows]
    for bound in (1, 2, 100):
        for lists in (pa.array(rows), pa.array([["skipped"], *rows]).slice(1)):
            got, pieces = encode_lists(lists, WordMemo(ranks, ids, None, bound))
            assert got.to_pylist() == [sum(r, []) for r in want]
            assert pieces.to_pylist() == [[len(w) for w in r] for r in want]
    assert encode_lists(pa.array([], pa.list_(pa.string())), whole)[0].to_pylist() == []


def test_encoding_in_place_exchanges_ids_only(spark):
    ranks = learned_ranks()
    root, _ = files(ranks)
    codec = read_tokenizer(spark, f"{root}/vocab.json", f"{root}/merges.txt")
    docs = spark.createDataFrame([(i, "hello world " * i) for i in range(40)], "pos bigint, text string").repartition(8)
    plan = tasks.build_pretrain(docs, 16, 4, 2, codec=codec)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "shard" in dealt[0] and "ArrowEvalPython" in plan, plan


def test_portable_codec_of_a_given_vocabulary(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 7)], "token string, id int")
    docs = spark.createDataFrame([(0, "b a c")], "pos bigint, text string")
    got = tasks.tokenise_pretrain(docs, codec=PortableCodec(vocab, unk_id=3))[0].first().input_ids
    assert got == [7, 0, 3]


def test_null_response_keeps_its_prompt(spark):
    pairs = spark.createDataFrame([(0, "q", None, "bad"), (1, None, "good", "bad")],
                                  "pair_id bigint, question string, response_chosen string, response_rejected string")
    r, vocab = tasks.build_reward(pairs, "pair_id", "qwen", 400)
    names = {v.id: v.token for v in vocab.collect()}
    rows = {x.pair_id: x for x in r.collect()}
    words = lambda ids: [names[i] for i in ids]
    assert words(rows[0].input_ids_chosen)[-5:] == ["q", "<|im_end|>", "<|im_start|>", "assistant", "<|im_end|>"]
    assert words(rows[0].input_ids_rejected)[-6:] == ["q", "<|im_end|>", "<|im_start|>", "assistant", "bad", "<|im_end|>"]
    assert words(rows[1].input_ids_chosen)[-3:] == ["assistant", "good", "<|im_end|>"]
    assert rows[0].attention_mask_chosen == [1] * len(rows[0].input_ids_chosen)
    scored = tasks.build_scoring(pairs.withColumnRenamed("response_chosen", "answer"), "pair_id", vocab=vocab)
    assert {x.pair_id: x.input_ids for x in scored.collect()} == {k: v.input_ids_chosen for k, v in rows.items()}
