"""Named queries: one per operator (or operator group) of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the driver's
tables.  List columns are summarised as length + md5 of their text form so
that results compare across engines; every computed column is aliased to the
same name as in ``plans.oracle``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import ids_digest, rounded, tokens_digest
from tessera.functions.templates import get_template, template_names
from tessera.operators import collate, mix, order, preference, render, tokens, validate
from tessera.operators.pack import pack
from tessera.plans import tasks
from tessera.sources import tables

# parameters of the registered queries (fixed up front, never tuned to pass)
PACK_LEN, PACK_BATCH, PACK_WORKERS = 64, 100, 4
MAPB_BATCH, MAPB_WORKERS = 64, 3
SFT_TEMPLATE, SFT_MAX_LEN, SFT_BATCH, SFT_WORKERS = "qwen", 512, 16, 2
PLAN_BS, PLAN_ACCUM, SEED = 8, 2, 42
PAD_ID = 0
DPO_MAX_CHARS = 1500
REWARD_MAX_LEN = 512
BPE_MAX_LEN = 2048
SCORING_LEN = 256
MIX_EPOCHS = 5
MIX_RATIOS = (1.0, 0.3, 0.0, 0.75)
SPLIT_PERCENT = 10.0
BETA = 0.1
DRO_WEIGHT = 1.0


def _n(c):
    return F.size(c).cast("bigint")


# --- pretraining -----------------------------------------------------------------

def pretrain_pretokens(spark: SparkSession, sf: str) -> DataFrame:
    toks = tasks.pretrain_pretokens(tables.pretrain_docs(spark, sf))
    return toks.select("pos", _n("tokens").alias("n_tokens"), tokens_digest("tokens").alias("tokens_md5"))


def pretrain_full_pretokens(spark: SparkSession, sf: str) -> DataFrame:
    toks = tasks.pretrain_pretokens(tables.pretrain_docs(spark, sf), profile="full")
    return toks.select("pos", _n("tokens").alias("n_tokens"), tokens_digest("tokens").alias("tokens_md5"))


def pretrain_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.vocab_table(tasks.pretrain_pretokens(tables.pretrain_docs(spark, sf)))


def pretrain_encoded(spark: SparkSession, sf: str) -> DataFrame:
    ids, _ = tasks.tokenise_pretrain(tables.pretrain_docs(spark, sf))
    return ids.select("pos", _n("input_ids").alias("n_tokens"), ids_digest("input_ids").alias("ids_md5"),
                      ids_digest("labels").alias("labels_md5"))


def pretrain_map_batches(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.pretrain_docs(spark, sf)
    return order.assign_map_batches(docs, MAPB_BATCH, MAPB_WORKERS).select("pos", "shard", "batch", "in_shard")


def pretrain_packed(spark: SparkSession, sf: str) -> DataFrame:
    out = tasks.build_pretrain(tables.pretrain_docs(spark, sf), PACK_LEN, PACK_BATCH, PACK_WORKERS)
    return out.select("shard", "batch", "chunk", "n_tokens", ids_digest("input_ids").alias("ids_md5"))


def pretrain_packed_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Packing with the tail kept (the optional policy), single shard."""
    docs = tables.pretrain_docs(spark, sf)
    ids, _ = tasks.tokenise_pretrain(docs)
    out = pack(order.assign_map_batches(ids, PACK_BATCH, 1), PACK_LEN, keep_tail=True)
    return out.select("shard", "batch", "chunk", "n_tokens", ids_digest("input_ids").alias("ids_md5"))


def prepared_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = tasks.build_pretrain(tables.pretrain_docs(spark, sf), PACK_LEN, PACK_BATCH, PACK_WORKERS)
    return out.groupBy("shard").agg(F.count(F.lit(1)).alias("samples"), F.sum("n_tokens").alias("tokens"))


def pretrain_decoded(spark: SparkSession, sf: str) -> DataFrame:
    ids, vocab = tasks.tokenise_pretrain(tables.pretrain_docs(spark, sf))
    dec = tokens.decode_ids(ids, ["pos"], vocab)
    return dec.select("pos", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def pretrain_preview(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.pretrain_docs(spark, sf)
    ids, vocab = tasks.tokenise_pretrain(docs)
    out = pack(order.assign_map_batches(ids, PACK_BATCH, PACK_WORKERS, n_rows=order.row_count(docs)), PACK_LEN)
    # the first prepared sample: a distributed top-1, then decoded
    first = out.orderBy("shard", "batch", "chunk").limit(1).withColumn("pos", F.lit(0).cast("bigint"))
    dec = tokens.decode_ids(first, ["pos"], vocab, sep=" ")
    return dec.select(F.col("text").alias("preview"))


def documents_nfc(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text")
    norm = tokens.normalise_nfc(docs.withColumn("raw", F.col("text")), "text")
    return norm.select("pos", F.md5("text").alias("text_md5"), (F.col("text") != F.col("raw")).alias("changed"))


def documents_concat(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents")
    # the distinct languages: a handful of values, the only thing collected
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())
    parts = [
        order.dense_index(docs.where(F.col("lang") == lg).select("doc_id"), ["doc_id"], "pos") for lg in langs
    ]
    out = mix.concat_datasets(parts)
    return out.select("pos", "file_index", "doc_id")


def documents_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.pretrain_docs(spark, sf)
    return validate.train_eval_split(docs, SPLIT_PERCENT, "pos", SEED).select("pos", "split")


BPE_MERGES = 256


def _bpe(spark, sf):
    from tessera.operators.bpe import encode_bpe

    docs = tables.pretrain_docs(spark, sf)
    # one pass of NFC + regex, written to the checkpoint folder and re-read
    toks = order.materialise_scratch(tasks.pretrain_pretokens(docs, profile="full"), "bpe-pretokens")
    words = order.materialise_scratch(tables.word_counts(toks), "bpe-words")
    merges, vocab = tables.bpe_tables(words, BPE_MERGES)
    return encode_bpe(toks, ["pos"], merges, vocab), vocab


def bpe_encoded(spark: SparkSession, sf: str) -> DataFrame:
    ids, _ = _bpe(spark, sf)
    return ids.select("pos", _n("input_ids").alias("n_tokens"), ids_digest("input_ids").alias("ids_md5"))


def bpe_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """decode(encode(text)) with the full profile and byte-level BPE is lossless."""
    from tessera.operators.bpe import decode_bytes

    ids, vocab = _bpe(spark, sf)
    dec = decode_bytes(ids, ["pos"], vocab)
    return dec.select("pos", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def pretrain_encoded_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with special markers, as ids of a public byte-level tokeniser (ops 26, 28, 30)."""
    ids, _ = tasks.tokenise_pretrain(tables.marked_docs(spark, sf), codec=tables.public_tokenizer(spark))
    return ids.select("pos", _n("input_ids").alias("n_tokens"), ids_digest("input_ids").alias("ids_md5"))


def pretrain_packed_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents packed into training chunks."""
    out = tasks.build_pretrain(tables.marked_docs(spark, sf), PACK_LEN, PACK_BATCH, PACK_WORKERS,
                               codec=tables.public_tokenizer(spark))
    return out.select("shard", "batch", "chunk", "n_tokens", ids_digest("input_ids").alias("ids_md5"))


def pretrain_decoded_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the public tokeniser back to text: lossless, markers included (op 29)."""
    codec = tables.public_tokenizer(spark)
    ids, _ = tasks.tokenise_pretrain(tables.marked_docs(spark, sf), codec=codec)
    dec = codec.decode(ids, ["pos"])
    return dec.select("pos", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


STREAM_LEN, STREAM_BATCH = 64, 100
FILE_DOCS, FILE_CONVS, FILE_PAIRS, FILE_WORKERS = 400, 60, 60, 2


def files_pretrain(spark: SparkSession, sf: str) -> DataFrame:
    """The file entry point over JSON-lines files of 400 documents each (ops 1, 2, 30, 34, 35, 46)."""
    root = tables.json_files(tables.pretrain_docs(spark, sf), "pos", ["text"], FILE_DOCS, "files-pt")
    out = tasks.prepare_training_data(spark, "pt", train_file_dir=root, max_seq_length=PACK_LEN, batch_size=PACK_BATCH,
                                      workers=FILE_WORKERS)
    return out.select("file_index", "pos", "shard", "batch", "chunk", "n_tokens", ids_digest("input_ids").alias("ids_md5"))


def files_sft(spark: SparkSession, sf: str) -> DataFrame:
    """The file entry point over files of 60 conversations each (ops 1, 2, 31, 34, 36, 46)."""
    root = tables.json_files(tables.sft_conversations(spark, sf), "pos", ["conversations"], FILE_CONVS, "files-sft")
    out = tasks.prepare_training_data(spark, "sft", train_file_dir=root, max_seq_length=SFT_MAX_LEN,
                                      template_name=SFT_TEMPLATE, batch_size=SFT_BATCH, workers=FILE_WORKERS)
    return out.select("file_index", "pos", "shard", "batch", F.col("n").alias("n_full"),
                      ids_digest("input_ids").alias("ids_md5"), ids_digest("labels").alias("labels_md5"))


def _pair_files(spark, sf, label):
    cols = ["question", "response_chosen", "response_rejected"]
    return tables.json_files(tables.preference_pairs(spark, sf), "pair_id", cols, FILE_PAIRS, label)


def files_dpo(spark: SparkSession, sf: str) -> DataFrame:
    """The file entry point over files of 60 preference pairs each (ops 1, 2, 13, 14, 20, 46)."""
    out = tasks.prepare_training_data(spark, "dpo", train_file_dir=_pair_files(spark, sf, "files-dpo"),
                                      max_seq_length=DPO_MAX_CHARS, template_name=SFT_TEMPLATE)
    return out.select("file_index", "pos", F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"),
                      F.md5("rejected").alias("rejected_md5"))


def files_reward(spark: SparkSession, sf: str) -> DataFrame:
    """The same files prepared for the reward model (ops 1, 2, 21, 32, 46)."""
    out = tasks.prepare_training_data(spark, "reward", train_file_dir=_pair_files(spark, sf, "files-reward"),
                                      max_seq_length=REWARD_MAX_LEN, template_name=SFT_TEMPLATE)
    return out.select("file_index", "pos", ids_digest("input_ids_chosen").alias("chosen_md5"),
                      ids_digest("input_ids_rejected").alias("rejected_md5"))




def stream_prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental preparation (op 60): the documents are written as one folder of JSON-lines
    files per language (lines in doc_id order over its files) under the checkpoint folder, then
    a file-source stream prepares each file once (packing scope = folder)."""
    import uuid

    from tessera.session import checkpoint_dir
    from tessera.sources.io import PRETRAIN_SCHEMA
    from tessera.operators.codec import codec_for
    from tessera.streaming.incremental import folder_pretrain_preparer, prepare_stream

    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    docs = tables.table(spark, sf, "documents").select("lang", "doc_id", "text")
    # ranges of (lang, doc_id): a language's files, named by range, follow each other in order of doc_id
    (docs.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "text")
     .write.partitionBy("lang").json(f"{root}/in"))
    vocab = tokens.vocab_table(tasks.pretrain_pretokens(tables.pretrain_docs(spark, sf)))
    prep = folder_pretrain_preparer(STREAM_LEN, STREAM_BATCH, codec=codec_for(None, vocab))
    out = prepare_stream(spark, f"{root}/in/*", f"{root}/out", f"{root}/ckpt", prep, PRETRAIN_SCHEMA, "*.json", whole=True)
    return out.select("shard", "batch", "chunk", "n_tokens", ids_digest("input_ids").alias("ids_md5"))


def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental preparation by ledger (op 60): files of 400 documents go through a stream, which is then
    started again without its checkpoint; ``in_file`` places, and whether places over all files are dense."""
    import uuid

    from tessera.operators.codec import PortableCodec
    from tessera.session import checkpoint_dir
    from tessera.sources.io import PRETRAIN_SCHEMA
    from tessera.streaming.incremental import indexed_pretrain_preparer, prepare_stream_once

    docs = tables.pretrain_docs(spark, sf)
    files = tables.json_files(docs, "pos", ["text"], FILE_DOCS, "stream-files")
    root = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    counted = PortableCodec().learn(tasks.task_pretokens(docs, "pt"))
    vocab = order.materialise_scratch(counted.vocab, "stream-vocab")
    prepare = indexed_pretrain_preparer(STREAM_LEN, STREAM_BATCH, codec=PortableCodec(vocab, size=counted.size))
    for attempt in ("first", "again"):           # the second finds every file committed
        out = prepare_stream_once(spark, files, f"{root}/out", f"{root}/checkpoint-{attempt}", prepare, PRETRAIN_SCHEMA)
    facts = out.agg((F.count(F.lit(1)) == F.max("pos") + 1).alias("a"), (F.count_distinct("pos") == F.count(F.lit(1))).alias("b"))
    facts = order.materialise_scratch(facts.select((F.col("a") & F.col("b")).alias("dense")), "stream-dense")
    index = F.regexp_extract("file", "bucket=([0-9]+)", 1).cast("int")
    return out.select(index.alias("file_index"), "in_file", "batch", "chunk", "n_tokens",
                      ids_digest("input_ids").alias("ids_md5"), facts.select("dense").scalar().alias("dense"))


# --- supervised fine-tuning --------------------------------------------------------

def sft_conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.sft_conversations(spark, sf)
    return c.select(
        "pos",
        _n("conversations").alias("n_messages"),
        F.md5(F.array_join(F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"))
        .alias("conv_md5"),
    )


def sft_rendered(spark: SparkSession, sf: str) -> DataFrame:
    c = render.render_messages(tables.sft_conversations(spark, sf), SFT_TEMPLATE)
    text = render.messages_text("messages")
    return c.select("pos", _n("messages").alias("n_messages"), F.length(text).cast("bigint").alias("n_chars"),
                    F.md5(text).alias("text_md5"))


def renderable_templates() -> list[str]:
    """Templates that can render every conversation of the fixture (those with a
    system format; chatglm2 needs {idx})."""
    return [n for n in template_names() if get_template(n).system_format is not None]


def sft_rendered_templates(spark: SparkSession, sf: str) -> DataFrame:
    convs = tables.sft_conversations(spark, sf)
    r = render.render_with_templates(convs, renderable_templates())
    text = render.messages_text("messages")
    return r.select("template_name", "pos", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


def plain_templates() -> list[str]:
    """Templates without a system format that need nothing but the message's text."""
    return [n for n in template_names()
            if get_template(n).system_format is None and "{idx}" not in get_template(n).user_format]


def sft_rendered_plain_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations without their system messages, under the templates that have no place for one (op 17)."""
    convs = tables.sft_conversations(spark, sf).withColumn(
        "conversations", F.filter("conversations", lambda m: m["role"] != "system"))
    r = render.render_with_templates(convs, plain_templates())
    text = render.messages_text("messages")
    return r.select("template_name", "pos", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


def chat_rendered(spark: SparkSession, sf: str) -> DataFrame:
    c = render.render_chat(tables.sft_conversations(spark, sf), add_generation_prompt=True)
    return c.select("pos", F.length("chat_text").cast("bigint").alias("n_chars"), F.md5("chat_text").alias("text_md5"))


def sft_tokens(spark: SparkSession, sf: str) -> DataFrame:
    ids, _ = tasks.tokenise_sft(tables.sft_conversations(spark, sf), SFT_TEMPLATE)
    return ids.select("pos", _n("input_ids").alias("n_tokens"),
                      collate.supervised_count("labels").alias("n_supervised"),
                      ids_digest("input_ids").alias("ids_md5"), ids_digest("labels").alias("labels_md5"))


def _sft_prepared(spark, sf, discard):
    # flat turns in: messages are tokenised per row and conversations are only
    # grouped once their size is known to be within max_seq_len (skew-safe)
    out = tasks.build_sft_from_turns(tables.table(spark, sf, "conversations"), SFT_TEMPLATE, SFT_MAX_LEN, discard,
                                     SFT_BATCH, SFT_WORKERS)
    return out.select("pos", "shard", "batch", "rank_in_batch", "out_pos", F.col("n").alias("n_full"),
                      _n("input_ids").alias("n_tokens"), ids_digest("input_ids").alias("ids_md5"),
                      ids_digest("labels").alias("labels_md5"))


def sft_prepared(spark: SparkSession, sf: str) -> DataFrame:
    return _sft_prepared(spark, sf, True)


def sft_prepared_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return _sft_prepared(spark, sf, False)


def sft_prepared_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Flat turns prepared with the ids of a public byte-level tokeniser (ops 28, 31, 36)."""
    out = tasks.build_sft_from_turns(tables.table(spark, sf, "conversations"), SFT_TEMPLATE, BPE_MAX_LEN, True,
                                     SFT_BATCH, SFT_WORKERS, codec=tables.public_tokenizer(spark))
    return out.select("pos", "shard", "batch", "rank_in_batch", "out_pos", F.col("n").alias("n_full"),
                      ids_digest("input_ids").alias("ids_md5"), ids_digest("labels").alias("labels_md5"))


def sft_preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first prepared SFT sample (output position 0), decoded (op 9)."""
    out, vocab = tasks.build_sft_from_turns(tables.table(spark, sf, "conversations"), SFT_TEMPLATE, SFT_MAX_LEN,
                                            True, SFT_BATCH, SFT_WORKERS, return_vocab=True)
    first = out.where(F.col("out_pos") == 0).select("pos", "input_ids")
    return tokens.decode_ids(first, ["pos"], vocab, sep=" ").select("pos", F.col("text").alias("preview"))


def _sft_ids(spark, sf):
    ids, _ = tasks.tokenise_sft(tables.sft_conversations(spark, sf), SFT_TEMPLATE)
    return ids.withColumn("n", _n("input_ids"))


def supervision_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = collate.supervision_stats(_sft_ids(spark, sf))
    return s.select("pos", "n_tokens", "n_supervised", "n_supervised_shifted", "fully_masked")


def shifted_labels(spark: SparkSession, sf: str) -> DataFrame:
    s = _sft_ids(spark, sf).withColumn("shifted", collate.shifted_labels("labels"))
    return s.select("pos", _n("shifted").alias("n_shifted"), ids_digest("shifted").alias("shifted_md5"))


def plan_sequential(spark: SparkSession, sf: str) -> DataFrame:
    return order.plan_sequential(_sft_ids(spark, sf), PLAN_BS).select("pos", "order_idx", "batch_id")


def plan_random(spark: SparkSession, sf: str) -> DataFrame:
    return order.plan_random(_sft_ids(spark, sf), PLAN_BS, SEED).select("pos", "order_idx", "batch_id")


def plan_permuted(spark: SparkSession, sf: str) -> DataFrame:
    """Training order of the documents by a keyed bijection (op 38)."""
    docs = tables.pretrain_docs(spark, sf)
    return order.plan_permuted(docs.select("pos"), PLAN_BS, order.row_count(docs), SEED)


def plan_length_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return order.plan_length_grouped(_sft_ids(spark, sf), PLAN_BS, PLAN_ACCUM, SEED, "n").select(
        "pos", "order_idx", "batch_id")


def _padded(spark, sf):
    planned = order.plan_random(_sft_ids(spark, sf), PLAN_BS, SEED)
    return collate.collate_pad(planned, PAD_ID)


def collate_padded(spark: SparkSession, sf: str) -> DataFrame:
    p = _padded(spark, sf)
    return p.select("pos", "batch_id", _n("input_ids").alias("width"), ids_digest("input_ids").alias("ids_md5"),
                    ids_digest("labels").alias("labels_md5"),
                    F.size(F.filter("attention_mask", lambda x: x)).cast("bigint").alias("n_attended"))


def padding_stats_random(spark: SparkSession, sf: str) -> DataFrame:
    return collate.padding_stats(order.plan_random(_sft_ids(spark, sf), PLAN_BS, SEED))


def padding_stats_length_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return collate.padding_stats(order.plan_length_grouped(_sft_ids(spark, sf), PLAN_BS, PLAN_ACCUM, SEED, "n"))


def unpad_offsets(spark: SparkSession, sf: str) -> DataFrame:
    u = collate.unpad_offsets(_padded(spark, sf))
    return u.select("pos", "batch_id", "row_in_batch", "seqlen", "cu_offset", "max_seqlen",
                    ids_digest("indices").alias("indices_md5"))


def cu_seqlens(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets of each padded batch's sequences, with their closing total (op 42)."""
    u = collate.cu_seqlens(_padded(spark, sf))
    return u.select("batch_id", _n("cu_seqlens").alias("n_offsets"), ids_digest("cu_seqlens").alias("cu_md5"),
                    "max_seqlen", "total")


def last_token_index(spark: SparkSession, sf: str) -> DataFrame:
    p = _padded(spark, sf)
    return p.select("pos", collate.last_token_index("input_ids", PAD_ID).alias("last_idx"))


# --- preference data ----------------------------------------------------------------

def dpo_prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = tasks.build_dpo(tables.preference_pairs(spark, sf), SFT_TEMPLATE, DPO_MAX_CHARS)
    return d.select("pair_id", F.length("prompt").cast("bigint").alias("prompt_chars"),
                    F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"),
                    F.md5("rejected").alias("rejected_md5"))


def reward_tokens(spark: SparkSession, sf: str) -> DataFrame:
    r, _ = tasks.build_reward(tables.preference_pairs(spark, sf), "pair_id", SFT_TEMPLATE, REWARD_MAX_LEN, True)
    return r.select("pair_id", _n("input_ids_chosen").alias("n_chosen"), _n("input_ids_rejected").alias("n_rejected"),
                    ids_digest("input_ids_chosen").alias("chosen_md5"),
                    ids_digest("input_ids_rejected").alias("rejected_md5"),
                    F.aggregate("attention_mask_chosen", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_chosen"))


def reward_tokens_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of the pairs as ids of a public byte-level tokeniser (ops 28, 32)."""
    r, _ = tasks.build_reward(tables.preference_pairs(spark, sf), "pair_id", SFT_TEMPLATE, BPE_MAX_LEN, True,
                              codec=tables.public_tokenizer(spark))
    return r.select("pair_id", _n("input_ids_chosen").alias("n_chosen"), _n("input_ids_rejected").alias("n_rejected"),
                    ids_digest("input_ids_chosen").alias("chosen_md5"),
                    ids_digest("input_ids_rejected").alias("rejected_md5"))


def dpo_preview(spark: SparkSession, sf: str) -> DataFrame:
    """First prepared DPO sample (dataset order), as prompt + chosen / rejected (op 9)."""
    d = tasks.build_dpo(tables.preference_pairs(spark, sf), SFT_TEMPLATE, DPO_MAX_CHARS)
    first = d.orderBy("pair_id").limit(1)  # a distributed top-1
    return first.select("pair_id", F.md5(F.concat("prompt", "chosen")).alias("chosen_md5"),
                        F.md5(F.concat("prompt", "rejected")).alias("rejected_md5"))


def reward_preview(spark: SparkSession, sf: str) -> DataFrame:
    """First prepared reward sample, chosen side decoded (op 9)."""
    r, vocab = tasks.build_reward(tables.preference_pairs(spark, sf), "pair_id", SFT_TEMPLATE, REWARD_MAX_LEN, True)
    first = r.orderBy("pair_id").limit(1).select("pair_id", "input_ids_chosen")
    dec = tokens.decode_ids(first, ["pair_id"], vocab, "input_ids_chosen", sep=" ")
    return dec.select("pair_id", F.col("text").alias("preview"))


def scoring_prompts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = tables.preference_pairs(spark, sf).select("pair_id", "question", F.col("response_chosen").alias("answer"))
    s = tasks.build_scoring(pairs, "pair_id", SFT_TEMPLATE, max_length=SCORING_LEN)
    return s.select("pair_id", _n("input_ids").alias("n_tokens"), ids_digest("input_ids").alias("ids_md5"))


def instructions_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.sources.io import jsonl_lines

    recs = tables.instruction_records(spark, sf)
    return jsonl_lines(recs, ["instruction", "input", "output"]).select("id", F.md5("value").alias("line_md5"))


def instructions_valid(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.sources.io import jsonl_lines

    lines = jsonl_lines(tables.instruction_records(spark, sf), ["instruction", "input", "output"])
    return validate.validate_instructions(lines, "value", mode="flag").select("id", "valid")


def instructions_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Validity of lines of which many are broken: keys missing, outputs of every kind, cut-off lines (op 10)."""
    return validate.validate_instructions(tables.instruction_lines(spark, sf), "value", mode="flag").select("id", "valid")


# --- mixing ---------------------------------------------------------------------------

def _mix(spark, sf):
    rows, props = tables.mix_sources(spark, sf)
    props = mix.check_proportions(props)
    # ranking and mixing run on keys only; the payload is attached once, when written
    return mix.shuffle_sources(rows.select("source", "id"), SEED), props


def mix_proportions(spark: SparkSession, sf: str) -> DataFrame:
    _, props = tables.mix_sources(spark, sf)
    return mix.check_proportions(props)


def mix_shuffled_sources(spark: SparkSession, sf: str) -> DataFrame:
    shuffled, _ = _mix(spark, sf)
    return shuffled.select("source", "id", "r", "n_source")


def mix_epochs(spark: SparkSession, sf: str) -> DataFrame:
    shuffled, props = _mix(spark, sf)
    return mix.mix_epochs(shuffled, props, MIX_EPOCHS).select("epoch", "source", "id", "r", "num", "wrapped")


def mix_epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    shuffled, props = _mix(spark, sf)
    return mix.shuffle_epoch(mix.mix_epochs(shuffled, props, MIX_EPOCHS), SEED).select("out_pos", "epoch", "source", "id")


def mix_permuted(spark: SparkSession, sf: str) -> DataFrame:
    """Sources shuffled, mixed and shuffled by epoch through keyed bijections (ops 47-50)."""
    rows, props = tables.mix_sources(spark, sf)
    ranked = order.dense_index(rows.select("source", "id"), ["source", "id"], "_g")
    first = ranked.groupBy("source").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("count"))
    placed = tokens.lookup(ranked, first, "source", ["_first"]).withColumn("at", F.col("_g") - F.col("_first"))
    out = mix.mix_permuted(placed.select("source", "id", "at"), mix.check_proportions(props), MIX_EPOCHS, SEED)
    return out.select("out_pos", "epoch", "source", "id")


def mixture_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The epoch-mixing job over instruction files of four sources: every written line and its place (ops 3, 6, 7, 10, 47-50)."""
    import uuid

    from tessera.session import checkpoint_dir

    root = f"{checkpoint_dir(spark).rstrip('/')}/mixture-{uuid.uuid4().hex}"
    recs = tables.instruction_records(spark, sf)
    source = F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))
    (recs.select(source.alias("source"), "id", "instruction", "input", "output").repartition("source")
     .sortWithinPartitions("source", "id").drop("id").write.partitionBy("source").json(f"{root}/in"))
    config = {f"source=s{i}": r for i, r in enumerate(MIX_RATIOS)}
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{root}/config")
    out = tasks.build_mixture(spark, f"{root}/in", f"{root}/config", MIX_EPOCHS, f"{root}/out", SEED)
    return out.select("out_pos", F.md5("value").alias("line_md5"))


def mix_report(spark: SparkSession, sf: str) -> DataFrame:
    shuffled, props = _mix(spark, sf)
    return mix.mix_report(mix.mix_epochs(shuffled, props, MIX_EPOCHS))


# --- preference metrics ----------------------------------------------------------------

def _pairs_wide(spark, sf, average=False):
    """One pass over the token table: policy and reference sums together."""
    tok = tables.token_logps(spark, sf)
    seqs = preference.sequence_logps(tok, "logp", average, extra={"seq_ref_logp": "ref_logp"})
    return preference.pair_sides(seqs, "seq_logp", prefix="policy", extra={"seq_ref_logp": "reference"})


def sequence_logps(spark: SparkSession, sf: str) -> DataFrame:
    s = preference.sequence_logps(tables.token_logps(spark, sf), "logp")
    return s.select("seq_id", "pair_id", "side", "n_completion", rounded("seq_logp").alias("seq_logp"))


def pair_logps(spark: SparkSession, sf: str) -> DataFrame:
    w = _pairs_wide(spark, sf)
    return w.select("pair_id", "n_chosen", "n_rejected", rounded("policy_chosen").alias("policy_chosen"),
                    rounded("policy_rejected").alias("policy_rejected"),
                    rounded("reference_chosen").alias("reference_chosen"),
                    rounded("reference_rejected").alias("reference_rejected"))


def _losses(spark, sf, kind, dro=False):
    # the robust objective averages log-probs over tokens, whatever the kind
    average = dro or kind in ("ipo", "simpo", "orpo")
    return preference.preference_loss(_pairs_wide(spark, sf, average), kind, BETA)


def _loss_cols(df):
    return df.select("pair_id", rounded("loss").alias("loss"), rounded("chosen_reward").alias("chosen_reward"),
                     rounded("rejected_reward").alias("rejected_reward"))


def dpo_losses(spark: SparkSession, sf: str) -> DataFrame:
    return _loss_cols(_losses(spark, sf, "sigmoid"))


def ipo_losses(spark: SparkSession, sf: str) -> DataFrame:
    return _loss_cols(_losses(spark, sf, "ipo"))


def simpo_losses(spark: SparkSession, sf: str) -> DataFrame:
    return _loss_cols(_losses(spark, sf, "simpo"))


def orpo_losses(spark: SparkSession, sf: str) -> DataFrame:
    return _loss_cols(_losses(spark, sf, "orpo"))


def preference_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = preference.preference_metrics(_losses(spark, sf, "sigmoid"), "eval")
    return m.select(*[rounded(c).alias(c) for c in m.columns])


def dro_loss(spark: SparkSession, sf: str) -> DataFrame:
    d = preference.dro_loss(_losses(spark, sf, "sigmoid", dro=True), DRO_WEIGHT)
    return d.select(rounded("dro_loss").alias("dro_loss"))


def token_nll(spark: SparkSession, sf: str) -> DataFrame:
    t = preference.token_nll(tables.token_logps(spark, sf), "logp", "chosen")
    return t.select(rounded("nll").alias("nll"), "n_tokens", rounded("perplexity").alias("perplexity"))


RPO_ALPHA, CPO_ALPHA = 0.2, 0.5


def _chosen_nll(spark, sf):
    """Mean negative log-likelihood of the chosen side's supervised tokens: one number."""
    return preference.token_nll(tables.token_logps(spark, sf), "logp", "chosen").select("nll").scalar()


def _rpo(spark, sf):
    wide = order.materialise_scratch(_pairs_wide(spark, sf).withColumn("nll", _chosen_nll(spark, sf)), "rpo-pairs")
    return preference.preference_loss(wide, "sigmoid", BETA, rpo_alpha=RPO_ALPHA, nll="nll")


def rpo_losses(spark: SparkSession, sf: str) -> DataFrame:
    """DPO losses with the weighted likelihood of the chosen side added (op 55)."""
    return _loss_cols(_rpo(spark, sf))


def rpo_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of the same losses, with the likelihood's column (op 56)."""
    m = preference.preference_metrics(_rpo(spark, sf), "train", nll="nll")
    return m.select(*[rounded(c).alias(c) for c in m.columns])


def cpo_objectives(spark: SparkSession, sf: str) -> DataFrame:
    """Objectives of the CPO family: SimPO and ORPO pair losses, plain and robust, plus alpha times the
    likelihood of the chosen side (op 55)."""
    rows = []
    nll = order.materialise_scratch(preference.token_nll(tables.token_logps(spark, sf), "logp", "chosen"), "cpo-nll")
    pairs = order.materialise_scratch(_pairs_wide(spark, sf, True), "cpo-pairs")
    for kind in ("simpo", "orpo"):
        losses = preference.preference_loss(pairs, kind, BETA)
        for name, weight in (("mean", None), ("robust", DRO_WEIGHT)):
            one = preference.cpo_objective(losses, nll.select("nll").scalar(), CPO_ALPHA, weight)
            rows.append(one.select(F.lit(kind).alias("kind"), F.lit(name).alias("reduction"),
                                   *[rounded(c).alias(c) for c in ("preference_loss", "nll_loss", "objective")]))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def reward_pair_losses(spark: SparkSession, sf: str) -> DataFrame:
    """The reward model's pair loss, each side's average log-prob standing for its scalar reward (op 55)."""
    return _loss_cols(_losses_of_rewards(spark, sf))


def _losses_of_rewards(spark, sf):
    return preference.preference_loss(_pairs_wide(spark, sf, True), "reward", BETA)


def reference_logps(spark: SparkSession, sf: str) -> DataFrame:
    """Reference values through the cache (op 54): even pairs were computed before (and differ by one, to
    tell them apart), every tenth of those lacks its rejected side; the rest is recomputed and added."""
    import uuid

    from tessera.session import checkpoint_dir

    wide = order.materialise_scratch(
        _pairs_wide(spark, sf).select("pair_id", "reference_chosen", "reference_rejected"), "reference-pairs")
    cache = preference.ReferenceCache(spark, f"{checkpoint_dir(spark).rstrip('/')}/reference-{uuid.uuid4().hex}")
    cache.add(wide.where("pair_id % 2 = 0").select(
        "pair_id", (F.col("reference_chosen") - 1).alias("reference_chosen"),
        F.when(F.col("pair_id") % 10 != 0, F.col("reference_rejected") - 1).alias("reference_rejected")))
    out = cache.fill(wide.select("pair_id"), lambda missing: missing.join(wide, "pair_id"))
    return out.select("pair_id", rounded("reference_chosen").alias("reference_chosen"),
                      rounded("reference_rejected").alias("reference_rejected"), F.col("version").cast("int").alias("version"))


def score_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared error and binary cross-entropy of the pairs' implicit reward logits against 1 (op 59)."""
    w = _pairs_wide(spark, sf, True).select((F.col("policy_chosen") - F.col("policy_rejected")).alias("logit"),
                                            F.lit(1.0).alias("target"))
    m = preference.score_losses(w, "logit", "target")
    return m.select(rounded("mse").alias("mse"), rounded("bce").alias("bce"))


def class_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-entropy of logit arrays against integer classes, per document (op 59)."""
    d = tables.letter_logits(spark, sf)
    return d.select("doc_id", rounded(preference.class_cross_entropy("logits", "label")).alias("loss"))


def multilabel_bce(spark: SparkSession, sf: str) -> DataFrame:
    """Binary cross-entropy of logit arrays against multi-hot targets, per document (op 59)."""
    d = tables.letter_logits(spark, sf)
    return d.select("doc_id", rounded(preference.multilabel_bce("logits", "targets")).alias("loss"))


def classifier_losses(spark: SparkSession, sf: str) -> DataFrame:
    """The three kinds of classifier loss over the table (op 59); regression is of the first logit against the class."""
    d = tables.letter_logits(spark, sf)
    out = None
    for problem, target in (("regression", "label"), ("single_label", "label"), ("multi_label", "targets")):
        one = preference.classifier_loss(d, problem, "logits", target).select(
            F.lit(problem).alias("problem"), rounded("loss", 4).alias("loss"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def reward_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Implicit reward logit per pair (chosen minus rejected average policy
    log-prob); sigmoid score, and MSE / BCE against 'chosen wins' = 1."""
    w = _pairs_wide(spark, sf, True).select("pair_id", (F.col("policy_chosen") - F.col("policy_rejected")).alias("logit"))
    # one row per pair, written once: the scalar subquery below reads it instead of re-running the upstream
    w = order.materialise_scratch(w, "reward-logits")
    scored = preference.reward_scores(w, "logit").withColumn("target", F.lit(1.0))
    losses = preference.score_losses(scored, "logit", "target")
    return scored.select(
        "pair_id", rounded("logit").alias("logit"), rounded("score").alias("score"),
        losses.select("mse").scalar().alias("mse_all"),
    ).withColumn("mse_all", rounded("mse_all"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pretrain_pretokens, pretrain_full_pretokens, pretrain_vocab, pretrain_encoded, pretrain_map_batches,
        pretrain_packed, pretrain_packed_tail, prepared_counts, pretrain_decoded, pretrain_preview, documents_nfc,
        bpe_encoded, bpe_roundtrip, pretrain_encoded_bpe, pretrain_packed_bpe, pretrain_decoded_bpe, sft_prepared_bpe,
        reward_tokens_bpe, stream_prepared, stream_ledger, files_pretrain, files_sft, files_dpo, files_reward,
        documents_concat, documents_split,
        sft_conversations, sft_rendered, sft_rendered_templates, chat_rendered, sft_tokens, sft_prepared,
        sft_prepared_truncated, sft_preview, supervision_stats, shifted_labels, plan_sequential, plan_random, plan_length_grouped,
        collate_padded, padding_stats_random, padding_stats_length_grouped, unpad_offsets, last_token_index,
        dpo_prompts, dpo_preview, reward_tokens, reward_preview, scoring_prompts, instructions_jsonl, instructions_valid,
        mix_proportions, mix_shuffled_sources, mix_epochs, mix_epoch_order, mix_report,
        sequence_logps, pair_logps, dpo_losses, ipo_losses, simpo_losses, orpo_losses, preference_metrics,
        dro_loss, token_nll, reward_scores, rpo_losses, rpo_metrics, cpo_objectives, reward_pair_losses, reference_logps,
        score_losses, class_cross_entropy, multilabel_bce, classifier_losses, cu_seqlens, sft_rendered_plain_templates,
        instructions_checked, plan_permuted, mix_permuted, mixture_lines,
    )
}
