"""Task-level compositions of the operators: pretrain, SFT, preference, reward.

Each function returns DataFrames.  Dense indexes are written to the checkpoint
folder while the plan is built; nothing is collected except scalars (row
counts) that parameterise the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fixed import (
    DEFAULT_MAX_SEQ_LEN,
    DEFAULT_TEMPLATE,
    EOS_TOKEN,
    IGNORE_INDEX,
    MAP_BATCH_SIZE,
    SCORING_MAX_LEN,
)
from tessera.operators.codec import codec_for
from tessera.operators.order import assign_map_batches, batch_partitioning_pays, row_count, spread
from tessera.operators.pack import pack, sort_by_length
from tessera.operators.render import render_messages, render_preference, render_reward, render_scoring_prompt
from tessera.operators.tokens import nfc_column, normalise_nfc, normalise_nfc_nested, pretokenise, vocab_table
from tessera.operators.validate import drop_empty_pairs, drop_long, drop_long_chars, truncate


# --- pretraining ---------------------------------------------------------------

def pretrain_pretokens(docs: DataFrame, profile: str = "portable") -> DataFrame:
    # Hash-partition the raw text by pos once: the regroup after the vocabulary
    # join then needs no shuffle of the (larger) exploded token rows.
    # NFC first, as the tokeniser does; markers are split out and kept whole
    return pretokenise(normalise_nfc(docs.select("pos", "text").repartition("pos"), "text"), "text", "tokens", profile,
                       markers=True)


def learned(codec, raw: DataFrame, task_type: str, template=DEFAULT_TEMPLATE, eos: str = EOS_TOKEN, keys=("pos",)):
    """``codec`` fit for the pre-tokens of ``raw``, which is read where it lies."""
    if codec.vocab is not None:
        return codec
    return codec.learn(task_pretokens(spread(raw, *keys), task_type, template, eos, codec))


def tokenise_pretrain(docs: DataFrame, vocab: DataFrame | None = None, codec=None) -> tuple[DataFrame, DataFrame]:
    """(pos, input_ids, labels) with labels = input_ids; no BOS/EOS, no separator (op 30)."""
    codec = learned(codec_for(codec, vocab), docs.select("pos", "text"), "pt")
    dealt = spread(docs.select("pos", "text"), "pos") if codec.in_place else docs.select("pos", "text").repartition("pos")
    toks = normalise_nfc(dealt, "text").select("pos", codec.split("text").alias("tokens"))
    return codec.encode(toks, ["pos"]).withColumn("labels", F.col("input_ids")), codec.vocab


def build_pretrain(
    docs: DataFrame,
    max_seq_len: int = DEFAULT_MAX_SEQ_LEN,
    batch_size: int = MAP_BATCH_SIZE,
    workers: int | None = None,
    vocab: DataFrame | None = None,
    n_rows: int | None = None,
    separator_id: int | None = None,
    codec=None,
) -> DataFrame:
    """documents → token ids → shard/batch → packed chunks of ``max_seq_len``.

    ``codec``: the tokeniser (``operators.codec``); without one, whole
    pre-tokens are looked up in ``vocab``, or in one counted over ``docs``.
    ``separator_id`` (optional, off by default as in the reference) appends
    that id to every document before packing.

    With enough map batches the text is hash-partitioned by (shard, batch)
    once; the per-row regroup (keyed by shard, batch, pos), the packing window
    and the chunk aggregation all reuse it: a single exchange, of raw text.
    Labels equal the ids and are made after packing.
    """
    if n_rows is None:
        n_rows = row_count(docs)
    codec = learned(codec_for(codec, vocab), docs.select("pos", "text"), "pt")
    batched = assign_map_batches(docs.select("pos", "text"), batch_size, workers, n_rows=n_rows)
    by_batch = batch_partitioning_pays(docs.sparkSession, n_rows, batch_size, workers)
    return with_labels(pack_documents(batched, codec, max_seq_len, by_batch, separator_id))


def pack_documents(batched: DataFrame, codec, max_seq_len: int, by_batch: bool,
                   separator_id: int | None = None) -> DataFrame:
    """Documents with ``shard``, ``batch`` and ``pos`` → packed chunks of ids, with a codec fit for them.

    ``by_batch``: texts are dealt out by (shard, batch), else by ``pos``; with a
    codec that encodes in place texts stay and ids are dealt out by (shard, batch).
    """
    texts, keys = batched.select("shard", "batch", "pos", "text"), ["shard", "batch", "pos"]
    dealt = spread(texts, "pos") if codec.in_place else texts.repartition(*(keys[:2] if by_batch else keys[2:]))
    ids = codec.encode(normalise_nfc(dealt, "text").select(*keys, codec.split("text").alias("tokens")), keys)
    if separator_id is not None:
        ids = ids.withColumn("input_ids", F.concat("input_ids", F.array(F.lit(int(separator_id)))))
    return pack(ids, max_seq_len, ("input_ids",))


def with_labels(packed: DataFrame) -> DataFrame:
    """``labels`` = ``input_ids``, beside them."""
    cols = [c for c in packed.columns if c != "n_tokens"]
    return packed.select(*cols, F.col("input_ids").alias("labels"), "n_tokens")


# --- supervised fine-tuning ----------------------------------------------------

def sft_pretokens(convs: DataFrame, template=DEFAULT_TEMPLATE, eos: str = EOS_TOKEN, codec=None) -> DataFrame:
    """Render, then pre-tokenise each message on its own (no merge crosses a
    message border); ``sup`` flags assistant tokens."""
    codec = codec_for(codec)
    rendered = render_messages(normalise_nfc_nested(convs, "conversations"), template, eos)
    per_msg = F.transform(
        "messages",
        # a NULL message has no token; a NULL array would empty the whole conversation
        lambda m: F.struct(m["role"].alias("role"), F.coalesce(
            codec.split(m["text"]), F.array().cast("array<string>")).alias("t")),
    )
    return (
        rendered.withColumn("_mt", per_msg)
        .withColumn("tokens", F.flatten(F.transform("_mt", lambda m: m["t"])))
        .withColumn("sup", F.flatten(F.transform("_mt", lambda m: F.array_repeat(m["role"] == "assistant", F.size(m["t"])))))
        .drop("_mt")
    )


def tokenise_sft(convs: DataFrame, template=DEFAULT_TEMPLATE, eos: str = EOS_TOKEN,
                 vocab: DataFrame | None = None, codec=None) -> tuple[DataFrame, DataFrame]:
    """(pos, input_ids, labels): assistant tokens supervised, all else -100 (op 31)."""
    codec = codec_for(codec, vocab)
    toks = sft_pretokens(convs, template, eos, codec)
    codec = codec.learn(toks)
    return masked(codec.encode(toks, ["pos"], flags_col="sup")), codec.vocab


def masked(ids: DataFrame) -> DataFrame:
    """``labels`` from ids and their ``sup`` flags: -100 where nothing is supervised."""
    labels = F.zip_with("input_ids", "sup", lambda i, s: F.when(s, i).otherwise(F.lit(IGNORE_INDEX)))
    return ids.withColumn("labels", labels).drop("sup")


def build_sft(
    convs: DataFrame,
    template=DEFAULT_TEMPLATE,
    max_seq_len: int = DEFAULT_MAX_SEQ_LEN,
    discard_long_sample: bool = True,
    batch_size: int = MAP_BATCH_SIZE,
    workers: int | None = None,
    eos: str = EOS_TOKEN,
    vocab: DataFrame | None = None,
    n_rows: int | None = None,
    codec=None,
) -> DataFrame:
    """Tokenise → (drop long) → sort by pre-truncation length inside each map
    batch → truncate.  Batches are cut on the input rows, before any drop.

    With enough map batches the conversations are hash-partitioned by
    (shard, batch) before rendering, so the per-row regroup and the sorting
    window reuse that single exchange.
    """
    if n_rows is None:
        n_rows = row_count(convs)
    codec = learned(codec_for(codec, vocab), convs, "sft", template, eos)
    batched = assign_map_batches(convs, batch_size, workers, n_rows=n_rows)
    by_batch = batch_partitioning_pays(convs.sparkSession, n_rows, batch_size, workers)
    return sort_conversations(batched, codec, template, max_seq_len, discard_long_sample, by_batch, eos)


def sort_conversations(batched: DataFrame, codec, template, max_seq_len: int, discard_long_sample: bool, by_batch: bool,
                       eos: str = EOS_TOKEN) -> DataFrame:
    """Conversations with ``shard``, ``batch`` and ``pos`` → prepared samples, with a codec fit for them."""
    dealt = batched.repartition("shard", "batch") if by_batch and not codec.in_place else batched
    toks = sft_pretokens(dealt, template, eos, codec)
    samples = masked(codec.encode(toks, ["shard", "batch", "pos"], flags_col="sup"))
    samples = samples.withColumn("n", F.size("input_ids").cast("bigint"))
    if discard_long_sample:
        samples = drop_long(samples, max_seq_len)
    return truncate(sort_by_length(samples, "n"), max_seq_len)


# --- preference (DPO / ORPO / SimPO) and reward ----------------------------------

def build_dpo(pairs: DataFrame, template=DEFAULT_TEMPLATE, max_chars: int = DEFAULT_MAX_SEQ_LEN) -> DataFrame:
    """prompt/chosen/rejected strings; the length limit counts characters and
    always drops (ops 13, 14, 20)."""
    rendered = render_preference(pairs, template)
    return drop_empty_pairs(drop_long_chars(rendered, max_chars))


def filled(df: DataFrame, *cols: str) -> DataFrame:
    """NULL texts as empty ones, so that the rest of their sample (its prompt) stays."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in cols})


def reward_pretokens(pairs: DataFrame, keys: list[str], template=DEFAULT_TEMPLATE, eos: str = EOS_TOKEN,
                     codec=None) -> DataFrame:
    """``tokens`` of both rendered sides, the chosen one's first, and ``is_chosen`` beside them."""
    codec = codec_for(codec)
    rendered = render_reward(filled(pairs, "question", "response_chosen", "response_rejected"), template, eos)
    sides = rendered.select(*keys, codec.split(nfc_column("chosen_text")).alias("_c"),
                            codec.split(nfc_column("rejected_text")).alias("_r"))
    return sides.select(*keys, F.concat("_c", "_r").alias("tokens"), F.concat(
        F.array_repeat(F.lit(True), F.size("_c")), F.array_repeat(F.lit(False), F.size("_r"))).alias("is_chosen"))


def build_reward(
    pairs: DataFrame,
    key: str = "pair_id",
    template=DEFAULT_TEMPLATE,
    max_seq_len: int = DEFAULT_MAX_SEQ_LEN,
    discard_long_sample: bool = True,
    eos: str = EOS_TOKEN,
    vocab: DataFrame | None = None,
    codec=None,
) -> tuple[DataFrame, DataFrame]:
    """Chosen/rejected full texts tokenised whole; masks all ones (ops 21, 32).

    A NULL question or response counts as an empty text: its side still holds
    the rendered rest.  Both sides are encoded in one pass and told apart by a
    flag at every id.
    """
    codec = codec_for(codec, vocab)
    toks = reward_pretokens(pairs, [key], template, eos, codec)
    codec = codec.learn(toks)
    ids = codec.encode(toks, [key], flags_col="is_chosen")
    n = F.size(F.filter("is_chosen", lambda x: x))
    out = ids.withColumn("_n", n).select(
        key, F.slice("input_ids", F.lit(1), F.col("_n")).alias("input_ids_chosen"),
        F.slice("input_ids", F.col("_n") + 1, F.size("input_ids") - F.col("_n")).alias("input_ids_rejected"))
    if discard_long_sample:
        out = out.where(
            (F.size("input_ids_chosen") <= max_seq_len) & (F.size("input_ids_rejected") <= max_seq_len)
        )
    out = truncate(out, max_seq_len, ("input_ids_chosen", "input_ids_rejected"))
    return (
        out.withColumn("attention_mask_chosen", F.array_repeat(F.lit(1), F.size("input_ids_chosen")))
        .withColumn("attention_mask_rejected", F.array_repeat(F.lit(1), F.size("input_ids_rejected"))),
        codec.vocab,
    )


def build_scoring(df: DataFrame, key: str, template=DEFAULT_TEMPLATE, eos: str = EOS_TOKEN,
                  max_length: int = SCORING_MAX_LEN, vocab: DataFrame | None = None, codec=None) -> DataFrame:
    """Scoring prompt → ids truncated to ``max_length`` (op 22); a NULL text is empty."""
    codec = codec_for(codec, vocab)
    rendered = render_scoring_prompt(filled(df, "question", "answer"), template, eos).select(
        key, codec.split(nfc_column("scoring_text")).alias("tokens"))
    ids = codec.learn(rendered).encode(rendered, [key])
    return truncate(ids, max_length, ("input_ids",))


# --- entry points: task dispatch over files, and the epoch-mixing job ------------------

TASK_TYPES = ("zero-pt", "pt", "sft", "dpo", "orpo", "simpo", "reward")


def prepare_training_data(
    spark,
    task_type: str,
    train_file: str | None = None,
    train_file_dir: str | None = None,
    cache_dir: str | None = None,
    max_seq_length: int = DEFAULT_MAX_SEQ_LEN,
    template_name: str = DEFAULT_TEMPLATE,
    discard_long_sample: bool = True,
    batch_size: int = MAP_BATCH_SIZE,
    workers: int | None = None,
    vocab: DataFrame | None = None,
    return_vocab: bool = False,
    codec=None,
):
    """Prepare every input file for ``task_type`` and concatenate them in file order.

    Files: ``train_file`` if given, else ``train_file_dir/*.json*`` (sorted);
    JSON lines or JSON arrays, a malformed line fails the job.  Batching and
    packing scope is the file, but all files go through one job: worker shards
    and map batches are arithmetic on (file, line, lines of the file).

    ``codec``: the tokeniser.  Without one, all files share one vocabulary of
    whole pre-tokens: ``vocab``, or one derived over all of them, which
    ``return_vocab`` hands back for preparing evaluation data.  ``pos`` is dense
    over the result, whatever the filters drop.

    With ``cache_dir``, a run writes the files it prepares as one table and then
    commits each of them in the cache's ledger, under a key of the file's full
    path, length and modification time, the tokeniser and the parameters;
    later runs prepare only files without a commit.
    """
    from tessera.operators.order import index_in_groups
    from tessera.sources import io

    if task_type not in TASK_TYPES:
        raise ValueError(f"unknown task type {task_type!r}; known: {TASK_TYPES}")
    files = [io.qualified(spark, f) for f in io.discover_files(spark, train_file, train_file_dir)]
    if not files:
        raise FileNotFoundError(f"no input files for {train_file or train_file_dir}")
    tokenised = task_type in ("zero-pt", "pt", "sft", "reward")
    schema = (io.PRETRAIN_SCHEMA if task_type in ("zero-pt", "pt") else
              io.SFT_SCHEMA if task_type == "sft" else io.PREFERENCE_SCHEMA)
    codec = codec_for(codec, vocab) if tokenised else None
    if tokenised and codec.vocab is None and schema is io.PRETRAIN_SCHEMA and not cache_dir:
        out, vocab = _learn_and_prepare(spark, files, codec, max_seq_length, batch_size, workers)
        return (out, vocab) if return_vocab else out
    if tokenised and codec.vocab is None:      # one vocabulary over all files, also those prepared before
        raw = io.read_samples(spark, files, schema)
        counted = vocab_table(task_pretokens(raw, task_type, template_name, codec=codec))
        codec = codec_for(None, order_materialise(counted, "vocab"))
    vocab = codec.vocab if tokenised else None

    def prepared(paths: list[str]) -> DataFrame:
        return _prepare_files(spark, task_type, paths, schema, codec, max_seq_length, template_name,
                              discard_long_sample, batch_size, workers)

    if not cache_dir:
        out = prepared(files).withColumn("file_index", F.col("file_index").cast("int"))
        return (out, vocab) if return_vocab else out

    params = dict(task=task_type, max_seq_length=max_seq_length, template=template_name,
                  discard=discard_long_sample, batch_size=batch_size, workers=workers)
    if tokenised:
        params["tokeniser"] = codec.stamp()
    keys = {f: io.params_fingerprint(f, params | {"file": io.file_stamp(spark, f)}) for f in files}
    ledger = io.CacheLedger(spark, cache_dir)
    missing = [f for f in files if keys[f] not in ledger.committed()]
    if missing:
        ledger.commit(prepared(missing), [keys[f] for f in missing])
    union = ledger.read([keys[f] for f in files])
    out = index_in_groups(union.withColumnRenamed("pos", "_run_pos"), ["file_index"], "_run_pos", "pos",
                          first=None).drop("_run_pos")
    return (out, vocab) if return_vocab else out


def _prepare_files(spark, task_type: str, files: list[str], schema, codec, max_seq_length: int, template_name: str,
                   discard_long_sample: bool, batch_size: int, workers: int | None) -> DataFrame:
    """All of ``files`` in one job; ``file_index`` is the place in the list, ``pos`` dense over the result."""
    from tessera.operators.order import (
        assign_file_batches, dense_index, file_batch_count, index_in_groups, number_lines, task_slots)
    from tessera.operators.tokens import lookup
    from tessera.sources import io

    raw = io.with_file_index(io.read_samples(spark, files, schema), files).drop("_file")
    if task_type in ("dpo", "orpo", "simpo"):
        # what is dropped is known line by line: lines are numbered after it
        kept = build_dpo(raw, template_name, max_seq_length).select("file_index", "_start", "prompt", "chosen", "rejected")
        return number_lines(kept, "file_index").select("file_index", "pos", "prompt", "chosen", "rejected")
    rows = number_lines(raw, "file_index").drop("_start")
    keys = ("pos",)
    if task_type == "reward":
        samples = build_reward(rows, "pos", template_name, max_seq_length, discard_long_sample,
                               codec=learned(codec, rows, task_type, template_name, keys=keys))[0]
        samples = order_materialise(samples, "reward-samples")
        index = order_materialise(dense_index(samples.select("pos"), ["pos"], "_out"), "reward-index")
        n = index.count()
        files_of = rows.select("pos", "file_index")
        placed = lookup(samples, index.join(files_of, "pos"), "pos", ["_out", "file_index"], n)
        return placed.drop("pos").withColumnRenamed("_out", "pos")
    codec = learned(codec, rows, task_type, template_name, keys=keys)
    if task_type == "sft":
        by_batch = file_batch_count(rows, batch_size, workers) >= task_slots(spark)
        batched = assign_file_batches(rows, batch_size, workers)
        out = sort_conversations(batched, codec, template_name, max_seq_length, discard_long_sample, by_batch)
        out = out.drop("pos").withColumnRenamed("out_pos", "pos")
    else:
        packed = pack_files(rows, codec, max_seq_length, batch_size, workers, labels=False)
        out = with_labels(index_in_groups(packed, ["shard", "batch"], "chunk", "pos"))
    return file_places(out, workers)


def _learn_and_prepare(spark, files: list[str], codec, max_seq_length: int, batch_size: int,
                       workers: int | None) -> tuple[DataFrame, DataFrame]:
    """Pretraining files and the vocabulary of whole pre-tokens over them: a text is read, normalised and split once.

    A reading task writes its lines' pre-tokens as numbers of its buckets, and each bucket's distinct ones with their
    counts; the vocabulary is counted from those, and its ids go back to the buckets.  Lines read in fewer splits than
    there are task slots are numbered and written first, and dealt out to be split.
    """
    from tessera.operators.order import assign_file_batches, index_in_groups, number_lines, task_slots
    from tessera.operators.tokens import bucket_vocab, encode_numbered, numbered_tokens
    from tessera.sources import io

    def split(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != "text"]
        return numbered_tokens(normalise_nfc(df, "text").select(*others, codec.split("text").alias("tokens")))

    raw = io.read_samples(spark, files, io.PRETRAIN_SCHEMA)
    spread_out = raw.rdd.getNumPartitions() >= task_slots(spark)
    raw = io.with_file_index(raw, files).drop("_file")
    if spread_out:
        rows = number_lines(split(raw), "file_index")
    else:
        rows = order_materialise(split(spread(number_lines(raw, "file_index").drop("_start"), "pos")), "encode-rows")
    vocab = order_materialise(bucket_vocab(rows), "vocab")
    keys = ["shard", "batch", "pos"]
    ids = encode_numbered(assign_file_batches(rows, batch_size, workers), keys, vocab, unk_id=codec.unk_id)
    out = with_labels(index_in_groups(pack(ids, max_seq_length, ("input_ids",)), ["shard", "batch"], "chunk", "pos"))
    return file_places(out, workers).withColumn("file_index", F.col("file_index").cast("int")), vocab


def pack_files(rows: DataFrame, codec, max_seq_len: int, batch_size: int, workers: int | None = None,
               labels: bool = True) -> DataFrame:
    """Lines of ``number_lines`` → packed chunks of every file, ``shard`` counting on over the files (``file_places``)."""
    from tessera.operators.order import assign_file_batches, file_batch_count, task_slots

    by_batch = file_batch_count(rows, batch_size, workers) >= task_slots(rows.sparkSession)
    codec = learned(codec, rows.select("pos", "text"), "pt")
    packed = pack_documents(assign_file_batches(rows, batch_size, workers), codec, max_seq_len, by_batch)
    return with_labels(packed) if labels else packed


def file_places(df: DataFrame, workers: int | None = None) -> DataFrame:
    """``shard`` that counts on over the files as ``file_index`` and the shard in the file."""
    w = max(int(workers or 1), 1)
    return df.withColumn("file_index", F.floor(F.col("shard") / w).cast("int")).withColumn("shard", F.col("shard") % w)


def task_pretokens(raw: DataFrame, task_type: str, template=DEFAULT_TEMPLATE, eos: str = EOS_TOKEN,
                   codec=None) -> DataFrame:
    """``tokens`` of each input row, as the task's tokenising sees them; no exchange."""
    codec = codec_for(codec)
    if task_type in ("zero-pt", "pt"):
        return normalise_nfc(raw.select("text"), "text").select(codec.split("text").alias("tokens"))
    if task_type == "sft":
        return sft_pretokens(raw, template, eos, codec).select("tokens")
    return reward_pretokens(raw, [], template, eos, codec).select("tokens")


def build_mixture(
    spark,
    input_root: str,
    proportion_config: str,
    epochs: int,
    output: str,
    seed: int = 42,
) -> DataFrame:
    """The epoch-mixing job: lines are numbered where they are read, shuffled and mixed by arithmetic
    (``mix_permuted``) and exchanged once, to be written in order.  Sources ``<input_root>/<source>/*.json`` with
    instruction records (validated: one bad line fails the job), a
    ``{source: ratio}`` config, ``epochs`` epochs, written as JSON lines in
    epoch order (shuffled inside each epoch).  Returns the written rows."""
    from pyspark.sql import types as T

    from tessera.operators.mix import mix_permuted
    from tessera.operators.validate import validate_instructions
    from tessera.sources import io

    props = io.read_proportions(spark, proportion_config)
    sources = [r[0] for r in props.select("source").collect()]  # the config: one row per source
    lines_schema = T.StructType([T.StructField("value", T.StringType())])
    files = {s: io.discover_files(spark, directory=f"{input_root.rstrip('/')}/{s}", pattern="*.json") for s in sources}
    missing = [s for s, fs in files.items() if not fs]
    if missing:
        raise FileNotFoundError(f"no *.json files for sources {missing}")
    raw = spark.read.schema(lines_schema).text([f for fs in files.values() for f in fs]) \
        .withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")})
    raw = raw.withColumn("source", io.source_name())
    checked = validate_instructions(raw, "value", mode="fail")
    from tessera.operators.order import number_lines
    from tessera.operators.tokens import lookup

    # a source's files lie together in order of path, so its lines do
    rows = order_materialise(number_lines(checked).select("pos", "source", "value"), "mix-lines")
    io.check_sources(rows, sources)
    first = rows.groupBy("source").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("count"))
    rows = lookup(rows, order_materialise(first, "mix-sources"), "source", ["_first"]).withColumn(
        "at", F.col("pos") - F.col("_first"))
    out = mix_permuted(rows.select("source", "at", "value"), props, epochs, seed).select("out_pos", "value")
    out.repartitionByRange("out_pos").sortWithinPartitions("out_pos").select("value").write.mode("overwrite").text(output)
    return out


def build_sft_from_turns(
    turns: DataFrame,
    template=DEFAULT_TEMPLATE,
    max_seq_len: int = DEFAULT_MAX_SEQ_LEN,
    discard_long_sample: bool = True,
    batch_size: int = MAP_BATCH_SIZE,
    workers: int | None = None,
    eos: str = EOS_TOKEN,
    vocab: DataFrame | None = None,
    key: str = "conv_id",
    return_vocab: bool = False,
    codec=None,
):
    """SFT preparation from flat turns (conv_id, turn, role, text) — same result
    as ``build_sft`` on the grouped conversations, without grouping them first.

    ``pos`` is the dense rank of the conversation's key, whatever its type and
    gaps; the key stays beside it.  Turns without a key take no part.  Every
    conversation counts for the batches and, unless it is too long, comes out,
    also one without a token (only unknown roles).  Of a turn that is there
    more than once the rows follow each other by role and text.

    Every message is rendered and tokenised on its own row.  Per-conversation
    facts (token total, whether a system message exists) are partial
    aggregates, so a conversation holding a large share of all turns never
    lands in one group: with the discard policy it is dropped before any
    per-conversation grouping, and every conversation that is grouped holds
    at most ``max_seq_len`` tokens.  With the truncation policy, turns that
    start beyond ``max_seq_len`` are cut first, using a global running sum
    over the narrow (conversation, turn, length) rows (range-partitioned, so
    no conversation is confined to one task).
    """
    from tessera.functions.templates import format_column, get_template
    from tessera.operators.order import dense_index, running_sum
    from tessera.operators.render import default_system_text
    from tessera.operators.tokens import lookup

    tpl = get_template(template) if isinstance(template, str) else template
    name = tpl.template_name
    content = nfc_column("text")
    if tpl.system_format is None:
        system = F.raise_error(F.lit(f"template {name!r} has no system format but a system message was given"))
    else:
        system = format_column(tpl.system_format, content, None, f"{name}.system_format")
    role = F.col("role")
    rendered = (
        F.when(role == "system", system.cast("string"))
        .when(role == "user", format_column(tpl.user_format, content, eos, f"{name}.user_format"))
        .when(role == "assistant", format_column(tpl.assistant_format, content, eos, f"{name}.assistant_format"))
    )
    turns = turns.where(F.col(key).isNotNull())
    # per conversation: any system message, and its size (partial aggregates: skew-safe)
    convs = turns.groupBy(F.col(key).alias("_key")).agg(
        F.coalesce(F.max((F.col("role") == "system").cast("int")), F.lit(0)).alias("_has_sys"),
        F.count(F.lit(1)).alias("_turns"))
    convs = order_materialise(dense_index(convs, ["_key"], "pos"), "sft-convs")
    n_rows = convs.count()
    rows = _numbered_turns(turns, key).where(role.isin("system", "user", "assistant"))
    msgs = lookup(rows.select(F.col(key).alias("_key"), F.lit(1).alias("_k"), "turn", "_d", "role",
                              rendered.alias("_text")), convs, "_key", ["pos"], n_rows, freq="_turns")
    msgs = msgs.select("pos", "_k", "turn", "_d", "role", "_text")
    block = default_system_text(tpl)
    if block is not None:
        synthetic = convs.where(F.col("_has_sys") == 0).select(
            "pos", F.lit(0).alias("_k"), F.lit(-1).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("_d"),
            F.lit("system").alias("role"), F.lit(block).alias("_text"))
        msgs = msgs.unionByName(synthetic)
    codec = codec_for(codec, vocab)
    place = ["pos", "_k", "turn", "_d"]
    toks = msgs.select(*place, (F.col("role") == "assistant").alias("asst"), codec.split("_text").alias("tokens"))
    # written once (the split is evaluated once); turns without a token contribute nothing
    toks = order_materialise(toks, "sft-turn-tokens").where(F.size("tokens") > 0)
    codec = codec.learn(toks)
    ids = order_materialise(codec.encode(toks, [*place, "asst"]), "sft-turn-ids")
    totals = ids.groupBy("pos").agg(F.sum(F.size("input_ids")).cast("bigint").alias("n"),
                                     F.count(F.lit(1)).alias("_rows"))
    totals = order_materialise(totals, "sft-totals")
    if discard_long_sample:
        # hot conversations resolve through the broadcast side of the lookup
        kept = lookup(ids, totals, "pos", ["n"], freq="_rows").where(F.col("n") <= max_seq_len).drop("n")
    else:
        # where each turn starts inside its conversation: a global running sum over
        # (conversation, turn) order minus the conversation's first value — no
        # per-conversation window, so a huge conversation is spread by range
        narrow = ids.select(*place, F.size("input_ids").cast("bigint").alias("_m"))
        cum = running_sum(narrow, place, "_m", "_g")
        base = cum.groupBy("pos").agg(F.min("_g").alias("_base"), F.count(F.lit(1)).alias("_rows"))
        starts = lookup(cum, base, "pos", ["_base"], freq="_rows").withColumn(
            "_start", F.col("_g") - F.col("_base")).where(F.col("_start") < max_seq_len).select(*place, "_start")
        kept = ids.join(starts, place).withColumn(
            "input_ids", F.slice("input_ids", 1, (F.lit(max_seq_len) - F.col("_start")).cast("int"))).drop("_start")
    labels = F.when(F.col("asst"), F.col("input_ids")).otherwise(
        F.array_repeat(F.lit(IGNORE_INDEX), F.size("input_ids")))
    per_conv = kept.withColumn("labels", labels).groupBy("pos").agg(
        F.array_sort(F.collect_list(F.struct("_k", "turn", "_d", "input_ids", "labels"))).alias("_m"))
    # all conversations with their full lengths, so that those without a token stay
    lengths = convs.select("pos", F.col("_key").alias(key)).join(totals.select("pos", "n"), "pos", "left") \
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    if discard_long_sample:
        lengths = lengths.where(F.col("n") <= max_seq_len)
    none = F.array().cast("array<int>")
    whole = lengths.join(per_conv, "pos", "left").select(
        "pos", key, "n",
        F.coalesce(F.flatten(F.transform("_m", lambda m: m["input_ids"])), none).alias("input_ids"),
        F.coalesce(F.flatten(F.transform("_m", lambda m: m["labels"])), none).alias("labels"))
    batched = assign_map_batches(whole, batch_size, workers, n_rows=n_rows)
    out = truncate(sort_by_length(batched, "n"), max_seq_len)
    return (out, codec.vocab) if return_vocab else out


def _numbered_turns(turns: DataFrame, key: str) -> DataFrame:
    """``_d``: place among the rows of the same (conversation, turn), by role and text; 0 where there is one.

    Repeated turns are looked for on narrow rows; only they go through a window.
    """
    one = F.lit(0).cast("bigint").alias("_d")
    cols = [F.col(key), F.col("turn").cast("bigint").alias("turn"), "role", "text"]
    turns = turns.select(*cols)
    again = order_materialise(turns.groupBy(key, "turn").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"), "sft-repeats")
    if again.isEmpty():
        return turns.select("*", one)
    marked = turns.join(again.select(key, F.col("turn"), F.lit(True).alias("_again")), [key, "turn"], "left")
    by = Window.partitionBy(key, "turn").orderBy("role", "text")
    repeated = marked.where("_again").drop("_again").withColumn("_d", (F.row_number().over(by) - 1).cast("bigint"))
    return marked.where("_again is null").drop("_again").select("*", one).unionByName(repeated)


def order_materialise(df: DataFrame, label: str) -> DataFrame:
    from tessera.operators.order import materialise_scratch

    return materialise_scratch(df, label)
