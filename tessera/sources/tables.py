"""Driver tables and the fixtures derived from them by Spark.

Every fixture is a Spark job over the given parquet tables, so its work grows
with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import seeded_hash
from tessera.functions.fixed import DEFAULT_SEED
from tessera.operators.order import dense_index, materialise_scratch

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# FIXED VALUES (ours): mixing ratios assigned to sources in name order, cycling
MIX_RATIO_CYCLE = (0.0, 0.25, 0.29, 0.5, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pretrain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretraining text: ``pos`` = doc_id (dense from 0, the arrival order)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("pos"), "text")


def marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretraining text that holds special markers: every document's text, an end-of-text
    marker, its source's name and an end-of-message marker."""
    from tessera.functions.fixed import ENDOFTEXT, IM_END

    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("bigint").alias("pos"),
                       F.concat("text", F.lit(ENDOFTEXT), "source", F.lit(IM_END)).alias("text"))


def json_files(rows: DataFrame, order_col: str, cols: list[str], per_file: int, label: str) -> str:
    """``rows`` as compressed JSON-lines files of ``per_file`` consecutive ``order_col`` values each, lines in
    that order, under the checkpoint folder; returns the pattern of the files' folders."""
    import uuid

    from tessera.session import checkpoint_dir

    root = f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    bucket = F.lpad(F.floor(F.col(order_col) / per_file).cast("string"), 12, "0")
    (rows.select(bucket.alias("bucket"), order_col, *cols).repartition("bucket").sortWithinPartitions("bucket", order_col)
     .select("bucket", *cols).write.partitionBy("bucket").option("compression", "gzip").json(root))
    return f"{root}/bucket=*"


def public_tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.json"):
    """The codec of an installed public byte-level tokeniser file."""
    from tessera.operators.codec import read_tokenizer_json

    return read_tokenizer_json(spark, f"file://{public_tokenizer_path(name)}")


def public_tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def flat_turns_to_conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) rows → one row per conversation holding
    ``conversations ARRAY<STRUCT<role, content>>`` in turn order (op 24)."""
    return (
        turns.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
        .select(
            F.col(key).cast("bigint").alias("pos"),
            F.transform("_t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias(
                "conversations"
            ),
        )
    )


def sft_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_turns_to_conversations(table(spark, sf_dir, "conversations"))


def preference_pairs(spark: SparkSession, sf_dir: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """(pair_id, conv_id, turn, question, response_chosen, response_rejected).

    A user turn t and the assistant turn t+1 of the same conversation form a
    pair; the rejected answer is the chosen answer of the next pair in
    md5(seed:conv_id:turn) order; the last pair in that order has none and is dropped.
    """
    c = table(spark, sf_dir, "conversations")
    users = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answers = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_chosen")
    )
    pairs = users.join(answers, ["conv_id", "turn"]).withColumn("_k", seeded_hash(seed, "conv_id", "turn"))
    ranked = dense_index(pairs, ["_k", "conv_id", "turn"], "pair_id").drop("_k")
    nxt = ranked.select((F.col("pair_id") - 1).alias("pair_id"), F.col("response_chosen").alias("response_rejected"))
    return ranked.join(nxt, "pair_id").select(
        "pair_id", "conv_id", "turn", "question", "response_chosen", "response_rejected"
    )


def instruction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records from the pairs: instruction = question, input = '', output = chosen."""
    return preference_pairs(spark, sf_dir).select(
        F.col("pair_id").alias("id"),
        F.col("question").alias("instruction"),
        F.lit("").alias("input"),
        F.col("response_chosen").alias("output"),
    )


VOWELS = "aeiou"


def letter_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit arrays as a classifier's head would give them, one per document: how often each vowel
    occurs, over 10 and less 3 (large for long texts); ``label`` is an integer class, -100 for none;
    ``targets`` are multi-hot."""
    docs = table(spark, sf_dir, "documents")
    count = lambda v: F.length("text") - F.length(F.replace(F.col("text"), F.lit(v), F.lit("")))
    bit = lambda i: (F.floor(F.col("doc_id") / (1 << i)) % 2).cast("int")
    k = (F.col("n_chars") % (len(VOWELS) + 1)).cast("int")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.array(*[count(v).cast("double") / 10 - 3 for v in VOWELS]).alias("logits"),
        F.when(k < len(VOWELS), k).otherwise(-100).alias("label"),
        F.array(*[bit(i) for i in range(len(VOWELS))]).alias("targets"))


def instruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value): instruction records as JSON lines, most of them as they are, others by their id
    with a key missing, with an output that is empty, null or another kind of value, or cut off."""
    recs = instruction_records(spark, sf_dir)
    rest = F.to_json(F.struct("instruction", "input"))
    whole = F.to_json(F.struct("instruction", "input", "output"))
    with_output = lambda js: F.concat(F.expr("left(_r, length(_r) - 1)"), F.lit(f',"output":{js}}}'))
    kinds = ['""', "null", "0", '"0"', "0.0", "false", "true", "[]", "[0]", "{}", '{"a":null}', "-1"]
    kind = F.col("id") % (2 * len(kinds) + 4)
    value = F.when(kind == 0, rest).when(kind == 1, F.expr("left(_w, length(_w) - 5)")).when(
        kind == 2, F.to_json(F.struct("input", "output"))).when(kind == 3, F.concat(F.lit("["), F.col("_w"), F.lit("]")))
    for i, js in enumerate(kinds):
        value = value.when(kind == 4 + i, with_output(js))
    return recs.withColumns({"_r": rest, "_w": whole}).select("id", value.otherwise(F.col("_w")).alias("value"))


def mix_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, proportions): documents tagged by source, and a ratio per source
    cycling through ``MIX_RATIO_CYCLE`` in source-name order."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("bigint").alias("id"), "text")
    sources = docs.select("source").distinct()
    ranked = dense_index(sources, ["source"], "_k")
    cycle = F.array(*[F.lit(float(r)) for r in MIX_RATIO_CYCLE])
    props = ranked.select(
        "source", F.element_at(cycle, (F.col("_k") % len(MIX_RATIO_CYCLE) + 1).cast("int")).alias("ratio")
    )
    return docs, props


def _unigram_logp(counts: DataFrame):
    """(token, logp) of an add-one unigram model over (token, c) counts,
    ln((c + 1) / (N + V)), and the floor ln(1 / (N + V)) for unseen tokens
    (N, V are scalar subqueries over the small, materialised count table)."""
    denom = counts.select(F.sum("c") + F.count(F.lit(1))).scalar()
    return counts.select("token", "c", F.log((F.col("c") + 1) / denom).alias("logp")), F.log(F.lit(1.0) / denom)


def token_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-token log-prob table for the preference metrics (ops 52-59).

    One sequence per (pair, side): the question's portable tokens (label -100)
    followed by the response's tokens (label = token length, i.e. supervised).
    ``logp`` comes from a unigram model of assistant turns (the "policy"),
    ``ref_logp`` from one of all turns (the "reference"); unseen tokens get
    the add-one floor.  Columns: seq_id, pair_id, side, tok_pos, label, logp, ref_logp.
    """
    from tessera.operators.tokens import pretokens

    conv = table(spark, sf_dir, "conversations")
    all_tokens = conv.select("role", F.explode_outer(pretokens("text")).alias("token")).where(F.col("token").isNotNull())
    # one regex pass over the conversations: counts per (token, is-assistant), written once
    by_role = materialise_scratch(
        all_tokens.groupBy("token", (F.col("role") == "assistant").alias("asst")).agg(F.count(F.lit(1)).alias("c")),
        "unigram-counts",
    )
    policy, pol_floor = _unigram_logp(by_role.where("asst").select("token", "c"))
    reference, ref_floor = _unigram_logp(by_role.groupBy("token").agg(F.sum("c").alias("c")))
    pairs = preference_pairs(spark, sf_dir)
    sides = pairs.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(F.lit("chosen").alias("side"), F.lit(0).alias("k"), F.col("response_chosen").alias("resp")),
                F.struct(F.lit("rejected").alias("side"), F.lit(1).alias("k"), F.col("response_rejected").alias("resp")),
            )
        ).alias("s"),
        pretokens("question").alias("q"),
    ).select("pair_id", "s.side", "s.k", "q", pretokens("s.resp").alias("a"))
    seq = sides.select(
        (F.col("pair_id") * 2 + F.col("k")).cast("bigint").alias("seq_id"),
        "pair_id",
        "side",
        F.concat("q", "a").alias("tokens"),
        F.concat(
            F.array_repeat(F.lit(-100), F.size("q")), F.transform("a", lambda t: F.length(t))
        ).alias("labels"),
    )
    tok = seq.select(
        "seq_id", "pair_id", "side", F.posexplode("tokens").alias("tok_pos", "token"), "labels"
    ).select("seq_id", "pair_id", "side", F.col("tok_pos").cast("bigint").alias("tok_pos"), "token",
             F.col("labels")[F.col("tok_pos")].cast("int").alias("label"))
    # the unigram tables grow with the corpus: size-checked broadcast, else a
    # hot/cold split so frequent tokens never meet in one shuffle partition
    from tessera.operators.tokens import lookup

    pol = policy.select("token", "c", F.col("logp").alias("_p"))
    ref = reference.select("token", "c", F.col("logp").alias("_r"))
    joined = lookup(tok, pol, "token", ["_p"], freq="c")
    joined = lookup(joined, ref, "token", ["_r"], freq="c")
    return (
        joined
        .select(
            "seq_id", "pair_id", "side", "tok_pos", "label",
            F.coalesce(F.col("_p"), pol_floor).alias("logp"),
            F.coalesce(F.col("_r"), ref_floor).alias("ref_logp"),
        )
    )


def word_counts(tokens: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, c): distinct pre-tokens with their counts (map-side partial counts)."""
    from tessera.operators.tokens import explode_items

    return explode_items(tokens, tokens_col, "token").groupBy("token").agg(F.count(F.lit(1)).alias("c"))


def bpe_tables(words: DataFrame, num_merges: int) -> tuple[DataFrame, DataFrame]:
    """Enabling fixture for op 28 (the tokeniser files are not shipped):
    (merges, vocab) from one pass of adjacent byte-symbol pair counts over
    ``words`` (token, c) — see ``word_counts``.

    merges = the ``num_merges`` most frequent adjacent pairs (ties by symbols),
    ranked in that order; vocab = the 256 byte symbols (ids 0-255 in byte
    order), then one merged symbol per merge (256 + rank), then the special
    markers.  Files of a tokeniser are read by ``operators.codec``.
    """
    from pyspark.sql import Window

    from tessera.functions.fixed import SPECIAL_TOKENS
    from tessera.operators.bpe import byte_alphabet, symbols_column

    spark = words.sparkSession
    sym = words.select(symbols_column("token").alias("s"), "c").withColumn("_m", F.size("s") - 1)
    pairs = sym.select(
        F.explode(F.zip_with(F.slice("s", 1, F.col("_m")), F.slice("s", 2, F.col("_m")),
                             lambda a, b: F.struct(a.alias("left"), b.alias("right")))).alias("p"), "c"
    ).groupBy("p.left", "p.right").agg(F.sum("c").alias("n"))
    # the merge-table size is the feature: a top-k (per-partition partial top-k)
    top = materialise_scratch(pairs.orderBy(F.col("n").desc(), "left", "right").limit(int(num_merges)), "bpe-pairs")
    merges = top.withColumn(
        "rank", (F.row_number().over(Window.orderBy(F.col("n").desc(), "left", "right")) - 1).cast("int")
    ).select("left", "right", "rank")  # bounded by num_merges rows
    alphabet = byte_alphabet()
    base = spark.createDataFrame([(alphabet[b], b) for b in range(256)], "token string, id int")
    merged = merges.select(F.concat("left", "right").alias("token"), (F.col("rank") + 256).cast("int").alias("id"))
    special = spark.createDataFrame(
        [(t, 256 + int(num_merges) + j) for j, t in enumerate(SPECIAL_TOKENS)], "token string, id int")
    return merges, base.unionByName(merged).unionByName(special)
