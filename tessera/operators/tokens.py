"""Tokenisation as corpus jobs (ops 25-30).

* ``pretokenise``   — one ``regexp_extract_all`` per row, JVM side, no shuffle.
* ``vocab_table``   — explode → ``groupBy(token).count()`` (map-side partial
  counts) → dense id by (count desc, token asc) through ``dense_index``.
* ``encode_tokens`` — explode with position → equi-join the vocabulary
  (broadcast, below a checked row count) → regroup per row with an ordered
  ``collect_list``; beyond the bound, ``encode_by_bucket``.
* ``decode_ids``    — the inverse join, ordered concat.
* ``normalise_nfc`` — ICU's NFC through ``reflect`` (JVM-side); an Arrow UDF
  fallback gated by a rule-built class of NFC-unstable characters.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import col
from tessera.functions.fixed import (
    FULL_PRETOKEN_PATTERN,
    MARKER_PATTERN,
    PORTABLE_PRETOKEN_PATTERN,
    SPECIAL_TOKENS,
)
from tessera.operators.order import dense_index, materialise_scratch

# tables up to this many rows are broadcast to the join (a token, an id and a hash entry: some 20 MB an executor)
BROADCAST_VOCAB_ROWS = 250_000
# beyond it, rows are encoded in buckets of about this many pre-tokens
BUCKET_TOKENS = 2_000_000
# with a shuffled table, this many most frequent entries still go through a broadcast
HOT_ROWS = 100_000
# spread of the salt that keeps already-resolved (hot) rows off a single shuffle partition
SALT_BUCKETS = 4096


def pretoken_pattern(profile: str = "portable") -> str:
    if profile == "portable":
        return PORTABLE_PRETOKEN_PATTERN
    if profile == "full":
        return "(?U)" + FULL_PRETOKEN_PATTERN
    raise ValueError(f"unknown pre-token profile {profile!r}")


# a special marker, or a maximal run of text that does not start a marker
SEGMENT_PATTERN = f"{MARKER_PATTERN}|(?:(?!{MARKER_PATTERN})[\\s\\S])+"
MARKER_OPENING, MARKER_END = "<|", "|>"
# the markers by what lies between their common ends: found faster
MARKER_CORE = r"<\|(?:" + "|".join(m.removeprefix(MARKER_OPENING).removesuffix(MARKER_END) for m in SPECIAL_TOKENS) + r")\|>"


def pretokens(text, profile: str = "portable", markers: bool = False) -> Column:
    """Column: array of pre-tokens of ``text`` (empty array for empty text).

    With ``markers`` the special markers are split out first and kept whole;
    each text segment between them is pre-tokenised on its own (so no
    pattern branch can run across a marker).
    """
    pat = F.lit(pretoken_pattern(profile))
    plain = F.regexp_extract_all(col(text), pat, 0)
    if not markers:
        return plain
    def each(segments):
        return F.flatten(F.transform(segments, lambda s: F.when(s.isin(*SPECIAL_TOKENS), F.array(s))
                                     .otherwise(F.regexp_extract_all(s, pat, 0))))

    # markers are set apart by NUL and the text is cut there; one that holds NUL itself is cut by a slower pattern
    marked = each(F.split(F.regexp_replace(col(text), f"({MARKER_CORE})", "\u0000$1\u0000"), "\u0000"))
    with_nul = each(F.regexp_extract_all(col(text), F.lit(SEGMENT_PATTERN), 0))
    # every marker opens the same way; a text without that has nothing to split out
    return F.when(~F.contains(col(text), F.lit(MARKER_OPENING)), plain).when(
        F.contains(col(text), F.lit("\u0000")), with_nul).otherwise(marked)


def pretokenise(df: DataFrame, text_col: str = "text", out: str = "tokens", profile: str = "portable",
                markers: bool = False) -> DataFrame:
    return df.withColumn(out, pretokens(text_col, profile, markers))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@functools.lru_cache(maxsize=1)
def nfc_unstable_class() -> str:
    """Java regex class covering every character that can make NFC change a string.

    Built by rule from ``unicodedata``: characters whose own NFC differs,
    characters with a non-zero combining class (reordering), the second
    character of every two-character canonical decomposition (composition
    partners) and the Hangul vowel / trailing jamo (algorithmic composition).
    Most of them are marks, tested by ``\\p{M}`` (one table lookup in Java);
    the rest become a few ranges (gaps up to 16 merged, a harmless superset);
    ``\\p{Cn}`` adds whatever the JVM's older Unicode tables leave unassigned.
    A string without any of them is already NFC.
    """
    unstable = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
            unstable.add(cp)
        dec = unicodedata.decomposition(ch)
        if dec and not dec.startswith("<"):
            parts = dec.split()
            if len(parts) == 2:
                unstable.add(int(parts[1], 16))
    rest = sorted(cp for cp in unstable if not unicodedata.category(chr(cp)).startswith("M"))
    ranges: list[list[int]] = []
    for cp in rest:
        if ranges and cp - ranges[-1][1] <= 16:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    # \p{Cn}: characters the JVM's (older) Unicode tables do not know go to Python too
    return f"[\\p{{M}}\\p{{Cn}}{body}]"


def nfc_unstable(text) -> Column:
    """JVM-side test: may NFC change this string?  Pure-ASCII strings short-circuit."""
    c = col(text)
    return ~c.rlike("^[\\x00-\\x7F]*$") & c.rlike(nfc_unstable_class())


# ICU4J ships with Spark 4 (collation support); its static composer is NFC.
ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"


def nfc_column(text, engine: str = "jvm") -> Column:
    """NFC of a string column.

    ``engine='jvm'`` (default): ICU's composer through the built-in
    ``reflect`` function — JVM-side, no Python, and it leaves the plan's
    partitioning intact (a Python eval node would hide it and force extra
    exchanges downstream).  Pure-ASCII rows skip the call.
    ``engine='python'``: ``unicodedata`` in an Arrow UDF; rows without any
    NFC-unstable character (checked JVM-side) pass NULL to it, so only
    unstable rows' text crosses to Python.
    """
    c = col(text)
    if engine == "jvm":
        composed = F.call_function("reflect", F.lit(ICU_NORMALIZER), F.lit("compose"), c, F.lit(False))
        return F.when(c.isNull() | c.rlike("^[\\x00-\\x7F]*$"), c).otherwise(composed)
    if engine == "python":
        return F.coalesce(_nfc(F.when(nfc_unstable(c), c)), c)
    raise ValueError(f"unknown NFC engine {engine!r}")


def normalise_nfc(df: DataFrame, text_col: str = "text", engine: str = "jvm") -> DataFrame:
    """Unicode NFC (op 25), applied before any pre-tokenising."""
    return df.withColumn(text_col, nfc_column(text_col, engine))


def normalise_nfc_nested(df: DataFrame, nested_col: str) -> DataFrame:
    """NFC of every string inside a nested column (e.g. conversations).

    The value is serialised with ``to_json``, normalised JVM-side and read
    back with ``from_json`` (pure-ASCII rows skip the round trip).  Exact:
    JSON syntax characters are starters that never compose, so NFC of the
    JSON text equals the JSON of the NFC'd strings.
    """
    c = col(nested_col)
    dtype = df.schema[nested_col].dataType
    js = F.to_json(c)
    return df.withColumn(
        nested_col, F.when(js.rlike("^[\\x00-\\x7F]*$"), c).otherwise(F.from_json(nfc_column(js), dtype))
    )


def explode_items(df: DataFrame, array_col: str, name: str) -> DataFrame:
    """One row per array element.

    ``explode`` would let Catalyst infer ``size(array) > 0`` as a filter and
    push it below earlier operators (down to the scan), evaluating the regex
    that builds the array twice, once before any repartition.  ``explode_outer``
    plus a null filter above the generator keeps one evaluation.
    """
    return df.select(F.explode_outer(col(array_col)).alias(name)).where(F.col(name).isNotNull())


def vocab_table(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, id, count): dense ids by descending count, ties by token (byte order)."""
    counts = (
        explode_items(df, tokens_col, "token")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _ranked(counts)


def _ranked(counts: DataFrame) -> DataFrame:
    return dense_index(counts, [F.col("count").desc(), F.col("token")], "id").select(
        "token", F.col("id").cast("int").alias("id"), F.col("count").cast("bigint").alias("count")
    )


def vocab_size(vocab: DataFrame) -> int:
    return int(vocab.count())


def lookup(occ: DataFrame, table: DataFrame, key: str, values: list[str], size: int | None = None,
           freq: str | None = "count") -> DataFrame:
    """Left equi-join of occurrence rows to a table with a unique ``key``.

    * table of at most ``BROADCAST_VOCAB_ROWS`` rows (checked): broadcast join;
    * larger: the most frequent keys are resolved by a broadcast join first
      (``id`` is the frequency rank where there is one, so ``id < HOT_ROWS``
      finds them without a sort; else a frequency above ``total / HOT_ROWS``,
      which at most ``HOT_ROWS`` keys can have); the rest shuffle-join on
      (flag, key), where rows already resolved, and rows without a key, carry a
      salt made of the whole row instead of their key.
    """
    if size is None:
        size = vocab_size(table)
    side = table.select(key, *values)
    if size <= BROADCAST_VOCAB_ROWS:
        return occ.join(F.broadcast(side), key, "left")
    if "id" in (key, *values):
        hot = table.where(F.col("id") < HOT_ROWS)
    elif freq in table.columns:
        total = table.agg(F.coalesce(F.sum(freq), F.lit(0))).first()[0]
        hot = table.where(F.col(freq) > total / HOT_ROWS)
    else:
        return occ.join(side, key, "left")  # unique on both sides but for AQE's skew split
    hot = hot.select(key, *[F.col(v).alias(f"_hot_{v}") for v in values])
    row = F.xxhash64(*[F.col(c) for c in occ.columns])
    staged = occ.join(F.broadcast(hot), key, "left")
    settled = F.col(f"_hot_{values[0]}").isNotNull() | F.col(key).isNull()
    staged = staged.withColumn("_jk_flag", settled.cast("int")).withColumn(
        "_jk", F.when(settled, F.pmod(row, F.lit(SALT_BUCKETS)).cast("string")).otherwise(F.col(key).cast("string"))
    )
    cold = side.select(F.lit(0).alias("_jk_flag"), F.col(key).cast("string").alias("_jk"),
                       *[F.col(v).alias(f"_cold_{v}") for v in values])
    joined = staged.join(cold, ["_jk_flag", "_jk"], "left")
    for v in values:
        joined = joined.withColumn(v, F.coalesce(F.col(f"_hot_{v}"), F.col(f"_cold_{v}")))
    return joined.drop("_jk_flag", "_jk", *[f"_hot_{v}" for v in values], *[f"_cold_{v}" for v in values])


def encode_tokens(
    df: DataFrame,
    key_cols: list[str],
    vocab: DataFrame,
    tokens_col: str = "tokens",
    out: str = "input_ids",
    unk_id: int | None = None,
    flags_col: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """Map every pre-token to its id, keeping order.  Rows with no tokens get [].

    ``flags_col`` (optional boolean array aligned with the tokens) is carried
    through and returned as ``<flags_col>`` aligned with the ids.
    Unknown tokens take ``unk_id``; without one they raise.
    """
    if size is None:
        size = vocab_size(vocab)
    if size > BROADCAST_VOCAB_ROWS:
        return encode_by_bucket(df, key_cols, vocab, tokens_col, out, unk_id, flags_col)
    carried = [flags_col] if flags_col else []
    ex = df.select(*key_cols, *carried, F.posexplode_outer(col(tokens_col)).alias("_i", "token"))
    if flags_col:
        ex = ex.withColumn("_f", F.col(flags_col)[F.col("_i")]).drop(flags_col)
    joined = lookup(ex, vocab, "token", ["id"], size)
    if unk_id is not None:
        idc = F.coalesce(F.col("id"), F.lit(unk_id))
    else:
        idc = F.when(F.col("token").isNotNull() & F.col("id").isNull(),
                     F.raise_error(F.concat(F.lit("token not in vocabulary: "), F.col("token")))).otherwise(F.col("id"))
    fields = [F.col("_i"), idc.cast("int").alias("id")]
    if flags_col:
        fields.append(F.col("_f").alias("f"))
    item = F.when(F.col("_i").isNotNull(), F.struct(*fields))
    grouped = joined.groupBy(*key_cols).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    res = grouped.withColumn(out, F.transform("_s", lambda x: x["id"]))
    if flags_col:
        res = res.withColumn(flags_col, F.transform("_s", lambda x: x["f"]))
    return res.drop("_s")


def encode_by_bucket(df: DataFrame, key_cols: list[str], vocab: DataFrame, tokens_col: str = "tokens",
                     out: str = "input_ids", unk_id: int | None = None, flags_col: str | None = None) -> DataFrame:
    """``encode_tokens`` for a vocabulary too large to broadcast: no occurrence meets it.

    A task cuts its rows into buckets of at most ``BUCKET_TOKENS`` pre-tokens (a
    longer row is one), writes each row's pre-tokens as numbers of its bucket
    and each bucket's distinct pre-tokens once.  Those meet the vocabulary;
    their ids go back to the bucket, whose rows exchange numbers for ids.
    """
    carried = [flags_col] if flags_col else []
    rows, pairs = _numbered(df.select(*key_cols, *carried, F.col(tokens_col).alias("_t")))
    return _looked_up(rows, pairs, [*key_cols, *carried], vocab, out, unk_id)


def numbered_tokens(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``df`` with its pre-tokens as numbers of their bucket, for ``bucket_vocab`` and ``encode_numbered``.

    Not written yet: what reads it has to write it first, once.
    """
    return _number(df.select(*[c for c in df.columns if c != tokens_col], F.col(tokens_col).alias("_t")), counted=True)


def bucket_vocab(rows: DataFrame) -> DataFrame:
    """``vocab_table`` of written ``numbered_tokens``: buckets' counts are summed, no occurrence is exploded."""
    held = rows.where(F.col("_words").isNotNull()).select(F.inline(F.arrays_zip("_words", "_counts")))
    return _ranked(held.groupBy(F.col("_words").alias("token")).agg(F.sum("_counts").alias("count")))


def encode_numbered(rows: DataFrame, key_cols: list[str], vocab: DataFrame, out: str = "input_ids",
                    unk_id: int | None = None) -> DataFrame:
    """``encode_by_bucket`` of written ``numbered_tokens``."""
    return _looked_up(rows.select(*key_cols, "_b", "_codes"), _pairs(rows), key_cols, vocab, out, unk_id)


def _looked_up(rows: DataFrame, pairs: DataFrame, kept: list[str], vocab: DataFrame, out: str,
               unk_id: int | None) -> DataFrame:
    """Rows of numbers (``_b``, ``_codes``) with ids in their place."""
    known = _resolved(pairs, vocab, "token", "id")
    missing = F.lit(unk_id).cast("int") if unk_id is not None else F.raise_error(
        F.concat(F.lit("token not in vocabulary: "), F.col("_item"))).cast("int")
    known = known.select(F.col("_b").alias("_of"), "_c", F.coalesce(F.col("_value").cast("int"), missing).alias("id"))
    # as they were read back: flags of an array that holds no NULL are nullable there
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def look_up(held: pa.Table, dictionary: pa.Table) -> pa.Table:
        ids = np.zeros(len(dictionary), np.int32)
        ids[dictionary["_c"].to_numpy()] = dictionary["id"].to_numpy()
        codes = held["_codes"].combine_chunks()
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))]), pa.int32()),
            pa.array(ids[codes.flatten().to_numpy(zero_copy_only=False)]))
        return held.select(kept).append_column(out, lists)

    return rows.groupBy("_b").cogroup(known.groupBy("_of")).applyInArrow(look_up, schema)


def _numbered(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose last column, ``_t``, is an array: the rows with its items as numbers of their bucket (``_b``,
    ``_codes``), and each bucket's distinct items (``_b``, ``_c``, ``_item``)."""
    rows = materialise_scratch(_number(source), "encode-rows")
    return rows.drop("_words"), _pairs(rows)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_words").isNotNull()).select("_b", F.posexplode("_words").alias("_c", "_item"))


def _number(source: DataFrame, counted: bool = False) -> DataFrame:
    """``_numbered`` rows before they are written; with ``counted``, how often its bucket has each of ``_words``."""
    fields, items = source.schema.fields[:-1], source.schema["_t"].dataType
    written = T.StructType([*fields, T.StructField("_b", T.LongType()), T.StructField("_codes", T.ArrayType(T.IntegerType())),
                            T.StructField("_words", T.ArrayType(items.elementType))])
    if counted:
        written.add("_counts", T.ArrayType(T.LongType()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = batch.column(len(fields)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            at = 0
            while at < len(batch):
                begin = int(ends[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(ends, begin + BUCKET_TOKENS, side="right")))
                part = batch.slice(at, end - at)
                found = part.column(len(fields)).flatten().dictionary_encode()
                offsets = pa.array(np.concatenate([[0], ends[at:end] - begin]), pa.int32())
                here = pa.array([0] + [None] * (len(part) - 1), pa.int32())

                def on_first(values: pa.Array) -> pa.Array:            # a list on the first row of the bucket
                    return pa.ListArray.from_arrays(
                        pa.array([0] + [len(values)] * len(part), pa.int32()), values).take(here)  # noqa: B023

                columns = [*part.columns[:len(fields)], pa.array(np.full(len(part), bucket)),
                           pa.ListArray.from_arrays(offsets, found.indices.cast(pa.int32())), on_first(found.dictionary)]
                if counted:
                    codes = found.indices.drop_null().to_numpy(zero_copy_only=False)
                    columns.append(on_first(pa.array(np.bincount(codes, minlength=len(found.dictionary)), pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=written.names)
                bucket += 1
                at = end

    return source.mapInArrow(number, written)


def _resolved(pairs: DataFrame, vocab: DataFrame, key: str, value: str) -> DataFrame:
    """Buckets' distinct items with their ``_value`` in the vocabulary, NULL where it has none.

    Frequent entries, which are in many buckets, meet a broadcast; what is left meets the rest of the vocabulary.
    """
    hot = vocab.where(F.col("id") < HOT_ROWS).select(F.col(key).alias("_item"), F.col(value).alias("_hot"))
    staged = pairs.join(F.broadcast(hot), "_item", "left")
    cold = vocab.where(F.col("id") >= HOT_ROWS).select(F.col(key).alias("_item"), F.col(value).alias("_value"))
    rest = staged.where(F.col("_hot").isNull()).select("_b", "_c", "_item").join(cold, "_item", "left")
    return staged.where(F.col("_hot").isNotNull()).select("_b", "_c", "_item", F.col("_hot").alias("_value")).unionByName(
        rest.select("_b", "_c", "_item", "_value"))


def decode_ids(df: DataFrame, key_cols: list[str], vocab: DataFrame, ids_col: str = "input_ids",
               out: str = "text", sep: str = "", size: int | None = None) -> DataFrame:
    """ids → text by joining the vocabulary and concatenating tokens in order."""
    if size is None:
        size = vocab_size(vocab)
    if size > BROADCAST_VOCAB_ROWS:
        return decode_by_bucket(df, key_cols, vocab, ids_col, out, sep)
    ex = df.select(*key_cols, F.posexplode_outer(col(ids_col)).alias("_i", "id"))
    joined = lookup(ex, vocab, "id", ["token"], size)
    item = F.when(F.col("_i").isNotNull(), F.struct("_i", F.coalesce(F.col("token"), F.lit("")).alias("t")))
    return (
        joined.groupBy(*key_cols)
        .agg(F.array_sort(F.collect_list(item)).alias("_s"))
        .withColumn(out, F.array_join(F.transform("_s", lambda x: x["t"]), sep))
        .drop("_s")
    )


def decode_by_bucket(df: DataFrame, key_cols: list[str], vocab: DataFrame, ids_col: str = "input_ids",
                     out: str = "text", sep: str = "") -> DataFrame:
    """``decode_ids`` for a vocabulary too large to broadcast: a bucket's distinct ids meet it, no occurrence does."""
    rows, pairs = _numbered(df.select(*key_cols, F.col(ids_col).cast("array<int>").alias("_t")))
    known = _resolved(pairs, vocab, "id", "token").select(
        F.col("_b").alias("_of"), "_c", F.coalesce("_value", F.lit("")).alias("token"))
    schema = T.StructType([*[rows.schema[c] for c in key_cols], T.StructField(out, T.StringType())])

    def look_up(held: pa.Table, dictionary: pa.Table) -> pa.Table:
        places = np.argsort(dictionary["_c"].to_numpy())
        tokens = pa.concat_arrays([dictionary["token"].combine_chunks().take(pa.array(places)), pa.array([""])])
        codes = held["_codes"].combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens.take(codes.flatten().fill_null(len(places))))
        return held.select(key_cols).append_column(out, pc.binary_join(lists, sep))

    return rows.groupBy("_b").cogroup(known.groupBy("_of")).applyInArrow(look_up, schema)
