"""One tokeniser for every preparation task (ops 26-32).

A codec knows how texts are split and how the pieces become ids:

* ``split(text)``  — column: the pre-tokens of a text, special markers kept
  whole (one pattern finds them, in pretraining text as in rendered messages);
* ``learn(tokens)`` — a codec fit for the given pre-tokens: what has to be known
  about the corpus before rows can be encoded;
* ``encode(df)``   — ids of the pre-token arrays, with flags aligned on request;
* ``decode(df)``   — texts of ids.

``PortableCodec`` looks whole pre-tokens up in a vocabulary (given, or counted
over the corpus).  ``ByteLevelCodec`` is the byte-level BPE tokeniser of a
vocabulary and a merge table: read from ``vocab.json`` and ``merges.txt``
(``read_tokenizer``) or from one combined JSON file (``read_tokenizer_json``).

The portable codec's vocabulary can be as large as the corpus makes it, so
pre-tokens meet it in a join.  Counting it reads the texts where they lie
(map-side combined); only the pass that encodes exchanges them.  The byte-level
codec's tables are bounded by their files and broadcast: rows are encoded in
place and nothing but ids is exchanged, when they are batched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.fixed import SPECIAL_TOKENS
from tessera.operators.bpe import attach_ids, decode_in_place, shared_tables, table_values
from tessera.operators.order import materialise_scratch
from tessera.operators.tokens import (
    BROADCAST_VOCAB_ROWS, decode_ids, encode_tokens, pretokens, vocab_size, vocab_table)
from tessera.sources.io import table_stamp


@dataclass(frozen=True)
class PortableCodec:
    """Vocabulary lookup of whole pre-tokens; without a vocabulary, ``learn`` counts one."""

    vocab: DataFrame | None = None
    unk_id: int | None = None
    profile: str = "portable"
    size: int | None = None      # rows of the vocabulary, where known

    @property
    def in_place(self) -> bool:
        """A vocabulary that is not broadcast meets rows in buckets: dealing texts out before is of no use."""
        return self.size is not None and self.size > BROADCAST_VOCAB_ROWS

    def split(self, text) -> Column:
        return pretokens(text, self.profile, markers=True)

    def learn(self, tokens: DataFrame, tokens_col: str = "tokens") -> PortableCodec:
        if self.vocab is not None:
            return self
        vocab = vocab_table(tokens, tokens_col)
        return replace(self, vocab=vocab, size=vocab_size(vocab))

    def encode(self, df: DataFrame, key_cols: list[str], tokens_col: str = "tokens", out: str = "input_ids",
               flags_col: str | None = None) -> DataFrame:
        return encode_tokens(df, key_cols, self.vocab, tokens_col, out, self.unk_id, flags_col, self.size)

    def stamp(self) -> list:
        """What a cache key has to know of the tokeniser."""
        return ["portable", self.profile, self.unk_id, *table_stamp(self.vocab.select("token", "id"))]

    def decode(self, df: DataFrame, key_cols: list[str], ids_col: str = "input_ids", out: str = "text") -> DataFrame:
        return decode_ids(df, key_cols, self.vocab, ids_col, out, sep=" ")


@dataclass(frozen=True)
class ByteLevelCodec:
    """Byte-level BPE: (left, right, rank) merges and (token, id) vocabulary, both bounded by the tokeniser files.

    Special markers missing from the vocabulary get the ids after its largest,
    in their fixed order, as added tokens do.  A piece that is not in the
    vocabulary takes ``unk_id``; without one it fails the job.
    """

    merges: DataFrame
    vocab: DataFrame
    unk_id: int | None = None
    profile: str = "full"
    _tables: Callable | None = field(default=None, repr=False, compare=False)

    #: rows are encoded where they are, without an exchange
    in_place = True

    @classmethod
    def load(cls, merges: DataFrame, vocab: DataFrame, unk_id: int | None = None, profile: str = "full") -> ByteLevelCodec:
        """A codec whose tables are read once, checked and shipped to the executors once."""
        spark = vocab.sparkSession
        ranks, ids = table_values(merges, vocab)
        if len(set(ids.values())) < len(ids):
            raise ValueError("the vocabulary gives one id to several tokens")
        missing = [t for t in SPECIAL_TOKENS if t not in ids]
        added = [(t, max(ids.values(), default=-1) + 1 + i) for i, t in enumerate(missing)]
        if added:
            vocab = vocab.select("token", F.col("id").cast("int").alias("id")).unionByName(
                spark.createDataFrame(added, "token string, id int"))
            ids.update(added)
        return cls(merges, vocab, unk_id, profile, shared_tables(spark, ranks, ids))

    def split(self, text) -> Column:
        return pretokens(text, self.profile, markers=True)

    def learn(self, tokens: DataFrame, tokens_col: str = "tokens") -> ByteLevelCodec:
        return self

    def _shared(self) -> Callable:
        return self._tables or shared_tables(self.vocab.sparkSession, *table_values(self.merges, self.vocab))

    def encode(self, df: DataFrame, key_cols: list[str], tokens_col: str = "tokens", out: str = "input_ids",
               flags_col: str | None = None) -> DataFrame:
        return attach_ids(df, key_cols, self._shared(), self.unk_id, tokens_col, out, flags_col)

    def stamp(self) -> list:
        return ["bytes", self.profile, self.unk_id, *table_stamp(self.vocab.select("token", "id")),
                *table_stamp(self.merges.select("left", "right", "rank"))]

    def decode(self, df: DataFrame, key_cols: list[str], ids_col: str = "input_ids", out: str = "text") -> DataFrame:
        return decode_in_place(df, key_cols, self._shared(), ids_col, out)


def codec_for(codec, vocab: DataFrame | None = None):
    """The codec a task works with: the given one, or the portable one with ``vocab`` (None: counted over the corpus)."""
    if codec is None:
        return PortableCodec(vocab, size=None if vocab is None else vocab_size(vocab))
    if vocab is not None:
        raise ValueError("give either a codec or a vocabulary")
    return codec


# --- tokeniser files ---------------------------------------------------------------------

def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _or_fail(value: Column, dtype: str, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(what)).cast(dtype))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``vocab.json`` (an object token → id) as (token, id)."""
    kind = "map<string,int>"
    parsed = _or_fail(F.from_json("value", kind), kind, f"{path} is not a JSON object of ids")
    return _whole(spark, path).select(F.explode(parsed).alias("token", "id"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``merges.txt`` as (left, right, rank): a pair a line, most urgent first.

    A first line that starts with ``#version:`` and blank lines do not count;
    of a pair that is there twice the last line holds; a line that is not a
    pair fails the job.
    """
    lines = F.filter(F.transform(F.split("value", "\r\n|\n|\r"), lambda x, i: F.when(
        ~((i == 0) & F.trim(x).startswith("#version:")), F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    return _ranked(_whole(spark, path).select(F.transform(lines, lambda x: F.split(x, r"\s+")).alias("pairs")), path)


def _ranked(pairs: DataFrame, path: str) -> DataFrame:
    """(left, right, rank) of one row holding an array of pairs, in order."""
    at = pairs.select(F.posexplode("pairs").alias("rank", "p"))
    ok = F.when(F.size("p") == 2, F.col("p"))
    p = _or_fail(ok, "array<string>", f"{path} holds a merge that is not a pair")
    return at.select(p.alias("p"), "rank").select(F.col("p")[0].alias("left"), F.col("p")[1].alias("right"), "rank") \
        .groupBy("left", "right").agg(F.max("rank").alias("rank"))


def read_tokenizer(spark: SparkSession, vocab_path: str, merges_path: str, unk_id: int | None = None) -> ByteLevelCodec:
    """The byte-level codec of a ``vocab.json`` / ``merges.txt`` pair."""
    return ByteLevelCodec.load(materialise_scratch(read_merges(spark, merges_path), "merges"),
                               materialise_scratch(read_vocab(spark, vocab_path), "vocabulary"), unk_id)


def read_tokenizer_json(spark: SparkSession, path: str, unk_id: int | None = None) -> ByteLevelCodec:
    """The byte-level codec of one JSON file holding ``model.vocab``, ``model.merges`` (pairs, or
    strings of two symbols) and ``added_tokens``."""
    kind = "struct<model:struct<vocab:map<string,int>>,added_tokens:array<struct<content:string,id:int>>>"
    raw = _whole(spark, path)
    held = materialise_scratch(raw.select(F.from_json("value", kind).alias("t")).select(
        _or_fail(F.col("t.model.vocab"), "map<string,int>", f"{path} holds no model.vocab").alias("vocab"),
        F.coalesce("t.added_tokens", F.array().cast("array<struct<content:string,id:int>>")).alias("added")), "tokenizer")
    own = held.select(F.explode("vocab").alias("token", "id"))
    added = held.select(F.explode("added").alias("a")).select(F.col("a.content").alias("token"), F.col("a.id").alias("id"))
    vocab = own.unionByName(added.join(own.select("token"), "token", "left_anti"))
    as_pairs = F.from_json("value", "struct<model:struct<merges:array<array<string>>>>")["model"]["merges"]
    as_lines = F.from_json("value", "struct<model:struct<merges:array<string>>>")["model"]["merges"]
    pairs = F.when(F.exists(as_pairs, lambda p: p.isNotNull()), as_pairs).otherwise(
        F.transform(as_lines, lambda x: F.split(x, " ")))
    pairs = _or_fail(pairs, "array<array<string>>", f"{path} holds no model.merges")
    return ByteLevelCodec.load(materialise_scratch(_ranked(raw.select(pairs.alias("pairs")), path), "merges"),
                               materialise_scratch(vocab, "vocabulary"), unk_id)
