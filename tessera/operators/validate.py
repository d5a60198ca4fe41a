"""Validation, length policies and splits (ops 10-14, 16).  All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col, seeded_hash
from tessera.functions.fixed import DEFAULT_SEED

REQUIRED_INSTRUCTION_KEYS = ("instruction", "input", "output")


def variant_truthy(v, path: str) -> Column:
    """Python truthiness of the value at ``path`` of a variant.

    null/false/0/""/[]/{} and a missing value are falsy; anything else (the string "0" too) is truthy.
    """
    at = F.variant_get(v, path, "variant")
    kind = F.schema_of_variant(at)
    return (
        F.when(kind.startswith("STRING"), F.length(F.try_variant_get(v, path, "string")) > 0)
        .when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double") != 0)
        .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, path, "array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), F.size(F.try_variant_get(v, path, "map<string,variant>")) > 0)
        .otherwise(F.lit(False))
    )


def json_truthy(line, path: str) -> Column:
    """Python truthiness of the JSON value at ``path`` of the JSON text ``line``."""
    return variant_truthy(F.try_parse_json(col(line)), path)


def instruction_valid(line) -> Column:
    """Keys instruction, input, output present (null allowed) and output truthy (op 10).

    The line is parsed once: everything is read from its variant, bound by a one-element ``transform``.
    """
    def valid(v):
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        present = F.lit(True)
        for k in REQUIRED_INSTRUCTION_KEYS:
            present = present & F.coalesce(F.array_contains(keys, k), F.lit(False))
        return present & F.coalesce(variant_truthy(v, "$.output"), F.lit(False))

    return F.transform(F.array(F.try_parse_json(col(line))), valid)[0]


def validate_instructions(df: DataFrame, line_col: str = "value", mode: str = "fail"):
    """``mode='fail'``: a single invalid line aborts the job (raise at run time).
    ``mode='flag'``: add a boolean ``valid`` column.
    ``mode='quarantine'``: return (valid rows, invalid rows)."""
    flagged = df.withColumn("valid", instruction_valid(line_col))
    if mode == "flag":
        return flagged
    if mode == "quarantine":
        return flagged.where("valid").drop("valid"), flagged.where(~F.col("valid")).drop("valid")
    if mode == "fail":
        checked = F.when(
            ~F.col("valid"), F.raise_error(F.concat(F.lit("invalid instruction record: "), col(line_col)))
        ).otherwise(F.lit(True))
        # a filter keeps the check in the plan (a dropped column would be pruned away)
        return flagged.where(checked).drop("valid")
    raise ValueError(f"unknown mode {mode!r}")


def drop_long(df: DataFrame, max_len: int, length_of: str = "labels") -> DataFrame:
    """Drop a sample iff its token length is greater than max_len (op 11)."""
    return df.where(F.size(col(length_of)) <= F.lit(int(max_len)))


def truncate(df: DataFrame, max_len: int, list_cols=("input_ids", "labels")) -> DataFrame:
    """Keep the first max_len entries of every list column (op 12)."""
    for c in list_cols:
        df = df.withColumn(c, F.slice(F.col(c), 1, int(max_len)))
    return df


def drop_long_chars(df: DataFrame, max_chars: int, prompt="prompt", chosen="chosen", rejected="rejected") -> DataFrame:
    """Drop iff len(prompt)+len(chosen) or len(prompt)+len(rejected) exceeds max_chars, in code points (op 13)."""
    longest = F.greatest(F.length(col(chosen)), F.length(col(rejected)))
    return df.where(F.length(col(prompt)) + longest <= F.lit(int(max_chars)))


def drop_empty_pairs(df: DataFrame, prompt="prompt", chosen="chosen", rejected="rejected") -> DataFrame:
    """Drop iff prompt, chosen or rejected is empty (op 14)."""
    return df.where((F.length(col(prompt)) > 0) & (F.length(col(chosen)) > 0) & (F.length(col(rejected)) > 0))


def split_threshold(eval_percent: float) -> str:
    """Hex threshold on the first 8 md5 digits giving an ``eval_percent`` eval share."""
    value = int(round(eval_percent / 100.0 * 16 ** 8))
    return format(min(value, 16 ** 8), "08x") if value < 16 ** 8 else "g"


def train_eval_split(df: DataFrame, eval_percent: float, key: str = "pos", seed: int = DEFAULT_SEED) -> DataFrame:
    """Deterministic hash split (op 16): ``split`` = 'eval' iff the first eight
    hex digits of md5(seed:key) sort below the threshold, else 'train'."""
    bucket = F.substring(seeded_hash(seed, key), 1, 8)
    return df.withColumn("split", F.when(bucket < F.lit(split_threshold(eval_percent)), "eval").otherwise("train"))


def drop_unsupervised(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Opt-in filter: drop samples whose shifted labels hold no supervised token
    (the reference keeps them; see ``collate.supervision_stats``)."""
    from tessera.operators.collate import shifted_labels, supervised_count

    return df.where(supervised_count(shifted_labels(labels)) > 0)


def marker_collisions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row: how many special markers occur inside raw content (they become
    special tokens when tokenised, as in the reference)."""
    from tessera.functions.fixed import MARKER_PATTERN

    found = F.regexp_extract_all(col(text_col), F.lit(MARKER_PATTERN), 0)
    return df.withColumn("marker_collisions", F.size(found).cast("bigint"))
