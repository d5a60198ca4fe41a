"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Benchmark texts (questions and answers) are normalised to words; each window
of ``window`` consecutive words (a whole item, if it has fewer) becomes one
pattern of the automaton.  A document is normalised once and scanned once;
the places found map back to words and to offsets of the original text.

Documents are scanned where they are, without a shuffle.  The benchmark is
the stated query set: its patterns are dealt into blocks of at most
``block_bytes`` normalised bytes by hash, each block is one automaton of a
bounded size that its tasks receive, and the scans of all blocks are merged
per document.  A benchmark of a usual size is one block, hence one automaton.

Edge cases: NULL text has no words; items without words have no window;
repeated rows get a row each; a NULL item_id is named "null"; other columns
of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

WINDOW = 10
BLOCK_BYTES = 16 << 20

#: bytes to normalised bytes: A-Z lower-cased, all other ASCII but 0-9 and a-z to a blank
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    """The item's windows, each as b" w1 w2 ... "."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i:i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def automaton(patterns: dict[bytes, list[str]]):
    """Aho-Corasick automaton of patterns with the items of each."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for p, items in patterns.items():
        s = p.decode("latin-1")
        found.add_word(s, (len(s), s.count(" ") - 1, items))
    found.make_automaton()
    return found


def scan(words: list[bytes], found) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans [first word, end word) of all windows that occur, and their items."""
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    spans: list[list[int]] = []
    items: set[str] = set()
    at = word = 0
    hits = sorted((end - size + 1, n, own) for end, (size, n, own) in found.iter(line))
    for begin, n, own in hits:
        word += line.count(" ", at, begin)
        at = begin
        items.update(own)
        if spans and word <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], word + n)
        else:
            spans.append([word, word + n])
    return [tuple(s) for s in spans], items


def word_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """UTF-8 offsets in the original text of spans of words."""
    raw = text.encode("utf-8", "surrogatepass")
    import re

    places = [m.span() for m in re.finditer(rb"[^\x20]+", raw.translate(_TABLE))]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> list[dict[bytes, list[str]]]:
    """The benchmark's patterns in blocks of bounded size, by hash."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                             F.col(text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * window
    n = max(1, -(-int(total) // (block_bytes * window)))
    out = []
    for b in range(n):
        patterns: dict[bytes, list[str]] = {}
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b)
        for item, body in part.toLocalIterator():
            for p in windows(words_of(body), window):
                own = patterns.setdefault(p, [])
                if item not in own:
                    own.append(item)
        if patterns:
            out.append(patterns)
    return out


def _scanner(block):
    """A UDF that scans texts with the automaton of the broadcast patterns ``block``."""
    @F.pandas_udf("n_words long, spans array<struct<first:long,end:long>>, items array<string>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tidy()
        found = automaton(block.value) if block.value else None
        for texts in batches:
            rows = []
            for body in texts:
                words = words_of(body)
                spans, items = scan(words, found) if words and found else ([], set())
                rows.append((len(words), [{"first": a, "end": b} for a, b in spans], sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scanned


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
               keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents with ``n_words``, the hit ``spans`` of words and the ``items`` found.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    blocks = _blocks(benchmark, item_id, item_text, window, block_bytes)
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(b) for b in blocks] or [sc.broadcast({})]
    own = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    out = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), *own)
    for i, block in enumerate(shared):
        out = out.withColumn(f"_b{i}", _scanner(block)("_text"))
    n = len(shared)
    if n == 1:
        spans, items = F.col("_b0.spans"), F.col("_b0.items")
    else:
        every = F.array_sort(F.concat(*[F.col(f"_b{i}.spans") for i in range(n)]))
        spans = _merged(every)
        items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"_b{i}.items") for i in range(n)])))
    return out.select(F.col("_doc").alias("doc_id"), *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
                      F.col("_b0.n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))


def _merged(spans):
    """Sorted spans with overlapping ones merged."""
    empty = F.expr("CAST(array() AS array<struct<first:bigint,end:bigint>>)")

    def step(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], x["end"]).alias("end"))
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["first"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(x)))

    return F.aggregate(spans, empty, step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return find_leaks(docs, benchmark, window, block_bytes).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
