"""Byte-level BPE (op 28) and byte-level decoding (op 29).

Encoding a corpus is dominated by a few frequent pre-tokens, and the ids of a
pre-token depend on nothing but the tokeniser's tables, which its files bound:
they are checked, collected and broadcast.  Rows are encoded where they are,
in Arrow batches; a batch's distinct pre-tokens are looked up once, in a
bounded memo of the task, and the ids of a row are gathered by arithmetic on
offsets.  No occurrence is exploded, joined or shuffled.

Decoding goes the same way: a piece's bytes depend on the vocabulary alone,
so rows of ids become texts where they are.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col
from tessera.functions.fixed import SPECIAL_TOKENS

# largest merge table / vocabulary accepted for broadcasting to the encoders
MAX_TABLE_ROWS = 2_000_000
# up to this many symbols a list is faster than a heap
SHORT_WORD = 48
# words or ids of an Arrow batch that are worked on at once
BATCH_ITEMS = 2_000_000
# words a task remembers the ids of, and the longest of them
MEMO_WORDS, MEMO_LENGTH = 200_000, 256


def byte_alphabet() -> dict[int, str]:
    """Byte → printable symbol.  Printable Latin-1 bytes (33-126, 161-172,
    174-255) stand for themselves; the other 68 bytes take the code points
    256, 257, … in increasing byte order."""
    printable = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    table, spare = {}, 256
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


def to_symbols(token: str, alphabet: dict[int, str]) -> list[str]:
    return [alphabet[b] for b in token.encode("utf-8")]


def apply_merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Repeatedly merge the adjacent pair with the lowest rank (all its
    non-overlapping occurrences, left to right) until no ranked pair is left.

    The symbols form a linked list and ranked pairs wait in a heap by (rank,
    place of the left symbol), so a word of n symbols costs n log n, not a
    pass over the word for every merge.  A pair's occurrences are merged as
    one round; pairs that come up in a round wait for the next, as they do
    when whole passes are made, even if their rank is lower.
    """
    n = len(symbols)
    if n <= SHORT_WORD:
        return _merge_short(list(symbols), ranks)
    sym: list[str | None] = list(symbols)          # None: merged into the symbol to its left
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)

    def pair_at(i: int) -> tuple[str, str] | None:
        return (sym[i], sym[after[i]]) if sym[i] is not None and after[i] < n else None

    while heap:
        rank, i = heap[0]
        pair = pair_at(i)
        if pair is None or ranks.get(pair) != rank:
            heapq.heappop(heap)                    # one of its symbols has been merged since
            continue
        changed, others = [], []
        while heap and heap[0][0] == rank:
            _, i = heapq.heappop(heap)
            here = pair_at(i)
            if here == pair:
                j = after[i]
                sym[i], sym[j] = pair[0] + pair[1], None
                after[i] = after[j]
                if after[j] < n:
                    before[after[j]] = i
                changed.append(i)
            elif here is not None and ranks.get(here) == rank:
                others.append((rank, i))           # another pair that shares the rank
        for entry in others:
            heapq.heappush(heap, entry)
        for i in changed:
            for left in (before[i], i):
                near = pair_at(left) if left >= 0 else None
                if near is not None and (r := ranks.get(near)) is not None:
                    heapq.heappush(heap, (r, left))
    return [x for x in sym if x is not None]


def _merge_short(s: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """``apply_merges`` for a few symbols: the ranks of neighbours in a list, searched from left to right."""
    get, never = ranks.get, float("inf")
    near = [get(p, never) for p in zip(s, s[1:])]
    while near:
        rank = min(near)
        if rank == never:
            break
        i = near.index(rank)
        pair = (s[i], s[i + 1])
        merged, changed = pair[0] + pair[1], []
        while True:
            if (s[i], s[i + 1]) == pair:
                s[i:i + 2] = [merged]
                del near[i]                       # what is at i now is the next place's, and out of date
                changed.append(i)
            try:
                i = near.index(rank, i + 1)
            except ValueError:
                break
        for i in changed:
            if i < len(near):
                near[i] = get((s[i], s[i + 1]), never)
            if i:
                near[i - 1] = get((s[i - 1], s[i]), never)
    return s


def _bounded_collect(df: DataFrame, what: str) -> list:
    """Collect a table whose size is bounded by the tokeniser files; one job,
    and never more than ``MAX_TABLE_ROWS + 1`` rows reach the driver."""
    rows = df.limit(MAX_TABLE_ROWS + 1).collect()
    if len(rows) > MAX_TABLE_ROWS:
        raise ValueError(f"{what} has more than {MAX_TABLE_ROWS} rows, above the broadcast bound")
    return rows


def table_values(merges: DataFrame, vocab: DataFrame) -> tuple[dict[tuple[str, str], int], dict[str, int]]:
    """Merge ranks and ids as dictionaries: tables bounded by the tokeniser files, checked before they are collected."""
    ranks = {(r["left"], r["right"]): int(r["rank"])
             for r in _bounded_collect(merges.select("left", "right", "rank"), "merges")}
    ids = {r["token"]: int(r["id"]) for r in _bounded_collect(vocab.select("token", "id"), "vocabulary")}
    return ranks, ids


def shared_tables(spark, ranks: dict, ids: dict) -> Callable[[], tuple[dict, dict]]:
    """The tables for worker functions, shipped once per executor."""
    try:
        b_ranks, b_ids = spark.sparkContext.broadcast(ranks), spark.sparkContext.broadcast(ids)
        return lambda: (b_ranks.value, b_ids.value)
    except Exception:  # noqa: BLE001 - Spark Connect: the tables travel with the function
        return lambda: (ranks, ids)


class WordMemo:
    """Ids of words, each encoded when it is first met; a bounded memory of a task."""

    def __init__(self, ranks: dict, ids: dict, unk_id: int | None, bound: int = MEMO_WORDS):
        self.ranks, self.ids, self.unk_id, self.bound = ranks, ids, unk_id, bound
        self.alphabet, self.specials, self.held = byte_alphabet(), set(SPECIAL_TOKENS), {}

    def __call__(self, word: str) -> list[int]:
        found = self.held.get(word)
        if found is None:
            if len(self.held) >= self.bound:
                self.held.clear()
            found = self._encode(word)
            if len(word) <= MEMO_LENGTH:
                self.held[word] = found
        return found

    def _encode(self, word: str) -> list[int]:
        if word in self.specials and word in self.ids:
            return [self.ids[word]]
        out = []
        for p in apply_merges(to_symbols(word, self.alphabet), self.ranks):
            v = self.ids.get(p, self.unk_id)
            if v is None:
                raise ValueError(f"piece {p!r} of {word!r} is not in the vocabulary and no unk id is set")
            out.append(v)
        return out


def in_slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows in order, cut so that no cut but one long row holds more than ``BATCH_ITEMS`` items."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(lists):
        begin = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begin + BATCH_ITEMS, side="right")))
        yield lists.slice(at, end - at)
        at = end


def _gathered(flat: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, end of each code's values) when the codes' runs of ``flat``, which lie there in order, follow each other."""
    starts = np.concatenate([[0], np.cumsum(lens)])
    n = lens[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(total)], ends


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Where each row's items begin among the flattened ones, and their end."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def encode_lists(tokens: pa.ListArray, encode: Callable[[str], list[int]]) -> tuple[pa.ListArray, pa.ListArray]:
    """(ids, pieces per word) of lists of words; every word of the lists is looked up once."""
    found = tokens.flatten().dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = [encode(w) for w in found.dictionary.to_pylist()]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(itertools.chain.from_iterable(words), np.int32, int(lens.sum()))
    ids, ends = _gathered(flat, lens, codes)
    word_at = _offsets(tokens)
    id_at = np.concatenate([[0], ends])[word_at]
    as_list = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
    return as_list(id_at, ids), as_list(word_at, lens[codes])


def decode_lists(lists: pa.ListArray, pieces: dict[int, bytes]) -> pa.Array:
    """Texts of lists of ids; every id of the lists is looked up once, an unknown or NULL one gives nothing."""
    found = lists.flatten().dictionary_encode()
    parts = [pieces.get(i, b"") for i in found.dictionary.to_pylist()] + [b""]
    codes = found.indices.fill_null(len(parts) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    data, ends = _gathered(np.frombuffer(b"".join(parts), np.uint8), lens, codes)
    at = np.concatenate([[0], ends])[_offsets(lists)]
    raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:                           # bytes that are not UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def attach_ids(df: DataFrame, key_cols: list[str], tables: Callable[[], tuple[dict, dict]], unk_id: int | None = None,
               tokens_col: str = "tokens", out: str = "input_ids", flags_col: str | None = None) -> DataFrame:
    """Ids of the pre-token arrays of ``df``, row by row where they are: no exchange.

    The merges are a pure function of the word and bounded tables, so what is
    saved by encoding a word once is saved within a batch (its distinct words)
    and a task (a bounded memo); a dictionary of all distinct words would have
    to meet every occurrence in a shuffle once it is too large to broadcast.
    ``flags_col``: a boolean array aligned with the pre-tokens; it is returned
    aligned with the ids (a pre-token's flag for each of its pieces).
    A NULL array has no ids.
    """
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = WordMemo(*tables(), unk_id)
        for tokens in batches:
            yield _joined([encode_lists(part, memo)[0] for part in in_slices(tokens)], pa.list_(pa.int32()))

    def ids_and_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = WordMemo(*tables(), unk_id)
        lists = pa.list_(pa.int32())
        for tokens in batches:
            done = [encode_lists(part, memo) for part in in_slices(tokens)]
            yield pa.StructArray.from_arrays([_joined([d[k] for d in done], lists) for k in (0, 1)], ["ids", "pieces"])

    if flags_col is None:
        return df.select(*key_cols, F.arrow_udf(ids_of, "array<int>")(col(tokens_col)).alias(out))
    both = F.arrow_udf(ids_and_pieces, "struct<ids:array<int>,pieces:array<int>>")(col(tokens_col))
    flags = F.flatten(F.zip_with(col(flags_col), F.col("_e.pieces"), lambda f, n: F.array_repeat(f, n)))
    return df.select(*key_cols, flags_col, both.alias("_e")).select(
        *key_cols, F.col("_e.ids").alias(out), flags.alias(flags_col))


def encode_bpe(
    df: DataFrame,
    key_cols: list[str],
    merges: DataFrame,
    vocab: DataFrame,
    tokens_col: str = "tokens",
    out: str = "input_ids",
    unk_id: int | None = None,
    flags_col: str | None = None,
) -> DataFrame:
    """Byte-level BPE ids for the pre-token arrays of ``df``.

    ``merges``: (left, right, rank); ``vocab``: (token, id).  Special markers
    present in the vocabulary map straight to their ids.  A piece missing from
    the vocabulary takes ``unk_id``; without one the job fails.
    """
    tables = shared_tables(df.sparkSession, *table_values(merges, vocab))
    return attach_ids(df, key_cols, tables, unk_id, tokens_col, out, flags_col)


def decode_in_place(df: DataFrame, key_cols: list[str], tables: Callable[[], tuple[dict, dict]],
                    ids_col: str = "input_ids", out: str = "text") -> DataFrame:
    """ids → text row by row: pieces back to bytes, UTF-8 decoded with replacement, special markers
    verbatim; unknown ids give nothing, a NULL array the empty text."""
    def pieces() -> dict[int, bytes]:
        byte_of, specials = {ch: b for b, ch in byte_alphabet().items()}, set(SPECIAL_TOKENS)
        return {i: t.encode() if t in specials else bytes(byte_of[c] for c in t) for t, i in tables()[1].items()
                if t in specials or all(c in byte_of for c in t)}

    return _decoded(df, key_cols, pieces, ids_col, out)


def _decoded(df: DataFrame, key_cols: list[str], pieces: Callable[[], dict[int, bytes]], ids_col: str, out: str) -> DataFrame:
    """Texts of id lists, given each id's bytes."""
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = pieces()
        for lists in batches:
            yield _joined([decode_lists(part, held) for part in in_slices(lists)], pa.string())

    return df.select(*key_cols, F.arrow_udf(texts, "string")(col(ids_col)).alias(out))


def decode_bytes(df: DataFrame, key_cols: list[str], vocab: DataFrame, ids_col: str = "input_ids",
                 out: str = "text") -> DataFrame:
    """ids → text: vocabulary pieces mapped back to bytes, UTF-8 decoded with
    replacement.  Special markers are emitted verbatim.

    The vocabulary (id, token) is checked against the bound and broadcast; rows stay where they are.
    """
    byte_of, specials = {ch: bytes([b]) for b, ch in byte_alphabet().items()}, set(SPECIAL_TOKENS)
    rows = _bounded_collect(vocab.select("id", "token"), "vocabulary")
    held = {r["id"]: r["token"].encode() if r["token"] in specials else b"".join(byte_of.get(c, b"") for c in r["token"])
            for r in rows if r["token"] is not None}
    try:
        shared = df.sparkSession.sparkContext.broadcast(held)
        pieces = lambda: shared.value
    except Exception:  # noqa: BLE001 - Spark Connect: the table travels with the function
        pieces = lambda: held
    return _decoded(df, key_cols, pieces, ids_col, out)


def symbols_column(token) -> "F.Column":
    """Spark expression: pre-token → array of byte-alphabet symbols.

    A byte read as Latin-1 is the character of its number; the bytes that do not stand for themselves are translated.
    """
    moved = {chr(b): s for b, s in byte_alphabet().items() if chr(b) != s}
    bytes_as_text = F.decode(F.encode(col(token), "UTF-8"), "ISO-8859-1")
    return F.split(F.translate(bytes_as_text, "".join(moved), "".join(moved.values())), "")
