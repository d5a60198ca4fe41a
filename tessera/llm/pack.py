"""Best-fit packing: bounded-space online best-fit of token pieces into fixed-length sequences.

``tokenise`` turns documents into pieces of at most ``capacity`` tokens (the
real ids travel along as little-endian unsigned 32-bit bytes), ``place``
packs pieces, ``sequences`` assembles the packed token sequences.

Packing is online and bounded in space: a stream of pieces fills a fixed
number of open bins kept in a bitset keyed by free space.  A piece goes to
the open bin with the least sufficient free space; when none fits and all
bins are in use, the fullest bin closes first.  Streams are independent, so
Spark runs one per group; their number follows the tokens and rows there
are, hence a group's size is bounded whatever the data.

Edge cases: NULL text is an empty document, whose only token is the end
token; no input row gives no piece; a NULL doc_id is kept as it is; repeated
rows are packed once per row; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidied, tidy, written

CAPACITY = 4096
OPEN_BINS = 1024
STREAM_TOKENS = 1 << 24   # tokens per stream
STREAM_ROWS = 1 << 17     # pieces per stream
CACHED_WORDS = 300_000    # per Python worker, twice, and what one group of texts has beyond
CACHED_CHARS = 64
GROUP_CHARS = 1 << 22     # of texts that are encoded at a time
LEAN_WORDS = 60_000       # the same two where a worker is to hold little
LEAN_CHARS = 1 << 20
BATCH_CHUNKS = 4096       # the tokenizer's own objects are that many at a time; they are larger than the ids

#: a lower-case Latin word and the marks behind it: two tokens of the pre-tokeniser, none of its special cases
_WORD = re.compile("([a-zß-öø-ɏ]+)([!-&(-/:-@\\[-`{-~]*)")
#: characters that normalisation may change or join
_RARE = re.compile("[^\x00-\u012f\u0131-\u02ff\u2010-\u2027]")
_KEPT: dict = {}          # a worker's caches outlive its tasks, until one of another operator tidies it


class WordIds:
    """Ids of a text as bytes, put together from cached ids of its words.

    White space never lies inside a token, so a text's ids are those of its
    blank-separated chunks in a row.  A group of texts is cut into chunks and
    put together again by Arrow; Python sees its distinct chunks, once each.
    A chunk that is a lower-case Latin word with marks behind it is the word's
    ids and the marks' ids; words not yet known go to the tokenizer's model
    itself, or many at a time to the same model behind a plain split where they
    hold more than a to z.  Any other chunk goes through the tokenizer as it is.  A full cache is set aside and a new one begun, into
    which comes back what is met again: words that recur stay.
    """

    def __init__(self, path: str, cached: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = Tokenizer(self.model)
        self.split.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cached = cached or CACHED_WORDS
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids; pass many at once, as what is new is learned in one go."""
        simple = [t.lower() if "<|" not in t and not _RARE.search(t) else t for t in texts]
        split = pc.split_pattern(pc.replace_substring(pa.array(simple, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids = pa.array(self._known(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = ids.buffers()[2]
        return [data[begin:end].to_pybytes() if end > begin else b"" for begin, end in itertools.pairwise(ends)]

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.chunks) > self.cached:
            self.old, self.chunks = self.chunks, {}
        known = self.chunks
        ids = list(map(known.get, chunks))
        missing = [i for i, x in enumerate(ids) if x is None]
        long = self._learn(self._new([chunks[i] for i in missing]))
        for i in missing:
            c = chunks[i]
            ids[i] = known[c] if c in known else long[c]
        return ids

    def _new(self, chunks: list[str]) -> list[str]:
        """What the cache set aside does not have either; the rest is fetched back."""
        old, known, new = self.old, self.chunks, []
        for c in chunks:
            if c in old:
                known[c] = old[c]
            else:
                new.append(c)
        return new

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Cache the ids of new chunks, of their words and of their marks; those too long to keep are returned."""
        known = self.chunks
        long: dict[str, bytes] = {}
        parts, odd, words, marks = [], [], set(), set()
        for c in chunks:
            m = _WORD.fullmatch(c)
            if m and c == c.lower():             # a text with rare characters is not lower-cased
                word, mark = m.groups()
                words.add(word)
                if mark:
                    parts.append((c, word, mark))
                    marks.add(mark)
            else:
                odd.append(c)
        words = self._new([w for w in words if w not in known])
        whole = list(set(self._new([m for m in marks if m not in known])).union(odd))
        for c, ids in itertools.chain(self._ids_of_words(words), self._ids_of_chunks(whole)):
            (long if len(c) > CACHED_CHARS else known)[c] = ids
        for c, word, mark in parts:
            ids = (known if word in known else long)[word] + (known if mark in known else long)[mark]
            (long if len(c) > CACHED_CHARS else known)[c] = ids
        return long

    @staticmethod
    def _batches(tokenizer, items: list, texts: list[str], size: int | None = None) -> Iterator[tuple]:
        """Items and the encodings of their texts."""
        size = size or BATCH_CHUNKS
        for at in range(0, len(texts), size):
            yield from zip(items[at:at + size], tokenizer.encode_batch(texts[at:at + size], add_special_tokens=False))

    def _ids_of_chunks(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        for c, e in self._batches(self.whole, new, new):
            yield c, np.array(e.ids, "<u4").tobytes()

    def _ids_of_words(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        tokens_of = self.model.tokenize
        for w in new:
            if w.isascii():                      # letters that stand for themselves as bytes
                ids = [t.id for t in tokens_of(w)]
                yield w, struct.pack(f"<{len(ids)}I", *ids)
        new = [w for w in new if not w.isascii()]
        lines = [new[i:i + 64] for i in range(0, len(new), 64)]
        for line, e in self._batches(self.split, lines, [" ".join(x) for x in lines], BATCH_CHUNKS // 64):
            ids = np.array(e.ids, "<u4")
            ends = np.searchsorted(np.array(e.word_ids), np.arange(len(line)), side="right")
            raw, at = ids.tobytes(), 0
            for w, end in zip(line, (ends * 4).tolist()):
                yield w, raw[at:end]
                at = end


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file: in ``folder``, in $TOKENIZER_DIR, or where their package lies."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if not folder:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def word_ids(path: str) -> WordIds:
    """The worker's WordIds; kept for its next tasks where this package can be imported there."""
    try:
        from tessera.llm import pack as own

        kept = own._KEPT
    except ImportError:
        kept = {}
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
             doc_id: str = "doc_id", text: str = "text", digest: bool = False, lean: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids) per piece; only documents over ``capacity`` are cut.

    With ``digest``, the ids' CRC-32 ``ids_crc32`` instead of ``ids``.  ``lean`` gives the same rows with less memory and
    more CPU: a task encodes less at a time, caches fewer words and leaves none to its worker.  Spark deals tasks to all
    idle workers in turn, hence caches that stay are held by as many workers as any earlier stage had at once.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = capacity * 4
    chars = LEAN_CHARS if lean else GROUP_CHARS
    last = "ids_crc32 long" if digest else "ids binary"
    names = ["doc_id", "piece", "start", "length", last.split()[0]]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lean:
            tidy()
        words = WordIds(tokenizer, LEAN_WORDS) if lean else word_ids(tokenizer)
        gc.disable()  # scanning the caches again and again costs more than the encoding
        try:
            yield from encoded(batches, words)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch], words: WordIds) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            at = 0
            while at < len(batch):
                group, size = [], 0
                while at + len(group) < len(batch) and size < chars:
                    group.append(texts[at + len(group)].as_py() or "")
                    size += len(group[-1])
                rows = []
                for row, ids in enumerate(words.encode(group), at):
                    ids += end
                    for n, begin in enumerate(range(0, len(ids), step)):
                        cut = ids[begin:begin + step]
                        rows.append((row, n, begin // 4, len(cut) // 4, zlib.crc32(cut) if digest else cut))
                yield frame(batch, rows)
                at += len(group)

    def frame(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        row, piece, start, length, ids = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(ids, pa.int64() if digest else pa.binary())],
            names=names)

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cols.mapInArrow(tidied(pieces) if lean else pieces, f"doc_id long, piece int, start long, length long, {last}")


def best_fit(lengths, capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each length, in order of arrival."""
    bits = 0                                     # bit f: an open bin has f free
    bins: dict[int, list[int]] = {}              # free space -> open bins, last in first out
    n_open = n_bins = 0
    where, offset = [], []
    for n in lengths:
        fit = bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            stack = bins[free]
            b = stack.pop()
            if not stack:
                bits ^= 1 << free
        else:
            if n_open == open_bins:              # the fullest closes
                fullest = (bits & -bits).bit_length() - 1
                stack = bins[fullest]
                stack.pop()
                if not stack:
                    bits ^= 1 << fullest
                n_open -= 1
            free, b = capacity, n_bins
            n_bins += 1
            n_open += 1
        where.append(b)
        offset.append(capacity - free)
        free -= n
        if free:
            bins.setdefault(free, []).append(b)
            bits |= 1 << free
        else:
            n_open -= 1
    return where, offset


def place(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs doc_id, piece, start and length (1 to ``capacity``).

    ``pieces`` should be narrow and written: it is read twice.
    """
    tokens, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    streams = max(1, -(-tokens // STREAM_TOKENS), -(-rows // STREAM_ROWS))
    keyed = pieces.withColumn("_mix", F.xxhash64("doc_id", "piece", "start", "length"))
    keyed = keyed.withColumn("_stream", F.pmod("_mix", F.lit(streams)))

    def pack(group: pa.Table) -> pa.Table:
        # a fixed, mixed order of arrival: a retried task packs alike
        group = group.sort_by([(c, "ascending") for c in ("_mix", "doc_id", "piece", "start", "length")])
        where, offset = best_fit(group.column("length").to_pylist(), capacity, open_bins)
        stream = group.column("_stream")[0].as_py()
        number = pa.array(np.array(where, "int64") * streams + stream)
        return (group.drop_columns(["_mix", "_stream"]).append_column("sequence_id", number)
                .append_column("offset", pa.array(offset, pa.int64())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return keyed.groupBy("_stream").applyInArrow(pack, f"{fields}, sequence_id long, offset long")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) with the pieces' ids concatenated in order of offset."""
    key = ["doc_id", "piece"]
    at = placed.select(*key, "sequence_id", "offset")
    same = at["doc_id"].eqNullSafe(pieces["doc_id"]) & (at["piece"] == pieces["piece"])
    parts = pieces.join(at, same).select("sequence_id", "offset", "length", "ids")
    return parts.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit(b""),
                    lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, lean: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = tokenise(docs, tokenizer, digest=True, lean=lean)
    return place(written(pieces, "pieces"))
