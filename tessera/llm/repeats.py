"""Suffix-array dedup: remove every byte covered by a 200-byte string that starts anywhere else too.

A suffix array of all texts cannot be sorted shard by shard unless equal
strings meet in a shard.  So each 200-byte window gets an anchor, the least
100-byte hash inside it, which depends on nothing but the window's content:

1. Anchors are computed for whole texts; hashes of anchors are shuffled,
   packed, and those that occur once leave.  A task passes on an anchor once,
   however often it has it.
2. The windows of a repeated anchor's place form a context (200 to 300
   bytes).  Equal contexts become one row with a count (partial aggregation,
   so a passage in a third of all texts is one row a task).
3. Contexts are dealt into shards by anchor and the shard's suffixes are
   sorted by induction (``suffixes``), no more than ``SHARD_BYTES`` at a time;
   a window is repeated if its context is or if a neighbour in the order
   shares its 200 bytes.  An anchor whose different contexts exceed that size
   (100 bytes of a line that very many texts hold, in other words each time)
   goes on as 128-bit hashes of its windows, packed, a window once a task.
4. Results return to the contexts' places by a join, spans are merged per
   text, and the bytes outside are hashed.

Every window lies in one context, and equal windows in contexts of the same
anchor, so results do not depend on the sharding.  Equal texts are one text
with a number of copies: from 200 bytes on, copies repeat altogether.

Edge cases: NULL is the empty text; texts under 200 bytes lose nothing;
repeated rows are copies of each other whatever their ids; a NULL doc_id is
kept; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import shuffle_partitions, tidied, tidied_group, written
from tessera.llm.shingles import Powers, mix, prefix_hash, slices, text_bytes
from tessera.llm.suffixes import repeated, shard_text

LENGTH = 200
ANCHOR = 100
BUCKET_BYTES = 64 << 20         # text behind a bucket of anchors
SHARD_BYTES = 1 << 19           # contexts sorted at a time, at most, in about 130 times that memory
HASHED_BYTES = 16 << 20         # packed windows of a bucket, on average
WINDOW_BYTES = 37               # of a packed window
FOLD_WINDOWS = 1 << 18
FOLD_ANCHORS = 1 << 18
BROADCAST_BYTES = 32 << 20

U = np.uint64


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for every i, by running minima of blocks."""
    n = len(x)
    blocks = -(-n // w)
    wide = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    wide[:n] = x
    wide = wide.reshape(blocks, w)
    left = np.minimum.accumulate(wide, axis=1).ravel()
    right = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def anchors(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in a text: hash, first window, end window, and whether a window of the run
    occurs elsewhere in the text itself (a run may overlap its own repetition)."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    s, down = prefix_hash(data, powers)
    h = mix((s[ANCHOR:] - s[:-ANCHOR]) * down[:n - ANCHOR + 1], 21)
    least = sliding_least(h, LENGTH - ANCHOR + 1)
    cut = np.flatnonzero(np.diff(least)) + 1
    first = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(least)]])
    # a run of one hash may hold several places of it; as it is the content that counts, only its length is bounded
    long = np.flatnonzero(end - first > LENGTH)
    if len(long):
        pieces = [(np.arange(a, b, LENGTH - ANCHOR + 1), b) for a, b in zip(first[long], end[long])]
        first = np.sort(np.concatenate([np.delete(first, long), *[p for p, _ in pieces]]))
        end = np.append(first[1:], len(least))
    window = (s[LENGTH:] - s[:-LENGTH]) * down[:n - LENGTH + 1]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    again = np.logical_or.reduceat(np.isin(window, twice), first) if len(twice) else np.zeros(len(first), bool)
    return least[first], first, end, again


def _texts(docs: DataFrame, doc_id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the text and two hashes of it, and the columns to carry along as ``c``."""
    own = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("c")] if carry else []
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *own)
    return raw.withColumns({"hi": F.xxhash64("text"), "lo": F.xxhash64(F.lit(1), "text")})


def _each(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, np.ndarray]]:
    base = 0
    for part in slices(batch, text, 1 << 20):
        data, offsets = text_bytes(part.column(text))
        for r in range(len(part)):
            yield base + r, data[offsets[r]:offsets[r + 1]]
        base += len(part)


def _pack(columns: list[np.ndarray], bucket: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Columns of numbers as one row of binaries per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.append(begin[1:], len(bucket))
    cols = [x[order] for x in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[begin].astype(np.int64)),
         *[pa.array([x[a:b].tobytes() for a, b in zip(begin, end)], pa.binary()) for x in cols]],
        names=["bucket", *names])


def repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(hi, first): first windows of the runs, per text, whose anchor occurs more than once."""
    names = ["hash", "own", "first", "known"]

    def fold(parts: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([p[0] for p in parts])
        own = np.repeat(np.array([p[2] for p in parts], np.int64), [len(p[0]) for p in parts])
        first = np.concatenate([p[1] for p in parts])
        again = np.concatenate([p[3] for p in parts])
        order = np.argsort(h, kind="stable")
        h, own, first, again = h[order], own[order], first[order], again[order]
        begin = np.concatenate([[True], h[1:] != h[:-1]])
        known = ~(begin & np.append(begin[1:], True)) | again
        if known.any():                          # settled here: back to the texts, and on once
            yield _pack([h[known], own[known], first[known], known[known]], np.full(known.sum(), -1), names)
        send = begin
        yield _pack([h[send], own[send], first[send], known[send]], (h[send] >> U(16)) % U(buckets), names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, parts, size, seen = Powers(), [], 0, set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for r, data in _each(batch, 1):
                if keys[r] in seen:              # a copy
                    continue
                seen.add(keys[r])
                h, first, _, again = anchors(data, powers)
                if len(h):
                    parts.append((h, first, keys[r], again))
                    size += len(h)
                if size > FOLD_ANCHORS:
                    yield from fold(parts)
                    parts, size, seen = [], 0, set()
        if parts:
            yield from fold(parts)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, first in zip(b.column(0), b.column(1)):
                yield by_text(np.frombuffer(own.as_py(), np.int64), np.frombuffer(first.as_py(), np.int64))

    def by_text(own: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        """Places per text as one binary."""
        out = _pack([first.astype(np.int32)], own, ["first"])
        return pa.RecordBatch.from_arrays(list(out.columns), names=["hi", "first"])

    def bucket(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)])
        h, own, first, known = (read(c, t) for c, t in zip(names, (np.uint64, np.int64, np.int64, bool)))
        order = np.argsort(h, kind="stable")
        h, own, first, known = h[order], own[order], first[order], known[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(begin, len(h)))
        # the same place of a text may come from two tasks that have copies of it
        more = (np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)) | (
            np.minimum.reduceat(first, begin) != np.maximum.reduceat(first, begin))
        more |= np.logical_or.reduceat(known, begin)
        keep = np.repeat(more, sizes) & ~known
        return pa.Table.from_batches([by_text(own[keep], first[keep])]) if keep.any() else empty

    empty = pa.table({"hi": pa.array([], pa.int64()), "first": pa.array([], pa.binary())})
    schema = "hi long, first binary"
    packed = written(texts.select("hi", "text").mapInArrow(
        tidied(make), "bucket long, hash binary, own binary, first binary, known binary"), "runs")
    own = packed.where("bucket < 0").select("own", "first").mapInArrow(settled, schema)
    others = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(tidied_group(bucket), schema)
    return own.union(others)


def contexts(texts: DataFrame, places: DataFrame, with_bytes: bool) -> DataFrame:
    """Contexts of the repeated anchors: c_hi, c_lo and hash with ``bytes``, or with the place (hi, first, windows)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            wanted = batch.column(2).to_pylist()
            rows: list = []
            for r, data in _each(batch, 1):
                h, first, end, _ = anchors(data, powers)
                chosen = np.unique(np.concatenate([np.frombuffer(b, np.int32) for b in wanted[r]]))
                at = np.searchsorted(first, chosen)
                at = at[at < len(first)]
                s, down = prefix_hash(data, powers)
                a, b = first[at], end[at] + LENGTH - 1
                c = (s[b] - s[a]) * down[a]
                c_hi, c_lo = mix(c ^ (b - a).astype(np.uint64), 31), mix(c, 32) ^ h[at]
                raw = data.tobytes() if with_bytes else b""
                own = [raw[i:j] for i, j in zip(a.tolist(), b.tolist())] if with_bytes else [keys[r]] * len(a)
                rows.append((c_hi, c_lo, h[at], own, a, end[at] - first[at]))
                if len(rows) >= 512:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    def frame(rows) -> pa.RecordBatch:
        signed = lambda i: pa.array(np.concatenate([r[i] for r in rows]).view(np.int64))
        own = [x for r in rows for x in r[3]]
        cols, names = [signed(0), signed(1), signed(2)], ["c_hi", "c_lo", "hash"]
        if with_bytes:
            return pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.binary())], names=[*names, "bytes"])
        return pa.RecordBatch.from_arrays(
            [*cols, pa.array(own, pa.int64()), signed(4), signed(5)], names=[*names, "hi", "first", "windows"])

    cols = "c_hi long, c_lo long, hash long, "
    joined = texts.select("hi", "lo", "text").join(places, "hi").select("hi", "text", "places")
    return joined.mapInArrow(tidied(make), cols + ("bytes binary" if with_bytes else "hi long, first long, windows long"))


def repeated_windows(kinds: DataFrame) -> DataFrame:
    """(c_hi, c_lo, spans): the repeated windows of each context, as spans of window starts.

    ``kinds`` has c_hi, c_lo, hash, bytes and n, the context's places.
    """
    per_anchor = kinds.groupBy("hash").agg(F.sum(F.octet_length("bytes")).alias("w"))
    per_anchor = written(per_anchor.withColumn("large", F.col("w") > SHARD_BYTES), "anchor-sizes")
    total, large, count = (x or 0 for x in per_anchor.agg(
        F.sum(F.when(~F.col("large"), F.col("w"))), F.sum(F.when(F.col("large"), F.col("w"))),
        F.sum(F.col("large").cast("long"))).first())
    shards = max(1, -(-total // SHARD_BYTES))

    def pieces(table: pa.Table) -> Iterator[pa.Table]:
        """Whole anchors of a shard, of ``SHARD_BYTES`` together at most."""
        table = table.sort_by("hash")
        h = table.column("hash").to_numpy()
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in table.column("bytes").to_pylist()])])
        at = last = 0
        for end in ends.tolist():
            if sizes[end] - sizes[at] > SHARD_BYTES and last > at:
                yield table.slice(at, last - at)
                at = last
            last = end
        yield table.slice(at, last - at)

    def sort(table: pa.Table) -> pa.Table:
        return pa.concat_tables([sort_piece(p) for p in pieces(table)])

    def sort_piece(table: pa.Table) -> pa.Table:
        strings = table.column("bytes").to_pylist()
        n = table.column("n").to_numpy()
        found = repeated(strings, LENGTH)
        _, begins = shard_text(strings)
        out = []
        for b, x, k in zip(begins.tolist(), strings, n.tolist()):
            windows = len(x) - LENGTH + 1
            own = np.ones(windows, bool) if k > 1 else found[b:b + windows]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            out.append(edge.astype(np.int32).tobytes())
        return pa.table({"c_hi": table.column("c_hi"), "c_lo": table.column("c_lo"),
                         "spans": pa.array(out, pa.binary())})

    small = kinds
    if count:
        anchors_of = per_anchor.where("large").select("hash")
        if count * 8 <= BROADCAST_BYTES:
            anchors_of = F.broadcast(anchors_of)
        small = kinds.join(anchors_of, "hash", "left_anti")
    dealt = small.select("c_hi", "c_lo", "hash", "bytes", "n", F.pmod(F.xxhash64("hash"), F.lit(shards)).alias("shard"))
    found = dealt.groupBy("shard").applyInArrow(tidied_group(sort), "c_hi long, c_lo long, spans binary")
    if not count:
        return found
    # a context of b bytes has b - 199 windows, half of its bytes at most
    buckets = max(shuffle_partitions(kinds.sparkSession), -(-large // 2 * WINDOW_BYTES // HASHED_BYTES))
    return found.unionByName(hashed_windows(kinds.join(anchors_of, "hash", "left_semi"), buckets))


def hashed_windows(kinds: DataFrame, buckets: int) -> DataFrame:
    """``repeated_windows`` by the windows' own hashes, so no task holds all contexts of an anchor."""
    names = ["w_hi", "w_lo", "c_hi", "c_lo", "at", "known"]
    types = (np.int64, np.int64, np.int64, np.int64, np.int32, bool)

    def starts(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns in order of the windows' hashes, and where a new hash begins."""
        order = np.lexsort(columns[1::-1])
        columns = [x[order] for x in columns]
        hi, lo = columns[:2]
        return columns, np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])

    def fold(parts: list) -> Iterator[pa.RecordBatch]:
        digests = np.frombuffer(b"".join(p[0] for p in parts), np.int64).reshape(-1, 2)
        sizes = [len(p[0]) // 16 for p in parts]
        own = [np.repeat(np.array([p[i] for p in parts], np.int64), sizes) for i in (1, 2)]
        copies = np.repeat(np.array([p[3] for p in parts], bool), sizes)
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        (hi, lo, c_hi, c_lo, at, copies), begin = starts([digests[:, 0], digests[:, 1], *own, at, copies])
        known = ~(begin & np.append(begin[1:], True)) | copies
        columns = [hi, lo, c_hi, c_lo, at, known]
        if known.any():                          # settled here: back to the contexts, and on once
            yield _pack([x[known] for x in columns], np.full(known.sum(), -1), names)
        group = np.cumsum(begin) - 1
        columns[5] = np.logical_or.reduceat(known, np.flatnonzero(begin))[group]
        sent = [x[begin] for x in columns]
        yield _pack(sent, (sent[0].view(np.uint64) >> U(16)) % U(buckets), names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            c_hi, c_lo, n = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for r, raw in enumerate(batch.column(2)):
                raw = raw.as_py()
                digests = b"".join(hashlib.blake2b(raw[i:i + LENGTH], digest_size=16).digest()
                                   for i in range(len(raw) - LENGTH + 1))
                parts.append((digests, c_hi[r], c_lo[r], n[r] > 1))
                size += len(digests) // 16
                if size > FOLD_WINDOWS:
                    yield from fold(parts)
                    parts, size = [], 0
        if parts:
            yield from fold(parts)

    def by_context(c_hi: np.ndarray, c_lo: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Repeated windows per context as one binary."""
        order = np.lexsort((c_lo, c_hi))
        c_hi, c_lo, at = c_hi[order], c_lo[order], at[order].astype(np.int32)
        begin = np.flatnonzero(np.concatenate([[True], (c_hi[1:] != c_hi[:-1]) | (c_lo[1:] != c_lo[:-1])]))
        end = np.append(begin[1:], len(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(c_hi[begin]), pa.array(c_lo[begin]),
             pa.array([at[i:j].tobytes() for i, j in zip(begin, end)], pa.binary())], names=["c_hi", "c_lo", "at"])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                yield by_context(*(np.frombuffer(x.as_py(), t) for x, t in zip(row, types[2:5])))

    def bucket(table: pa.Table) -> pa.Table:
        columns, begin = starts([np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)])
                                 for c, t in zip(names, types)])
        _, _, c_hi, c_lo, at, known = columns
        first = np.flatnonzero(begin)
        sizes = np.diff(np.append(first, len(at)))
        more = (sizes > 1) | np.logical_or.reduceat(known, first)
        keep = np.repeat(more, sizes) & ~known
        return pa.Table.from_batches([by_context(c_hi[keep], c_lo[keep], at[keep])]) if keep.any() else empty

    def spans(at: pd.Series) -> pd.Series:
        out = []
        for parts in at:
            x = np.unique(np.concatenate([np.frombuffer(p, np.int32) for p in parts]))
            cut = np.flatnonzero(np.diff(x) > 1) + 1
            out.append(np.column_stack([x[np.append(0, cut)], x[np.append(cut - 1, len(x) - 1)] + 1]).astype(
                np.int32).tobytes())
        return pd.Series(out, dtype=object)

    empty = pa.table({"c_hi": pa.array([], pa.int64()), "c_lo": pa.array([], pa.int64()),
                      "at": pa.array([], pa.binary())})
    schema = "c_hi long, c_lo long, at binary"
    packed = written(kinds.select("c_hi", "c_lo", "bytes", "n").mapInArrow(
        tidied(make), "bucket long, " + ", ".join(f"{c} binary" for c in names)), "window-hashes")
    own = packed.where("bucket < 0").select("c_hi", "c_lo", "at").mapInArrow(settled, schema)
    others = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(tidied_group(bucket), schema)
    merged = own.union(others).groupBy("c_hi", "c_lo").agg(F.collect_list("at").alias("at"))
    return merged.select("c_hi", "c_lo", F.pandas_udf(spans, "binary")("at").alias("spans"))


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, text, hi, lo) and, per text with repeats, (hi, lo, spans): removed runs as int64 pairs."""
    spark = docs.sparkSession
    texts = _texts(docs, doc_id, text)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))
    copies = written(texts.groupBy("hi", "lo").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).cast("long").alias("n")), "copies")
    places = repeated_anchors(texts.where(F.octet_length("text") >= LENGTH), buckets)
    places = written(places.groupBy("hi").agg(F.collect_list("first").alias("places")), "anchors")
    places = _small(places, F.aggregate("places", F.lit(0), lambda a, p: a + F.octet_length(p)), broadcast_bytes)
    # a text's places once, though it may have copies
    every = contexts(texts, places, True)
    kinds = every.groupBy("c_hi", "c_lo", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes"))
    found = written(repeated_windows(written(kinds, "contexts")).where(F.octet_length("spans") > 0), "windows")
    at = contexts(texts, places, False).join(found, ["c_hi", "c_lo"]).select("hi", "first", "spans")
    per_text = at.groupBy("hi").agg(F.collect_set(F.struct("first", "spans")).alias("parts"))
    merged = per_text.select("hi", F.pandas_udf(_merge, "binary")("parts").alias("spans"))
    whole = F.expr("copies > 1 and n >= %d" % LENGTH)
    spans = copies.join(merged, "hi", "left").select(
        "hi", "lo", "n", whole.alias("whole"), "spans").where("whole or spans is not null")
    return texts, written(spans, "spans")


def _small(df: DataFrame, size, most: int) -> DataFrame:
    """``df`` to be broadcast if its checked size is small, else as it is."""
    total = df.agg(F.coalesce(F.sum(size + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df


def _merge(parts: pd.Series) -> pd.Series:
    """Byte runs [begin, end) of spans of windows, merged."""
    out = []
    for rows in parts:
        runs = []
        for row in rows:
            edge = np.frombuffer(row["spans"], np.int32).reshape(-1, 2).astype(np.int64) + row["first"]
            runs.append(edge)
        runs = np.concatenate(runs)
        runs[:, 1] += LENGTH - 1
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        reach = np.maximum.accumulate(runs[:, 1])
        new = np.concatenate([[True], runs[1:, 0] > reach[:-1]])
        begin = runs[new, 0]
        end = reach[np.append(np.flatnonzero(new)[1:] - 1, len(runs) - 1)]
        out.append(np.column_stack([begin, end]).tobytes())
    return pd.Series(out, dtype=object)


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False,
            broadcast_bytes: int = BROADCAST_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row; if wanted the ``kept`` text, without what a cut
    leaves of a character, and the columns ``carry`` as struct ``c``."""
    _, spans = covered(docs, doc_id, text, broadcast_bytes)
    texts = _texts(docs, doc_id, text, carry)
    own = _small(spans.drop("n"), F.coalesce(F.octet_length("spans"), F.lit(0)), broadcast_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data, offsets = text_bytes(part.column(1))
                gone, count, digest, left = [], [], [], []
                for r, (whole, runs) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    raw = data[offsets[r]:offsets[r + 1]].tobytes()
                    runs = [(0, len(raw))] if whole else \
                        np.frombuffer(runs, np.int64).reshape(-1, 2).tolist() if runs else []
                    kept, at = [], 0
                    for i, j in runs:
                        kept.append(raw[at:i])
                        at = j
                    rest = b"".join(kept) + raw[at:]
                    gone.append(len(raw) - len(rest))
                    count.append(len(runs))
                    digest.append(hashlib.sha256(rest).hexdigest())
                    left.append(rest.decode("utf-8", "ignore") if keep_text else None)
                out = [part.column(0), pa.array(np.diff(offsets)), pa.array(gone, pa.int64()),
                       pa.array(count, pa.int64()), pa.array(digest, pa.string())]
                out += [pa.array(left, pa.string())] if keep_text else []
                yield pa.RecordBatch.from_arrays([*out, *part.columns[4:]], names=schema.names)

    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
                                + (", kept string" if keep_text else ""))
    more = [texts.schema["c"]] if carry else []
    schema = StructType([*schema.fields, *more])
    joined = texts.join(own, ["hi", "lo"], "left").select(
        "doc_id", "text", F.coalesce("whole", F.lit(False)), "spans", *[f.name for f in more])
    return joined.mapInArrow(tidied(cut), schema)


def dedup_documents(docs: DataFrame) -> DataFrame:
    return removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
