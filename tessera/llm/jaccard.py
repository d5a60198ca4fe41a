"""N-gram Jaccard join with a token-group matrix: exact links and components.

A document's set is its distinct k-word shingles.  Equal sets are one set from
the start.  Then:

1. *Bound against all others.*  A set with a partner of Jaccard >= 0.8 shares
   at least ``c`` of its first ``n - ceil(0.8 n) + c`` shingles (in the order of
   their hashes) with it, so sets that share fewer with all other sets
   together leave at once.  Only shingle hashes are shuffled, packed.
2. *Groups of similar sets.*  Sets with an equal minimum hash (of a few) are
   compared with one of them, the centre, never pairwise.  Links make groups.
3. *Token-group matrix.*  A group's token union holds a shingle if any member
   does.  A set goes on only if enough of its shingles lie in unions of other
   groups; their number bounds its overlap with any member, hence the sizes a
   partner can have.  The sets left are dealt into units of similar ones (equal
   minimum hash of their shared shingles), of bounded size.  Rarest shingles
   first (all sets use that one order), the larger set's first
   ``n - ceil(0.8 n) + 1`` meet the units whose members have one of them among
   their own first ``m - ceil(8 m / 9) + 1``; only units whose sizes and bounds
   qualify open.
4. *Open units.*  The members of two units are compared exactly, block by
   block, by counting common shingles for all of them at a time, so sets a
   little under the threshold of each other make no row per pair.  A pair of
   blocks gives the links that connect what is linked across it, no more rows
   than it has members.

Every bound is a necessary condition, so no link between different groups is
lost, and links inside a group would not change its component.  Frequent
shingles neither collect their sets in one task (a task passes on a shingle
once, however many of its sets have it) nor pair them.

Edge cases: rows without words or text have an empty set and no link; equal
sets link whatever their size; a NULL doc_id takes part but gives no component
id; repeated rows give a row each; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidied, tidied_group, written
from tessera.llm.components import components
from tessera.llm.shingles import Powers, mix, shingle_sets, slices

K = 5
PERCENT = 80
ROUNDS = 3
BROADCAST_ROWS = 500_000      # of ids, 12 MB
BUCKET_ENTRIES = 1 << 21      # packed entries of a bucket, on average
MIN_BUCKETS = 16
FOLD_ENTRIES = 1 << 18        # entries a task folds at a time
BLOCK_ENTRIES = 1 << 16       # shingles of a block of sets, on average
LEAST_ENTRIES = 64            # that a set counts for, so a block has about 1,024 members at most
SETTLED_ENTRIES = 1 << 18     # entries of a bucket that are sorted at a time, on average
EXPAND = 1 << 20              # meetings on common shingles that are counted one by one; beyond, by products
PRODUCT_CELLS = 1 << 20       # cells of the factors of such a product

U = np.uint64


def _least(n, percent: int = PERCENT):
    """Shingles that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def _rows_of_sets(batch: pa.RecordBatch, powers: Powers) -> Iterator[tuple[int, np.ndarray]]:
    for part, base in _parts(batch):
        hashes, ends = shingle_sets(part.column(1), powers, K)
        at = 0
        for r, end in enumerate(ends.tolist()):
            yield base + r, hashes[at:end]
            at = end


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    base = 0
    for part in slices(batch, 1):
        yield part, base
        base += len(part)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _signature(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return int(mix(own, 11).sum(dtype=np.uint64)), int(mix(own, 12).sum(dtype=np.uint64))


def features(docs: DataFrame, with_tokens: bool = False) -> DataFrame:
    """doc_id, n, hi, lo (the set's signature) and, if wanted, ``tokens`` per row of (doc_id, text)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part, _ in _parts(batch):
                hashes, ends = shingle_sets(part.column(1), powers, K)
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                sums = [np.concatenate([[U(0)], np.cumsum(mix(hashes, s), dtype=np.uint64)]) for s in (11, 12)]
                cols = [part.column(0), pa.array((ends - begins).astype(np.int64)),
                        _signed(sums[0][ends] - sums[0][begins]), _signed(sums[1][ends] - sums[1][begins])]
                names = ["doc_id", "n", "hi", "lo"]
                if with_tokens:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(offsets, _signed(hashes)))
                    names.append("tokens")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n long, hi long, lo long" + (", tokens array<long>" if with_tokens else "")
    return docs.mapInArrow(tidied(make), schema)


# ---- shared shingles: how many of a set's (chosen) shingles other groups have, without collecting any shingle's sets


class _Fold:
    """Packs entries (token, set, group) of a task by bucket; a token that the task has in two groups is
    settled here and goes on once."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.parts: list[tuple[np.ndarray, int, int]] = []
        self.size = 0
        self.seen: set[int] = set()

    def add(self, tokens: np.ndarray, own: int, group: int) -> None:
        if own in self.seen:                     # a copy
            return
        self.seen.add(own)
        self.parts.append((tokens, own, group))
        self.size += len(tokens)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        sizes = [len(t) for t, _, _ in self.parts]
        tokens = np.concatenate([t for t, _, _ in self.parts])
        own = np.repeat(np.array([o for _, o, _ in self.parts], np.uint64), sizes)
        group = np.repeat(np.array([g for _, _, g in self.parts], np.uint64), sizes)
        same = all(o == g for _, o, g in self.parts)
        self.parts, self.size = [], 0
        self.seen.clear()
        tokens, own, group, shared = _by_token(tokens, own, group)
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        send = ~shared | first
        bucket = (tokens >> U(20)) % U(self.buckets)
        yield _credits(own[shared])
        order = np.argsort(bucket[send], kind="stable")
        bucket, columns = bucket[send][order], [x[send][order] for x in (tokens, own, group)]
        flag = shared[send][order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        begin = np.concatenate([[0], cuts])
        end = np.concatenate([cuts, [len(bucket)]])
        blobs = [[x[a:b].tobytes() for a, b in zip(begin, end)] for x in (*columns, flag)]
        if same:                                 # each set its own group: no need to send it twice
            blobs[2] = [b""] * len(begin)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[begin].astype(np.int64)), *[pa.array(b, pa.binary()) for b in blobs]], names=_PACKED)


_PACKED = ["bucket", "tokens", "own", "groups", "shared"]


def _by_token(tokens, own, group):
    """Entries in order of token, and which tokens lie in two groups at least."""
    order = np.argsort(tokens, kind="stable")
    tokens, own, group = tokens[order], own[order], group[order]
    if not len(tokens):
        return tokens, own, group, np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    lengths = np.diff(np.concatenate([begin, [len(tokens)]]))
    shared = np.minimum.reduceat(group, begin) != np.maximum.reduceat(group, begin)
    return tokens, own, group, np.repeat(shared, lengths)


def _credits(own: np.ndarray) -> pa.RecordBatch:
    """Sets and their numbers of shared tokens, under bucket -1."""
    keys, counts = np.unique(own, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([-1], pa.int64()), pa.array([counts.astype("<u8").tobytes()], pa.binary()),
         pa.array([keys.tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())],
        names=_PACKED)


def shared_counts(packed: DataFrame) -> DataFrame:
    """(own, shared): per set the number of its packed tokens that lie in another group too."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts, keys in zip(batch.column(0), batch.column(1)):
                yield counted(np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(counts.as_py(), "<u8"))

    def counted(keys, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [_signed(keys), pa.array(counts.astype(np.int64))], names=["own", "shared"])

    def bucket(table: pa.Table) -> pa.Table:
        # views of the table's own bytes; a bucket is settled in ranges of its tokens, a few entries at a time
        view = lambda x, t: np.frombuffer(x.as_buffer(), t)
        rows = [(view(t, U), view(o, U), view(g, U), view(k, bool)) for t, o, g, k in zip(
            *(table.column(c) for c in _PACKED[1:]))]
        rows = [(t, o, g if len(g) else o, k) for t, o, g, k in rows]
        parts = -(-sum(len(t) for t, *_ in rows) // SETTLED_ENTRIES)
        keys, counts = [], []
        for part in range(parts):
            tokens, own, group, known = (np.concatenate(x) for x in zip(
                *[[x[here] for x in row] for row in rows for here in [(row[0] >> U(8)) % U(parts) == part]]))
            order = np.argsort(tokens, kind="stable")
            tokens, own, group, known = tokens[order], own[order], group[order], known[order]
            if not len(tokens):
                continue
            begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            lengths = np.diff(np.concatenate([begin, [len(tokens)]]))
            shared = np.minimum.reduceat(group, begin) != np.maximum.reduceat(group, begin)
            shared |= np.logical_or.reduceat(known, begin)
            # entries settled by their task already have their credit
            k, c = np.unique(own[np.repeat(shared, lengths) & ~known], return_counts=True)
            keys.append(k)
            counts.append(c)
        none = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        return pa.Table.from_batches([counted(np.concatenate(keys or none[0]), np.concatenate(counts or none[1]))])

    schema = "own long, shared long"
    settled = packed.where("bucket = -1").select("tokens", "own").mapInArrow(unpack, schema)
    others = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(tidied_group(bucket), schema)
    return settled.union(others).groupBy("own").agg(F.sum("shared").alias("shared"))


_PACKED_SCHEMA = "bucket long, tokens binary, own binary, groups binary, shared binary"


def pack_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed first shingles of the texts' sets; every set is a group of its own."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, fold = Powers(), _Fold(buckets)
        for batch in batches:
            for _, own in _rows_of_sets(batch, powers):
                n = len(own)
                if n:
                    key = _signature(own)[0]
                    fold.add(own[:n - _least(n) + 1 + n // 10], key, key)
                if fold.size > FOLD_ENTRIES:
                    yield from fold.flush()
        yield from fold.flush()

    return docs.mapInArrow(tidied(make), _PACKED_SCHEMA)


def pack_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """Packed first shingles of (own, grp, tokens): one more than a set's own bound asks for, as a partner of 5
    shares two with a set of 4."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(buckets)
        for batch in batches:
            tokens = batch.column(2)
            flat = np.asarray(tokens.values).view(np.uint64)
            offsets = tokens.offsets.to_numpy()
            own, group = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            for r in range(len(batch)):
                first = offsets[r]
                n = int(offsets[r + 1] - first)
                fold.add(flat[first:first + min(n, n - _least(n) + 2 + n // 5)], int(own[r]), int(group[r]))
                if fold.size > FOLD_ENTRIES:
                    yield from fold.flush()
        yield from fold.flush()

    return sets.select("own", "grp", "tokens").mapInArrow(tidied(make), _PACKED_SCHEMA)


# ---- links


def _linked(a_n, b_n, common, percent: int = PERCENT):
    return common * 100 >= (a_n + b_n - common) * percent


def _common(a, b):
    return F.size(F.array_intersect(a, b))


def star_links(sets: DataFrame, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(u, v) links between sets and the centres of the sets with the same minimum hash, under some hashes."""
    keys = [F.struct(F.lit(r).alias("r"), F.array_min(F.transform(
        "tokens", lambda t, r=r: F.xxhash64(t, F.lit(r).cast("long")))).alias("h")) for r in range(rounds)]
    keyed = written(sets.select("own", "n", F.explode(F.array(*keys)).alias("key")), "keys")
    centres = keyed.groupBy("key").agg(
        F.min(F.struct("n", "own")).alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    near = keyed.join(centres, "key").select("own", F.col("c.own").alias("v")).where("own <> v").distinct()
    return verified(near, sets, broadcast_rows)


def _small(ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """``ids``, to be broadcast if there are few."""
    return F.broadcast(ids) if ids.count() <= broadcast_rows else ids


def verified(pairs: DataFrame, sets: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The (own, v) of ``pairs`` that link, as (u, v); only sets in a pair are shuffled."""
    pairs = written(pairs, "pairs")
    met = pairs.select("own").union(pairs.select(F.col("v").alias("own"))).distinct()
    sets = written(sets.join(_small(met, broadcast_rows), "own", "left_semi"), "paired")
    a = sets.select("own", F.col("n").alias("a_n"), F.col("tokens").alias("a"))
    b = sets.select(F.col("own").alias("v"), F.col("n").alias("b_n"), F.col("tokens").alias("b"))
    both = pairs.join(a, "own").join(b, "v")
    return written(both.where(_linked(F.col("a_n"), F.col("b_n"), _common("a", "b"))).select(
        F.col("own").alias("u"), "v").distinct(), "links")


def matrix_links(sets: DataFrame, buckets: int) -> DataFrame:
    """(u, v) links between sets of different groups; ``sets`` has own, n, tokens and grp."""
    counts = shared_counts(pack_sets(sets, buckets))
    able = written(sets.join(counts, "own").where("shared >= 1 + n div 5"), "able")
    entries = able.select("own", "grp", "n", F.explode("tokens").alias("t"))
    # one order for all, rare first; shingles of one group only are the rarest and take the first places
    rare = entries.select("t", "grp").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = entries.join(rare, "t").groupBy("own", "grp", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "t"))).alias("order"))
    # overlap >= 4 / 9 of both sizes together, hence no partner is larger than ``top``
    ranked = written(ranked.where(F.size("order") >= _sql_least("n")).withColumn(
        "top", F.expr("(9 * size(order)) div 4 - n")), "ranked")

    tokens = F.transform("order", lambda o: o["t"])
    members = written(units(ranked.withColumn("tokens", tokens)).drop("tokens"), "members")

    def prefix(least: str, name: str) -> DataFrame:
        """Per shingle and unit, what bounds the members that have it among their first ones."""
        first = F.greatest(F.lit(0), F.expr(f"size(order) - {least} + 1")).cast("int")
        own = members.select("unit", "grp", "n", "top", F.explode(F.slice("order", F.lit(1), first)).alias("o"))
        return own.groupBy(F.col("o.t").alias("t"), F.col("unit").alias("unit" + name)).agg(
            F.min("n").alias("low" + name), F.max("n").alias("high" + name), F.max("top").alias("most" + name),
            F.min("grp").alias("g_low" + name), F.max("grp").alias("g_high" + name))

    # the larger set asks, the smaller one answers: its overlap is 8 / 9 of its own size at least
    asks = prefix("((4 * n + 4) div 5)", "_a")
    answers = prefix("((8 * n + 8) div 9)", "_b")
    other = (F.least("g_low_a", "g_low_b") != F.greatest("g_high_a", "g_high_b"))
    fits = (F.col("low_b") <= F.least("high_a", "most_a")) & (
        F.col("high_b") * 100 >= F.col("low_a") * PERCENT) & (F.col("most_b") >= F.col("low_a"))
    opened = asks.join(answers, "t").where(other & fits).select(
        F.least("unit_a", "unit_b").alias("unit_a"), F.greatest("unit_a", "unit_b").alias("unit_b")).distinct()
    blocks = written(members.groupBy("unit", "block").agg(
        F.collect_list(F.struct("own", "grp", "n", tokens.alias("tokens"))).alias("m")), "blocks")
    side = lambda x: blocks.select(F.col("unit").alias("unit_" + x), F.col("block").alias("block_" + x))
    pairs = opened.join(side("a"), "unit_a").join(side("b"), "unit_b").where(
        "unit_a <> unit_b or block_a <= block_b").select("block_a", "block_b")
    rows = lambda x: blocks.select(F.col("block").alias("block_" + x), F.col("m").alias(x))
    both = pairs.join(rows("a"), "block_a").join(rows("b"), "block_b").select("a", "b")
    return written(both.mapInArrow(tidied(_compare), "u long, v long").distinct(), "links")


def units(sets: DataFrame) -> DataFrame:
    """``sets`` (own, grp, tokens, ...) with ``unit`` and ``block``: sets with one minimum hash share units.

    What a group has under a minimum hash is a unit of its own if it fills a block, cut into as many; the
    smaller groups under that hash are dealt into units of one block each.
    """
    weight = F.greatest(F.size("tokens"), F.lit(LEAST_ENTRIES)).cast("long")
    keyed = sets.withColumn("key", F.array_min(F.transform("tokens", lambda t: F.xxhash64(t))))
    of_group = written(keyed.groupBy("key", "grp").agg(F.sum(weight).alias("w")), "unit-sizes")
    parts = lambda c: F.ceil(F.col(c) / BLOCK_ENTRIES).cast("long")
    # what fills more than a block is few rows, one for so many shingles; all else is one block, without a look-up
    alone = of_group.where(F.col("w") >= BLOCK_ENTRIES).select("key", "grp", parts("w").alias("cuts"))
    rest = of_group.where(F.col("w") < BLOCK_ENTRIES).groupBy("key").agg(F.sum("w").alias("rest")).where(
        F.col("rest") > BLOCK_ENTRIES).select("key", parts("rest").alias("parts"))
    dealt = keyed.join(F.broadcast(alone), ["key", "grp"], "left").join(F.broadcast(rest), "key", "left")
    unit = F.when(F.col("cuts").isNotNull(), F.xxhash64("key", "grp", F.lit(1))).otherwise(
        F.xxhash64("key", F.pmod(F.xxhash64("grp"), F.coalesce("parts", F.lit(1).cast("long"))), F.lit(2)))
    return dealt.withColumn("unit", unit).withColumn("block", F.xxhash64("unit", F.pmod(
        F.xxhash64("own"), F.coalesce("cuts", F.lit(1).cast("long"))))).drop("key", "cuts", "parts")


def _block(rows: pa.Array) -> tuple[np.ndarray, ...]:
    """own, grp, n and size of the members, and all their shingles."""
    tokens = rows.field("tokens")
    size = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
    own, grp, n = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("own", "grp", "n"))
    return own, grp, n, size, tokens.flatten().to_numpy(zero_copy_only=False)


def common_counts(a: np.ndarray, a_row: np.ndarray, a_rows: int,
                  b: np.ndarray, b_row: np.ndarray, b_rows: int) -> np.ndarray:
    """Matrix of the numbers of tokens that rows of ``a`` and of ``b`` have in common."""
    both = np.intersect1d(a, b)
    out = np.zeros((a_rows, b_rows), np.int64)
    if not len(both):
        return out
    column = []
    for x, row in ((a, a_row), (b, b_row)):
        at = np.minimum(np.searchsorted(both, x), len(both) - 1)
        hit = both[at] == x
        order = np.argsort(at[hit], kind="stable")
        column.append((at[hit][order], row[hit][order]))
    (ca, ra), (cb, rb) = column
    na, nb = np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))
    if int((na * nb).sum()) <= EXPAND:
        begin = np.concatenate([[0], np.cumsum(nb)[:-1]])
        times = nb[ca]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cell = np.repeat(ra, times) * b_rows + rb[np.repeat(begin[ca], times) + inside]
        return np.bincount(cell, minlength=a_rows * b_rows).reshape(a_rows, b_rows)
    step = max(1, PRODUCT_CELLS // (a_rows + b_rows))
    for at in range(0, len(both), step):
        end = min(len(both), at + step)
        factors = []
        for c, r, rows in ((ca, ra, a_rows), (cb, rb, b_rows)):
            i, j = np.searchsorted(c, [at, end])
            f = np.zeros((rows, end - at), np.float32)
            f[r[i:j], c[i:j] - at] = 1
            factors.append(f)
        out += (factors[0] @ factors[1].T).astype(np.int64)     # exact: a product has fewer columns than 2^24
    return out


def block_links(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) that connect the members of two blocks which links between different groups connect."""
    (own_a, grp_a, n_a, size_a, tok_a), (own_b, grp_b, n_b, size_b, tok_b) = a, b
    common = common_counts(tok_a, np.repeat(np.arange(len(own_a)), size_a), len(own_a),
                           tok_b, np.repeat(np.arange(len(own_b)), size_b), len(own_b))
    linked = (common > 0) & (common * 100 >= (n_a[:, None] + n_b[None, :] - common) * PERCENT)
    linked &= grp_a[:, None] != grp_b[None, :]
    far = len(own_a)
    label = np.arange(far)
    while True:
        label_b = np.where(linked, label[:, None], far).min(axis=0)
        now = np.minimum(label, np.where(linked, label_b[None, :], far).min(axis=1))
        if np.array_equal(now, label):
            break
        label = now
    moved, found = np.flatnonzero(label != np.arange(far)), np.flatnonzero(label_b < far)
    u = np.concatenate([own_a[moved], own_b[found]])
    v = np.concatenate([own_a[label[moved]], own_a[label_b[found]]])
    return u[u != v], v[u != v]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        ends = [batch.column(i).offsets.to_numpy() for i in (0, 1)]
        for r in range(len(batch)):
            a, b = (_block(batch.column(i).values.slice(ends[i][r], ends[i][r + 1] - ends[i][r])) for i in (0, 1))
            u, v = block_links(a, b)
            us.append(u)
            vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.int64)) for x in (us, vs)], names=["u", "v"])


def _sql_least(n: str):
    """``_least`` as a column."""
    return F.expr(f"({n} * {PERCENT} + 99) div 100")


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id per row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    feats = written(features(rows), "sets")
    total = feats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(MIN_BUCKETS, -(-total // (3 * BUCKET_ENTRIES)))
    # one row per different set, under the id of one of its documents
    kinds = written(feats.where("n > 0").groupBy("hi", "lo").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("doc_id")), "kinds")
    counts = shared_counts(pack_texts(rows, buckets))
    chosen = written(kinds.join(counts.withColumnRenamed("own", "hi"), "hi").where(
        "shared >= 1 + n div 10").select("hi", "lo", "doc_id"), "chosen")
    ids = chosen.select(F.col("doc_id").alias("_id"), "hi", "lo")
    if chosen.count() <= broadcast_rows:         # 24 bytes a row
        ids = F.broadcast(ids)
    texts = rows.join(ids.select("_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = features(texts, with_tokens=True).join(ids.select("hi", "lo"), ["hi", "lo"], "left_semi")
    # the signature's first half names a set among those that are left
    sets = written(sets.select(F.col("hi").alias("own"), "n", "tokens"), "tokens")
    if not sets.groupBy("own").count().where("count > 1").isEmpty():     # repeated rows, or NULL ids with one text
        sets = written(sets.dropDuplicates(["own"]), "sets-once")
    stars = star_links(sets)
    groups = components(stars).select(F.col("vertex").alias("own"), F.col("component").alias("grp"))
    grouped = sets.join(_small(groups, broadcast_rows), "own", "left").withColumn("grp", F.coalesce("grp", "own"))
    links = stars.union(matrix_links(grouped, buckets))
    found = components(links).select(F.col("vertex").alias("hi"), F.col("component").alias("c"))
    classes = kinds.join(found, "hi", "left").select("hi", "lo", "doc_id", F.coalesce("c", "hi").alias("c"))
    least = classes.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_set = written(classes.join(least, "c").select("hi", "lo", "component_id"), "classes")
    return feats.join(of_set, ["hi", "lo"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
