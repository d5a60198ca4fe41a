"""JSON array files read by several tasks (op 1).

A file that holds one array has no line per record, so Spark's JSON reader
takes it as a whole, in one task.  Here it is read as text cut at every ``}``,
which Spark splits by byte ranges like lines.  Where records begin and end
follows from two facts about the text before a place: whether it lies inside
a string, and how many braces are open.  Both add up over splits:

1. each split is summed up for either answer to "does it begin inside a
   string" (narrow: a row per split);
2. the sums of a file's splits are put in sequence, which gives every split's
   true beginning;
3. each split gives the piece that ends a record begun before it;
4. each split gives its records in order, the last one completed by the pieces
   of the splits after it.

Records stay with the split they begin in, in their order, so
``operators.order.number_lines`` numbers them like lines.  The file is read
three times and nothing but sums and border pieces is exchanged.

Arrays of objects only; other elements, or text between records that is not a
comma, fail the job, as does an array that ends inside a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.order import BROADCAST_GROUPS, materialise_scratch

END = "}"
ESCAPED = re.compile(r"\\.", re.S)
BETWEEN = " \t\r\n,"
BOM = "\ufeff"


def braces(text: str) -> tuple[int, int, int]:
    """Quotes of a fragment, and its opening braces outside strings if it begins outside or inside one."""
    if "\\" in text:
        text = ESCAPED.sub("", text)
    parts = text.split('"')
    return len(parts) - 1, sum(p.count("{") for p in parts[::2]), sum(p.count("{") for p in parts[1::2])


def after(text: str, inside: bool, depth: int) -> tuple[bool, int]:
    """(inside a string, open braces) behind a fragment and the brace that ends it."""
    quotes, out, within = braces(text)
    depth += within if inside else out
    inside ^= bool(quotes & 1)
    return inside, depth if inside else depth - 1


class Records:
    """Fragments of one split in, records of it out; ``inside`` and ``depth`` are what its beginning lies in."""

    def __init__(self, inside: bool = False, depth: int = 0, first: bool = False):
        self.inside, self.depth = inside, depth
        self.open = inside or depth > 0          # a record begun before the split is not done yet
        self.head: list[str] = []                # its fragments
        self.parts: list[str] = []               # the fragments of the record that is open now
        self.first, self.ended = first, False    # at the file's beginning; behind its last record

    def add(self, text: str) -> str | None:
        """The record that the fragment ends, if it began in this split."""
        if self.open:
            self.head.append(text + END)
            self.inside, self.depth = after(text, self.inside, self.depth)
            self.open = self.inside or self.depth > 0
            return None
        if not self.parts:
            begin = text.find("{")
            lead = (text[:begin] if begin >= 0 else text).lstrip(BOM).strip(BETWEEN)
            if self.first and lead.startswith("["):
                lead = lead[1:].strip(BETWEEN)
            if self.ended or lead not in ("", "]"[:begin < 0]):
                raise ValueError(f"malformed array: {text[:80]!r} between records")
            self.first, self.ended = False, begin < 0
            if self.ended:
                return None
            text = text[begin:]
        self.parts.append(text)
        self.inside, self.depth = after(text, self.inside, self.depth)
        if self.inside or self.depth > 0:
            return None
        record, self.parts = END.join(self.parts) + END, []
        return record


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, start, further columns), fragments) of each split, in order; a partition may hold several."""
    def rows():
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield from zip(*columns)

    stream = rows()
    row = next(stream, None)
    while row is not None:
        key = row[1:]

        def fragments():
            nonlocal row
            while row is not None and row[1:] == key:  # noqa: B023
                yield row[0] or ""
                row = next(stream, None)

        own = fragments()
        yield key, own
        for _ in own:                            # what the caller left
            pass


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start), fragments in _splits(batches):
        state, depth = [False, True], [0, 0]
        for text in fragments:
            for s in (0, 1):
                state[s], depth[s] = after(text, state[s], depth[s])
        yield pa.RecordBatch.from_pylist([{"_file": file, "_start": start, "ends0": state[0], "ends1": state[1],
                                           "depth0": depth[0], "depth1": depth[1]}], schema=_SUMS)


_SUMS = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("ends0", pa.bool_()), ("ends1", pa.bool_()),
                   ("depth0", pa.int64()), ("depth1", pa.int64())])


def _in_sequence(splits: pd.DataFrame) -> pd.DataFrame:
    """What each split of one file begins in."""
    splits = splits.sort_values("_start")
    inside, depth, begins = False, 0, []
    for ends0, ends1, depth0, depth1 in zip(*(splits[c].tolist() for c in ("ends0", "ends1", "depth0", "depth1"))):
        begins.append((inside, depth))
        inside, depth = (ends1, depth + depth1) if inside else (ends0, depth + depth0)
    last = [False] * (len(begins) - 1) + [True]
    return splits[["_file", "_start"]].assign(inside=[i for i, _ in begins], depth=[d for _, d in begins], last=last)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The piece of each split that belongs to a record begun before it, and whether that record ends in it."""
    for (file, start, inside, depth, _), fragments in _splits(batches):
        split = Records(inside, depth, first=start == 0)
        for text in fragments:
            if not split.open:
                break
            split.add(text)
        yield pa.RecordBatch.from_pylist([{"_file": file, "_start": start, "head": "".join(split.head), "done": not split.open}],
                                         schema=_HEADS)


_HEADS = pa.schema([("_file", pa.string()), ("_start", pa.int64()), ("head", pa.string()), ("done", pa.bool_())])


def _rests(splits: pd.DataFrame) -> pd.DataFrame:
    """What completes the last record of each split of one file: the heads behind it, up to one that is done."""
    splits = splits.sort_values("_start")
    rests, rest = [], []
    for head, done in zip(splits["head"].tolist()[::-1], splits["done"].tolist()[::-1]):
        rests.append("".join(rest[::-1]))
        rest = [head] if done else [*rest, head]
    return splits[["_file", "_start"]].assign(rest=rests[::-1])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, start, inside, depth, last, rest), fragments in _splits(batches):
        split, held = Records(inside, depth, first=start == 0), []
        for text in fragments:
            record = split.add(text)
            if record is not None:
                held.append(record)
            if len(held) >= 1000:
                yield _batch(held, file, start)
                held = []
        if last and not split.ended:
            raise ValueError(f"malformed array: {file} ends before its last bracket")
        if split.parts:
            held.append(END.join(split.parts) + END + rest)
        if held:
            yield _batch(held, file, start)


def _batch(records: list[str], file: str, start: int) -> pa.RecordBatch:
    n = len(records)
    return pa.RecordBatch.from_arrays([pa.array(records), pa.array([file] * n), pa.array([start] * n, pa.int64())],
                                      names=["value", "_file", "_start"])


def array_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, _file, _start): the records of array files as JSON texts, in order inside each split."""
    fragments = spark.read.option("lineSep", END).text(paths).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    sums = fragments.mapInArrow(_sums, "_file string, _start long, ends0 boolean, ends1 boolean, depth0 long, depth1 long")
    begins = sums.groupBy("_file").applyInPandas(_in_sequence, "_file string, _start long, inside boolean, depth long, last boolean")
    begins = materialise_scratch(begins, "array-begins")         # a row per scan split
    few = begins.count() <= BROADCAST_GROUPS
    side = lambda df: F.broadcast(df) if few else df
    placed = fragments.join(side(begins), ["_file", "_start"]).select(
        "value", "_file", "_start", "inside", "depth", "last")
    heads = placed.mapInArrow(_heads, "_file string, _start long, head string, done boolean")
    rests = heads.groupBy("_file").applyInPandas(_rests, "_file string, _start long, rest string")
    rests = materialise_scratch(rests, "array-rests")             # at most a record per split
    whole = placed.join(side(rests), ["_file", "_start"]).select(
        "value", "_file", "_start", "inside", "depth", "last", "rest")
    return whole.mapInArrow(_records, "value string, _file string, _start long")
