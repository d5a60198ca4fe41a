"""Operators applied as pipeline stages: documents in, documents out.

Every stage keeps the input's columns and the rows it has no reason to drop.
Edge cases: NULL texts are empty texts and stay unless a stage's decision
drops them; rows with a NULL doc_id cannot name a group, so the near-duplicate
stage keeps them; rows repeated under one doc_id are copies, of which it keeps
one; columns of any other name pass through, whatever they are called; very
long texts are judged whole; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, pack, quality, repeats
from tessera.llm.common import small_batches, written

BROADCAST_ROWS = 500_000     # of ids, 4 MB


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Documents that the classifier, learned from the labels, takes for good."""
    small_batches(docs.sparkSession)
    stats = written(quality.document_statistics(docs), "quality-stats")
    model = quality.fit(stats, labels, label)
    return docs.where(quality.text_score(model)(F.col("text")) >= 0.5)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies."""
    small_batches(docs.sparkSession)
    found = written(jaccard.join_documents(docs), "classes")
    ids = written(found.where("doc_id = component_id").groupBy("doc_id").count(), "kept-ids")
    rows, most = ids.agg(F.count(F.lit(1)), F.max("count")).first()
    chosen = ids.select(F.col("doc_id").alias("_id"))
    if rows <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    kept = docs.where("doc_id is not null").alias("d").join(
        chosen.alias("k"), F.col("d.doc_id") == F.col("k._id"), "left_semi")
    if most is not None and most > 1:
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents with every byte of a repeated passage cut out (and what is left of a cut character)."""
    small_batches(docs.sparkSession)
    kept = repeats.removed(docs, keep_text=True, carry=tuple(docs.columns))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("c.text"))
    out = kept.withColumn("_text", text)
    cols = {c: F.col("_text") if c == "text" else F.length("_text").cast("long") if c == "n_chars"
            else F.col(f"c.`{c}`") for c in docs.columns}
    return out.select(*[v.alias(c) for c, v in cols.items()])


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any window of the benchmark."""
    small_batches(docs.sparkSession)
    cols = docs.columns
    found = decontaminate.find_leaks(docs.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in cols])), benchmark,
                                     keep=("_all",))
    return found.where(F.size("spans") == 0).select(*[F.col(f"_all.`{c}`").alias(c) for c in cols])


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces and their places, as the packing operator returns them."""
    small_batches(docs.sparkSession)
    return pack.pack_documents(docs, tokenizer or pack.tokenizer_path("word_bpe_49k.json"), lean=True)
