"""Preference, likelihood and reward metrics over tables of log-probs (ops 52-59).

Input is a long table of per-token log-probs produced elsewhere
(``seq_id, pair_id, side, tok_pos, label, logp[, ref_logp]``); everything is
an aggregation or a column expression.  The only shuffle is the per-sequence
``groupBy``; pair-level work then stays on the pair key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import col
from tessera.functions.fixed import DEFAULT_BETA, DEFAULT_DRO_WEIGHT, IGNORE_INDEX

LOSS_KINDS = ("sigmoid", "ipo", "simpo", "orpo", "reward")
SIMPO_GAMMA = 0.5  # default target reward margin of SimPO


def log_sigmoid(x: Column) -> Column:
    """Stable log(sigmoid(x)) = min(x, 0) - ln(1 + exp(-|x|))."""
    return F.least(x, F.lit(0.0)) - F.log(F.lit(1.0) + F.exp(-F.abs(x)))


def sequence_logps(tok: DataFrame, value: str = "logp", average: bool = False,
                   keys=("seq_id", "pair_id", "side"), out: str = "seq_logp",
                   extra: dict[str, str] | None = None) -> DataFrame:
    """Per sequence: shift by one (position 0 is never predicted), ignore -100
    labels, sum the log-probs (or their mean) and count the tokens (op 52).

    ``extra`` maps further value columns to output names (e.g. the reference
    model's log-probs) so that one pass over the token table serves both.
    """
    mask = (F.col("tok_pos") >= 1) & (F.col("label") != F.lit(IGNORE_INDEX))
    values = {out: value, **(extra or {})}
    agg = tok.groupBy(*keys).agg(
        F.sum(mask.cast("bigint")).alias("n_completion"),
        *[F.sum(F.when(mask, col(v)).otherwise(F.lit(0.0))).alias(f"_s_{o}") for o, v in values.items()],
    )
    for o in values:
        s = F.col(f"_s_{o}")
        agg = agg.withColumn(o, (F.try_divide(s, F.col("n_completion")) if average else s).cast("double")).drop(f"_s_{o}")
    return agg


def pair_sides(seqs: DataFrame, value: str = "seq_logp", pair: str = "pair_id",
               names=("chosen", "rejected"), prefix: str = "policy",
               extra: dict[str, str] | None = None) -> DataFrame:
    """Long (one row per side) → wide (one row per pair) (op 53).
    ``extra`` maps further per-side columns to output prefixes."""
    a, b = names
    cols = {prefix: value, **{p: v for v, p in (extra or {}).items()}}
    aggs = []
    for pre, v in cols.items():
        aggs += [F.max(F.when(F.col("side") == a, col(v))).alias(f"{pre}_{a}"),
                 F.max(F.when(F.col("side") == b, col(v))).alias(f"{pre}_{b}")]
    aggs += [F.max(F.when(F.col("side") == a, F.col("n_completion"))).alias(f"n_{a}"),
             F.max(F.when(F.col("side") == b, F.col("n_completion"))).alias(f"n_{b}")]
    return seqs.groupBy(pair).agg(*aggs)


def reference_logps(pairs: DataFrame, precomputed: DataFrame | None, recomputed: DataFrame,
                    use_precomputed: bool, pair: str = "pair_id") -> DataFrame:
    """Reference values: precomputed ones when both sides are present and the
    switch (precompute or RPO weight) is on, otherwise the recomputed ones (op 54)."""
    out = pairs.join(recomputed, pair, "left")
    if precomputed is None or not use_precomputed:
        return out
    pre = precomputed.select(pair, F.col("reference_chosen").alias("_pc"), F.col("reference_rejected").alias("_pr"))
    both = F.col("_pc").isNotNull() & F.col("_pr").isNotNull()
    return (
        out.join(pre, pair, "left")
        .withColumn("reference_chosen", F.when(both, F.col("_pc")).otherwise(F.col("reference_chosen")))
        .withColumn("reference_rejected", F.when(both, F.col("_pr")).otherwise(F.col("reference_rejected")))
        .drop("_pc", "_pr")
    )


class ReferenceCache:
    """Reference log-probs by pair (op 54), kept in a folder of versions.

    ``fill`` recomputes values only for pairs that have not both of them yet
    (an anti-join) and adds them as one more version; a version counts once it
    is written to its end, and of a pair that several hold the newest counts.
    """

    COLS = ("reference_chosen", "reference_rejected")

    def __init__(self, spark, root: str, pair: str = "pair_id"):
        self.spark, self.root, self.pair = spark, root.rstrip("/"), pair

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/version=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(str(s.getPath().getParent().getName()).split("=")[1]) for s in found)

    def read(self) -> DataFrame | None:
        """(pair, reference_chosen, reference_rejected, version) of the pairs with both values; None before any."""
        versions = self._versions()
        if not versions:
            return None
        held = self.spark.read.option("basePath", self.root).parquet(*[f"{self.root}/version={v}" for v in versions])
        held = held.where(F.col(self.COLS[0]).isNotNull() & F.col(self.COLS[1]).isNotNull())
        if len(versions) == 1:
            return held.select(self.pair, *self.COLS, "version")
        newest = held.groupBy(self.pair).agg(F.max(F.struct("version", *self.COLS)).alias("_n"))
        return newest.select(self.pair, *[F.col(f"_n.{c}").alias(c) for c in self.COLS], F.col("_n.version").alias("version"))

    def add(self, values: DataFrame) -> int:
        """Write (pair, reference_chosen, reference_rejected) rows as the next version; returns its number."""
        version = max(self._versions(), default=-1) + 1
        values.select(self.pair, *self.COLS).write.mode("overwrite").parquet(f"{self.root}/version={version}")
        return version

    def missing(self, pairs: DataFrame) -> DataFrame:
        """The pairs without both values."""
        held = self.read()
        return pairs if held is None else pairs.join(held.select(self.pair), self.pair, "left_anti")

    def fill(self, pairs: DataFrame, recompute) -> DataFrame:
        """``pairs`` with their reference values and the version each came from; ``recompute(missing pairs)``
        gives values for the missing ones."""
        missing = self.missing(pairs)
        if not missing.isEmpty():
            self.add(recompute(missing))
        return pairs.join(self.read(), self.pair, "left")


def preference_loss(pairs: DataFrame, kind: str = "sigmoid", beta: float = DEFAULT_BETA,
                    ipo_double: bool = True, rpo_alpha: float | None = None, nll: str | None = None,
                    gamma: float = SIMPO_GAMMA) -> DataFrame:
    """Pair loss and implicit rewards (op 55).

    Inputs per pair: ``policy_chosen, policy_rejected`` (+ ``reference_chosen,
    reference_rejected`` for sigmoid/ipo), lengths ``n_chosen, n_rejected``.
    * sigmoid (DPO):  -logsigmoid(beta * ((pc - pr) - (rc - rr)))
    * ipo:   (logits - 1/(2 beta))^2 on length-averaged log-probs, divided by
      the length once more when ``ipo_double`` (the reference's behaviour)
    * simpo: -logsigmoid(beta * (pc - pr) - gamma) on averaged log-probs
    * orpo:  -beta * logsigmoid(log-odds(pc) - log-odds(pr)) on averaged log-probs
    * reward: -logsigmoid(r_chosen - r_rejected) on scalar rewards
    An RPO weight adds ``rpo_alpha * nll``.
    """
    if kind not in LOSS_KINDS:
        raise ValueError(f"unknown loss kind {kind!r}; known: {LOSS_KINDS}")
    b = F.lit(float(beta))
    pc, pr = F.col("policy_chosen"), F.col("policy_rejected")
    df = pairs
    if kind == "ipo" and ipo_double:
        per = F.try_divide
        df = df.withColumn("policy_chosen", per(pc, F.col("n_chosen"))).withColumn(
            "policy_rejected", per(pr, F.col("n_rejected")))
        df = df.withColumn("reference_chosen", per(F.col("reference_chosen"), F.col("n_chosen"))).withColumn(
            "reference_rejected", per(F.col("reference_rejected"), F.col("n_rejected")))
    pc, pr = F.col("policy_chosen"), F.col("policy_rejected")
    if kind in ("sigmoid", "ipo"):
        rc, rr = F.col("reference_chosen"), F.col("reference_rejected")
        logits = (pc - pr) - (rc - rr)
        loss = -log_sigmoid(b * logits) if kind == "sigmoid" else F.pow(logits - F.lit(1.0 / (2.0 * beta)), 2)
        chosen_r, rejected_r = b * (pc - rc), b * (pr - rr)
    elif kind == "simpo":
        loss = -log_sigmoid(b * (pc - pr) - F.lit(float(gamma)))
        chosen_r, rejected_r = b * pc, b * pr
    elif kind == "orpo":
        log_odds = (pc - pr) - (F.log(F.lit(1.0) - F.exp(pc)) - F.log(F.lit(1.0) - F.exp(pr)))
        loss = -b * log_sigmoid(log_odds)
        chosen_r, rejected_r = b * pc, b * pr
    else:
        loss = -log_sigmoid(pc - pr)
        chosen_r, rejected_r = pc, pr
    if rpo_alpha is not None and nll is not None:
        loss = loss + F.lit(float(rpo_alpha)) * F.col(nll)
    return (
        df.withColumn("loss", loss.cast("double"))
        .withColumn("chosen_reward", chosen_r.cast("double"))
        .withColumn("rejected_reward", rejected_r.cast("double"))
    )


def preference_metrics(losses: DataFrame, split: str = "train", nll: str | None = None) -> DataFrame:
    """Batch-level means (op 56); names get an ``eval_`` prefix for evaluation."""
    p = "eval_" if split == "eval" else ""
    aggs = [
        F.avg("chosen_reward").alias(f"{p}rewards_chosen"),
        F.avg("rejected_reward").alias(f"{p}rewards_rejected"),
        F.avg((F.col("chosen_reward") > F.col("rejected_reward")).cast("double")).alias(f"{p}rewards_accuracies"),
        F.avg(F.col("chosen_reward") - F.col("rejected_reward")).alias(f"{p}rewards_margins"),
        F.avg("policy_rejected").alias(f"{p}logps_rejected"),
        F.avg("policy_chosen").alias(f"{p}logps_chosen"),
        F.avg("loss").alias(f"{p}loss"),
    ]
    if nll is not None:
        aggs.append(F.avg(nll).alias(f"{p}nll_loss"))
    return losses.agg(*aggs)


def dro_loss(losses: DataFrame, weight: float = DEFAULT_DRO_WEIGHT, loss: str = "loss") -> DataFrame:
    """-w * ln(mean(exp(-loss / w))) (op 57), overflow-free.

    Shifted log-sum-exp: the maximum of -loss/w is a scalar subquery, so both
    passes are plain distributed aggregates (partial sums per task).  The
    one-column loss table is written to the checkpoint folder first so the
    upstream plan runs once, not once per pass.
    """
    from tessera.operators.order import materialise_scratch

    w = F.lit(float(weight))
    x = -F.col("_l") / w
    losses = materialise_scratch(losses.select(col(loss).alias("_l")), "dro-losses")
    top = losses.select(F.max(x)).scalar()
    return losses.select(
        (-w * (top + F.log(F.avg(F.exp(x - top))))).alias("dro_loss")
    )


def cpo_objective(losses: DataFrame, nll: float | Column, alpha: float = 1.0, dro_weight: float | None = None) -> DataFrame:
    """Objective of the CPO family (op 55): the mean pair loss, or with ``dro_weight`` its robust
    form, plus ``alpha`` times the negative log-likelihood of the chosen side.

    One row: ``preference_loss``, ``nll_loss``, ``objective``.
    """
    if dro_weight is None:
        mean = losses.agg(F.avg("loss").alias("preference_loss"))
    else:
        mean = dro_loss(losses, dro_weight).withColumnRenamed("dro_loss", "preference_loss")
    value = nll if isinstance(nll, Column) else F.lit(float(nll))
    return mean.withColumn("nll_loss", value).withColumn(
        "objective", F.col("preference_loss") + F.lit(float(alpha)) * F.col("nll_loss"))


def token_nll(tok: DataFrame, value: str = "logp", side: str | None = "chosen") -> DataFrame:
    """Mean negative log-prob over supervised, shifted tokens, and its perplexity (op 58)."""
    mask = (F.col("tok_pos") >= 1) & (F.col("label") != F.lit(IGNORE_INDEX))
    if side is not None:
        mask = mask & (F.col("side") == side)
    return tok.where(mask).agg(
        (-F.avg(col(value))).alias("nll"),
        F.count(F.lit(1)).alias("n_tokens"),
    ).withColumn("perplexity", F.exp("nll"))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def reward_scores(df: DataFrame, logit: str = "logit", out: str = "score") -> DataFrame:
    """logit → sigmoid score (op 59)."""
    return df.withColumn(out, sigmoid(logit))


def class_cross_entropy(logits, label, ignore_index: int = IGNORE_INDEX) -> Column:
    """Cross-entropy of an array of logits against an integer class (op 59): log-sum-exp minus the
    class's logit, shifted by the largest logit, so no logit overflows.

    NULL for an ignored or NULL label and where a logit is NULL; a class that is not there fails.
    """
    x, t = col(logits), col(label)
    whole = ~F.exists(x, lambda v: v.isNull())
    top = F.array_max(x)
    rest = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    bad = F.raise_error(F.concat(F.lit("class out of range: "), t.cast("string"))).cast("double")
    inside = (t >= 0) & (t < F.size(x))
    return F.when(t.isNotNull() & (t != F.lit(ignore_index)) & whole & (F.size(x) > 0), F.when(
        inside, top + F.log(rest) - F.element_at(x, F.when(inside, t.cast("int") + 1).otherwise(1))).otherwise(bad))


def multilabel_bce(logits, targets) -> Column:
    """Mean binary cross-entropy of an array of logits against 0/1 targets of the same length (op 59);
    max(x, 0) - x t + ln(1 + exp(-|x|)) per entry, so no logit overflows."""
    x, t = col(logits), col(targets)
    each = F.zip_with(x, t, lambda v, y: F.greatest(v, F.lit(0.0)) - v * y.cast("double")
                      + F.log1p(F.exp(-F.abs(v))))
    bad = F.raise_error(F.lit("logits and targets differ in length")).cast("double")
    total = F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(x) == F.size(t), F.try_divide(total, F.size(x).cast("double"))).when(
        x.isNotNull() & t.isNotNull(), bad)


def classifier_loss(df: DataFrame, problem: str, logits: str = "logits", target: str = "target") -> DataFrame:
    """One row (``loss``, ``n``) over a table of logit arrays, as a sequence classifier's head reports it (op 59).

    ``regression``: mean squared error of one logit against a number;
    ``single_label``: cross-entropy against integer classes; ``multi_label``:
    binary cross-entropy against multi-hot targets.
    """
    if problem == "regression":
        each = F.pow(col(logits)[0] - col(target).cast("double"), 2)
    elif problem == "single_label":
        each = class_cross_entropy(logits, target)
    elif problem == "multi_label":
        each = multilabel_bce(logits, target)
    else:
        raise ValueError(f"unknown problem {problem!r}; known: regression, single_label, multi_label")
    return df.select(each.alias("_l")).agg(F.avg("_l").alias("loss"), F.count("_l").alias("n"))


def score_losses(df: DataFrame, logit: str = "logit", target: str = "target") -> DataFrame:
    """Regression (MSE of the raw logit) and binary cross-entropy against a 0/1 target (op 59)."""
    x, t = col(logit), col(target).cast("double")
    bce = -(t * log_sigmoid(x) + (F.lit(1.0) - t) * log_sigmoid(-x))
    return df.agg(F.avg(F.pow(x - t, 2)).alias("mse"), F.avg(bce).alias("bce"))
