"""Preference / likelihood / reward metrics (ops 52-59) against plain-Python formulas."""

import math

import pytest

from pyspark.sql import functions as F

from tessera.operators.preference import (
    dro_loss,
    pair_sides,
    preference_loss,
    preference_metrics,
    reference_logps,
    score_losses,
    sequence_logps,
    token_nll,
)


def logsig(x):
    return -math.log1p(math.exp(-x)) if x >= 0 else x - math.log1p(math.exp(x))


TOK = [  # seq_id, pair_id, side, tok_pos, label, logp
    (0, 0, "chosen", 0, 5, -9.0), (0, 0, "chosen", 1, -100, -1.0), (0, 0, "chosen", 2, 7, -2.0), (0, 0, "chosen", 3, 8, -3.0),
    (1, 0, "rejected", 0, 5, -9.0), (1, 0, "rejected", 1, 6, -4.0),
    (2, 1, "chosen", 0, 1, -1.0),  # one-token sequence: nothing predicted
    (3, 1, "rejected", 0, -100, -1.0), (3, 1, "rejected", 1, -100, -2.0),  # all masked
]


def test_sequence_logps_shift_and_mask(spark):
    df = spark.createDataFrame(TOK, "seq_id bigint, pair_id bigint, side string, tok_pos bigint, label int, logp double")
    s = {r.seq_id: (r.seq_logp, r.n_completion) for r in sequence_logps(df).collect()}
    assert s == {0: (-5.0, 2), 1: (-4.0, 1), 2: (0.0, 0), 3: (0.0, 0)}
    avg = {r.seq_id: r.seq_logp for r in sequence_logps(df, average=True).collect()}
    assert avg[0] == -2.5 and avg[2] is None  # 0/0 is NULL, not an error
    w = {r.pair_id: r for r in pair_sides(sequence_logps(df)).collect()}
    assert (w[0].policy_chosen, w[0].policy_rejected, w[0].n_chosen) == (-5.0, -4.0, 2)
    nll = token_nll(df).first()
    assert nll.nll == pytest.approx(2.5) and nll.n_tokens == 2


@pytest.mark.parametrize("kind", ["sigmoid", "ipo", "simpo", "orpo", "reward"])
def test_losses_match_formulas(spark, kind):
    pc, pr, rc, rr, nc, nr, b = -0.7, -0.9, -0.8, -0.6, 4, 2, 0.1
    df = spark.createDataFrame([(0, pc, pr, rc, rr, nc, nr)],
                               "pair_id bigint, policy_chosen double, policy_rejected double, reference_chosen double, "
                               "reference_rejected double, n_chosen bigint, n_rejected bigint")
    r = preference_loss(df, kind, b).first()
    if kind == "sigmoid":
        exp = -logsig(b * ((pc - pr) - (rc - rr)))
    elif kind == "ipo":
        lg = (pc / nc - pr / nr) - (rc / nc - rr / nr)
        exp = (lg - 1 / (2 * b)) ** 2
    elif kind == "simpo":
        exp = -logsig(b * (pc - pr) - 0.5)
    elif kind == "orpo":
        exp = -b * logsig((pc - pr) - (math.log1p(-math.exp(pc)) - math.log1p(-math.exp(pr))))
    else:
        exp = -logsig(pc - pr)
    assert r.loss == pytest.approx(exp, rel=1e-12)


def test_metrics_and_dro_overflow(spark):
    rows = [(i, float(l), float(c), float(r), -1.0, -2.0) for i, (l, c, r) in
            enumerate([(1000.0, 0.2, 0.1), (-800.0, 0.1, 0.3), (3.0, 0.0, 0.0)])]
    df = spark.createDataFrame(rows, "pair_id bigint, loss double, chosen_reward double, rejected_reward double, "
                                     "policy_chosen double, policy_rejected double")
    m = preference_metrics(df, "eval").first().asDict()
    assert m["eval_rewards_accuracies"] == pytest.approx(1 / 3) and "eval_loss" in m
    w = 0.01
    xs = [-1000.0 / w, 800.0 / w, -3.0 / w]
    top = max(xs)
    expect = -w * (top + math.log(sum(math.exp(x - top) for x in xs) / 3))
    assert dro_loss(df, w).first().dro_loss == pytest.approx(expect)


def test_reference_switch_and_scores(spark):
    pairs = spark.createDataFrame([(0, -1.0, -2.0)], "pair_id bigint, policy_chosen double, policy_rejected double")
    rec = spark.createDataFrame([(0, -3.0, -4.0)], "pair_id bigint, reference_chosen double, reference_rejected double")
    pre = spark.createDataFrame([(0, -5.0, -6.0)], "pair_id bigint, reference_chosen double, reference_rejected double")
    assert reference_logps(pairs, pre, rec, False).first().reference_chosen == -3.0
    assert reference_logps(pairs, pre, rec, True).first().reference_chosen == -5.0
    s = spark.createDataFrame([(2.0, 1.0), (-1.0, 0.0)], "logit double, target double")
    r = score_losses(s).first()
    assert r.mse == pytest.approx(((2 - 1) ** 2 + 1) / 2)
    assert r.bce == pytest.approx((-logsig(2.0) - logsig(1.0)) / 2)


def test_ipo_single_division(spark):
    pc, pr, rc, rr, nc, nr, b = -0.7, -0.9, -0.8, -0.6, 4, 2, 0.1
    df = spark.createDataFrame([(0, pc, pr, rc, rr, nc, nr)],
                               "pair_id bigint, policy_chosen double, policy_rejected double, reference_chosen double, "
                               "reference_rejected double, n_chosen bigint, n_rejected bigint")
    r = preference_loss(df, "ipo", b, ipo_double=False).first()
    assert r.loss == pytest.approx(((pc - pr) - (rc - rr) - 1 / (2 * b)) ** 2, rel=1e-12)


# --- classifier heads, the CPO family, the reference cache -----------------------------------

def test_logit_losses_equal_the_textbook_and_do_not_overflow(spark):
    import numpy as np
    import pytest

    from tessera.operators.preference import class_cross_entropy, classifier_loss, multilabel_bce

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist(), int(rng.integers(4)), rng.integers(0, 2, 4).tolist()) for i in range(30)]
    rows += [(90, [1000.0, -1000.0, 999.0, 0.0], 1, [0, 1, 1, 0]), (91, [-800.0] * 4, 0, [1, 1, 1, 1])]
    skipped = [(92, [1.0, 2.0, 3.0, 4.0], -100, [0, 0, 0, 0]), (93, [1.0, None, 3.0, 4.0], 0, [0, 0, 0, 0]),
               (94, None, 0, None), (95, [1.0, 2.0, 3.0, 4.0], None, None)]
    df = spark.createDataFrame(rows + skipped, "id int, logits array<double>, target int, hot array<int>")
    got = {r.id: r for r in df.select("id", class_cross_entropy("logits", "target").alias("ce"),
                                      multilabel_bce("logits", "hot").alias("bce")).collect()}
    for i, x, t, hot in rows:
        x = np.array(x)
        ce = np.log(np.exp(x - x.max()).sum()) + x.max() - x[t]
        bce = np.mean([np.logaddexp(0, v) - v * y for v, y in zip(x, hot)])
        assert abs(got[i].ce - ce) <= 1e-9 * max(1, ce) and abs(got[i].bce - bce) <= 1e-9 * max(1, bce)
    assert [got[i].ce for i in (92, 93, 94, 95)] == [None] * 4 and got[94].bce is None and got[93].bce is None
    one = classifier_loss(df, "single_label").first()
    assert one.n == len(rows) and abs(one.loss - np.mean([got[i].ce for i, *_ in rows])) < 1e-9
    with pytest.raises(Exception, match="class out of range"):
        df.select(class_cross_entropy("logits", F.lit(4))).collect()
    with pytest.raises(Exception, match="differ in length"):
        df.select(multilabel_bce("logits", F.array(F.lit(1)))).collect()
    with pytest.raises(ValueError):
        classifier_loss(df, "ranking")


def test_cpo_objective_adds_the_likelihood(spark):
    import math

    from tessera.operators.preference import cpo_objective

    losses = spark.createDataFrame([(0.5,), (1.5,), (4.0,)], "loss double")
    plain = cpo_objective(losses, 2.0, 0.25).first()
    assert (plain.preference_loss, plain.nll_loss, plain.objective) == (2.0, 2.0, 2.5)
    robust = cpo_objective(losses, 2.0, 0.25, dro_weight=2.0).first()
    spec = -2 * math.log(sum(math.exp(-x / 2) for x in (0.5, 1.5, 4.0)) / 3)
    assert abs(robust.preference_loss - spec) < 1e-12 and abs(robust.objective - spec - 0.5) < 1e-12


def test_reference_cache_recomputes_only_what_is_missing(spark):
    import os
    import tempfile

    from tessera.operators.preference import ReferenceCache

    root = tempfile.mkdtemp(prefix="tessera-ref-", dir="/tmp")
    cache = ReferenceCache(spark, root)
    assert cache.read() is None
    kind = "pair_id bigint, reference_chosen double, reference_rejected double"
    pairs = spark.range(6).withColumnRenamed("id", "pair_id")
    cache.add(spark.createDataFrame([(0, -1.0, -2.0), (1, -1.0, None), (9, -5.0, -5.0)], kind))
    asked = []

    def recompute(missing):
        asked.append(sorted(r.pair_id for r in missing.collect()))
        return missing.select("pair_id", F.lit(-3.0).alias("reference_chosen"), F.lit(-4.0).alias("reference_rejected"))

    rows = lambda df: {r.pair_id: (r.reference_chosen, r.reference_rejected, r.version) for r in df.collect()}
    expect = {0: (-1.0, -2.0, 0)} | {i: (-3.0, -4.0, 1) for i in range(1, 6)}
    assert rows(cache.fill(pairs, recompute)) == expect and rows(cache.fill(pairs, recompute)) == expect
    assert asked == [[1, 2, 3, 4, 5]]                       # the second time nothing was missing
    os.makedirs(os.path.join(root, "version=2"))            # a version that was not written to its end
    assert rows(cache.fill(pairs, recompute)) == expect
    cache.add(spark.createDataFrame([(0, -7.0, -8.0)], kind))
    assert rows(cache.fill(pairs, recompute))[0] == (-7.0, -8.0, 2)
