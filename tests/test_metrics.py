"""Hand-computed values of the metrics."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import agreement as A
from plumbline.operators import inference as I
from plumbline.operators import metrics as M

SCORED = "config_id string, pipeline_class string, case_id string, seed_id string, dimension string, category string, answer_correct boolean, is_answerable boolean, noise_ratio double, crs_score int, final_answer string, truncated boolean"


def row(**k):
    base = dict(config_id="naive|bm25|standard_1", pipeline_class="naive", case_id="c", seed_id="nq-0", dimension="refusal", category="answer", answer_correct=None, is_answerable=True, noise_ratio=None, crs_score=None, final_answer="x", truncated=False)
    return tuple((base | k).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCORED)


def refusal_rows():
    out = [row(case_id=f"u{i}", is_answerable=False, category=c) for i, c in enumerate(["refusal", "refusal", "refusal", "answer"])]
    return out + [row(case_id=f"a{i}", category=c, answer_correct=ok) for i, (c, ok) in enumerate([("refusal", None), ("answer", True), ("answer", False), ("unparseable", None)])]


def test_refusal_confusion(spark):
    x = M.refusal_f1(frame(spark, refusal_rows()), ["pipeline_class"]).first()
    assert (x.tp, x.fp, x.fn, x.tn, x.n) == (3, 1, 1, 3, 8) and x.f1 == pytest.approx(0.75) and x.plain_accuracy == 1 / 8 and x.degenerate is None
    x = M.refusal_f1(frame(spark, refusal_rows()[:4])).first()
    assert x.degenerate == "no answerable cases" and x.precision == 1.0
    x = M.refusal_f1(frame(spark, [])).first()
    assert x is None or x.n in (None, 0)


@pytest.mark.parametrize(
    ("accuracy", "auc", "ndc50", "slope", "cliff", "censored", "text"),
    [
        ((0.9, 0.8, 0.6, 0.4, 0.2), 0.6194, 0.625, 0.175, 0.2, "none", "0.625"),
        ((0.9, 0.9, 0.8, 0.8, 0.8), 0.8417, None, 0.1, 0.1, "right", "> 0.90"),
        ((0.4, 0.3, 0.2, 0.1, 0.0), 0.2167, None, 0.1, 0.1, "left", "< 0.00"),
        ((0.6, 0.7, 0.7, 0.7, 0.7), 0.6861, None, 0.0, 0.0, "right", "> 0.90"),
    ],
)
def test_curves(spark, accuracy, auc, ndc50, slope, cliff, censored, text):
    df = spark.createDataFrame(list(zip(M.NOISE_GRID, accuracy)), "noise_ratio double, accuracy double")
    x = M.degradation_curve(df).first()
    assert x.auc == pytest.approx(auc, abs=1e-4) and x.slope == pytest.approx(slope) and x.cliff == pytest.approx(cliff) and x.censored == censored and x.ndc50_text == text
    assert x.ndc50 == (pytest.approx(ndc50) if ndc50 else None) and x.fixed_point == accuracy[3]


def test_curve_needs_every_ratio(spark):
    x = M.degradation_curve(spark.createDataFrame([(0.0, 0.5), (0.9, 0.1)], "noise_ratio double, accuracy double")).first()
    assert x.auc is None and x.ndc50 is None and x.censored is None and x.ndc50_text is None


def test_noise_accuracy_counts_null_as_miss(spark):
    rows = [row(dimension="noise", noise_ratio=0.0, answer_correct=v) for v in (True, None, False, True)] + [row(dimension="noise", answer_correct=True)]
    assert M.noise_accuracy(frame(spark, rows)).first().accuracy == 0.5


def test_rubric(spark):
    rows = [row(dimension="conflict", crs_score=s) for s in (0, 4, 4, 2, None)] + [row(dimension="conflict", crs_score=1, truncated=True, final_answer=None)]
    x = M.conflict_resolution(frame(spark, rows)).first()
    assert (x.mean, x.n, x.n0, x.n1, x.n4) == (2.2, 5, 1, 1, 2)
    assert M.conflict_resolution(frame(spark, rows), exclude_non_terminating=True).first().mean == 2.5
    with pytest.raises(Exception, match="rubric"):
        M.conflict_resolution(frame(spark, [row(dimension="conflict", crs_score=5)])).collect()


def ratings(spark, cells):
    return spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a int, b int")


def test_agreement_values(spark):
    x = A.diagnostics(ratings(spark, [(1, 1, 8), (1, 0, 1), (0, 0, 1)]), "a", "b").first()
    assert x.kappa == pytest.approx(0.6154, abs=1e-4) and x.ac1 == pytest.approx(0.8658, abs=1e-4)
    x = A.diagnostics(ratings(spark, [(1, 1, 89), (1, 0, 2), (0, 1, 9)]), "a", "b").first()
    assert x.kappa == pytest.approx(-0.0338, abs=1e-4) and x.ac1 == pytest.approx(0.8772, abs=1e-4) and x.pabak == pytest.approx(0.78) and x.paradox
    x = A.diagnostics(ratings(spark, [(1, 1, 5)]), "a", "b").first()
    assert x.kappa == 1 and x.ac1 == 1 and x.pabak is None
    assert A.weighted_kappa(ratings(spark, [(0, 0, 3), (4, 4, 3)]), "a", "b").first().weighted_kappa == 1
    assert A.weighted_kappa(ratings(spark, [(2, 2, 3)]), "a", "b").first().weighted_kappa == 1


def test_constant_statistic_has_no_width(spark):
    rows = [row(case_id=f"c{i}", dimension="conflict", crs_score=3) for i in range(20)]
    x = I.intervals(frame(spark, rows), "crs", ["pipeline_class"], resamples=50).first()
    assert (x.observed, x.lower, x.upper, x.n_failed) == (3, 3, 3, 0)


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    df = frame(spark, [r[:2] + (f"{r[2]}{k}",) + r[3:] for k in range(5) for r in refusal_rows()])
    one = I.intervals(df.coalesce(1), "refusal_f1", ["pipeline_class"], resamples=60).collect()
    two = I.intervals(df.repartition(7), "refusal_f1", ["pipeline_class"], resamples=60).collect()
    assert one == two and one[0].lower <= one[0].observed <= one[0].upper


def test_paired_difference_uses_shared_units(spark):
    rows = [row(case_id=f"c{i}", dimension="conflict", crs_score=4, pipeline_class="agentic") for i in range(10)] + [row(case_id=f"c{i}", dimension="conflict", crs_score=1) for i in range(5, 15)]
    x = I.paired_differences(frame(spark, rows), "crs", resamples=40).first()
    assert (x.arm_a, x.arm_b, x.observed, x.n_units) == ("agentic", "naive", 3, 5) and x.significant and x.practical


def test_unpaired_groups_must_be_disjoint(spark):
    rows = [row(case_id="c0", dimension="conflict", crs_score=k, seed_id=s) for k, s in ((1, "nq-1"), (2, "tqa-1"))]
    df = frame(spark, rows).withColumn("source", M.seed_source())
    with pytest.raises(Exception, match="both groups"):
        I.unpaired_differences(df, "crs", group="pipeline_class", side="source", sides=("nq", "tqa"), resamples=10).collect()


def test_divergence_counts_null(spark):
    rows = [row(case_id="n", dimension="noise", noise_ratio=0.0, answer_correct=v, pipeline_class=p) for p, v in (("naive", None), ("agentic", False))]
    assert M.divergent_cases(frame(spark, rows)).count() == 1
    assert M.divergent_cases(frame(spark, rows).withColumn("answer_correct", F.lit(None).cast("boolean"))).count() == 0


def test_splitting_draws_like_plain_draws():
    """Counts of kinds by splitting have the mean, variance and covariance of drawing units one by one, and cost no more for more units."""
    m = np.array([5000, 1, 2999, 12, 1988])
    many = np.array([I.weights(10_000, m, "s", b) for b in range(4000)])
    p = m / m.sum()
    assert (many.sum(axis=1) == 10_000).all() and (I.weights(10_000, m, "s", 7) == many[7]).all()
    assert np.abs(many.mean(axis=0) - 10_000 * p).max() < 4 * np.sqrt(10_000 * 0.25 / 4000)
    assert np.allclose(np.cov(many.T), 10_000 * (np.diag(p) - np.outer(p, p)), atol=150, rtol=0.08)
    few = np.array([I.weights(40, np.array([20, 15, 5]), "t", b) for b in range(4000)])
    one_by_one = np.array([np.bincount(np.searchsorted([20, 35, 40], np.random.default_rng(b).integers(0, 40, 40), "right"), minlength=3) for b in range(4000)])
    assert np.abs(few.mean(axis=0) - one_by_one.mean(axis=0)).max() < 0.25 and np.abs(few.var(axis=0) - one_by_one.var(axis=0)).max() < 0.8
    began = time.time()
    assert I.weights(10**15, np.array([10**15 - 10**6, 10**6]), "u", 1)[1] > 990_000 and time.time() - began < 0.1


def test_resampling_in_blocks(spark, monkeypatch):
    """Kinds dealt over blocks: the interval is that of one block, as far as chance goes, and a unit's draws are the same for both arms."""
    rows = [row(case_id=f"c{i}", pipeline_class=c, dimension="conflict", crs_score=(i * (7 if c == "naive" else 3)) % 5) for i in range(300) for c in ("naive", "agentic")]
    rows += [row(case_id=f"c{i}", pipeline_class="reasoning", dimension="conflict", crs_score=3) for i in range(400, 404)]
    df = frame(spark, rows)
    whole = {x.pipeline_class: x for x in I.intervals(df, "crs", ["pipeline_class"]).collect()}
    pair = I.paired_differences(df.filter("pipeline_class <> 'reasoning'"), "crs").first()
    monkeypatch.setattr(I, "KINDS", 2)
    monkeypatch.setattr(I, "LEAF", 50)
    blocks = {x.pipeline_class: x for x in I.intervals(df, "crs", ["pipeline_class"]).collect()}
    again = I.paired_differences(df.filter("pipeline_class <> 'reasoning'"), "crs").first()
    assert set(whole) == set(blocks) == {"naive", "agentic", "reasoning"} and blocks["reasoning"].lower == blocks["reasoning"].upper == 3
    for c in ("naive", "agentic"):
        assert whole[c].observed == blocks[c].observed and abs(whole[c].lower - blocks[c].lower) < 0.06 and abs(whole[c].upper - blocks[c].upper) < 0.06
    assert pair.observed == again.observed and abs(pair.lower - again.lower) < 0.08 and abs(pair.upper - again.upper) < 0.08 and pair.n_units == again.n_units == 300


def test_resamples_of_many_units_are_plain_draws(spark, monkeypatch):
    """However many units there are, draw by draw, in blocks of kinds as well."""
    import hashlib

    n, group = 5001, "naive"
    rows = [row(case_id=f"c{i}", pipeline_class=group, dimension="conflict", crs_score=i * i % 5) for i in range(n)]
    order = sorted(i * i % 5 for i in range(n))
    values = []
    for b in range(4):
        digests = [hashlib.md5(f"7|{group}|{b}|{q}".encode()).hexdigest() for q in range(n // 4 + 1)]
        values.append(sum(order[int(digests[j // 4][8 * (j % 4) : 8 * (j % 4) + 8], 16) % n] for j in range(n)) / n)
    values.sort()
    at = lambda q: values[int(q * 3)] + (q * 3 - int(q * 3)) * (values[min(3, int(q * 3) + 1)] - values[int(q * 3)])
    df = frame(spark, rows)
    for kinds in (I.KINDS, 2):
        monkeypatch.setattr(I, "KINDS", kinds)
        got = I.intervals(df, "crs", ["pipeline_class"], resamples=4, seed=7).first()
        assert got.lower == pytest.approx(at(0.025), abs=1e-12) and got.upper == pytest.approx(at(0.975), abs=1e-12)


def test_draws_are_counted_in_pieces(monkeypatch):
    whole = np.bincount(np.searchsorted([20, 35, 40], I.drawn(40, 40, "s", 1), "right"), minlength=3)
    monkeypatch.setattr(I, "PIECE", 12)
    assert (I.times_drawn(np.array([0, 20, 35]), 40, 40, "s", 1) == whole).all()
    assert (I.times_drawn(np.array([20, 35]), 40, 40, "s", 1) == whole[1:]).all()
