"""Chains whose inputs and results a study has published, from its values; four digits are stored there."""

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import stats
from quorumlake.operators import agreement, frame, row_bootstrap, series

RELATIONS = [("mixed_or_conditional", "mixed_or_conditional", 5), ("mixed_or_conditional", "opposes", 5), ("mixed_or_conditional", "supports", 2), ("mixed_or_conditional", "unclear", 1), ("opposes", "mixed_or_conditional", 6), ("opposes", "neutral_or_no_position", 7), ("opposes", "opposes", 46), ("opposes", "supports", 2), ("supports", "mixed_or_conditional", 7), ("supports", "neutral_or_no_position", 11), ("supports", "opposes", 1), ("supports", "supports", 51), ("supports", "unclear", 1), ("unclear", "mixed_or_conditional", 1), ("unclear", "supports", 1), ("unclear", "unclear", 3)]
MODES = [("analytical_exposition", "analytical_exposition", 25), ("analytical_exposition", "explicit_stance", 6), ("analytical_exposition", "refusal", 5), ("analytical_exposition", "voiced_continuation", 2), ("empty", "refusal", 1), ("explicit_stance", "analytical_exposition", 4), ("explicit_stance", "explicit_stance", 86), ("explicit_stance", "incomplete", 1), ("explicit_stance", "refusal", 1), ("explicit_stance", "voiced_continuation", 3), ("incomplete", "analytical_exposition", 1), ("incomplete", "explicit_stance", 3), ("incomplete", "refusal", 1), ("incomplete", "voiced_continuation", 1), ("other", "explicit_stance", 1), ("other", "incomplete", 2), ("voiced_continuation", "explicit_stance", 1), ("voiced_continuation", "incomplete", 1), ("voiced_continuation", "refusal", 1), ("voiced_continuation", "voiced_continuation", 4)]
near = lambda x: pytest.approx(x, abs=5.1e-5)


def test_two_annotators(spark):
    rows = [("relation", a, c) for a, c, n in RELATIONS for _ in range(n)] + [("mode", a, c) for a, c, n in MODES for _ in range(n)]
    both = ("supports", "opposes")
    rows += [("direction", a, c) for a, c, n in RELATIONS for _ in range(n) if a in both and c in both]
    found = agreement.agreement(spark.createDataFrame(rows, "dimension string, a string, c string"), "a", "c", ["dimension"])
    got = {r.dimension: (r.n, r.accuracy, r.kappa) for r in found.collect()}
    assert got == {"relation": (150, near(0.7), near(0.5524)), "mode": (150, near(0.7667), near(0.5644)), "direction": (100, near(0.97), near(0.9399))}


def test_outcome_rates_by_completeness(spark):
    counts = [(100, "length", "neutral_or_no_position", 43), (100, "stop", "neutral_or_no_position", 2), (250, "length", "mixed_or_conditional", 4), (250, "length", "neutral_or_no_position", 37), (250, "stop", "neutral_or_no_position", 4)]
    rows = spark.createDataFrame([(b, f == "length", f == "stop", o) for b, f, o, n in counts for _ in range(n)], "budget int, truncated boolean, response_complete boolean, outcome string")
    got = {(r.scope, r.budget, r.outcome): (r.n, r.total, r.rate) for r in frame.by_completeness(rows, ["budget"]).collect()}
    mixed, neutral = "mixed_or_conditional", "neutral_or_no_position"
    assert {k: v[:2] for k, v in got.items()} == {("all", 100, neutral): (45, 45), ("completed_only", 100, neutral): (2, 2), ("truncated_only", 100, neutral): (43, 43), ("all", 250, mixed): (4, 45), ("all", 250, neutral): (41, 45), ("completed_only", 250, neutral): (4, 4), ("truncated_only", 250, mixed): (4, 41), ("truncated_only", 250, neutral): (37, 41)}
    assert got["truncated_only", 250, mixed][2] == pytest.approx(0.0975609756097561, abs=1e-15)


def test_wilson_intervals(spark):
    published = [(70, 117, 0.5077, 0.6826), (2, 26, 0.0214, 0.2414), (1, 47, 0.0038, 0.1111), (7, 117, 0.0293, 0.1184), (24, 26, 0.7586, 0.9786), (7, 110, 0.0312, 0.1256), (16, 117, 0.086, 0.2106), (18, 26, 0.5001, 0.835), (7, 101, 0.034, 0.1362), (14, 117, 0.0726, 0.1909), (17, 26, 0.4622, 0.8059), (8, 103, 0.0399, 0.1458), (14, 26, 0.3546, 0.7124), (6, 103, 0.027, 0.1213), (20, 26, 0.5795, 0.8897), (5, 101, 0.0213, 0.1107), (1, 117, 0.0015, 0.0468), (26, 26, 0.8713, 1.0), (11, 116, 0.0538, 0.1619)]
    low, high = stats.wilson(F.col("k"), F.col("n"))
    for r in spark.createDataFrame(published, "k long, n long, l double, h double").select("*", low.alias("low"), high.alias("high")).collect():
        assert (r.low, r.high) == (near(r.l), near(r.h))


def test_contrasts_of_two_rates(spark):
    published = [(13, 76, 3, 32, 0.0773, -0.0861, 0.1946, 0.3843), (5, 35, 2, 2, -0.8571, -0.9374, -0.1824, 0.0315), (35, 111, 2, 34, 0.2565, 0.1025, 0.3573, 0.0017), (43, 111, 3, 34, 0.2992, 0.134, 0.4086, 0.0007), (23, 80, 2, 30, 0.2208, 0.0501, 0.3383, 0.0196), (11, 31, 3, 4, -0.3952, -0.645, 0.0873, 0.2794), (31, 111, 4, 34, 0.1616, -0.0048, 0.276, 0.0671), (22, 88, 3, 32, 0.1562, -0.0118, 0.2733, 0.0768), (2, 23, 2, 2, -0.913, -0.9758, -0.231, 0.02), (23, 111, 2, 34, 0.1484, 0.0012, 0.243, 0.0665)]
    k = [F.col(c) for c in ("k1", "n1", "k2", "n2")]
    low, high = stats.newcombe(*k)
    for r in spark.createDataFrame(published, "k1 long, n1 long, k2 long, n2 long, d double, l double, h double, p double").select("*", low.alias("low"), high.alias("high"), stats.fisher(*k).alias("fisher")).collect():
        assert (r.k1 / r.n1 - r.k2 / r.n2, r.low, r.high, r.fisher) == (near(r.d), near(r.l), near(r.h), near(r.p))


def test_exact_tests_of_pairs(spark):
    published = [(2, 0, 0.5), (10, 33, 0.0006), (10, 45, 0.0), (3, 1, 0.625), (3, 0, 0.25), (11, 1, 0.0063)]
    for r in spark.createDataFrame(published, "fixed long, broken long, p double").select("*", stats.mcnemar(F.col("fixed"), F.col("broken")).alias("got")).collect():
        assert r.got == near(r.p)


def test_checkpoint_half_way(spark):
    curve = [0.24825731925911174, 0.2735510854411472, 0.3040231029675364, 0.3374825731925911, 0.3746265684126668, 0.4047998406691894, 0.4325831507667795, 0.4477195777733519, 0.4706233817964549, 0.48376817367058356, 0.4970125473013344, 0.5024895439155547, 0.7404899422425811]
    assert series.first_sustained(spark.createDataFrame(list(enumerate(curve)), "i int, x double"), "i", "x").first().i == 10


# row bootstraps


def replicates_of(spark, rows, **how):
    df = spark.createDataFrame(rows, "g string, x double, y double")
    return row_bootstrap.row_replicates(df, {"x": F.col("x"), "y": F.col("y")}, 400, ["g"], **how)


def test_replicates_draw_exactly_n_rows_and_have_the_right_spread(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = {g: rng.normal(3, 2, n).round(digits) for g, n, digits in (("few", 60, 0), ("many", 3000, 6), (None, 40, 1))}
    rows = [(g, float(x), 1.0 if x > 3 else None) for g, xs in data.items() for x in xs]
    for cells in (1 << 14, 64):  # one block a group, and many
        got = replicates_of(spark, rows, block_cells=cells).toPandas()
        assert len(got) == 1200
        for g, xs in data.items():
            own = got[got.g.isna()] if g is None else got[got.g == g]
            assert set(own.n) == {len(xs)} and sorted(own.rep) == list(range(400))
            means = own.x / own.n
            se = xs.std() / np.sqrt(len(xs))
            assert abs(means.mean() - xs.mean()) < 5 * se / 20 and 0.85 < means.std() / se < 1.15
            assert abs((own.y / own.n).mean() - (xs > 3).mean()) < 0.02


def test_draws_do_not_depend_on_partitions_and_blocks_share_the_rest(spark):
    import numpy as np

    rows = [("a", float(i % 37), float(i % 3)) for i in range(700)]
    key = lambda d: sorted((r.g, r.rep, r.n, round(r.x, 6), round(r.y, 6)) for r in d.collect())
    assert key(replicates_of(spark, rows, block_cells=16)) == key(replicates_of(spark, rows[::-1], block_cells=16)) != key(replicates_of(spark, rows, seed=5, block_cells=16))
    sizes = np.array([5, 0, 17, 1, 90, 2, 2, 8])
    parts = np.stack([row_bootstrap.block_draws(sizes, b, 2000, (3, 4)) for b in range(8)])
    assert (parts.sum(axis=0) == sizes.sum()).all() and (parts[1] == 0).all()
    assert np.allclose(parts.mean(axis=1), sizes, atol=0.6) and np.allclose(parts.var(axis=1), sizes * (1 - sizes / 125), rtol=0.2)
    assert row_bootstrap.row_replicates(spark.createDataFrame([], "g string, x double"), {"x": F.col("x")}, 10, ["g"]).count() == 0
