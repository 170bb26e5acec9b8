"""Operators 11 to 13 and the bitmaps of operator 8: brute force, edge cases, held-out accuracy."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlake.llm import bands, codebooks, jaccard, quality
from quorumlake.llm.blocks import U64

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_as_sql(spark, query, sql, tables, sf):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    plain = lambda d: sorted((tuple(None if pd.isna(v) else v for v in r) for r in d[sorted(d.columns)].astype(object).values.tolist()), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and len(got) and plain(got) == plain(want)


# 12

LINE = "sale_id long, line_no int, item_id long, quantity int, amount double, p long, bucket long, note string"
ITEM = "item_id long, price double, u long, n string"


def brute_bands(lines, items, top=10):
    def cents(x):
        return None if x is None or not abs(x) <= bands.MOST else math.floor(100 * x + 0.5)

    priced = []
    for s, no, i, q, a in lines:
        c = cents(a)
        if None not in (s, i, q, c) and q:
            priced.append(((2 * c + q) // (2 * q), s, no, i))
    out = []
    for item, price in items:
        p, pairs, crc = cents(price), [], 0
        for u, s, no, i in priced if p is not None else []:
            gap = abs(u - p)
            if i != item and (gap <= 50 or 1000 * gap <= 5 * min(u, p)):
                pairs.append((gap, u, s, (no is not None, no or 0), i, no))
                crc += zlib.crc32(f"{s},{'' if no is None else no},{i}".encode())
        pairs.sort(key=lambda x: x[:5])
        tail = (len(pairs), sum(x[0] for x in pairs), crc)
        out += [(item, k + 1, x[0], x[1], x[2], x[5], x[4], *tail) for k, x in enumerate(pairs[:top])] or [(item, 0, None, None, None, None, None, 0, 0, 0)]
    return sorted(out, key=repr)


def near(spark, lines, items, **how):
    found = bands.near_prices(spark.createDataFrame([(*x, 1, 2, "c") for x in lines], LINE).repartition(3), spark.createDataFrame([(*x, 7, "d") for x in items], ITEM), **how)
    return rows_of(found)


def test_near_prices_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(i, rng.choice([round(rng.uniform(-1, 9), 2), round(rng.uniform(50, 4000), 2), 5.0, None])) for i in range(60)]
    lines = []
    for k in range(900):
        item, price = rng.choice(items)
        q = rng.choice([1, 2, 3, 7, 40, -2])
        lines.append((rng.randrange(200), rng.choice([1, 2, 3, None]), item, q, round((price if price is not None else 5) * q * rng.uniform(0.98, 1.02), 2)))
    lines += [(5, 1, 3, 1, 5.0)] * 300 + [(6, k, 4, 1, 5.0) for k in range(40)] + lines[:20]
    assert near(spark, lines, items) == brute_bands(lines, items)
    assert near(spark, lines, items, top=3) == brute_bands(lines, items, 3)


def test_near_prices_at_the_edges(spark):
    lines = [(1, 1, 1, 1, 100.0), (None, 1, 1, 1, 100.0), (1, None, 2, 1, 100.5), (2, 1, None, 1, 100.0), (3, 1, 1, None, 100.0), (4, 1, 1, 1, None), (5, 1, 1, 0, 100.0), (6, 1, 1, 1, float("nan")), (7, 1, 1, 1, 1e300), (8, 1, 9, 3, 100.01), (9, 1, 9, -3, -300.0), (10, 1, 9, 1, 1_000_000.0)]
    items = [(1, 100.0), (1, 100.0), (1, 100.5), (None, 100.0), (2, None), (3, float("inf")), (4, -5.0), (5, 1_004_999.99), (6, 1_005_000.01), (7, 0.0)]
    assert near(spark, lines, items) == brute_bands(lines, items)
    assert near(spark, [], items) == brute_bands([], items)
    assert near(spark, lines, []) == []


def test_an_item_with_most_lines_about_its_own_price_finds_the_others(spark):
    lines = [(k, 1, 1, 1, 50 + (k % 60) / 100) for k in range(3000)] + [(9000 + k, 1, 2, 1, 50.9) for k in range(12)] + [(9100, 1, 3, 1, 50.0)]
    items = [(1, 50.3), (2, 50.3), (3, 50.6)]
    got = near(spark, lines, items)
    assert got == brute_bands(lines, items)


def test_thinned_lists_hold_the_first_of_all_others():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 80))
        u, item = np.sort(rng.integers(0, 4, n)), rng.integers(0, int(rng.integers(1, 6)), n)
        kept = bands.thinned(u, item, 3)
        for x in range(6):
            for v in range(4):
                want = [i for i in range(n) if u[i] == v and item[i] != x][:3]
                assert [i for i in kept.tolist() if u[i] == v and item[i] != x][:3] == want


def test_buckets_increase_and_bands_span_few(spark):
    v = [*range(-9000, 9000, 7), *range(9000, 10_000_000, 99_991), 10**15]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v long").select(bands.bucket(F.col("v"))).collect()]
    assert got == sorted(got)
    spans = spark.createDataFrame([(x,) for x in v], "v long").select((bands.bucket(bands.highest(F.col("v"))) - bands.bucket(bands.lowest(F.col("v")))).alias("d"))
    assert spans.agg(F.max("d")).first()[0] <= 5


def test_op12_equals_sql(spark):
    same_as_sql(spark, bands.op12_near_prices, bands.OP12_SQL, ["items", "sale_lines"], SF)


# 13


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(np.float32(x).astype(float) * 4096) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    at = [k * d // parts for k in range(parts + 1)]
    books = [[v[at[k] : at[k + 1]] for _, v, _ in kept[:entries]] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for k, book in enumerate(books):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(v[at[k] : at[k + 1]], book)[1], []).append(v[at[k] : at[k + 1]])
            books[k] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else x for e, x in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        found = [nearest(v[at[k] : at[k + 1]], book) for k, book in enumerate(books)]
        coded.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found)))
    return sorted(((i, label, code, error, sum(e for _, other, _, e in coded if other == label), digest) for i, label, code, error in coded), key=repr)


def coded(spark, rows):
    return rows_of(codebooks.compress(spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, v int, code string").repartition(3)))


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16)], int(i) % 3 if i % 5 else None) for i in range(120)]
    rows += [(3, rows[9][1], 1), (3, rows[3][1], 0), (None, rows[5][1], 2), *[(200 + k, rows[1][1], 7) for k in range(90)]]
    rows += [(300, None, 1), (-1, [0.1] * 15 + [None], 1), (-2, [float("nan")] * 16, 1), (-3, [float("inf")] * 16, 1), (301, [0.5] * 8, 1), (302, [], 1)]
    assert coded(spark, rows) == brute_codes(rows)
    few = rows[:5]
    assert coded(spark, few) == brute_codes(few)
    assert coded(spark, [(1, None, 1)]) == [] and coded(spark, []) == []
    uneven = [(i, [float(x) for x in rng.normal(0, 1, 13)], 0) for i in range(40)]
    assert coded(spark, uneven) == brute_codes(uneven)
    with pytest.raises(ValueError, match="coded exactly"):
        coded(spark, [(1, [9000.0] * 8, 1)])


def test_partial_distances_give_the_nearest_entry():
    rng = np.random.default_rng(3)
    for d in (0, 1, 5):
        x, book = rng.integers(-9, 9, (500, d)), rng.integers(-9, 9, (16, d))
        index, best = codebooks.nearest(x, book)
        full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def test_op13_equals_sql(spark):
    same_as_sql(spark, codebooks.op13_partial_distance_codes, codebooks.OP13_SQL, ["embeddings"], SF)


# 11


def test_held_out_quality(spark):
    got = quality.op11_fourier_quality(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    test = both[both.held_out]
    assert len(test) > 60 and (test.predicted == test.quality).mean() > 0.95 > 1.05 * test.quality.mean()


DOCS = "doc_id long, text string, lang string, source string, x int, fold string"


def quality_of(spark, docs, labels, parts=2):
    d = spark.createDataFrame([(i, t, "en", "s", 1, "f") for i, t in docs], DOCS).repartition(parts)
    return rows_of(quality.quality(d, spark.createDataFrame(labels, "doc_id long, quality int, score double")))


def test_quality_learns_from_no_held_out_label_and_whatever_the_partitions(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "rain"]
    docs = [(i, " ".join(rng.choices(words, k=60)) if i % 3 else "BUY!!! " * rng.randrange(20, 60)) for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0.0) for i in range(300)]
    first = quality_of(spark, docs, labels)
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    flipped = [(i, 1 - y if i in held else y, s) for i, y, s in labels]
    assert first == quality_of(spark, docs, flipped, 5) == quality_of(spark, docs[::-1], [x for x in labels if x[0] not in held], 3)
    assert all(r[3] == int(r[0] % 3 > 0) for r in first) and {r[0] for r in first if r[1]} == held
    unknown = quality_of(spark, docs, labels + [(1, None, 0.0), (None, 1, 0.0), (7, 5, 0.0)])
    assert unknown == first


def test_quality_at_the_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "é 中文 😀"), (5, "x" * 300_000), (5, "x" * 300_000), (None, "a b c"), (6, "a\nb\n\nb\n" * 20_000)]
    got = quality_of(spark, docs, [])
    assert len(got) == 8 and {r[2] for r in got} == {0.5} and {r[3] for r in got} == {0} and [r[1] for r in got if r[0] is None] == [False]
    one_class = quality_of(spark, docs, [(i, 1, 0.0) for i in range(1, 7)])
    assert len(one_class) == 8 and all(0 <= r[2] <= 1 for r in one_class)
    assert len({r[2] for r in one_class if r[0] in (1, 2)}) == 1 and quality_of(spark, [], [(1, 1, 0.0)]) == []


def test_statistics_count_whole_texts():
    from quorumlake.llm.blocks import Prefix, space_table

    text = "Aa bb!! bb 12.\nAa bb!! cc,dd"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    x = dict(zip(quality.STATISTICS, quality.statistics(data, np.array([0, len(data)]), Prefix(), space_table(), quality._classes())[0], strict=True))
    n = len(text)
    assert x["letters"] == pytest.approx(14 / n) and x["capitals"] == pytest.approx(2 / 14) and x["digits"] == pytest.approx(2 / n)
    assert x["other_marks"] == pytest.approx(4 / n) and x["sentence_marks"] == pytest.approx(2 / n) and x["marks_in_a_row"] == pytest.approx(2 / n)
    assert x["distinct_words"] == pytest.approx(5 / 7) and x["top_word"] == pytest.approx(2 / 7) and x["repeated_words"] == 0 and x["repeated_lines"] == 0
    assert x["words_with_marks"] == pytest.approx(3 / 7) and x["lines"] == pytest.approx(math.log1p(2) / 16)


def test_isotonic_scores_never_fall():
    rng = np.random.default_rng(0)
    total = rng.integers(1, 9, 60)
    ones = rng.binomial(total, np.linspace(0, 1, 60))
    place, value = quality.isotonic(np.arange(60.0), ones, total)
    assert (np.diff(place) > 0).all() and (np.diff(value) > 0).all() and value.min() >= 0 and value.max() <= 1
    weights = {round(p, 9): v for p, v in zip(place, value, strict=True)}
    assert sum(weights.values()) and np.isclose(np.interp(np.arange(60.0), place, value).mean(), (ones / total).mean(), atol=0.1)


# 8


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (80, 100)):
        sets = []
        for size in (1, 3, 30, 130, 700, 900):
            base = rng.integers(0, 1 << 63, size).astype(U64)
            for _ in range(12):
                one = base.copy()
                change = rng.random(size) < rng.choice([0.0, 0.03, 0.08, 0.1, 0.4])
                one[change] = rng.integers(0, 1 << 63, int(change.sum())).astype(U64)
                sets.append(np.unique(one))
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        maps = jaccard.parities(np.concatenate(sets), row, size, num, den)
        known = rng.integers(0, 30, len(sets))
        a, b = jaccard.possible(maps, size, known, num, den)
        named = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
        assert len(named) == len(a)
        links = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if known[i] != known[j] and len(np.intersect1d(sets[i], sets[j])) * den >= num * len(np.union1d(sets[i], sets[j]))}
        assert links <= named and len(named) < 2 * len(links) + 60


def test_variants_far_below_the_threshold_are_not_read_again(spark, monkeypatch):
    """Templated pages: many candidates, hardly a link; and the groups that are too crowded to name pairs are compared as a whole."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]

    def variant(text):
        return " ".join(rng.choice(words) if rng.random() < 1 / 7 else w for w in text.split())

    texts = [" ".join(rng.choices(words, k=120)) for _ in range(100)]
    rows = [t for t in texts for t in (t, variant(t), variant(t), variant(t))] + [texts[0] + " tail", texts[1] + " tail"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    read = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda base, edges, *rest: (read.append(edges.count()), verified(base, edges, *rest))[1])
    first = rows_of(jaccard.similar_components(docs))
    assert read[-1] <= 4 and {r[2] for r in first if r[0] >= 400} == {0, 4}
    monkeypatch.setattr(jaccard, "MOST_PAIRS", -1)
    assert rows_of(jaccard.similar_components(docs)) == first
