"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
import xxhash
from pyspark.sql import functions as F

from quorumlake.llm import blocks, components, decontamination, fingerprints, jaccard, language, lines, packing, pii, repeats, scoring, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, bucket int, rid string"


def corpus(spark, rows):
    """Documents with columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge_rows():
    rng = random.Random(5)
    words = [f"w{rng.randrange(300)}" for _ in range(4000)]
    long = " ".join(words)
    near = " ".join(words[:1000])
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two three"), (6, "one two three"), (7, "ONE two Three"), (8, long), (9, near), (10, near + " tail"), (10, near + " tail"), (None, near), (11, "a b c d e f g h"), (12, "a b c d e f g h i"), (13, "é ß 😀 中文 text"), (14, "!!! 123 ..."), (15, long), (16, "x" * 50_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, edge_rows):
    return corpus(spark, edge_rows)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


# blocks


def test_words_are_those_of_each_row():
    import pyarrow as pa

    texts = ["a  bb", None, "", " ccc\nd", "dd"]
    data, offsets, nulls = blocks.flat(pa.array(texts))
    start, end, row = blocks.words(data, offsets, blocks.space_table())
    assert [(int(r), data[s:e].tobytes().decode()) for s, e, r in zip(start, end, row, strict=True)] == [(0, "a"), (0, "bb"), (3, "ccc"), (3, "d"), (4, "dd")]
    assert nulls.tolist() == [False, True, False, False, False]


def test_sorted_keys_and_frames_come_back():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (blocks.unpack_sorted(blocks.pack_sorted(keys)) == keys).all()
    assert blocks.unframed(blocks.framed(b"a", b"", b"ccc")) == [b"a", b"", b"ccc"]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 5), (3, 1)], "a long, b long")
    assert dict(components.components(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 4}
    assert components.components(edges.limit(0)).count() == 0


# 1


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [prose(rng.randrange(15, 50)) for _ in range(12)]

    def paraphrased(text):
        ws = text.split()
        for i in range(2, len(ws) - 8, 7):
            ws[i] = rng.choice(vocabulary)
        return " ".join(ws)

    rows = [(i, prose(rng.randrange(20, 400))) for i in range(300)]
    planted = {}
    for k, item in enumerate(items):
        body = item.upper() if k % 3 == 0 else paraphrased(item) if k % 3 == 1 else item.replace(" ", ", ")
        rows.append((1000 + k, prose(60) + " " + body + ". " + prose(40)))
        planted[1000 + k] = k
    rows += [(2000, None), (2001, ""), (2002, items[3]), (2002, items[3])]
    benchmark = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    found = decontamination.contaminated(corpus(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {*planted.items(), (2002, 3)}
    assert all(0 <= r.cosine <= 1 and 0 < r.lcs <= 1 for r in found)


def invented(rng, n=4000):
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n)]
    weights = [1 / (k + 5) for k in range(n)]
    return vocabulary, lambda m: " ".join(rng.choices(vocabulary, weights, k=m))


def test_verbatim_copies_of_short_and_long_items_are_found(spark):
    rng = random.Random(2)
    vocabulary, _ = invented(rng)
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [prose(n) for n in (5, 6, 8, 10, 12, 14, 20, 40, 60, 100, 150, 200, 300, 400, 600, 800)]
    rows = [(i, prose(rng.randrange(20, 400))) for i in range(300)] + [(1000 + k, prose(rng.randrange(50, 70)) + " " + item + " " + prose(40)) for k, item in enumerate(items)]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = decontamination.contaminated(corpus(spark, rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1000 + k, k) for k in range(len(items))}


def leaks(item, text, lcs=decontamination.LCS, answer=decontamination.ANSWER):
    """The definition, by plain search: the best place of the item in the text."""
    a, b = (re.findall(r"[a-z0-9]+", x.lower()) for x in (item, text))
    code = {w: i for i, w in enumerate({*a, *b})}
    x, y = (np.array([code[w] for w in z], dtype=np.uint64) for z in (a, b))
    tail = x[-max(1, len(x) // 4) :]
    for at in range(0, len(y), 8):
        region = y[max(0, at - len(x)) : at + 32 + len(x)]
        share = decontamination.common(region, decontamination.places(x), len(x)) / len(x)
        if share >= 0.85 or (share >= lcs and decontamination.common(region, decontamination.places(tail), len(tail)) / len(tail) >= answer):
            return True
    return False


def test_paraphrases_of_a_large_benchmark_are_found(spark):
    """600 items in one search; 200 leaks with a third of the words replaced, against the definition."""
    rng = random.Random(4)
    vocabulary, prose = invented(rng)
    items = [prose(rng.randrange(14, 50)) for _ in range(600)]
    rows = [(i, prose(rng.randrange(20, 300))) for i in range(400)]
    planted = {}
    for k in range(200):
        ws = items[3 * k].split()
        for i in rng.sample(range(len(ws) * 3 // 4), int(len(ws) * 0.33)):
            ws[i] = rng.choice(vocabulary)
        rows.append((1000 + k, prose(rng.randrange(30, 90)) + " " + " ".join(ws) + " " + prose(40)))
        if leaks(items[3 * k], rows[-1][1]):
            planted[1000 + k] = 3 * k
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(corpus(spark, rows), benchmark).collect()}
    assert len(planted) > 150 and len(found & set(planted.items())) >= 0.95 * len(planted)
    assert all(leaks(items[j], dict(rows)[i]) for i, j in found)


def test_the_latent_space_finds_what_plain_cosine_misses(spark):
    """Rare words of an item are replaced by others that stand in the same company in the corpus."""
    rng = random.Random(6)
    _, prose = invented(rng, 300)
    topics = [[f"topic{t}word{'abcdefghij'[k]}" for k in range(10)] for t in range(30)]
    twins = [(f"{a}physician", f"{a}doctor") for a in (f"t{t}" for t in range(30))]
    rows = []
    for i in range(900):
        t = i % 30
        rows.append((i, " ".join(rng.sample(topics[t], 9) + [twins[t][rng.randrange(2)]] + prose(20).split())))
    item_words, common_words = [], prose(14).split()
    for k in range(8):
        item_words += [common_words[k], twins[5][0]]
    item = " ".join(item_words + common_words[8:])
    replaced = item.replace(twins[5][0], twins[5][1])
    items = decontamination.Items([1], [item])
    base = spark.createDataFrame(rows, "doc_id long, text string")
    decontamination._weigh(base, items)
    decontamination._span(base, items, 40)
    assert items.basis.shape[1] == 40 < items.size  # truncated
    data, offsets, _ = blocks.flat(decontamination.lowered(__import__("pyarrow").array([item, replaced])))
    p = decontamination.Passages(data, offsets, blocks.Prefix(), decontamination.punctuation(), items.vocabulary, decontamination.leading_bits(items.vocabulary))
    whole = np.stack([np.bincount(p.dim[p.row == r], weights=(items.weights[p.dim] * p.sign)[p.row == r], minlength=items.size) for r in (0, 1)])
    cosine = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y))
    assert cosine(*whole) < decontamination.COSINE < cosine(*(whole @ items.basis))


def test_weights_do_not_depend_on_the_size_of_the_corpus():
    items, weights = decontamination.Items([1], ["alpha beta gamma delta"]), []
    for units in (1000, 1_000_000):
        items.weigh(units, np.array([1, 20, 4, 300] + [3] * decontamination.REST) * (units // 1000))
        weights.append(items.weights.tolist())
    assert weights[0] == pytest.approx(weights[1])


def test_no_benchmark_and_no_documents(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, empty).count() == 0
    one = spark.createDataFrame([(1, "some words to look for in all documents here")], "item_id long, text string")
    assert decontamination.contaminated(docs.limit(0), one).count() == 0


def test_longest_common_subsequence():
    item, region = np.array([1, 2, 3, 2, 5], dtype=np.uint64), np.array([9, 1, 3, 9, 2, 5, 2], dtype=np.uint64)
    assert decontamination.common(region, decontamination.places(item), 5) == 4


# 2


def brute_scores(rows, order, alpha=0.4):
    import math

    texts = [words_of(t) for _, t in rows]
    grams = lambda ws, n: Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    own = [[grams(ws, n) for n in range(1, order + 1)] for ws in texts]
    total = [sum((o[n] for o in own), Counter()) for n in range(order)]
    n_words = sum(map(len, texts))
    out = []
    for ws, o in zip(texts, own, strict=True):
        rest, score = n_words - len(ws), 0.0
        for i in range(len(ws)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                g = tuple(ws[i - n + 1 : i + 1])
                c = total[n - 1][g] - o[n - 1][g]
                if c:
                    below = total[n - 2][g[:-1]] - o[n - 2][g[:-1]] if n > 1 else rest
                    score += math.log10(c / below) + (longest - n) * math.log10(alpha)
                    break
            else:
                score += longest * math.log10(alpha) - math.log10(rest + 1)
        out.append((len(ws), round(score, 6)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, edge_rows, docs, order):
    got = scoring.stupid_backoff(docs, order).collect()
    want = Counter((i, *s) for (i, _), s in zip(edge_rows, brute_scores(edge_rows, order), strict=True))
    assert Counter((r.doc_id, r.n_words, round(r.log10_score, 6)) for r in got) == want
    assert all((r.log10_per_word is None) == (r.n_words == 0) for r in got)


def test_registered_query_scores_trigrams(spark, edge_rows, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = scoring.op2_stupid_backoff(spark, str(tmp_path)).collect()
    want = Counter((i, n, round(s, 4)) for (i, _), (n, s) in zip(edge_rows, brute_scores(edge_rows, 3), strict=True))
    assert Counter((r.doc_id, r.n_words, r.log10_score) for r in got) == want


def test_scores_of_no_documents(docs):
    assert scoring.stupid_backoff(docs.limit(0)).count() == 0


# 3


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.predict(docs, language.fit(docs, ~language.held_out()))
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    held = out.filter(language.held_out()).collect()
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_edge_cases(spark, docs):
    train = spark.createDataFrame([(i, "the cat and the dog " * 3, "en") for i in range(5)] + [(i, "der hund und die katze", "de") for i in range(5, 10)], "doc_id long, text string, lang string")
    model = language.fit(train, F.lit(True))
    out = {r.doc_id: r for r in language.predict(docs, model, pred="p", score="q").collect()}
    assert [out[i].p for i in (1, 2, 3, 14)] == ["und"] * 4 and all(out[i].q == 0 for i in (1, 2, 3, 14))
    assert out[13].p != "und" and 0 <= out[13].q <= 1
    unseen = spark.createDataFrame([(1, "hunden katzen"), (2, "cats dogs")], "doc_id long, text string")
    assert [r.p for r in language.predict(unseen, model, pred="p").orderBy("doc_id").collect()] == ["de", "en"]
    nothing = language.fit(train.limit(0), F.lit(True))
    assert {r.p for r in language.predict(docs, nothing, pred="p").collect()} == {"und"}


# 4


def test_fingerprints(spark):
    rows = [(1, "a b c\nd e f\ng"), (2, "d e f\na b c\ng"), (5, "a b c\nd e f\ng"), (9, "other words stand here\nand there"), (11, None), (12, "é😀x")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(corpus(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        direct = spark.createDataFrame([(edited,)], "t string").select(fingerprints.digest(fingerprints.lanes(F.col("t")))).first()[0]
        assert got[i].edited_fingerprint == direct
    assert got[1].fingerprint == got[5].fingerprint == got[2].fingerprint  # paragraphs are a multiset
    assert len({r.fingerprint for r in got.values()}) == 4
    assert got[5].near_next == 0 or got[2].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert fingerprints.fingerprints(corpus(spark, rows).limit(0)).count() == 0
    alone = fingerprints.fingerprints(corpus(spark, rows[:1])).first()
    assert alone.near_next == 1.0


def plain_fingerprint(text):
    """(exact lanes, sketch lanes) without Spark."""
    exact, sketch = [0] * 16, [0] * 64
    for p in text.split("\n"):
        digest = hashlib.sha512(p.encode()).digest()
        exact = [(x + int.from_bytes(digest[4 * i : 4 * i + 4], "big")) % (1 << 32) for i, x in enumerate(exact)]
        ws = p.split(" ")
        for k, w in enumerate(ws):
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            if k + 1 < len(ws):
                h = xxhash.xxh64_intdigest(ws[k + 1].encode(), seed=h)
            mark = (h - (1 << 64) if h >> 63 else h) % 128
            sketch[mark // 2] += 1 - 2 * (mark % 2)
    return exact, sketch


def test_fingerprints_equal_plain_ones(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gämma", "", "delta 😀", "x"]) for _ in range(rng.randrange(0, 30)))
    rows = [(i * 7 % 101, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(200, rows_text := "one\ntwo three"), (199, rows_text), (300, None), (None, "no id")]
    got = {r.doc_id: r for r in fingerprints.fingerprints(corpus(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    hexed = lambda v: "".join(f"{x:08x}" for x in v[0]) + "".join(f"{x % (1 << 16):04x}" for x in v[1])

    def alike(v, w):
        a, b = np.array(v[1], dtype=float), np.array(w[1], dtype=float)
        norm = np.sqrt((a @ a) * (b @ b))
        return 1.0 if v == w else min(max(a @ b / norm if norm else 0.0, 0.0), 0.999999)

    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, changed, following = map(plain_fingerprint, (t, edited, after))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (hexed(own), hexed(changed))
        assert got[i].near_edited == pytest.approx(alike(own, changed)) and got[i].near_next == pytest.approx(alike(own, following))


def test_insertion_and_deletion_are_homomorphic(spark):
    t = spark.createDataFrame([("a b\nc d", "c d", "a b")], "w string, x string, y string")
    v = {c: fingerprints.lanes(F.col(c)) for c in t.columns}
    r = t.select(fingerprints.digest(fingerprints.add(v["x"], v["y"])).alias("p"), fingerprints.digest(v["w"]).alias("w"), fingerprints.digest(fingerprints.add(v["w"], v["x"], -1)).alias("d"), fingerprints.digest(v["y"]).alias("y")).first()
    assert r.p == r.w and r.d == r.y


# 5


def test_boilerplate_lines_go(spark):
    rows = [(i, f"own {i}\n menu \nown too {i}", "en", "a" if i < 40 else "b", 1, "x", 1, "y") for i in range(60)] + [(100, None, "en", "a", 0, "x", 1, "y"), (101, "", "en", None, 0, "x", 1, "y"), (102, "menu\nmenu\nx", "en", None, 0, "x", 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs, max_ratio=0.4).collect()}
    assert got[3].text == "own 3\nown too 3" and got[3]._n_dropped == 1 and got[45]._n_dropped == 1
    assert got[100].text is None and got[101].text == "" and got[102].text == "menu\nmenu\nx"
    assert lines.drop_boilerplate(docs, max_ratio=1.0).agg(F.sum("_n_dropped")).first()[0] == 0
    assert lines.drop_boilerplate(docs.limit(0)).columns == [*docs.columns, "_n_lines", "_n_dropped"]


def test_small_hosts_have_boilerplate_too(spark):
    rows = [(i, f"own {i}\nfooter", "en", f"h{h}", 1, "x", 1, "y") for h, n in ((1, 9), (2, 6), (3, 3), (4, 1)) for i in range(100 * h, 100 * h + n)]
    got = {r.doc_id: r._n_dropped for r in lines.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, n in got.items() if n == 1} == {i for i in got if i < 400} and got[400] == 0
    few = lines.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), support=7).collect()
    assert {r.doc_id for r in few if r._n_dropped} == set(range(100, 109))


def test_clashing_columns_of_lines_and_languages(spark):
    names = ["doc_id", "text", "source", "_host", "_drop", "_kept", "_n_lines", "_n_dropped", "lang", "LANG_PRED", "score"]
    docs = spark.createDataFrame([(i, f"own {i}\nfooter", "s", "a", "b", "c", 7, 8, "en", "q", 0.5) for i in range(12)], names)
    out = lines.drop_boilerplate(docs)
    assert out.columns == [*names, "__n_lines", "__n_dropped"]
    assert {(r._drop, r._n_lines, r.__getitem__("__n_dropped"), r.text) for r in out.collect()} == {("b", 7, 1, f"own {i}") for i in range(12)}
    out = language.predict(docs, language.fit(docs, F.lit(True)))
    assert out.columns == [*names[:-2], "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"en"}


# 6


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    luhn = lambda s: sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(s[::-1])) % 10 == 0
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = {"email": False, "ip": any(int(x) > 255 for x in m[0].split(".")) if kind == "ip" else False, "card": not (13 <= len(digits) <= 19 and luhn(digits)), "phone": not 9 <= len(digits) <= 15}
            if not bad[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pattern_spans_equal_brute_force(spark):
    texts = ["a@b-_c@d.e f@g.h_i@j.k", "1.2.3.4.5.6.7.8.9", "999.1.1.1 1.1.1.1", "4111 1111 1111 1111 x 4111-1111-1111-1112", "+1 (2) 3.4-5 6 7 8 9 0", "é@a.b ü x@ä.de", "+12345678", "@@@", "a@b.c..d@e.f", "0000255.1.1.1", "1." * 2000, "1 " * 3000, "a" * 20000 + "@", "a@b" + ".c" * 3000, "1" * 3000, "+" * 500, "😀 x@y.z 😀 1.2.3.4", "+1" * 50, None, ""]
    got = pii.personal_data(corpus(spark, enumerate(texts))).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.base] == brute_spans(texts[r.doc_id])
    assert {r.doc_id: r.sanitised for r in got}[16] == "😀 [EMAIL] 😀 [IP]"


def test_terms_that_always_stand_by_an_entity_are_found(spark):
    rows = [(i, f"captain Zorblax {i} writes from zor@mail.org today") for i in range(4)] + [(i, f"today the captain {i} writes to us from here again and again") for i in range(4, 40)]  # different texts: equal ones are one document
    got = {r.doc_id: r for r in pii.personal_data(corpus(spark, rows)).collect()}
    assert {s.kind for s in got[0].spans} == {"email", "term"} and "[TERM]" in got[0].sanitised and "Zorblax" not in got[0].sanitised
    assert "captain" in got[0].sanitised and got[9].spans == []
    assert pii.personal_data(corpus(spark, rows).limit(0)).count() == 0


def test_revealing_terms_go_from_documents_without_the_entity(spark):
    rows = [(i, f"ticket {i} zorvanek zorvanek@mail.org") for i in range(4)] + [(10, "Zorvanek called again")] + [(100 + i, "nothing of note here") for i in range(300)]
    got = {r.doc_id: r for r in pii.personal_data(corpus(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got[10].base == [] and got[10].sanitised == "[TERM] called again"
    assert all("zorvanek" not in got[i].sanitised for i in range(4))
    assert all(got[100 + i].spans == [] for i in range(300))


def test_running_sums_of_long_arrays(spark):
    for n in (0, 1, 63, 64, 65, 5000):
        t = spark.createDataFrame([([(k * 7) % 11 for k in range(n)],)], "a array<bigint>")
        r = t.select(pii.running(F.col("a"), lambda x, y: x + y).alias("s"), pii.running(F.col("a"), F.greatest).alias("m")).first()
        values = np.array([(k * 7) % 11 for k in range(n)], dtype=np.int64)
        assert r.s == np.cumsum(values).tolist() and r.m == np.maximum.accumulate(values).tolist()


def test_dense_texts_take_time_in_proportion(spark):
    """A megabyte of one sign, and a line of very many entities; a fold that copied its list would not end."""
    texts = ["1." * 500_000, " ".join(f"name{k}@host{k % 50}.org" for k in range(20_000))]
    began = time.time()
    got = {r.doc_id: r for r in pii.personal_data(corpus(spark, enumerate(texts))).collect()}
    assert time.time() - began < 60
    assert [(s.kind, s.start, s.end) for s in got[0].base] == [("ip", k, k + 7) for k in range(0, 1_000_000, 8)]
    assert got[0].sanitised == "[IP]." * 125_000
    assert [(s.kind, s.start, s.end) for s in got[1].base] == brute_spans(texts[1])
    assert got[1].sanitised.count("[EMAIL]") == 20_000


def brute_terms(rows, residual):
    """(entity, term) by their definition, over different texts: of those with the term, how many have it by the entity."""
    texts = {text for _, text in rows}
    letters = lambda x: {w for w in re.split(r"[^a-zé]+", x.lower()) if len(w) >= 2}
    near = {}  # text: {entity: terms by it}
    for text in texts:
        near[text] = {}
        for kind, pattern in PATTERNS:
            found = list(re.finditer(pattern, text))
            valid = {(a, b) for k, a, b in brute_spans(text) if k == kind}
            edges = [0, *[x for m in found for x in m.span()], len(text)]
            for k, m in enumerate(found):
                if m.span() in valid:
                    before, after = text[edges[2 * k] : m.start()], text[m.end() : edges[2 * k + 3]]
                    before = before if len(before) <= pii.NEAR else re.sub(r"^[^\W\d_]+", "", before[-pii.NEAR :])
                    after = after if len(after) <= pii.NEAR else re.sub(r"[^\W\d_]+$", "", after[: pii.NEAR])
                    near[text].setdefault(m[0].lower(), set()).update(letters(before) | letters(after))
    out = set()
    for entity in {e for n in near.values() for e in n}:
        for term in {t for n in near.values() for t in n.get(entity, ())}:
            holders = [t for t in texts if term in letters(t)]
            together = sum(term in near[t].get(entity, ()) for t in holders)
            if -np.log2(together / (len(holders) + 1)) <= residual:
                out.add((entity, term))
    return out


def test_terms_count_documents_and_copies_are_one(spark):
    found = lambda rows: {t for _, t in found_pairs(rows)}

    def found_pairs(rows):
        got = pii.revealing(spark.createDataFrame(rows, "doc_id long, _text string").withColumn("_found", pii.pattern_spans(F.col("_text"))))
        pairs = {(r.entity, r.term) for r in got.collect()} if got is not None else set()
        assert pairs == brute_terms(rows, pii.RESIDUAL)
        return pairs

    often_in_one = [(0, " ".join(f"zebra {i} bob@host.com" for i in range(8)))] + [(i, f"the zebra eats grass {i}") for i in range(1, 10)]
    assert "zebra" not in found(often_in_one)
    always = [(i, f"{i} of kim at bob@host.com") for i in range(8)]
    assert "kim" in found(always)
    others = [(20 + i, f"row {i} has nothing of it") for i in range(30)]
    assert found(always + others) == found(always * 5 + others * 3) == {"kim", "at"}
    one = [(0, "kim at bob@host.com"), *others]
    assert found(one) == found(one + [(k, "kim at bob@host.com") for k in range(50, 60)]) == set()
    hidden = {r.doc_id: r.sanitised for r in pii.personal_data(corpus(spark, always + [(99, "ask Kim")])).collect()}
    assert hidden[99] == "ask [TERM]" and all("kim" not in hidden[i] for i in range(8))


@pytest.mark.parametrize("residual", [0.75, 1.0])
def test_revealing_terms_equal_brute_force(spark, residual):
    rng = random.Random(8)
    common, people = [f"{a}{b}{c}word" for a in "abcd" for b in "efgh" for c in "ijk"], [f"{a}{b}person" for a in "klmn" for b in "opqr"]
    rows = []
    for i in range(150):
        who = rng.randrange(16)
        mark = [f"mail{who}@host.org", f"10.0.0.{who}", f"+49 30 12345{who:02d}", ""][who % 4]
        lines_ = [" ".join(rng.choices(common, k=rng.randrange(3, 40))) for _ in range(3)]
        lines_[1] += f" {people[who]}\n{mark}\n {people[who] if rng.random() < 0.5 else rng.choice(people)} "
        rows.append((i, "\n".join(lines_)))
    rows += [(500 + i, t) for i, t in rows[:10]]
    found = pii.revealing(spark.createDataFrame(rows, "doc_id long, _text string").withColumn("_found", pii.pattern_spans(F.col("_text"))), residual)
    want = brute_terms(rows, residual)
    assert {(r.entity, r.term) for r in found.collect()} == want and want


# 7


def test_packing_round_trip(spark, edge_rows, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [*edge_rows, (20, "<|endoftext|> inside"), (21, "a" * 3)]
    packed, certificate = packing.pack(packing.tokenized(corpus(spark, rows)))
    got = packed.collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == certificate["bins"] >= certificate["bound"]
    assert packing.pack(packing.tokenized(docs.limit(0)))[0].count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a \n" + " " * 700_000 + "b", "q" * 2_000_000], ids=["spaces", "newlines", "mixed", "letters"])
def test_long_runs_get_the_ids_of_the_json_form(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    encode = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert encode(text).tolist() == want


def test_a_document_of_a_long_run_is_packed(spark):
    packed, certificate = packing.pack(packing.tokenized(corpus(spark, [(1, " " * 1_000_000), (2, "a b")])))
    assert packed.agg(F.sum("length")).first()[0] == 1_000_001 + 3 and certificate["bins"] >= certificate["bound"]


def test_bounds_and_best_fit():
    h = np.zeros(11, dtype=np.int64)
    h[6] = 5
    assert packing.lower_bound(h, 10) == 5  # no two fit together; the sum alone says 3
    sizes = np.array([6, 4, 5, 5, 3, 7])
    bins, offsets, made = packing.best_fit(sizes, 10)
    assert made == 3 and all(sizes[bins == b].sum() <= 10 for b in range(3))
    for seed in range(5):
        sizes = np.random.default_rng(seed).integers(1, 101, 500)
        made = packing.best_fit(sizes, 100)[2]
        assert packing.lower_bound(np.bincount(sizes, minlength=101), 100) <= made <= 1.25 * sizes.sum() / 100 + 1


# 8


def brute_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        ws = words_of(t)
        sets.append((i, {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), i if not s else least.get(find(k))) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("num", "n"), [(85, 4), (80, 5), (50, 2)])
def test_jaccard_components_equal_brute_force(spark, edge_rows, num, n):
    rng = random.Random(num)
    rows = list(edge_rows)
    for g in range(25):  # chains of edits around the threshold, of all sizes
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([4, 6, 9, 14, 25, 60, 150, 400]))]
        for k in range(6):
            rows.append((1000 + g * 10 + k, " ".join(base)))
            base = list(base)
            for _ in range(max(1, len(base) * (100 - num) // 100 // (2 * n))):
                base[rng.randrange(len(base))] = f"v{rng.randrange(5000)}"
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(corpus(spark, rows), num, 100, n).collect())
    assert got == brute_components(rows, n, num, 100)


def test_large_candidate_groups_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 8)
    rng = random.Random(3)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(60):
        ws = list(base)
        for _ in range(2):
            ws[rng.randrange(120)] = f"u{rng.randrange(10_000)}"
        rows.append((i, " ".join(ws)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(corpus(spark, rows)).collect())
    assert got == brute_components(rows, 4, 85, 100)


def test_links_inside_a_large_group():
    rng = np.random.default_rng(0)
    bases = [np.unique(rng.integers(0, 1 << 62, 80).astype(np.uint64)) for _ in range(40)]
    sets = []
    for b in bases:
        for _ in range(5):
            s = b.copy()
            s[rng.integers(0, len(s), 3)] = rng.integers(0, 1 << 62, 3).astype(np.uint64)
            sets.append(np.unique(s))
    parent = list(range(len(sets)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in jaccard.linked(sets, 85, 100):
        parent[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert find(a) == find(b)


@pytest.mark.parametrize("swap", [False, True])
def test_repeated_and_null_ids_break_no_chain(spark, swap):
    text = lambda *changed: " ".join(f"u{k}" if k in changed else f"v{k}" for k in range(120))
    rows = [(5, " ".join(f"x{k}" for k in range(90))), (5, text()), (12, text(3)), (7, text(3, 60)), (None, text(3, 60, 100)), (30, text(3, 60, 100, 20, 40))]
    rows = [rows[1], rows[0], *rows[2:]] if swap else rows
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(corpus(spark, rows)).collect())
    assert got == brute_components(rows, 4, 85, 100) and got[30, 117, 5] == 1


def test_forest_of_edges():
    a, b = np.array([5, 7, 9, 30, 9, 40]), np.array([7, 9, 1, 31, 5, 40])
    assert dict(zip(*(x.tolist() for x in jaccard.forest_of(a, b)), strict=True)) == {5: 1, 7: 1, 9: 1, 31: 30}


def test_no_shingles_at_all(spark, docs):
    assert jaccard.similar_components(docs.limit(0)).count() == 0
    blank = jaccard.similar_components(corpus(spark, [(1, None), (2, ""), (3, " ")])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in blank} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}


# 9


def test_shards(spark, edge_rows, docs):
    got = sharding.assign(docs, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in edge_rows)
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    again = sharding.assign(docs.repartition(7), 4).collect()
    assert Counter((r.doc_id, r.shard) for r in got) == Counter((r.doc_id, r.shard) for r in again)
    assert sharding.assign(docs.limit(0)).count() == 0


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    a, b = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert ((a == b) | (b == 16)).all() and abs((a != b).mean() - 1 / 17) < 0.01
    assert np.bincount(a).min() > 1000


def plain_jump(key, n):
    """The published loop, on Python's integers."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_equal_the_published_loop(spark):
    docs = corpus(spark, [(i * 13 - 500, "x") for i in range(400)] + [(None, "y")])
    for r in sharding.assign(docs, 16).collect():
        key = 42 if r.doc_id is None else xxhash.xxh64_intdigest(str(r.doc_id).encode(), seed=42)
        assert (r.shard, r.grown_shard) == (plain_jump(key, 16), plain_jump(key, 17))


# 10


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = Counter()
    for (i, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, len(b), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [40, 200])
def test_repeats_equal_brute_force(spark, edge_rows, length):
    rng = random.Random(length)
    letters = lambda n: "".join(rng.choices("abcdé ", k=n))
    passage = letters(length + 37)
    rows = [*((i, t) for i, t in edge_rows if len(t or "") < 40_000), (30, letters(500) + passage), (31, passage + letters(300)), (32, letters(10) + passage[: length - 1]), (33, "ab" * length), (34, letters(length)), (35, passage[5:] + "!" + passage[:-5])]
    got = repeats.without_repeats(corpus(spark, rows), length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, length)


def test_long_texts_go_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(9)
    text = "".join(rng.choices("abcdef", k=5000))
    rows = [(1, text), (2, "".join(rng.choices("abcdef", k=3000)) + text[1000:2500]), (3, text[:90] + "x")]
    got = repeats.without_repeats(corpus(spark, rows), 80).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 80)
    assert repeats.without_repeats(corpus(spark, rows).limit(0), 80).count() == 0


def test_groups_that_cross_boundaries_are_compared(spark):
    """One gram in very many contexts, over more buckets than contexts of it fit in one."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    core, rows = letters(150), []
    for i in range(120):
        text = letters(90) + core + letters(90)
        rows += [(2 * i, text), (2 * i + 1, letters(60) + (text[30:280] if i % 3 == 0 else core) + letters(50))]
    for buckets in (1, 40, 400):
        got = repeats.without_repeats(corpus(spark, rows), 200, buckets=buckets).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 200)


def test_common_prefixes_and_parts():
    rng = np.random.default_rng(3)
    texts = sorted(bytes(rng.integers(97, 99, 32).astype(np.uint8)) if k % 4 else b"a" * 31 + bytes([97 + k % 3]) for k in range(200))
    words = [np.array([int.from_bytes(t[8 * w : 8 * w + 8], "big") for t in texts], dtype=np.uint64) for w in range(4)]
    same = lambda x, y: next((k for k in range(32) if x[k] != y[k]), 32)
    assert repeats.common_prefix(words).tolist() == [-1, *map(same, texts[1:], texts)]
    splitters = [w[::9] for w in words]
    assert repeats.part_of(splitters, words).tolist() == [sum(s <= t for s in texts[::9]) for t in texts]


def test_sort_by_several_keys():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 5, 500).astype(np.uint64) for _ in range(3)]
    order = repeats.multikey_order(*keys)
    assert [tuple(int(k[i]) for k in keys) for i in order] == sorted(zip(*[k.tolist() for k in keys], strict=True))


# queries


def test_registered_queries_run_on_whole_tables(spark):
    from quorumlake.llm import registry

    n = ds.dataset(f"{SF}/documents.parquet").count_rows()
    for name in ("op2_stupid_backoff", "op3_word_backoff_language", "op4_multiset_fingerprints", "op5_site_lines", "op6_disclosure_pii", "op8_ngram_jaccard", "op9_jump_shards", "op10_suffix_repeats"):
        assert registry.QUERIES[name](spark, SF).count() == n, name


def test_shuffle_files_of_a_written_half_go_at_its_end(spark):
    """Else texts of two shuffles are on disk at once."""
    from quorumlake.runtime import materialize

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    files = lambda: {x for x in str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()).replace(")", ",").split(", ") if "shuffle_" in x}
    old = files()
    out = materialize(spark.range(1000).repartition(3, "id"), drop_shuffles=True)
    end = time.time() + 20
    while files() - old and time.time() < end:
        time.sleep(0.2)
    assert not files() - old and out.count() == 1000 and spark.conf.get(key) == before
    materialize(spark.range(1000).repartition(3, "id"))
    assert files() - old
