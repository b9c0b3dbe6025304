import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from slatework.functions.geo import EARTH_M
from slatework.llm import canonical, lookalike, overlap


def forms(spark, texts, kind="text"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.form for r in sorted(lookalike.one_form(df, "t", kind, keep=("i",)).collect(), key=lambda r: r.i)]


def test_one_form(spark):
    same = ["pollustaló_1.png", "pollustaló_1.png", "​pollustaló_1­.png ", "ｐollustaló＿１．png", "роllustаló_1.png", "pollustaló_𝟷.png", " pollustaló_1.png "]
    assert set(forms(spark, same)) == {"pollustaló_1.png"}
    assert forms(spark, [None, "", " ​", "a b", "a  b", "A"]) == [None, "", "", "a b", "a  b", "A"]
    long = "roof ﬂat " * 20_000
    assert forms(spark, [long]) == [long.replace("ﬂ", "fl").strip()]  # whole, and its ligatures written out
    assert len(set(forms(spark, ["x_1.png", "x_2.png", "y_1.png", "X_1.png"]))) == 4


def test_compatibility_forms_are_written_plainly(spark):
    pairs = {"ﬁle_ﬄ": "file_ffl", "Ⅳ_ⅷ": "IV_viii", "x²y³z¹": "x2y3z1", "ǆ_ĳ": "dž_ij", "a…": "a...", "ｶﾞ": "ガ", "ℌ①": "H①"}
    assert forms(spark, list(pairs)) == list(pairs.values())


def test_form_equals_plain_python(spark):
    rnd = random.Random(1)
    chars = "abé́αοанк​­１ｚ𝟵   ._-‐"
    texts = ["".join(rnd.choices(chars, k=12)) for _ in range(200)]
    invisible = {"​", "­"}

    def plain(t):
        t = "".join(c for c in t if c not in invisible)
        t = "".join(unicodedata.normalize("NFKC", c) if ord(c) >= 0x2100 and c not in " ‐" else c for c in t)
        t = unicodedata.normalize("NFC", "".join(lookalike.LOOKALIKES.get(c, c) for c in t))
        return t.replace(" ", " ").replace(" ", " ").strip(" ")

    assert forms(spark, texts) == [plain(t) for t in texts]


def test_image_names(spark):
    same = ["a b_1.png", "train/a b_1.png", "crops\\A B_1.PNG", "a b_1.jpeg", "a b_1 (2).png", "a b_1_copy.png", "a b_1-Copy.png", "a b_1_crop.png", "a b_1.png.png", "а b_1_crop (1).JPG"]
    assert set(forms(spark, same, "image")) == {"a b_1"}
    assert len(set(forms(spark, ["a_1.png", "a_2.png", "a_11.png"], "image"))) == 3


def test_registered_spelling(spark):
    rows = spark.createDataFrame([(1, "аb.png"), (2, "ab.png"), (3, "zz.png"), (4, None), (5, " "), (6, "ab.png​"), (6, "ab.png​")], "id long, t string").selectExpr("*", "'x' as form", "'y' as registered")
    register = spark.createDataFrame([("ab.png",), ("ab.png",), ("cd.png",), (None,)], "f string")
    assert sorted(map(tuple, lookalike.registered_spelling(rows, "id", "t", register, "f").collect())) == [(1, "ab.png"), (6, "ab.png"), (6, "ab.png")]
    assert lookalike.registered_spelling(rows, "id", "t", register.where("false"), "f").count() == 0
    with pytest.raises(ValueError, match="form"):
        lookalike.one_form(rows, "t", keep=("form",))


def edits(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_search_equals_brute_force():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcd", k=rnd.randint(0, 7)))
    entries = [(w, i) for i, w in enumerate({word() for _ in range(60)}) if w]
    trie = canonical.Trie(entries)
    for _ in range(300):
        v, k = word(), rnd.randint(0, 3)
        assert trie.search(v, k) == {i: edits(v, w) for w, i in entries if edits(v, w) <= k}


@pytest.mark.parametrize(
    ("typed", "ref"),
    [
        ("new_town_norland", 1), ("Norland - New Town", 1), ("NEW TOWN", 1), ("New Town 70828", 1), ("Nëw Towm (Norland)", 1), ("New Town, Nor.", 1), ("City of New Town, Norland", 1), ("New Town, New Town District, Norland", 1),
        ("LÃ¸vstad, Sudland", 2), ("Lovstad", 2), ("Løvstda, Sudlnd", 2), ("Xqqzwk, Norland", -1), ("???", -1), ("same as above", -1),
    ],
)
def test_cities(spark, typed, ref):
    r = spark.createDataFrame([(1, "New Town, Norland", "Norland", 10.0, 10.0), (2, "Løvstad, Sudland", "Sudland", 0.0, 50.0)], "city_id long, city_name string, country string, latitude double, longitude double")
    rows = spark.createDataFrame([(7, typed, None, None)], "id long, value string, lat double, lon double")
    assert [(x.id, x.ref_id) for x in canonical.cities(rows, r).collect()] == [(7, ref)]


def test_the_nearest_of_namesakes_and_the_odd_cases(spark):
    r = spark.createDataFrame([(1, "Aaton, Norland", "Norland", 10.0, 10.0), (2, "Aaton, Sudland", "Sudland", 0.0, 50.0)], "city_id long, city_name string, country string, latitude double, longitude double")
    rows = [(1, "aaton", 1.0, 49.0), (2, "aaton", None, None), (3, "Aaton, Sudland", 10.0, 10.0), (4, None, 1.0, 1.0), (5, " ​", 1.0, 1.0), (6, "x" * 100_000, 1.0, 1.0), (2, "aaton", None, None)]
    df = spark.createDataFrame(rows, "id long, value string, lat double, lon double").selectExpr("*", "'c' as refs", "1 as ref")
    got = sorted((x.id, x.ref_id, x.exact) for x in canonical.cities(df, r).collect())
    assert got == [(1, 2, False), (2, 1, False), (2, 1, False), (3, 2, True), (6, -1, False)]
    assert canonical.cities(df.where("false"), r).count() == 0
    assert {x.ref_id for x in canonical.cities(df, r.where("false")).collect()} == {-1}


def test_roofshapes(spark):
    r = spark.createDataFrame([(1, "Flat", "level"), (2, "Hipped", "hip"), (3, "Half-Hipped", "clipped gable"), (4, "Gabled", "gable, saddle"), (5, "Sawtooth", "shed row"), (6, "Skillion", "shed")], "shape_id long, roofshape string, also_called string")
    typed = {"FLAT": 1, "roof: flat": 1, "flat_roof": 1, "Flat (main)": 1, "hip roof": 2, "Hiiped": 2, "HALF HIP": 3, "clipped gable": 3, "Gables": 4, "shed": 6, "shed row": 5, "green": -1, "ridge 12 m": -1, "3": -1}
    rows = spark.createDataFrame([(i, v, None, None) for i, v in enumerate([*typed, "n/a", None, "Flat"])], "id long, value string, lat double, lon double")
    got = {x.value: x.ref_id for x in canonical.roofshapes(rows, r).collect() if not x.exact}
    assert got == typed


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_overlap_equals_brute_force(spark, threshold):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    text = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 9)))
    e, t = [text() for _ in range(60)], [text() for _ in range(60)]
    t += e[:10]
    grams = lambda s: {tuple(s.split()[i : i + 2]) for i in range(max(1, len(s.split()) - 1))}
    want = {(a, b) for a in e for b in t if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= threshold - 1e-12}
    frames = [spark.createDataFrame([(x,) for x in [*v, None, ""]], "text string") for v in (e, t)]
    got = [(r.text_e, r.text_t) for r in overlap.similar_texts(*frames, lambda c: overlap.word_shingles(c, 2), threshold).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_weighted_overlap_equals_brute_force(spark):
    import math
    from collections import Counter

    rnd = random.Random(9)
    names = lambda n: sorted({f"{rnd.choice(['aston', 'bremen', 'port_kiel', 'new york'])}_{rnd.randint(100, 160)}{rnd.choice(['', '_height', ' roof', '_final', '_copy'])}.{rnd.choice(['png', 'jpg'])}" for _ in range(n)})
    e, t = names(80), names(120)
    words = {x: frozenset(w for w in __import__("re").split(r"[^a-z0-9]+", x) if w and w not in overlap.HANDLING) for x in {*e, *t}}
    counts = Counter(w for x in words.values() for w in x)
    weight = lambda ws: sum(math.log1p(len(words) / counts[w]) ** 3 for w in ws)
    measured = {(a, b): weight(words[a] & words[b]) / weight(words[a] | words[b]) for a in e for b in t}
    for threshold in (0.3, 0.5, 0.8):
        frames = [spark.createDataFrame([(x,) for x in v], "text string") for v in (e, t)]
        got = {(r.text_e, r.text_t): r.similarity for r in overlap.similar_texts(*frames, overlap.name_shingles, threshold, weighted=True).collect()}
        want = {k: v for k, v in measured.items() if v >= threshold - 1e-12}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert any(v < 1 for v in want.values())


def test_cross_pairs_keep_copies_and_empty_sides(spark, monkeypatch):
    from slatework import session

    e = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghij"), (3, None), (4, "")], "id long, text string")
    t = spark.createDataFrame([(7, "abcdefghij"), (8, "abcdefghik"), (9, "short")], "id long, text string")
    s = lambda c: overlap.char_shingles(c, 8)
    found = overlap.similar_texts(e, t, s, 0.5)
    assert sorted(map(tuple, overlap.cross_pairs(e, t, found).collect())) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    assert overlap.similar_texts(e.where("false"), t, s, 1.0).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        overlap.similar_texts(e.select("text"), t.select("text"), s, 0.0)
    assert EARTH_M > 0
    # A text that very many rows hold is dealt to several tasks without loss.
    monkeypatch.setattr(session, "DEALT_ROWS", 3)
    many = spark.createDataFrame([(i, "abcdefghij") for i in range(20)], "id long, text string")
    assert sorted(map(tuple, overlap.cross_pairs(e, many, overlap.similar_texts(e, many, s, 1.0)).collect())) == [(a, b) for a in (1, 2) for b in range(20)]


def test_name_shingles(spark):
    df = spark.createDataFrame([("Aston_00123 (2)_copy.PNG",), ("aston-00123.jpg",), ("12.png",), ("",), (None,)], "t string").select(overlap.name_shingles(F.col("t")).alias("s"))
    a, b, c, d, n = (r.s for r in df.collect())
    assert sorted(a) == sorted(b)
    assert (len(a), len(c), d, n) == (2, 2, [], None)
