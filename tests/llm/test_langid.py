"""Language ID against a plain Kneser-Ney model, and its bounds."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from motorspark.llm import langid


def plain_model(words, alphabet):
    """log p(character | up to three before it) of one language, with dictionaries."""
    places = [(("\x02" * 3) + w + "\x03")[i - 3 : i + 1] for w in words for i in range(3, len(w) + 4)]
    orders = []
    for n in range(1, 5):
        if n == 4:
            counts = Counter(places)
        else:
            counts = Counter(g[-n:] for g in {p[-(n + 1) :] for p in places})
        ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        total, kinds = defaultdict(int), defaultdict(int)
        for g, c in counts.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        orders.append((counts, total, kinds, discount))

    def p(g, n=4):
        if n == 0:
            return 1 / alphabet
        counts, total, kinds, discount = orders[n - 1]
        own = g[4 - n :]
        if not total[own[:-1]]:
            return p(g, n - 1)
        return max(counts[own] - discount, 0) / total[own[:-1]] + discount * kinds[own[:-1]] / total[own[:-1]] * p(g, n - 1)

    return lambda w: -sum(math.log(p((("\x02" * 3) + w + "\x03")[i - 3 : i + 1])) for i in range(3, len(w) + 4))


@pytest.fixture(scope="module")
def model_and_words():
    r = random.Random(3)
    make = lambda letters: ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(200)]
    words = {"aa": make("abcde"), "bb": make("cdefg")}
    # Fewer than 20 texts: none is held back.
    return langid.fit({k: [" ".join(w)] for k, w in words.items()}), words


def test_scores_equal_the_plain_model(model_and_words):
    model, words = model_and_words
    alphabet = len({c for ws in words.values() for w in ws for c in w} | {"\x02", "\x03"}) + 1
    asked = [*words["aa"][:40], *words["bb"][:40], "xyz", "a", "axe", "gggggggg", "一"]
    got = model.word_scores(asked)
    for j, lang in enumerate(model.languages):
        plain = plain_model(words[lang], alphabet)
        assert np.allclose(got[:, j], [plain(w) for w in asked], rtol=1e-4)


def test_long_words_are_scored_as_if_in_one_piece(model_and_words, monkeypatch):
    model, _ = model_and_words
    r = random.Random(1)
    words = ["".join(r.choice("abcdefg") for _ in range(10_000)), "abc", "x" * 3000]
    whole = model.word_scores(words)
    for places in (7, 100, 4096):
        monkeypatch.setattr(langid, "PLACES", places)
        assert np.allclose(model.word_scores(words), whole, rtol=1e-9)
    assert langid.entropies(model, [words[0]])[1].tolist() == [10_000]


def test_train_takes_distinct_texts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 100)
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts: seen.update(texts))
    rows = [(i, "hot text", "aa") for i in range(300)] + [(1000 + i, f"text {i} " + "ab" * 5000, "aa") for i in range(20)]
    rows += [(2000, None, "aa"), (2001, "", "aa"), (2002, "some", None), (2003, "12", "cc"), (2004, "only one", "bb")]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(seen) == {"aa", "bb"} and len(seen["aa"]) == len(set(seen["aa"])) == 5
    assert all(len(t) <= 100 + langid.SLICES for t in seen["aa"])


def test_a_language_with_few_documents_rejects_like_all(spark):
    r = random.Random(0)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(60))
    model = langid.fit({"aa": [make(["ba", "ko", "ti"]) for _ in range(60)], "bb": [make(["sch", "ung", "ei"]) for _ in range(3)]})
    assert np.isfinite(model.limit).all()


def test_query_on_odd_rows(spark, tmp_path):
    r = random.Random(2)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(30))
    kinds = {"aa": ["ba", "ko", "ti"], "bb": ["sch", "ung", "ei"]}
    rows = [(i, make(kinds[k]), k, "x", 0.5, True) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa", "x", 0.5, True), (501, "", None, "x", 0.5, True), (None, make(kinds["bb"]), "bb", "x", 0.5, True), rows[0], (502, "sch" * 500_000, None, "x", 0.5, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, rejected boolean")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op9_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    right = [g["lang_pred"] == rows[g["doc_id"]][2] for g in got if g["doc_id"] is not None and g["doc_id"] < 500]
    assert np.mean(right) > 0.95
    by = {g["doc_id"]: g for g in got}
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[502]["lang_pred"] == "bb" and not by[None]["held_out"]
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert langid.op9_langid(spark, f"{tmp_path}/none").count() == 0


def test_numbers_are_no_letters_and_short_junk_is_rejected(spark):
    r = random.Random(6)
    kinds = {"aa": ["ba", "ko", "ti", "na", "re"], "bb": ["sch", "ung", "ei", "de", "ver"]}
    word = lambda parts: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    make = lambda parts, n: " ".join(word(parts) for _ in range(n))
    model = langid.fit({k: [make(p, 100) for _ in range(60)] for k, p in kinds.items()})
    assert (np.diff(model.limit, axis=1) <= 0).all() and np.isfinite(model.limit).all()
    texts = ["½ ²", "Ⅷ", "12 ³", "x½y"]
    real = [make(p, n) for p in kinds.values() for n in (1, 2, 5, 10, 20) for _ in range(40)]
    junk = [" ".join("".join(r.choice("qxzjwvkfpmyhgu") for _ in range(r.randint(3, 8))) for _ in range(n)) for n in (5, 8, 12, 16) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(texts + real + junk)]
    got = [g for g in sorted(langid.detect(spark.createDataFrame(rows, "doc_id long, text string"), model).collect(), key=lambda g: g["doc_id"])]
    assert [g["lang_pred"] for g in got[:3]] == ["und"] * 3 and got[3]["lang_pred"] != "und" and all(g["rejected"] for g in got[:3])
    good, bad = got[4 : 4 + len(real)], got[4 + len(real) :]
    assert not any(g["rejected"] for g in good) and np.mean([g["rejected"] for g in bad]) > 0.97


def test_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 10)
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts: seen.update(texts))
    rows = [(i, f"text of language {i % 300} number {i}", f"l{i % 300}") for i in range(900)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen) == 300 and all(len(t) == 1 for t in seen.values())
