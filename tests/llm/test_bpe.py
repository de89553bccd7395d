"""BPE against the tokenizers library: every code point with a category, odd rows, very long texts."""

import hashlib
import random
import sys
import unicodedata

import pytest
import tokenizers

from motorspark.llm import bpe, packing


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    return bpe.Encoder(path), tokenizers.Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def points():
    """All code points with a category, those the regex library has a category for beyond these, and a sample of the rest."""
    every = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    known = [c for c in every if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    newer = [c for c in every if bpe._unsettled().match(chr(c)) and bpe.regex.match(r"[\p{L}\p{N}\s]", chr(c))]
    rest = random.Random(1).sample(every, 3000)
    return known + newer + rest + [0x558, 0x58B, 0x88F, 0xC5C, 0xCDC, 0x18EAA, 0x323FF]


@pytest.mark.parametrize("context", ["a{}'s", "1{}! ", " {} x"])
def test_every_code_point(both, points, context):
    code, t = both
    texts = ["\n".join(context.format(chr(c)) for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in code.encode_batch(texts)] == want


def test_the_packing_encoder_has_the_same_ids(both, points):
    texts = ["\n".join(f"a{chr(c)}'s 1{chr(c)}!" for c in points[i : i + 500]) for i in range(0, len(points), 1500)]
    assert [packing.ids_of(x, packing.default_ranks()).tolist() for x in texts] == [e.ids for e in both[1].encode_batch(texts, add_special_tokens=False)]


def test_long_texts_with_an_unsettled_code_point(both):
    code, t = both
    text = ("words and 123 numbers,  spaces\n" * 40_000) + "\U00018eaa's" + "x" * 5000
    want = t.encode(text, add_special_tokens=False).ids
    got = code.encode_batch([text])[0]
    assert got.tolist() == want and code.decode(got) == t.decode(want, skip_special_tokens=False)


def test_unsettled_code_points_are_searched_among_distinct_characters(monkeypatch):
    searched = []

    class Class:
        def search(self, text):
            searched.append(len(text))

    monkeypatch.setattr(bpe, "_unsettled", Class)
    assert len(bpe.words_of("é und noch ein Wort, " * 10_000)) == 60_001 and searched and max(searched) < 20


def test_a_merge_looks_up_its_neighbours_only(both):
    code, t = both
    looked = []

    class Merges(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(200)) for _ in range(20)]
    own, code.merges = code.merges, Merges(code.merges)
    try:
        assert [code.merge(w.encode()) for w in words] == [e.ids for e in t.encode_batch(words, add_special_tokens=False)]
    finally:
        code.merges = own
    assert len(looked) < 3 * 200 * len(words)


def test_query(spark, tmp_path, both):
    _, t = both
    texts = [None, "", "a", "<|endoftext|> x <|endoftext|>", "é中😀՘", " \n\n  ", "same", "same"]
    rows = [(i, x, "clash", "clash") for i, x in enumerate(texts)] + [(None, "no id", "c", "c"), (2, "a", "c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.op3_bpe(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == sorted(want)
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert bpe.op3_bpe(spark, f"{tmp_path}/none").count() == 0
