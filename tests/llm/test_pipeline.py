"""Every stage of the pipeline against brute force, on a table whose columns clash with the operators' own."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from motorspark.llm import langid, packing, toxicity

DDL = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, kept string, rejected string, "
    "lang_pred string, n_lines string, n_dropped string, fp string, component_id string, _gone string, tail string, ids string"
)
LOWER = {i: i + 32 for i in range(65, 91)}
EXTRA = tuple(f"own {i}" for i in range(12))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    path = str(tmp_path_factory.mktemp("pipeline"))
    word = lambda parts: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    kinds = {"aa": ["ba", "ko", "ti", "mu"], "bb": ["sch", "ung", "ei", "ver"]}
    rows, labels = [], []
    for i in range(240):
        lang = "aa" if i % 3 else "bb"
        words = [word(kinds[lang]) for _ in range(r.randint(30, 90))]
        if i % 4 == 1:
            words[r.randrange(len(words))] = r.choice(["vilexx", "nastyy"])
        text = " ".join(words)
        if i % 10 == 0:
            text += "\nA line that MANY documents hold "
        rows.append([i, text, lang])
        labels.append((i, 1, int(i % 4 == 1)))
    for i in range(30):  # near copies: one word of about sixty is another
        words = rows[3 * i][1].split(" ")
        words[i % len(words)] = "changed"
        rows.append([300 + i, " ".join(words), rows[3 * i][2]])
    rows += [[400, None, None], [401, "", None], [402, "12 .. 34", None], [403, "short one", None], [404, "short one", None], [405, "short one", "aa"], [406, "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(400)), None]]
    rows += [[None, rows[6][1], "aa"], list(rows[8]), list(rows[8])]
    rows = [(i, t, g, "s", len(t) if t is not None else None, *EXTRA) for i, t, g in rows]
    spark.createDataFrame(rows, DDL).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def as_list(df):
    assert df.columns == [c.split()[0] for c in DDL.split(", ")]
    rows = [tuple(r) for r in df.collect()]
    assert all(r[5:] == EXTRA for r in rows)
    return sorted(((str(r[0]), str(r[1]), str(r[2]), r[4]) for r in rows), key=str)


def plain(rows):
    return sorted(((str(i), str(t), str(g), n) for i, t, g, n in rows), key=str)


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_stages_equal_brute_force(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "line_dedup", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in docs.collect()]

    # Toxicity: every text alone, by the same weights.
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    net = toxicity.train(docs.where(toxicity.fold(4) != 2), labels.where(toxicity.fold(4) != 2))
    score = lambda t: toxicity.Scorer(net).scores([t or ""])[0]
    want = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(want) < len(rows) / 2
    docs = stages["toxicity"](spark, docs, folder)
    assert as_list(docs) == plain(want)

    # Language.
    model = langid.train(docs.where(langid.fold(5) != 0))
    good = []
    for r in want:
        h, n = langid.entropies(model, [r[1] or ""])
        if n[0] and h[0].min() <= model.limit[h[0].argmin(), min(int(n[0]).bit_length(), langid.LEVELS) - 1]:
            good.append(r)
    gone = {r[0] for r in want} - {r[0] for r in good}
    assert {400, 401, 402, 406} <= gone
    docs = stages["language_id"](spark, docs, folder)
    assert as_list(docs) == plain(good)

    # Lines.
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    number = lambda i: 2**63 - 1 if i is None else i
    holders = {}
    for i, t, _, _ in good:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(number(i))
    lines = []
    for i, t, g, _ in good:
        text = "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == number(i))
        lines.append((i, text, g, len(text)))
    assert any(a[1] != b[1] for a, b in zip(good, lines))
    docs = stages["line_dedup"](spark, docs, folder)
    assert as_list(docs) == plain(lines)

    # Near-duplicates: all pairs.
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        five = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        three = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in three]
        return five, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    made = [sets(t) for _, t, _, _ in lines]
    parent = list(range(len(lines)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(lines)), 2):
        (x, p), (y, q) = made[a], made[b]
        if (p ^ q).bit_count() <= 2 or (x and y and len(x & y) / len(x | y) >= 0.8) or (lines[a][0] is not None and lines[a][0] == lines[b][0]):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(lines):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = [r for k, r in enumerate(lines) if least.get(find(k)) == r[0]]
    assert len(want) < len(lines) - 15
    docs = stages["near_duplicates"](spark, docs, folder)
    assert as_list(docs) == plain(want)

    # Packing: every id of every document once, no gap, no window too full.
    pieces = stages["packing"](spark, docs, folder).collect()
    enc = packing.tokenizer(packing.default_ranks(), "<|endoftext|>", 50256)
    tokens = {}
    for i, t, _, _ in want:
        tokens[i] = tokens.get(i, 0) + len(enc.encode_ordinary(t)) + 1
    found = {}
    for p in pieces:
        found[p["doc_id"]] = found.get(p["doc_id"], 0) + p["length"]
    assert found == tokens
    fill = {}
    for p in pieces:
        fill.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() == [o for o, _ in sorted(v)] for v in fill.values())
    assert len(fill) == -(-sum(tokens.values()) // packing.WINDOW)


def test_run_equals_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
