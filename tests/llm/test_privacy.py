"""Personal data against a plain version: base spans by ``re``, disclosures by counting in Python."""

import hashlib
import math
import random
import re
import time

import pytest

from motorspark.llm import privacy as P

SCHEMA = "doc_id long, text string, pii string, sanitised string, _mark string"
LOWER = {i: i + 32 for i in range(65, 91)}
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def good(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    return {"email": True, "ip": all(int(x) <= 255 for x in value.split(".")) if kind == "ip" else None, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k in P.KINDS for m in re.finditer(BASE[k], text or "") if good(k, m[0])]


def entity(kind, value):
    return f"{kind}:{value.translate(LOWER) if kind == 'email' else value if kind == 'ip' else re.sub('[^0-9]', '', value)}"


def terms(text):
    """Words of three letters or more, as (start, end, word)."""
    out, start = [], None
    for i, c in enumerate(text + " "):
        if c.isalpha():
            start = i if start is None else start
        elif start is not None:
            if i - start >= 3:
                out.append((start, i, text[start:i].translate(LOWER)))
            start = None
    return out


def plain(rows, support=P.SUPPORT, alpha=P.ALPHA):
    """Spans of every row with their labels."""
    both, contexts, known, freq, mentions, docs = {}, {}, {}, {}, [], [(i, t or "") for i, t in rows]
    for n, (i, text) in enumerate(docs):
        own = {w for _, _, w in terms(text)}
        for w in own | {w[0] + "*" for w in own}:
            freq[w] = freq.get(w, 0) + 1
        for kind in P.KINDS:
            every = [m.span() for m in re.finditer(BASE[kind], text)]
            edges = [0, *(e for span in every for e in span), len(text)]
            for k, (a, b) in enumerate(every):
                if not good(kind, text[a:b]):
                    continue
                low, high = max(edges[2 * k], a - P.REACH), min(edges[2 * k + 3], b + P.REACH)
                near = [(s + low, e + low, w) for s, e, w in terms(text[low:a])][-P.WINDOW :] + [(s + b, e + b, w) for s, e, w in terms(text[b:high])][: P.WINDOW]
                c = entity(kind, text[a:b])
                known.setdefault(c, set()).add((i, text))
                mentions.append((n, c, near))
                for _, _, w in near:
                    both.setdefault((c, w), set()).add((i, text))
                    contexts.setdefault((c, w), set()).add(tuple(x[2] for x in near))
    shown = {}
    for (c, w), met in both.items():
        content = len(docs) / len(known[c])
        if len(contexts[c, w]) >= support and content > 1 and math.log(len(met) * content / freq[w]) / math.log(content) >= alpha:
            shown[c, w] = w[0].upper() + "." if math.log(len(docs) / freq[w[0] + "*"]) / math.log(content) < alpha else ""
    out = []
    for n, (i, text) in enumerate(docs):
        own = [(k, a, b, f"[{k.upper()}]") for k, a, b, _ in base(text)]
        more = {}
        for m, c, near in mentions:
            for a, b, w in near if m == n else []:
                if (c, w) in shown and not any(x < b and a < y for _, x, y, _ in own):
                    more[a, b] = min(more.get((a, b), "~"), shown[c, w])
        out.append((i, text, own + [("term", a, b, label) for (a, b), label in sorted(more.items())]))
    return out


def mended(text, spans):
    out, at = "", 0
    for a, b, label in sorted(s[1:] for s in spans):
        if a >= at:
            out += text[at:a] + label
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    filler = ["the", "market", "Éclair", "opens", "中文字", "today", "with", "new", "fruit", "and", "bread", "ab", "x"]
    bits = ["a@b.co", "A@b.c_d@e.f", "x.y@@z.com", "joe@x..com", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "4111111111111112", "+1 (743) 555-3824", "+12", "+1 234567 8", "+49.30-1234567890123456", "12 34 1.2.3.4 5", "+1 555 123 4567.joe@x.com", "😀+4 (0) 12345678", "9@9.9", "@", "-._%+-@a-.-b"]
    make = lambda n: " ".join(r.choice(filler) if r.random() < 0.8 else r.choice(bits) + r.choice(["", ".", ",", "\n", "é"]) for _ in range(n))
    out = [(i, make(r.choice([0, 1, 5, 40, 200]))) for i in range(150)]
    out += [(200, None), (201, ""), (202, "+"), (None, "null id a@b.co 1.2.3.4"), out[3], out[3], (203, "".join(r.choice("0123456789.+-@ ()ab") for _ in range(3000)))]
    # A person next to an address in many texts, and nowhere else; one of common words next to another.
    words = ["market", "opens", "today", "with", "new", "fruit", "and", "bread", "the"]
    for i in range(12):
        out.append((300 + i, f"{' '.join(r.sample(words, 6))} ask Zebulon Quist at zq.77@corp.example {' '.join(r.sample(words, 6))}. Zebulon is far."))
    out += [(400 + i, f"{' '.join(r.sample(words, 5))} ask Zoe Zimmer Zander Zapf of the market {i}") for i in range(30)]
    return out + [(500 + i, out[-40][1]) for i in range(3)]


def test_every_span_against_a_plain_version(spark, rows):
    docs = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in rows], SCHEMA)
    found = P.sanitise(docs)
    assert sorted(found.columns) == ["_mark", "doc_id", "pii", "sanitised", "text"]
    got = sorted(str((r["doc_id"], r["text"], [tuple(s) for s in r["pii"]], r["sanitised"])) for r in found.collect())
    want = plain(rows)
    assert got == sorted(str((i, t, s, mended(t, s))) for i, t, s in want)
    labels = {t[a:b]: label for _, t, s in want for k, a, b, label in s if k == "term"}
    assert labels["Zebulon"] == "Z." and labels["Quist"] == "" and not {"market", "opens", "the"} & set(labels)


def test_query(spark, rows, tmp_path):
    spark.createDataFrame([x for x in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text, spans in plain(rows):
        own = [s for s in spans if s[0] != "term"]
        joined = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in x)
        want.append(str((i, *(sum(s[0] == k for s in own) for k in P.KINDS), hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans))))
    assert sorted(str(tuple(r)) for r in P.op11_pii(spark, str(tmp_path)).collect()) == sorted(want)


def test_other_thresholds_and_the_shuffled_count(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_TERMS", 0)
    docs = spark.createDataFrame([(*x, None, None, None) for x in rows], SCHEMA)
    got = sorted(str((r["doc_id"], [tuple(s) for s in r["pii"]])) for r in P.sanitise(docs, 2, 0.3).select("doc_id", "pii").collect())
    assert got == sorted(str((i, s)) for i, _, s in plain(rows, 2, 0.3))


def test_long_runs_and_many_spans(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "a@" + "b." * 300_000 + "c", "a." * 400_000 + "@", "1.1." * 200_000, "+1" + " " * 500_000, "x@y.zz " * 20_000, "1 " * 300_000, "+1-" * 200_000]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    began = time.time()
    got = {r["doc_id"]: [tuple(s)[:3] for s in r["pii"]] for r in P.sanitise(docs).select("doc_id", "pii").collect()}
    assert time.time() - began < 200
    assert {i: len(s) for i, s in got.items()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 100_000, 5: 0, 6: 20_000, 7: 0, 8: 0}
    assert got[2][0] == ("email", 0, len(texts[2])) and got[6][-1] == ("email", 139_993, 139_999)


def test_empty_table(spark):
    assert P.sanitise(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_on_the_way(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = P.op11_pii(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
