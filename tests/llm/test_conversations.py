"""Conversation repair against an exhaustive search, and the damage against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from motorspark.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, audit string, present_ string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")
PATTERN = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = BLANK.findall(text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """cost, audit and repaired rows by trying every edit of every row, with up to two rows put in before each and at the end."""
    found, best = faults(rows), None
    puts = [[], *([r] for r in ("user", "assistant")), *map(list, product(("user", "assistant"), repeat=2))]
    per = []
    for (role, text), fault in zip(rows, found, strict=True):
        stays = 5 * (fault == "truncated")
        edits = [("D", 2, [])]
        if fault not in ("blank", "duplicate"):
            edits += [("K", stays, [(role, text)])] + [("R", 1 + stays, [(r, text)]) for r in ("user", "assistant")]
        per.append([("I" * len(p) + e, 5 * len(p) + c, [(r, "") for r in p] + out) for p in puts for e, c, out in edits])
    per.append([("I" * len(p), 5 * len(p), [(r, "") for r in p]) for p in puts])
    # States after each row: the initials so far, which must begin some word of the pattern.
    states = {"": (0, "", [])}
    for choices in per:
        after = {}
        for word, (cost, audit, out) in states.items():
            for letters, more, rows_ in choices:
                initials = word + "".join(r[:1] or "-" for r, _ in rows_)
                if not re.fullmatch(r"(s?(ua)*u?)?", initials):
                    continue
                new = (cost + more, audit + letters, out + rows_)
                if initials not in after or new[:2] < after[initials][:2]:
                    after[initials] = new
        states = after
    best = min((v for w, v in states.items() if PATTERN.fullmatch(w) and w != "s"), key=lambda v: v[:2])
    return best


def damaged(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        own = convs.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in convs.items()}


def expected(rows):
    out = {}
    for conv_id, own in damaged(rows).items():
        turns = {t for t, _, _ in own if t is not None}
        pairs = [(r, t) for _, r, t in own]
        found = faults(pairs)
        cost, audit, fixed = plain(pairs) if pairs else (0, "", [])
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv_id] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_rows(seed, convs=60):
    r, rows = random.Random(seed), []
    for c in range(convs):
        for turn in range(r.randint(1, 7)):
            at = None if r.random() < 0.05 else turn + r.choice([0, 0, 0, 2])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "USER"])
            rows.append((c, at, role, r.choice(["Hello there.", "What?", "No end", "", " \t\n", None, "é中😀!", "Yes. ", f"text {r.random()}."])))
    rows += [(None, 0, "user", "A null id."), (None, 1, "assistant", "Yes!"), (10**17 + 1, -(2**40), "user", "Far."), (10**17 + 1, 2**40, "assistant", "Away.")]
    return rows + rows[5:9]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_conversation_against_an_exhaustive_search(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in C.repair(C.damage(df)).collect()}
    assert got == expected(rows)


def test_without_damage_and_present(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A."), (2, 0, "assistant", "Lone."), (3, 0, "user", "Gone."), (4, 5, "system", "Only.")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).withColumn("present", F.col("conv_id") != 3)
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in C.repair(df).collect()}
    assert got == {1: (0, "KKK"), 2: (2, "D"), 3: (0, ""), 4: (2, "D")}
    none = hashlib.sha256(b"").hexdigest()
    assert {r["conv_id"]: r["repaired_sha256"] for r in C.repair(df).collect() if r["conv_id"] > 2} == {3: none, 4: none}


def test_turns_are_those_of_the_digest(spark, monkeypatch):
    rows = random_rows(3)
    df = C.damage(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))
    turns = {}
    for r in C.repaired_turns(df).orderBy("conv_id", "position").collect():
        assert r["position"] == len(turns.setdefault(r["conv_id"], [])) and r["edit"] in "KRI"
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in C.repair(df).collect():
        assert hashlib.sha256("\n".join(turns.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_long_conversations_spill(spark):
    n = 3 * C.POINTERS + 17
    own = spark.range(n).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("Turn "), F.col("id").cast("string"), F.when(F.col("id") % 1000 == 999, "").otherwise(".")).alias("text"),
    )
    row = C.repair(own).first()
    assert row["truncated"] == n // 1000 and len(row["audit"].replace("I", "")) == n and row["gaps"] == 0
    # Costs alone, by states 0 (nothing yet or an answer) and 1 (a question); rows put in first.
    cost = [0, 5]
    for i in range(n):
        stays = 5 * (i % 1000 == 999)
        kept = [(1, 0), (0, 1)] if i % 2 == 0 else [(1, 1), (0, 0)]
        ways = {0: [cost[0] + 2], 1: [cost[1] + 2]}
        for at, reroled in kept:
            ways[1 - at].append(cost[at] + stays + reroled)
        cost = [min(ways[0]), min(ways[1])]
        cost = [min(cost[0], cost[1] + 5), min(cost[1], cost[0] + 5)]
    assert row["cost"] == cost[0]
    turns = C.repaired_turns(own).orderBy("position").collect()
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == row["repaired_sha256"] and len(turns) == row["audit"].count("K") + row["audit"].count("R") + row["audit"].count("I")


def test_empty_table_and_very_long_text(spark):
    assert C.repair(C.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * 1_500_000 + f"{i}.") for i in range(4)]
    got = {r[0]: tuple(r[1:]) for r in C.repair(C.damage(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))).collect()}
    assert got == expected(rows)
