"""Personal data [native]: information-theoretic sanitisation.

Protected entities are the e-mail and IP addresses, card and phone numbers of
the texts. Terms (words of letters) that stand next to an entity can reveal it
as well: a term discloses an entity by their pointwise mutual information over
the entity's information content, ``PMI(c, t) / IC(c)``, which is 1 for a term
that occurs with nothing but the entity and 0 for one that is independent of
it. Document frequencies of entities, pairs and terms are counted over the
whole corpus. A term over the threshold is generalised to its initial where
that, counted the same way, is under it, and removed where not.

DataFrame functions only. Matches get their places from the lengths of what
lies between them, so a text is never cut by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm._io import documents, join_counted, written
from motorspark.llm.line_dedup import LOWER, UPPER

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _NAME = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A run of characters is tried from its beginning only, or from the end of the match before: what fails there fails further on.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
ANY = r"[0-9@]"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}{3,}"
#: Terms on either side of an entity, and code points in which they are looked for.
WINDOW, REACH = 8, 160
#: Different surroundings in which an entity and a term must meet, and the share of its information that the term may give away.
SUPPORT, ALPHA = 3, 0.75
#: As many terms are sent to every task; more are joined by a shuffle.
BROADCAST_TERMS = 50_000
LAST = 2**63 - 1
#: Running sums go in two levels: sums of blocks, and sums inside a block.
STRIDE = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of ints what ``join`` makes of 0 and all elements before it."""
    fold = lambda x: F.aggregate(x, F.lit(0), join)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRIDE).cast("int")), lambda b: fold(F.slice(v, b * STRIDE + 1, F.lit(STRIDE))))
    starts = lambda v: let(blocks(v), lambda s: F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b))))
    inside = lambda v, s: F.transform(
        v, lambda _, i: join(s[F.floor(i / STRIDE).cast("int")], fold(F.slice(v, F.floor(i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE)))
    )
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(starts(v), lambda s: inside(v, s))))


def places(text: Column, pattern: str, reach: int = 0) -> Column:
    """``start``, ``end`` (code points, exclusive) and ``value`` of every match; with ``reach``, so many code points ``before`` and ``after``, up to the next match."""

    def at(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(gaps[i]) + F.length(m))

        def one(starts: Column) -> Column:
            def made(m: Column, i: Column) -> Column:
                start = starts[i] + F.length(gaps[i])
                more = [F.right(gaps[i], F.lit(reach)).alias("before"), F.left(gaps[i + 1], F.lit(reach)).alias("after")] if reach else []
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), *more)

            return F.transform(found, made)

        return let(running(lengths, lambda a, b: a + b), one)

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: at(gaps, found)))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _good(kind: str, value: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return let(F.translate(value, " -", ""), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """What is the same for all spellings of an entity."""
    own = F.translate(value, UPPER, LOWER) if kind == "email" else value if kind == "ip" else F.translate(value, "+ ().-", "")
    return F.concat(F.lit(f"{kind}:"), own)


def base_spans(kind: str, text: Column, reach: int = 0) -> Column:
    """The places of a kind's matches that count, leftmost first and non-overlapping."""
    kept = lambda: F.filter(places(text, PATTERNS[kind], reach), lambda p: _good(kind, p["value"]))
    fields = "start int, `end` int, value string" + ", before string, after string" * bool(reach)
    empty = F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>")
    return F.when(F.coalesce(text.rlike(SIGNS[kind]), F.lit(False)), kept()).otherwise(empty)


def _mentions(docs: DataFrame) -> DataFrame:
    """One row an entity in a text: _doc, _mark, entity, context (a hash of the terms around it) and terms (start, end, term)."""

    def terms(p: Column) -> Column:
        # The window's own places, moved to where it lies in the text.
        moved = lambda part, by: F.transform(places(part, TERM), lambda t: F.struct((t["start"] + by).alias("start"), (t["end"] + by).alias("end"), F.translate(t["value"], UPPER, LOWER).alias("term")))
        left = moved(p["before"], p["start"] - F.length(p["before"]))
        right = moved(p["after"], p["end"])
        return F.concat(let(left, lambda x: F.slice(x, F.greatest(F.size(x) - WINDOW + 1, F.lit(1)), F.lit(WINDOW))), F.slice(right, 1, WINDOW))

    one = lambda kind: lambda p: F.struct(_entity(kind, p["value"]).alias("entity"), terms(p).alias("terms"))
    every = F.concat(*[F.transform(base_spans(k, F.col("text"), REACH), one(k)) for k in KINDS])
    rows = docs.where(F.col("text").rlike(ANY)).select("_doc", "_mark", F.explode(every).alias("m"))
    context = F.xxhash64(F.transform("m.terms", lambda t: t["term"]))
    return rows.select("_doc", "_mark", "m.entity", context.alias("context"), "m.terms")


def disclosures(docs: DataFrame, mentions: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame | None:
    """entity, term, ``disclosure``, ``general`` (whether the term's initial may stay) and ``n`` (rows of the pair); None without candidates."""
    document = F.struct("_doc", "_mark")
    pairs = mentions.select("_doc", "_mark", "entity", "context", F.explode("terms.term").alias("term"))
    met = pairs.groupBy("entity", "term").agg(F.count_distinct(document).alias("both"), F.count_distinct("context").alias("contexts"), F.count(F.lit(1)).alias("n")).where(F.col("contexts") >= support)
    known = mentions.groupBy("entity").agg(F.count_distinct(document).alias("entities"))
    candidates = written(met.join(known, "entity"), "privacy-candidates")
    if candidates.isEmpty():
        return None
    # The term and its initial, which is told from a word by a star.
    initial = lambda w: F.concat(F.left(w, F.lit(1)), F.lit("*"))
    wanted = written(candidates.select(F.explode(F.array("term", initial(F.col("term")))).alias("term")).distinct(), "privacy-terms")
    own = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    words = docs.select(F.explode(let(F.array_distinct(own), lambda w: F.concat(w, F.array_distinct(F.transform(w, initial))))).alias("term"))
    if wanted.count() <= BROADCAST_TERMS:
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("terms"))
    counted = written(counted.join(wanted, "term", "left_semi"), "privacy-counts")
    total = docs.count()
    content = F.lit(total).cast("double") / F.col("entities")
    f = candidates.join(counted, "term").join(counted.select(F.col("term").alias("_initial"), F.col("terms").alias("_more")), initial(F.col("term")) == F.col("_initial"))
    # A text that holds an entity twice counts once, as its terms do; where each holds the entity, nothing is disclosed.
    shown = F.log(F.col("both") * content / F.col("terms")) / F.log(content)
    # The initial stands beside the entity in all its documents at most.
    blurred = F.log(F.lit(total).cast("double") / F.col("_more")) / F.log(content)
    f = f.where(content > 1).select("entity", "term", shown.alias("disclosure"), (blurred < alpha).alias("general"), "n")
    return f.where(F.col("disclosure") >= alpha)


def sanitise(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``pii`` (kind, start, end, label) and ``sanitised``, the text with each span replaced by its label.

    Spans are those of the kinds in KINDS, each leftmost and non-overlapping
    in itself, in this order, and ``term`` after them: terms within WINDOW
    terms of an entity of their text that disclose it by ``alpha`` or more,
    as far as they met it in ``support`` different surroundings. Labels are
    the kind in brackets, and for terms their initial with a point, or
    nothing. Of spans that overlap, the first one's label stands for all.

    A null text is an empty one and has no span. Rows that repeat a doc_id
    are judged each; rows equal in doc_id and text are one document when
    counting. A null doc_id is an id like any other. Other columns stay, but
    for ``pii`` and ``sanitised``. An empty table gives an empty table.
    """
    own = [c for c in docs.columns if c not in ("pii", "sanitised", "text")]
    text = F.coalesce("text", F.lit(""))
    # The caller's columns pass under names that nothing can clash with.
    base = docs.select(*[F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(own)], text.alias("text"), F.coalesce("doc_id", F.lit(LAST)).alias("_doc"), F.xxhash64(text).alias("_mark"))
    keys = base.select("_doc", "_mark", "text")
    mentions = written(_mentions(keys), "privacy-mentions")
    shown = disclosures(keys, mentions, support, alpha)
    span = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("label"))
    first = [F.transform(base_spans(k, F.col("text")), span(k)) for k in KINDS]
    kind = "array<struct<kind:string,start:int,end:int,label:string>>"
    some, rest = base.where(F.col("text").rlike(ANY)), base.where(~F.col("text").rlike(ANY))
    terms = F.array().cast(kind)
    if shown is not None:
        rows = mentions.select("_doc", "_mark", "entity", F.explode("terms").alias("t")).select("_doc", "_mark", "entity", "t.start", "t.end", "t.term")
        shown = written(shown, "privacy-disclosures")
        label = F.when(F.col("general"), F.concat(F.upper(F.left("term", F.lit(1))), F.lit("."))).otherwise("")
        marked = join_counted(rows, shown, ["entity", "term"], "n").groupBy("_doc", "_mark", "start", "end").agg(F.min(label).alias("label"))
        marked = marked.groupBy("_doc", "_mark").agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", "label"))).alias("_terms"))
        some = some.join(written(marked, "privacy-marked"), ["_doc", "_mark"], "left")
        terms = F.coalesce("_terms", terms)
    # A term within an entity is part of it.
    apart = lambda t, spans: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    all_ = let(F.concat(*first).cast(kind), lambda spans: F.concat(spans, F.filter(terms, lambda t: apart(t, spans)))) if shown is not None else F.concat(*first).cast(kind)
    columns = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(own)]
    some = some.select(*columns, "text", all_.alias("pii"))
    some = some.withColumn("sanitised", F.when(F.size("pii") == 0, F.col("text")).otherwise(_replaced(F.col("text"), F.col("pii"))))
    return some.unionByName(rest.select(*columns, "text", F.array().cast(kind).alias("pii"), F.col("text").alias("sanitised")))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its label; overlapping spans are one, with the first one's label."""

    def mended(chars: Column, s: Column, before: Column) -> Column:
        cut = lambda a, b: F.array_join(F.slice(chars, a + 1, F.greatest(b - a, F.lit(0))), "")
        parts = F.transform(s, lambda x, i: F.when(x["start"] >= before[i], F.concat(cut(before[i], x["start"]), x["label"])).otherwise(""))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), cut(last, F.size(chars)))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label"))))
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return let(ordered, lambda s: let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda before: let(chars, lambda c: mended(c, s, before))))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the personal data in every document; odd rows as in ``sanitise``."""
    found = sanitise(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
