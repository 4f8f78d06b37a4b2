"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

The protected entities are of five kinds, found by pattern: email, ip, card, phone (the base),
and secret (a quoted value of 16 signs or more, letters and digits, that something is set to).
A term is a run of two or more letters, digits or _, lower-cased. It is near an entity
if it stands whole within CONTEXT code points before or after it, on any line, and no other match of
the kind's pattern lies between or covers it. Over the corpus

    p(kind) = documents with the kind / documents
    p(kind | term) = (documents with the term near the kind + p(kind)) / (documents with the term + 1)
    disclosure = PMI(term; kind) / IC(kind) = log2(p(kind | term) / p(kind)) / -log2 p(kind)

so disclosure is near 1 for terms that are hardly seen elsewhere, 0 for those that tell nothing.
A term that happens to stand near an entity has told nothing yet: with

    q(kind) = (document, term) pairs near the kind / all (document, term) pairs
    evidence = all * KL(both / all || q(kind)), for both / all over q(kind)

exp(-evidence) bounds the chance that a term placed without regard to entities comes that near that often (Chernoff).
Only terms whose evidence exceeds log(terms / CHANCE) count, so in the whole vocabulary fewer than CHANCE terms
are expected by mere chance. No least count is set: what it takes follows from the corpus. Occurrences near an entity
of such terms at or over `remove` are removed, those at or over `generalise` are replaced by a general word.

Places come from running sums over the pieces between matches, in rows, so long texts with many
matches cost no more than their length; rows are told apart by a row id of the stored table.

Defined cases: null and empty texts have no spans; identifiers that fail their check (parts of
an ip over 255, digits, Luhn) are dropped and not looked for again in the same place; spans may
overlap between kinds; a kind that all documents have tells nothing; repeated rows count and get
equal results; null ids are rows of their own; other columns are kept by sanitize and ignored by find.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunledger.llm.common import materialize

#: The identifiers' patterns. Possessive, and started only where a run starts or
#: the match before ended, they find what the plain forms find, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: An entity that is protected, but not of the base.
SECRET = r"""(?<=[=:] ?["'])[A-Za-z0-9+/_-]{16,}+(?=["'])"""
#: A cheap test without which no match can be.
GATES = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}
TERM = r"[\p{L}\p{N}_]{2,}"
CONTEXT = 64
REMOVE, GENERALISE = 0.9, 0.75
#: Terms of a whole vocabulary that may pass for telling by chance, for each kind.
CHANCE = 0.05
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "generalised": "[TERM]", "removed": ""}
SPANS = "array<struct<kind:string,start:int,end:int>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, its digits added."""
    back = F.split(F.reverse(digits), "")
    value = F.transform(back, lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(F.filter(value, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _fine(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(x, r"\."), lambda p: part(p) & (F.when(part(p), F.regexp_replace(p, "^0+(?=.)", "").cast("int")).otherwise(256) <= 255))
    if kind == "card":
        return _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "secret":
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    return F.lit(True)


def _check(kind: str):
    return lambda m: F.coalesce(_fine(kind, m), F.lit(False))


def _piece(kind: str):
    """Of a piece of text and the match after it: what places and contexts need."""

    def item(x: Column, i: Column) -> Column:
        piece, match = x["piece"], x["match"]
        ends = [F.substring(piece, 1, CONTEXT).alias("head"), F.substring(piece, -CONTEXT, CONTEXT).alias("before")]
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(piece).alias("n"), *ends, match.alias("match"), (match.isNotNull() & F.coalesce(_fine(kind, match), F.lit(False))).alias("fine"))

    return item


def _kinds() -> dict[str, str]:
    return {**PATTERNS, "secret": SECRET}


def kinds_of(text: Column) -> Column:
    """The kinds of entities that a text has."""
    some = []
    for kind, pattern in _kinds().items():
        gate = text.rlike(pattern) if GATES[kind] is None else text.contains(GATES[kind]) & text.rlike(pattern)
        some.append(F.when(gate & F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _check(kind)), kind))
    return F.array_compact(F.array(*some))


def prepared(documents: DataFrame) -> DataFrame:
    """documents, stored, with a row id and the kinds of entities of each row."""
    text = F.coalesce("text", F.lit(""))
    return materialize(documents.withColumns({"__rid": F.monotonically_increasing_id(), "__kinds": kinds_of(text)}), "pii-rows")


def entities(rows: DataFrame) -> DataFrame:
    """rid, kind, start, end (code points, end exclusive), and the text before and after, of each entity of prepared rows."""
    text = F.coalesce("text", F.lit(""))
    parts = []
    for kind, pattern in _kinds().items():
        both = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
        parts.append(F.when(F.array_contains("__kinds", kind), F.transform(both, _piece(kind))).otherwise(F.array()))
    pieces = rows.filter(F.size("__kinds") > 0).select(F.col("__rid").alias("rid"), F.inline(F.concat(*parts)))
    in_order = Window.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("n") + F.coalesce(F.length("match"), F.lit(0))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    placed = pieces.withColumns({"stop": end, "after": F.lead("head").over(in_order)}).filter("fine")
    return placed.select("rid", "kind", (F.col("stop") - F.length("match")).cast("int").alias("start"), F.col("stop").cast("int").alias("end"), "before", "after")


def _terms(snippet: Column, start: Column, cut_first: Column, cut_last: Column) -> Column:
    """Terms (lower-cased) of a snippet of at most CONTEXT code points and their places; the first or last may be cut off and is left out."""
    both = F.arrays_zip(F.split(snippet, TERM, -1).alias("piece"), F.regexp_extract_all(snippet, F.lit(TERM), F.lit(0)).alias("match"))
    first = F.struct(start.alias("at"), F.array().cast("array<struct<term:string,start:int,end:int>>").alias("found"))

    def step(a: Column, x: Column) -> Column:  # at most CONTEXT / 2 steps
        lo = a["at"] + F.length(x["piece"])
        hi = lo + F.length(x["match"])
        whole = ~(cut_first & (lo == start)) & ~(cut_last & (hi == start + F.length(snippet)))
        one = F.struct(F.lower(x["match"]).alias("term"), lo.alias("start"), hi.alias("end"))
        return F.struct(F.coalesce(hi, a["at"]).alias("at"), F.when(x["match"].isNotNull() & whole, F.concat(a["found"], F.array(one))).otherwise(a["found"]).alias("found"))

    return F.aggregate(both, first, step, lambda a: a["found"])


def near_terms(found: DataFrame) -> DataFrame:
    """rid, kind, term, start, end of each term near an entity."""
    full = lambda c: F.length(c) == CONTEXT
    before = _terms(F.col("before"), F.col("start") - F.length("before"), full("before"), F.lit(False))
    after = _terms(F.col("after"), F.col("end"), F.lit(False), full("after"))
    return found.select("rid", "kind", F.inline(F.concat(before, after)))


def disclosure(rows: DataFrame, near: DataFrame) -> DataFrame:
    """term, kind, disclosure and by_chance (whether its place may be chance) of each term that stands near the kind, over all prepared rows."""
    together = near.select("rid", "kind", "term").distinct().groupBy("term", "kind").agg(F.count("*").alias("both"))
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("all"))
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("__kinds", k)).alias(k) for k in _kinds()]).first()
    words = materialize(words, "pii-terms")
    size = words.agg(F.count("*").alias("terms"), F.sum("all").alias("pairs")).first()
    near_pairs = {r["kind"]: r["n"] for r in together.groupBy("kind").agg(F.sum("both").alias("n")).collect()}  # one row for each kind
    chance = F.create_map(*[F.lit(x) for k in _kinds() for x in (k, near_pairs.get(k, 0) / max(1, size["pairs"] or 0))])
    share = F.create_map(*[F.lit(x) for k in _kinds() for x in (k, counts[k] / max(1, counts["n"]))])  # one entry for each kind
    p = F.element_at(share, F.col("kind"))
    told = together.join(words, "term").withColumn("p", p).filter((F.col("p") > 0) & (F.col("p") < 1))
    q, rate = F.element_at(chance, F.col("kind")), F.col("both") / F.col("all")
    kl = rate * F.log(rate / q) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - q))).otherwise(0.0)
    evidence = F.when((rate > q) & (q > 0), F.col("all") * kl).otherwise(0.0)
    by_chance = evidence <= math.log(max(1, size["terms"]) / CHANCE)
    return told.select("term", "kind", by_chance.alias("by_chance"), (-F.log2((F.col("both") + F.col("p")) / (F.col("all") + 1) / F.col("p")) / F.log2("p")).alias("disclosure"))


def spans_of(rows: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """rid, base and added (arrays of kind, start, end; added: secret, removed, generalised) of the prepared rows that have any."""
    found = materialize(entities(rows), "pii-entities")
    near = materialize(near_terms(found), "pii-near")
    told = disclosure(rows, near).filter(~F.col("by_chance") & (F.col("disclosure") >= generalise))
    acted = near.join(told, ["term", "kind"]).groupBy("rid", "start", "end").agg(F.max("disclosure").alias("most"))
    acted = acted.select("rid", F.when(F.col("most") >= remove, "removed").otherwise("generalised").alias("kind"), "start", "end")
    every = found.select("rid", "kind", "start", "end").unionByName(acted)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(LABELS) for x in (k, i)])
    item = F.struct(F.element_at(number, F.col("kind")).alias("nr"), "start", "end", "kind")
    lists = every.groupBy("rid").agg(F.array_sort(F.collect_list(item)).alias("all"))  # as many as the text has
    part = lambda base: F.transform(F.filter("all", lambda x: (x["nr"] < len(PATTERNS)) == F.lit(base)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return lists.select("rid", part(True).alias("base"), part(False).alias("added"))


def find(documents: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, base (array of kind, start, end) and added (the same, kinds secret, removed and generalised) of each row."""
    rows = prepared(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    empty = F.array().cast(SPANS)
    out = rows.select("doc_id", F.col("__rid").alias("rid")).join(spans_of(rows, remove, generalise), "rid", "left")
    return out.select("doc_id", F.coalesce("base", empty).alias("base"), F.coalesce("added", empty).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _equals(value: str):
    return lambda x: x == value


def digest(found: DataFrame) -> DataFrame:
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))


def sanitize(documents: DataFrame, **limits: float) -> DataFrame:
    """documents with each span of text replaced by its label (removed terms: by nothing); of overlapping spans the first counts."""
    rows = prepared(documents)
    at = F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = spans_of(rows, **limits).select(F.col("rid").alias("__rid"), F.explode(at).alias("x")).select("__rid", "x.*")
    label = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)])
    before = Window.partitionBy("__rid").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    # what an earlier span covers is left out of a later one
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).filter("start = from")
    spans = spans.withColumn("next", F.lead("start").over(Window.partitionBy("__rid").orderBy("start")))
    lists = spans.groupBy("__rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "next", "kind"))).alias("__spans"))
    text = F.col("text")
    rest = lambda x: F.substring(text, x["end"] + 1, F.coalesce(x["next"], F.length(text)) - x["end"])
    clean = F.concat(F.substring(text, F.lit(1), F.get("__spans", 0)["start"]), F.array_join(F.transform("__spans", lambda x: F.concat(F.element_at(label, x["kind"]), rest(x))), ""))
    joined = rows.join(lists, "__rid", "left")
    return joined.select(*[F.when(text.isNotNull() & (F.size("__spans") > 0), clean).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])
