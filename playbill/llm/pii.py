"""Personal data by weak supervision, as DataFrame plans only.

Patterns propose spans.  Three groups of labelers vote on each: patterns (is the form strict?),
gazetteers (known name, mail ending, prefix or reserved network) and context (which words stand
before it?), +1, 0 or -1.  Expectation-maximisation over the counts of vote patterns, a bounded
table, estimates how far each labeler can be trusted, per kind.  The posterior of every vote
pattern then trains the span classifier: log-odds of the span's own features, summed over the
corpus by one aggregate.  Base spans are rules and always stay; other proposals are added where
the classifier gives them `ACCEPT` or more and no base span overlaps.

Only counts (vote patterns, feature buckets) reach the driver, never spans or texts.

Defined cases: null text counts as empty and has no span; repeated rows and repeated or null ids
each get their own result; without proposals nothing is learned and nothing added; an empty table
gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playbill.llm.common import spans, spell, with_key
from playbill.session import cut

BASE = ["email", "ip", "card", "phone"]

# The four base kinds as defined; the guards and possessive marks only save time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_spelled": r"(?i)\b[a-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,12}\b",
    "phone_local": r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}\b",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
# What a text must hold before a pattern is tried.
NEEDS = {"email": ["@"], "phone": ["+"], "email_spelled": ["dot", "DOT", "Dot"], "ip": ["."], "person": ["Mr", "Ms", "Dr", "Herr", "Frau", "Señor", "M"]}

# Gazetteers and cues, fixed values.
ENDINGS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "se"]
GIVEN = ["anna", "maria", "john", "james", "mary", "peter", "paul", "thomas", "laura", "carlos", "sofia", "hans", "julia", "pierre", "marie", "jose", "david", "sarah", "michael", "emma"]
CUES = {
    "email": "mail|contact|write|correo|courriel|schreib", "ip": r"\bip\b|host|server|address|adresse", "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|call|tel|mobile|fax|ruf|appel|llam",
    "email_spelled": "mail|contact|write|reach|correo|courriel", "phone_local": "phone|call|tel|mobile|fax|ruf|appel|llam", "national_id": r"ssn|social|security|\bid\b", "iban": "iban|account|bank|konto|compte|cuenta", "person": "name|dear|contact|sign|regards",
}
AGAINST = r"version|release|isbn|issn|figure|table|page|chapter|section|order|invoice|item|ticket|part"
LABELERS = ["form", "gazetteer", "context"]
CONTEXT = 32
ROUNDS = 25
ACCEPT = 0.8
SMOOTH = 2.0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    d = _digits(c)
    n = F.length(d)
    value = lambda i: F.ascii(F.substring(d, i, 1)) - 48
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """The checks that a match of a base kind must pass."""
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, r"^0+(?=.)", "")
        return F.forall(F.split(hit, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.lpad(F.substring(part(x), 1, 3), 3, "0") <= "255"))
    if kind == "card":
        n = F.length(_digits(hit))
        return (n >= 13) & (n <= 19) & luhn(hit)
    if kind == "phone":
        n = F.length(_digits(hit))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def proposals(keyed: DataFrame) -> DataFrame:
    """doc_id, _id, _k, base: checked spans of the base kinds; more: other proposals, with context."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>")

    def of(kind: str) -> Column:
        found = spans(text, PATTERNS[kind], CONTEXT)
        if kind in BASE:
            found = F.filter(found, lambda x: valid(kind, x["hit"]))
        if kind in NEEDS:
            held = F.lit(False)
            for need in NEEDS[kind]:
                held = held | F.contains(text, F.lit(need))
            found = F.when(held, found).otherwise(none)
        return F.transform(found, lambda x: F.struct(
            F.lit(list(PATTERNS).index(kind)).alias("ord"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"),
            x["before"].alias("before"), x["after"].alias("after"),
        ))

    return keyed.select("doc_id", "_id", "_k", F.concat(*[of(k) for k in PATTERNS]).alias("found"))


def votes(found: DataFrame) -> DataFrame:
    """The proposals, one row each, with a vote of every labeler and the classifier's features."""
    one = found.select("_id", "_k", F.explode("found").alias("s")).select("_id", "_k", "s.*")
    hit, before, kind = F.lower("hit"), F.lower("before"), F.col("kind")
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    digits = _digits(F.col("hit"))
    form = F.when(kind.isin("card", "iban"), F.when(luhn(F.col("hit")) | (kind == "iban"), 1).otherwise(-1)).when(
        kind.isin("phone_local", "national_id"), sign(~F.rlike(digits, F.lit(r"^(?:000|666|9)|^([0-9])\1+$")), F.lit(True))
    ).when(kind == "ip", sign(F.length("hit") >= 9, F.length("hit") <= 7)).otherwise(sign(F.length("hit").between(8, 60), F.length("hit") > 100))
    gazetteer = F.when(kind.isin("email", "email_spelled"), sign(F.regexp_extract(hit, r"([a-z]+)$", 1).isin(ENDINGS), F.lit(False))).when(
        kind == "ip", sign(F.lit(False), F.rlike(hit, F.lit(r"^(?:0|10|127|255)\.|^192\.168\.")))
    ).when(kind == "person", sign(F.exists(F.split(hit, r"[\s.]+"), lambda w: w.isin(GIVEN)), F.lit(False))).otherwise(0)
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & F.rlike(before, F.lit(words)))
    context = sign(cue, F.rlike(before, F.lit(AGAINST)))
    length = F.least(F.floor(F.length("hit") / 4), F.lit(12)).cast("string")
    shape = lambda c: F.when(c.isNull() | (c == ""), "end").when(F.rlike(c, F.lit(r"\s")), "space").when(F.rlike(c, F.lit("[0-9]")), "digit").when(F.rlike(c, F.lit(r"\p{L}")), "letter").otherwise("mark")
    marked = one.withColumns({"form": form, "gazetteer": gazetteer, "context": context})
    feature = lambda name, c: F.concat_ws("|", kind, F.lit(name), c)
    return marked.withColumn("features", F.array(
        feature("length", length), feature("after", shape(F.col("after"))), feature("left", shape(F.right("before", F.lit(1)))),
        feature("digits", F.least(F.length(digits), F.lit(20)).cast("string")), feature("form", F.col("form").cast("string")),
        feature("gazetteer", F.col("gazetteer").cast("string")), feature("context", F.col("context").cast("string")),
    ))


def estimate(counts: dict[tuple, int]) -> dict[tuple, float]:
    """Posterior of each (kind, votes) by expectation-maximisation over its counts.

    Each labeler has a table of vote shares given truth and given error; it starts from a mild
    trust in its sign.  The shares are smoothed, so a labeler that never votes says nothing.
    """
    posterior = {}
    for kind in sorted({k for k, *_ in counts}):
        rows = {votes: n for (k, *v), n in counts.items() if k == kind for votes in [tuple(v)]}
        start = {True: {1: 0.5, 0: 0.4, -1: 0.1}, False: {1: 0.15, 0: 0.4, -1: 0.45}}
        share, tables = 0.5, [{t: dict(start[t]) for t in (True, False)} for _ in LABELERS]
        belief = {}
        for _ in range(ROUNDS):
            for votes in rows:
                odds = math.log(share / (1 - share)) + sum(math.log(t[True][v] / t[False][v]) for t, v in zip(tables, votes))
                belief[votes] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
            total = sum(rows.values())
            share = min(0.98, max(0.02, (sum(n * belief[v] for v, n in rows.items()) + SMOOTH) / (total + 2 * SMOOTH)))
            for i, t in enumerate(tables):
                for truth, vote in product((True, False), (1, 0, -1)):
                    chance = lambda v: belief[v] if truth else 1 - belief[v]
                    mass = sum(n * chance(v) for v, n in rows.items())
                    t[truth][vote] = (sum(n * chance(v) for v, n in rows.items() if v[i] == vote) + SMOOTH * start[truth][vote] * 10) / (mass + SMOOTH * 10)
        posterior |= {(kind, *v): b for v, b in belief.items()}
    return posterior


def classifier(voted: DataFrame) -> dict[str, float]:
    """Log-odds of every feature bucket, and under `kind` those of the kind itself."""
    counts = {(r["kind"], r["form"], r["gazetteer"], r["context"]): r["n"] for r in voted.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()}  # kinds x 3^labelers at most
    if not counts:
        return {}
    belief = F.create_map(*[x for key, p in estimate(counts).items() for x in (F.lit("|".join(map(str, key))), F.lit(p))])
    soft = voted.withColumn("p", F.element_at(belief, F.concat_ws("|", "kind", *[F.col(c).cast("string") for c in LABELERS])))
    sums = soft.select("p", F.explode(F.concat("features", F.array("kind"))).alias("feature")).groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # feature buckets
    whole = {r["feature"]: (r["yes"] + SMOOTH, r["no"] + SMOOTH) for r in sums if "|" not in r["feature"]}
    weights = {k: math.log(y / n) for k, (y, n) in whole.items()}
    for r in sums:
        if "|" in r["feature"]:
            yes, no = whole[r["feature"].split("|")[0]]
            weights[r["feature"]] = math.log((r["yes"] + SMOOTH) / (yes + SMOOTH)) - math.log((r["no"] + SMOOTH) / (no + SMOOTH))
    return weights


def unopposed(voted: DataFrame, accepted: Column) -> DataFrame:
    """(_id, _k, chosen): of each text the accepted further spans that no base span overlaps.

    Spans of a text meet by start: one overlaps a base span if an earlier one ends behind its start,
    or a later one starts before its end.
    """
    rows = voted.filter(F.col("kind").isin(BASE) | accepted).select("_id", "_k", "ord", "start", "end", "kind", F.col("kind").isin(BASE).alias("own")).dropDuplicates(["_id", "_k", "ord", "start"])
    earlier = Window.partitionBy("_id", "_k").orderBy("start", F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_id", "_k").orderBy(F.desc("start"), F.desc("own")).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumns({"reached": F.max(F.when(F.col("own"), F.col("end"))).over(earlier), "next": F.min(F.when(F.col("own"), F.col("start"))).over(later)})
    free = met.filter(~F.col("own") & (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    return free.groupBy("_id", "_k").agg(F.collect_list(F.struct("ord", "start", "end", "kind")).alias("chosen"))


def detect(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, _id, _k, base, found: base spans, and all spans in the order of the kinds, then start."""
    rows = cut(proposals(with_key(docs).select("doc_id", "_id", "_k", "text")))
    voted = cut(votes(rows))
    weights = classifier(voted)
    base = F.transform(F.filter("found", lambda x: x["kind"].isin(BASE)), lambda x: F.struct(x["ord"].alias("ord"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    rows = rows.select("doc_id", "_id", "_k", base.alias("base"))
    kept = F.col("base")
    if weights:
        table = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(w))])
        weigh = F.aggregate("features", F.coalesce(F.element_at(table, F.col("kind")), F.lit(0.0)), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
        rows = rows.join(unopposed(voted, 1 / (1 + F.exp(-weigh)) >= accept), ["_id", "_k"], "left")
        kept = F.when(F.col("chosen").isNull(), F.col("base")).otherwise(F.concat("base", "chosen"))
    return rows.select("doc_id", "_id", "_k", F.array_sort("base").alias("base"), F.array_sort(kept).alias("found"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")


def report(docs: DataFrame) -> DataFrame:
    return detect(docs).select("doc_id", *[_count(k).alias(f"n_{k}") for k in BASE], F.sha2(spell(F.col("base")).cast("binary"), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"))
