"""Secret scans through an inverted index of trigrams, as DataFrame plans only.

Each rule's pattern is read once and turned into a Boolean query: alternatives of trigrams that
every match must hold.  The index lists, for each trigram that some query names, the documents
whose lower-cased text holds it.  Intersected postings give the candidates of a rule; their
texts are joined back and verified by the pattern itself.  Rules without a mandatory trigram
are run over every text.

Defined cases: null text counts as empty and has no span; repeated rows and repeated or null ids
each get their own result; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from itertools import product
from re import _parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.common import bound, carried, running, spans, spell, with_key
from playbill.session import cut


class Rule(NamedTuple):
    kind: str
    pattern: str  # for Java and for the query reader
    keep: tuple[int, int] | None = None  # (group, least length), checked on the match itself
    base: bool = False


# The three base kinds as defined, then well-known published credential formats.
# A run of a single class with a least length is written into the pattern, which gives the same matches.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 6), True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", None, True),
    Rule("hex", r"[0-9a-f]{24,}", None, True),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
]


BLOCK = 4_096  # characters of a text that are counted at once
FEW = 16  # exact strings kept together before they become trigrams


def _least(query: list[frozenset[str]]) -> list[frozenset[str]]:
    """Without alternatives that another one already covers."""
    return [q for q in dict.fromkeys(query) if not any(o < q for o in query)]


def _both(left: list[frozenset[str]], right: list[frozenset[str]]) -> list[frozenset[str]]:
    return _least([a | b for a, b in product(left, right)])


def _grams(strings: set[str]) -> list[frozenset[str]]:
    return _least([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])


def _strings(op: str, arg) -> set[str] | None:
    """The few exact strings that an item stands for, lower-cased."""
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and len(arg) <= 5 and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op == "SUBPATTERN":
        return _joined(arg[3])
    if op == "BRANCH":
        parts = [_joined(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and tuple(arg[:2]) == (0, 1) and (once := _joined(arg[2])) is not None:
        return once | {""}
    return None


def _joined(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        part = _strings(str(op), arg)
        if part is None or len(out) * len(part) > FEW:
            return None
        out = {a + b for a, b in product(out, part)}
    return out


def _query(items) -> list[frozenset[str]]:
    query, run = [frozenset()], {""}
    for op, arg in items:
        name = str(op)
        exact = _strings(name, arg)
        if exact is not None and len(run) * len(exact) <= FEW:
            run = {a + b for a, b in product(run, exact)}
            continue
        query, run = _both(query, _grams(run)), exact or {""}
        if exact is None:
            if name == "SUBPATTERN":
                query = _both(query, _query(arg[3]))
            elif name == "BRANCH":
                query = _both(query, _least([q for p in arg[1] for q in _query(p)]))
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                query = _both(query, _query(arg[2]))
    return _both(query, _grams(run))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, one of which every match holds whole; empty if nothing is mandatory."""
    query = _query(_parser.parse(pattern))
    return [] if frozenset() in query else query


def postings(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(gram, _id, _k): the inverted index over the trigrams that the rules' queries name."""
    grams = sorted({g for r in rules for q in trigram_query(r.pattern) for g in q})
    low = docs.select("_id", "_k", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    return low.select("_id", "_k", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(_id, _k, kinds): documents in the intersected postings of each rule's alternatives."""
    terms = [(r.kind, i, len(q), g) for r in rules for i, q in enumerate(trigram_query(r.pattern)) for g in sorted(q)]
    asked = index.sparkSession.createDataFrame(terms, "kind string, alt int, n int, gram string")  # as long as the rules
    met = index.distinct().join(F.broadcast(asked), "gram").groupBy("_id", "_k", "kind", "alt").agg(F.count("*").alias("met"), F.first("n").alias("n"))
    return met.filter("met = n").groupBy("_id", "_k").agg(F.collect_set("kind").alias("kinds"))


def _found(text: Column, rule: Rule, order: int) -> Column:
    found = spans(text, rule.pattern)
    if rule.keep:
        group, least = rule.keep
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["hit"], rule.pattern, group)) >= least)
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, _id, _k, found: spans of every document, by start, then by the rules' order."""
    keyed = with_key(docs).select("doc_id", "_id", "_k", "text")
    text = F.coalesce("text", F.lit(""))
    index = cut(postings(keyed, rules))
    asked = candidates(index, rules)
    by_index = [(i, r) for i, r in enumerate(rules) if trigram_query(r.pattern)]
    in_full = [(i, r) for i, r in enumerate(rules) if not trigram_query(r.pattern)]
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    verified = (
        keyed.join(asked, ["_id", "_k"])
        .select("_id", "_k", F.concat(none, *[F.when(F.array_contains("kinds", r.kind), _found(text, r, i)).otherwise(none) for i, r in by_index]).alias("part"))
        .filter(F.size("part") > 0).groupBy("_id", "_k").agg(F.first("part").alias("part"))  # repeated rows have the same spans
    )
    whole = keyed.select("doc_id", "_id", "_k", F.concat(none, *[_found(text, r, i) for i, r in in_full]).alias("own"))
    return whole.join(verified, ["_id", "_k"], "left").select("doc_id", "_id", "_k", F.array_sort(F.concat("own", F.coalesce("part", none))).alias("found"))


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")


def report(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    base = [r.kind for r in rules if r.base]
    own = F.filter("found", lambda x: x["kind"].isin(base))
    return scan(docs, rules).select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in base],
        F.sha2(spell(own).cast("binary"), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"),
    )


def _replaced(text: Column, found: Column) -> Column:
    """The text with each group of overlapping spans, sorted by start, replaced by the kind of its first.

    Texts are cut into blocks, so a piece far inside is found without counting from the start.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK)), lambda k: F.substring(text, (k * BLOCK + 1).cast("int"), F.lit(BLOCK)))

    def piece(cut_up: Column, lo: Column, hi: Column) -> Column:
        part = lambda k: F.substring(F.get(cut_up, k.cast("int")), (F.greatest(lo - k * BLOCK, F.lit(0)) + 1).cast("int"), (hi - F.greatest(lo, k * BLOCK)).cast("int"))
        return F.when(hi <= lo, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.floor(lo / BLOCK), F.floor((hi - 1) / BLOCK)), part), ""))

    def joined(cut_up: Column, upto: Column) -> Column:
        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0).cast("bigint"))
        first = F.filter(F.transform(found, lambda x, i: F.struct(before(i).alias("lo"), x["start"].alias("hi"), x["kind"].alias("kind"))), lambda x: x["hi"] >= x["lo"])
        shown = F.transform(first, lambda x: F.concat(piece(cut_up, x["lo"], x["hi"]), F.lit("<"), x["kind"], F.lit(">")))
        return F.concat(F.array_join(shown, ""), piece(cut_up, F.element_at(upto, -1), F.length(text).cast("bigint")))

    reached = running(F.transform(found, lambda x: x["end"]), F.greatest)
    return bound(F.struct(blocks.alias("b"), reached.alias("u")), lambda x: joined(x["b"], x["u"]))


def redact(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The documents with every span replaced by `<kind>`; overlapping spans become one, named by the first."""
    keyed = carried(docs, "doc_id", "text")
    found = scan(docs, rules).filter(F.size("found") > 0).groupBy("_id", "_k").agg(F.first("found").alias("_found"))
    clean = _replaced(F.col("text"), F.col("_found"))
    row = F.col("_row").withField("text", clean)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(clean).cast(docs.schema["n_chars"].dataType))
    joined = keyed.join(found, ["_id", "_k"], "left")
    return joined.select(F.when(F.col("_found").isNull(), F.col("_row")).otherwise(row).alias("_row")).select("_row.*")
