"""Quality rules as a ledger of bits.

Every rule is evaluated once for every whole text.  Its failure is one bit of `failed`, what it
measured stays beside it.  A policy is a version and a mask of rules: applying one, comparing two
and finding what each rule alone decides are bitwise steps over the stored ledger, no text is read
again.  The ablation counts are taken from the distinct masks, of which there are few.

Defined cases: null and empty texts have no word and fail `few_words`; repeated rows are rows of
their own; an empty table gives an empty ledger; further columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.common import map_columns

# Word and symbol classes of the ledger.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
ENDS = "!?"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_ends", "n_ellipsis_lines", "n_bullet_lines"]

# Name, and the failure as whole-number arithmetic on the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("few_letters", "100 * n_letters < 60 * word_chars"),
    ("shouting", "100 * n_upper > 70 * n_letters and n_letters > 0"),
    ("exclamations", "100 * n_ends > 40 * n_words"),
    ("ellipses", "n_lines >= 4 and 100 * n_ellipsis_lines > 30 * n_lines"),
    ("bullets", "n_lines >= 4 and 100 * n_bullet_lines > 90 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
mask = lambda *names: sum(BIT[n] for n in names)

POLICIES = {
    "base": mask("few_words", "repeated_words"),
    "v1": mask("few_words", "repeated_words", "symbols", "word_length", "few_letters"),
    "v2": sum(BIT.values()),
}
CURRENT = "v2"


def repeats(words: list[str]) -> int:
    """Words in windows of three that the text has twice or more, the first one included."""
    import numpy as np

    if len(words) < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]  # two steps, so that no product overflows
    code = pair[:-1].astype(np.int64) * len(ids) + a[2:]
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    stripped = [x.strip() for x in lines]
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    lower = text.lower()
    # Lower case of one letter may be several, and then the texts cannot be compared place by place.
    upper = sum(a != b for a, b in zip(text, lower if len(lower) == len(text) else map(str.lower, text))) if letters and text != lower else 0
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats(words), len(lines), letters, upper,
        sum(map(text.count, ENDS)), sum(x.endswith(("...", "…")) for x in stripped), sum(x[:1] in "•*-" for x in stripped),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, the measurements, and `failed`: the bits of the rules that the text fails."""
    kind = docs.schema[id_col].dataType.simpleString()
    measured = map_columns(docs.select(id_col, "text"), lambda ids, texts: [ids, *zip(*map(measure, texts))], f"{id_col} {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    failed = sum((F.when(F.expr(test), F.lit(1 << i)).otherwise(0) for i, (_, test) in enumerate(RULES)), F.lit(0)).cast("bigint")
    return measured.withColumn("failed", failed)


def passes(policy: str, failed: str | Column = "failed") -> Column:
    col = F.col(failed) if isinstance(failed, str) else failed
    return col.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that it alone removes, rows kept without it."""
    own = F.lit(POLICIES[policy])
    masks = ledger_rows.groupBy(F.col("failed").bitwiseAND(own).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("bigint").alias("bit")) for name, bit in BIT.items() if POLICIES[policy] & bit]))
    one = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return one.groupBy("rule", "bit").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_by_it"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without_it"),
    )


def policy_changes(ledger_rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows by their verdict under two policies."""
    return ledger_rows.groupBy(passes(old).alias("kept_old"), passes(new).alias("kept_new")).agg(F.count("*").alias("n"), F.bit_or("failed").alias("bits_seen"), F.bit_and("failed").alias("bits_shared"))
