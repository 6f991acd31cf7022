"""Grouping of spelling variants by a trie of frequency vectors.

The words of the corpus are counted first; from there on only the vocabulary moves.  Letters are
dealt into `GROUPS` groups, the frequent ones evenly, and a word is the vector of its counts of
each group.  Words lie in a trie whose levels are these counts in turn.  One edit raises at most
one count by one (surplus) and lowers at most one other (deficit), so a depth-first search enters
a child if its count is that of the query, or one more or less while that budget is unspent.  The
words of the leaves that it reaches are verified letter by letter.

The upper levels of the trie are shards: words with the same first counts.  Their depth comes from
the vocabulary, so that a word meets about `SHARD` others in its shard.  A word is at home in one
shard and a guest in those that one surplus and one deficit reach; of two shards the later one is
visited, so every pair meets once.  Shards with more words than that are cut into blocks.

A word's form is its near word of largest count, if that is at least `MUCH_MORE` times its own.
Counts grow by that factor along a chain of forms, so chains are short; roots are found by
pointer doubling.  How many words can have one form is bounded by its length and the letters.

Defined cases: null text has no words; a null id counts as the empty text; repeated rows are
counted as often as they stand there; ties of counts go to the smallest word in code-point order;
an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playbill.llm.components import in_slots
from playbill.session import cut

# Runs of letters, and which of them lose a letter.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSES = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
MUCH_MORE = 5

GROUPS = 10
SHARD = 2_000
LEAF = 24  # words of a node that are compared at once


def lowered(run: Column) -> Column:
    """A-Z in lower case, no other letter changed."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the runs of the whole texts, some with a letter lost, that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    long = runs.filter(F.length("run") >= least_letters).select("id", lowered(F.col("run")).alias("run"))
    hashed = long.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % LOSES == 0, lost).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def letter_groups(vocabulary: DataFrame, groups: int = GROUPS) -> list[str]:
    """Letters by falling frequency, dealt out to and fro, so that every group holds frequent and rare ones."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").agg(F.count("*").alias("n"))
    ranked = [r["letter"] for r in letters.orderBy(F.desc("n"), "letter").collect()]  # at most the letters of RUN
    dealt: list[list[str]] = [[] for _ in range(groups)]
    for i, letter in enumerate(ranked):
        turn, place = divmod(i, groups)
        dealt[place if turn % 2 == 0 else groups - 1 - place].append(letter)
    return ["".join(g) for g in dealt]


def counts(word: Column, letters: list[str]) -> list[Column]:
    return [F.length(word) - F.length(F.translate(word, g, "")) if g else F.lit(0) for g in letters]


def depth(vocabulary: DataFrame, letters: list[str], size: int = SHARD) -> int:
    """The least number of levels after which a word shares its counts with about `size` words on the mean."""
    vector = F.transform(F.array(*counts(F.col("word"), letters)), lambda c: c.cast("string"))
    prefixes = F.transform(F.sequence(F.lit(1), F.lit(len(letters))), lambda d: F.struct(d.alias("d"), F.array_join(F.slice("v", F.lit(1), d), ",").alias("p")))
    sizes = vocabulary.select(vector.alias("v")).select(F.explode(prefixes).alias("x")).groupBy("x.d", "x.p").agg(F.count("*").alias("n"))
    means = {r["d"]: r["m"] for r in sizes.groupBy("d").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).collect()}  # one row a level
    return min([d for d, m in means.items() if m <= size], default=len(letters))


def shards(vocabulary: DataFrame, letters: list[str], levels: int) -> DataFrame:
    """(shard, word, n, guest): every word at home, and as a guest where an edit may lead to a later shard."""
    first = [f"v[{i}]" for i in range(levels)]
    moves = [()] + [(i,) for i in range(levels)] + [(i, j) for i in range(levels) for j in range(i + 1, levels)]

    def place(move: tuple[int, ...]) -> str:
        changed = [c + (" + 1" if move[:1] == (i,) else " - 1" if move[1:] == (i,) else "") for i, c in enumerate(first)]
        key = f"concat_ws(',', {', '.join(f'cast({c} AS string)' for c in changed)})"
        visit = f"named_struct('shard', {key}, 'guest', {'true' if move else 'false'})"
        return f"if(v[{move[1]}] > 0, {visit}, null)" if len(move) > 1 else visit

    visits = F.expr(f"explode(array_compact(array({', '.join(map(place, moves))})))")
    vectors = vocabulary.select("word", "n", F.array(*counts(F.col("word"), letters)).alias("v"))
    return vectors.select("word", "n", visits.alias("x")).select("x.shard", "word", "n", "x.guest")


def one_edit(a: str, b: str) -> bool:
    """Whether two different words differ by one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if n == len(b) else n + 1 == len(b) and a[i:] == b[i + 1 :]


def vectors(found: list[str], letters: list[str]):
    """The count of each letter group in each word, as a matrix."""
    import numpy as np

    group = np.zeros(256, dtype=np.int64)
    for g, members in enumerate(letters):
        for letter in members:
            group[ord(letter)] = g
    points = np.frombuffer("".join(found).encode("latin-1"), dtype=np.uint8)
    owner = np.repeat(np.arange(len(found)), [len(w) for w in found])
    return np.bincount(owner * len(letters) + group[points], minlength=len(found) * len(letters)).reshape(len(found), len(letters))


def search(homes, queries, leaf: int = LEAF):
    """(query, home) rows of vectors within one surplus and one deficit, by a depth-first walk of the trie of the homes.

    All queries walk at once: a node is a range of the sorted homes with the queries that reach it.
    """
    import numpy as np

    order = np.lexsort(homes.T[::-1])
    tree, levels = homes[order], homes.shape[1]
    everyone, none = np.arange(len(queries)), np.zeros(len(queries), dtype=bool)
    out: list = []
    stack = [(0, len(tree), 0, everyone, none, none)]
    while stack:
        lo, hi, level, at, surplus, deficit = stack.pop()
        if not len(at) or lo == hi:
            continue
        if level == levels or hi - lo <= leaf:
            step = max(1, 4_000_000 // ((hi - lo) * levels))
            for i in range(0, len(at), step):
                change = queries[at[i : i + step], None, :] - tree[None, lo:hi, :]
                near = (np.maximum(change, 0).sum(axis=2) <= 1) & (np.maximum(-change, 0).sum(axis=2) <= 1)
                q, h = np.nonzero(near)
                out.append((at[i + q], order[lo + h]))
            continue
        column = tree[lo:hi, level]
        edges = np.flatnonzero(np.diff(column, prepend=-1))
        change = queries[at, level]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), hi - lo]):
            more = change - column[a]
            go = (more == 0) | ((more == 1) & ~surplus) | ((more == -1) & ~deficit)
            stack.append((lo + a, lo + b, level + 1, at[go], surplus[go] | (more[go] == 1), deficit[go] | (more[go] == -1)))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def near(vocabulary: DataFrame, letters: list[str], levels: int, size: int = SHARD) -> DataFrame:
    """(word, n_near, form_n, form): the number of near words, and the most frequent of them."""

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("guest", kind="stable")
        found, n = frame["word"].tolist(), frame["n"].tolist()
        homes = int((~frame["guest"]).sum())
        best: dict[int, tuple[int, int, str]] = {}
        if homes and len(found) > 1:
            table = vectors(found, letters)
            # Homes of two blocks meet elsewhere, so only guests search then.
            first = 0 if key[1] == key[2] else homes
            for q, h in zip(*(x.tolist() for x in search(table[:homes], table[first:]))):
                q += first
                if (q >= homes or q < h) and one_edit(found[q], found[h]):
                    for a, b in ((q, h), (h, q)):
                        count, least, form = best.get(a, (0, 1, ""))
                        best[a] = (count + 1, *min((least, form), (-n[b], found[b])))
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"word": text([found[i] for i in best]), "n_near": [x[0] for x in best.values()], "form_n": [-x[1] for x in best.values()], "form": text([x[2] for x in best.values()])})

    dealt = in_slots(shards(vocabulary, letters, levels), ["shard"], "word", size)
    # Dealt by the whole key: the blocks of a hot shard are not to stay where its rows met to be counted.
    parts = dealt.select("shard", "slot", "part", "word", "n", "guest").repartition("shard", "slot", "part").groupBy("shard", "slot", "part").applyInPandas(run, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("form_n"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, from (word, form): where following forms ends."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("middle"), F.col("root").alias("further"))
        moved = cut(now.join(ahead, F.col("root") == F.col("middle"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, groups: int = GROUPS, size: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    vocabulary = cut(words(docs))
    letters = letter_groups(vocabulary, groups)
    pairs = near(vocabulary, letters, depth(vocabulary, letters, size), size)
    much = F.col("form_n") >= MUCH_MORE * F.col("n")
    known = cut(vocabulary.join(pairs, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("form")).alias("form"), F.when(much, F.col("form_n")).alias("form_n")))
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
