"""The training-data queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from playbill.llm import embeddings, filter_audit, langid, mixing, online_packing, packing, pii, quality, rules, secrets, simhash, spelling, substrings
from playbill.llm.common import crc_mod, table
from playbill.plans.registry import query

SECRET_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
rules(ord, kind, pat) AS (VALUES %s),
gaps AS (
  SELECT r, ord, kind, regexp_extract_all(text, pat) AS hits, regexp_split_to_array(text, pat) AS gap
  FROM d, rules WHERE regexp_matches(text, pat)),
places AS (
  SELECT r, ord, kind, hits[i] AS hit,
         list_sum(list_transform(gap[1:i], lambda g: length(g)))
         + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s
  FROM gaps, unnest(range(1, len(hits) + 1)) AS u(i)),
found AS (
  SELECT r, ord, kind, CAST(s AS BIGINT) AS s, CAST(s + length(hit) AS BIGINT) AS e FROM places
  WHERE ord > 0 OR length(regexp_extract(hit, %s, 2)) >= 6),
own AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord <= 2), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM found GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN own USING (r)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SECRET_SQL = SECRET_SQL % (", ".join(f"({i}, {_quoted(r.kind)}, {_quoted(r.pattern)})" for i, r in enumerate(secrets.RULES)), _quoted(secrets.RULES[0].pattern))

MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{mixing.SYMBOLS}', '')) AS marks,
         (CAST(('0x' || substr(md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 12)) AS UBIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN size > 0 THEN greatest(0.1::DOUBLE, 1::DOUBLE - marks::DOUBLE / size::DOUBLE) ELSE 1::DOUBLE END AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM k GROUP BY source),
ranked AS (SELECT *, 3::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 3::DOUBLE * source_size / w, source NULLS LAST) AS rn, sum(source_size) OVER () AS whole, sum(w) OVER () AS ws FROM s),
levels AS (
  SELECT *, (whole - coalesce(sum(most) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (ws - coalesce(sum(w) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ranked),
aims AS (
  SELECT source, source_size, CASE WHEN level * w >= most THEN most ELSE w * (SELECT arg_min(level, rn) FROM levels WHERE level * w < most) END AS target FROM levels),
run AS (
  SELECT k.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, CAST(doc_id AS VARCHAR), size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN aims a ON k.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN epochs < 3 AND upto - size / 2::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
m AS (
  SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
         + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
letters AS (SELECT f, i FROM (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) AS v(f, i)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE (1 << a.i) + (1 << b.i) + (1 << c.i) + (1 << d.i) + (1 << e.i) = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, CAST(s.step AS INT) AS step, substr(filter_order, s.step, 1) AS f,
         (SELECT sum(1 << i) FROM letters WHERE contains(substr(filter_order, 1, s.step), f)) AS upto,
         1 << (SELECT i FROM letters WHERE f = substr(filter_order, s.step, 1)) AS own
  FROM orders, (SELECT unnest(range(1, 6)) AS step) AS s),
counted AS (
  SELECT part, filter_order, step, f,
         CAST(sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & upto = own THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & own > 0 AND mask & (upto - own) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & upto = own THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & upto = own THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM steps, cells GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


# crc32 is spelled out byte by byte; near words share a key with one letter left out.
SPELLING_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce([CAST(n AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents),
counted AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS m
  FROM runs WHERE length(r) >= 6 GROUP BY ALL),
hexed AS (SELECT r, m, hex(encode(id || ':' || r)) AS x FROM counted),
hashed AS (
  SELECT r, m, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT))),
           lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295::UBIGINT) AS h
  FROM hexed, bits),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, m FROM hashed),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
keys AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM w, unnest(range(0, length(word))) AS u(i)),
pairs AS (
  SELECT a.word, b.word AS other FROM keys a JOIN keys b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT k.word, w.word FROM keys k JOIN w ON k.rest = w.word
  UNION SELECT w.word, k.word FROM keys k JOIN w ON k.rest = w.word),
near AS (SELECT pairs.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS best, max(w.n) AS best_n FROM pairs JOIN w ON w.word = other GROUP BY pairs.word),
forms AS (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM w LEFT JOIN near USING (word)),
chain(word, tip) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM (SELECT * FROM chain) c, forms f WHERE f.word = c.tip AND f.form IS NOT NULL)
SELECT f.word, f.form, c.tip AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.tip AND e.form IS NULL
"""


@query("op12_spelling", SPELLING_SQL)
def op12_spelling(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@query("op11_online_packing")
def op11_online_packing(spark, sf):
    return online_packing.pack_online(table(spark, sf, "documents"))


@query("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_secrets", SECRET_SQL)
def op7_secrets(spark, sf):
    return secrets.report(table(spark, sf, "documents"))


@query("op10_mixing", MIX_SQL)
def op10_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op1_language")
def op1_language(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op2_packing")
def op2_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op4_rules")
def op4_rules(spark, sf):
    rows = rules.ledger(table(spark, sf, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~rules.passes("base")).alias("base_failed"), rules.passes(rules.CURRENT).alias("kept"), "failed")


@query("op6_embeddings")
def op6_embeddings(spark, sf):
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


@query("op8_simhash")
def op8_simhash(spark, sf):
    return simhash.report(table(spark, sf, "documents"))


@query("op5_substrings")
def op5_substrings(spark, sf):
    return substrings.dedup(table(spark, sf, "documents")).drop("removed")


@query("op9_quality")
def op9_quality(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    net = quality.fit(docs, table(spark, sf, "labels"), ~held_out)
    return quality.score(docs.select("doc_id", "text", held_out.alias("held_out")), net).drop("text")


@query("op3_pii")
def op3_pii(spark, sf):
    return pii.report(table(spark, sf, "documents"))
