"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fingerprint, hmm, middle, mixing, neighbours, packing, quality, repair, secrets, sharding, simhash, substrings, suffixes
from .common import table


def op1_simhash(spark, sf_dir):
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    s = sharding.shard(table(spark, sf_dir, "documents"))
    return s.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op4_fingerprints(spark, sf_dir):
    return fingerprint.with_neighbours(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def op6_substrings(spark, sf_dir):
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_hmm(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_middle(spark, sf_dir):
    moved = middle.restore(middle.transform(table(spark, sf_dir, "documents")))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return repair.with_reports(conversations, repair.damage(conversations))


def op13_suffixes(spark, sf_dir):
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def shard_sizes(spark, sf_dir):
    """What SQL can tell of op2: each document once with its size."""
    return op2_sharding(spark, sf_dir).select("doc_id", "size", "law")


def fingerprint_edits(spark, sf_dir):
    """What SQL can tell of op4: lengths and edited texts."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secrets_base(spark, sf_dir):
    """What SQL can tell of op5: the base spans."""
    return op5_secrets(spark, sf_dir).drop("spans")


def hmm_base(spark, sf_dir):
    """What SQL can tell of op9: folds, counts and the unigram base."""
    return op9_hmm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_sharding, op3_neighbours, op4_fingerprints, op5_secrets, op6_substrings, op7_quality, op8_mixing, op9_hmm, op10_packing, op11_middle, op12_repair, op13_suffixes, pipeline,
    shard_sizes, fingerprint_edits, secrets_base, hmm_base,
)}

#: CRC-32 of a short ASCII string, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295, range(0, 8 * len({0}))), lambda c, k: xor(
  (CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr({0}, CAST(k // 8 + 1 AS BIGINT), 1))) ELSE c END) >> 1,
  3988292384 * ((CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr({0}, CAST(k // 8 + 1 AS BIGINT), 1))) ELSE c END) & 1))), 4294967295)"""

#: A state of the repair in SQL: the least (cost, audit, repaired rows) of what reaches it.
STEP = "CASE WHEN {p} IS NOT NULL THEN {{'c': {p}['c'] + {w}, 'a': {p}['a'] || '{x}', 'm': {m}}} END"
NONE = "CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, m VARCHAR[]))"
ADD = lambda p, w, x, row: STEP.format(p=p, w=w, x=x, m=f"list_append({p}['m'], {row})")
ANY_USER = lambda w, x, row, *of: ", ".join(ADD(p, w, x, row) for p in of)

#: Spans of a pattern: code points before a match are those of the pieces of a split and of the matches before it.
SPANS = r"""SELECT doc_id, {kind} AS kind, start, start + len(m) AS stop, m FROM (
  SELECT doc_id, ms[i] AS m, CAST(coalesce(list_sum(list_transform(bs[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, ms, bs, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS bs FROM d)))"""
ASSIGN, ACCESS, HEX = secrets.ASSIGN.replace("'", "''"), "AKIA[A-Z0-9]+", "[0-9a-f]+"

ORACLE_SQL = {
    "op13_suffixes": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, lower(hex(b)) AS x, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM h)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE doc_id > first),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
e AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM p GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(z) - list_sum(a), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN a IS NULL THEN b ELSE unhex(array_to_string([substr(x, 2 * CASE WHEN k = 1 THEN 0 ELSE z[k - 1] END + 1, 2 * (CASE WHEN k > len(a) THEN n ELSE a[k] END - CASE WHEN k = 1 THEN 0 ELSE z[k - 1] END)) FOR k IN range(1, len(a) + 2)], '')) END) AS kept_sha256
FROM h JOIN d USING (doc_id) LEFT JOIN e ON h.doc_id = e.doc_id""",
    "op12_repair": rf"""
WITH RECURSIVE
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, {CRC32.format("key")} % 20 AS k FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k WHERE k <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM d),
f AS (
  SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o)),
r AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM f GROUP BY conv_id),
w(conv_id, i, n0, n1, n2, n3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 'm': CAST([] AS VARCHAR[])}}, {NONE}, {NONE}, {NONE} FROM r
  UNION ALL
  SELECT conv_id, i, m0, m1, m2, m3 FROM (
    SELECT f.conv_id, f.i, f.fault IN (1, 2) AS gone, CASE WHEN f.fault = 3 THEN 1 ELSE 0 END AS t,
           least(n2, {ANY_USER(2, "I", "'user:'", "n0", "n1", "n3")}) AS e2, least(n3, {ADD("e2", 2, "I", "'assistant:'")}) AS e3,
           {STEP.format(p="n0", w=3, x="D", m="n0['m']")} AS m0,
           least({STEP.format(p="n1", w=3, x="D", m="n1['m']")}, CASE WHEN NOT gone AND x = 's' THEN {ADD("n0", "t", "K", "role || ':' || text")} END) AS m1,
           least({STEP.format(p="e2", w=3, x="D", m="e2['m']")}, CASE WHEN NOT gone THEN least({ANY_USER("2 + t", "R", "'user:' || text", "n0", "n1", "e3")}) END,
                 CASE WHEN NOT gone AND x = 'u' THEN least({ANY_USER("t", "K", "role || ':' || text", "n0", "n1", "e3")}) END) AS m2,
           least({STEP.format(p="e3", w=3, x="D", m="e3['m']")}, CASE WHEN NOT gone THEN {ADD("e2", "2 + t", "R", "'assistant:' || text")} END,
                 CASE WHEN NOT gone AND x = 'a' THEN {ADD("e2", "t", "K", "role || ':' || text")} END) AS m3
    FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)),
b AS (
  SELECT r.*, least(n2, {ANY_USER(2, "I", "'user:'", "n0", "n1", "n3")}) AS e2, least(n0, n3, {ADD("e2", 2, "I", "'assistant:'")}) AS best
  FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.n)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best['c'], 0) AS BIGINT) AS cost, coalesce(best['a'], '') AS audit, sha256(coalesce(array_to_string(best['m'], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op11_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, [CAST('0x' || substr(x, k, 8) AS BIGINT) FOR k IN [1, 9, 17, 25]] AS h FROM d),
c AS (SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS z FROM u),
p AS (
  SELECT doc_id, t, n, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:z], '') AS m, array_to_string(w[z + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""",
    "shard_sizes": "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, 'bytes' AS law FROM documents",
    "fingerprint_edits": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nxt FROM d)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_chars, sha256(substr(t, 1, len(t) - len(t) // 4) || substr(nxt, 1, len(t) // 4)) AS edited_sha256 FROM n""",
    "secrets_base": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, 0 AS kind, start, stop FROM ({SPANS.format(kind=0, p=ASSIGN)}) WHERE len(regexp_extract(m, '{ASSIGN}', 2)) >= 8
  UNION ALL SELECT doc_id, kind, start, stop FROM ({SPANS.format(kind=1, p=ACCESS)}) WHERE len(m) >= 16
  UNION ALL SELECT doc_id, kind, start, stop FROM ({SPANS.format(kind=2, p=HEX)}) WHERE len(m) >= 32)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind), '')) AS base_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    "hmm_base": rf"""
WITH d AS (
  SELECT doc_id, {CRC32.format("CAST(doc_id AS VARCHAR)")} % 10 = 0 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w
  FROM documents),
k AS (SELECT doc_id, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM k WHERE NOT held_out GROUP BY word),
t AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT k.doc_id, k.held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(t.n) AS BIGINT) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.1) / (t.n + 0.1 * (t.v + 1)))), 4) AS base_score
FROM k LEFT JOIN c ON k.word = c.word CROSS JOIN t GROUP BY k.doc_id, k.held_out""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS w,
         CAST(source_size AS DOUBLE) * 2 AS cap, sum(source_size) OVER () * 1.5 AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w),
t AS (
  SELECT source, source_size,
         least(cap, w * (SELECT arg_min(lev, cap / w) FROM l WHERE lev * w <= cap)) AS target
  FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN whole < 2 AND (upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
    "op6_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d),
y AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM y WHERE k > 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.j) AS kept FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
}

