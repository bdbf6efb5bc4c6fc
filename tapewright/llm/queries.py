"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import (
    decontaminate, fingerprints, jaccard_join, lang_id, license_scan, line_templates, lm_score, mixing, prefix_trie, spelling, substring_dedup, suffix_dedup, token_store)
from tapewright.llm.common import ID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary() -> str:
    """Place of the public vocabulary file on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_substring_dedup")
def repeated_spans(spark, sf):
    return substring_dedup.dedup(table(spark, sf, "documents"))


@query("op2_language_id")
def language_id(spark, sf):
    return lang_id.identify(table(spark, sf, "documents"))


@query("op3_decontamination")
def decontamination(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_jaccard_join")
def ngram_join(spark, sf):
    return jaccard_join.join(table(spark, sf, "documents")).select(F.col(ID).alias("doc_id"), "class_id", "copies", "n_links")


@query("op5_line_templates")
def template_lines(spark, sf):
    return line_templates.dedup(table(spark, sf, "documents"))


@query("op6_lm_score")
def language_model(spark, sf):
    return lm_score.score(table(spark, sf, "documents"))


@query("op7_token_store")
def token_file(spark, sf):
    return token_store.round_trip(table(spark, sf, "documents"), vocabulary())


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST(('0x' || substr(md5('8|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5)
         / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, CAST(sum(size * CAST(floor(size * 1024 / (size + 64.0::DOUBLE)) AS BIGINT)) AS BIGINT) AS score_words,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
k AS (
  SELECT 0.0::DOUBLE AS share, 0 AS step
  UNION ALL
  SELECT (SELECT (sum(source_size) - coalesce(sum(CASE WHEN weight * k.share >= 3.0::DOUBLE * source_size THEN 3.0::DOUBLE * source_size END), 0))
                 / sum(CASE WHEN weight * k.share < 3.0::DOUBLE * source_size THEN weight END) FROM s), step + 1
  FROM k WHERE step < 60),
t AS (
  SELECT s.*, least(weight * (SELECT max(share) FROM k), 3.0::DOUBLE * source_size) AS target FROM s),
e AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, t.n_docs, t.score_words, u,
         floor(t.target / t.source_size + 1e-12::DOUBLE) AS sure, greatest(t.target / t.source_size - floor(t.target / t.source_size + 1e-12::DOUBLE), 0) AS p
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT *, CASE WHEN p > 0 THEN p + least(p, 1 - p) * (CAST(floor(size * 1024 / (size + 64.0::DOUBLE)) AS BIGINT) / 1024.0::DOUBLE - score_words / (1024.0::DOUBLE * source_size)) END AS p_i FROM e),
q AS (
  SELECT *, (u / (1 - u)) / (p_i / (1 - p_i)) * (p / (1 - p)) AS ratio FROM o),
v AS (
  SELECT *, ratio / (1 + ratio) AS rank FROM q),
r AS (
  SELECT *, floor(rank * ceil(n_docs / 512.0::DOUBLE)) AS bucket, target - sure * source_size AS "left",
         sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM v),
f AS (
  SELECT *, max(CASE WHEN upto <= "left" THEN upto ELSE 0 END) OVER (PARTITION BY source) AS base,
         max(upto) OVER (PARTITION BY source, bucket) AS bucket_end, min(upto - size) OVER (PARTITION BY source, bucket) AS bucket_start FROM r),
g AS (
  SELECT *, "left" - base AS rest, bucket_start < "left" AND bucket_end > "left" AND upto > "left" AND p > 0 AS open,
         CASE WHEN size > 0 THEN least(1, floor(("left" - base) / size + 0.5::DOUBLE)) ELSE 0 END AS part FROM f),
h AS (
  SELECT *, CASE WHEN open AND part > 0 THEN abs(rest - size) END AS miss FROM g),
i AS (
  SELECT *, row_number() OVER (PARTITION BY source, open ORDER BY miss NULLS LAST, rank, doc_id) AS place FROM h)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (sure + CASE WHEN p > 0 AND upto <= "left" THEN 1 WHEN open AND place = 1 AND miss < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM i
"""


@query("op8_mixing", MIX_SQL)
def mixture(spark, sf):
    return mixing.per_row(mixing.mixed(table(spark, sf, "documents")))


@query("op9_license_scan")
def licenses(spark, sf):
    return license_scan.scan(table(spark, sf, "documents"), license_scan.templates(spark))


@query("op10_fingerprints")
def prints(spark, sf):
    return fingerprints.compare(table(spark, sf, "documents"))


#: crc32 of the decimal id, bit by bit; prefixes are compared as lists of turns.
TRIE_SQL = r"""
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda crc, byte:
    list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) % 4 AS h FROM own),
built AS (
  SELECT h.conv_id, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
pre AS (
  SELECT conv_id, d, l[1:d] AS p, len(l) = d AS here FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN here THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ids,
         CASE WHEN d > 0 THEN len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM pre GROUP BY d, p),
linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]),
counted AS (
  SELECT n.d, n.conv_id, n.p, n.parent_conv_id, n.n_convs, n.ids, n.words, count(k.d) AS n_children FROM linked n LEFT JOIN nodes k ON k.d = n.d + 1 AND k.p[1:n.d] = n.p GROUP BY ALL)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves,
       CAST(sum((x.n_convs - 1) * x.words) AS BIGINT) AS saved_tokens, sha256(a.ids) AS ends_sha256
FROM counted a JOIN counted x ON x.d >= a.d AND x.p[1:a.d] = a.p GROUP BY a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.ids, a.p
"""


@query("op11_prefix_trie", TRIE_SQL)
def prefix_nodes(spark, sf):
    return prefix_trie.trie(table(spark, sf, "conversations"))


#: Texts as hex, in overlapping cuts so that windows are taken from short strings.
REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
c AS (
  SELECT doc_id, 500 * q AS base, substr(x, 1000 * q + 1, 1098) AS y FROM (SELECT *, unnest(range(0, (n + 499) // 500)) AS q FROM d)),
w AS (
  SELECT doc_id, base + j AS i, substr(y, 2 * j + 1, 100) AS g FROM (SELECT *, unnest(range(0, least(500, len(y) // 2 - 49))) AS j FROM c)),
f AS (
  SELECT g, min(doc_id) AS first FROM w GROUP BY g),
s AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM w JOIN f USING (g) WHERE f.first < w.doc_id),
r AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT *, sum(CASE WHEN was IS NULL OR i > was + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
k AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS kept
  FROM (SELECT r.*, d.x, lag(b, 1, 0) OVER (PARTITION BY r.doc_id ORDER BY a) AS done FROM r JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.x ELSE kept || substr(d.x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


@query("op12_suffix_dedup", REPEATS_SQL)
def repeated_bytes(spark, sf):
    found = suffix_dedup.dedup(table(spark, sf, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SPELLING_SQL = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
p AS (
  SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM o WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (
  SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda crc, byte:
    list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT) AS h FROM p),
v AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
c AS (
  SELECT word, i, word[1:i] AS a, word[i + 2:] AS b FROM (SELECT word, unnest(range(0, length(word))) AS i FROM v)),
e AS (
  SELECT DISTINCT c.word, v.word AS near FROM c JOIN v ON v.word = c.a || c.b),
near AS (
  SELECT l.word, r.word AS near FROM c l JOIN c r ON r.i = l.i AND r.a = l.a AND r.b = l.b AND r.word <> l.word
  UNION ALL SELECT word, near FROM e UNION ALL SELECT near, word FROM e),
best AS (
  SELECT near.word, near.near, w.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS place
  FROM near JOIN v w ON w.word = near.near),
f AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * v.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * v.n THEN b.near_n END AS form_n
  FROM v LEFT JOIN best b ON b.word = v.word AND b.place = 1),
r AS (
  SELECT word, word AS root FROM f
  UNION ALL
  SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f g ON g.word = r.root AND g.form IS NULL
"""


@query("op13_spelling_variants", SPELLING_SQL)
def spelling_variants(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))
