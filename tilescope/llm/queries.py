"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilescope.llm import divergence, embeddings, language, lines, links, mixing, periodic, pieces, quality, sharding, simhash, token_files, toxicity
from tilescope.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


N_SHARDS = 40

SHARD_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, text,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 16))::UBIGINT AS k
  FROM documents),
walk AS (
  SELECT DISTINCT doc_id, k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM docs
  UNION ALL
  SELECT doc_id, nk, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((nk >> 33) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT *, CAST((k::UHUGEINT * {sharding.MULTIPLIER} + 1) % 18446744073709551616::UHUGEINT AS UBIGINT) AS nk
        FROM walk WHERE j < {N_SHARDS})),
crc_bits AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
crcs AS (
  SELECT text, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
           lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT text FROM docs WHERE text IS NOT NULL), crc_bits),
ends AS (SELECT doc_id, CAST(max(b) FILTER (WHERE b < {N_SHARDS}) AS INTEGER) AS shard,
              CAST(CASE WHEN max(j) = {N_SHARDS} THEN {N_SHARDS} ELSE max(b) END AS INTEGER) AS grown_shard FROM walk GROUP BY doc_id)
SELECT d.doc_id, d.size, c.text_crc32, 'key' AS law, a.shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY md5(concat_ws('|', coalesce(CAST(d.doc_id AS VARCHAR), '~'),
         CAST(d.size AS VARCHAR), coalesce(CAST(c.text_crc32 AS VARCHAR), '~')))) - 1 AS slot,
       a.grown_shard
FROM docs d LEFT JOIN crcs c ON d.text = c.text JOIN ends a ON d.doc_id IS NOT DISTINCT FROM a.doc_id"""


@query("op1_sharding", SHARD_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), N_SHARDS)


MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(text) AS text_md5 FROM documents),
items AS (
  SELECT *, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '~'), coalesce(source, '~'), CAST(size AS VARCHAR),
                coalesce(text_md5, '~'), '')) AS h FROM docs),
ranked AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM items GROUP BY source)),
weighed AS (
  SELECT *, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CASE k WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS tilt FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
            / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS LAST)),
sources AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, (SELECT max(lev) FROM levels) * weight) AS target,
         weight * (1 + tilt) AS w0, weight * (1 - tilt) AS w1 FROM levels),
placed AS (
  SELECT i.doc_id, i.size, s.*, CAST(floor(s.target) AS BIGINT) AS goal,
         CAST(coalesce(sum(i.size) OVER (PARTITION BY i.source ORDER BY i.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM items i JOIN sources s ON i.source IS NOT DISTINCT FROM s.source),
counted AS (
  SELECT *, least(greatest(goal - start, 0), size) + least(greatest(goal - start - source_size, 0), size) AS taken,
         start / greatest(goal, 1) * ((w0 + w1) / 2) AS d FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CASE WHEN taken > 0 THEN round(least(1.0, d * 2 / (w0 + sqrt(greatest(w0 * w0 + d * 2 * (w1 - w0), 0)))), 9) END AS position
FROM counted"""


@query("op2_mixing", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(read(spark, sf_dir, "documents"))


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u),
firsts AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(f.w, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(f.w, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.u LEFT JOIN firsts f ON e.vec_id = f.u"""


@query("op3_embedding_dedup", VECTOR_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


LINE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site FROM documents),
lines AS (SELECT r, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM texts),
shared AS (SELECT trim(line, ' ') AS line FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
           GROUP BY trim(line, ' ') HAVING count(DISTINCT site) >= 10),
marked AS (SELECT l.r, l.line, l.pos, s.line IS NOT NULL AS gone FROM lines l LEFT JOIN shared s ON trim(l.line, ' ') = s.line),
joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY r)
SELECT t.doc_id, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed,
       coalesce(length(j.text), 0) AS n_chars, md5(j.text) AS text_md5
FROM texts t LEFT JOIN joined j ON t.r = j.r"""


@query("op5_line_dedup", LINE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(read(spark, sf_dir, "documents"))


#: (verdict, host, path) of the contract's rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

URL_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM p),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT q.r, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
         FROM q JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY q.r),
hrefs AS (SELECT host, unnest(regexp_extract_all(html, '(?i)href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?([^"''>\x20\x09-\x0D]+)', 1)) AS link FROM q),
links AS (SELECT host AS source, CASE WHEN starts_with(link, '//') THEN regexp_extract(substr(link, 3), '^([^/?#]*)', 1)
            WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN regexp_extract(substr(link, strpos(link, '://') + 3), '^([^/?#]*)', 1)
            WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN '' ELSE host END AS target FROM hrefs),
edges AS (SELECT source, translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target, count(*) AS n FROM links
          GROUP BY ALL HAVING source <> '' AND target <> '' AND source <> target),
moves AS (SELECT 'trust' AS kind, source AS a, target AS b, n / sum(n) OVER (PARTITION BY source) * 0.85 AS share FROM edges
          UNION ALL SELECT 'distrust', target, source, n / sum(n) OVER (PARTITION BY target) * 0.85 FROM edges),
step AS (SELECT 0 AS k, CASE f.verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, q.host, CAST(count(*) AS DOUBLE) AS mass
         FROM q JOIN fits f ON q.r = f.r WHERE q.host <> '' GROUP BY ALL
         UNION ALL SELECT s.k + 1, m.kind, m.b, sum(s.mass * m.share) FROM step s JOIN moves m ON s.kind = m.kind AND s.host = m.a
         WHERE s.k < 400 GROUP BY s.k, m.kind, m.b),
hosts AS (SELECT host, coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0) * 0.15 AS t, coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) * 0.15 AS d
          FROM step GROUP BY host)
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.verdict, CASE WHEN round(h.d, 9) > round((h.t + h.d) * 0.5, 9) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN fits f ON q.r = f.r LEFT JOIN hosts h ON q.host = h.host"""


@query("op10_url_filter", URL_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_report(read(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(periodic.with_planted_runs(read(spark, sf_dir, "documents")))


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(read(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS own, coalesce(any_value(s.v), 0) AS v
           FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
           LEFT JOIN sizes s ON g.lang = s.lang GROUP BY g.lang, g.source),
langs AS (SELECT lang, sum(own) AS own FROM groups GROUP BY lang),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.own + g.v)::HUGEINT AS p
          FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair_part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
totals AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term),
shares AS (SELECT t.lang, t.term, 1 + 1000000000::HUGEINT * (t.n + 1) // (l.own + s.v)::HUGEINT AS q
           FROM totals t JOIN langs l USING (lang) JOIN sizes s USING (lang)),
term_part AS (SELECT c.lang, c.source, 'term' AS part, c.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
              FROM cells c JOIN shares s ON c.lang = s.lang AND c.term = s.term WHERE c.n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
           FROM (SELECT * FROM pair_part UNION ALL SELECT * FROM term_part))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(read(spark, sf_dir, "documents"))
