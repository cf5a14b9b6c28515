"""Quality and identity checks over whole tables; most return offending rows or their counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescope.functions import scalars as S
from tilescope.functions.scalars import as_bigint as bi
from tilescope.operators import quality as Q
from tilescope.plans.fixtures import COORD, MEMBERS, K, coordinates, features, folds, members, table
from tilescope.plans.ranking_queries import CURVE, score_curve
from tilescope.plans.registry import query
from tilescope.plans.shape import B, R, keyed
from tilescope.session import new_scratch_path
from tilescope.sources.files import hash_files, write_files


@query("q01_unique_key", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem
GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return keyed(Q.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
                 ["l_orderkey", "l_linenumber"], ["n"])


@query("q02_label_domain", """WITH t AS (SELECT CASE l_partkey % 50 WHEN 0 THEN '1.5' WHEN 1 THEN 'true' WHEN 2 THEN '"2"'
 ELSE CAST(l_orderkey % 9 - 2 AS VARCHAR) END AS label FROM lineitem)
SELECT label, count(*) AS n FROM t WHERE label NOT IN ('-1', '0', '1', '2', '3', '4', '5') GROUP BY label""")
def _(spark, sf):
    part = F.pmod("l_partkey", F.lit(50))
    t = table(spark, sf, "lineitem").select(
        F.when(part == 0, "1.5").when(part == 1, "true").when(part == 2, '"2"')
        .otherwise((F.pmod("l_orderkey", F.lit(9)) - 2).cast("string")).alias("label"))
    return Q.check_labels(t, K, True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("q03_exact_coverage", """SELECT o_custkey + 5 AS key, 'left' AS side FROM orders WHERE o_custkey + 5 NOT IN
 (SELECT c_custkey FROM customer) GROUP BY 1
UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 5 FROM orders)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") + 5).alias("key"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return Q.check_coverage(o, c, "key")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER"]


@query("q04_complete_grid", """WITH have AS (SELECT c_mktsegment AS segment, c_nationkey::BIGINT AS nation,
  floor(c_acctbal / 500)::BIGINT AS band, count(*) AS n FROM customer GROUP BY ALL),
grid AS (SELECT s AS segment, n AS nation, k - 1 AS band FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'),
 ('HOUSEHOLD'), ('MACHINERY'), ('OTHER')) a(s) CROSS JOIN range(20) b(n) CROSS JOIN range(20) c(k))
SELECT coalesce(h.segment, g.segment) AS segment, coalesce(h.nation, g.nation) AS nation, coalesce(h.band, g.band) AS band,
 coalesce(h.n, 0) AS n, g.segment IS NOT NULL AS expected
FROM have h FULL JOIN grid g ON h.segment = g.segment AND h.nation = g.nation AND h.band = g.band
WHERE coalesce(h.n, 0) <> 1 OR g.segment IS NULL""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), bi("c_nationkey").alias("nation"),
        F.floor(F.col("c_acctbal") / 500).alias("band"))
    return Q.check_grid(c, {"segment": SEGMENTS, "nation": list(range(20)), "band": list(range(-1, 19))})


@query("q05_constant_within_group", """SELECT l_orderkey, (count(DISTINCT l_returnflag) > 1) AS l_returnflag_varies,
 (count(DISTINCT l_linestatus) > 1) AS l_linestatus_varies FROM lineitem GROUP BY l_orderkey
HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1""")
def _(spark, sf):
    return Q.check_constant(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("q06_disjoint_test_folds", """SELECT l_partkey AS tile_id, count(DISTINCT l_suppkey % 5) AS folds FROM lineitem
WHERE l_linenumber = 1 GROUP BY 1 HAVING count(DISTINCT l_suppkey % 5) > 1""")
def _(spark, sf):
    s = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("tile_id"), F.pmod("l_suppkey", F.lit(5)).alias("fold"),
        F.when(F.col("l_linenumber") == 1, "test").otherwise("train").alias("role"))
    return keyed(Q.check_disjoint(s), ["tile_id"], ["folds"])


@query("q07_role_support", """WITH a AS (SELECT fold, CASE WHEN vec_id % 5 = fold THEN 'test'
  WHEN vec_id % 5 = (fold + 1) % 5 THEN 'val' ELSE 'train' END AS role, label, count(*) AS actual
 FROM embeddings CROSS JOIN range(5) r(fold) GROUP BY ALL),
e AS (SELECT f.i AS fold, r AS role, c.i AS label, CASE r WHEN 'train' THEN 30 ELSE 10 END AS declared
 FROM range(5) f(i) CROSS JOIN (VALUES ('train'), ('val'), ('test')) v(r) CROSS JOIN range(11) c(i))
SELECT e.fold, e.role, e.label, declared::BIGINT AS declared, coalesce(actual, 0) AS actual FROM e LEFT JOIN a
 ON a.fold = e.fold AND a.role = e.role AND a.label = e.label
WHERE coalesce(actual, 0) <> declared OR coalesce(actual, 0) = 0""")
def _(spark, sf):
    design = spark.range(5).select(F.col("id").cast("int").alias("fold")).withColumn(
        "role", F.explode(F.array(F.lit("train"), F.lit("val"), F.lit("test")))).withColumn(
        "label", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn(
        "n", F.when(F.col("role") == "train", 30).otherwise(10))
    return keyed(Q.check_support(folds(spark, sf), design, ["fold", "role", "label"]),
                 ["fold", "role", "label"], ["declared", "actual"])


@query("q08_catalog_gate", """WITH h AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'display' WHEN 1 THEN 'linear' END AS space,
 s_acctbal > 0 AS verified, s_nationkey % 2 = 0 AS labelled FROM supplier)
SELECT s_suppkey, 'intensity' AS reason FROM h WHERE coalesce(space, '') <> 'display'
UNION ALL SELECT s_suppkey, 'unverified' FROM h WHERE NOT verified
UNION ALL SELECT s_suppkey, 'unlabeled' FROM h WHERE NOT labelled""")
def _(spark, sf):
    m = F.pmod("s_suppkey", F.lit(3))
    h = table(spark, sf, "supplier").select(
        "s_suppkey", F.when(m == 0, "display").when(m == 1, "linear").alias("space"),
        (F.col("s_acctbal") > 0).alias("verified"), (F.col("s_nationkey") % 2 == 0).alias("labelled"))
    return Q.gate_catalog(h, "s_suppkey", {"intensity": F.col("space") == "display",
                                           "unverified": F.col("verified"), "unlabeled": F.col("labelled")})


# a file holds the pages of 64 consecutive ids
FILES = """WITH f AS (SELECT page_id // 64 AS k, string_agg(html, chr(10) ORDER BY page_id) AS t FROM pages GROUP BY ALL)"""


def page_files(spark, sf):
    p = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 64).alias("k")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("p"))
    return p.select("k", F.array_join(F.transform("p", lambda r: r["html"]), "\n").alias("t"))


@query("q09_file_hashes", FILES + """ SELECT concat('pages/', k, '.html') AS path, CASE k % 5 WHEN 1 THEN 'digest' WHEN 2 THEN 'size' WHEN 3 THEN 'missing' END AS status FROM f WHERE k % 5 IN (1, 2, 3)
UNION ALL SELECT concat('pages/', k, '.more.html'), 'unexpected' FROM f WHERE k % 5 = 3""")
def _(spark, sf):
    # files with planted faults against a manifest of what they should be: a changed byte, a byte too many, another name
    path, m = new_scratch_path(spark, "files"), F.col("k") % 5
    files = page_files(spark, sf)
    name = lambda end: F.concat(F.lit("pages/"), F.col("k").cast("string"), F.lit(end))
    changed = F.when(m == 1, F.concat(F.lit("#"), F.substring("t", 2, 2**30))).when(m == 2, F.concat("t", F.lit("#"))).otherwise(F.col("t"))
    write_files(files.select(F.when(m == 3, F.concat(F.col("k").cast("string"), F.lit(".more.html"))).otherwise(F.concat(F.col("k").cast("string"), F.lit(".html"))).alias("name"),
                             changed.alias("content")), f"{path}/pages")
    raw = F.col("t").cast("binary")
    manifest = files.select(name(".html").alias("path"), F.length(raw).alias("bytes"), F.sha2(raw, 256).alias("sha256"))
    return Q.check_hashes(hash_files(spark, path, "*.html"), manifest)


@query("q09_content_digest", FILES + " SELECT concat(k, '.html') AS path, octet_length(encode(t)) AS bytes, sha256(t) AS sha256 FROM f")
def _(spark, sf):
    path = new_scratch_path(spark, "files")
    write_files(page_files(spark, sf).select(F.concat(F.col("k").cast("string"), F.lit(".html")).alias("name"), F.col("t").alias("content")), path)
    return hash_files(spark, path)


@query("q10_id_digest", """WITH a AS (SELECT o_orderstatus AS status, o_custkey % 20 AS grp, o_orderkey AS id,
 row_number() OVER (PARTITION BY o_orderstatus, o_custkey % 20 ORDER BY o_orderkey) - 1 AS pos FROM orders),
b AS (SELECT status, grp, pos // 10000 AS pos, count(*) AS n, sha256('[' || string_agg(id::VARCHAR, ',' ORDER BY pos) || ']') AS d
 FROM a GROUP BY ALL),
c AS (SELECT status, grp, pos // 10000 AS pos, sum(n) AS n, sha256('["' || string_agg(d, '","' ORDER BY pos) || '"]') AS d FROM b GROUP BY ALL)
SELECT status, grp, CAST(sum(n) AS BIGINT) AS n, sha256('["' || string_agg(d, '","' ORDER BY pos) || '"]') AS digest FROM c GROUP BY ALL""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"),
                                          F.pmod("o_custkey", F.lit(20)).alias("grp"), "o_orderkey")
    return Q.digest_ids(o, ["status", "grp"], "o_orderkey")


@query("q11_probability_rows", f"""WITH {MEMBERS}, broken AS (SELECT tile_id, member, cls,
 CASE WHEN tile_id % 17 = 0 AND cls = 0 THEN p + 0.25 WHEN tile_id % 19 = 0 THEN 1.0 / 6 ELSE p END AS p FROM prob),
r AS (SELECT b.tile_id, b.member, sum(p) AS total, bool_and(p >= 0 AND p <= 1) AS inside, max(p) AS top,
  max(p) FILTER (WHERE cls = m.pred) AS at_pred FROM broken b JOIN member_pred m USING (tile_id, member) GROUP BY ALL),
t AS (SELECT b.tile_id, b.member, sum((b.p = r.top)::INT) AS ties FROM broken b JOIN r USING (tile_id, member) GROUP BY ALL)
SELECT r.member, count(*) AS rows, {B('sum((NOT (inside AND abs(total - 1) <= 1e-6))::INT)', 'invalid')},
 {B('sum((ties > 1)::INT)', 'tied')}, {B('sum((at_pred <> top)::INT)', 'not_maximum')}
FROM r JOIN t USING (tile_id, member) GROUP BY r.member""")
def _(spark, sf):
    t = F.col("tile_id")
    m = members(spark, sf).withColumn("prob", F.transform(
        "prob", lambda p, i: F.when((t % 17 == 0) & (i == 0), p + 0.25)
        .when(t % 19 == 0, F.lit(1.0) / 6.0).otherwise(p)))
    return keyed(Q.check_probs(m, ["member"]), ["member"], ["rows", "invalid", "tied", "not_maximum"])


@query("q12_float32_exact", """SELECT l_returnflag AS model, count(*) AS n FROM lineitem
WHERE l_discount <> l_discount::FLOAT::DOUBLE OR l_quantity <> l_quantity::FLOAT::DOUBLE GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"),
                                             F.array("l_discount", "l_quantity").alias("v"))
    return Q.check_float32(li, "v").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("q13_golden_compare", """WITH e AS (SELECT CASE WHEN p_size = 13 THEN -p_partkey ELSE p_partkey END AS k,
 p_retailprice + CASE p_size WHEN 7 THEN 0.01 WHEN 8 THEN 1e-9 ELSE 0 END AS price,
 CASE WHEN p_size = 5 THEN NULL ELSE p_size END AS size FROM part),
j AS (SELECT coalesce(a.p_partkey, e.k) AS p_partkey, a.p_partkey AS ak, e.k AS ek,
 a.p_retailprice AS ap, e.price AS ep, a.p_size AS asz, e.size AS esz FROM part a FULL JOIN e ON a.p_partkey = e.k)
SELECT p_partkey, '*' AS field, 'missing' AS status FROM j WHERE ak IS NULL
UNION ALL SELECT p_partkey, '*', 'extra' FROM j WHERE ek IS NULL
UNION ALL SELECT p_partkey, 'p_retailprice', 'value' FROM j WHERE abs(ap - ep) > 1e-6
UNION ALL SELECT p_partkey, 'p_size', 'value' FROM j WHERE ak IS NOT NULL AND ek IS NOT NULL AND asz IS DISTINCT FROM esz""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", "p_brand")
    size = F.col("p_size")
    # planted faults: shifted keys, shifted prices (one within tolerance), missing sizes
    e = p.select(
        F.when(size == 13, -F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("p_partkey"),
        (F.col("p_retailprice") + F.when(size == 7, 0.01).when(size == 8, 1e-9).otherwise(0.0)).alias("p_retailprice"),
        F.when(size != 5, size).alias("p_size"), "p_brand")
    return Q.compare_tables(p, e, ["p_partkey"], {"p_retailprice": 1e-6})


@query("q15_private_text", f"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL
 SELECT -1 - page_id, url || ' copied from /' || CASE WHEN page_id % 2 = 0 THEN 'srv/a' ELSE ' ' END || ' at 1/2 3/4'
  || CASE page_id % 3 WHEN 0 THEN ' on me@host:x' WHEN 1 THEN ' see C:{chr(92)}a or log:/var/x' ELSE ' me@host' END FROM pages),
u AS (SELECT doc_id, unnest(regexp_split_to_array(text, $p${Q.TOKEN_ENDS}$p$)) AS k FROM t),
v AS (SELECT doc_id, k, CASE WHEN contains(k, ':/') THEN list_extract(string_split(k, ':'), -1) ELSE k END AS path,
  substr(k, strpos(k, '@') + 1) AS rest FROM u WHERE NOT contains(k, '://'))
SELECT DISTINCT doc_id, 'text' AS "column", CASE WHEN starts_with(path, '/') AND translate(substr(path, 2), '0123456789.', '') <> '' THEN 'unix'
 WHEN lower(substr(k, 1, 1)) BETWEEN 'a' AND 'z' AND substr(k, 2, 2) = ':' || chr(92)
  OR strpos(k, '@') > 1 AND strpos(rest, ':') > 1 THEN 'drive_or_host' END AS kind
FROM v WHERE kind IS NOT NULL""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    p = table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("doc_id"),
        F.concat(F.col("url"), F.lit(" copied from /"), F.when(F.col("page_id") % 2 == 0, "srv/a").otherwise(" "),
                 F.lit(" at 1/2 3/4"), F.when(F.col("page_id") % 3 == 0, " on me@host:x")
                 .when(F.col("page_id") % 3 == 1, " see C:\\a or log:/var/x").otherwise(" me@host")).alias("text"))
    return Q.find_private(d.unionByName(p), ["doc_id"])


@query("q16_geometry", f"""WITH {COORD}
SELECT tile_id, 'short' AS reason FROM coord WHERE tile_id % 9 = 1
UNION ALL SELECT tile_id, 'open' FROM coord WHERE tile_id % 7 = 0 OR tile_id % 9 = 1
UNION ALL SELECT tile_id, 'range' FROM coord WHERE lon - 180 + 1.5 > 180 OR lat + 1.5 > 90 AND tile_id % 9 <> 1
UNION ALL SELECT tile_id, 'sector' FROM coord WHERE NOT (lon >= tile_id % 5 * 72 AND lon < (tile_id % 5 + 1) * 72)""")
def _(spark, sf):
    c = coordinates(spark, sf).withColumn("x", F.col("lon") - 180.0)
    pt = lambda dx, dy: F.struct((F.col("x") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))
    t = F.col("tile_id")
    corners = F.array(pt(0.0, 0.0), pt(1.5, 0.0), pt(1.5, 1.5), pt(0.0, 1.5))
    ring = (F.when(t % 9 == 1, F.array(pt(0.0, 0.0), pt(1.5, 0.0)))
            .when(t % 7 == 0, corners).otherwise(F.concat(corners, F.array(pt(0.0, 0.0)))))
    rings = Q.check_geometry(c.withColumn("ring", ring), "tile_id")
    points = Q.check_sector_points(c.withColumn("sector", F.pmod(t, F.lit(5))), "tile_id", "lon", "sector", 5)
    return rings.unionByName(points.withColumn("reason", F.lit("sector")))


@query("q17_curve_validity", CURVE + f""" SELECT model, fold::BIGINT AS fold, {R('threshold')}, 'precision' AS reason
 FROM curve WHERE CAST(threshold AS BIGINT) % 10 = 3 AND tp > 0
UNION ALL SELECT model, fold::BIGINT, threshold, 'recall' FROM curve WHERE CAST(threshold AS BIGINT) % 10 = 7""")
def _(spark, sf):
    # planted faults: a doubled precision and a doubled recall
    t = F.col("threshold").cast("bigint") % 10
    c = (score_curve(spark, sf)
         .withColumn("precision", F.when(t == 3, F.col("precision") * 2).otherwise(F.col("precision")))
         .withColumn("recall", F.when(t == 7, F.col("recall") * 2).otherwise(F.col("recall"))))
    bad = Q.check_curve(c, ["model", "fold"])
    return keyed(bad, ["model", "fold", "reason"], (), ["threshold"])


@query("q18_feature_meta", """WITH m AS (SELECT label, count(*) AS n_features, max(len(embedding)) AS dim FROM embeddings GROUP BY label)
SELECT label::BIGINT AS label, 'n_features' AS field, 'value' AS status FROM m WHERE n_features <> 50
UNION ALL SELECT label::BIGINT, 'revision', 'value' FROM m WHERE label % 4 = 0""")
def _(spark, sf):
    f = features(spark, sf)
    meta = f.groupBy("label").agg(F.count(F.lit(1)).alias("n_features"), F.max(F.size("f")).alias("dim")).withColumn(
        "revision", F.when(F.col("label") % 4 != 0, "r1"))
    expected = f.select("label").distinct().select(
        "label", F.lit(50).cast("bigint").alias("n_features"), F.lit(64).alias("dim"), F.lit("r1").alias("revision"))
    return keyed(Q.check_feature_meta(meta, expected, "label"), ["label", "field", "status"])


@query("q19_field_projection", """SELECT e.event_id, e.user_id AS who_user_id, e.event_type AS what_kind FROM events e""")
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.struct("user_id", "ts").alias("who"),
        F.struct(F.col("event_type").alias("kind"), "props").alias("what"))
    return Q.pick(e, ["event_id", "who.user_id", "what.kind"])


@query("q21_optional_values", """SELECT vec_id FROM embeddings WHERE vec_id % 6 IN (1, 2, 3)""")
def _(spark, sf):
    m = F.pmod("vec_id", F.lit(6))
    first = F.slice(S.as_doubles("f"), 1, 3)
    t = features(spark, sf).select(
        "vec_id", (m <= 2).alias("has"),
        F.when(m == 0, first).when(m == 1, F.slice(first, 1, 2))
        .when(m == 2, F.array(F.lit(0.0), F.lit(float("nan")), F.lit(0.0))).when(m == 3, first).alias("v"))
    return Q.check_optional(t, "has", "v", 3).select("vec_id")
