"""Odd rows, empty tables and the methods' own promises, on small inputs."""

import itertools
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescope.llm import common, embeddings, language, lines, links, mixing, pieces, quality, sharding, simhash, similar, toxicity


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_jump_hash_moves_only_into_the_new_shard(spark):
    keys = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("k"))
    for n in (1, 2, 7):
        got = rows(keys.select("k", sharding.jump(F.col("k"), n).alias("a"), sharding.jump(F.col("k"), n + 1).alias("b")))
        assert all(r["a"]["grown"] == r["b"]["shard"] and r["b"]["shard"] in (r["a"]["shard"], n) for r in got)
        moved = sum(r["b"]["shard"] == n for r in got)
        assert abs(moved - 2000 / (n + 1)) < 6 * (2000 / (n + 1)) ** 0.5


def test_sharding_odd(odd, empty):
    got = rows(sharding.shard_documents(odd, 3))
    assert len(got) == odd.count() and sharding.shard_documents(empty, 3).count() == 0
    assert {r["text_crc32"] for r in got if r["size"] == 16} == {None, 0}
    for k in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_schedule_inverts_its_integral(spark):
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 0.0), (0.25, 2.0), (0.5, 2.0), (1.0, 0.5))])
    segments = mixing.integrate(knots)
    got = spark.range(101).select((F.col("id") / 100).alias("s"), mixing.invert(segments, F.col("id") / 100).alias("t")).collect()
    grid = np.linspace(0, 1, 20001)
    area = np.concatenate(([0], np.cumsum(np.diff(grid) * np.interp((grid[1:] + grid[:-1]) / 2, [0, 0.25, 0.5, 1], [0, 2, 2, 0.5]))))
    assert all(abs(np.interp(r["t"], grid, area / area[-1]) - r["s"]) < 1e-3 for r in got)
    assert all(a["t"] <= b["t"] for a, b in itertools.pairwise(got))


def test_mixing_odd(odd, empty):
    got = rows(mixing.mix_counts(odd))
    assert len(got) == odd.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    assert max(r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()) <= 4  # a repeated row, twice


def test_mixing_fills_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000}
    docs = spark.createDataFrame([(i, "w " * 10, s) for s, n in sizes.items() for i in range(n // 10)], "doc_id long, text string, source string")
    targets = {r["source_size"] * 10 + k: r["target"] for k, r in enumerate(rows(mixing.mix_counts(docs).select("source_size", "target").distinct()))}
    assert sorted(round(v) for v in targets.values()) == [20, 998, 1995 + 2]  # a is capped; b and c share 2 to 1
    assert abs(sum(targets.values()) - 1.5 * 2010) < 1e-6


def test_covering_masks_cover():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    assert len(masks) == 31
    rng = np.random.default_rng(0)
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(m & diff == 0 for m in masks)


def test_components_against_search(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    first = {n: n for p in pairs for n in p}
    for _ in range(400):
        for a, b in pairs:
            first[a] = first[b] = min(first[a], first[b])
    assert got == {n: f for n, f in first.items() if n != f}


def test_simhash_odd(odd, empty, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 2)
    got = rows(simhash.near_duplicates(odd))
    assert len(got) == odd.count() and simhash.near_duplicates(empty).count() == 0
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {3}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r["component_id"] for r in got})
    assert simhash.drop_near_duplicates(empty).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = base[:30] + rng.normal(size=(30, 16)) * 0.05
    out = [(i, [float(v) for v in x], i % 3) for i, x in enumerate(np.vstack([base, near, base[:10]]))]
    out += [(100 + i, out[i][1], out[i][2]) for i in range(5)]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] + [1.0] * 15, 1), (204, [], 1), (205, out[0][1], None),
           (None, out[1][1], 1), (206, [1.0] * 8, 1), (207, [1e200] * 16, 1), (207, [1e200] * 16, 1)]
    return out + odd


@pytest.mark.parametrize("block", [3, 2048])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    data = vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("rid", F.lit("clash")).withColumn("vector", F.lit(1))
    got = sorted((repr(tuple(r)) for r in embeddings.near_vectors(df).collect()))

    def unit(e):
        if e is None or not e or any(v is None or not np.isfinite(v) for v in e) or not any(e):
            return None
        x = np.array(e) / np.abs(e).max()
        return x / np.linalg.norm(x)

    units = [unit(e) for _, e, _ in data]
    n = len(data)
    link = [[i != j and units[i] is not None and units[j] is not None and data[i][2] is not None and data[i][2] == data[j][2]
             and len(units[i]) == len(units[j]) and bool(units[i] @ units[j] >= 0.98) for j in range(n)] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((data[i][0] for i in range(n) if group[i] == g and data[i][0] is not None), default=None) for g in set(group)}
    want = sorted(repr((data[i][0], int(sum(link[i])), least[group[i]], data[i][0] == least[group[i]])) for i in range(n))
    assert got == want
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2100))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, n, e = embeddings.quantise(x)
    error = np.abs(x @ x.T - embeddings.code_products(q, q) * np.outer(s, s))
    assert (error <= np.outer(n, e) + e[:, None] + embeddings.SLACK).all()


def test_lines_odd(spark, odd, empty):
    got = lines.clean_lines(odd, min_sites=3)
    assert got.columns == odd.columns and got.count() == odd.count() and lines.line_report(odd, min_sites=3).count() == odd.count()
    assert lines.line_report(empty).count() == 0
    docs = spark.createDataFrame([(i, f"own {i}\n  shared \n\nshared\nlast {i}", f"s{i % k}") for k in (9, 10, 11) for i in range(40)], "doc_id long, text string, source string")
    for k, gone in ((9, False), (10, True), (11, True)):
        part = docs.where(F.expr(f"source in ({', '.join(repr(f's{j}') for j in range(k))})"))
        text = lines.clean_lines(part).where("doc_id = 1").first()["text"]
        assert text == ("own 1\n\nlast 1" if gone else "own 1\n  shared \n\nshared\nlast 1")


def test_language_odd(spark, odd, empty):
    got = rows(language.language_report(odd))
    assert len(got) == odd.count() and language.language_report(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 6))
    assert by[10]["lang_pred"] in ("en", "de") and all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for r in got)
    assert language.keep_languages(odd).columns == odd.columns


def test_language_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang in ('en', 'de')")
    en, de = (docs.where(f"lang = '{k}' and n_chars > 1500").first()["text"].split()[:40] for k in ("en", "de"))
    mixed = docs.unionByName(spark.createDataFrame([(-1, " ".join(en + de), None, None, None)], docs.schema))
    spans = language.identify(mixed, F.lit(True), spans=True).where("doc.doc_id = -1").first()["language"]["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[0]["words"] - 40) <= 2


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(4)
    words = np.array([4, 0, 6, 1])
    scores = rng.normal(size=(11, 3)).astype(np.float32) * 2
    got, at = language.viterbi(scores, words, switch=1.5), 0
    for n in words:
        own = scores[at:at + n]
        value = lambda p: sum(own[i, k] for i, k in enumerate(p)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))
        if n:
            assert abs(value(got[at:at + n]) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-4
        at += n


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = rows(quality.quality_report(odd, labels))
    assert len(got) == odd.count() and quality.quality_report(empty, labels).count() == 0
    assert quality.quality_report(odd, labels.where("false")).where("kept").count() > 0
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (3, 4, 6))


def test_decision_list_learns_a_conjunction(spark):
    rng = np.random.default_rng(5)
    data = [(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(rng.integers(10, 500, 3000), rng.random(3000), rng.random(3000)))]
    base = spark.createDataFrame(data, "doc_id long, n_words long, symbol_share double, upper_share double")
    features = base.select("*", *[F.lit(0.0).alias(f) for f in quality.FEATURES if f not in base.columns])
    labels = base.select("doc_id", F.when((F.col("symbol_share") > 0.6) & (F.col("upper_share") > 0.5), 0).otherwise(1).alias("quality"))
    rules = quality.learn_decision_list(features, labels)
    wrong = features.join(labels, "doc_id").where(quality.rejected(rules) != (F.col("quality") == 0)).count()
    assert rules and wrong < 0.06 * 3000


def test_urls(spark, empty):
    got = links.split_url(F.col("u"))
    cases = {"http://A.B/c?d#e": ("a.b", "/c"), "x://h#f": ("h", ""), "https://h?q/://": ("h", ""), "no scheme": ("", ""), None: ("", ""), "a://b://c": ("b:", "//c")}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", got[0].alias("h"), got[1].alias("p"))
    assert {r["u"]: (r["h"], r["p"]) for r in df.collect()} == cases
    page = lambda i, url, *to: (i, url, "".join(f'<a HREF="{t}">x</a>' for t in to))
    pages = spark.createDataFrame([
        page(1, "http://good.org/fr/1", "http://friend.info/", "/own"), page(2, "http://friend.info/x"),
        page(3, "http://bad.net/1"), page(4, "http://fan.info/x", "//bad.net/1", "mailto:a@b"), page(5, "http://alone.info/", "rel"),
        page(6, "http://sub.example.net/en/1"), page(7, "http://notnet/"), page(8, None), page(9, "http://bad.net/1"), (None, "http://bad.net/2", None)],
        "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rules", F.lit(1))
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in links.judge_urls(pages, rules).collect()}
    assert got == {1: ("org/fr/", "allow"), 2: (None, "allow"), 3: ("net/", "block"), 4: (None, "block"), 5: (None, "allow"),
                   6: ("example.net/en/", "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("net/", "block"), None: ("net/", "block")}
    assert links.judge_urls(pages.where("false"), rules).count() == 0


def test_spread_against_matrix(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 3, (8, 8)) * (rng.random((8, 8)) < 0.4)
    np.fill_diagonal(a, 0)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(a[i, j])) for i in range(8) for j in range(8) if a[i, j]], "source string, target string, n long")
    seeds = spark.createDataFrame([("h0", 3, 0), ("h1", 0, 2), ("h2", 1, 1)], "host string, allowed long, blocked long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in links.spread(seeds, edges).collect()}

    def walk(m, s):
        m, total, step = m / np.maximum(m.sum(axis=1, keepdims=True), 1), 0, np.array(s, float)
        for _ in range(400):
            total, step = total + step, 0.85 * step @ m
        return 0.15 * total

    t, d = walk(a.astype(float), [3, 0, 1] + [0] * 5), walk(a.T.astype(float), [0, 2, 1] + [0] * 5)
    assert all(abs(got.get(f"h{i}", (0, 0))[0] - t[i]) < 1e-9 and abs(got.get(f"h{i}", (0, 0))[1] - d[i]) < 1e-9 for i in range(8))


def test_mass_reaches_the_end_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(links, "FOLD", 3)
    page = lambda i, j: (i, f"http://h{i}.info/", f'<a href="http://h{j}.info/">x</a>')
    pages = spark.createDataFrame([*[page(i, i + 1) for i in range(60)], (60, "http://h60.info/", '<a href="http://bad.net/">x</a>'), (61, "http://bad.net/", None)],
                                  "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in links.judge_urls(pages, [("block", "net", "/")]).collect()}
    assert set(got.values()) == {"block"} and len(got) == 62


def test_a_long_url_costs_its_length(spark):
    host = "a." * 500_000 + "sub.net"
    pages = spark.createDataFrame([(1, f"http://{host}/x", None), (2, "http://x.y/" + "p/" * 400_000, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in links.judge_urls(pages, [("block", "net", "/"), ("allow", "a.sub.net", "/x")]).collect()}
    assert (got[1]["rule"], got[1]["verdict"], got[2]["verdict"]) == ("a.sub.net/x", "allow", "allow")
    assert links.judge_urls(pages, []).where("verdict = 'allow' and rule is null").count() == 2


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert len(rows(toxicity.grade_toxicity(odd, labels))) == odd.count()
    assert toxicity.grade_toxicity(empty, labels).count() == 0
    assert not any(r["toxic"] for r in rows(toxicity.grade_toxicity(odd, labels.where("false"))))


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 5, (600, 3))
    grades = np.digitize(x @ [1.0, 0.0, -0.5] + rng.normal(size=600) * 0.3, [0.5, 1.5, 2.5])
    weights, cuts = toxicity.fit_ordinal([(list(range(3)), r.astype(float).tolist()) for r in x], grades, 3, 4)
    assert (np.diff(cuts) > 0).all() and weights[0] > 0 > weights[2] and abs(weights[1]) < 0.3 * weights[0]


def test_ordinal_fit_is_at_the_optimum():
    """The likelihood written out row by row: its slope at the fit is zero in every direction, and no other point tried is better."""
    rng = np.random.default_rng(17)
    x = rng.integers(0, 4, (300, 4)).astype(float)
    grades = np.digitize(x @ [0.8, -0.4, 0.0, 0.3] + rng.logistic(size=300), [0.0, 1.0, 2.0])
    rows = [(np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in x]

    def value(w, cuts):
        total = 0.0
        for (at, v), g in zip(rows, grades):
            score = sum(w[i] * k for i, k in zip(at, v))
            upto = [0.0, *(1 / (1 + np.exp(score - c)) for c in cuts), 1.0]
            total += np.log(upto[g + 1] - upto[g])
        return total / len(rows) - toxicity.L2 / 2 * float(w @ w)

    w, cuts = toxicity.fit_ordinal(rows, grades, 4, 4)
    best = value(w, cuts)
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-4
        slope = (value(w + step[:4], cuts + step[4:]) - value(w - step[:4], cuts - step[4:])) / 2e-4
        assert abs(slope) < 2e-3
    for _ in range(40):
        move = rng.normal(size=7) * 0.3
        if (np.diff(cuts + move[4:]) > 0).all():
            assert value(w + move[:4], cuts + move[4:]) < best + 1e-9
    model = toxicity.OrdinalModel(["a", "b", "c", "d"], w, cuts)
    score = w[0] * np.log1p(2) + w[1] * np.log1p(1)
    assert np.allclose(np.cumsum(model.grades("A b a z"))[:3], 1 / (1 + np.exp(score - cuts)))


def test_rules_grow_and_prune_as_rows_say(spark):
    rng = np.random.default_rng(19)
    names = ("n_words", "symbol_share", "upper_share")
    x = np.round(rng.random((400, 3)), 2)
    bad = ((x[:, 0] > 0.5) & (x[:, 1] < 0.6)) ^ (rng.random(400) < 0.1)
    cuts = {n: [0.2, 0.4, 0.6, 0.8] for n in names}
    data = [(bool(b), *map(float, r), *(int(sum(v > c for c in cuts[n])) for n, v in zip(names, r))) for b, r in zip(bad, x)]
    df = spark.createDataFrame(data, ["bad", *names, *(f"bin_{n}" for n in names)])
    side = lambda i, above, cut: x[:, i] > cut if above else x[:, i] <= cut
    conditions, covered = [], np.ones(400, bool)
    while (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        gain, best = 1e-9, None
        for i, n in enumerate(names):
            for cut in cuts[n]:
                for above in (False, True):
                    p, q = (covered & side(i, above, cut) & bad).sum(), (covered & side(i, above, cut) & ~bad).sum()
                    own = p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                    if own > gain + 1e-12:
                        gain, best = own, (i, above, cut)
        if best is None:
            break
        conditions.append(best)
        covered &= side(*best)
    rule = quality._grow(df, cuts)
    assert rule.conditions == tuple((names[i], a, c) for i, a, c in conditions) and len(conditions) >= 2
    scores = []
    for k in range(1, len(conditions) + 1):
        inside = np.all([side(*c) for c in conditions[:k]], axis=0)
        p, q = int((inside & bad).sum()), int((inside & ~bad).sum())
        scores.append(((p - q) / max(p + q, 1), -k, p, q))
    want = max(scores)
    pruned, p, q = quality._prune(df, rule)
    assert (len(pruned.conditions), p, q) == (-want[1], want[2], want[3])


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.PieceModel(f.read())


def test_n_best_against_enumeration(model):
    def every(part):
        edges, out = {}, []
        for i, j, score, ids in model.edges(part):
            edges.setdefault(i, []).append((j, score, ids))

        def go(i, score, ids):
            if i == len(part):
                out.append((score, ids))
            for j, s, x in edges.get(i, []):
                go(j, score + s, ids + x)
        go(0, 0.0, ())
        return sorted(out, key=lambda c: -c[0])

    for part in (" hello", " theanes", "漢字", " a▁b", " über", " aaaaaaa", "\n", "  two"):
        want, got = every(part), model.n_best(part, 5)
        assert np.allclose([g[0] for g in got], [w[0] for w in want[:5]])
        assert len({g[1] for g in got}) == len(got)
        assert np.isclose(model.best(part)[0], want[0][0])
    text = " hello\n theanes"
    score, ids, found = model.encode(text[1:], 6)
    assert np.allclose([score, *[s for s, _ in found]], [w[0] for w in every(text)[:6]])
    ids = np.frombuffer(ids, "<i4").tolist()
    for _, edits in found:
        other = list(ids)
        for at, dropped, new in sorted(edits, reverse=True):
            other[at:at + dropped] = new
        assert model.decode(np.array(other, "<i4").tobytes()) == text[1:]


def test_a_long_line_without_spaces(model):
    rng = np.random.default_rng(13)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz漢"), 200_000))
    score, ids, found = model.encode(text, 4)
    assert model.decode(ids) == text and len(found) == 3 and all(s <= score for s, _ in found)
    assert np.isclose(model.forward(" " + text)[0][-1], score)


def test_parts_of_many_texts_as_alone(model):
    parts = {" hello", " theanes", "漢字", " über", " aaaaaaa", "\n", "  two", " x漢y"}
    together = model.best_of(parts)
    model.find_alternatives(parts, 4)
    for part in parts:
        assert together[part] == model.best(part)
        assert model.alternatives[part, 4] == model.n_best(part, 4)


def test_pieces_odd(odd, empty):
    got = rows(pieces.piece_report(odd))
    assert len(got) == odd.count() and all(r["exact"] for r in got) and pieces.piece_report(empty).count() == 0
    assert {r["n_pieces"] for r in got if r["doc_id"] in (3, 6)} == {0}
    shared = pieces.load(odd)
    coded = pieces.encode(odd, shared, 2, carry=("doc_id", "score")).withColumn("back", pieces.decode(F.col("ids"), shared))
    assert all(r["back"] == (r["text"] or "") for r in coded.select("text", "back").collect())


def test_pipeline_stages(spark, sf, odd, empty):
    import corpus_pipeline as P

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, empty, sf).columns == empty.columns
    assert P.STAGES[-1][1](spark, empty, sf).count() == 0
    kept = P.language_id(spark, docs, sf)
    assert {3, 4, 5, 6}.isdisjoint(r["doc_id"] for r in kept.collect())
    out = P.run(spark, sf).collect()
    assert out and all(r["exact"] for r in out)


def test_pipeline_keeps_one_of_a_group_on_many_sources(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    body = [" ".join(f"walk{i}x{j} the dog and the fox" for j in range(6)) for i in range(10)]
    common = "all rights are kept by the people who wrote this and the other page"
    text = lambda k: "\n".join([*body[:k], f"line {k} was edited and is not the same", *body[k + 1:]])
    made = ([(10_000 + i, "\n".join(body), "en", f" a{i:02d}", 1) for i in range(11)] + [(10_100 + i, text(i % 10), "en", f" a{i:02d}", 1) for i in range(11)]
            + [(10_200 + i, f"{common}\nthe house of number {i} was near the river {i * 7}", "en", f" a{i:02d}", 1) for i in range(11)])
    folder = tempfile.mkdtemp(prefix="spark-")
    more = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r["doc_id"]: r["text"] for r in P.line_dedup(spark, docs, folder).where("doc_id >= 10000").collect()}
    assert all(clean[d] == t for d, t, *_ in made if d < 10_200) and not any(common in clean[d] for d in clean)
    out = P.run(spark, folder).collect()
    kept = {r["doc_id"] for r in out if 10_000 <= r["doc_id"] < 10_200}
    assert 10_000 in kept and not kept & set(range(10_001, 10_011))


def test_pipeline_takes_boilerplate_from_different_articles(spark, sf):
    import corpus_pipeline as P

    rng = np.random.default_rng(11)
    common = [f"notice {k}: " + " ".join(f"word{k}x{j}" for j in range(25)) for k in range(3)]
    article = lambda i: " ".join(f"the tale{i} and of fact{j}" for j in rng.integers(0, 10**6, 6))
    body = "\n".join(" ".join(f"walk{i}y{j} the dog" for j in range(8)) for i in range(8))
    made = ([(i, "\n".join([common[0], article(i), *common[1:]]), "en", f"a{i:02d}", 1) for i in range(12)]
            + [(100 + i, body, "en", f"a{i:02d}", 1) for i in range(11)]
            + [(200 + i, body.replace(f"walk{i % 8}y3", f"edit{i}"), "en", f"a{i:02d}", 1) for i in range(11)])
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    share = sum(map(len, common)) / len(made[0][1])
    assert 0.7 < share < 0.85
    clean = {r["doc_id"]: r["text"] for r in P.line_dedup(spark, docs, sf).collect()}
    assert not any(line in clean[i] for i in range(12) for line in common) and all("tale" in clean[i] for i in range(12))
    assert all(clean[d] == t for d, t, *_ in made if d >= 100)
    kept = {r["doc_id"] for r in P.near_dedup(spark, P.line_dedup(spark, docs, sf), sf).collect()}
    assert set(range(12)) < kept and len(kept & set(range(100, 300))) == 1


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = [bytes(x) for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_dedup_stage_against_all_pairs(spark, odd, tile, monkeypatch):
    import corpus_pipeline as P

    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "CHARS", tile * 1000)
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 400, rng.integers(30, 120))]
        texts += [" ".join(base), " ".join(base).upper() + " "]
        for edits in (1, 2, 3, 5):
            own = list(base)
            for at in rng.integers(0, len(base), edits):
                own[at] = "edited"
            texts.append(" ".join(own))
    texts += ["", " \n", None, "a b", "A  b", "a b c"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8 or not (texts[i] or "").strip() and not (texts[j] or "").strip():
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    kept = sorted(r["doc_id"] for r in P.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(root)) and 20 < len(kept) < len(texts) - 20
    assert P.near_dedup(spark, odd, "").columns == odd.columns


def test_near_dedup_stage_links_by_simhash(spark, monkeypatch):
    import corpus_pipeline as P

    monkeypatch.setattr(similar, "band_pairs", lambda texts: texts.sparkSession.createDataFrame([], "u string, v string").transform(lambda d: common.keep(d, "none")))
    base = [f"w{k}" for k in np.random.default_rng(4).integers(0, 5000, 900)]
    edited = [*base[:500], "edited", *base[501:]]
    texts = [" ".join(base), " ".join(edited), " ".join(base).upper(), " ".join(base[:600]), "another text of a few words"]
    fps = [simhash.majority([similar.shingles(t)]) & (1 << 64) - 1 for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= simhash.RADIUS < (fps[0] ^ fps[4]).bit_count()
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()) == [0, 3, 4]


def test_pipeline_encodes_with_alternatives(spark, sf):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "", "en", "a", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in P.encode(spark, docs, sf).collect()}
    assert len(got[1]["alternatives"]) == pieces.N_BEST - 1 and all(a["score"] <= got[1]["score"] and a["edits"] for a in got[1]["alternatives"])
    assert got[2]["alternatives"] == [] and got[1]["exact"] and got[2]["exact"]
