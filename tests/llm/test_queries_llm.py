"""Registered queries of the llm package beside their SQL, and against brute force where SQL cannot say it."""

import re
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tilescope.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def run(spark, name, sf):
    df = entry.queries()[name](spark, sf)
    return df.columns, [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, sf, name):
    cols, got = run(spark, name, sf)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(cols)
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def test_all_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and "pipeline" in entry.queries()


def test_op1_law(spark, sf, con):
    cols, rows = run(spark, "op1_sharding", sf)
    rows = [dict(zip(cols, r)) for r in rows]
    own = texts(con)
    assert all(r["text_crc32"] == zlib.crc32(own[r["doc_id"]].encode()) and r["size"] == len(own[r["doc_id"]].encode()) + 16 for r in rows)
    assert all(0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40) for r in rows)
    for k in range(40):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_op2_targets(spark, sf):
    cols, rows = run(spark, "op2_mixing", sf)
    taken, target = Counter(), {}
    for r in rows:
        r = dict(zip(cols, r))
        assert 0 <= r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        target[key] = r["target"]
    assert all(v % int(target[k]) == 0 for k, v in taken.items())
    assert abs(sum(target[k] * (taken[k] // int(target[k])) for k in taken) - 1.5 * sum(r[cols.index("size")] for r in rows)) < 1


def test_op8_statistics(spark, sf, con):
    cols, rows = run(spark, "op8_quality_rules", sf)
    own, n = texts(con), 0
    for r in rows:
        r = dict(zip(cols, r))
        text = own[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        count = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert want == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])
        n += 1
    assert n == len(own)


def test_op9_brute_force(spark, sf, con):
    import xxhash

    cols, rows = run(spark, "op9_simhash", sf)
    got = {r[0]: dict(zip(cols, r)) for r in rows}
    prints = {}
    for i, text in texts(con).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
    first = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and first[b] < first[a]:
                    first[a], changed = first[b], True
    assert {i: g["component_id"] for i, g in got.items()} == first


def test_op7_held_out(spark, sf, con):
    cols, rows = run(spark, "op7_language_id", sf)
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [dict(zip(cols, r)) for r in rows]
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.95 * len(out)


def test_op6_labels(spark, con):
    cols, rows = run(spark, "op6_toxicity", "/root/testdata/sf0.01")
    known = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = [dict(zip(cols, r)) for r in rows]
    clean = [r for r in rows if known.get(r["doc_id"]) == 0]
    assert sum(r["toxic"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["severity"] <= 3 and 0 <= r["p_toxic"] <= 1 for r in rows)
    bad = [r for r in rows if known.get(r["doc_id"]) == 1]
    assert sum(r["toxic"] for r in bad) >= 0.5 * len(bad)


def test_op4_exact(spark, sf, con):
    cols, rows = run(spark, "op4_sentencepiece", sf)
    assert len(rows) == len(texts(con)) and all(r[cols.index("exact")] for r in rows)
