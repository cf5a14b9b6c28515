"""Periodic runs, token files and source divergence: brute force, damaged files, odd rows and empty tables."""

import hashlib
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilescope.llm import divergence, periodic, spans, token_files
from tilescope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- words ---------------------------------------------------------------------------------

def test_words_as_arrays():
    texts = ["", None, " a  b\n", "é\x00 \x1c", "x", "\t", "y z"]
    got, n = spans.words(pa.array(texts))
    assert [v.decode() for v in got.to_pylist()] == [w for t in texts for w in WORD.findall(t or "")]
    assert n.tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert [(i, j) for i, j in spans.slices(pa.array(texts), 3)] == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert spans.words(pa.array([], pa.string()))[1].tolist() == [] and list(spans.slices(pa.array([], pa.string()))) == []


# ---- op11 ----------------------------------------------------------------------------------

def brute_runs(w):
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(24, 3 * q) and not any(all(w[k] == w[k + c] for k in range(s, s + length - c)) for c in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(v for k, v in enumerate(w) if k not in gone)


def test_runs_against_every_period():
    rng, seen = random.Random(1), 0
    for _ in range(60):
        texts = [None, ""]
        for _ in range(6):
            parts = []
            for _ in range(rng.randint(0, 5)):
                base = [rng.choice("abcdefghijklmnopqrst"[:rng.choice([1, 2, 3, 20])]) for _ in range(rng.randint(1, 20))]
                parts += (base * rng.randint(1, 9))[:rng.randint(1, 90)]
            texts.append("  ".join(parts))
        for text, got in zip(texts, periodic.runs_of_texts(pa.array(texts)).to_pylist()):
            w = (text or "").split()
            want = brute_runs(w)
            assert [(r["start"], r["length"], r["period"]) for r in got["runs"]] == want
            assert got["collapsed"] == collapse(w, want)
            seen += len(want)
    assert seen > 200


def test_split_keeps_only_what_can_repeat():
    words = [str(k) for k in range(500)] + ["p", "q"] * 12 + [str(k) for k in range(500)]  # every number twice
    code = np.unique(words, return_inverse=True)[1]
    at, part = periodic.split(code, np.zeros(len(words), np.int64))
    assert at.tolist() == list(range(500, 524)) and len(set(part.tolist())) == 1


def test_run_lengths_at_the_limits():
    for text, n in (("a " * 23, 0), ("a " * 24, 1), (("a b c d e f g h " * 3), 1), (("a b c d e f g h i " * 3)[:-2], 0), (("a b c d e f g h i " * 3), 1)):
        assert len(periodic.runs_of_texts(pa.array([text])).to_pylist()[0]["runs"]) == n


def test_a_long_text_of_few_words():
    text = " ".join(random.Random(2).choice("ab") for _ in range(200_000)) + " x y z" * 50_000
    runs = periodic.runs_of_texts(pa.array([text])).to_pylist()[0]["runs"]
    assert runs[-1] == {"start": 200_000, "length": 150_000, "period": 3}


def test_find_runs_odd(odd, empty):
    got = rows(periodic.find_runs(odd))
    assert len(got) == odd.count() and periodic.find_runs(empty).count() == 0 and periodic.run_report(empty).count() == 0
    for r in got:
        assert r["collapsed"] == collapse(WORD.findall(r["doc"]["text"] or ""), [(x["start"], x["length"], x["period"]) for x in r["runs"]])
    assert any(r["runs"] for r in got)
    same = periodic.collapse_documents(odd)
    assert same.columns == odd.columns and same.count() == odd.count()
    twice = odd.withColumn("doc", F.lit(1)).withColumn("runs", F.lit("r")).withColumn("collapsed", F.lit("c")).withColumn("_r", F.lit("c"))
    assert periodic.collapse_documents(twice).columns == twice.columns
    report = rows(periodic.run_report(odd))
    assert all(len(r["runs_sha256"]) == 64 and len(r["collapsed_sha256"]) == 64 for r in report)


def test_op11_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in rows(QUERIES["op11_periodic_runs"](spark, sf))}
    own = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert len(got) == len(own)
    n_runs = 0
    for i, text in own.items():
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 2_000:
            continue
        runs = brute_runs(w)
        n_runs += len(runs)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        lines = "".join("%d,%d,%d\n" % r for r in runs)
        want = {"doc_id": i, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if runs else None,
                "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapse(w, runs).encode()).hexdigest()}
        assert got[i] == want
    assert n_runs > 5


# ---- op12 ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_stretches_have_the_ids_of_their_text(tokenizer):
    rng = random.Random(3)
    chars = [" ", " ", "  ", "\n", "\t", " ", " ", "　", "\x85", "\x1c", "\x00", "a", "b", "é", "и", "р", "中", "\U0001F600", "1", "'s", "'ll", ".",
             "<|endoftext|>", "​", " ", " ", " ", " ", " \n", "\r\n", "ā", "„"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(4_000)] + [None, ""]
    ids, n = token_files.token_ids(pa.array(texts))
    ends = np.cumsum(n)
    for text, end, k in zip(texts, ends, n):
        assert ids[end - k:end].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_frames_unpack_alone(tmp_path):
    import zstandard
    path = tmp_path / "a.zst"
    ids = np.arange(1_000, dtype=np.uint32) * 7
    with open(path, "wb") as f:
        w = token_files.FrameWriter(f, 64)
        for part in np.split(ids, [3, 3, 200, 999]):
            w.write(part)
        w.finish()
    with open(path, "rb") as f:
        r = token_files.FrameReader(f)
        assert len(r.table) == 16 and r.read(130, 40) == ids[130:170].astype("<u4").tobytes() and r.unpacked == 1
        assert r.read(190, 3) == ids[190:193].astype("<u4").tobytes() and r.unpacked == 2  # the frame at hand is used again
        assert r.read(0, 1_000) == ids.astype("<u4").tobytes() and r.read(1_000, 0) == b""
        with pytest.raises(ValueError):
            r.read(999, 2)
    with open(path, "rb") as f:  # any tool unpacks it: the table is a frame to skip
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain == ids.astype("<u4").tobytes()


def test_damage_is_found(tmp_path):
    import io
    out = io.BytesIO()
    w = token_files.FrameWriter(out, 64)
    w.write(np.random.default_rng(0).integers(0, 50_000, 640).astype(np.uint32))
    w.finish()
    good = bytearray(out.getvalue())
    bad = bytearray(good)
    bad[-9 - 4] ^= 1  # the last frame's checksum
    r = token_files.FrameReader(io.BytesIO(bytes(bad)))
    assert len(r.read(0, 576)) == 4 * 576
    with pytest.raises(ValueError):
        r.read(576, 1)
    for cut in (good[:-1], good[:5], b""):
        with pytest.raises(ValueError):
            token_files.FrameReader(io.BytesIO(bytes(cut)))
    empty = io.BytesIO()
    token_files.FrameWriter(empty).finish()
    assert token_files.FrameReader(io.BytesIO(empty.getvalue())).read(0, 0) == b""


def test_only_wanted_frames_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i} " * 40) for i in range(200)], "doc_id long, text string").repartition(5)
    index = token_files.write_tokens(docs, str(tmp_path / "t"), frame_ids=100)
    for r in index.where("doc_id = 77").collect():
        import pyarrow.fs
        fs, path = pyarrow.fs.FileSystem.from_uri(r["file"])
        reader = token_files.FrameReader(fs.open_input_file(path))
        reader.read(r["at"], r["n_tokens"])
        assert 1 <= reader.unpacked <= 3 < len(reader.table)
    wanted = spark.createDataFrame([(5,), (77,), (77,), (1_000,)], "doc_id long")
    assert sorted(r["doc_id"] for r in token_files.find_tokens(index, wanted).collect()) == [5, 77]


def test_tokens_odd(odd, empty, tokenizer):
    got = rows(token_files.token_report(odd))
    assert len(got) == odd.count() and token_files.token_report(empty).count() == 0
    own = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    sizes = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in own)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == sizes
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r[0] for r in own]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0


def test_op12_against_the_library(spark, sf, tokenizer):
    got = {r["doc_id"]: r for r in rows(QUERIES["op12_token_files"](spark, sf))}
    start = 0
    for i, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


# ---- op13 ----------------------------------------------------------------------------------

def test_perfect_hash_is_minimal():
    import pickle
    for n in (0, 1, 2, 1_000):
        keys = [f"k{i}".encode() for i in range(n)]
        h = pickle.loads(pickle.dumps(divergence.PerfectHash(keys)))
        own = np.array(keys + [None], dtype=object)[:-1]
        assert sorted(h.find(own).tolist()) == list(range(n)) and len(h) == n
        others = np.array([f"x{i}".encode() for i in range(500)] + [None], dtype=object)[:-1]
        assert (h.find(others) == -1).all()


def test_shares_are_exact():
    rng = random.Random(5)
    pairs = [(rng.randint(1, 10**rng.randint(1, 15)), rng.randint(1, 9 * 10**15)) for _ in range(500)]
    pairs = [(min(a, b), b) for a, b in pairs] + [(9 * 10**15, 9 * 10**15), (1, 1)]
    got = divergence._shares(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [1 + 10**9 * a // b for a, b in pairs]


def brute_divergence(docs, min_docs=3, top=200):
    letters = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(r[1] or "", r[2] or "", letters.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[0] or ""))) for r in docs]
    stands, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in found:
        stands[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, n in stands[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        total = Counter()
        for (g, _), c in counts.items():
            if g == lang:
                total.update(c)
        p, q = share(own), share(total)
        pairs = []
        for (g, other), c in counts.items():
            if g == lang and other != source:
                o = share(c)
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode()))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if own[t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


def test_divergence_odd(spark, odd, empty, monkeypatch):
    assert divergence.divergences(empty).count() == 0
    want = brute_divergence(odd.select("text", "lang", "source").collect())
    assert sorted(tuple(r) for r in divergence.divergences(odd).collect()) == want
    # small shards, rounds, blocks and dense arrays change nothing
    for name, value in (("SHARD_TERMS", 4), ("ROUND_BYTES", 900), ("SLOT_BYTES", 200), ("BLOCK", 2)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(tuple(r) for r in divergence.divergences(odd).collect()) == want


def test_divergence_ties_long_terms_and_languages_without_terms(spark):
    long = "ж" * 5_000
    docs = [(f"{long} a b", "x", s) for s in ("s1", "s2", "s3")] + [("a c c", "x", "s4"), ("", "x", "s5"), ("z", "y", "s1"), ("123", "y", "s2"), (None, None, None)]
    got = sorted(tuple(r) for r in divergence.divergences(spark.createDataFrame(docs, "text string, lang string, source string")).collect())
    assert got == brute_divergence(docs)
    assert any(r[3] == long for r in got) and ("y", "s1", "pair", "s2", 0, 1) in got


def test_divergence_top_settles_ties(spark):
    docs = [(f"{a} {b} q", "x", s) for s, (a, b) in zip(("u", "u", "u", "v", "v", "v"), [("k1", "k"), ("k2", "k")] * 3)]
    docs = [(t.replace("1", "a").replace("2", "b"), lang, s) for t, lang, s in docs]
    table = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.divergences(table, top=1).collect()) == brute_divergence(docs, top=1)
