"""File digests through the data source: planted faults, nested folders, bounded pieces, files split over tasks."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tilescope.operators import quality as Q
from tilescope.session import ship_code
from tilescope.sources import files as S


@pytest.fixture
def folder(spark, tmp_path):
    ship_code(spark)
    rows = [("a.bin", bytes(range(256)) * 40_000), ("b/c.bin", b""), ("b/d.txt", "é\n".encode()), ("_hidden", b"x")]
    for name, content in rows:
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path, dict(rows[:3])


@pytest.mark.parametrize("split", [1, S.SPLIT])
def test_digests_of_files(spark, folder, split):
    path, content = folder
    df = S.hash_files(spark, str(path), split=split)
    assert {r.path: (r.bytes, r.sha256) for r in df.collect()} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in content.items()}
    assert df.rdd.getNumPartitions() == (3 if split == 1 else 1)
    assert [r.path for r in S.hash_files(spark, f"file:{path}", "*.txt").collect()] == ["b/d.txt"]
    assert S.hash_files(spark, str(path), "*.none").count() == 0


def test_faults_against_a_manifest(spark, folder):
    path, content = folder
    right = [(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in content.items()]
    manifest = spark.createDataFrame([right[0], (right[1][0], 5, right[1][2]), ("gone", 1, "0")], "path string, bytes bigint, sha256 string")
    got = {r.path: r.status for r in Q.check_hashes(S.hash_files(spark, str(path)), manifest).collect()}
    assert got == {"b/c.bin": "size", "gone": "missing", "b/d.txt": "unexpected"}
    (path / "a.bin").write_bytes(b"\x01" + content["a.bin"][1:])
    assert Q.check_hashes(S.hash_files(spark, str(path), "a.bin"), manifest.limit(1)).first().status == "digest"


def test_written_files_are_read_by_name(spark, tmp_path):
    ship_code(spark)
    rows = spark.range(7).select(F.concat(F.col("id").cast("string"), F.lit(".t")).alias("name"), F.col("id").cast("string").alias("content")).repartition(3)
    assert S.write_files(rows, str(tmp_path / "x")) == 7 and S.write_files(rows, f"file://{tmp_path}/x") == 7 and S.write_files(rows.where("false"), str(tmp_path / "y")) == 0
    paths = spark.createDataFrame([(f"file:{tmp_path}/x/{i}.t", i) for i in (5, 2)], "path string, i int")
    assert {r.i: bytes(r.content) for r in S.read_contents(paths).collect()} == {5: b"5", 2: b"2"}
