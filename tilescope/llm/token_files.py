"""Token files: independent zstandard frames of ids with a trailing seek table and a checksum per frame.

A file is the public seekable zstandard layout: frames of FRAME_IDS ids (32-bit little-endian, the last one
shorter), then a skippable frame that lists every frame's compressed size, plain size and checksum (the low
half of XXH64 of the plain bytes). Any zstandard tool unpacks it to the ids in order; a reader takes the
table from the end and unpacks only the frames it needs. A Parquet index says where each document lies.
"""

from __future__ import annotations

import os
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilescope.llm import spans
from tilescope.llm.common import keep
from tilescope.session import new_scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
FRAME_IDS = 65_536
LEVEL = 3
#: Stretches of text whose ids a worker remembers: so many, of at most so many bytes.
KNOWN = 500_000
KNOWN_BYTES = 40
#: A reader hands on its rows when their ids come to about this many bytes.
READ_BYTES = 8 << 20

# ---- fixed values of the seekable layout
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_FOOTER = struct.Struct("<IBI")


# ---- ids ---------------------------------------------------------------------------------

@cache
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import tokenizers

    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    return tokenizers.Tokenizer.from_file(path)


_known: dict[str | None, dict[bytes, bytes]] = {}


def _encode(path: str | None, stretches: list[bytes]) -> list[bytes]:
    """32-bit ids of each stretch; a worker remembers the first KNOWN short ones, whatever task it serves."""
    known = _known.setdefault(path, {})
    out = [known.get(s) for s in stretches]
    new = [k for k, ids in enumerate(out) if ids is None]
    for k, e in zip(new, _tokenizer(path).encode_batch_fast([stretches[k].decode() for k in new], add_special_tokens=False)):
        out[k] = array("I", e.ids).tobytes()
        if len(known) < KNOWN and len(stretches[k]) <= KNOWN_BYTES:
            known[stretches[k]] = out[k]
    return out


_WHITE = spans.WHITE.copy()
_WHITE[0x1C:0x20] = True
_WIDE_TAIL = np.zeros(256, bool)  # last and last but one byte of every white space character beyond ASCII
_WIDE_TAIL[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, 0x85]] = True
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0x9A, 0x80, 0x81]] = True


def _stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(stretches in order, number of stretches of each text): white space, then what follows up to the next.

    The byte-level vocabulary's pattern ends a piece before any white space that follows something else and
    looks no further back, so stretches cut there have the same ids alone as within their text. Where the
    byte before may belong to a white space character beyond ASCII, no cut is made.
    """
    data, ends = spans.utf8(texts)
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before = data[:-1]
        wide = np.zeros(len(before), bool)
        wide[1:] = _WIDE_TAIL[before[1:]] & _WIDE_LEAD[before[:-1]]
        cut[1:-1] = spans.WHITE[data[1:]] & ~_WHITE[before] & ~wide
    cut[ends] = True
    at = np.flatnonzero(cut)
    counts = np.diff(np.searchsorted(at, ends))
    return spans.binary(data, at if len(data) else np.zeros(1, np.int64)), counts


def token_ids(texts: pa.Array, tokenizer: str | None = None, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts with ``end_id`` after each, number of ids of each text). Equal stretches are encoded once."""
    stretches, counts = _stretches(texts)
    which, distinct = spans.coded(stretches)
    encoded = _encode(tokenizer, distinct.to_pylist())
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    table = np.frombuffer(b"".join(encoded), "<u4")
    begins = np.cumsum(sizes) - sizes
    length = sizes[which]
    upto = np.concatenate(([0], np.cumsum(length)))
    ids = table[np.repeat(begins[which] - upto[:-1], length) + np.arange(upto[-1])]
    n = np.diff(upto[np.concatenate(([0], np.cumsum(counts)))])
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, n + 1


# ---- files -------------------------------------------------------------------------------

class FrameWriter:
    """Appends ids to a binary stream as frames; holds one frame at a time and twelve bytes for each earlier one."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS):
        self.stream, self.frame_ids = stream, frame_ids
        self.waiting, self.n, self.entries = [], 0, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def write(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at:at + self.frame_ids - self.n]
            self.waiting.append(part.astype("<u4"))
            self.n += len(part)
            at += len(part)
            if self.n == self.frame_ids:
                self._flush()

    def _flush(self) -> None:
        plain = b"".join(p.tobytes() for p in self.waiting)
        packed = self.packer.compress(plain)
        self.stream.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.waiting, self.n = [], 0

    def finish(self) -> None:
        if self.n:
            self._flush()
        table = np.array(self.entries, _ENTRY).tobytes()
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table) + _FOOTER.size) + table + _FOOTER.pack(len(self.entries), HAS_CHECKSUMS, SEEKABLE))


class FrameReader:
    """Reads ranges of ids from a seekable stream; unpacks the frames they touch, each once while ranges ascend."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, 2)
        stream.seek(max(0, size - _FOOTER.size))
        tail = stream.read(_FOOTER.size)
        n, flags, magic = _FOOTER.unpack(tail) if len(tail) == _FOOTER.size else (0, 0, 0)
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError("not a token file: the seek table is missing")
        length = n * _ENTRY.itemsize
        stream.seek(size - _FOOTER.size - length - 8)
        if struct.unpack("<II", stream.read(8)) != (SKIPPABLE, length + _FOOTER.size):
            raise ValueError("not a token file: the seek table's head is damaged")
        self.table = np.frombuffer(stream.read(length), _ENTRY)
        self.packed = np.concatenate(([0], np.cumsum(self.table["packed"], dtype=np.int64)))
        self.ids = np.concatenate(([0], np.cumsum(self.table["plain"], dtype=np.int64))) // 4
        self.last, self.plain, self.unpacked = -1, b"", 0
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        if k != self.last:
            self.stream.seek(int(self.packed[k]))
            plain = self.unpacker.decompress(self.stream.read(int(self.table["packed"][k])), max_output_size=int(self.table["plain"][k]))
            if len(plain) != self.table["plain"][k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table["check"][k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last, self.plain = k, plain
            self.unpacked += 1
        return self.plain

    def read(self, at: int, n: int) -> bytes:
        """``n`` ids from number ``at`` on, as bytes."""
        if at < 0 or n < 0 or at + n > self.ids[-1]:
            raise ValueError("ids beyond the end of the file")
        parts, k = [], int(np.searchsorted(self.ids, at, side="right")) - 1
        while n > 0:
            skip = at - int(self.ids[k])
            part = self.frame(k)[4 * skip:4 * (skip + n)]
            parts.append(part)
            at, n, k = at + len(part) // 4, n - len(part) // 4, k + 1
        return b"".join(parts)


# ---- Spark jobs --------------------------------------------------------------------------

def _place(folder: str, name: str):
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    return fs, f"{root}/{name}"


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode every text into token files under ``folder`` and return their index, a kept table.

    The index has a row per document: ``doc_id``, ``part`` and ``file``, ``at`` (ids before it in the file),
    ``start`` (ids of all documents before it) and ``n_tokens`` with the end id. Documents stand in ascending
    id order, null ids first, equal ids by their texts; a null text is empty and is its end id alone. Ids may
    be of any type that can be ordered. ``folder`` must be shared, as a URI or an absolute path.

    Rows are range-partitioned and sorted by Spark, each task streams one file and holds a slice of texts and
    one frame. A file's name carries its attempt, and the index, committed by Spark, names only files of
    attempts that succeeded: files of lost attempts are never read. File totals give the starts in
    one window over a row per file.
    """
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    by = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()),
                           T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        name, stream, writer, done = f"{part:06d}-{uuid.uuid4().hex}.ids.zst", None, None, 0
        for batch in batches:
            for i, j in spans.slices(batch.column(1)):
                ids, n = token_ids(batch.column(1)[i:j], tokenizer, end_id)
                if writer is None:
                    fs, path = _place(folder, name)
                    stream = fs.open_output_stream(path, compression=None)
                    writer = FrameWriter(stream, frame_ids)
                writer.write(ids)
                at = done + np.cumsum(n) - n
                done += len(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.full(j - i, part, np.int32)), pa.array([name] * (j - i)),
                                                  pa.array(at), pa.array(n)], names=schema.names)
        if writer is not None:
            writer.finish()
            stream.close()

    index = keep(ordered.mapInArrow(write, schema), "token_index")
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    return index.join(F.broadcast(offsets), "part").select(
        "doc_id", F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("file"), "part", "at", (F.col("_o") + F.col("at")).alias("start"), "n_tokens")


def read_tokens(index: DataFrame) -> DataFrame:
    """``index`` rows, all or any of those that ``write_tokens`` returned, with ``ids``: 32-bit little-endian ids read from the files.

    Each file is one task's, in ascending order, so a frame is unpacked once, and only if a wanted document
    touches it. A damaged frame raises.
    """
    names = index.columns
    n_files = max(1, index.select("file").distinct().count())
    schema = T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, reader = None, None
        for batch in batches:
            files, at, n = (batch.column(names.index(c)).to_pylist() for c in ("file", "at", "n_tokens"))
            first, ids, size = 0, [], 0
            for k in range(batch.num_rows):
                if files[k] != opened:
                    fs, path = pyarrow.fs.FileSystem.from_uri(files[k])
                    opened, reader = files[k], FrameReader(fs.open_input_file(path))
                ids.append(reader.read(at[k], n[k]))
                size += len(ids[-1])
                if size >= READ_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=schema.names)
                    first, ids, size = k + 1, [], 0

    return index.repartition(n_files, "file").sortWithinPartitions("file", "at").mapInArrow(read, schema)


def find_tokens(index: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents whose id is in ``wanted``; other documents' frames stay packed."""
    ids = wanted.select(F.col(f"`{id_col}`").alias("doc_id")).distinct()
    return read_tokens(index.join(ids, "doc_id", "left_semi"))


def token_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from files written to ``folder`` or to scratch."""
    spark = docs.sparkSession
    if folder is None:
        folder = new_scratch_path(spark, "tokens")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    rows = read_tokens(write_tokens(docs, folder, id_col, text_col))
    return rows.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
