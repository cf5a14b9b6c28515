"""SentencePiece encoding and decoding: Viterbi forward, A* backward for the N best segmentations."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
CACHED = 150_000
STEP = 4096
LONGEST_CACHED = 48
CHARS = 2_000_000
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


class Recent:
    """The last ``size`` to twice as many results that were asked for, by string."""

    def __init__(self, size: int):
        self.size, self.newer, self.older = size, {}, {}

    def get(self, key: str):
        return self.newer.get(key) or self.older.get(key)

    def put(self, found: dict) -> None:
        self.newer |= found
        if len(self.newer) >= self.size:
            self.newer, self.older = {}, self.newer


class PieceModel:
    """The piece lattice of a SentencePiece file: pieces with scores, bytes for characters without a piece.

    Spaces stand for the file's space symbol; one is put before a text that is not empty. A literal
    space symbol in a text is spelled in bytes, so decoding gives back every text exactly. Where no
    piece holds a space behind another character, a text falls apart before its runs of spaces (and
    at newlines, if no longer piece holds one), and segmentations of the parts are independent.
    """

    def __init__(self, proto: bytes, cached: int = CACHED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.proto, self.texts, self.pieces, self.bytes = proto, {}, {}, {}
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = sp.id_to_piece(i).replace(SPACE, " ")
                self.texts[i] = text.encode()
                self.pieces[text] = (float(sp.get_score(i)), i)
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces; texts outside its characters could not be decoded")
        self.texts |= {i: bytes([b]) for b, i in self.bytes.items()}
        #: score and id of every piece, None for what only begins one
        self.begins = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN_PENALTY
        spaces_lead = not any(" " in p.lstrip(" ") for p in self.pieces)
        lines_apart = not any("\n" in p and len(p) > 1 for p in self.pieces)
        self.parts = re.compile((r" +[^ \n]*|[^ \n]+|\n" if lines_apart else r" +[^ ]*") if spaces_lead else r"(?s).+")
        self.longest = max(map(len, self.pieces))
        lengths, self.hashes = {}, {}
        for text, (score, i) in self.pieces.items():
            lengths.setdefault(len(text), []).append((text, score, i))
        for n, own in lengths.items():
            keys = self.window_hashes([t for t, _, _ in own], n)[:, 0]
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise ValueError("two pieces have one hash")
            seen = np.zeros(1 << 16, bool)
            seen[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.hashes[n] = keys[order], np.array([own[k][1] for k in order]), np.array([own[k][2] for k in order]), [own[k][0] for k in order], seen
        self.lengths = sorted(self.hashes.keys() | {1})
        self.cache, self.alternatives = Recent(cached), {}

    def __reduce__(self):
        return PieceModel, (self.proto, self.cache.size)

    def edges(self, part: str) -> Iterator[tuple[int, int, float, tuple[int, ...]]]:
        """(start, end, score, ids) of the lattice, by start."""
        for i in range(len(part)):
            if part[i] not in self.pieces:
                yield i, i + 1, self.unknown, tuple(self.bytes[b] for b in part[i].encode())
            for j in range(i + 1, len(part) + 1):
                found = self.begins.get(part[i:j], False)
                if found is False:
                    break
                if found:
                    yield i, j, found[0], (found[1],)

    def forward(self, part: str) -> tuple[array, array, array, array]:
        """Best and second-best score up to each place, start and id of the best edge into it; equal scores go to the longer piece.

        The id is -1 where a character is spelled in bytes. Typed arrays: 24 bytes a character.
        """
        n, get = len(part), self.begins.get
        best, second = array("d", [-np.inf]) * (n + 1), array("d", [-np.inf]) * (n + 1)
        start, came = array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b, s, alone = best[i], second[i], True
            for j in range(i + 1, n + 1):
                found = get(part[i:j], False)
                if found:
                    score, piece = found
                    if j == i + 1:
                        alone = False
                    one, two, held = b + score, s + score, best[j]
                    if one > held:
                        second[j] = held if held > two else two
                        best[j], start[j], came[j] = one, i, piece
                    elif one > second[j]:
                        second[j] = one
                elif found is False:
                    break
            if alone:
                one, two, held = b + self.unknown, s + self.unknown, best[i + 1]
                if one > held:
                    second[i + 1] = held if held > two else two
                    best[i + 1], start[i + 1], came[i + 1] = one, i, -1
                elif one > second[i + 1]:
                    second[i + 1] = one
        return best, second, start, came

    def best(self, part: str) -> tuple[float, float, bytes]:
        """(score, what the second-best segmentation loses, ids as 32-bit little-endian bytes)."""
        best, second, start, came = self.forward(part)
        at, ids = len(part), array("i")
        while at:
            own, at = came[at], start[at]
            if own < 0:
                ids.extend([self.bytes[b] for b in reversed(part[at].encode())])
            else:
                ids.append(own)
        ids.reverse()
        return best[-1], best[-1] - second[-1], ids.tobytes()

    @staticmethod
    def window_hashes(parts: list[str], n: int) -> np.ndarray:
        """64-bit hashes of the windows of ``n`` characters of equally long parts, one row per part."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(parts), -1).astype(np.uint64)
        size = codes.shape[1] - n + 1
        out = np.zeros((len(parts), size), np.uint64)
        for k in range(n):
            out = (out ^ codes[:, k:k + size]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def pieces_in(self, parts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, part, number among the pieces of this length) of all pieces of ``length`` characters, by start."""
        keys, _, _, texts, seen = self.hashes[length]
        windows = self.window_hashes(parts, length).T
        col, row = np.nonzero(seen[(windows >> np.uint64(48)).astype(np.int64)])  # few windows pass that are no piece
        hashes = windows[col, row]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        if length > 3:
            for k in np.flatnonzero(hit).tolist():
                c = col[k]
                if parts[row[k]][c:c + length] != texts[at[k]]:  # one hash, another text
                    hit[k] = False
        return col[hit], row[hit], at[hit]

    def forward_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``forward`` of many parts of one length, a column each: one array step for each (start, end) where some part has a piece."""
        m, n = len(parts), len(parts[0])
        best, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        start, piece = np.zeros((n + 1, m), np.int32), np.zeros((n + 1, m), np.int32)
        best[0] = 0.0
        found = []
        for length in self.lengths:
            if length > n:
                break
            if length not in self.hashes:
                continue
            col, row, at = self.pieces_in(parts, length)
            scores, ids = self.hashes[length][1:3]
            found.append((length, np.searchsorted(col, np.arange(n + 1)).tolist(), row, scores[at], ids[at]))
        alone = np.ones((n, m), bool)
        for length, cuts, row, _, _ in found[:1]:
            if length == 1:
                alone[np.repeat(np.arange(n), np.diff(cuts)), row] = False
        spelled = [np.flatnonzero(a) for a in alone]
        for i in range(n):
            steps = [(i + length, row[cuts[i]:cuts[i + 1]], scores[cuts[i]:cuts[i + 1]], ids[cuts[i]:cuts[i + 1]]) for length, cuts, row, scores, ids in found if i + length <= n]
            if len(spelled[i]):
                steps.append((i + 1, spelled[i], self.unknown, -1))
            own, other = best[i], second[i]
            for j, rows, score, ids in steps:
                if not len(rows):
                    continue
                if len(rows) == m:
                    rows = slice(None)
                one, two, held = own[rows] + score, other[rows] + score, best[j, rows]
                better = one > held
                second[j, rows] = np.where(better, np.maximum(held, two), np.maximum(second[j, rows], one))
                best[j, rows] = np.where(better, one, held)
                start[j, rows] = np.where(better, i, start[j, rows])
                piece[j, rows] = np.where(better, ids, piece[j, rows])
        return best, second, start, piece

    def best_of_length(self, parts: list[str]) -> list[tuple[float, float, bytes]]:
        """``best`` of many parts of one length."""
        best, second, start, piece = self.forward_many(parts)
        m, n = len(parts), len(parts[0])
        rows, at, steps = np.arange(m), np.full(m, n), []
        odd = np.zeros(m, bool)  # parts with a character that is spelled in bytes
        while len(rows):
            own, into = piece[at, rows], start[at, rows]
            steps.append((rows, own))
            odd[rows[own < 0]] = True
            rows, at = rows[into > 0], into[into > 0]
        # every row's pieces from its last to its first: sorted by row, later steps first
        row, own = (np.concatenate(c) for c in zip(*steps))
        order = np.lexsort((-np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps]), row))
        ids = own[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(row, minlength=m))).tolist()
        spelled = {r: self.best(parts[r])[2] for r in np.flatnonzero(odd).tolist()}
        return [(b, b - s, spelled.get(r) or ids[x:y]) for r, (b, s, x, y) in enumerate(zip(best[n].tolist(), second[n].tolist(), [0, *ends], ends))]

    def best_of(self, parts: set[str]) -> dict[str, tuple[float, float, bytes]]:
        """``best`` by part: from the cache, by length in one pass each, and one by one for very long parts."""
        out, by_length = {}, {}
        for part in parts:
            found = self.cache.get(part)
            if found:
                out[part] = found
            else:
                by_length.setdefault(len(part), []).append(part)
        for n, own in by_length.items():
            for k in range(0, len(own), STEP):
                some = own[k:k + STEP]
                out.update(zip(some, self.best_of_length(some) if n <= LONGEST_CACHED else map(self.best, some)))
        self.cache.put({p: v for p, v in out.items() if len(p) <= LONGEST_CACHED})
        return out

    def n_best(self, part: str, n: int, best=None) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), best first: A* from the end, whose estimate to the start is the exact forward score.

        ``best`` are the forward scores, if a pass over many parts has them already. Pieces that end at a place are looked up
        when the search comes to it, so the lattice is never listed; as open ends are of different segmentations and their
        estimates exact, only as many of them as are still to be found are kept. Among equal estimates the path found last goes on, so ties do
        not widen the search.
        """
        if best is None:
            best = self.forward(part)[0]
        heap, tick, out, get = [(-best[len(part)], 0, len(part), 0.0, None)], 0, [], self.pieces.get
        while heap and len(out) < n:
            _, _, at, done, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for length in self.lengths:
                i = at - length
                if i < 0:
                    break
                found = get(part[i:at])
                if found:
                    score, own = found[0], (found[1],)
                elif length == 1:
                    score, own = self.unknown, tuple(self.bytes[b] for b in part[i].encode())
                else:
                    continue
                tick -= 1
                heap.append((-(done + score + best[i]), tick, i, done + score, (own, path)))
            heap = heapq.nsmallest(n - len(out), heap)
        return out

    def find_alternatives(self, parts: set[str], n: int) -> None:
        """Keep ``n_best`` of those parts that are not kept yet, with the forward pass over many at a time."""
        by_length: dict[int, list[str]] = {}
        for part in parts:
            if len(part) <= LONGEST_CACHED and (part, n) not in self.alternatives:
                by_length.setdefault(len(part), []).append(part)
        for own in by_length.values():
            for k in range(0, len(own), STEP):
                some = own[k:k + STEP]
                for part, best in zip(some, self.forward_many(some)[0].T.tolist()):
                    self.alternatives[part, n] = self.n_best(part, n, best)

    def encode(self, text: str | None, n: int = N_BEST) -> tuple[float, bytes, list]:
        return self.encode_all([text], n)[0]

    def encode_all(self, texts: list[str | None], n: int = N_BEST) -> list[tuple[float, bytes, list]]:
        """``combine`` of each text, with the distinct parts of all of them segmented together."""
        split = [self.parts.findall(" " + t) if t else [] for t in texts]
        found = self.best_of({p for parts in split for p in parts})
        best = [[found[p] for p in parts] for parts in split]
        changed = [self.cheapest(own, n) for own in best]
        if len(self.alternatives) >= CACHED // 10:
            self.alternatives.clear()
        self.find_alternatives({parts[k] for parts, own in zip(split, changed) for k in own}, n)
        return [self.combine(*of, n) for of in zip(split, best, changed)]

    @staticmethod
    def cheapest(best: list[tuple[float, float, bytes]], n: int) -> list[int]:
        """Places of the n - 1 parts whose second-best segmentation costs least, of those that have one, in order."""
        if n < 2 or not best:
            return []
        gaps = np.array([b[1] for b in best])
        least = np.argsort(gaps, kind="stable")[:n - 1]
        return np.sort(least[gaps[least] < np.inf]).tolist()

    def combine(self, parts: list[str], best: list[tuple[float, float, bytes]], changed: list[int], n: int) -> tuple[float, bytes, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
        """(score, ids, alternatives) of a whole text: alternatives are (score, edits), an edit (first piece, pieces replaced, ids).

        Parts are independent, so the n best texts change at most the n - 1 parts whose second-best
        costs least; their own n best are merged one part after another.
        """
        if not parts:
            return 0.0, b"", []
        score, ids = sum([b[0] for b in best]), [b[2] for b in best]
        merged: list[tuple[float, list]] = [(0.0, [])]
        at = first = 0
        for k in changed:
            first += sum(map(len, ids[at:k])) // 4
            at = k
            own = self.alternatives.get((parts[k], n)) or self.n_best(parts[k], n)
            edits = [(s - own[0][0], [(first, len(ids[k]) // 4, list(i))] if r else []) for r, (s, i) in enumerate(own)]
            merged = sorted(((a + b, x + y) for a, x in merged for b, y in edits), key=lambda c: (-c[0], len(c[1])))[:n]
        return score, b"".join(ids), [(score + loss, edits) for loss, edits in merged[1:]]

    def decode(self, ids: bytes) -> str:
        texts = self.texts
        return b"".join([texts[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode()[1:]


ENCODED = "score double, ids binary, alternatives array<struct<score: double, edits: array<struct<at: int, dropped: int, ids: array<int>>>>>"


def load(docs: DataFrame, path: str = MODEL, cached: int = CACHED):
    """The model file, read once by the driver and broadcast: its size is the vocabulary's, whatever the input's.

    A worker keeps the segmentations of ``cached`` to twice as many parts, about 330 bytes each.
    """
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(PieceModel(f.read(), cached))


def encode(docs: DataFrame, model, n_best: int = N_BEST, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
           check: bool = False) -> DataFrame:
    """Columns ``carry`` and ``text`` as they are, with score, ids (32-bit little-endian) and alternatives per document.

    With ``check`` also ``exact``: the ids decode to the text (a null text: to the empty one), found in the
    same worker, so that no second one holds the batch. Null and empty texts have no pieces and score 0. Repeated rows stay. Results leave the worker after
    about two million characters, so memory follows the longest text, not the batch.
    """
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model.value
        for batch in batches:
            sizes = batch["text"].str.len().fillna(0).cumsum().to_numpy() // CHARS
            for _, some in batch.groupby(sizes, sort=False):
                done = own.encode_all(some["text"].tolist(), n_best)
                if check:
                    some = some.assign(exact=[own.decode(d[1]) == (t or "") for t, d in zip(some["text"], done)])
                yield some.assign(
                    score=[float(d[0]) for d in done], ids=[d[1] for d in done],
                    alternatives=[[{"score": s, "edits": [{"at": a, "dropped": k, "ids": i} for a, k, i in e]} for s, e in d[2]] for d in done])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInPandas(run, f"{types}, {ENCODED}" + ", exact boolean" * check)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "text", "score", "ids", "alternatives", *["exact"] * check)


def decode(ids: Column, model) -> Column:
    """The text that ``ids`` encode; no ids give the empty text, null gives null."""
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        own = model.value
        return pd.Series([None if v is None else own.decode(v) for v in values], dtype=object)

    return run(ids)


def piece_report(docs: DataFrame, path: str = MODEL, n_best: int = N_BEST, cached: int = 2 * CACHED) -> DataFrame:
    """(doc_id, n_pieces, score, ids_md5, n_best, second, exact), one row per document.

    ``n_best`` counts the segmentations found, ``second`` is the score of the second best (null: none),
    ``exact`` says that the decoded ids equal the text (null text: the empty one).
    """
    rows = encode(docs, load(docs, path, cached), n_best, check=True)
    return rows.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "score", F.md5("ids").alias("ids_md5"),
        F.when(F.octet_length("ids") > 0, F.size("alternatives") + 1).otherwise(0).alias("n_best"),
        F.get("alternatives", F.lit(0))["score"].alias("second"), "exact")
