"""Byte-level BPE, encoded with a segment tree of pair ranks over byte positions, and decoded."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidymesh.llm.common import modest_batches

NONE = np.int64(1) << 62
WIDEST = 256
CHUNK_CHARS = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Ranks:
    """The vocabulary as arrays: ranks of pairs of tokens, tokens of single bytes, and the bytes of each token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.whole = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.of_key = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(x) for x in by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, or -1 where a pair (or a position that is none, -1) makes no token."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.of_key[at], -1)


def merge_one(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the leftmost pair of least rank until none is left. The tree's leaf i holds (rank, i) of the pair at i."""
    n = len(ids)
    width = 1 << max(1, (n - 1).bit_length())
    none = 1 << 62
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = pairs.get(ids[i] << 32 | ids[i + 1])
        if r is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            least = min(tree[k], tree[k ^ 1])
            k >>= 1
            if tree[k] == least:
                break
            tree[k] = least

    def pair_at(i: int) -> int:
        j = nxt[i]
        r = pairs.get(ids[i] << 32 | ids[j]) if j < n else None
        return none if r is None else r * width + i

    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        gone = nxt[i]
        ids[i] = rank
        nxt[i] = nxt[gone]
        if nxt[gone] < n:
            prv[nxt[gone]] = i
        put(gone, none)
        put(i, pair_at(i))
        if prv[i] >= 0:
            put(prv[i], pair_at(prv[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = nxt[i]
    return out


def merge_many(pieces: list[bytes], ranks: Ranks, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As merge_one for pieces of 2 to ``width`` bytes at once, one tree a row: (counts, flat ids)."""
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, n)
    raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
    cols = np.arange(width)
    ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for the place after the end
    ids[:, :width] = np.where(cols < lengths[:, None], ranks.single[raw], -1)
    nxt = np.broadcast_to(np.minimum(cols + 1, width), (n, width)).copy()
    nxt[cols[None, :] == lengths[:, None] - 1] = width
    prv = np.concatenate([np.broadcast_to(cols - 1, (n, width)), np.zeros((n, 1), np.int64)], axis=1)
    prv[:, 0] = width  # likewise the place before the start; nothing is read there
    pair = ranks.of_pairs(ids[:, :-1], ids[:, 1:])
    tree = np.full((n, 2 * width), NONE, np.int64)
    tree[:, width:] = np.where(pair >= 0, pair * width + cols, NONE)
    size = width
    while size > 1:
        size //= 2
        tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
        k = width + at
        tree[rows, k] = value
        while k[0] > 1:
            least = np.minimum(tree[rows, k], tree[rows, k ^ 1])
            k = k >> 1
            tree[rows, k] = least

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        rank, at = root // width, root % width
        gone = nxt[rows, at]
        after = nxt[rows, gone]
        ids[rows, at] = rank
        ids[rows, gone] = -1
        nxt[rows, at] = after
        prv[rows, after] = at
        put(rows, gone, NONE)
        found = ranks.of_pairs(rank, ids[rows, after])
        put(rows, at, np.where(found >= 0, found * width + at, NONE))
        before = prv[rows, at]
        has = before < width
        if has.any():
            r, b = rows[has], before[has]
            found = ranks.of_pairs(ids[r, b], rank[has])
            put(r, b, np.where(found >= 0, found * width + b, NONE))
        rows = rows[tree[rows, 1] < NONE]
    live = ids[:, :width] >= 0
    return live.sum(axis=1), ids[:, :width][live]


class Memo(dict):
    """Piece to its place among the pieces met so far; a new piece gets the next place."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Encoder:
    """Encodes lists of texts. Pieces that were met before are looked up; the memo is cleared at ``most`` pieces."""

    def __init__(self, ranks: Ranks, pattern: str, most: int = 150_000) -> None:
        self.ranks, self.find, self.most = ranks, regex.compile(pattern).findall, most
        self.clear()

    def clear(self) -> None:
        self.memo = Memo()
        self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def pieces(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts, out = np.ones(len(new), np.int64), [None] * len(new)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(new):
            whole = self.ranks.whole.get(piece)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) <= WIDEST:
                classes.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
            else:
                out[i] = np.array(merge_one(self.ranks.single[np.frombuffer(piece, np.uint8)].tolist(), self.ranks.pairs), np.int32)
                counts[i] = len(out[i])
        for width, at in classes.items():
            step = max(1, 1_000_000 // width)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                n, ids = merge_many([new[i] for i in part], self.ranks, width)
                counts[part] = n
                for i, own in zip(part, np.split(ids.astype(np.int32), np.cumsum(n)[:-1])):
                    out[i] = own
        return counts, np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens in each text, all ids)."""
        if len(self.memo) > self.most:
            self.clear()
        at = [list(map(self.memo.__getitem__, self.find(t))) for t in texts]
        if self.memo.new:
            counts, flat = self.pieces([p.encode("utf-8", "surrogatepass") for p in self.memo.new])
            self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
            self.memo.new = []
        n = np.fromiter(map(len, at), np.int64, len(at))
        places = np.fromiter((i for x in at for i in x), np.int64, int(n.sum()))
        counts = self.counts[places]
        ids = self.flat[ragged((np.cumsum(self.counts) - self.counts)[places], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(n)])]
        return np.diff(ends), ids


def in_chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of whole texts of about ``most`` characters; a longer text is alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process, kept between its tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Ranks(load_ranks(path)), pattern)
    return _encoders[path, pattern]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what is made for a batch takes many times its memory."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], names=[*kept, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode_bpe(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` plus the token ids of each whole text (array of int; replaces a column of that name).

    Each match of ``pattern`` is a piece of its own: the piece's id where it is a token, else the tokens left when
    the leftmost pair of least rank has been merged again and again. No special tokens. Null and empty texts have
    no ids. ``path``: a vocabulary file that every executor has at that place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            parts = [coder.encode(x) for x in in_chunks(texts)]
            counts = np.concatenate([np.zeros(1, np.int64), *(n for n, _ in parts)])
            ids = np.concatenate([np.zeros(0, np.int32), *(x for _, x in parts)])
            yield _with(batch, ids_col, pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(ids, pa.int32())))

    modest_batches(docs.sparkSession)
    return docs.mapInArrow(run, _schema(docs, ids_col, T.ArrayType(T.IntegerType())))


def decode_bpe(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` plus the bytes of the ids (replaces a column of that name); null ids are as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = encoder(path, pattern).ranks
        for batch in slices(batches):
            lists = batch.column(ids_col).fill_null([])
            ids, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            counts = ranks.lengths[ids]
            raw = np.empty(int(counts.sum()), np.uint8)
            for k in range(0, len(ids), 1_000_000):
                part, n = ids[k : k + 1_000_000], counts[k : k + 1_000_000]
                at = int(counts[:k].sum())
                raw[at : at + int(n.sum())] = ranks.blob[ragged(ranks.starts[part], n)]
            ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
            yield _with(batch, bytes_col, pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]))

    return docs.mapInArrow(run, _schema(docs, bytes_col, T.BinaryType()))
