"""Byte-level BPE of whole corpora in numpy matrices."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = os.environ.get("TICKWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
#: Cells of one matrix, documents of one slice, and pieces that a worker keeps.
CELLS, SLICE, KEPT = 1 << 20, 500, 400_000


def _letters() -> dict[str, int]:
    """The published letter of each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Open hash table from a pair of ids to the rank of its merge and the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        keys = (left.astype(np.int64) << 20) | right
        todo, slot = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            _, at = np.unique(slot[todo[free]], return_index=True)
            won = todo[free][at]
            self.keys[slot[won]], self.ranks[slot[won]], self.merged[slot[won]] = keys[won], won, merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x2545F4914F6CDD1D)) >> np.int64(64 - self.bits)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such merge) and merged id; a negative id pairs with nothing."""
        keys = (left.astype(np.int64) << 20) | right
        slot = self._home(keys)
        seen = self.keys[slot]
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            seen = self.keys[slot[todo]]
            todo = todo[(seen != keys[todo]) & (seen >= 0)]
        ok = (self.keys[slot] == keys) & (left >= 0) & (right >= 0)
        return np.where(ok, self.ranks[slot], NONE), self.merged[slot]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n`` values; it doubles, so that growing costs no more than filling."""
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [np.array([vocab[x] for x in part], np.int32) for part in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])]
        self.table = PairTable(*ids)
        self.first = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.lens, self.starts, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    # merging -------------------------------------------------------------------------------------------------

    def _merge(self, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``m`` (padded with -1) merged to their end: (row numbers, matrix) as rows finish."""
        row = np.arange(len(m))
        rank, new = self._ranks(m)
        while True:
            least = rank.min(axis=1, initial=NONE)
            go = least != NONE
            if not go.all():
                yield row[~go], m[~go]
                row, m, rank, new, least = row[go], m[go], rank[go], new[go], least[go]
            if not len(row):
                return
            m, rank, new = self._round(m, rank, new, least)

    def _ranks(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.table.find(m[:, :-1].ravel(), m[:, 1:].ravel())
        shape = (len(m), m.shape[1] - 1)
        return a.reshape(shape), b.reshape(shape)

    def _round(self, m, rank, new, least):
        """Each row merges its least pair, from the leftmost place on at every place of it: the same as one place
        after the other, since a merge only makes pairs of a later rank. Then the rows are compacted."""
        n, w = m.shape
        hit = rank == least[:, None]
        col = np.arange(w - 1)
        start = hit & ~np.pad(hit[:, :-1], ((0, 0), (1, 0)))
        hit &= (col - np.maximum.accumulate(np.where(start, col, 0), axis=1)) % 2 == 0  # of overlapping ones every second
        left = np.pad(hit, ((0, 0), (0, 1)))
        m = np.where(left, np.pad(new, ((0, 0), (0, 1))), m)
        keep = (m >= 0) & ~np.pad(hit, ((0, 0), (1, 0)))
        size = keep.sum(axis=1)
        to = np.cumsum(keep, axis=1) - 1
        r, c = np.nonzero(keep)
        width = max(2, int(size.max()))
        out, fresh = np.full((n, width), -1, np.int32), np.zeros((n, width), bool)
        out[r, to[r, c]], fresh[r, to[r, c]] = m[r, c], left[r, c]
        rank2, new2 = np.full((n, width), NONE, np.int32), np.zeros((n, width), np.int32)
        rank2[r, to[r, c]], new2[r, to[r, c]] = np.pad(rank, ((0, 0), (0, 1)), constant_values=NONE)[r, c], np.pad(new, ((0, 0), (0, 1)))[r, c]
        rank2, new2 = rank2[:, :-1], new2[:, :-1]
        i, j = np.nonzero(fresh[:, :-1] | fresh[:, 1:])
        rank2[i, j], new2[i, j] = self.table.find(out[i, j], out[i, j + 1])
        rank2[out[:, 1:] < 0] = NONE
        return out, rank2, new2

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; pieces of about one length share a matrix."""
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            small = sizes[order[at]]
            end = int(np.searchsorted(sizes[order], max(small + 3, small * 5 // 4), "right"))
            width = max(2, int(sizes[order[end - 1]]))
            end = min(end, at + max(1, CELLS // width))
            rows = order[at:end]
            at = end
            size = sizes[rows]
            m = np.full((len(rows), width), -1, np.int32)
            m[np.arange(width) < size[:, None]] = self.first[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
            for which, ids in self._merge(m):
                for i, x, k in zip(rows[which].tolist(), ids, (ids >= 0).sum(axis=1).tolist()):
                    done[i] = x[:k]
        return done

    # texts ---------------------------------------------------------------------------------------------------

    def _learn(self, texts: list[str | None]) -> list[list[str]]:
        if len(self.known) > KEPT:
            self._forget()
        cut = [self.split(t) if t else [] for t in texts]
        new = list(dict.fromkeys(p for c in cut for p in c if p not in self.known))
        if new:
            ids = self.pieces([p.encode("utf-8", "surrogatepass") for p in new])
            base = len(self.known)
            self.known.update((p, base + i) for i, p in enumerate(new))
            lens, flat = np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids)
            self.flat = _room(self.flat, self.used + len(flat))
            self.lens, self.starts = _room(self.lens, base + len(ids)), _room(self.starts, base + len(ids))
            self.flat[self.used : self.used + len(flat)] = flat
            self.lens[base : base + len(ids)], self.starts[base : base + len(ids)] = lens, self.used + np.cumsum(lens) - lens
            self.used += len(flat)
        return cut

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text. Null and empty texts have none."""
        cut = self._learn(texts)
        of = self.known
        piece = np.fromiter((of[p] for c in cut for p in c), np.int64, sum(map(len, cut)))
        lens = self.lens[piece]
        total = int(lens.sum())
        begin = np.cumsum(lens) - lens
        ids = self.flat[np.repeat(self.starts[piece] - begin, lens) + np.arange(total)] if total else np.zeros(0, np.int32)
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        return ids, np.bincount(text, weights=lens, minlength=len(texts)).astype(np.int64) if total else np.zeros(len(texts), np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        cut = self._learn(texts)
        of = self.known
        piece = np.fromiter((of[p] for c in cut for p in c), np.int64, sum(map(len, cut)))
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, cut), np.int64, len(cut)))
        return np.bincount(text, weights=self.lens[piece], minlength=len(texts)).astype(np.int64) if len(piece) else np.zeros(len(texts), np.int64)


_LOADED: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def _path(folder: str) -> str:
    return os.path.join(folder, VOCABULARY)


def encode_corpus(df: DataFrame, doc: Column, text: Column, *, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, without special tokens; strings that look like special
    tokens are ordinary text. Null and empty texts give an empty list; a null or repeated doc_id is kept
    as it is. One row out for each row in; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(_path(folder))
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                s = b.slice(at, SLICE)
                ids, n = bpe.encode(s.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    src = df.select(doc.alias("doc_id"), text.cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[Column], text: Column, *, folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and n_tokens, the number of ids of the whole text (0 for null and empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(_path(folder))
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                s = b.slice(at, SLICE)
                n = bpe.counts(s.column(s.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*s.columns[:-1], pa.array(n)], [*s.schema.names[:-1], "n_tokens"])

    kept = df.select(*keep)
    src = df.select(*keep, text.cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return src.mapInArrow(run, f"{fields}, n_tokens long")
