"""Byte-level byte-pair encoding and decoding in numpy.

A text is split by the tokenizer's pattern. The different pieces of a chunk that the worker does not know yet are put in
matrices, a piece to a row, with rows of like length together and the rest of a row padded. In each round every row merges
its leftmost pair of least rank: pairs are looked up in a hash table that holds every pair whose join is a token, and the
row closes up by one place. Rows without a pair left leave the matrix. A piece that is a token itself is that token.

A round costs the width of its rows, so a row costs the square of its length. A piece over LONG bytes, such as a page of one
letter, is a matrix of one row, and the rounds that would merge its least rank again one place after another are done
at once, where no merge among them makes a pair of lower rank: it then costs its length for each rank that it merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.textarrays import SEGMENT, U64

NONE = np.int32(2**31 - 1)
LONG = 256
#: Rows of a matrix, and pieces that a worker keeps the ids of.
ROWS, KNOWN = 8192, 400_000


class PairTable:
    """From two ids to the id of their join, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, U64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = self.key(left, right)
        slots, waiting = self.slot(keys), np.arange(len(keys))
        while len(waiting):
            free = self.keys[slots[waiting]] == U64(2**64 - 1)
            trying = waiting[free]
            _, first = np.unique(slots[trying], return_index=True)
            put = trying[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], joined[put]
            waiting = waiting[self.keys[slots[waiting]] != keys[waiting]]
            slots[waiting] = (slots[waiting] + 1) & (len(self.keys) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(U64) << U64(32)) | right.astype(U64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Joined ids, NONE where two do not join."""
        keys = self.key(left, right)
        slots = self.slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held != U64(2**64 - 1)))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != U64(2**64 - 1))]
        return out


class Codec:
    """The ranks of one file, and what this worker has encoded so far."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*(np.array(x, np.int32) for x in zip(*pairs, strict=True)))
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.cumsum(self.token_sizes) - self.token_sizes
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: np.ndarray = np.zeros(0, np.int32)
        self.sizes: np.ndarray = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        split = [self.pattern.findall(t) for t in texts]
        if len(self.known) > KNOWN:
            self.forget()
        pieces = list(chain.from_iterable(split))
        new = list(set(pieces).difference(self.known))
        if new:
            ids = self.merge([p.encode() for p in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *ids])
            self.sizes = np.concatenate([self.sizes, np.array([len(x) for x in ids], np.int64)])
        begins = np.cumsum(self.sizes) - self.sizes
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        out = ragged(self.flat, begins[number], self.sizes[number])
        bounds = np.cumsum([0, *map(len, split)])
        sums = np.r_[0, np.cumsum(self.sizes[number])]
        return out, sums[bounds[1:]] - sums[bounds[:-1]]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and how many each id has."""
        sizes = self.token_sizes[ids]
        return ragged(self.token_bytes, self.token_at[ids], sizes), sizes

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        open_: list[int] = []
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = np.array([self.ranks[p]], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                open_.append(i)
        open_.sort(key=lambda i: len(pieces[i]))
        a = 0
        while a < len(open_):
            b, width = a, 0
            while b < len(open_) and b - a < ROWS and len(pieces[open_[b]]) <= max(8, 1.25 * len(pieces[open_[a]])):
                width = len(pieces[open_[b]])
                b += 1
            self.merge_matrix([pieces[i] for i in open_[a:b]], width, open_[a:b], out)
            a = b
        return out

    def merge_matrix(self, pieces: list[bytes], width: int, place: list[int], out: list[np.ndarray]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        size = np.array([len(p) for p in pieces])
        ids, row = self.bytes_id[raw], np.array(place)
        inside = np.arange(width - 1)[None, :] < size[:, None] - 1
        ranks = np.where(inside, self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(inside.shape), NONE)
        while len(row):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            done = least == NONE
            for i in np.flatnonzero(done):
                out[row[i]] = ids[i, : size[i]].copy()
            keep = ~done
            ids, ranks, size, row, at, least = ids[keep], ranks[keep], size[keep] - 1, row[keep], at[keep], least[keep]
            if not len(row):
                break
            n, w = ids.shape
            # Close up: the second of the pair goes, and of the ranks the merged pair's own.
            each = np.arange(n)
            ids[each, at] = least
            ids = ids[np.arange(w)[None, :] != at[:, None] + 1].reshape(n, w - 1)
            ranks = ranks[np.arange(w - 1)[None, :] != at[:, None]].reshape(n, w - 2)
            if w > 2:
                right = np.minimum(at, w - 3)
                ok = at + 1 < size
                ranks[each[ok], at[ok]] = self.pairs.find(ids[each, right], ids[each, right + 1])[ok]
                ok = at > 0
                ranks[each[ok], at[ok] - 1] = self.pairs.find(ids[each[ok], at[ok] - 1], ids[each[ok], at[ok]])
                ranks[np.arange(w - 2)[None, :] >= size[:, None] - 1] = NONE
            else:
                for i in each:
                    out[row[i]] = ids[i, : size[i]].copy()
                break

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The rounds of one row, those of one rank together."""
        ids = self.bytes_id[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # Of places in a row every second one goes, from the left.
            run = np.cumsum(np.r_[True, np.diff(at) > 1])
            at = at[(at - at[np.searchsorted(run, run)]) % 2 == 0]
            joined = np.full(len(at), least)
            left, right = at > 0, at + 2 < len(ids)
            lower = (self.pairs.find(ids[at[left] - 1], joined[left]) < least).any() or (self.pairs.find(joined[right], ids[at[right] + 2]) < least).any()
            if lower or self.pairs.find(joined[:1], joined[:1])[0] < least:
                at = at[:1]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            ranks = ranks[keep[1:]]
            at = at - np.arange(len(at))
            for near in (at[at > 0] - 1, at[at < len(ranks)]):
                ranks[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids


def ragged(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[b : b + n] of every begin and size, end to end."""
    total = int(sizes.sum())
    steps = np.arange(total) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return values[steps]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def parts(batch: pa.RecordBatch, column: str, limit: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts, or lists, have about limit entries together."""
    import pyarrow.compute as pc

    values = batch.column(column)
    size = pc.binary_length if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length
    total = np.r_[0, np.cumsum(pc.fill_null(size(values), 0).to_numpy(zero_copy_only=False))]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: id_col and token_ids, an array of the ids of the whole text (null: empty).

    Ids are those of the tiktoken library for these ranks and this pattern without special tokens. A null id is carried,
    equal rows stay as many, no rows give no rows; other columns are left out, so no name can clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for part in parts(batch, "text"):
                ids, sizes = own.encode([t or "" for t in part.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "token_ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, token_ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """A row for each row: id_col, ids_col and decoded, the bytes that the ids stand for (null ids: none)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for part in parts(batch, "ids"):
                lists = part.column("ids")
                data, sizes = own.decode(lists.flatten().to_numpy(zero_copy_only=False))
                sums = np.r_[0, np.cumsum(sizes)]
                bounds = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
                decoded = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(sums[bounds].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, decoded.cast(pa.binary())], names=["id", "ids", "decoded"])

    return (
        encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")
        .withColumnsRenamed({"id": id_col, "ids": ids_col})
    )
