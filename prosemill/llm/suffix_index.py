"""Suffix-array de-duplication of byte strings by a logarithmic index family.

``SuffixLevels`` is a family of suffix arrays whose sizes are powers of two batches. A new batch gets its suffix array, in the
order of the suffixes' bytes. While a level of its own size exists, the two merge to one of twice the size; it is then
merge-scanned against every larger level. Merging or scanning, suffixes that agree in ``length`` bytes are neighbours, and
both are marked. Of such suffixes a level keeps one, the others being marked already, so a passage that thousands share is
carried once. Each suffix moves a logarithmic number of times.

The corpus has one family for each shard that ``windows`` deals, in which all suffixes meet that could agree in so many bytes;
a shard's batches are cut from its contexts as they come. A task holds the levels of its shard, so a lost executor costs
the shards it was at, which are dealt anew from a written table.

Suffixes are ordered by their first ``length`` bytes, as only matches so long count, and taken at window starts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.storage import Scratch
from prosemill.llm.textarrays import BASES, BYTE_SYMBOLS, U64, chunks, power_at, power_range, text_bytes
from prosemill.llm.windows import Windows, keyed, repeated, runs, window_places, with_spans

#: Bytes of contexts in a batch.
BATCH = 1 << 19
OWN = ("n_bytes", "spans", "kept")


class Bytes:
    """A growing text that compares any two of its places: by eight bytes as a number, or by fingerprints of ranges."""

    def __init__(self) -> None:
        self.size = 0
        self.data = np.zeros(8, np.uint8)
        self.sums = [np.zeros(1, U64) for _ in BASES]

    def append(self, data: np.ndarray) -> int:
        """Returns where the new bytes begin."""
        first, self.size = self.size, self.size + len(data)
        self.data = np.concatenate([self.data[:first], data, np.zeros(8, np.uint8)])
        for which, sums in enumerate(self.sums):
            self.sums[which] = np.concatenate([sums, sums[-1] + np.cumsum(BYTE_SYMBOLS[data] * power_range(which, False, len(data), first))])
        return first

    def eight(self, places: np.ndarray, left: np.ndarray | int) -> np.ndarray:
        """The eight bytes at each place, or as many as are left, as numbers in the order of the bytes."""
        found = np.ndarray((len(self.data) - 7,), ">u8", self.data.data, strides=(1,))[places].astype(U64)
        return found >> (U64(8) * np.maximum(0, 8 - np.asarray(left)).astype(U64))

    def prints(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple((sums[places + length] - sums[places]) * power_at(which, True, places) for which, sums in enumerate(self.sums))

    def common(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """How many bytes each pair of places has in common, below length, by bisection."""
        sums, (a, b) = self.sums[0], (np.minimum(a, b), np.maximum(a, b))
        shift, n = power_at(0, False, b - a), np.zeros(len(a), np.int64)
        step = 1 << (max(1, length - 1).bit_length() - 1)
        while step:
            more = n + step
            same = (more < length) & ((sums[a + np.minimum(more, length)] - sums[a]) * shift == sums[b + np.minimum(more, length)] - sums[b])
            n += step * same
            step >>= 1
        return n


def suffix_order(text: Bytes, places: np.ndarray, one: np.ndarray, two: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at these places, and whether each has its first ``length`` bytes in common with the one before.

    one, two: fingerprints of those bytes. The sort is stable and takes the sorted runs it finds as they are, so two arrays
    that lie end to end merge in linear time. Suffixes that eight bytes do not tell apart are ordered by the eight bytes
    after those that all of their group share, until each group is of one string.
    """
    key = text.eight(places, length)
    order = np.argsort(key, kind="stable")
    key = key[order]
    tied = np.r_[False, key[1:] == key[:-1]][: len(order)]
    while True:
        at = np.flatnonzero(tied)
        a, b = order[at - 1], order[at]
        unlike = at[(one[a] != one[b]) | (two[a] != two[b])]
        if not len(unlike):
            return order, tied
        group = np.cumsum(~tied) - 1
        is_open = np.zeros(group[-1] + 1, bool)
        is_open[group[unlike]] = True
        members = np.flatnonzero(is_open[group])
        own = group[members]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        shared = np.full(len(members), length, np.int64)
        later = np.flatnonzero(tied[members])
        x, y = order[members[later] - 1], order[members[later]]
        differs = np.flatnonzero((one[x] != one[y]) | (two[x] != two[y]))
        shared[later[differs]] = text.common(places[x[differs]], places[y[differs]], length)
        depth = np.repeat(np.minimum.reduceat(shared, first), np.diff(np.r_[first, len(members)]))
        own_order = order[members]
        key = text.eight(places[own_order] + depth, length - depth)
        again = np.lexsort((key, own))
        order[members], key = own_order[again], key[again]
        tied[members] = np.r_[False, (own[1:] == own[:-1]) & (key[1:] == key[:-1])]


class SuffixLevels:
    """add() takes texts; matched says of every window so far, in the order added, whether another agrees with it."""

    def __init__(self, length: int) -> None:
        self.length, self.text = length, Bytes()
        self.levels: list[tuple[int, np.ndarray]] = []
        self.places, self.one, self.two, self.matched = np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)

    def sorted(self, suffixes: np.ndarray) -> np.ndarray:
        """One of each set of suffixes that agree, in order; all that agree with another are marked."""
        order, same = suffix_order(self.text, self.places[suffixes], self.one[suffixes], self.two[suffixes], self.length)
        suffixes = suffixes[order]
        self.matched[suffixes[same | np.r_[same[1:], False][: len(same)]]] = True
        return suffixes[~same]

    def add(self, data: np.ndarray, starts: np.ndarray) -> None:
        """data: the batch's contexts end to end; starts: where its windows begin."""
        places = self.text.append(data) + starts
        one, two = self.text.prints(places, self.length)
        new = np.arange(len(self.places), len(self.places) + len(places))
        self.places, self.one, self.two = np.r_[self.places, places], np.r_[self.one, one], np.r_[self.two, two]
        self.matched = np.r_[self.matched, np.zeros(len(places), bool)]
        batch, size = self.sorted(new), 1
        while self.levels and self.levels[-1][0] == size:
            batch, size = self.sorted(np.concatenate([self.levels.pop()[1], batch])), size * 2
        for _, level in self.levels:
            self.sorted(np.concatenate([level, batch]))
        self.levels.append((size, batch))


def resolve(windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For windows.repeated: a shard's family, and the runs of matched windows of its contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kept, waiting, size, many = SuffixLevels(windows.length), [], [], 0, 0
        seen: set[tuple[int, int]] = set()

        def enter() -> None:
            nonlocal waiting, size, many
            part = pa.Table.from_batches(waiting).combine_chunks()
            data, bounds = text_bytes(part.column("content"))
            context, place = window_places(bounds, windows.length)
            index.add(data, bounds[context] + place)
            kept.append((part.drop_columns(["content", "many"]), context + many, place))
            waiting, size, many = [], 0, many + part.num_rows

        for batch in batches:
            new = []
            for i, name in enumerate(zip(batch.column("name").to_pylist(), batch.column("copy").to_pylist(), strict=True)):
                if name not in seen:
                    seen.add(name)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            _, sizes = text_bytes(batch.column("content"))
            for a, b in chunks(sizes, BATCH // 8):
                waiting.append(batch.slice(a, b - a))
                size += int(sizes[b] - sizes[a])
                if size >= BATCH:
                    enter()
        if waiting:
            enter()
        if kept:
            names = pa.concat_tables([k[0] for k in kept]).combine_chunks()
            context, place = (np.concatenate([k[i] for k in kept]) for i in (1, 2))
            first = names.column("copy").to_numpy() == 0
            hits = np.flatnonzero(index.matched & first[context])
            which, low, high = runs(context[hits], place[hits])
            names = names.take(pa.array(which)).combine_chunks()
            for batch in pa.table({"key": names.column("key"), "name": names.column("name"), "low": low.astype(np.int32), "high": high.astype(np.int32)}).to_batches(50_000):
                yield batch

    return run


def merged_spans(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """First and last starts of repeated windows as the maximal ranges that the windows cover."""
    found: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"] + length) for s in spans or ()):
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], max(high, found[-1][1]))
        else:
            found.append((low, high))
    return found


def cut_bytes(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, all_spans, kept = [], [], []
            for text, spans in zip(batch.column("_text").cast(pa.large_binary()).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                text, at, rest = text or b"", 0, []
                found = merged_spans(spans, length)
                for low, high in found:
                    rest.append(text[at:low])
                    at = high
                rest.append(text[at:])
                sizes.append(len(text))
                all_spans.append([{"start": a, "end": b} for a, b in found])
                kept.append(b"".join(rest))
            own = [pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            names = [n for n in batch.schema.names if n not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + own, names=[*names, *OWN])

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Cuts every byte that a string of ``length`` bytes covers which also starts anywhere else in the corpus.

    Texts are UTF-8 bytes, a null one empty; matches stay within a document; strings are judged on the input. Returns a
    row for each row: id_col, the columns in carry, n_bytes, spans (the maximal ranges cut, by byte) and kept (the bytes
    left, which need not be whole characters). Columns not named are left out, so no name can clash. Rows that agree in
    id and text count as different places: both are cut. A null id is an id like another. No rows give no rows.
    """
    spark = docs.sparkSession
    windows = Windows("bytes", length, max(1, length // 2))
    scratch = Scratch(spark, "suffix")
    rows = keyed(docs.select(id_col, *carry, F.col(text_col).alias("_text")), id_col, "_text")
    spans = repeated(rows.select("doc_key", "text_key", F.col("_text").alias("text")), windows, resolve, scratch)
    joined = with_spans(rows, spans.withColumnRenamed("spans", "_spans")).drop("doc_key", "text_key")
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry))
    return joined.mapInArrow(cut_bytes(length), f"{kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
