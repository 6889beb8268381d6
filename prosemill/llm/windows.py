"""Which windows of a fixed number of symbols occur more than once in a corpus: how windows reach the index that decides it.

Moving every window to the windows it may equal would move many times the corpus. So each window names one *anchor*: the
place, among its runs of ``head`` symbols, where the run's fingerprint is least. Equal windows hold their anchors at the
same place, so they have the same head, and the *context* of an anchor, the union of the windows that name it, goes to the
index once with all of them:

1. Contexts whose head occurs once in the corpus hold no repeated window and go nowhere.
2. Of equal contexts two go, with the text of two places that hold them, however many there are: pre-aggregation, combined
   before the shuffle.
3. Contexts are dealt by head to shards of about SHARD bytes, so windows that may be equal meet in one. ``resolve`` is the
   index of a shard, and it alone says which windows are repeated: a family of suffix arrays or a set of reference blocks.
4. A head with more than ``most`` different contexts is dealt further first: its windows are split in two by how far before
   the anchor they begin, and each half by the symbols that all its windows hold, a longer key than the head. Halves with
   different keys share no window, so what is alone with its key goes nowhere again, and equal halves are pre-aggregated.
   At the last cut the key is the window itself, so this ends, and no shard holds a hot head whole.

Places that hold a context learn its repeated windows by a join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.storage import Scratch
from prosemill.llm.textarrays import BYTE_SYMBOLS, SEGMENT, U64, Fingerprints, chunks, mixed, text_bytes, word_symbols, words

#: Different contexts that a shard may hold of one key, and the bytes of contexts that a shard should hold.
MOST, SHARD = 512, 2 << 20
KEY = ("doc_key", "text_key")
ANCHORS = "doc_key string, text_key long, first int, many int, key long, name long"
CONTENT = "key long, name long, copy int, many int, content binary"
PARTS = "parent_key long, parent_name long, shift int, key long, name long, many int, place int, low int, high int, content binary"
RESOLVED = "key long, name long, low int, high int"
POSITION = (1 << 24) - 1


@dataclass(frozen=True)
class Windows:
    """unit: bytes or words; length: of a window; head: symbols by which windows choose their anchor; most: as MOST."""

    unit: str
    length: int
    head: int
    most: int = MOST

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts that lie end to end, and where each text's begin."""
        if self.unit == "bytes":
            return BYTE_SYMBOLS[data], offsets
        starts, ends, bounds = words(data, offsets)
        return word_symbols(data, starts, ends), bounds

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of each symbol, and where each text's symbols begin."""
        if self.unit == "bytes":
            at = np.arange(len(data))
            return at, at + 1, offsets
        return words(data, offsets)


def segments(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first symbol and end of the pieces in which a text's windows are sought; pieces overlap by length - 1."""
    sizes = np.diff(bounds)
    many = np.maximum(1, -(-sizes // SEGMENT))
    text = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = bounds[text] + nth * SEGMENT
    end = np.minimum(bounds[text + 1], first + SEGMENT + length - 1)
    return text, first, end


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least of each width values in a row."""
    least = (values & U64(~POSITION & (2**64 - 1))) | np.arange(len(values), dtype=U64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & U64(POSITION)).astype(np.int64)


def named(prints: np.ndarray, place: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The name of a context: its symbols, where its anchor lies, and how many windows it has."""
    return mixed(prints + place.astype(U64) * U64(0x9E3779B97F4A7C15) + many.astype(U64))


def anchors(symbols: np.ndarray, length: int, head: int) -> tuple[np.ndarray, ...]:
    """Of one piece: each anchor's first window, number of windows, head, context and place."""
    n = len(symbols) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),)
    one, two = Fingerprints(symbols, 0), Fingerprints(symbols, 1)
    heads = one.windows(head)
    at = sliding_argmin(heads, length - head + 1)[:n]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    many = np.diff(np.r_[first, n])
    place = at[first]
    return first, many, heads[place], named(two.ranges(first, first + many + length - 1), place - first, many), place


def anchor_rows(windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in chunks(offsets):
                symbols, bounds = windows.symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found = []
                for text, first, end in zip(*segments(bounds, windows.length), strict=True):
                    if end - first >= windows.length:
                        start, many, key, name, _ = anchors(symbols[first:end], windows.length, windows.head)
                        found.append((np.full(len(start), a + text), start + (first - bounds[text]), many, key, name))
                if found:
                    text, start, many, key, name = (np.concatenate(x) for x in zip(*found, strict=True))
                    rows = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_key").take(rows), batch.column("text_key").take(rows), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(name.view(np.int64))],
                        names=["doc_key", "text_key", "first", "many", "key", "name"],
                    )

    return run


def context_rows(windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts each wanted context out of its text; of rows alike in id and text, which come one after another, out of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
            new = [i for i, name in enumerate(names) if name != (names[i - 1] if i else last)]
            last = names[-1] if names else last
            batch = batch.take(pa.array(new, pa.int64()))
            data, offsets = text_bytes(batch.column("text"))
            wanted = batch.column("wanted")
            for a, b in chunks(offsets):
                part = wanted.slice(a, b - a)
                rows = part.flatten()
                text = np.repeat(np.arange(b - a), part.value_lengths().to_numpy())
                first, many = (rows.field(x).to_numpy().astype(np.int64) for x in ("first", "many"))
                own = data[offsets[a] : offsets[b]]
                begins, ends, bounds = windows.edges(own, offsets[a : b + 1] - offsets[a])
                begin, end = begins[bounds[text] + first], ends[bounds[text] + first + many + windows.length - 2]
                raw = own.tobytes()
                # cut again by bytes, as contexts overlap and may come to more than an Arrow array holds
                for i, j in chunks(np.r_[0, np.cumsum(end - begin)]):
                    content = pa.array([raw[s:e] for s, e in zip(begin[i:j].tolist(), end[i:j].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(rows.field(x).slice(i, j - i) for x in ("key", "name", "copy", "many")), content, rows.field("hot").slice(i, j - i)], names=["key", "name", "copy", "many", "content", "hot"])

    return run


def part_rows(windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The two parts of each context of a hot key. low and high: how far before the anchor its windows may begin (null: anywhere)."""
    length, reach = windows.length, windows.length - windows.head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                data, offsets = text_bytes(rows.column("content"))
                symbols, bounds = windows.symbols(data, offsets)
                begins, ends, _ = windows.edges(data, offsets)
                one, two = Fingerprints(symbols, 0), Fingerprints(symbols, 1)
                out: list[tuple] = []
                fields = zip(*(rows.column(c).to_pylist() for c in ("key", "name", "many", "place", "low", "high")), bounds[:-1].tolist(), strict=True)
                for key, name, many, place, low, high, at in fields:
                    if place is None:
                        place, low, high = int(anchors(symbols[at : at + length], length, windows.head)[4][0]), 0, reach
                    middle = (low + high) // 2
                    for nearest, farthest in ((low, middle), (middle + 1, high)):
                        first, last = max(0, place - farthest), min(many - 1, place - nearest)
                        if nearest <= farthest and first <= last:
                            held = one.ranges(np.array([at + place - nearest]), np.array([at + place - farthest + length]))
                            own = two.ranges(np.array([at + first]), np.array([at + last + length]))
                            n = last - first + 1
                            new_key = mixed(held + U64(key & (2**64 - 1)) + U64(nearest * 1024 + farthest))
                            new_name = named(own, np.array([place - first]), np.array([n]))
                            cut = data[begins[at + first] : ends[at + last + length - 1]].tobytes()
                            out.append((key, name, first, int(new_key.view(np.int64)[0]), int(new_name.view(np.int64)[0]), n, place - first, nearest, farthest, cut))
                kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.binary()]
                names = [x.split()[0] for x in PARTS.split(", ")]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def window_places(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and place of each window of contexts whose symbols lie end to end."""
    many = np.maximum(0, np.diff(bounds) - length + 1)
    context = np.repeat(np.arange(len(many)), many)
    return context, np.arange(len(context)) - np.repeat(np.cumsum(many) - many, many)


def runs(context: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive places of a context, from pairs in any order: context, first, last."""
    order = np.lexsort((place, context))
    context, place = context[order], place[order]
    new = np.r_[True, (context[1:] != context[:-1]) | (place[1:] > place[:-1] + 1)] if len(context) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(context)] - 1 if len(first) else first
    return context[first], place[first], place[last]


def contexts(docs: DataFrame, shared: DataFrame, windows: Windows, scratch: Scratch) -> DataFrame:
    """CONTENT rows, and whether their key is hot: of each context the text of one place, or of two if more hold it."""
    place = F.struct("doc_key", "text_key", "first", "many")
    examples = scratch.write(shared.groupBy("key", "name").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("one"), F.max(place).alias("two")), "examples")
    different = examples.groupBy("key").agg(F.count(F.lit(1)).alias("different"))
    hot = scratch.write(different.where(F.col("different") > windows.most).select("key", F.lit(True).alias("hot")), "hot")
    copies = examples.join(hot.hint("merge"), "key", "left").select(
        "key", "name", F.coalesce("hot", F.lit(False)).alias("hot"), F.posexplode(F.when(F.col("times") > 1, F.array("one", "two")).otherwise(F.array("one"))).alias("copy", "at")
    )
    wanted = copies.groupBy("at.doc_key", "at.text_key").agg(F.collect_list(F.struct("at.first", "at.many", "key", "name", "copy", "hot")).alias("wanted"))
    held = docs.join(wanted.hint("merge"), [docs[k].eqNullSafe(wanted[k]) for k in KEY]).select(docs["doc_key"], docs["text_key"], "text", "wanted")
    return held.mapInArrow(context_rows(windows), f"{CONTENT}, hot boolean")


def dealt_further(content: DataFrame, windows: Windows, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """Content without a hot key, and of each round the parts with the contexts they were cut from."""
    settled, rounds = content.where("not hot").drop("hot"), []
    content = content.where("hot").withColumns({c: F.lit(None).cast("int") for c in ("place", "low", "high")})
    while not content.isEmpty():
        parts = content.select("key", "name", "many", "content", "place", "low", "high").mapInArrow(part_rows(windows), PARTS)
        parts = scratch.write(parts, f"parts{len(rounds)}")
        same = parts.groupBy("key", "name").agg(F.count(F.lit(1)).alias("times"), *(F.any_value(c).alias(c) for c in ("many", "place", "low", "high", "content")))
        same = scratch.write(same, f"same{len(rounds)}")
        # Again a key that occurs once holds no repeated window. Written, so that adaptive execution may split a hot key of the join.
        keys = same.groupBy("key").agg(F.sum("times").alias("all"), (F.count_if(F.col("low") < F.col("high")) > windows.most).alias("hot")).where(F.col("all") > 1)
        keys = scratch.write(keys.select("key", "hot"), f"again{len(rounds)}")
        twice = F.explode(F.when(F.col("times") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
        content = scratch.write(same.join(keys.hint("merge"), "key").select("key", "name", twice, "many", "content", "hot", "place", "low", "high"), f"content{len(rounds)}")
        rounds.append(scratch.write(parts.select("parent_key", "parent_name", "shift", "key", "name").distinct(), f"cuts{len(rounds)}"))
        scratch.drop(*(f"{x}{len(rounds) - 1}" for x in ("parts", "again", "same")))
        settled = settled.unionByName(content.where("not hot").select("key", "name", "copy", "many", "content"))
        content = content.where("hot")
    return settled, rounds


def repeated(docs: DataFrame, windows: Windows, resolve: Callable[[Windows], Callable], scratch: Scratch) -> DataFrame:
    """docs: doc_key, text_key, text. Returns for each key with any: spans, of first and last starts of repeated windows.

    resolve(windows) maps the CONTENT rows of a shard to RESOLVED rows of those of copy 0.
    """
    found = scratch.write(docs.mapInArrow(anchor_rows(windows), ANCHORS), "anchors")
    # Written, so that adaptive execution may split a hot head of the join.
    heads = scratch.write(found.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "heads")
    shared = scratch.write(found.join(heads.hint("merge"), "key"), "shared")
    scratch.drop("anchors", "heads")
    content = scratch.write(contexts(docs, shared, windows, scratch), "content")
    content, rounds = dealt_further(content, windows, scratch)
    size = content.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    edges = scratch.write(content.repartition(max(1, -(-size // SHARD)), "key").mapInArrow(resolve(windows), RESOLVED), "edges")
    for i, parts in reversed(list(enumerate(rounds))):
        above = parts.join(edges.hint("merge"), ["key", "name"]).select(F.col("parent_key").alias("key"), F.col("parent_name").alias("name"), (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high"))
        edges = scratch.write(edges.unionByName(above), f"edges{i}")
    edges = scratch.write(edges.groupBy("key", "name").agg(F.collect_set(F.struct("low", "high")).alias("edges")), "repeats")
    places = shared.join(edges.hint("merge"), ["key", "name"]).select(*KEY, F.transform("edges", lambda e: F.struct((F.col("first") + e["low"]).alias("low"), (F.col("first") + e["high"]).alias("high"))).alias("edges"))
    # A set, as rows alike in id and text bring the same edges.
    return places.groupBy(*KEY).agg(F.flatten(F.collect_set("edges")).alias("spans"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key of a row is its id with a hash of its text: rows alike in both are alike in their result."""
    return docs.withColumns({"doc_key": F.col(id_col).cast("string"), "text_key": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    same: list[Column] = [docs[k].eqNullSafe(spans[k]) for k in KEY]
    return docs.join(spans.hint("merge"), same, "left").drop(*[spans[k] for k in KEY])
