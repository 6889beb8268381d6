"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every text becomes its set of n-grams of words. Texts with equal sets are one *class*; one of them stands for it.
2. MinHash signatures are cut into bands of rows, numbered so that a pair at the threshold shares a band with the target
   recall. Classes are shuffled on band hashes; each is tied to the least class of its bucket (a star, not all pairs).
3. What hangs together by such ties is a *neighbourhood*, which holds every pair that shares a band. A class's n-gram set
   moves once to its neighbourhood, and there all pairs are verified on their full sets by matrix products; no pair becomes
   a row. A neighbourhood too large for one task is cut into blocks. Two blocks meet in a task of their own, to which goes
   what shares a band with a class of the other block; so a long chain of neighbours moves each set a few times, not
   once for each of its blocks.
4. Verified links give each class its number of links, and their components are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.components import components
from prosemill.llm.storage import Scratch
from prosemill.llm.textarrays import U64, Fingerprints, chunks, lowered, mixed, text_bytes, word_symbols, words
from prosemill.llm.windows import keyed

#: Classes and n-grams that one block of a neighbourhood may have.
BLOCK_CLASSES, BLOCK_GRAMS = 512, 1 << 20
#: Bands of this many rows at least: fewer chance meetings of texts that share a passage only.
ROWS = 8
RECALL = 0.99
COLUMNS = 2048


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    @staticmethod
    def for_recall(threshold: float, recall: float = RECALL, rows: int = ROWS) -> Banding:
        """The fewest bands at which 1 - (1 - threshold ** rows) ** bands reaches the recall."""
        return Banding(max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999, threshold**rows)))), rows)


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Of texts end to end: the sorted hashes of the different n-grams; a text of fewer words is one n-gram."""
    small = lowered(data)
    starts, ends, bounds = words(small, offsets)
    symbols = word_symbols(small, starts, ends)
    prints = Fingerprints(symbols, 0)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = min(size, b - a)
        at = np.arange(a, b - n + 1) if n else np.zeros(0, np.int64)
        sets.append(np.unique(prints.ranges(at, at + n)))
    return sets


def band_hashes(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray, banding: Banding) -> np.ndarray:
    least = np.full(len(factors), 2**64 - 1, U64)
    for a in range(0, len(grams), 2048):
        least = np.minimum(least, (grams[None, a : a + 2048] * factors[:, None] + offsets[:, None]).min(1))
    rows = mixed(least).reshape(banding.bands, banding.rows)
    total = np.arange(1, banding.bands + 1, dtype=U64)
    for k in range(banding.rows):
        total = mixed(total * U64(0x9E3779B97F4A7C15) + rows[:, k])
    return total


def signature_rows(size: int, banding: Banding):
    random = np.random.default_rng(977)
    factors = random.integers(1, 1 << 63, banding.bands * banding.rows, dtype=U64) * U64(2) + U64(1)
    offsets = random.integers(0, 1 << 63, banding.bands * banding.rows, dtype=U64) * U64(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for a, b in chunks(bounds):
                sets = gram_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)
                one = np.array([mixed(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) for s in sets], U64)
                two = np.array([mixed(s ^ U64(0x14057B7EF767814F)).sum(dtype=U64) for s in sets], U64)
                bands = np.concatenate([band_hashes(s, factors, offsets, banding) if len(s) else np.zeros(banding.bands, U64) for s in sets])
                at = pa.array((np.arange(b - a + 1) * banding.bands).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in ("id", "doc_key", "text_key")]
                    + [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(at, pa.array(bands.view(np.int64)))],
                    names=["id", "doc_key", "text_key", "one", "two", "grams", "bands"],
                )

    return run


def set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for a, b in chunks(bounds):
                sets = gram_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)
                at = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ("node", "copies")] + [pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "copies", "set"])

    return run


def shared_grams(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams that two sets or more hold, those in the same sets as one column: (column, set) of each entry; column weights."""
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    times = np.diff(np.r_[first, len(grams)])
    marks = np.random.default_rng(5).integers(0, 1 << 63, len(sets), dtype=U64)
    which = np.add.reduceat(mixed(marks[owner]), first)
    kept = np.flatnonzero(times > 1)
    _, example, weight = np.unique(which[kept], return_index=True, return_counts=True)
    example = kept[example]
    length = times[example]
    at = np.repeat(first[example] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return np.repeat(np.arange(len(example)), length), owner[at], weight


def common(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many n-grams each of the row sets shares with each of the column sets."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    if not sum(map(len, sets)):
        return out
    column, owner, weight = shared_grams(sets)
    same = len(rows) == len(columns) and (rows == columns).all()
    starts = np.searchsorted(column, np.arange(0, len(weight) + COLUMNS, COLUMNS))
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        width = min(COLUMNS, len(weight) - i * COLUMNS)
        if width <= 0:
            break
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - i * COLUMNS] = 1
        left = part[rows] * weight[i * COLUMNS : i * COLUMNS + width].astype(np.float32)
        out += left @ (part if same and len(rows) == len(part) else part[columns]).T
    return out


def least_linked(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of the components of a symmetric boolean matrix: the least of the labels in each."""
    labels = labels.copy()
    edges_a, edges_b = np.nonzero(linked)
    while len(edges_a):
        new = labels.copy()
        np.minimum.at(new, edges_a, labels[edges_b])
        if (new == labels).all():
            break
        labels = new
    return labels


LINKS = "node long, links long, label long"


def verify(threshold: float):
    """For one pair of blocks: each class's links to the other block (weighted by copies), and a class it hangs together with."""
    # linked if common >= threshold * (sizes - common), in whole millionths
    parts = round(threshold * 1_000_000)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        own = table.column("own").to_numpy()
        lists = table.column("set").combine_chunks()
        flat, at = lists.flatten().to_numpy().view(U64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        sets = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        size = np.array([len(s) for s in sets], np.int64)
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        rows, columns = np.flatnonzero(own == low), np.flatnonzero(own == high)
        shared = common(sets, rows, columns).astype(np.int64)
        linked = shared * (1_000_000 + parts) >= parts * (size[rows][:, None] + size[columns][None, :])
        linked &= shared > 0
        links = np.zeros(len(node), np.int64)
        whole = np.zeros((len(node), len(node)), bool)
        if low == high:
            np.fill_diagonal(linked, False)
            links[rows] = linked @ copies[rows]
            whole = linked
        else:
            links[rows] = linked @ copies[columns]
            links[columns] = linked.T @ copies[rows]
            whole[np.ix_(rows, columns)] = linked
            whole[np.ix_(columns, rows)] = linked.T
        return pa.table({"node": node, "links": links, "label": least_linked(whole, node)})

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds texts whose sets of ``size``-word n-grams have a Jaccard similarity of ``threshold`` or more.

    Words stand between blanks (U+0020, U+0009 to U+000D) and are lower-cased A to Z. A text of fewer words is one n-gram; a
    null, empty or blank text has none and is like no other. Returns a row for each row: id_col, class_id (the
    least id of its group, which links and equal sets hold together), n_links (rows whose text is linked to its own, copies
    included), copies (rows with an equal set, itself included), kept (true for one row of each group, of its least
    id), and the keys doc_key and text_key. A null id is less than any other. Columns not named are left out, so no name
    can clash. No rows give no rows. Pairs are verified in full; which are verified depends on MinHash, by the recall.
    """
    banding = Banding.for_recall(threshold, recall)
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    signed = rows.mapInArrow(signature_rows(size, banding), f"id {kind}, doc_key string, text_key long, one long, two long, grams long, bands array<long>")
    signed = scratch.write(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    # A set without n-grams is a class of its own row.
    apart = F.when(F.col("grams") == 0, F.col("row")).otherwise(F.lit(-1))
    signed = signed.withColumn("apart", apart)
    classes = signed.groupBy("one", "two", "grams", "apart").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "row")).alias("least"), F.min(F.struct("doc_key", "text_key")).alias("example"), F.any_value("bands").alias("bands"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    tied = classes.where("grams > 0").select("node", F.explode("bands").alias("band"))
    stars = tied.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least")
    stars = scratch.write(stars, "stars")  # written, so that adaptive execution may split a hot band of the join
    ties = tied.join(stars.hint("merge"), "band").where("node <> least").select(F.col("node").alias("one"), F.col("least").alias("two")).distinct()
    near = components(ties, scratch, "ties")
    asked = scratch.write(classes.join(near, "node").select("node", "component", "copies", "grams", "example.doc_key", "example.text_key"), "asked")
    sizes = asked.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))

    # The texts are shuffled whatever the size of the other side: what fits a broadcast on a small corpus does not on a large one.
    wanted = asked.select("node", "copies", F.col("doc_key").alias("_d"), F.col("text_key").alias("_t")).hint("merge")
    texts = rows.select("doc_key", "text_key", "text").join(wanted, F.col("doc_key").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t"))).select("node", "copies", "text")
    sets = scratch.write(texts.mapInArrow(set_rows(size), "node long, copies long, set array<long>"), "sets")
    homes = asked.select("node", "component").join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    homes = scratch.write(homes, "homes")
    # Which blocks a class meets: its own, and those of the classes it shares a band with.
    split = tied.join(homes.where("blocks > 1").hint("merge"), "node").select("node", "band", "own")
    met = split.groupBy("band").agg(F.collect_set("own").alias("others")).where(F.size("others") > 1)
    met = split.join(scratch.write(met, "met").hint("merge"), "band").select("node", F.explode("others").alias("other")).unionByName(homes.select("node", F.col("own").alias("other"))).distinct()
    block = F.struct(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).alias("pair")
    pairs = scratch.write(homes.join(met.hint("merge"), "node").select("node", "component", "own", block), "pairs")
    paired = sets.join(pairs.hint("merge"), "node").select("node", "copies", "set", "component", "own", "pair.*")
    found = scratch.write(paired.groupBy("component", "low", "high").applyInArrow(verify(threshold), LINKS), "found")
    scratch.drop("sets")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("node <> label").select(F.col("node").alias("one"), F.col("label").alias("two")).distinct(), scratch, "links")

    joined = classes.select("one", "two", "grams", "apart", "copies", "least", "node").join(links, "node", "left").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    heads = joined.groupBy("group").agg(F.min("least").alias("first"))
    final = scratch.write(joined.join(heads, "group").select("one", "two", "grams", "apart", "copies", F.coalesce("links", F.lit(0)).alias("links"), "first"), "final")
    out = signed.select("id", "doc_key", "text_key", "row", "one", "two", "grams", "apart").join(final, ["one", "two", "grams", "apart"])
    return out.select(
        F.col("id").alias(id_col), F.col("first.id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies",
        (F.col("row") == F.col("first.row")).alias("kept"), "doc_key", "text_key",
    )
