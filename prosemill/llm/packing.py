"""Packing of token sequences by shortest-pack-first over the length histogram.

Documents are tokenised once and cut into pieces: whole ones of the capacity, and a tail. The histogram of lengths (at most
``capacity`` rows, whatever the corpus) goes to the driver, which places lengths longest first, each into the packs with the
most room left, many packs at once: a pack is known only by its pattern, and a pattern by how many packs have it. So the
patterns, too, are bounded by the capacity. Pieces are then ranked within their length, and each finds its pattern, pack
and place by its rank.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.storage import Scratch

#: Parts in which the pieces of one length are ranked, so that a common length is no single task.
SALTS = 256
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"
#: How byte-level tokenizers split a text before they merge.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Encoder = Callable[[list[str]], list[np.ndarray]]
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """Ids as the tokenizers library gives them, loaded once for each worker.

    For a plain byte-level BPE file whose ids are the ranks of its merges, the same ids come from tiktoken over the same
    vocabulary, at several times the speed. Texts that hold one of the file's added tokens, and other kinds of file, go
    through the tokenizers library itself.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        added = [t.content for t in own.get_added_tokens_decoder().values()]
        ranks = byte_level_ranks(path)

        def by_library(texts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, "<u4") for e in own.encode_batch_fast(texts, add_special_tokens=False)]

        if ranks is None:
            _encoders[path] = by_library
        else:
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

            def encode(texts: list[str]) -> list[np.ndarray]:
                return [by_library([t])[0] if any(x in t for x in added) else np.array(fast.encode_ordinary(t), "<u4") for t in texts]

            _encoders[path] = encode
    return _encoders[path]


def byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes, if the file is a byte-level BPE without other steps and its ids are in the order of merges."""
    import json

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    split, model = held.get("pre_tokenizer") or {}, held["model"]
    level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain = not held.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model.get("type") != "BPE" or not level or not plain:
        return None
    # Printable bytes stand for themselves, the others for the characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    names = {t for t in model["vocab"] if all(c in letters for c in t)} - {t["content"] for t in held.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): model["vocab"][t] for t in names}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    return ranks if in_order and len(ranks) == 256 + len(merges) and all(ranks.get(bytes([b]), 256) < 256 for b in range(256)) else None


def cut(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for row, ids in enumerate(encode([t or "" for t in part.column("_text").to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(ids))
                names = [n for n in part.schema.names if n != "_text"]
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(n).take(take) for n in names] + [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)], names=[*names, "start", "length", "ids_crc32", "doc_tokens"])

    return run


@dataclass
class Pattern:
    """A pack's lengths in the order they were placed, each with how often, and how many packs are so filled."""

    lengths: tuple[tuple[int, int], ...]
    packs: int
    first: int = field(default=0)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Places lengths longest first, each into packs of the pattern that is shortest so far."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, found in open_packs.items() if found), default=0)
            if room < length:
                open_packs[capacity - length].append(((length,), left))
                break
            lengths, packs = open_packs[room].pop()
            used = min(packs, left)
            if packs > used:
                open_packs[room].append((lengths, packs - used))
            open_packs[room - length].append(((*lengths, length), used))
            left -= used
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for found in open_packs.values():
        for lengths, packs in found:
            merged[lengths] += packs
    patterns, first = [], 0
    for lengths, packs in sorted(merged.items(), reverse=True):
        runs: list[tuple[int, int]] = []
        for x in lengths:
            if runs and runs[-1][0] == x:
                runs[-1] = (x, runs[-1][1] + 1)
            else:
                runs.append((x, 1))
        patterns.append(Pattern(tuple(runs), packs, first))
        first += packs
    return patterns


def intervals(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, times in a pack, first pack, offset in the pack)."""
    rows, ranks = [], defaultdict(int)
    for p in patterns:
        offset = 0
        for length, times in p.lengths:
            low = ranks[length]
            ranks[length] += p.packs * times
            rows.append((length, low, ranks[length], times, p.first, offset))
            offset += length * times
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row: id_col, start (ids before it), length, ids_crc32, doc_tokens, sequence_id and offset.

    A row's ids are its text's (null: empty) and end_id; each lies in one piece. sequence_id counts from 0 and a sequence's
    pieces fill it from offset 0 without gaps. Rows alike in id and text are packed each for itself; a null id is carried.
    Other columns are left out, so no name can clash. No rows give no rows. tokenizer: a path that executors can open.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    salt = F.pmod(F.xxhash64("_id", "start", "ids_crc32"), F.lit(SALTS))
    pieces = scratch.write(texts.mapInArrow(cut(tokenizer, capacity, end_id), f"_id {kind}, {PIECE}").withColumn("salt", salt), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("times"))
    histogram = {r["length"]: r["times"] for r in counts.groupBy("length").agg(F.sum("times").alias("times")).collect()}  # at most capacity rows
    rows = intervals(shortest_pack_first(histogram, capacity))
    places = spark.createDataFrame(rows, "length long, low long, high long, times long, first long, base long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select("length", "salt", F.coalesce(F.sum("times").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("_id", "start", "ids_crc32")
    ranked = pieces.withColumn("within", F.row_number().over(within) - 1).join(parts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    found = ranked.join(F.broadcast(places), "length").where("rank >= low and rank < high")
    nth = F.col("rank") - F.col("low")
    return found.select(
        F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.expr("(rank - low) div times")).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(nth, F.col("times")) * F.col("length")).cast("long").alias("offset"),
    )
