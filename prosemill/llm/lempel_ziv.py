"""Removal of repeated word passages by relative Lempel-Ziv parsing.

What ``windows`` cuts out of the documents, every stretch that may hold a repeated window, is parsed greedily against the
reference blocks of its shard: all the stretches parsed there before it, indexed by each window of ``length`` words. At a
window that a block holds, the factor runs on for as long as text and block agree; a factor, being at least ``length`` words
long, is a duplicate span, in the text and in the block. After a factor the parse looks up the next window, the first
across the factor's boundary, and so on until one is known: a passage that goes over from one block to another is found
whole, as every window that no factor covers is looked up. Windows not known enter the index with the text as their block.

A shard holds all stretches that could share a window, so its blocks are every block that a factor may come from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.storage import Scratch
from prosemill.llm.suffix_index import merged_spans
from prosemill.llm.windows import Windows, keyed, repeated, with_spans

OWN = ("n_words", "n_removed", "kept_words", "kept_text")


class ReferenceBlocks:
    """Blocks of word numbers, and where each window of ``length`` words first stands."""

    def __init__(self, length: int):
        self.length = length
        self.numbers: dict[bytes, int] = {}
        self.blocks: list[np.ndarray] = []
        self.index: dict[bytes, tuple[int, int]] = {}

    def parse(self, text: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Factors of at least length words as (start, block, start there, words); the text becomes a block."""
        length, numbers, own, at, found = self.length, self.numbers, len(self.blocks), 0, []
        words = np.array([numbers.setdefault(w, len(numbers)) for w in text], np.int32)
        raw = words.tobytes()
        self.blocks.append(words)
        while at + length <= len(text):
            block, there = self.index.setdefault(raw[4 * at : 4 * (at + length)], (own, at))
            if (block, there) == (own, at):
                at += 1
                continue
            rest, other = words[at + length :], self.blocks[block][there + length :]
            both = min(len(rest), len(other))
            differ = np.flatnonzero(rest[:both] != other[:both])
            n = length + (int(differ[0]) if len(differ) else both)
            found.append((at, block, there, n))
            at += n - length + 1
        return found


def resolve(windows: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For windows.repeated: the blocks of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, names, rows = ReferenceBlocks(windows.length), [], set()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for key, name, copy, content in zip(*(batch.column(c).to_pylist() for c in ("key", "name", "copy", "content")), strict=True):
                if (name, copy) in seen:
                    continue
                seen.add((name, copy))
                names.append((key, name, copy))
                for at, block, there, n in blocks.parse(content.split()):
                    rows |= {(len(names) - 1, at, at + n - windows.length), (block, there, there + n - windows.length)}
        found = [(*names[i][:2], low, high) for i, low, high in rows if names[i][2] == 0]
        if found:
            kinds = {"key": pa.int64(), "name": pa.int64(), "low": pa.int32(), "high": pa.int32()}
            yield from pa.table({c: pa.array(x, k) for (c, k), x in zip(kinds.items(), zip(*found, strict=True), strict=True)}).to_batches(50_000)

    return run


def cut_words(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept_words, kept_text = [], [], [], []
            for text, spans in zip(batch.column("_text").cast(pa.large_binary()).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                words, cut, at, left, pieces = (text or b"").split(), 0, 0, [], []
                found = merged_spans(spans, length)
                for low, high in found:
                    left += words[at:low]
                    cut, at = cut + high - low, high
                left += words[at:]
                total.append(len(words))
                removed.append(cut)
                kept_words.append(b" ".join(left))
                if found:  # the text without the passages, each with the blanks after it
                    place, n = 0, 0
                    spans_of = word_starts(text)
                    for low, high in found:
                        pieces.append(text[place : spans_of[low]])
                        place = spans_of[high] if high < len(words) else len(text)
                    pieces.append(text[place:])
                    text = b"".join(pieces)
                kept_text.append(text)
            own = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_words, pa.binary()).cast(pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())]
            names = [n for n in batch.schema.names if n not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + own, names=[*names, *OWN])

    return run


def word_starts(text: bytes) -> list[int]:
    from prosemill.llm.textarrays import words

    return words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tolist()


def remove_repeated_passages(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Cuts every word that a window of ``length`` words covers whose word sequence also starts anywhere else.

    Words are the maximal runs of characters other than U+0020 and U+0009 to U+000D, unchanged; windows stay within a
    document (null text: no words) and are judged on the input. Returns a row for each row: id_col, the columns in carry,
    n_words, n_removed, kept_words (the words left, joined by one space) and kept_text (the text without the passages,
    its other blanks as they were; null stays null). Columns not named are left out, so no name can clash. Rows that agree
    in id and text are different places: both are cut. A null id is an id like another. No rows give no rows.
    """
    windows = Windows("words", length, max(1, length // 3 + 1))
    scratch = Scratch(docs.sparkSession, "passages")
    rows = keyed(docs.select(id_col, *carry, F.col(text_col).alias("_text")), id_col, "_text")
    spans = repeated(rows.select("doc_key", "text_key", F.col("_text").alias("text")), windows, resolve, scratch)
    joined = with_spans(rows, spans.withColumnRenamed("spans", "_spans")).drop("doc_key", "text_key")
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *carry))
    return joined.mapInArrow(cut_words(length), f"{kind}, n_words long, n_removed long, kept_words string, kept_text string")
