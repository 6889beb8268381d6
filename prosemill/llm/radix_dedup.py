"""Exact de-duplication by distributed most-significant-digit radix partitioning.

Documents are split by their bytes from the front. A digit is a run of bytes, eight times as long in each round, closed by
a mark for whether the text ends there. Documents of one group that share the digit form a group of the next round; one
that is alone in its group is settled, and so is a group whose texts have ended, as its members then agree in every byte.
Only the rest goes to the next round, without the bytes already compared. No text is ever compared by a digest.

Groups are counted with combining before the shuffle, so a group of copies is a row from each task, and members learn
their group by a join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.storage import Scratch
from prosemill.llm.textarrays import lowered, text_bytes

FIRST_DIGIT, GROWTH = 64, 8
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each text's first digit; if whole, also the id, the bytes after the digit and the digest to report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw, bounds = lowered(data).tobytes(), offsets.tolist()
            texts = [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            digits = pa.array([t[:FIRST_DIGIT] + (b"\x00" if len(t) > FIRST_DIGIT else b"\x01") for t in texts], pa.binary())
            if not whole:
                yield pa.RecordBatch.from_arrays([digits], names=["digit"])
                continue
            rest = pa.array([t[FIRST_DIGIT:] for t in texts], pa.binary())
            sums = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), digits, rest, sums], names=["id", "digit", "rest", "text_sha256"])

    return run


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups texts that are identical after lower-casing A to Z; of each group the row with the largest id stays.

    Returns a row for each row of docs: id_col, keep_id (the id of the row that stays), group_size, kept, and text_sha256 of
    the normalised text. A null text counts as empty; empty texts are equal. A null id is less than any other. Of
    rows with equal text and id exactly one is kept. Other columns are left out, so no name can clash; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    again = texts.mapInArrow(normalised(False), "digit binary").groupBy("digit").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("digit", F.lit(True).alias("again"))
    again = scratch.write(again, "again")  # written, so that adaptive execution may split a hot digit of the join
    whole = texts.mapInArrow(normalised(True), f"id {kind}, digit binary, rest binary, text_sha256 string")
    # Shuffled whatever the size of the other side: what fits a broadcast on a small corpus does not on a large one.
    state = whole.join(again.hint("merge"), "digit", "left").select("id", "text_sha256", F.when(F.col("again"), F.col("digit")).alias("group"), F.when(F.col("again"), F.col("rest")).alias("rest"))
    state = scratch.write(state.withColumn("row", F.monotonically_increasing_id()), "round0")
    done = [state.where("group is null").select("id", "text_sha256", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))]
    state, size, number = state.where("group is not null"), FIRST_DIGIT * (GROWTH - 1), 0
    while not state.isEmpty():
        number += 1
        state, finished = next_round(scratch, state, size, number)
        done.append(finished)
        size *= GROWTH
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(F.col("id").alias(id_col), *RESULT)


def next_round(scratch: Scratch, state: DataFrame, size: int, number: int) -> tuple[DataFrame, DataFrame]:
    """Splits each group by its next digit: what is still to be split, and the rows that are settled."""
    more = F.octet_length("rest") > size
    split = state.select(
        "row", "id", "text_sha256", "group", more.alias("more"),
        F.concat(F.substring("rest", 1, size), F.when(more, F.lit(b"\x00")).otherwise(F.lit(b"\x01"))).alias("digit"),
        F.when(more, F.expr(f"substring(rest, {size + 1}, 2147483647)")).alias("rest"),
    )
    groups = split.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("least"), F.max(F.struct("id", (-F.col("row")).alias("row"))).alias("top")).where("size > 1")
    found = split.join(scratch.write(groups, f"groups{number}").hint("merge"), ["group", "digit"], "left")
    going = F.col("size").isNotNull() & F.col("more")
    table = scratch.write(
        found.select(
            "row", "id", "text_sha256", going.alias("going"), F.when(going, F.col("rest")).alias("rest"), F.when(going, F.encode(F.col("least").cast("string"), "UTF-8")).alias("group"),
            F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
            F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
            (F.col("size").isNull() | (F.col("top.row") == -F.col("row"))).alias("kept"),
        ),
        f"round{number}",
    )
    return table.where("going").select("row", "id", "text_sha256", "group", "rest"), table.where("not going").select("id", *RESULT)
