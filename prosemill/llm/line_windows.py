"""Line de-duplication by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a document are a window. Windows with equal lines are found by a shuffle of their hashes
(128 bits: two 64-bit hashes of the lines), counted with combining before it. The lines of every occurrence but the
first, by id and place, are covered, coverings that overlap merge, and covered lines go. The first occurrence stays but for
lines that a later occurrence of some window covers as well: of four equal lines, whose window occurs again one line down,
the first line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.llm.storage import Scratch

SIZE = 3
OWN = ("kept_text", "n_lines", "n_removed")


def line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("one"), F.xxhash64(F.lit("second"), x).alias("two")))


def window_hashes(hashes: Column, size: int) -> Column:
    """An array with a struct (place, one, two) for each window. hashes: a column, as a lambda evaluates what it holds anew each time."""
    last = F.size(hashes) - size

    def window(i: Column) -> Column:
        own = F.slice(hashes, i + 1, size)
        return F.struct(i.alias("place"), F.xxhash64(F.transform(own, lambda p: p["one"])).alias("one"), F.xxhash64(F.transform(own, lambda p: p["two"])).alias("two"))

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window))


def remove_repeated_lines(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes the lines of every window of ``size`` consecutive lines that occurred before, in any document.

    Before means at a lesser (id, place). A line that a first occurrence and a later one of some window share goes. Returns a row for each row: id_col, the columns in
    carry, kept_text (the lines left, joined by newlines), n_lines and n_removed. Lines are what stands between newlines;
    a null text has none and stays null, an empty one has one; documents with fewer lines than a window stay as they are.
    Rows that agree in id and text are one place, so they get the same result; a null id is less than any other.
    Columns not named are left out, so no name can clash. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), *carry, F.col(text_col).alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_text"))
    hashed = rows.select("_id", "_key", line_hashes(F.split("_text", "\n")).alias("_hashes"))
    windows = hashed.select("_id", "_key", F.explode(window_hashes(F.col("_hashes"), size)).alias("w")).select("_id", "_key", "w.*")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("_id", "_key", "place")).alias("first"), F.max(F.struct("_id", "_key", "place")).alias("last"))
    repeated = first.where(~F.col("first").eqNullSafe(F.col("last"))).select("one", "two", "first")
    repeated = Scratch(docs.sparkSession, "lines").write(repeated, "repeated")  # so that adaptive execution may split a hot window
    # Both joins shuffle whatever the size of the other side: what fits a broadcast on a small corpus does not on a large one.
    later = windows.join(repeated.hint("merge"), ["one", "two"]).where(~F.struct("_id", "_key", "place").eqNullSafe(F.col("first")))
    covered = later.groupBy("_id", "_key").agg(F.collect_set("place").alias("places")).select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), "places")
    found = rows.join(covered.hint("merge"), F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_key").eqNullSafe(F.col("_key2")), "left").withColumn("_lines", F.split("_text", "\n"))
    lines = F.col("_lines")
    # Merged, as a set: each later window's lines.
    gone = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + size - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(F.col("places").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return found.select(
        F.col("_id").alias(id_col), *carry, kept.alias("kept_text"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )
