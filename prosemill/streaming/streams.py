"""The transforms on streams. All but the spacing of gaps are stateless, so they are the batch transforms themselves.

Gaps of a book keep, for each (book, acronym), the last event: its entry and whether it was a flag. Entries must come in
order; one that comes after a later entry of its acronym is marked late and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prosemill.functions import rules as R
from prosemill.operators.documents import first_uses

GAPS = "book string, acronym string, entry int, flagged boolean, late boolean"


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    book, acronym = key
    last, flag, seen = state.get if state.exists else (None, False, -1)
    rows = []
    for entry, known in sorted((int(e), bool(k)) for part in batches for e, k in zip(part["entry"], part["known"], strict=True)):
        late = entry <= seen
        due = not late and not known and (last is None or entry - last >= R.SPACING)
        if not late:
            seen = entry
            if known or due:
                last, flag = entry, due
        if due or late:
            rows.append((book, acronym, entry, due, late))
    state.update((last, flag, seen))
    yield pd.DataFrame(rows, columns=["book", "acronym", "entry", "flagged", "late"])


def spaced_gaps_stream(docs: DataFrame, book_col: str = "book_id", entry_col: str = "entry", text_col: str = "text") -> DataFrame:
    """Flagged first uses of a stream of entries, and late ones: book, acronym, entry, flagged, late."""
    keyed = docs.select(F.struct(F.col(book_col).cast("string").alias("book"), F.col(entry_col).cast("int").alias("entry")).alias("_key"), text_col)
    uses = first_uses(keyed, "_key", text_col).select("_key.book", "_key.entry", "acronym", F.col("explained").isNotNull().alias("known"))
    return uses.groupBy("book", "acronym").applyInPandasWithState(fold, GAPS, "last int, flag boolean, seen int", "append", GroupStateTimeout.NoTimeout)
