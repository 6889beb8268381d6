"""Acronym gaps across the entries of a book.

Only the first uses are shuffled, on (book, acronym); the spacing rule is a fold over each acronym's entries in order, as a
higher-order function. An acronym that every entry of one book uses is a list as long as the book, not as the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.functions import gaps, prose
from prosemill.functions import rules as R
from prosemill.operators.documents import each, first_uses


def spaced_gaps(docs: DataFrame, book_col: str = "book_id", entry_col: str = "entry", text_col: str = "text") -> DataFrame:
    """A row for each flagged first use: book_col, entry_col, acronym, last_entry, last_flagged (null: the first in the book).

    entry_col numbers the entries of a book from 0 without holes, each once.
    """
    keyed = docs.select(F.struct(F.col(book_col).alias("book"), F.col(entry_col).alias("entry")).alias("_key"), text_col)
    uses = first_uses(keyed, "_key", text_col).select("_key.book", "_key.entry", "acronym", F.col("explained").isNotNull().alias("known"))
    listed = uses.groupBy("book", "acronym").agg(F.sort_array(F.collect_list(F.struct("entry", "known"))).alias("uses"))
    event = "struct<entry: int, flagged: boolean>"
    start = F.struct(F.lit(None).cast(event).alias("last"), F.array().cast(f"array<struct<entry: int, last: {event}>>").alias("flags"))

    def step(state, use):
        due = state["last"].isNull() | (use["entry"] - state["last"]["entry"] >= R.SPACING)
        own = F.struct(use["entry"].cast("int").alias("entry"), (~use["known"]).alias("flagged"))
        flag = F.struct(use["entry"].cast("int").alias("entry"), state["last"].alias("last"))
        return F.struct(
            F.when(use["known"] | due, own).otherwise(state["last"]).alias("last"),
            F.when(~use["known"] & due, F.concat(state["flags"], F.array(flag))).otherwise(state["flags"]).alias("flags"),
        )

    flags = listed.select("book", "acronym", F.explode(F.aggregate("uses", start, step)["flags"]).alias("f"))
    return flags.select(F.col("book").alias(book_col), F.col("f.entry").alias(entry_col), "acronym", F.col("f.last.entry").alias("last_entry"), F.col("f.last.flagged").alias("last_flagged"))


def glossary_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each headword of a glossary: headword and expansion, in order."""
    run = lambda t: [{"nth": i, "headword": h, "expansion": e} for i, (h, e) in enumerate(gaps.glossary(prose.newlines(t)))]
    return each(docs, "nth int, headword string, expansion string", run, id_col, text_col)


def gap_findings(docs: DataFrame, glossary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents on their own: a row for each gap, with fix or hint from one glossary's text, and its place."""
    from prosemill.functions.findings import placed
    from prosemill.operators.documents import FINDING, positions_ddl

    entries = gaps.glossary(prose.newlines(glossary))

    def run(text: str | None) -> list[dict]:
        text = prose.newlines(text)
        return [{"nth": i} | f for i, f in enumerate(placed(text, gaps.locate(text, entries)[0]))]

    return each(docs, "nth int, " + positions_ddl(FINDING), run, id_col, text_col)


def missing_acronyms(docs: DataFrame, glossary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First uses that no word of a headword has; all stay out if the glossary (a column headword) is empty."""
    words = glossary.select(F.explode(F.regexp_extract_all("headword", F.lit("[A-Za-z0-9&]+"), F.lit(0))).alias("acronym")).distinct()
    some = words.limit(1).select(F.lit(True).alias("some"))
    return first_uses(docs, id_col, text_col).join(words, "acronym", "left_anti").join(F.broadcast(some)).select(id_col, "acronym", "start")


def anticipations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return each(docs, "anticipations int", lambda t: (gaps.anticipations(prose.newlines(t)),), id_col, text_col)
