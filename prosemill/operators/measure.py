"""Metrics of documents and their verdicts, in Catalyst expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import columns as C
from prosemill.functions import rules as R
from prosemill.functions.dialect import java

METRICS = (
    "words", "sentences", "paragraphs", "mean_sentence_words", "max_sentence_words", "pct_long_sentences", "flesch_reading_ease", "flesch_kincaid_grade", "pct_passive_sentences",
    "pct_long_words", "max_paragraph_words", "pct_ly_adverbs",
)


def structured(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _blocks (unwrapped prose), _plain, _sentences and _sizes (words of each)."""
    return (
        docs.withColumn("_blocks", C.unwrapped(C.strip_code(C.newlines(F.col(text_col)))))
        .withColumn("_plain", C.plain(F.col("_blocks")))
        .withColumn("_sentences", C.sentences(F.col("_plain")))
        .withColumn("_sizes", F.transform("_sentences", lambda s: F.regexp_count(s, F.lit(R.WORD))))
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row: id_col, the columns in carry, scored, and the metrics; all but words and sentences are null under 30 words."""
    held = structured(docs.select(id_col, *carry, F.col(text_col).alias("_text")), "_text")
    held = held.withColumn("_letters", C.letters(F.col("_plain"))).withColumn("_stems", C.stems(F.col("_letters")))
    held = held.withColumn("_paragraphs", F.filter(F.transform(F.split(C.plain(F.col("_blocks"), by_line=True), "\n", -1), lambda p: F.regexp_count(p, F.lit(R.WORD))), lambda n: n > 0))
    words = F.regexp_count("_plain", F.lit(R.WORD))
    short = F.regexp_count("_letters", F.lit("(?<![a-z])[a-z]{1,3}(?![a-z])"))
    voiced = F.regexp_count("_stems", F.lit("(?<![a-z])[^aeiouy ]*+[aeiouy][a-z]*+"))
    vowels = F.regexp_count("_stems", F.lit("[aeiouy]{1,2}"))
    long_words = F.regexp_count("_stems", F.lit("(?<![a-z])(?:[^aeiouy ]*+[aeiouy]{1,2}+){3}[a-z]*+"))
    ly = F.regexp_count(F.array_join(F.regexp_extract_all("_plain", F.lit(R.WORD), F.lit(0)), " "), F.lit("(?<![^ ])[^ ]{3,}[lL][yY](?![^ ])"))
    passive = F.size(F.filter("_sentences", lambda s: s.rlike(java(R.PASSIVE))))
    counted = held.select(
        id_col, *carry, words.alias("words"), F.size("_sentences").alias("sentences"), F.size("_paragraphs").alias("paragraphs"),
        F.coalesce(F.array_max("_sizes"), F.lit(0)).alias("max_sentence_words"), F.coalesce(F.array_max("_paragraphs"), F.lit(0)).alias("max_paragraph_words"),
        F.size(F.filter("_sizes", lambda n: n > R.LONG_SENTENCE)).alias("_long"), passive.alias("_passive"),
        (words + vowels - voiced).alias("_syllables"), long_words.alias("_long_words"), ly.alias("_ly"), short.alias("_short"),
    )
    # A short word is one syllable, and so is a longer one without a vowel left: words - voiced covers both.
    n, s = F.col("words").cast("double"), F.col("sentences").cast("double")
    per_sentence, per_word = n / s, F.col("_syllables") / n
    scored = F.col("words") >= R.MIN_WORDS_TO_SCORE
    values: dict[str, Column] = {
        "mean_sentence_words": C.round1(per_sentence),
        "pct_long_sentences": C.share(F.col("_long"), s),
        "flesch_reading_ease": C.round1(F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word),
        "flesch_kincaid_grade": C.round1(F.lit(0.39) * per_sentence + F.lit(11.8) * per_word - F.lit(15.59)),
        "pct_passive_sentences": C.share(F.col("_passive"), s),
        "pct_long_words": C.share(F.col("_long_words"), n),
        "pct_ly_adverbs": C.share(F.col("_ly"), n),
    }
    always = {"words", "sentences"}
    shown = [F.col(m) if m in always else F.when(scored, values.get(m, F.col(m))).alias(m) for m in METRICS]
    return counted.select(id_col, *carry, scored.alias("scored"), *shown)


def judged(measured: DataFrame, budget: tuple[tuple[str, str, float], ...] = R.BUDGET) -> DataFrame:
    """Adds over_budget, the metrics that fail in the budget's order, and failed. A null metric fails nothing.

    Long sentences that join clauses of an explanation are excused only by ``gate``, which reads them; here none is.
    """
    names = [F.when((F.col(n) > limit) if direction == "max" else (F.col(n) < limit), F.lit(n)) for n, direction, limit in budget]
    over = F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    return measured.withColumn("over_budget", over).withColumn("failed", F.size("over_budget") > 0)


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each sentence: id_col, number (from 0), sentence, words."""
    held = structured(docs.select(id_col, F.col(text_col).alias("_text")), "_text")
    return held.select(id_col, F.posexplode("_sentences").alias("number", "sentence")).withColumn("words", F.regexp_count("sentence", F.lit(R.WORD)))


def paragraph_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph: id_col, number (from 0), paragraph, words."""
    blocks = C.unwrapped(C.strip_code(C.newlines(F.col(text_col))))
    lines = F.filter(F.split(C.plain(blocks, by_line=True), "\n", -1), lambda p: p.rlike(R.WORD))
    return docs.select(id_col, F.posexplode(lines).alias("number", "paragraph")).select(
        id_col, "number", C.swap(F.col("paragraph"), r"^\s+|\s+\z", "").alias("paragraph"), F.regexp_count("paragraph", F.lit(R.WORD)).alias("words")
    )


def rollup(judged_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Figures by keys that ``measure`` carried, with sub-totals (keys null) from the first key down.

    mean_reading_ease, of scored documents, is a sum of whole tenths, so the same in any order, and cut after four places.
    """
    tenths = F.sum(F.round(10 * F.col("flesch_reading_ease")).cast("long"))
    return judged_rows.rollup(*keys).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("scored").cast("int")).alias("scored_documents"), F.sum("words").alias("words"),
        F.sum(F.col("failed").cast("int")).alias("failed_documents"), (F.floor(1000 * tenths.cast("double") / F.count("flesch_reading_ease")) / F.lit(10000.0)).alias("mean_reading_ease"),
    )
