"""From documents to packed sequences: five stages in order, each working on all that its predecessor kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, with
``n_chars`` of the text as it then is. ``run`` writes each stage's result as Parquet to the session's shared folder and reads it
back as the next one's input. Extra columns travel along whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.jaccard import near_duplicates
from prosemill.llm.lempel_ziv import remove_repeated_passages
from prosemill.llm.line_windows import remove_repeated_lines
from prosemill.llm.ordinal import rate
from prosemill.llm.packing import pack
from prosemill.llm.queries import quality_model
from prosemill.llm.storage import Scratch

CAPACITY = 1024


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and one column with everything else."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias("_others"))


def _unfolded(done: DataFrame, text: Column, like: DataFrame) -> DataFrame:
    """The columns of like, with another text and its length."""
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*[new.get(c, F.col("_others")[c]).alias(c) for c in like.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose best grade is more likely than not; the others go."""
    rated = rate(_folded(docs).withColumn("kept_text", F.col("text")), quality_model(spark, sf_dir, docs), carry=("kept_text", "_others"))
    return _unfolded(rated.where("selected"), F.col("kept_text"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows from the texts; every document stays."""
    return _unfolded(remove_repeated_lines(_folded(docs), carry=("_others",)), F.col("kept_text"), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the least id."""
    from pyspark.sql import Window

    from prosemill.llm.windows import KEY, keyed

    kept = near_duplicates(docs).where("kept").select("doc_key", "text_key").distinct()
    rows = keyed(_folded(docs), "doc_id", "text")
    held = rows.join(kept, rows["doc_key"].eqNullSafe(kept["doc_key"]) & (rows["text_key"] == kept["text_key"]), "left_semi")
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("_others").cast("string")))  # of rows alike in id and text
    return _unfolded(held.withColumn("_nth", first).where((F.col("_nth") == 1) | (F.length(F.trim("text")) == 0) | F.col("text").isNull()), F.col("text"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that repeat, in every document that holds them; every document stays."""
    return _unfolded(remove_repeated_passages(_folded(docs), carry=("_others",)), F.col("kept_text"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with the sequence and place of each."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL expresses neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
