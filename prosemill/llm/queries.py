"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.llm.ordinal import rate

    docs = table(spark, sf_dir, "documents")
    return rate(docs, quality_model(spark, sf_dir, docs))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """Grades: 0 toxic, 1 neither toxic nor good, 2 good."""
    from prosemill.llm.ordinal import train

    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return train(docs, table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")), 3)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.llm.line_windows import remove_repeated_lines

    done = remove_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.llm.suffix_index import remove_repeated_bytes

    done = remove_repeated_bytes(table(spark, sf_dir, "documents"), 400)
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.llm.radix_dedup import duplicate_groups

    return duplicate_groups(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from prosemill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.llm.lempel_ziv import remove_repeated_passages

    done = remove_repeated_passages(table(spark, sf_dir, "documents"), 35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.llm.chat import format_conversations, read_conversations

    conflict = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", conflict), (-1, 1, "assistant", conflict)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = read_conversations(format_conversations(rows))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "loss_texts")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from prosemill.llm.byte_pairs import decode, encode

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = decode(encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    ids = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prosemill.llm.media import read_media, store_media

    done = read_media(store_media(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(",", F.transform("fingerprints", F.hex)).alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_line_dedup,
        op3_suffix_dedup,
        op4_exact_dedup,
        op5_ngram_jaccard_join,
        op6_packing,
        op7_substring_dedup,
        op8_chat_formatting,
        op9_byte_pairs,
        op10_media_columns,
    )
}

LINES = """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    w AS (SELECT doc_id, place, lines[place + 1 : place + 3] AS own FROM (SELECT doc_id, lines, unnest(range(greatest(len(lines) - 2, 0))) AS place FROM d)),
    r AS (SELECT own, min(struct_pack(d := doc_id, p := place)) AS first FROM w GROUP BY own HAVING count(*) > 1),
    g AS (SELECT DISTINCT doc_id, unnest(range(place, place + 3)) AS line FROM w JOIN r USING (own) WHERE struct_pack(d := doc_id, p := place) <> first),
    l AS (SELECT doc_id, unnest(lines) AS line_text, unnest(range(len(lines))) AS line FROM d),
    k AS (SELECT doc_id, string_agg(line_text, chr(10) ORDER BY line) AS kept FROM l ANTI JOIN g USING (doc_id, line) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS gone FROM g GROUP BY doc_id)
    SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

EXACT = """WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY low) AS kept,
    sha256(low) AS text_sha256 FROM t"""

#: Of the operators that SQL expresses on whole tables.
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": LINES, "op4_exact_dedup": EXACT}
