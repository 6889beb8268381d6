"""The functions by name in SQL: prose_* scalars, and prose_findings as a table function for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prosemill.functions import findings, measuring, prose


def register(spark: SparkSession) -> None:
    def scalar(name: str, kind: str, function) -> None:
        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([function(prose.newlines(t)) for t in texts])

        spark.udf.register(name, run)

    scalar("prose_typography", "string", lambda t: findings.typography(t).text)
    scalar("prose_simplify", "string", lambda t: findings.simplify(t).text)
    scalar("prose_words", "int", prose.measured_words)
    scalar("prose_reading_ease", "double", lambda t: measuring.counted(t)[0].get("flesch_reading_ease"))
    scalar("prose_over_budget", "array<string>", lambda t: measuring.measure(t).over_budget())
    scalar("prose_tells", "int", lambda t: len(findings.tells(t)))

    @F.udtf(returnType="rule string, kind string, text string, line int, col int, fix string, hint string")
    class Findings:
        def eval(self, text: str | None) -> Iterator[tuple]:
            text = prose.newlines(text)
            for f in findings.placed(text, findings.review(text)):
                yield tuple(f[k] for k in ("rule", "kind", "text", "line", "col", "fix", "hint"))

    spark.udtf.register("prose_findings", Findings)
