"""The shared patterns of ``rules`` as each engine spells them.

Java (Spark): (?U) for Unicode classes and (?d) for newlines as the only line ends; $1 in replacements. RE2 (DuckDB) has no
lookaround and only ASCII classes, so the SQL counterparts first turn other letters into underscores, one for one.
"""

from __future__ import annotations

import re


def java(pattern: str) -> str:
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?{flags[1]}Ud){pattern[flags.end() :]}" if flags else f"(?Ud){pattern}"


def java_new(replacement: str) -> str:
    return replacement.replace("\\1", "$1")


def sql_text(value: str) -> str:
    """A DuckDB string literal."""
    return "'" + value.replace("'", "''") + "'"
