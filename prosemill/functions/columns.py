"""Document structure and counts as Catalyst expressions: no Python runs on the rows.

Each is the native twin of a function of ``prose``; tests hold the two together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.functions import rules as R
from prosemill.functions.dialect import java, java_new

GUARD = "\ue000"
#: White space but for the newline.
INLINE_SPACE = r"[\s&&[^\n]]"
#: The first of MARKDOWN within one line.
RULE_LINE = r"(?m)^[-=:|+[\s&&[^\n]]]{3,}$"


def swap(text: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(text, F.lit(java(pattern)), F.lit(java_new(new)))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern)))


def newlines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")


def strip_code(text: Column) -> Column:
    """Prose without code, its pieces joined by one space. Fences are cut first, inline code between them."""
    fenced = F.split(text, java(R.FENCE.replace("[^\\n]*)*)", "[^\\n]*)*+)")), -1)
    pieces = F.flatten(F.transform(fenced, lambda p: F.split(p, java(R.INLINE), -1)))
    return F.when(text.rlike(r"`|~~~|\[\^"), F.array_join(F.filter(pieces, lambda p: p != ""), " ")).otherwise(text)


def unwrapped(text: Column) -> Column:
    """Each block on one line."""
    trimmed = swap(text, rf"(?m)^{INLINE_SPACE}+|{INLINE_SPACE}+$", "")
    block = R.BLOCK_START.replace(r"\s", INLINE_SPACE)
    return swap(trimmed, rf"(?<=[^\n])\n(?=[^\n])(?!{block})", " ")


def plain(blocks: Column, by_line: bool = False) -> Column:
    """Of unwrapped text: URLs as one word, Markdown gone; by_line: as if each line stood alone."""
    text = swap(blocks, R.URL, "LINK")
    for pattern, new in R.MARKDOWN:
        if by_line:
            pattern = RULE_LINE if pattern == R.MARKDOWN[0][0] else pattern.replace(r"\s", INLINE_SPACE)
        text = swap(text, pattern, new)
    return text


def sentences(text: Column) -> Column:
    """Of plain text: its sentences, trimmed."""
    guarded = swap(text, R.ABBREVIATION, r"\1" + GUARD)
    pieces = F.split(swap(guarded, R.SENTENCE_END, "\\1\n"), "\n", -1)
    kept = F.filter(pieces, lambda s: s.rlike(R.WORD))
    return F.transform(kept, lambda s: F.translate(swap(s, r"^\s+|\s+\z", ""), GUARD, "."))


def letters(text: Column) -> Column:
    """The words of a text in small letters only, with a space between two."""
    return F.lower(F.translate(F.array_join(F.regexp_extract_all(text, F.lit(R.WORD), F.lit(0)), " "), "'’-", ""))


def stems(words: Column) -> Column:
    """Of letters(): words of four letters or more without silent endings and leading y, ready to count vowels in."""
    longer = F.regexp_replace(words, "(?<![a-z])[a-z]{1,3}(?![a-z])", "")
    soft = "[bcdfghjkmnpqrstvwxz]"
    return F.regexp_replace(F.regexp_replace(longer, rf"(?:(?<=[a-z]){soft}es|(?<=[a-z]{{2}})(?:{soft}e|ed))(?![a-z])", ""), "(?<![a-z])y", "")


def round1(x: Column) -> Column:
    """To one place, of the binary value, ties to even: what no built-in rounding does."""
    size = F.abs(x)
    k = F.floor(size * 10).cast("double")
    odd = 2 * k + 1
    rest = odd - 16 * size
    up = F.when(4 * size > rest, k + 1).when(4 * size < rest, k).when(k % 2 == 0, k).otherwise(k + 1)
    return F.signum(x) * up / 10


def share(n: Column, of: Column) -> Column:
    return round1(F.lit(100.0) * n / of)
