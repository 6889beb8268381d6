"""One document's structure: code and prose, quotations, blocks, sentences, words and positions.

Offsets are code points. Patterns are compiled with the regex module, whose classes are Unicode's. What makes a text's
positions honest is that code is *masked*: blanked in place, newlines kept; what makes its counts right is that code is *cut*.
"""

from __future__ import annotations

import bisect
import contextlib
import functools
import gc
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import regex

from prosemill.functions import rules as R

GUARD = "\ue000"
#: Texts whose results the functions that several gates share keep at hand; how many lines, and how long ones.
HELD, HELD_LINES, HELD_LENGTH = 32, 4096, 4096
#: Words whose figures are kept at hand.
HELD_WORDS = 1 << 18


@functools.cache
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


@functools.cache
def plainly(pattern: str) -> re.Pattern:
    """For a pattern without \\w, \\d and \\b, in which both engines agree and re is faster: its \\s, outside classes, as Unicode's."""
    return re.compile(pattern.replace(r"\s", r"[^\S\x1c-\x1f]"))


@contextlib.contextmanager
def fewer_collections() -> Iterator[None]:
    """Few objects here are in cycles, and the words at hand are many to walk through."""
    before = gc.get_threshold()
    gc.set_threshold(100_000, 20, 20)
    try:
        yield
    finally:
        gc.set_threshold(*before)


class Kept(dict):
    """function(key) for each key, kept at hand; emptied when full."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) >= HELD_WORDS:
            self.clear()
        value = self[key] = self.function(key)
        return value


def newlines(text: str | None) -> str:
    text = text or ""
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def folded(text: str) -> str:
    """For the search for words in any case: what (?i) takes for an ASCII letter is that letter."""
    return text.lower() if text.isascii() else text.replace("\u0130", "i").casefold()


def places_of(low: str, literals: Iterable[str]) -> list[int]:
    """Where one of these stands in a folded text with no ASCII letter next to it, in order."""
    found = set()
    for literal in literals:
        size, at = len(literal), low.find(literal)
        while at >= 0:
            if not ("a" <= low[at - 1 : at] <= "z" or "a" <= low[at + size : at + size + 1] <= "z"):
                found.add(at)
            at = low.find(literal, at + 1)
    return sorted(found)


def without(text: str, spans: list[tuple[int, int]], mark: str = " ") -> str:
    """The text with a mark for each character of these."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], mark * (b - a)]
        at = b
    return "".join([*out, text[at:]]) if out else text


def around(text: str, places: Iterable[int], back: int, forward: int) -> list[tuple[int, int]]:
    """Ranges that hold the word at each place with so many words before it and after it, merged where they meet."""
    found: list[tuple[int, int]] = []
    own_end = -1
    for at in places:
        if at < own_end:
            continue
        a = b = at
        for _ in range(back + 1):
            while a and text[a - 1].isspace():
                a -= 1
            while a and not text[a - 1].isspace():
                a -= 1
        for k in range(forward + 1):
            while b < len(text) and text[b].isspace():
                b += 1
            while b < len(text) and not text[b].isspace():
                b += 1
            own_end = b if not k else own_end
        if found and a <= found[-1][1]:
            found[-1] = (min(a, found[-1][0]), max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def segments(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is_code) over the whole text. Fences are found first, inline code only between them."""
    found, at = [], 0

    def between(a: int, b: int) -> None:
        for m in compiled(R.INLINE).finditer(text[a:b]):
            prose_until(a + m.start())
            found.append((a + m.start(), a + m.end(), True))
        prose_until(b)

    def prose_until(end: int) -> None:
        start = found[-1][1] if found else 0
        if end > start:
            found.append((start, end, False))

    if "`" in text or "~~~" in text or "[^" in text:
        for m in compiled(R.FENCE).finditer(text):
            between(at, m.start())
            found.append((m.start(), m.end(), True))
            at = m.end()
        between(at, len(text))
    elif text:
        found.append((0, len(text), False))
    return found


def filled(text: str, parts: list[tuple[int, int, bool]], fill) -> str:
    """The text with code replaced, character for character; fill(code) gives the character, newlines stay."""
    out = []
    for a, b, code in parts:
        piece = text[a:b]
        out.append("\n".join(fill(piece) * len(line) for line in piece.split("\n")) if code else piece)
    return "".join(out)


@functools.lru_cache(HELD)
def mask_code(text: str) -> str:
    return filled(text, segments(text), lambda _: " ")


def strip_code(text: str) -> str:
    return " ".join(text[a:b] for a, b, code in segments(text) if not code)


# ---- Quotations ----


@dataclass
class Mark:
    at: int
    opens: bool
    closes: bool
    sure: bool


BEFORE_OPENING = frozenset("([{<*_/—–-\"'“‘")
AFTER_CLOSING = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~”’…—–")


def quotation_marks(masked: str) -> dict[str, list[Mark]]:
    """The marks that can open or close, by family: straight and curly, double and single."""
    families: dict[str, list[Mark]] = {'"': [], "“": [], "'": [], "‘": []}
    for m in compiled("[\"'“”‘’]").finditer(masked):
        at, c = m.start(), m[0]
        before, after = masked[at - 1 : at] if at else "", masked[at + 1 : at + 2]
        lead = not before or before.isspace() or before in BEFORE_OPENING
        end = bool(before) and not before.isspace() and not (before.isalnum() and after.isalnum()) and (not after or after.isspace() or after in AFTER_CLOSING)
        word = ""
        if after.isalpha() and c in "'‘":
            i = at + 1
            while i < len(masked) and masked[i].isalpha():
                i += 1
            word = masked[at + 1 : i].lower()
        starts_word = bool(word) and word not in R.ELISIONS
        if c == "“":
            mark, family = Mark(at, True, False, True), c
        elif c == "”":
            mark, family = Mark(at, False, True, True), "“"
        elif c == '"':
            mark, family = Mark(at, lead and bool(after) and not after.isspace(), end, not (before.isascii() and before.isdigit())), c
        elif c == "'":
            mark, family = Mark(at, lead and starts_word, end, False), c
        elif c == "‘":
            mark, family = Mark(at, starts_word, False, True), c
        else:
            mark, family = Mark(at, False, end, False), "‘"
        if mark.opens or mark.closes:
            families[family].append(mark)
    return families


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of each quotation with its marks, in order."""
    if not compiled("[\"'“‘]").search(text):
        return []
    masked = filled(text, segments(text), lambda code: "\n" if code.startswith(("```", "~~~")) else "x")
    found = []
    for family, marks in quotation_marks(masked).items():
        single = family in "'‘"
        i = 0
        while i < len(marks):
            partner = closing_of(masked, marks, i, single) if marks[i].opens else None
            if partner is None:
                i += 1
            else:
                found.append((marks[i].at, marks[partner].at + 1))
                i = partner + 1
    return sorted(found)


def closing_of(masked: str, marks: list[Mark], opening: int, single: bool) -> int | None:
    """The mark that closes: the first sure one before another opening; else the first doubtful (single: the last)."""
    doubtful = None
    start = marks[opening].at + 1
    for j in range(opening + 1, len(marks)):
        if not marks[j].closes:
            break
        inside = masked[start : marks[j].at]
        if len(inside) > R.QUOTE_MAX or compiled(r"\n[ \t\r]*\n").search(inside):
            break
        if single and len(inside.strip()) < 2:
            continue
        if marks[j].sure:
            return j
        if single or doubtful is None:
            doubtful = j
    return doubtful


# ---- Blocks, sentences, words ----


def is_block(line: str) -> bool:
    return not line[:1].isalpha() and compiled(R.BLOCK_START).match(line) is not None


def unwrapped(text: str) -> str:
    """Each block on one line: a line goes on with the one above unless that is blank or it opens a block itself."""
    out: list[str] = []
    for line in (raw.strip() for raw in text.split("\n")):
        if line and out and out[-1] and not is_block(line):
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n".join(out)


#: The marks at the start of a line, and those inside one with what a text needs to have for each.
LINE_MARKS, INLINE_MARKS = R.MARKDOWN[:4], tuple(zip(R.MARKDOWN[4:], (("](",), ("*", "_"), ("|",)), strict=True))

#: Without one of these a text that starts with a letter is plain.
ANY_MARK = ("\n", "*", "_", "|", "](", "://", "www.")


def unmarked(text: str) -> str:
    """Marks at the start of lines gone. Only runs of lines that start with no letter can hold one, with the line that follows."""
    lines = text.split("\n")
    if all(line[:1].isalpha() for line in lines if line) and "\n\n\n" not in text:
        return text
    out: list[str] = []
    run: list[str] = []
    marked = False

    def close() -> None:
        piece = "\n".join(run)
        for pattern, new in LINE_MARKS if marked else ():
            piece = compiled(pattern).sub(new, piece)
        out.append(piece)
        run.clear()

    for line in lines:
        run.append(line)
        if line[:1].isalpha():
            close()
            marked = False
        else:
            marked = marked or bool(line) or run[-2:] == ["", ""]
    if run:
        close()
    return "\n".join(out)


def plain(text: str) -> str:
    """Blocks on one line each, URLs as one word, Markdown gone."""
    if text[:1].isalpha() and not any(mark in text for mark in ANY_MARK):
        return text.strip()
    return plain_line(text) if len(text) <= HELD_LENGTH else bare(text)


def bare(text: str) -> str:
    text = unwrapped(text)
    if "://" in text or "www." in text:
        text = compiled(R.URL).sub("LINK", text)
    text = unmarked(text)
    for (pattern, new), needed in INLINE_MARKS:
        if any(mark in text for mark in needed):
            text = compiled(pattern).sub(new, text)
    return text


plain_line = functools.lru_cache(HELD_LINES)(bare)


def guarded(text: str) -> str:
    """Stops of abbreviations as a mark of the same length that ends no sentence."""
    return compiled(R.ABBREVIATION).sub(lambda m: m[0].replace(".", GUARD), text)


ABBREVIATED = tuple(a.casefold() for a in R.ABBREVIATIONS.split())
#: The last two letters of each, in any case.
TAILS = frozenset(x + y for a in ABBREVIATED for x in (a[-2], a[-2].upper()) for y in (a[-1], a[-1].upper()))
ABBREVIATED_END = re.compile("(?:^|[^a-z])(?:" + "|".join(map(re.escape, ABBREVIATED)) + ")$")


def abbreviated(text: str) -> bool:
    """May the text end in an abbreviation?"""
    tail = text[-2:]
    return (tail in TAILS or not tail.isascii()) and ABBREVIATED_END.search(folded(text[-8:])) is not None


def sentence_pieces(text: str) -> list[tuple[int, int]]:
    """What lies between sentence ends; the closing marks and blanks after a stop belong to neither side."""
    at, found = 0, []
    for m in plainly(R.SENTENCE_END).finditer(text):
        stop = m.start()
        if abbreviated(text[max(0, stop - 8) : stop]):
            break
        found.append((at, stop + 1))
        at = m.end()
    else:
        return [*found, (at, len(text))]
    at, found = 0, []
    for m in plainly(R.SENTENCE_END).finditer(guarded(text)):
        found.append((at, m.end(1)))
        at = m.end()
    return [*found, (at, len(text))]


LETTER = re.compile("[A-Za-z]")


def has_word(text: str) -> bool:
    return LETTER.search(text) is not None


def words(text: str) -> list[str]:
    return plainly(R.WORD).findall(text)


#: Bytes as letters, marks that a word may go on with, and blanks; and the same with small letters and apostrophes kept.
SHAPES = bytes(97 if chr(b).isalpha() and b < 128 else 45 if chr(b) in "'-" else 32 for b in range(256))
LOWERED = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if chr(b) in "'-" else 32 for b in range(256))

LOWERED_LINES = LOWERED[:10] + b"\n" + LOWERED[11:]


def tokens(text: str, table: bytes = LOWERED) -> list[bytes]:
    """Runs of letters, apostrophes (all straight) and hyphens: a word each from its first letter on, none without one."""
    return (text if text.isascii() else text.replace("’", "'")).encode("utf-8", "surrogatepass").translate(table).split()


def lines_of_tokens(lines: list[str]) -> list[list[bytes]]:
    """tokens() of each line, none of which holds a newline."""
    text = "\n".join(lines)
    data = (text if text.isascii() else text.replace("’", "'")).encode("utf-8", "surrogatepass").translate(LOWERED_LINES)
    return [line.split() for line in data.split(b"\n")] if lines else []


def count_words(text: str) -> int:
    found = tokens(text, SHAPES)
    return len(found) - sum(not t.strip(b"-") for t in found) if "-" in text or "'" in text or "’" in text else len(found)


def pieces_of(line: str) -> tuple[str, ...]:
    parts = plainly(R.SENTENCE_END).split(line)  # a stretch, its stop, the next stretch ...
    if any(map(abbreviated, parts[:-1:2])):
        pieces = [line[a:b].strip() for a, b in sentence_pieces(line)]
    else:
        pieces = [(p + stop).strip() for p, stop in zip(parts[::2], [*parts[1::2], ""], strict=True)]
    return tuple([p for p in pieces if LETTER.search(p)])


line_sentences = functools.lru_cache(HELD_LINES)(pieces_of)


def sentences(text: str) -> list[str]:
    """Of a text without code: no sentence crosses a block."""
    return [s for line in map(str.strip, plain(text).split("\n")) if line for s in (line_sentences if len(line) <= HELD_LENGTH else pieces_of)(line)]


@functools.lru_cache(HELD)
def measured_words(text: str) -> int:
    """The words of a document as its metrics count them."""
    return count_words("\n".join(sentences(strip_code(text))))


def paragraphs(text: str) -> list[str]:
    """Of a text without code: runs of prose lines; a list item, heading or table row stands alone."""
    found = (plain(line).strip() for line in unwrapped(text).split("\n"))
    return [p for p in found if has_word(p)]


def units(masked: str) -> list[tuple[int, int, bool]]:
    """(start, end, opens as a block) of each block of a masked text, trimmed."""
    found: list[tuple[int, int, bool]] = []
    at, open_ = 0, False
    for line in masked.split("\n"):
        stripped = line.strip()
        start = at + len(line) - len(line.lstrip())
        end = at + len(line.rstrip())
        at += len(line) + 1
        if not stripped:
            open_ = False
        elif open_ and not is_block(stripped):
            found[-1] = (found[-1][0], end, found[-1][2])
        else:
            found.append((start, end, is_block(stripped)))
            open_ = True
    return found


def sentence_ranges(segmented: str, start: int, end: int) -> list[tuple[int, int]]:
    """Trimmed ranges of the sentences in one block."""
    block, found = segmented[start:end], []
    for a, b in sentence_pieces(block):
        piece = block[a:b]
        if has_word(piece):
            found.append((start + a + len(piece) - len(piece.lstrip()), start + a + len(piece.rstrip())))
    return found


def blank_emphasis(masked: str) -> str:
    return masked.replace("*", " ").replace("_", " ")


VOWELS = re.compile("[aeiouy]{1,2}")
SILENT = re.compile(r"(?:[^laeiouy]es|[^laeiouy]e|ed)\Z")


def beats(word: str) -> int:
    letters = word.lower()
    if not (letters.isascii() and letters.isalpha()):
        letters = "".join(c for c in letters if "a" <= c <= "z")
    if len(letters) <= 3:
        return min(1, len(letters))
    if letters[-1] in "eds":
        letters = SILENT.sub("", letters)
    return max(1, len(VOWELS.findall(letters.removeprefix("y"))))


def syllables(word: str) -> int:
    return BEATS[word]


BEATS = Kept(beats)


def round1(x: float) -> float:
    """To one place, of the binary value, ties to even."""
    return float(f"{x:.1f}")


# ---- Positions ----


@dataclass
class Positions:
    """Lines, columns and offsets, in code points or UTF-16 units. Lines and columns count from 1."""

    text: str
    utf16: bool = False
    starts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.starts = [0, *(m.end() for m in compiled("\n").finditer(self.text))]
        self.wide = [m.start() for m in compiled("[\U00010000-\U0010ffff]").finditer(self.text)] if self.utf16 else []

    def at(self, offset: int) -> tuple[int, int, int]:
        line = bisect.bisect_right(self.starts, offset)
        start = self.starts[line - 1]
        wide = bisect.bisect_left(self.wide, offset)
        return line, offset - start + 1 + wide - bisect.bisect_left(self.wide, start), offset + wide

    def span(self, start: int, end: int) -> dict:
        line, col, low = self.at(start)
        end_line, end_col, high = self.at(end)
        return {"line": line, "col": col, "end_line": end_line, "end_col": end_col, "from": low, "to": high}


def measured_units(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, end, words) of each sentence and of each paragraph, words as the metrics count them."""
    masked = mask_code(text)
    segmented, blocks = blank_emphasis(masked), units(masked)
    size = lambda a, b: count_words(plain(masked[a:b]))
    long_ones = [(a, b, n) for a, b, _ in blocks if (n := size(a, b))]
    return [(a, b, size(a, b)) for x, y, _ in blocks for a, b in sentence_ranges(segmented, x, y)], long_ones


def spans(text: str, utf16: bool = False) -> dict[str, list[dict]]:
    positions = Positions(text, utf16)
    return {kind: [{"words": n} | positions.span(a, b) for a, b, n in found] for kind, found in zip(("sentences", "paragraphs"), measured_units(text), strict=True)}


def long_sentence_at(text: str, at: int) -> dict | None:
    """The last sentence begun by an offset (in UTF-16 units), if it is too long."""
    begun = [s for s in spans(text, True)["sentences"] if s["from"] <= at]
    return begun[-1] if begun and begun[-1]["words"] > R.LONG_SENTENCE else None


def same_openings(text: str) -> list[tuple[int, int]]:
    """From first to last of each run of sentences of one prose paragraph that open with the same word, articles aside."""
    masked = mask_code(text)
    segmented, found = blank_emphasis(masked), []
    for a, b, block in units(masked):
        if block or segmented.count(".", a, b) + segmented.count("!", a, b) + segmented.count("?", a, b) < R.SAME_OPENING_RUN - 1:
            continue
        ranges = sentence_ranges(segmented, a, b)
        if len(ranges) < R.SAME_OPENING_RUN:
            continue
        first = [plainly(R.WORD).search(segmented, s, e)[0].lower() for s, e in ranges]
        breaks = [0, *(i for i, (x, y) in enumerate(pairwise(first), 1) if x != y or y in ("the", "a", "an")), len(first)]
        found += [(ranges[i][0], ranges[j - 1][1]) for i, j in pairwise(breaks) if j - i >= R.SAME_OPENING_RUN]
    return found
