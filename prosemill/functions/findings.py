"""What the rules find in a document, and the two rewrites: typography and clutter."""

from __future__ import annotations

import bisect
import functools
from dataclasses import dataclass, field

from prosemill.functions import prose as P
from prosemill.functions import rules as R
from prosemill.functions.prose import compiled
from prosemill.functions.rules import Rule


@dataclass
class Hit:
    rule: str
    kind: str
    start: int
    end: int
    fix: str | None = None
    hint: str | None = None


SMALL = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


@functools.lru_cache(P.HELD)
def vocabulary(text: str) -> set[str]:
    """The letter runs of a text, case folded, and "#" if it has one: what triggers are looked up in."""
    found = set((text.lower() if text.isascii() else text.casefold()).encode("utf-8", "surrogatepass").translate(SMALL).decode().split())
    return found | {"#"} if "#" in text else found


class Table:
    """Rules by their triggers."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.places: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            for word in rule.triggers:
                self.places.setdefault(word, []).append(i)

    def wanted(self, present: set[str]) -> list[Rule]:
        """Those of which a trigger is there, in the order of the table."""
        return [self.rules[i] for i in sorted({i for word in self.places.keys() & present for i in self.places[word]})]


TELLS, CLUTTER, COMPLEXITY = Table(R.TELLS), Table(R.CLUTTER), Table(R.COMPLEXITY)
HEDGES = Table(tuple(r for r in R.COMPLEXITY if r.name.startswith("hedge")))
#: The triggers of what only fills.
FILLING = frozenset(word for table in (TELLS, CLUTTER, HEDGES) for word in table.places)


def tell_copy(span: str) -> tuple[str, list[tuple[int, int]]]:
    """The span with hard wraps closed up, and for each stretch of it where it starts in the copy and in the span."""
    stretches: list[str] = []
    starts: list[tuple[int, int]] = []
    if "\n" not in span:
        return span, [(0, 0)]
    if any(c in span for c in "\x1c\x1d\x1e\x1f"):  # blank for strip, but not for the rules
        pieces, at = [], 0
        for m in compiled(r"\s*\n\s*").finditer(span):
            pieces.append((at, span[at : m.start()]))
            at = m.end()
        pieces.append((at, span[at:]))
    else:
        pieces, at, lines = [], 0, span.split("\n")
        for i, line in enumerate(lines):
            kept = line if not i else line.lstrip()
            begin = at + len(line) - len(kept)
            kept = kept.rstrip() if i < len(lines) - 1 else kept
            if kept or i in (0, len(lines) - 1):
                pieces.append((begin, kept))
            at += len(line) + 1
    length = 0
    for begin, kept in pieces:
        starts.append((length, begin))
        stretches.append(kept)
        length += len(kept) + 1
    return " ".join(stretches), starts


def place(starts: list[tuple[int, int]], at: int) -> int:
    """Where a character of the copy stood."""
    low, begin = starts[bisect.bisect_right(starts, at, key=lambda s: s[0]) - 1]
    return begin + at - low


def prose_spans(text: str) -> list[tuple[int, str]]:
    return [(a, text[a:b]) for a, b, code in P.segments(text) if not code]


def tells(text: str) -> list[Hit]:
    """Every tell, in document order, ties in the order of the table."""
    wanted, found = TELLS.wanted(vocabulary(text)), []
    for base, span in prose_spans(text) if wanted else ():
        closed, starts = tell_copy(span)
        for rule in wanted:
            for m in compiled(rule.pattern).finditer(span if rule.anchored else closed):
                a, b = m.span() if rule.anchored else (place(starts, m.start()), place(starts, m.end() - 1) + 1)
                found.append(Hit(rule.name, rule.kind, base + a, base + b))
    return sorted(found, key=lambda h: h.start)


def cased(word: str, like: str) -> str:
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def replacement(rule: Rule, m) -> str:
    what, value = rule.action
    if what == "word":
        return cased(value, m[0])
    if what == "keep":
        return m.expand(value)
    lead, letter = m[1], m[2]
    return lead + (letter.upper() if m[0][:1].isupper() and not lead else letter)


def allowed(owners: str, start: int, end: int, text: str, new: str) -> bool:
    """May text[start:end] become new? Not if that changes a quotation; owners has a mark for each quoted character."""
    quoted = next((i for i in range(start, end) if owners[i] != " "), None)
    return quoted is None or (quoted > start and new.endswith(text[quoted:end]))


def owners_of(text: str) -> str:
    """A character for each of the text's: blank outside quotations, one of two signs inside (neighbours differ)."""
    quotations = P.quotations(text)
    if not quotations:
        return " " * len(text)
    marks = [" "] * len(text)
    for i, (a, b) in enumerate(quotations):
        marks[a:b] = "qr"[i % 2] * (b - a)
    return "".join(marks)


def worded(text: str, clutter: list[Rule], hard: list[Rule]) -> list[Hit]:
    """What these rules find, by stretch of prose and rule."""
    found: list[Hit] = []
    owners = owners_of(text) if clutter else ""
    for base, span in prose_spans(text) if clutter or hard else ():
        for rule in clutter:
            for m in compiled(rule.pattern).finditer(span):
                fix = replacement(rule, m)
                if allowed(owners, base + m.start(), base + m.end(), text, fix):
                    found.append(Hit(rule.name, rule.kind, base + m.start(), base + m.end(), fix))
        for rule in hard:
            found += [Hit(rule.name, rule.kind, base + m.start(), base + m.end(), hint=rule.hint) for m in compiled(rule.pattern).finditer(span)]
    return found


def simplifications(text: str) -> list[Hit]:
    """Clutter, with its fix, and complexity, with its hint, in document order."""
    present = vocabulary(text)
    found = worded(text, CLUTTER.wanted(present), COMPLEXITY.wanted(present))
    found += [Hit(R.SAME_OPENING, "complexity", a, b, hint=R.SAME_OPENING_HINT) for a, b in P.same_openings(text)]
    return sorted(found, key=lambda h: h.start)


def padding(text: str) -> int:
    """How many words and phrases only fill: tells, clutter and hedges."""
    present = vocabulary(text) & FILLING
    return len(worded(text, CLUTTER.wanted(present), HEDGES.wanted(present))) + len(tells(text)) if present else 0


def lengths(text: str, budget=R.BUDGET) -> list[Hit]:
    """Sentences and paragraphs that are too long, as far as the budget has their measures."""
    limits = {name: limit for name, direction, limit in budget if direction == "max"}
    sentences, paragraphs = P.measured_units(text)
    found = []
    if any(name == "pct_long_sentences" for name, _, _ in budget):
        found += [Hit("long-sentence", "length", a, b, hint=f"{n} words: split it, or cut to the point") for a, b, n in sentences if n > R.LONG_SENTENCE]
    if "max_paragraph_words" in limits:
        found += [Hit("long-paragraph", "length", a, b, hint=f"{n} words: break it up") for a, b, n in paragraphs if n > limits["max_paragraph_words"]]
    return found


def review(text: str, budget=R.BUDGET) -> list[Hit]:
    """All of them, by start and end."""
    return sorted(simplifications(text) + tells(text) + lengths(text, budget), key=lambda h: (h.start, h.end))


def placed(text: str, hits: list[Hit], utf16: bool = False) -> list[dict]:
    positions = P.Positions(text, utf16)
    return [{"rule": h.rule, "kind": h.kind, "text": text[h.start : h.end], **positions.span(h.start, h.end), "fix": h.fix, "hint": h.hint} for h in hits]


# ---- Rewrites ----


@dataclass
class Flag:
    rule: str
    count: int
    hint: str | None
    samples: list[str]


@dataclass
class Rewrite:
    text: str
    fixes: dict[str, int] = field(default_factory=dict)
    flags: list[Flag] = field(default_factory=list)


class Span:
    """A stretch of prose under edit, with the owner of each character kept in step with the text."""

    def __init__(self, text: str, owners: str):
        self.text, self.owners = text, owners

    def edit(self, pattern: str, new, respect_quotes: bool) -> int:
        """Replaces every match by new(match), but for those that would change a quotation. Returns how many."""
        texts, owners, at, done = [], [], 0, 0
        for m in compiled(pattern).finditer(self.text):
            a, b = m.span()
            fresh = new(m)
            quoted = next((i for i in range(a, b) if self.owners[i] != " "), None)
            if respect_quotes and not allowed(self.owners, a, b, self.text, fresh):
                continue
            texts += [self.text[at:a], fresh]
            if quoted is not None and respect_quotes:  # the quoted end stays as it is
                owners += [self.owners[at:a], " " * (len(fresh) - (b - quoted)), self.owners[quoted:b]]
            else:
                inside = self.owners[a:b] and self.owners[a] == self.owners[b - 1] and self.owners[a]
                owners += [self.owners[at:a], (inside or " ") * len(fresh)]
            at, done = b, done + 1
        if done:
            self.text, self.owners = "".join([*texts, self.text[at:]]), "".join([*owners, self.owners[at:]])
        return done


#: What a stretch of prose has to hold for a pass to change it; a pass that is not here is always tried.
NEEDED: dict[str, tuple[str, ...]] = {
    "crlf": ("\r",), "zero_width": tuple("\u200b\u200c\u200d\ufeff"), "nbsp": tuple("\u00a0\u202f\u2007"), "curly_double": tuple("“”„‟"), "curly_single": tuple("‘’‚‛"),
    "ellipsis": ("…",), "endash_range": ("–",), "endash_clause": ("–",), "em_dash": ("—",), "double_hyphen": ("--",), "space_comma": (" ,", "\t,"),
    "double_comma": (",,", ", ", ",\t"), "run_spaces": ("  ", "\t"), "trailing_ws": (" \n", "\t\n"),
}


def rewritten(text: str, passes) -> tuple[str, dict[str, int]]:
    """Runs passes over each prose span; code goes through. Fixes are counted in the order they first fire."""
    owners, out, fixes = owners_of(text), [], {}
    for a, b, code in P.segments(text):
        if code:
            out.append(text[a:b])
            continue
        span = Span(text[a:b], owners[a:b])
        for name, pattern, new, words in passes:
            if name in NEEDED and not any(c in span.text for c in NEEDED[name]):
                continue
            if n := span.edit(pattern, new, words):
                fixes[name] = fixes.get(name, 0) + n
        out.append(span.text)
    return "".join(out), fixes


def typography_passes():
    for name, pattern, new in R.TYPOGRAPHY:
        if name == "in_order_to":
            yield name, pattern, lambda m, new=new: cased(new, m[0]), True
        else:
            yield name, pattern, lambda m, new=new: m.expand(new) if "\\" in new else new, False


def flagged(found: list[tuple[Rule | str, str | None, str, list[tuple[int, int]]]], pad: int, dots: str) -> list[Flag]:
    """Flags by rule from (rule, hint, subject, ranges), most frequent first, ties as they first came."""
    flags: dict[str, Flag] = {}
    for name, hint, subject, ranges in found:
        if ranges:
            flag = flags.setdefault(name, Flag(name, 0, hint, []))
            flag.count += len(ranges)
            flag.samples = (flag.samples + [sample(subject, a, b, pad, dots) for a, b in ranges[: R.SAMPLES]])[: R.SAMPLES]
    return sorted(flags.values(), key=lambda f: -f.count)


def sample(text: str, start: int, end: int, pad: int, dots: str) -> str:
    a, b = max(0, start - pad), min(len(text), end + pad)
    return (dots if a else "") + text[a:b].replace("\n", " ").strip() + (dots if b < len(text) else "")


def typography(text: str) -> Rewrite:
    """The typographic fixes in order, then what tells are left."""
    new, fixes = rewritten(text, list(typography_passes()))
    new = new.rstrip(" \t")
    wanted = TELLS.wanted(vocabulary(new))
    found = []
    for _, span in prose_spans(new) if wanted else ():
        closed = tell_copy(span)[0]
        for rule in wanted:
            subject = span if rule.anchored else closed
            found.append((rule.name, None, subject, [m.span() for m in compiled(rule.pattern).finditer(subject)]))
    return Rewrite(new, fixes, flagged(found, R.TELL_PAD, "…"))


def simplify(text: str) -> Rewrite:
    """The clutter fixes in order and the closing of blank runs, then what complexity is left."""
    passes = [(r.name, r.pattern, lambda m, r=r: replacement(r, m), True) for r in CLUTTER.wanted(vocabulary(text))]
    runs = next((n, p) for n, p, _ in R.TYPOGRAPHY if n == "run_spaces")
    new, fixes = rewritten(text, [*passes, (*runs, lambda m: " ", False)])
    wanted, found = COMPLEXITY.wanted(vocabulary(new)), []
    for _, span in prose_spans(new):
        for rule in wanted:
            found.append((rule.name, rule.hint, span, [m.span() for m in compiled(rule.pattern).finditer(span)]))
    found.append((R.SAME_OPENING, R.SAME_OPENING_HINT, new, P.same_openings(new)))
    return Rewrite(new, fixes, flagged(found, R.SIMPLIFY_PAD, "..."))
