"""A subset of grammar checking in British English: articles, doubled words, "their is", and American spellings."""

from __future__ import annotations

import functools

from prosemill.functions import findings
from prosemill.functions import prose as P
from prosemill.functions import rules as R
from prosemill.functions.findings import Hit
from prosemill.functions.prose import compiled

#: British stems in -our, -re, -ogue, and verbs that double their l: what the endings that are not Oxford ones apply to.
OUR = "arbour ardour armour behaviour candour clamour clangour colour demeanour dolour enamour endeavour favour fervour flavour glamour harbour honour humour labour neighbour odour parlour rancour rigour rumour saviour savour splendour succour tumour valour vapour vigour misbehaviour dishonour discolour watercolour"
RE = "calibre centre fibre goitre litre lustre meagre mitre sabre sceptre sombre spectre theatre epicentre millilitre kilolitre"
OGUE = "analogue catalogue dialogue epilogue monologue prologue travelogue demagogue synagogue pedagogue"
DOUBLED = "cancel channel counsel dial duel enamel equal fuel fulfil funnel grovel initial jewel label level libel marshal marvel model panel parcel pedal pencil quarrel refuel reveal rival shovel shrivel signal snivel spiral swivel total travel trowel tunnel unravel"
#: Words in -ize or -yze that British English spells so too.
KEPT = frozenset("capsize capsizes capsized capsizing downsize downsizes downsized downsizing outsize outsized oversize oversized resize resizes resized resizing undersize undersized".split())
#: Vowel letters that sound as consonants, and the other way round.
CONSONANT_SOUND = r"(?i)(?:eu|ewe|one\b|once\b|ouija|u(?:[bcfgknprst](?:[aeiou]|rin|iqu)|ni(?!n|m[^a])|sab|ter))"
VOWEL_SOUND = r"(?i)(?:heir|hono(?:u)?r|honest|hour)|[FHLMNRSX](?=[A-Z0-9]*\b)(?-i:[A-Z0-9]+)\b"


@functools.cache
def british_words() -> frozenset[str]:
    """The British words that the rows of endings lead to, from their stems."""
    found = {stem + tail for stem in OUR.split() for tail in ("", "s", "ed", "ing", "ful", "ite", "ites")}
    found |= {w for stem in RE.split() for w in (stem, stem + "s", stem[:-1] + "ed", stem[:-1] + "ing", stem + "d")}
    found |= {w for stem in OGUE.split() for w in (stem, stem + "s")}
    return frozenset(found | {stem + "l" * (not stem.endswith("ll")) + tail for stem in DOUBLED.split() for tail in ("ed", "ing", "er", "ers")})


def british(word: str) -> str | None:
    """The British spelling of an American word, in the word's case."""
    low = word.lower()
    for table, oxford in ((R.OXFORD_ENDINGS, True), (R.OTHER_ENDINGS, False)):
        for ending, wanted in table:
            if low.endswith(ending):
                stem = low.removesuffix(ending)
                new = stem + wanted
                if (oxford and len(stem) >= R.OXFORD_MIN_STEM and low not in KEPT) or (not oxford and new in british_words()):
                    return new.upper() if len(word) > 1 and word.isupper() else new.capitalize() if word[0].isupper() else new
    return None


def grammar(text: str) -> list[Hit]:
    """Findings in document order, none in code and none on exactly the range of another rule's."""
    masked, hits = P.mask_code(text), []

    def add(rule: str, start: int, end: int, fix: str | None, hint: str) -> None:
        hits.append(Hit(f"grammar:{rule}", "tell", start, end, fix, hint))

    for m in compiled(r"[^\W\d_]+").finditer(masked):
        if m[0].isascii() and (new := british(m[0])):
            add("BritishSpelling", *m.span(), new, f"British spelling: `{new}`")
    for m in compiled(r"\b(a|an|A|An)\s+(?=\w)").finditer(masked):
        vowel = bool(compiled("[aeiouAEIOU]").match(masked, m.end()) and not compiled(CONSONANT_SOUND).match(masked, m.end())) or bool(compiled(VOWEL_SOUND).match(masked, m.end()))
        if masked[m.end()].isalpha() and vowel != (len(m[1]) == 2):
            add("AnA", *m.span(1), m[1][0] + "n" * vowel, f'"{m[1][0].lower() + "n" * vowel}" before this sound')
    for m in compiled(r"(?i)\b([^\W\d_]+)\s+\1\b").finditer(masked):
        if m[1].lower() not in ("had", "that"):
            add("RepeatedWords", *m.span(), m[1], "a word stands here twice")
    for m in compiled(r"\b([Tt]heir)\s+(?:is|are|was|were)\b").finditer(masked):
        add("TheirToThere", *m.span(1), None, 'did you mean "there"?')
    own = {(h.start, h.end) for h in findings.tells(text) + findings.simplifications(text)}
    return sorted((h for h in hits if (h.start, h.end) not in own), key=lambda h: (h.start, h.end))


def flags(text: str, hits: list[Hit]) -> list[findings.Flag]:
    """By rule, most frequent first; a sample shows the one suggestion if there is one."""
    found: dict[str, findings.Flag] = {}
    for h in hits:
        flag = found.setdefault(h.rule, findings.Flag(h.rule, 0, None, []))
        flag.count += 1
        if len(flag.samples) < R.SAMPLES:
            quoted = f'  → "{h.fix}"' if h.fix is not None else ""
            flag.samples.append(findings.sample(text, h.start, h.end, R.TELL_PAD, "…") + quoted)
    return sorted(found.values(), key=lambda f: -f.count)
