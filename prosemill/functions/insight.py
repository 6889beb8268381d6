"""The structure of a filed insight: template, significance, no code references, no figures of a customer."""

from __future__ import annotations

from prosemill.functions import rules as R
from prosemill.functions.prose import compiled

ABSENT = "missing template section(s): {}"
GRADES = "found {} significance value(s); keep exactly one of Low / Medium / High / Critical on its own line"
MORE = " (+{} more)"
DISCLOSED = '{}: "{}" — describe it qualitatively instead ("a large estate"); the number is the customer\'s to disclose'


def check(text: str) -> list[tuple[str, str]]:
    """(check, detail) of every failure; none for an insight that passes."""
    failures, low = [], text.lower()
    if absent := [s for s in R.SECTIONS if s.lower() not in low]:
        failures.append(("sections", ABSENT.format(", ".join(absent))))
    if (n := len(compiled(R.SIGNIFICANCE).findall(text))) != 1:
        failures.append(("significance", GRADES.format(n)))
    for pattern, what in R.CODE_REFERENCES:
        if found := sorted({m[0] for m in compiled(pattern).finditer(text)}):
            more = MORE.format(len(found) - 3) if len(found) > 3 else ""
            failures.append(("no_internal_refs", f"{what}: {', '.join(found[:3])}{more}"))
    seen = set()
    for pattern, what in R.CUSTOMER_FIGURES:
        for m in compiled(pattern).finditer(text):
            figure = " ".join(m[0].split())
            around = text[max(0, m.start() - R.LIMIT_WINDOW) : m.end() + R.LIMIT_WINDOW]
            if figure.lower() not in seen and not compiled(R.LIMIT_WORDS).search(around):
                seen.add(figure.lower())
                failures.append(("no_customer_metrics", DISCLOSED.format(what, figure)))
    return failures
