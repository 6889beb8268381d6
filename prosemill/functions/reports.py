"""Reports for people, as text, and for programs, as JSON. Their words and columns are fixed values."""

from __future__ import annotations

import json

from prosemill.functions import rules as R
from prosemill.functions.findings import Flag, Rewrite
from prosemill.functions.gates import Outcome, cut_pct

RULE, END = "─", "=" * 45


def number(name: str, value: float) -> str:
    return str(int(value)) if name in R.COUNTS and value == int(value) else str(float(value))


def shortened(text: str, size: int = 72) -> str:
    return text if len(text) <= size else text[: size - 3].rstrip() + "..."


def by_count(fixes: dict[str, int]) -> list[str]:
    return [f"  {n:>3}  {name}" for name, n in sorted(fixes.items(), key=lambda x: -x[1])]


def flag_lines(flags: list[Flag], why: str, dot: str, hints: bool = False) -> list[str]:
    if not flags:
        return ["FLAGGED: nothing"]
    lines = [f"FLAGGED ({why}, {sum(f.count for f in flags)}):"]
    for f in flags:
        lines.append(f"  {f.count:>3}  {f.rule}" + (f"  -> {f.hint or ''}" if hints else ""))
        lines += [f"         {dot} {s}" for s in f.samples]
    return lines


def typography_text(r: Rewrite) -> str:
    fixed = [f"FIXED (auto, {sum(r.fixes.values())}):", *by_count(r.fixes)] if r.fixes else ["FIXED: nothing (already clean typography)"]
    return "\n".join([f"{RULE * 2} detell report {RULE * 29}", *fixed, *flag_lines(r.flags, "needs a human/voice pass", "·"), RULE * 46])


def grammar_text(flags: list[Flag]) -> str:
    return "\n".join([f"{RULE * 2} grammar report {RULE * 28}", *flag_lines(flags, "British English, needs a human pass", "·"), RULE * 46])


def length_lines(o: Outcome) -> list[str]:
    c = o.length
    if not c:
        return []
    if not c.scored:
        return [f"LENGTH: {c.before} -> {c.after} words (source under {R.MIN_WORDS_TO_SCORE} words, no cut required)"]
    head = f"LENGTH  [{c.label}]  {c.before} -> {c.after} words, cut {cut_pct(c.before, c.after)}%"
    if not c.explaining_before:
        return [f"{head}   target >= {R.COMPRESSION_TARGET}%"]
    before, after = c.padding
    return [
        head, f"        padding {before} -> {after} words, cut {cut_pct(before, after)}%   target >= {R.COMPRESSION_TARGET}%",
        f"        explanation {c.explaining_before} -> {c.explaining_after} words, at most {c.limit} ({R.EXPLANATION_GROWTH}x)",
    ]


def explanation_lines(o: Outcome) -> list[str]:
    e = o.kept
    if not e:
        return ["PROMISED, NOT UNPACKED (name the parts where you promise them):", *(f'       "{p}"' for p in o.promised)] if o.promised else []
    lines = []
    if e.gated:
        lines.append(f"JOINTS  [{'PASS' if e.joints_ok else 'LOST'}]  {e.joints_required} owed (explanation, surviving sentences), {e.joints_after} in the rewrite (because/so/but/if...)")
    lines += [f'LISTS   [LOST]  "{name}" lost: {", ".join(items)}' for name, items in e.lost]
    if len(e.unkept_after) > e.unkept_before:
        lines.append("LISTS   [LOST]  promised, not unpacked: " + ", ".join(f'"{t}"' for t in e.unkept_after))
    if e.lists_ok and o.source_lists:
        lines.append(f"LISTS   [PASS]  {o.source_lists} unpacked list(s), every part kept")
    return lines


def fact_lines(o: Outcome) -> list[str]:
    total, missing = o.facts or (0, [])
    if not total:
        return []
    if not missing:
        return [f"FACTS   [KEPT]  {total} of {total} numbers, dates, quotes and code spans"]
    listed = ", ".join(f'"{f.text}" (line {f.line})' for f in missing)
    return [f"FACTS   [CHECK]  {total - len(missing)} of {total} kept; missing: {listed} (report only: restore it, or confirm the cut)"]


def insight_lines(failures: list[tuple[str, str]] | None) -> list[str]:
    if failures is None:
        return []
    if not failures:
        return ["INSIGHT STRUCTURE  [PASS]  sections present, no internal refs"]
    return [f"INSIGHT STRUCTURE  [FAIL] ({len(failures)}):", *(f"  [FAIL]  {check:<18} {detail}" for check, detail in failures)]


def score_lines(o: Outcome, budget) -> list[str]:
    values, lines = o.metrics.values, []
    for name, direction, limit in budget:
        if name in values:
            value, judged = values[name], o.metrics.judged.get(name, values[name])
            ok = judged <= limit if direction == "max" else judged >= limit
            excused = "" if judged == value else f"   ({number(name, judged)} without joined sentences)"
            lines.append(f"  [{'PASS' if ok else 'OVER'}]  {name:<22} {number(name, value):>7}   budget {'<=' if direction == 'max' else '>='} {number(name, limit)}{excused}")
    return lines


def simplify_text(o: Outcome, budget=R.BUDGET, failures: list[tuple[str, str]] | None = None) -> str:
    fixes, m = o.rewrite.fixes, o.metrics
    lines = ["== simplify report =========================="]
    lines += [f"CLUTTER CUT (auto, {sum(fixes.values())}):", *by_count(fixes)] if fixes else ["CLUTTER CUT: nothing (no stock wordy phrases)"]
    lines += flag_lines(o.rewrite.flags, "needs the rewrite pass", ".", hints=True)
    against = length_lines(o) + explanation_lines(o) + fact_lines(o)
    over = o.over(budget)
    if not m.scored:
        lines += [f"SCORECARD: skipped, only {int(m.values['words'])} words (need {R.MIN_WORDS_TO_SCORE}+ to score)", *against, *insight_lines(failures)]
        lines += [f"VERDICT: OVER BUDGET on {', '.join(over)}"] if over else []
        return "\n".join([*lines, END])
    counts = [int(m.values[k]) for k in ("words", "sentences", "paragraphs")]
    lines += ["SCORECARD  ({} words, {} sentences, {} paragraphs):".format(*counts), *score_lines(o, budget), *against]
    for title, found in ((f"LONGEST SENTENCES (over {R.LONG_SENTENCE} words, cut or split):", m.long_sentences), (f"JOINED SENTENCES (explanation, every clause within {R.LONG_SENTENCE} words: excused):", m.joined_sentences)):
        lines += [title, *(f"  {n:>3}w  {shortened(s)}" for n, s in found[:5])] if found else []
    lines += ["PASSIVE SENTENCES (name the actor):", *(f"       {shortened(s)}" for s in m.passive_sentences[:5])] if m.passive_sentences else []
    lines += insight_lines(failures)
    over += ["insight structure"] if failures else []
    return "\n".join([*lines, f"VERDICT: OVER BUDGET on {', '.join(over)}" if over else "VERDICT: within budget", END])


# ---- JSON ----


def flags_json(flags: list[Flag], hints: bool = False) -> list[dict]:
    return [{"rule": f.rule, "count": f.count} | ({"hint": f.hint} if hints else {}) | {"samples": f.samples} for f in flags]


def typography_json(r: Rewrite) -> str:
    return json.dumps({"fixes": r.fixes, "flags": flags_json(r.flags), "total_fixes": sum(r.fixes.values()), "total_flags": sum(f.count for f in r.flags)}, ensure_ascii=False, indent=2)


def grammar_json(flags: list[Flag]) -> str:
    return json.dumps({"flags": flags_json(flags), "total_flags": sum(f.count for f in flags)}, ensure_ascii=False, indent=2)


def simplify_json(o: Outcome, budget=R.BUDGET, failures: list[tuple[str, str]] | None = None) -> str:
    m, c, e = o.metrics, o.length, o.kept
    listed = lambda found: [{"words": n, "text": s} for n, s in found[:5]]
    held = {
        "fixes": o.rewrite.fixes, "flags": flags_json(o.rewrite.flags, True),
        "metrics": {k: int(v) if k in R.COUNTS else float(v) for k, v in sorted(m.values.items())}, "scored": m.scored, "over_budget": m.over_budget(budget),
        "long_sentences": listed(m.long_sentences), "joined_sentences": listed(m.joined_sentences),
        "total_fixes": sum(o.rewrite.fixes.values()), "total_flags": sum(f.count for f in o.rewrite.flags),
        "compression": None, "explanation": None, "facts": None, "promised_not_unpacked": o.promised,
        "insight": None if failures is None else [{"check": k, "detail": d} for k, d in failures],
    }
    if c:
        before, after = c.padding
        held["compression"] = {
            "before": c.before, "after": c.after, "cut_pct": cut_pct(c.before, c.after), "padding_before": before, "padding_after": after, "padding_cut_pct": cut_pct(before, after),
            "padding_target": R.COMPRESSION_TARGET, "explanation_before": c.explaining_before, "explanation_after": c.explaining_after, "explanation_limit": c.limit,
            "growth": R.EXPLANATION_GROWTH, "scored": c.scored, "ok": c.ok,
        }
    if e:
        held["explanation"] = {
            "joints": {"source": e.joints_source, "required": e.joints_required, "after": e.joints_after, "gated": e.gated, "ok": e.joints_ok},
            "lists": {"lost": [{"list": n, "missing": i} for n, i in e.lost], "promised_not_unpacked_before": e.unkept_before, "promised_not_unpacked_after": e.unkept_after, "ok": e.lists_ok},
        }
    if o.facts:
        total, missing = o.facts
        held["facts"] = {"source": total, "kept": total - len(missing), "missing": [{"kind": f.kind, "text": f.text, "line": f.line} for f in missing]}
    return json.dumps(held, ensure_ascii=False, indent=2)
