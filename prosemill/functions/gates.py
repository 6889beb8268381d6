"""A rewrite against its source: length, connectives, lists, facts, and the verdict."""

from __future__ import annotations

from dataclasses import dataclass, field

from prosemill.functions import explaining, facts, findings, measuring
from prosemill.functions import rules as R
from prosemill.functions.prose import measured_words, round1


def cut_pct(before: int, after: int) -> float:
    return round1(100.0 * (before - after) / before) if before else 0.0


@dataclass
class Length:
    before: int
    after: int
    explaining_before: int = 0
    explaining_after: int = 0

    @property
    def scored(self) -> bool:
        return self.before >= R.MIN_WORDS_TO_SCORE

    @property
    def padding(self) -> tuple[int, int]:
        return max(0, self.before - self.explaining_before), max(0, self.after - self.explaining_after)

    @property
    def padding_ok(self) -> bool:
        before, after = self.padding
        return cut_pct(before, after) >= R.COMPRESSION_TARGET if before else not after

    @property
    def limit(self) -> int:
        return int(self.explaining_before * R.EXPLANATION_GROWTH)

    @property
    def explanation_ok(self) -> bool:
        return self.explaining_after <= self.limit

    @property
    def ok(self) -> bool:
        return not self.scored or (self.padding_ok and self.explanation_ok)

    @property
    def label(self) -> str:
        if self.ok:
            return "PASS"
        return "LONG" if self.after > self.before or not self.explanation_ok else "SHORT"


@dataclass
class Kept:
    joints_source: int
    joints_required: int
    joints_after: int
    lost: list[tuple[str, list[str]]]
    unkept_before: int
    unkept_after: list[str]

    @property
    def gated(self) -> bool:
        return self.joints_source >= R.MIN_JOINTS_TO_GATE

    @property
    def joints_ok(self) -> bool:
        return not self.gated or self.joints_after >= self.joints_required

    @property
    def lists_ok(self) -> bool:
        return not self.lost and len(self.unkept_after) <= self.unkept_before


@dataclass
class Outcome:
    """What a simplifying pass over a document gives, with gates if there is a source."""

    rewrite: findings.Rewrite
    metrics: measuring.Metrics
    length: Length | None = None
    kept: Kept | None = None
    source_lists: int = 0
    facts: tuple[int, list[facts.Fact]] | None = None
    promised: list[str] = field(default_factory=list)

    def over(self, budget=R.BUDGET) -> list[str]:
        found = self.metrics.over_budget(budget)
        found += ["length"] if self.length and not self.length.ok else []
        found += ["joints"] if self.kept and not self.kept.joints_ok else []
        return found + (["lists"] if self.kept and not self.kept.lists_ok else [])


def lengths_of(source: str, rewrite: str) -> Length:
    return Length(measured_words(source), measured_words(rewrite), *explaining.explaining_words(source, rewrite))


def kept_of(source: str, rewrite: str) -> Kept:
    required, after = explaining.owed_joints(source, rewrite)
    return Kept(
        len(explaining.joints_of_all(source)), required, after, explaining.lost_parts(source, rewrite),
        sum(not p.unpacked for p in explaining.promises(source)), [p.text for p in explaining.unkept(source, rewrite)],
    )


def judge(text: str, source: str | None = None) -> Outcome:
    """Simplifies the text, measures what comes out, and holds it against the source."""
    rewrite = findings.simplify(text)
    promised = [p.text for p in explaining.promises(rewrite.text) if not p.unpacked]
    if source is None:
        return Outcome(rewrite, measuring.measure(rewrite.text), promised=promised)
    return Outcome(
        rewrite, measuring.measure(rewrite.text, source), lengths_of(source, rewrite.text), kept_of(source, rewrite.text),
        sum(p.unpacked for p in explaining.promises(source)), facts.dropped(source, rewrite.text), promised,
    )
