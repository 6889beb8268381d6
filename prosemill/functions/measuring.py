"""A document's metrics and its verdict. The native twin of the counts is functions.columns."""

from __future__ import annotations

import functools
from collections import Counter
from dataclasses import dataclass, field

from prosemill.functions import explaining
from prosemill.functions import prose as P
from prosemill.functions import rules as R
from prosemill.functions.prose import compiled, round1


@dataclass
class Metrics:
    values: dict[str, float]
    scored: bool
    long_sentences: list[tuple[int, str]] = field(default_factory=list)
    passive_sentences: list[str] = field(default_factory=list)
    joined_sentences: list[tuple[int, str]] = field(default_factory=list)
    judged: dict[str, float] = field(default_factory=dict)

    def over_budget(self, budget=R.BUDGET) -> list[str]:
        """The metrics that fail, in the budget's order. A metric that is not there fails nothing."""
        if not self.scored:
            return []
        values = self.values | self.judged
        return [n for n, direction, limit in budget if n in values and (values[n] > limit if direction == "max" else values[n] < limit)]


def share(n: int, of: int) -> float:
    return round1(100.0 * n / of)


def word_figures(token: bytes) -> int:
    """Of a run of letters, apostrophes and hyphens: its syllables by four, two if it is an adverb in -ly, one if a form of "be" may end it; -1 if it is no word."""
    word = token.decode().lstrip("'-")
    if not word:
        return NO_WORD
    return 4 * P.beats(word) + 2 * (len(word) > 4 and word.endswith("ly")) + (word in FORMS_OF_BE or not word.isalpha())


NO_WORD = -1
FORMS_OF_BE = frozenset(R.BE.split())
FIGURES = P.Kept(word_figures)
#: Letters that fold to those of a form of "be", but are no words here.
FOLDING = "\u017f\u0130"


def counted(text: str) -> tuple[dict[str, float], list[str], list[int], list[str]]:
    """The metrics, the sentences, the words of each, and the passive ones; but the counts of words and sentences no metrics under 30 words."""
    prose = P.strip_code(text)
    sentences = P.sentences(prose)
    sizes, passive, all_figures = [], [], []
    folding = any(c in prose for c in FOLDING)
    for s, own in zip(sentences, P.lines_of_tokens(sentences), strict=True):
        figures = list(map(FIGURES.__getitem__, own))
        if NO_WORD in figures:
            figures = [f for f in figures if f != NO_WORD]
        sizes.append(len(figures))
        all_figures += figures
        if (folding or any(f & 1 for f in set(figures))) and compiled(R.PASSIVE).search(s):
            passive.append(s)
    seen = Counter(all_figures)
    words = sum(sizes)
    if words < R.MIN_WORDS_TO_SCORE:
        return {"words": words, "sentences": len(sentences)}, sentences, sizes, passive
    blocks = [P.count_words(p) for p in P.paragraphs(prose)]
    beats = sum((f >> 2) * n for f, n in seen.items())
    long_ = sum(n > R.LONG_SENTENCE for n in sizes)
    per_sentence, per_word = words / len(sizes), beats / words
    values = {
        "words": words,
        "sentences": len(sizes),
        "paragraphs": len(blocks),
        "mean_sentence_words": round1(per_sentence),
        "max_sentence_words": max(sizes),
        "pct_long_sentences": share(long_, len(sizes)),
        "flesch_reading_ease": round1(206.835 - 1.015 * per_sentence - 84.6 * per_word),
        "flesch_kincaid_grade": round1(0.39 * per_sentence + 11.8 * per_word - 15.59),
        "pct_passive_sentences": share(len(passive), len(sizes)),
        "pct_long_words": share(sum(n for f, n in seen.items() if f >> 2 >= R.LONG_WORD_SYLLABLES), words),
        "max_paragraph_words": max(blocks, default=0),
        "pct_ly_adverbs": share(sum(n for f, n in seen.items() if f & 2), words),
    }
    return values, sentences, sizes, passive


@functools.lru_cache(P.HELD)
def measure(text: str, source: str | None = None) -> Metrics:
    """With a source, a long sentence is excused only if it also came from the source's explanation."""
    values, sentences, sizes, passive = counted(text)
    if values["words"] < R.MIN_WORDS_TO_SCORE:
        return Metrics(values, False)
    metrics = Metrics(values, True, passive_sentences=passive)
    long_ = [s for n, s in zip(sizes, sentences, strict=True) if n > R.LONG_SENTENCE]
    left = explaining.joined_sentences(text, source) if long_ else Counter()
    excused, judged = [], []
    for n, s in zip(sizes, sentences, strict=True):
        if n > R.LONG_SENTENCE and left and left[key := explaining.sentence_key(s)] > 0:  # each occurrence is excused once
            left[key] -= 1
            excused.append((n, s))
        else:
            judged.append((n, s))
    longest = lambda found: sorted(((n, s) for n, s in found if n > R.LONG_SENTENCE), key=lambda x: -x[0])
    metrics.long_sentences, metrics.joined_sentences = longest(judged), longest(excused)
    if excused:
        metrics.judged = {"max_sentence_words": max((n for n, _ in judged), default=0), "pct_long_sentences": share(len(metrics.long_sentences), len(sizes))}
    return metrics


def disagreements(text: str) -> list[str]:
    """Where the positioned segmentation and the counted one differ; empty if they agree."""
    counted, placed = measure(text), P.spans(text)
    if not counted.scored:
        return []
    size = {k: [s["words"] for s in v] for k, v in placed.items()}
    seen = {
        "sentences": len(size["sentences"]), "max_sentence_words": max(size["sentences"], default=0), "paragraphs": len(size["paragraphs"]),
        "max_paragraph_words": max(size["paragraphs"], default=0), "words": sum(size["sentences"]),
    }
    return [f"{k}: spans {v}, metrics {counted.values[k]}" for k, v in seen.items() if v != counted.values[k]]
