"""Per-document functions as DataFrame transforms.

What needs a scan of characters, positions or state runs as an Arrow function over batches: a document is a row, so nothing
is shuffled but where a second table is joined. Each returns id_col and its own columns; other columns stay out, so no name
clashes. A null text counts as empty, a null id is carried, and CR and CRLF are read as LF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosemill.functions import explaining, facts, findings, gaps, gates, grammar, insight, measuring, prose, reports
from prosemill.functions import rules as R
from prosemill.operators.measure import METRICS

POSITION = "line: int, col: int, end_line: int, end_col: int, from: int, to: int"
FINDING = f"rule: string, kind: string, text: string, {POSITION}, fix: string, hint: string"
SPAN = f"words: int, {POSITION}"
FLAG = "rule: string, count: int, hint: string, samples: array<string>"


def schema_of(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


def calmly(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    def calm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with prose.fewer_collections():
            yield from run(batches)

    return calm


def each(docs: DataFrame, columns: str, function: Callable[..., dict | tuple | list[dict]], id_col: str, *texts: str) -> DataFrame:
    """function(text, ...) for each row, as columns: a dict or tuple for a row, a list of dicts for a row each."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema_of(columns)]
    kind = docs.schema[id_col].dataType
    id_type, names = to_arrow_type(kind), [f[0] for f in fields]

    @calmly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, rows = [], []
                for key, *own in zip(part.column("_id").to_pylist(), *(part.column(f"_t{k}").to_pylist() for k in range(len(texts))), strict=True):
                    made = function(*own)
                    for row in made if isinstance(made, list) else [made]:
                        ids.append(key)
                        rows.append(row if isinstance(row, dict) else dict(zip(names, row, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type)] + [pa.array([r[n] for r in rows], t) for n, t in fields], names=["_id", *names])

    picked = docs.select(F.col(id_col).alias("_id"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(texts)])
    return picked.mapInArrow(run, f"_id {kind.simpleString()}, {columns}").withColumnRenamed("_id", id_col)


def positions_ddl(struct: str) -> str:
    return struct.replace(":", "").replace("from int", "`from` int").replace("to int", "`to` int")


def located(which: str, utf16: bool) -> Callable[[str | None], list[dict]]:
    find = {"tells": findings.tells, "simplify": findings.simplifications, "review": findings.review, "grammar": grammar.grammar, "lengths": findings.lengths}[which]

    def run(text: str | None) -> list[dict]:
        text = prose.newlines(text)
        return [{"nth": i} | f for i, f in enumerate(findings.placed(text, find(text), utf16))]

    return run


def find(docs: DataFrame, which: str = "review", id_col: str = "doc_id", text_col: str = "text", utf16: bool = False) -> DataFrame:
    """A row for each finding, nth in its document. which: tells, simplify, review (both and lengths), lengths or grammar."""
    return each(docs, "nth int, " + positions_ddl(FINDING), located(which, utf16), id_col, text_col)


def flag_rows(flags: list[findings.Flag]) -> list[dict]:
    return [{"rule": f.rule, "count": f.count, "hint": f.hint, "samples": f.samples} for f in flags]


def rewrite(docs: DataFrame, which: str = "typography", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: rewritten, fixes (rule and count, as they first fired), flags (on what came out). which: typography or simplify."""
    apply = {"typography": findings.typography, "simplify": findings.simplify}[which]

    def run(text: str | None) -> tuple:
        r = apply(prose.newlines(text))
        return r.text, [{"rule": k, "n": n} for k, n in r.fixes.items()], flag_rows(r.flags), sum(r.fixes.values()), sum(f.count for f in r.flags)

    return each(docs, f"rewritten string, fixes array<struct<rule: string, n: int>>, flags array<struct<{FLAG}>>, total_fixes int, total_flags int", run, id_col, text_col)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", utf16: bool = False) -> DataFrame:
    """A row for each sentence and paragraph with its words and place."""

    def run(text: str | None) -> list[dict]:
        found = prose.spans(prose.newlines(text), utf16)
        return [{"unit": unit.removesuffix("s"), "nth": i} | s for unit, listed in found.items() for i, s in enumerate(listed)]

    return each(docs, "unit string, nth int, " + positions_ddl(SPAN), run, id_col, text_col)


def long_sentence_at(docs: DataFrame, at: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sentence at an offset (UTF-16 units), of the documents where it is too long."""

    def run(text: str | None) -> list[dict]:
        found = prose.long_sentence_at(prose.newlines(text), at)
        return [{k: found[k] for k in ("words", "from", "to")}] if found else []

    return each(docs, "words int, `from` int, `to` int", run, id_col, text_col)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``measure.measure`` by the plain functions, which need a fraction of the time of its expressions."""
    from pyspark.sql.pandas.types import to_arrow_type

    counts = {"words", "sentences", *R.COUNTS}
    fields = [("scored", pa.bool_(), "boolean"), *((m, pa.int32(), "int") if m in counts else (m, pa.float64(), "double") for m in METRICS)]
    kept = [f"_c{k}" for k in range(len(carry) + 1)]
    kinds = [docs.schema[c].dataType for c in (id_col, *carry)]
    types = [to_arrow_type(k) for k in kinds]

    @calmly
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [measuring.counted(prose.newlines(t))[0] for t in part.column("_text").to_pylist()]
                values = [pa.array([r["words"] >= R.MIN_WORDS_TO_SCORE for r in rows], pa.bool_()), *(pa.array([r.get(n) for r in rows], t) for n, t, _ in fields[1:])]
                own = [part.column(c).cast(t) for c, t in zip(kept, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *values], names=[*kept, *(n for n, _, _ in fields)])

    picked = docs.select(*[F.col(c).alias(k) for c, k in zip((id_col, *carry), kept, strict=True)], F.col(text_col).alias("_text"))
    ddl = ", ".join([*(f"{k} {kind.simpleString()}" for k, kind in zip(kept, kinds, strict=True)), *(f"{n} {kind}" for n, _, kind in fields)])
    return picked.mapInArrow(run, ddl).withColumnsRenamed(dict(zip(kept, (id_col, *carry), strict=True)))


def disagreements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the two segmentations of a document disagree on; no rows if they agree everywhere."""
    return each(docs, "detail string", lambda t: [{"detail": d} for d in measuring.disagreements(prose.newlines(t))], id_col, text_col)


def quotations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each quotation: start, end (code points, marks included) and quote."""

    def run(text: str | None) -> list[dict]:
        text = prose.newlines(text)
        return [{"start": a, "end": b, "quote": text[a:b]} for a, b in prose.quotations(text)]

    return each(docs, "start int, end int, quote string", run, id_col, text_col)


def joints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each connective: kind and at."""
    return each(docs, "kind string, at int", lambda t: [{"kind": k, "at": a} for k, a in explaining.joints(prose.newlines(t))], id_col, text_col)


def promises(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each promised list: text, count, noun, start, end, unpacked, items."""
    run = lambda t: [{"text": p.text, "count": p.count, "noun": p.noun, "start": p.start, "end": p.end, "unpacked": p.unpacked, "items": p.items} for p in explaining.promises(prose.newlines(t))]
    return each(docs, "text string, count int, noun string, start int, end int, unpacked boolean, items array<string>", run, id_col, text_col)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each paragraph with its score as explanation."""
    names = ("words", "sentences", "joints", "definitions", "promises", "anticipations", "padding", "explanatory")
    run = lambda t: [{"nth": i} | {n: getattr(p, n) for n in names} for i, p in enumerate(explaining.scored_paragraphs(prose.newlines(t)))]
    return each(docs, "nth int, " + ", ".join(f"{n} int" for n in names[:-1]) + ", explanatory boolean", run, id_col, text_col)


def fact_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each fact, first of its kind and key: kind, fact, line, key, at."""
    run = lambda t: [{"kind": f.kind, "fact": f.text, "line": f.line, "key": f.key, "at": f.at} for f in facts.facts(prose.newlines(t))]
    return each(docs, "kind string, fact string, line int, key string, at int", run, id_col, text_col)


def insights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each structural failure of an insight: nth, check, detail."""
    run = lambda t: [{"nth": i, "check": c, "detail": d} for i, (c, d) in enumerate(insight.check(prose.newlines(t)))]
    return each(docs, "nth int, check string, detail string", run, id_col, text_col)


def first_uses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each acronym of a document, at its first use: acronym, start, end, explained (the form, or null), plural."""
    run = lambda t: [u.__dict__ for u in gaps.first_uses(prose.newlines(t))]
    return each(docs, "acronym string, start int, end int, explained string, plural boolean", run, id_col, text_col)


# ---- Pairs: a rewrite and the text it was made from ----

GATE = (
    "before int, after int, cut_pct double, padding_before int, padding_after int, padding_cut_pct double, explanation_before int, explanation_after int, explanation_limit int, length_label string, "
    "length_ok boolean, joints_source int, joints_required int, joints_after int, joints_ok boolean, lost_lists array<struct<list: string, missing: array<string>>>, "
    "unkept_before int, unkept_after array<string>, lists_ok boolean, facts_source int, facts_missing array<struct<kind: string, fact: string, line: int>>, over array<string>, failed boolean, "
    "simplified string, joined_sentences array<struct<words: int, sentence: string>>"
)


def gate_row(rewrite_text: str | None, source: str | None, budget=R.BUDGET) -> dict:
    o = gates.judge(prose.newlines(rewrite_text), prose.newlines(source))
    c, e, (total, missing) = o.length, o.kept, o.facts
    before, after = c.padding
    over = o.over(budget)
    return {
        "before": c.before, "after": c.after, "cut_pct": gates.cut_pct(c.before, c.after), "padding_before": before, "padding_after": after, "padding_cut_pct": gates.cut_pct(before, after),
        "explanation_before": c.explaining_before, "explanation_after": c.explaining_after, "explanation_limit": c.limit, "length_label": c.label if c.scored else None, "length_ok": c.ok,
        "joints_source": e.joints_source, "joints_required": e.joints_required, "joints_after": e.joints_after, "joints_ok": e.joints_ok,
        "lost_lists": [{"list": n, "missing": i} for n, i in e.lost], "unkept_before": e.unkept_before, "unkept_after": e.unkept_after, "lists_ok": e.lists_ok,
        "facts_source": total, "facts_missing": [{"kind": f.kind, "fact": f.text, "line": f.line} for f in missing], "over": over, "failed": bool(over), "simplified": o.rewrite.text,
        "joined_sentences": [{"words": n, "sentence": s} for n, s in o.metrics.joined_sentences],
    }


def paired(rewrites: DataFrame, sources: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, rewrite and source, joined on the id; a rewrite without a source is left out."""
    return rewrites.select(id_col, F.col(text_col).alias("rewrite")).join(sources.select(id_col, F.col(text_col).alias("source")), id_col)


def gate(pairs: DataFrame, id_col: str = "doc_id", rewrite_col: str = "rewrite", source_col: str = "source") -> DataFrame:
    """A row for each pair: the simplified rewrite held against its source, gate by gate, and whether it failed."""
    return each(pairs, GATE, gate_row, id_col, rewrite_col, source_col)


def lost_facts(pairs: DataFrame, id_col: str = "doc_id", rewrite_col: str = "rewrite", source_col: str = "source") -> DataFrame:
    """A row for each fact of the source that the rewrite has no more: kind, fact, line, key."""

    def run(new: str | None, source: str | None) -> list[dict]:
        return [{"kind": f.kind, "fact": f.text, "line": f.line, "key": f.key} for f in facts.dropped(prose.newlines(source), prose.newlines(new))[1]]

    return each(pairs, "kind string, fact string, line int, key string", run, id_col, rewrite_col, source_col)


def judged_measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None, budget=R.BUDGET) -> DataFrame:
    """The budget's verdict with joined sentences excused, against a source if there is one: judged_max, judged_pct_long, over_budget."""

    def run(text: str | None, source: str | None = None) -> tuple:
        m = measuring.measure(prose.newlines(text), prose.newlines(source) if source is not None else None)
        value = lambda n: float(m.judged.get(n, m.values[n])) if m.scored else None
        return m.scored, value("max_sentence_words"), value("pct_long_sentences"), m.over_budget(budget), len(m.joined_sentences)

    return each(docs, "scored boolean, judged_max double, judged_pct_long double, over_budget array<string>, joined int", run, id_col, text_col, *([source_col] if source_col else []))


# ---- Reports ----


def report(docs: DataFrame, which: str = "simplify", as_json: bool = False, with_insight: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None, budget=R.BUDGET) -> DataFrame:
    """A row for each row: rewritten, report and failed. which: typography, simplify or grammar."""

    def run(text: str | None, source: str | None = None) -> tuple:
        text = prose.newlines(text)
        if which == "typography":
            r = findings.typography(text)
            return r.text, (reports.typography_json if as_json else reports.typography_text)(r), False
        if which == "grammar":
            flags = grammar.flags(text, grammar.grammar(text))
            return text, (reports.grammar_json if as_json else reports.grammar_text)(flags), False
        o = gates.judge(text, prose.newlines(source) if source is not None else None)
        failures = insight.check(o.rewrite.text) if with_insight else None
        return o.rewrite.text, (reports.simplify_json if as_json else reports.simplify_text)(o, budget, failures), bool(o.over(budget) or failures)

    return each(docs, "rewritten string, report string, failed boolean", run, id_col, text_col, *([source_col] if source_col else []))
