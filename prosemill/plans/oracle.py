"""DuckDB SQL for the registered queries, built from the rule data. RE2 knows no lookaround, so passes are repeated or marked."""

from __future__ import annotations

from prosemill.functions import insight as I
from prosemill.functions import rules as R
from prosemill.functions.dialect import sql_text as q
from prosemill.functions.rules import Rule
from prosemill.plans import snippets as S

NL = "chr(10)"
MARK, GUARD = "\ue001", "\ue000"
SPACE = r"[ \t\r\f\v]"
#: ABBREVIATION with the character before it, as no letter of any script may stand there.
STOPPED = r"(^|[^\pL\pM\pN_])((?i:" + "|".join(a.replace(".", r"\.") for a in R.ABBREVIATIONS.split()) + r"))\."


def sub(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(new)}, 'g')"


def n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def twice(text: str, pattern: str, new: str) -> str:
    return sub(sub(text, pattern, new), pattern, new)


def ascii_words(text: str) -> str:
    """Other letters as underscores, so that RE2's word boundaries stand where Unicode's do."""
    return sub(text, "[^\\x00-\\x7f‘’“”—–…£€]", "_")


def plain(text: str, by_line: bool = False) -> str:
    text = sub(text, R.URL, "LINK")
    for pattern, new in R.MARKDOWN:
        if by_line:
            pattern = pattern.replace(r"[-=:|+\s]", r"[-=:|+ \t\r\f\v]").replace(r"\s", SPACE)
        text = sub(text, pattern, new)
    return text


def structure(snippets: tuple[str, ...] = ()) -> str:
    """CTEs up to s: doc_id, lang, source, blocks, plain, sentences."""
    documents = f"({S.injected_sql(snippets)}) AS i" if snippets else "documents"
    block = R.BLOCK_START.replace(r"\s", SPACE)
    code = f"array_to_string(list_filter(flatten(list_transform(string_split_regex(raw, {q(R.FENCE)}), lambda p: string_split_regex(p, {q(R.INLINE)}))), lambda x: x <> ''), ' ')"
    marked = sub(sub("prose", f"(?m)^{SPACE}+|{SPACE}+$", ""), rf"\n({block})", f"\n{MARK}\\1")
    sentence = sub(sub("plain", STOPPED, f"\\1\\2{GUARD}"), R.SENTENCE_END, "\\1\n")
    return f"""
    WITH d AS (SELECT doc_id, lang, source, {sub("coalesce(text, '')", "\\r\\n?", chr(10))} AS raw FROM {documents}),
    c AS (SELECT doc_id, lang, source, {code} AS prose FROM d),
    b AS (SELECT doc_id, lang, source, replace({twice(marked, f"([^\\n])\\n([^\\n{MARK}])", "\\1 \\2")}, '{MARK}', '') AS blocks FROM c),
    p AS (SELECT *, {plain("blocks")} AS plain FROM b),
    s AS (SELECT *, list_transform(list_filter(string_split({sentence}, {NL}), lambda x: regexp_matches(x, {q(R.WORD)})), lambda x: trim(replace(x, '{GUARD}', '.'), ' ' || chr(9) || chr(13))) AS sentences FROM p)"""


def round1(x: str) -> str:
    k, odd = f"floor(abs({x}) * 10)", f"(2 * floor(abs({x}) * 10) + 1)"
    up = f"CASE WHEN 4 * abs({x}) > {odd} - 16 * abs({x}) THEN {k} + 1 WHEN 4 * abs({x}) < {odd} - 16 * abs({x}) THEN {k} WHEN {k}::BIGINT % 2 = 0 THEN {k} ELSE {k} + 1 END"
    return f"(sign({x}) * ({up}) / 10)"


def measured() -> str:
    """CTEs up to m: every metric."""
    words = f"regexp_extract_all(plain, {q(R.WORD)})"
    beats = "list_transform(words, lambda w: CASE WHEN len(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(w, '([^laeiouy]es|[^laeiouy]e|ed)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END)"
    passive = ascii_words("x")
    lines = plain("blocks", by_line=True)
    return f"""{structure()},
    w AS (SELECT *, list_transform({words}, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')) AS words, len({words}) AS n,
        len(list_filter({words}, lambda w: len(w) > 4 AND lower(w) LIKE '%ly')) AS ly,
        list_transform(sentences, lambda x: {n("x", R.WORD)}) AS sizes,
        list_filter(list_transform(string_split({lines}, {NL}), lambda x: {n("x", R.WORD)}), lambda k: k > 0) AS paras,
        len(list_filter(sentences, lambda x: regexp_matches({passive}, {q(R.PASSIVE)}))) AS passives FROM s),
    y AS (SELECT *, {beats} AS beats, len(sentences) AS k, n::DOUBLE / len(sentences) AS wps FROM w),
    v AS (SELECT *, CASE WHEN n > 0 THEN list_sum(beats)::DOUBLE / n END AS spw, n >= {R.MIN_WORDS_TO_SCORE} AS scored FROM y),
    m AS (SELECT doc_id, lang, source, scored, n AS words, k AS sentences,
        CASE WHEN scored THEN len(paras) END AS paragraphs, CASE WHEN scored THEN list_max(sizes) END AS max_sentence_words,
        CASE WHEN scored THEN coalesce(list_max(paras), 0) END AS max_paragraph_words,
        CASE WHEN scored THEN {round1("wps")} END AS mean_sentence_words,
        CASE WHEN scored THEN {round1(f"(100e0 * len(list_filter(sizes, lambda z: z > {R.LONG_SENTENCE})) / k)")} END AS pct_long_sentences,
        CASE WHEN scored THEN {round1("(206.835e0 - 1.015e0 * wps - 84.6e0 * spw)")} END AS flesch_reading_ease,
        CASE WHEN scored THEN {round1("(0.39e0 * wps + 11.8e0 * spw - 15.59e0)")} END AS flesch_kincaid_grade,
        CASE WHEN scored THEN {round1("(100e0 * passives / k)")} END AS pct_passive_sentences,
        CASE WHEN scored THEN {round1(f"(100e0 * len(list_filter(beats, lambda z: z >= {R.LONG_WORD_SYLLABLES})) / n)")} END AS pct_long_words,
        CASE WHEN scored THEN {round1("(100e0 * ly / n)")} END AS pct_ly_adverbs FROM v)"""


def metrics(columns: str) -> str:
    return f"{measured()} SELECT {columns} FROM m"


def judged() -> str:
    tests = ", ".join(f"CASE WHEN {name} {'>' if direction == 'max' else '<'} {limit}e0 THEN '{name}' END" for name, direction, limit in R.BUDGET)
    return f"{measured()}, j AS (SELECT *, list_filter([{tests}], lambda x: x IS NOT NULL) AS over FROM m)"


def verdicts(columns: str) -> str:
    return f"{judged()} SELECT {columns} FROM j"


def grouped(key: str) -> str:
    return f"""{judged()} SELECT {key}, count(*) AS documents, sum(scored::INT)::BIGINT AS scored_documents, sum(words)::BIGINT AS words,
    sum((len(over) > 0)::INT)::BIGINT AS failed_documents FROM j GROUP BY {key}"""


def sentences() -> str:
    return f"""{structure()}, e AS (SELECT doc_id, unnest(sentences) AS x, generate_subscripts(sentences, 1) - 1 AS number FROM s)
    SELECT doc_id, number::BIGINT AS number, md5(x) AS sentence_md5, {n("x", R.WORD)}::BIGINT AS words FROM e"""


def paragraphs() -> str:
    return f"""{structure()}, l AS (SELECT doc_id, list_filter(string_split({plain("blocks", by_line=True)}, {NL}), lambda x: regexp_matches(x, {q(R.WORD)})) AS ps FROM p),
    e AS (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS number FROM l) SELECT doc_id, number::BIGINT AS number, {n("x", R.WORD)}::BIGINT AS words FROM e"""


def re2(pattern: str) -> str:
    """The one lookbehind of the tables as a character before; the one lookahead goes, its cases are taken out beforehand."""
    return pattern.replace(r"(?<![\w'’])", r"(?:^|[^\w'’])").replace(r"(?!\s+than\b)", "")


def rule_counts(rules: tuple[Rule, ...], snippets: tuple[str, ...]) -> str:
    closed = {"tell": "closed"}
    parts = [f"SELECT '{r.name}' AS rule, sum({n('text' if r.anchored else closed.get(r.kind, 'text'), re2(r.pattern))})::BIGINT AS hits FROM t" for r in rules]
    return f"""WITH i AS ({S.injected_sql(snippets)}), t AS (SELECT {sub(ascii_words("text"), "(?i)\\brather\\s+than\\b", "-")} AS text, {sub(ascii_words("text"), "\\s*\\n\\s*", " ")} AS closed FROM i)
    SELECT rule, hits FROM ({' UNION ALL '.join(parts)}) WHERE hits > 0"""


def chat_residue() -> str:
    chat = [r for r in R.TELLS if r.name.startswith("chat:")]
    hits = " + ".join(n("text" if r.anchored else "closed", r.pattern) for r in chat)
    return f"""WITH t AS (SELECT role, {ascii_words("coalesce(text, '')")} AS text, {sub(ascii_words("coalesce(text, '')"), "\\s*\\n\\s*", " ")} AS closed FROM conversations)
    SELECT role, count(*) AS turns, sum({hits})::BIGINT AS hits FROM t GROUP BY role"""


def tell_positions() -> str:
    """By the text before each hit: lines are its newlines, columns what follows the last."""
    pattern = q(next(r.pattern for r in R.TELLS if r.name == "word:vocabulary"))
    return f"""WITH i AS ({S.injected_sql(S.TELLS)}), t AS (SELECT doc_id, text, {ascii_words("text")} AS plain FROM i),
    h AS (SELECT doc_id, text, regexp_extract_all(plain, {pattern}) AS hits, string_split_regex(plain, {pattern}) AS parts FROM t),
    e AS (SELECT doc_id, text, unnest(range(1, len(hits) + 1)) AS k, hits, parts FROM h),
    a AS (SELECT doc_id, text, k, hits[k] AS hit, list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS offset_at FROM e),
    b AS (SELECT *, left(text, offset_at::BIGINT) AS before FROM a)
    SELECT doc_id, substring(text, offset_at::BIGINT + 1, length(hit)) AS text, (length(before) - length(replace(before, {NL}, '')) + 1)::BIGINT AS line,
    (length(string_split(before, {NL})[-1]) + 1)::BIGINT AS col FROM b"""


def typography_steps() -> list[tuple[str, list[tuple[str, str]]]]:
    """Of each rule, in order: the passes that RE2 needs for it, as (pattern, replacement)."""
    steps = []
    for name, pattern, new in R.TYPOGRAPHY:
        passes = {
            "endash_range": [(r"(\d)(?:\s+–\s*|–\s+)(\d)", r"\1–\2")] * 2,
            "run_spaces": [(r"(\S)[ \t]{2,}(\S)", r"\1 \2")] * 2,
            "in_order_to": [(r"\bI(?i:n order to)\b", "To"), (pattern, new)],
            "endash_clause": [(pattern.replace(r"\s", r"[\s\x{a0}\x{2009}]"), new)],
        }
        steps.append((name, passes.get(name, [(pattern, new)])))
    return steps


def typography() -> str:
    text = "text"
    for _, passes in typography_steps():
        for pattern, new in passes:
            text = sub(text, pattern, new)
    return f"WITH i AS ({S.injected_sql(S.TYPOGRAPHY)}), t AS (SELECT doc_id, {sub(text, '[ \\t]+$', '')} AS text FROM i) SELECT doc_id, md5(text) AS text_md5, length(text)::BIGINT AS chars FROM t"


def tallies() -> str:
    """A table for each pass, with the hits of the passes before."""
    tables, counts, last = [f"WITH s0 AS ({S.injected_sql(S.TYPOGRAPHY)})"], [], 0
    for name, passes in typography_steps():
        hits = []
        for pattern, new in passes:
            last += 1
            tables.append(f"s{last} AS MATERIALIZED (SELECT doc_id, {sub('text', pattern, new)} AS text, {n('text', pattern)} AS hits FROM s{last - 1})")
            hits.append(f"SELECT doc_id, hits FROM s{last}")
        counts.append(f"SELECT '{name}' AS rule, doc_id, sum(hits) AS hits FROM ({' UNION ALL '.join(hits)}) GROUP BY doc_id")
    return f"{', '.join(tables)} SELECT rule, sum(hits)::BIGINT AS fixes, count(*) AS documents FROM ({' UNION ALL '.join(counts)}) WHERE hits > 0 GROUP BY rule"


def clutter() -> str:
    text = "text"
    for r in R.CLUTTER:
        what, value = r.action
        if what == "word":
            body = r.pattern.removeprefix(r"(?i)\b(?:").removesuffix(r")\b").split("|")
            capital = "|".join(f"{p[0].upper()}(?i:{p[1:]})" for p in body)
            text = sub(sub(text, rf"\b(?:{capital})\b", value[0].upper() + value[1:]), r.pattern, value)
        elif what == "keep":
            text = sub(text, r.pattern, value)
    text = twice(text, r"(\S)[ \t]{2,}(\S)", r"\1 \2")
    return f"WITH i AS ({S.injected_sql(S.CLUTTER)}), t AS (SELECT doc_id, {text} AS text FROM i) SELECT doc_id, md5(text) AS text_md5, length(text)::BIGINT AS chars FROM t"


def facts() -> str:
    return f"WITH i AS ({S.injected_sql(S.FACTS)}), t AS (SELECT doc_id, {ascii_words('text')} AS text FROM i)"


def numbers() -> str:
    bare = sub(sub("text", R.DATE, " "), R.LIST_MARKER, " ")
    pattern = q("([A-Za-z_]?)(" + R.NUMBER + ")")
    return f"""{facts()}, b AS (SELECT doc_id, {bare} AS text FROM t),
    e AS (SELECT doc_id, unnest(regexp_extract_all(text, {pattern}, 2)) AS digits, unnest(regexp_extract_all(text, {pattern}, 1)) AS lead FROM b)
    SELECT DISTINCT doc_id, replace(rtrim(digits, '.,'), ',', '') AS key FROM e WHERE lead = ''"""


def dates() -> str:
    return f"{facts()} SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, {q(R.DATE)}))) AS fact FROM t"


def insight() -> str:
    return f"SELECT doc_id, array_to_string(list_sort(list(\"check\")), ',') AS checks FROM ({insight_details()}) GROUP BY doc_id"


def insight_details() -> str:
    """Figures are placed as in tell_positions, as their surroundings decide."""
    contained = lambda s: f"CASE WHEN NOT contains(lower(text), {q(s.lower())}) THEN {q(s)} END"
    rows = [
        f"SELECT doc_id, 0 AS step, 0 AS place, 'sections' AS \"check\", format({q(I.ABSENT)}, array_to_string(absent, ', ')) AS detail FROM (SELECT doc_id, list_filter([{', '.join(map(contained, R.SECTIONS))}], lambda x: x IS NOT NULL) AS absent FROM i) WHERE len(absent) > 0",
        f"SELECT doc_id, 1, 0, 'significance', format({q(I.GRADES)}, grades) FROM (SELECT doc_id, {n('text', R.SIGNIFICANCE)} AS grades FROM i) WHERE grades <> 1",
    ]
    for step, (pattern, what) in enumerate(R.CODE_REFERENCES, 2):
        names = f"(SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, {q(pattern)}))) AS names FROM i)"
        more = f"CASE WHEN len(names) > 3 THEN format({q(I.MORE)}, len(names) - 3) ELSE '' END"
        rows.append(f"SELECT doc_id, {step}, 0, 'no_internal_refs', {q(what + ': ')} || array_to_string(names[1:3], ', ') || {more} FROM {names} WHERE len(names) > 0")
    split = lambda step, pattern, what: f"SELECT doc_id, text, plain, {step} AS step, {q(what)} AS what, regexp_extract_all(plain, {q(pattern)}) AS hits, string_split_regex(plain, {q(pattern)}) AS parts FROM t"
    figures = " UNION ALL ".join(split(step, *figure) for step, figure in enumerate(R.CUSTOMER_FIGURES, 10))
    rows.append(f"SELECT doc_id, step, place, 'no_customer_metrics', format({q(I.DISCLOSED)}, what, figure) FROM g WHERE nth = 1")
    return f"""WITH i AS ({S.injected_sql(S.INSIGHTS)}), t AS (SELECT doc_id, text, {ascii_words("text")} AS plain FROM i), h AS ({figures}),
    e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM h),
    a AS (SELECT *, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::BIGINT AS place, length(hits[k]) AS size FROM e),
    f AS (SELECT doc_id, step, place, what, {sub("trim(substring(text, place + 1, size))", "\\s+", " ")} AS figure, substring(plain, greatest(place - {R.LIMIT_WINDOW}, 0) + 1, place + size + {R.LIMIT_WINDOW} - greatest(place - {R.LIMIT_WINDOW}, 0)) AS around FROM a),
    g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(figure) ORDER BY step, place) AS nth FROM f WHERE NOT regexp_matches(around, {q(R.LIMIT_WORDS)})),
    r AS ({' UNION ALL '.join(rows)})
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step, place) - 1)::INT AS nth, "check", detail FROM r"""


def spacing() -> str:
    """Which first uses explain their acronym the snippets say; the fold is a recursion over the entries that use it."""
    explained = " OR ".join(f"(acronym = '{a}' AND a.doc_id % {len(S.GAPS)} = {i})" for i, a in ((0, "OCPP"), (1, "EVSE")))
    return f"""WITH RECURSIVE {first_acronyms().removeprefix("WITH ")},
    b AS (SELECT source AS book_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS entry FROM documents),
    o AS (SELECT book_id, entry, acronym, {explained} AS known, row_number() OVER (PARTITION BY book_id, acronym ORDER BY entry) AS nth FROM a JOIN b ON a.doc_id = b.doc_id),
    r AS (SELECT book_id, acronym, nth, entry, NOT known AS flagged, CAST(NULL AS BIGINT) AS before, entry AS last FROM o WHERE nth = 1
        UNION ALL
        SELECT o.book_id, o.acronym, o.nth, o.entry, NOT o.known AND o.entry - r.last >= {R.SPACING}, r.last, CASE WHEN o.known OR o.entry - r.last >= {R.SPACING} THEN o.entry ELSE r.last END
        FROM r JOIN o ON o.book_id = r.book_id AND o.acronym = r.acronym AND o.nth = r.nth + 1)
    SELECT book_id, entry::BIGINT AS entry, acronym, before::BIGINT AS last_entry FROM r WHERE flagged"""


# ---- Counterparts of parts of larger operators ----


def rollup(*keys: str) -> str:
    return f"""{judged()} SELECT {', '.join(keys)}, count(*) AS documents, sum(scored::INT)::BIGINT AS scored_documents, sum(words)::BIGINT AS words,
    sum((len(over) > 0)::INT)::BIGINT AS failed_documents, floor(1000 * sum(round(10 * flesch_reading_ease)::BIGINT)::DOUBLE / count(flesch_reading_ease)) / 10000 AS mean_reading_ease FROM j GROUP BY ROLLUP ({', '.join(keys)})"""


def units(snippets: tuple[str, ...] = ()) -> str:
    """CTEs up to u: doc_id, unit, nth, x, words."""
    return f"""{structure(snippets)}, l AS (SELECT doc_id, sentences, list_filter(string_split({plain("blocks", by_line=True)}, {NL}), lambda x: regexp_matches(x, {q(R.WORD)})) AS ps FROM s),
    e AS (SELECT doc_id, 'sentence' AS unit, unnest(sentences) AS x, generate_subscripts(sentences, 1) - 1 AS nth FROM l
        UNION ALL SELECT doc_id, 'paragraph', unnest(ps), generate_subscripts(ps, 1) - 1 FROM l),
    u AS (SELECT doc_id, unit, nth::BIGINT AS nth, x, {n("x", R.WORD)}::BIGINT AS words FROM e)"""


def span_words() -> str:
    return f"{units()} SELECT doc_id, unit, nth, words FROM u"


def length_counts() -> str:
    limit = next(limit for name, _, limit in R.BUDGET if name == "max_paragraph_words")
    return f"""{units()} SELECT doc_id, 'long-' || unit AS rule, count(*) AS hits FROM u
    WHERE words > CASE unit WHEN 'sentence' THEN {R.LONG_SENTENCE} ELSE {limit} END GROUP BY ALL"""


def signals() -> str:
    of = lambda pattern: n(ascii_words("trim(x, ' ' || chr(9) || chr(13))"), pattern) + "::BIGINT"
    return f"{units(S.EXPLAINING)} SELECT doc_id, nth, words, {of(R.DEFINITION)} AS definitions, {of(R.ANTICIPATION)} AS anticipations FROM u WHERE unit = 'paragraph'"


def anticipations() -> str:
    return f"SELECT i.doc_id, coalesce(sum(anticipations), 0)::BIGINT AS anticipations FROM documents AS i LEFT JOIN ({signals()}) AS g ON g.doc_id = i.doc_id GROUP BY i.doc_id"


def promises() -> str:
    words = ", ".join(f"'{w}'" for w in R.NUMBER_WORDS)
    return f"""WITH i AS ({S.injected_sql(S.EXPLAINING)}), t AS (SELECT doc_id, {ascii_words("text")} AS text FROM i),
    e AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {q(R.PROMISE)}, 1))) AS number, lower(unnest(regexp_extract_all(text, {q(R.PROMISE)}, 2))) AS noun FROM t)
    SELECT doc_id, noun, coalesce(list_position([{words}], number) - 1, TRY_CAST(number AS BIGINT))::BIGINT AS "count", count(*) AS mentions FROM e GROUP BY ALL"""


def negatives(pattern: str) -> tuple[list[str], str]:
    """The bodies of the negative lookarounds that open a pattern, and its rest."""
    found = []
    while opening := next((o for o in ("(?<!", "(?!") if pattern.startswith(o)), None):
        depth, end = 1, len(opening)
        while depth:
            depth += {"(": 1, ")": -1}.get(pattern[end], 0)
            end += 1
        found.append(pattern[len(opening) : end - 1])
        pattern = pattern[end:]
    return found, pattern


def guarded(word: str) -> str:
    """Whether one of a connective's guards holds for the texts before and after it."""
    ways = []
    for before, after in R.CONNECTIVE_GUARDS[word]:
        (not_before, left), (not_after, right) = negatives(before), negatives(after)
        tests = [f"regexp_matches(before, {q(f'(?i){left}')})"] if left != r"\z" else []  # every text has an end
        tests += [f"regexp_matches(after, {q(rf'(?i)\A(?:{right})')})"] if right else []
        tests += [f"NOT regexp_matches(before, {q(rf'(?i)(?:{x}){left}')})" for x in not_before] + [f"NOT regexp_matches(after, {q(rf'(?i)\A(?:{x})')})" for x in not_after]
        ways.append(f"({' AND '.join(tests)})")
    return f"WHEN '{word}' THEN {' OR '.join(ways)}"


def connectives() -> str:
    """CTEs from c0 (doc_id, plain, left_over) on to joints: doc_id, kind, place.

    For each group of the table: its hits in what the groups before left, those whose guards hold, and the text without these.
    """
    held = f"CASE lower(hit) {' '.join(map(guarded, R.CONNECTIVE_GUARDS))} ELSE true END"
    steps = []
    for i, (_, words) in enumerate(R.JOINTS, 1):
        pattern = q(rf"(?i)\b(?:{words})\b")
        steps.append(f"""h{i} AS MATERIALIZED (SELECT doc_id, plain, regexp_extract_all(left_over, {pattern}) AS hits, string_split_regex(left_over, {pattern}) AS parts FROM c{i - 1}),
    u{i} AS (SELECT doc_id, plain, hits, parts, unnest(range(1, len(hits) + 1)) AS k FROM h{i}),
    p{i} AS (SELECT doc_id, plain, k, hits[k] AS hit, (list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::BIGINT AS place FROM u{i}),
    a{i} AS (SELECT doc_id, k, hit, place, right(regexp_replace(left(plain, place), '\\s+\\z', ''), {R.GUARD_BEFORE}) AS before, substring(plain, place + length(hit) + 1, {R.GUARD_AFTER}) AS after FROM p{i}),
    e{i} AS MATERIALIZED (SELECT doc_id, k, place, {held} AS holds FROM a{i}),
    o{i} AS (SELECT doc_id, list(holds ORDER BY k) AS held FROM e{i} GROUP BY doc_id),
    c{i} AS MATERIALIZED (SELECT h.doc_id, plain, array_to_string(list_transform(range(1, len(parts) + 1), lambda k: parts[k] || CASE WHEN k > len(hits) THEN '' WHEN held[k] THEN repeat('_', length(hits[k])) ELSE hits[k] END), '') AS left_over
        FROM h{i} AS h LEFT JOIN o{i} AS o ON o.doc_id = h.doc_id)""")
    found = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, place FROM e{i} WHERE holds" for i, (kind, _) in enumerate(R.JOINTS, 1))
    return f"{', '.join(steps)}, joints AS ({found})"


def joints() -> str:
    return f"""WITH i AS ({S.injected_sql(S.EXPLAINING)}), c0 AS (SELECT doc_id, text AS plain, text AS left_over FROM (SELECT doc_id, {ascii_words('text')} AS text FROM i)),
    {connectives()} SELECT doc_id, kind, place::INT AS "at" FROM joints"""


def paragraph_joints() -> str:
    """Each paragraph is a text of its own."""
    return f"""{units(S.EXPLAINING)}, c0 AS (SELECT struct_pack(d := doc_id, nth := nth) AS doc_id, text AS plain, text AS left_over FROM (SELECT doc_id, nth, {ascii_words('x')} AS text FROM u WHERE unit = 'paragraph')),
    {connectives()} SELECT c0.doc_id.d AS doc_id, c0.doc_id.nth AS nth, count(kind) AS joints FROM c0 LEFT JOIN joints ON joints.doc_id = c0.doc_id GROUP BY ALL"""


def first_acronyms() -> str:
    """CTEs up to a: doc_id, acronym, plural, of the first use: the least k."""
    text = sub(sub(sub(sub("text", R.FENCE, " "), R.INLINE, " "), R.NOT_PROSE[0], " "), R.NOT_PROSE[1], " ")
    text = sub(sub(text, r"(?m)^\s*#[^\n]*", " "), r"[*_]", " ")
    capitals = "len(regexp_extract_all({w}, '[A-Z]'))"
    shape = f"regexp_full_match({{w}}, '[a-z]?[A-Z][A-Za-z0-9&]*[A-Z0-9]') AND NOT regexp_matches({{w}}, '[a-z][a-z]') AND ({capitals} >= 2 OR ({capitals} = 1 AND regexp_matches({{w}}, '^[A-Z]') AND regexp_matches({{w}}, '[0-9]')))"
    own, short = shape.format(w="w"), shape.format(w="left(w, -1)")
    universal = ", ".join(f"'{u}'" for u in sorted(R.UNIVERSAL))
    return f"""WITH i AS ({S.injected_sql(S.GAPS)}), t AS (SELECT doc_id, string_split_regex({text}, {q("[^\\pL\\pN/.&-]+")}) AS chunks FROM i),
    e AS (SELECT doc_id, generate_subscripts(chunks, 1) AS k, unnest(chunks) AS chunk FROM t),
    w AS (SELECT doc_id, k, regexp_extract(chunk, '^([A-Za-z0-9&]+)(?:$|[/.])', 1) AS w FROM e),
    f AS (SELECT doc_id, k, w, {own} AS plain, ends_with(w, 's') AND {short} AS s FROM w WHERE w <> ''),
    g AS (SELECT doc_id, k, CASE WHEN plain THEN w ELSE left(w, -1) END AS acronym, NOT plain AS plural FROM f WHERE plain OR s),
    a AS (SELECT doc_id, acronym, arg_min(plural, k) AS plural FROM g WHERE acronym NOT IN ({universal}) GROUP BY doc_id, acronym)"""


def acronyms() -> str:
    return f"{first_acronyms()} SELECT doc_id, acronym, plural FROM a"


def missing() -> str:
    return f"{first_acronyms()} SELECT doc_id, acronym FROM a WHERE acronym NOT IN ('CPO', 'DNO', 'list')"


def glossary() -> str:
    """The stops of the snippets' expansions stand after small letters, and their brackets are not nested."""
    end = q(r"^((?:[^(.]|\([^)]*\))*?[a-z0-9)])\.(?:\s|$)")
    return f"""WITH i AS ({S.injected_sql(S.GLOSSARY)}),
    e AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, {q(R.GLOSSARY_LINE)}, 1))) AS headword, unnest(regexp_extract_all(text, {q(R.GLOSSARY_LINE)}, 2)) AS said,
        generate_subscripts(regexp_extract_all(text, {q(R.GLOSSARY_LINE)}, 1), 1) AS k FROM i),
    f AS (SELECT doc_id, k, headword, trim(CASE WHEN regexp_matches(said, {end}) THEN regexp_extract(said, {end}, 1) ELSE said END) AS expansion FROM e)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS nth, headword, expansion FROM f WHERE headword <> '' AND expansion <> ''"""


LOST = r"(?:2025|18,000|4\.5|October)"


def lost_numbers() -> str:
    """Numbers of the source that the rewrite has neither as such, nor as a word, nor among other digits."""
    words = ", ".join(f"'{w}'" for w in R.NUMBER_WORDS)
    bare = lambda text: sub(sub(text, R.DATE, " "), R.LIST_MARKER, " ")
    pattern = q("([A-Za-z_]?)(" + R.NUMBER + ")")
    found = lambda name: f"(SELECT doc_id, unnest(regexp_extract_all({bare(name)}, {pattern}, 2)) AS digits, unnest(regexp_extract_all({bare(name)}, {pattern}, 1)) AS lead FROM t)"
    keys = lambda name: f"SELECT DISTINCT doc_id, replace(rtrim(digits, '.,'), ',', '') AS key FROM {found(name)} WHERE lead = ''"
    return f"""WITH i AS ({S.injected_sql(S.FACTS)}), t AS (SELECT doc_id, {ascii_words("text")} AS text, {ascii_words(sub("text", LOST, ""))} AS new FROM i),
    a AS ({keys("text")}), b AS ({keys("new")}), c AS (SELECT * FROM a ANTI JOIN b USING (doc_id, key))
    SELECT doc_id, key FROM c JOIN t USING (doc_id)
    WHERE NOT (coalesce(TRY_CAST(key AS BIGINT) < {len(R.NUMBER_WORDS)}, false) AND coalesce(regexp_matches(new, '(?i)\\b' || [{words}][TRY_CAST(key AS BIGINT) + 1] || '\\b'), false))
    AND NOT regexp_matches(replace(new, ',', ''), '(^|[^0-9.])' || replace(key, '.', '\\.') || '($|[^0-9])')"""


def date_keys() -> str:
    """Of a date in small letters, bare of ordinals: its words, month and numbers, then its key, as three selects to nest."""
    from prosemill.functions.facts import MONTHS

    months = f"[{', '.join(map(q, MONTHS))}]"
    parts = f"""SELECT *, list_filter(list_transform(list_filter(words, lambda w: regexp_full_match(w, '[a-z]+')), lambda w: list_position({months}, left(w, 3))), lambda m: m > 0)[1:1] AS months,
        list_transform(list_filter(words, lambda w: regexp_full_match(w, '[0-9]+')), lambda w: w::BIGINT) AS numbers FROM (SELECT *, regexp_extract_all(bare, '[a-z0-9]+') AS words FROM dated)"""
    order = """CASE WHEN len(months) = 0 AND len(numbers) = 3 THEN CASE WHEN numbers[1] > 31 THEN numbers ELSE list_reverse(numbers) END
        WHEN len(months) = 1 AND len(numbers) = 2 THEN [numbers[2], months[1], numbers[1]] WHEN len(months) = 1 AND len(numbers) = 1 THEN [numbers[1], months[1]] ELSE [0] END"""
    spelled = "array_to_string(list_transform(list_filter(string_split_regex(translate(bare, ',.', '  '), '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN regexp_full_match(w, '[a-z]+') THEN left(w, 3) ELSE w END), ' ')"
    padded = "array_to_string(list_transform(ordered, lambda k: CASE WHEN k < 10 THEN '0' ELSE '' END || k::VARCHAR), '-')"
    return f"SELECT doc_id, version, place, fact, CASE WHEN ordered[1] > 31 THEN {padded} ELSE {spelled} END AS key FROM (SELECT *, {order} AS ordered FROM ({parts}))"


def pieces(table: str, text: str, pattern: str) -> str:
    return f"SELECT doc_id, version, text, regexp_extract_all({text}, {q(pattern)}) AS hits, string_split_regex({text}, {q(pattern)}) AS parts FROM {table}"


def hits_at(table: str) -> str:
    before = "list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)"
    return f"SELECT doc_id, version, text, hits[k] AS hit, ({before})::BIGINT AS place FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM {table})"


def lost_facts() -> str:
    """Dates and numbers; the snippets and the corpus have neither quotations nor code."""
    blank = "array_to_string(list_transform(range(1, len(parts) + 1), lambda k: parts[k] || CASE WHEN k > len(hits) THEN '' ELSE repeat(' ', length(hits[k])) END), '')"
    bare = sub("lower(hit)", R.ORDINAL, "\\1")
    return f"""WITH source AS ({S.injected_sql(S.FACTS)}),
    t AS (SELECT doc_id, 'old' AS version, {ascii_words("text")} AS text FROM source UNION ALL SELECT doc_id, 'new', {ascii_words(sub("text", LOST, ""))} FROM source),
    day AS MATERIALIZED ({pieces("t", "text", R.DATE)}), dated AS (SELECT *, hit AS fact, {bare} AS bare FROM ({hits_at("day")})), keyed AS ({date_keys()}),
    dateless AS (SELECT doc_id, version, {blank} AS text FROM day), marked AS ({pieces("dateless", "text", R.LIST_MARKER)}), rest AS (SELECT doc_id, version, {blank} AS text FROM marked WHERE version = 'old'),
    digit AS ({pieces("rest", "text", "[A-Za-z_]?" + R.NUMBER)}),
    num AS (SELECT doc_id, text, place, rtrim(hit, '.,') AS digits FROM ({hits_at("digit")}) WHERE regexp_matches(hit, '^[0-9]')),
    shown AS (SELECT doc_id, 'number' AS kind, place, replace(digits, ',', '') AS key, CASE WHEN place > 0 AND contains('{R.CURRENCY}', substring(text, place, 1)) THEN substring(text, place, 1) ELSE '' END || digits
        || regexp_extract(substring(text, place + length(digits) + 1), {q(f"^(?:{R.UNIT})")}) AS fact FROM num),
    gone AS (SELECT doc_id, 'number' AS kind, key FROM ({lost_numbers()}) UNION ALL SELECT DISTINCT doc_id, 'date', key FROM (SELECT doc_id, key FROM keyed WHERE version = 'old') AS o ANTI JOIN (SELECT doc_id, key FROM keyed WHERE version = 'new') AS w USING (doc_id, key)),
    found AS (SELECT doc_id, kind, key, arg_min(fact, place) AS fact, min(place) AS place FROM (SELECT doc_id, kind, key, fact, place FROM shown UNION ALL SELECT doc_id, 'date', key, fact, place FROM keyed WHERE version = 'old') GROUP BY ALL)
    SELECT doc_id, kind, fact, (length(left(text, place)) - length(replace(left(text, place), {NL}, '')) + 1)::INT AS line, key FROM gone JOIN found USING (doc_id, kind, key) JOIN source USING (doc_id)"""


def same_openings() -> str:
    """Runs of sentences of one line of prose that open with the same word; an article opens a run of its own."""
    block = R.BLOCK_START.replace(r"\s", SPACE)
    split = sub(sub("line", STOPPED, f"\\1\\2{GUARD}"), R.SENTENCE_END, "\\1\n")
    return f"""{structure(S.HARD)},
    l AS (SELECT doc_id, unnest(list_filter(string_split(blocks, {NL}), lambda x: NOT regexp_matches(x, {q(f"^(?:{block})")}))) AS blocks FROM s),
    n AS (SELECT doc_id, row_number() OVER () AS k, {plain("blocks", by_line=True)} AS line FROM l),
    o AS (SELECT doc_id, k, list_transform(list_filter(string_split({split}, {NL}), lambda x: regexp_matches(x, {q(R.WORD)})), lambda x: lower(regexp_extract(x, {q(R.WORD)}))) AS words FROM n),
    e AS (SELECT doc_id, k, unnest(words) AS word, generate_subscripts(words, 1) AS nth FROM o),
    opened AS (SELECT *, (word IN ('the', 'a', 'an') OR coalesce(word <> lag(word) OVER (PARTITION BY k ORDER BY nth), true))::INT AS opens FROM e),
    r AS (SELECT doc_id, k, nth, sum(opens) OVER (PARTITION BY k ORDER BY nth) AS run FROM opened),
    runs AS (SELECT doc_id, count(*) AS sentences FROM r GROUP BY doc_id, k, run HAVING count(*) >= {R.SAME_OPENING_RUN})
    SELECT doc_id, count(*) AS runs FROM runs GROUP BY doc_id"""
