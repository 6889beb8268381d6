"""The rule tables: what each rule is called, what it matches and what it says. Data only.

Patterns are written once, in the syntax that Java, RE2 and the regex module share (Unicode classes are meant: the helpers of
``dialect`` add what each engine needs). ``'`` outside a class stands for a straight or curly apostrophe, which may be missing
where a ``?`` follows. A rule's ``triggers`` are words (lower case) of which every match holds one, so that a text without them
needs no search; a rule without triggers is always searched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

QUOTE = "['’]"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    kind: str = "tell"
    hint: str | None = None
    #: Sees real line starts; the other tells see a copy with hard wraps closed up.
    anchored: bool = False
    #: For clutter: ("word", w) a plain word, cased as the hit; ("keep", template); ("drop", "") all but the next letter.
    action: tuple[str, str] | None = None
    triggers: frozenset[str] = frozenset()


def phrase_pattern(phrases: list[str]) -> str:
    """Any of the phrases as whole words, in any case, with any white space for each space."""
    return r"(?i)\b(?:" + "|".join(p.replace("'", QUOTE).replace(" ", r"\s+") for p in phrases) + r")\b"


def phrase_triggers(phrases: list[str]) -> frozenset[str]:
    """The longest plain word of each phrase, a common one only for want of another; with and without a letter that may be missing."""
    bare = [re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)\??", " ", p) for p in phrases]
    spelled = [q for p in bare for q in (re.sub(r"(\S)\?", r"\1", p), re.sub(r"\S\?", "", p))]
    return frozenset(max((w for w in re.split(r"[^a-z]+", p)), key=lambda w: (w not in COMMON and len(w) > 2, len(w))) for p in spelled)


#: Words that many texts hold.
COMMON = frozenset("the and that this with from have has for not are was were which will can its you all any one what when there their they".split())


def either_quote(pattern: str) -> str:
    """The pattern with every apostrophe outside a class as a straight or a curly one."""
    return re.sub(r"\[[^\]]*\]|'", lambda m: QUOTE if m[0] == "'" else m[0], pattern)


def tell(name: str, pattern: str, triggers: str, anchored: bool = False) -> Rule:
    return Rule(name, either_quote(pattern), anchored=anchored, triggers=frozenset(triggers.split()))


def said(name: str, phrases: str) -> Rule:
    listed = [p.strip() for p in phrases.split(",")]
    return Rule(name, phrase_pattern(listed), triggers=phrase_triggers(listed))


# ---- Fixed values: thresholds, limits and word lists that results depend on. ----

LONG_SENTENCE, LONG_WORD_SYLLABLES, MIN_WORDS_TO_SCORE, SAME_OPENING_RUN = 25, 3, 30, 3
COMPRESSION_TARGET, EXPLANATION_GROWTH = 40.0, 1.5
EXPLANATORY_DENSITY, SURVIVES = 0.4, 0.5
JOINED_MAX_WORDS, JOINED_MAX_CLAUSES, MIN_JOINTS_TO_GATE = 45, 3, 3
QUOTE_MAX, SPACING, LIMIT_WINDOW = 400, 8, 40
TELL_PAD, SIMPLIFY_PAD, SAMPLES = 24, 28, 3

#: (metric, direction, limit) in the order of verdicts; limits are inclusive.
BUDGET: tuple[tuple[str, str, float], ...] = (
    ("mean_sentence_words", "max", 18.0),
    ("max_sentence_words", "max", 30.0),
    ("pct_long_sentences", "max", 15.0),
    ("flesch_reading_ease", "min", 50.0),
    ("flesch_kincaid_grade", "max", 12.0),
    ("pct_passive_sentences", "max", 10.0),
    ("pct_long_words", "max", 20.0),
    ("max_paragraph_words", "max", 90.0),
    ("pct_ly_adverbs", "max", 4.0),
)
COUNTS = ("words", "sentences", "paragraphs", "max_sentence_words", "max_paragraph_words")

WORD = r"[A-Za-z][A-Za-z'’\-]*"
FENCE = r"(?s:```.*?```|~~~.*?~~~)|(?m:^ {0,3}\[\^[^\]\n]+\]:[^\n]*(?:\n(?: {4}|\t)[^\n]*)*)"
INLINE = r"`[^`\n]+`|\[\^[^\]\s]+\]"
ABBREVIATIONS = "e.g i.e etc vs approx Mr Mrs Ms Dr Prof Fig No Inc Ltd Corp St Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"
ABBREVIATION = r"(?i)\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS.split()) + r")\."
SENTENCE_END = r"""([.!?])["')\]*_~]*\s+"""
BLOCK_START = r"(?:[-*+]\s|\d+[.)]\s|#{1,6}\s|>|\||```|~~~)"
URL = r"https?://[^\s)]+|www\.[^\s)]+"
#: Markdown that is stripped before counting, in this order: (pattern by line, replacement).
MARKDOWN: tuple[tuple[str, str], ...] = (
    (r"(?m)^[-=:|+\s]{3,}$", ""),
    (r"(?m)^\s{0,3}#{1,6}\s*", ""),
    (r"(?m)^\s{0,3}>\s?", ""),
    (r"(?m)^\s{0,3}(?:[-*+]|\d+[.)])\s+", ""),
    (r"!?\[([^\]\n]*)\]\([^)\n]*\)", r"\1"),
    (r"[*_]{1,3}([^*_\n]+)[*_]{1,3}", r"\1"),
    (r"\|", " "),
)

#: Words that an apostrophe stands in front of.
ELISIONS = frozenset("bout cause cos coz cuz em n nuff til tis twas twere twill".split())

TELLS: tuple[Rule, ...] = (
    said(
        "word:vocabulary",
        "delve, delves, delved, delving, tapestry, realm, realms, testament, beacon, landscape, nuanced, multifaceted, underscore, "
        "underscores, pivotal, intricate, myriad, plethora, elevate, elevates, holistic, synergy, seamless, seamlessly, robust, "
        "leverage, leveraging, utilize, utilizes, utilized, utilizing, utilise, utilises, utilised, utilising, meticulous, "
        "meticulously, bustling, vibrant, crucial, vital, harness, unlock, unlocking, embark, foster, fostering, cultivate, "
        "endeavor, endeavour, paramount, showcase, showcases, showcasing, streamline, streamlines, streamlined, streamlining, "
        "cutting-edge, state-of-the-art, transformative, revolutionise, revolutionize, revolutionary, empower, empowers, "
        "empowering, resonate, resonates, unparalleled, ever-evolving, profound, innovative, spearhead, boasts, additionally, "
        "garner, garners, garnered, interplay, bolster, bolsters, bolstered, enduring, nestled, renowned, stunning, breathtaking, "
        "groundbreaking",
    ),
    tell("phrase:not-just", r"(?i)\bit'?s not just\b[^.\n]*?\bit'?s\b", "not"),
    tell("phrase:not-about", r"(?i)\bit'?s not (?:just )?about\b[^.\n]*?\bit'?s about\b", "about"),
    tell("phrase:not-only", r"(?i)\bnot only\b[^.\n]*?\bbut also\b", "also"),
    tell("phrase:dive-in", r"(?i)\blet'?s (?:dive|delve|jump)\b", "dive delve jump"),
    tell("phrase:dive-deeper", r"(?i)\bdive (?:deeper|into)\b", "dive"),
    tell("phrase:todays-world", r"(?i)\bin today'?s (?:fast-paced|digital|modern|ever-changing)\b", "fast digital modern ever"),
    tell("phrase:worth-noting", r"(?i)\bit(?:'?s| is) (?:worth|important) (?:noting|to note|to remember|to understand|to highlight|to recognis[ez]e) that\b", "worth important"),
    tell("phrase:when-it-comes", r"(?i)\bwhen it comes to\b", "comes"),
    tell("phrase:end-of-day", r"(?i)\bat the end of the day\b", "day"),
    tell("phrase:that-said", r"(?i)\bthat being said\b", "said"),
    tell("phrase:needless", r"(?i)\bneedless to say\b", "needless"),
    tell("phrase:closer", r"(?im)\b(?:in conclusion|in summary|to sum up|to wrap up|all in all)\b|^\s*overall,", "conclusion summary sum wrap all overall", anchored=True),
    tell("phrase:game-changer", r"(?i)\bgame[- ]?changer\b", "changer gamechanger"),
    tell("phrase:navigate", r"(?i)\bnavigat(?:e|ing) the\b", "navigate navigating"),
    tell("phrase:plays-role", r"(?i)\bplays? a (?:crucial|key|vital|pivotal|significant|central|major) role\b", "role"),
    tell("phrase:more-than", r"(?i)\bmore than just\b", "more"),
    tell("phrase:in-a-world", r"(?i)\bin (?:a|an|today'?s) (?:world|era|age|landscape|climate) where\b", "where"),
    tell("phrase:this-is-where", r"(?i)\b(?:this|that) is where\b[^.\n]*?\b(?:comes? in|shines?)\b", "where"),
    tell("phrase:whether-youre", r"(?i)\bwhether you'?re\b", "whether"),
    tell("phrase:we-will", r"(?i)\bwe'?(?:ll|re going to) (?:explore|discuss|cover|walk through|take a look at|dive into)\b", "explore discuss cover walk take dive"),
    tell("phrase:takeaway", r"(?i)\b(?:key takeaway|the takeaway (?:here|is))\b", "takeaway"),
    tell("phrase:no-denying", r"(?i)\b(?:make no mistake|there'?s no denying|it goes without saying)\b", "mistake denying saying"),
    tell(
        "phrase:not-x-its-y",
        r"(?i)\b(?:it|this|that|they|these|those)(?:'s not|'re not| is not| are not| was not| were not| isn'?t| aren'?t| wasn'?t| weren'?t)\b"
        r"[^.!?\n]{1,80}[.!?]\s+(?:it|this|that|they|these|those)(?:'s|'re| is| are| was| were)\b"
        r"|\b(?-i:It|This|That|They)(?: isn'?t| aren'?t| wasn'?t| is not| was not)\b[^.!?\n]{1,60}\s*(?:,|[—–]|--)\s*(?:it|this|that|they)(?:'s|'re| is| are| was)\b"
        r"|\b(?-i:It)'?s not (?:a|an|the)\b[^.!?\n]{1,60}?\s*(?:,|[—–]|--)\s*it'?s\b"
        r"|\bless about\b[^.!?\n]{1,60}\bmore about\b"
        r"|\b(?:does not|doesn'?t) mean\b[^.!?\n]{1,80}[.!?]\s+it means\b",
        "not isn isnt aren arent wasn wasnt weren werent less mean",
    ),
    tell("phrase:no-x-no-y", r"\bNo [^.!?\n]{1,30}[.!] No [^.!?\n]{1,30}[.!]", "no"),
    tell(
        "phrase:run-up",
        r"(?i)\bhere'?s (?:the thing|the deal|the kicker|the twist|the truth|the reality|why|what you need to know)\b"
        r"|\blet'?s be (?:honest|clear|real)\b|\bthe (?:truth|reality) is\b|(?-i:\b(?:Honestly|Frankly|Seriously)\?|\bLook, )",
        "here heres honest clear real truth reality honestly frankly seriously look",
    ),
    tell(
        "phrase:closer-line",
        r"(?i)\b(?:let that sink in|(?:and )?that changes everything|(?:and )?that'?s the (?:whole |real )?point|that'?s the real (?:win|story|lesson)|the rest is history)[.!]",
        "sink everything point win story lesson history",
    ),
    tell(
        "phrase:borrowed-authority",
        r"(?i)\b(?:experts (?:agree|say|suggest|believe)|studies (?:show|suggest|have shown)|research (?:shows|suggests|has shown)|(?:many|most) experts\b"
        r"|it(?: is|'?s) widely (?:accepted|known|believed|recogni[sz]ed))\b",
        "experts studies research widely",
    ),
    tell(
        "phrase:significance",
        r"(?i)\bmarks? (?:a|an) (?:significant|major|pivotal|important|key|new|historic) (?:milestone|moment|shift|step|chapter|turning point)\b"
        r"|\bthe future (?:looks|is) bright\b|\b(?:an|a) (?:enduring|lasting) legacy\b",
        "mark marks future legacy",
    ),
    tell("phrase:doc-narration", r"(?i)\bthis (?:document|doc|post|article|guide) (?:aims to|will (?:explore|walk|take|cover|discuss|dive))\b", "document doc post article guide"),
    tell("phrase:serves-as", r"(?i)\b(?:serves?|served|serving|stands?|stood|functions|functioned) as (?:a|an|the)\b", "serve serves served serving stand stands stood functions functioned"),
    tell(
        "phrase:ing-tail",
        r"(?i)(?:,\s+|\s*[—–]\s*)(?:highlighting|underscoring|reflecting|ensuring|emphasi[sz]ing|symboli[sz]ing|signall?ing|demonstrating|illustrating|cementing|solidifying"
        r"|reinforcing|contributing to|paving the way|setting the stage|marking (?:a|an|the) (?:\w+ )?(?:(?:end|start|beginning|close|completion|culmination|debut|arrival|return|launch) of"
        r"|milestone|moment|shift|chapter|turning point|era|first time)|making it (?:easier|harder|possible|ideal|clear))\b",
        "highlighting underscoring reflecting ensuring emphasizing emphasising symbolizing symbolising signaling signalling demonstrating illustrating cementing "
        "solidifying reinforcing contributing paving setting marking making",
    ),
    tell("chat:preamble", r"(?mi)^\s*(?:certainly|absolutely|sure|of course|great question)[!,.]", "certainly absolutely sure course question", anchored=True),
    tell("chat:hope-helps", r"(?i)\bi hope this helps\b", "hope"),
    tell("chat:feel-free", r"(?i)\bfeel free to\b", "feel"),
    tell("chat:let-me-know", r"(?i)\blet me know if\b", "know"),
    tell("chat:happy-to", r"(?i)\bi'?d be happy to\b", "happy"),
    tell("chat:sycophancy", r"(?i)\byou'?re (?:absolutely|completely|totally) right\b", "right"),
    tell("chat:offer", r"(?i)\bwould you like me to\b", "would"),
    tell(
        "chat:knowledge-limit",
        r"(?i)\bas of my (?:last|latest) (?:update|knowledge update|training)\b|\bmy (?:knowledge|training) (?:cutoff|cut-off)\b|\bi (?:don'?t|do not) have (?:access to )?real-time\b",
        "update training knowledge real",
    ),
    tell("chat:as-an-ai", r"(?i)\bas an ai(?:,|\s+(?:language model|model|assistant))", "ai"),
    tell("chat:heres-summary", r"(?i)\bhere'?s (?:a|the) (?:quick )?(?:breakdown|rundown|summary|overview)\b", "breakdown rundown summary overview"),
    tell(
        "heading:title-case",
        r"(?m)^#{1,6}(?:[ \t]+(?:a|an|and|as|at|but|by|for|in|of|on|or|the|to|vs|with|[A-Z][A-Z0-9&-]+))*"
        r"(?:[ \t]+[A-Z][a-z][\w'’-]*(?:[ \t]+(?:a|an|and|as|at|but|by|for|in|of|on|or|the|to|vs|with|[A-Z][A-Z0-9&-]+))*){3,}[ \t]*$",
        "#",
        anchored=True,
    ),
    tell("heading:emoji", "(?m)^#{1,6}[ \\t]+[^\\n]*[\U0001f300-\U0001faff\u2600-\u27bf]", "#", anchored=True),
    said("hedge:filler", "very, really, quite, just, actually, basically, essentially, simply, truly, literally, definitely, arguably, certainly, clearly, obviously, somewhat"),
    tell("hedge:the-fact", r"(?i)\bthe fact that\b", "fact"),
)


def clutter(name: str, phrases: str, word: str) -> Rule:
    listed = [p.strip() for p in phrases.split(",")]
    return Rule(f"clutter:{name}", phrase_pattern(listed), "clutter", action=("word", word), triggers=phrase_triggers(listed))


def shorter(name: str, pattern: str, triggers: str, template: str = r"\1") -> Rule:
    return Rule(f"clutter:{name}", r"(?i)\b" + pattern + r"\b", "clutter", action=("keep", template), triggers=frozenset(triggers.split()))


def throat(name: str, phrases: str) -> Rule:
    """A phrase that means nothing with the next word's first letter, and what stands before that letter."""
    listed = [p.strip() for p in phrases.split(",")]
    body = "|".join(p.replace("'", QUOTE).replace(" ", r"\s+") for p in listed)
    return Rule(f"padding:{name}", r"(?i)\b(?:" + body + r")\s*,?\s+([^\w\s]*)(\w)", "clutter", action=("drop", ""), triggers=phrase_triggers(listed))


CLUTTER: tuple[Rule, ...] = (
    clutter("because", "due to the fact that, owing to the fact that, on account of the fact that, for the reason that, in view of the fact that", "because"),
    clutter("although", "despite the fact that, in spite of the fact that, regardless of the fact that, notwithstanding the fact that", "although"),
    clutter("if", "in the event that, in the eventuality that", "if"),
    clutter("so-that", "in order that", "so that"),
    clutter("whether", "the question as to whether, whether or not", "whether"),
    clutter("now", "at this point in time, at the present time, at this moment in time", "now"),
    clutter("soon", "in the near future, at an early date", "soon"),
    clutter("before", "prior to, in advance of, previous to", "before"),
    clutter("after", "subsequent to, following on from", "after"),
    clutter("during", "during the course of, in the course of", "during"),
    clutter("period", "period of time", "period"),
    shorter("basis", r"on\s+a\s+(daily|weekly|monthly|quarterly|yearly)\s+basis", "basis"),
    clutter("regularly", "on a regular basis", "regularly"),
    clutter("few", "few in number", "few"),
    clutter("enough", "a sufficient number of, sufficient quantities of", "enough"),
    clutter("in", "in the field of, in the area of", "in"),
    clutter("every", "each and every", "every"),
    clutter("first", "first and foremost", "first"),
    # Only a word that ends in "ing" has this one plain form.
    shorter("purposes", r"for\s+([a-z]*ing)\s+purposes", "purposes", r"for \1"),
    clutter("currently", "as of the current time, as things currently stand", "now"),
    shorter("outcome", r"(?:final|end)\s+(outcomes?)", "outcome outcomes"),
    shorter("history", r"past\s+(histor(?:y|ies))", "past"),
    shorter("plans", r"future\s+(plans?)", "future"),
    shorter("revert", r"(revert\w*)\s+back", "back"),
    shorter("plan", r"(plan|plans|planned|planning)\s+ahead(?:\s+in\s+advance)?", "ahead"),
    shorter("planning", r"advance\s+(planning)", "advance"),
    shorter("together", r"(combine[sd]?|combining|collaborate[sd]?|collaborating|merge[sd]?|merging|join|joined|joining|grouped|grouping)\s+together", "together"),
    shorter("essential", r"absolutely\s+(essential)", "absolutely"),
    shorter("eliminate", r"completely\s+(eliminat\w+)", "completely"),
    clutter("near", "in close proximity to, in proximity to", "near"),
    shorter("innovation", r"new\s+(innovations?)", "new"),
    shorter("bonus", r"added\s+(bonus(?:es)?)", "added"),
    shorter("summary", r"brief\s+(summar(?:y|ies))", "brief"),
    shorter("fundamentals", r"basic\s+(fundamentals)", "basic"),
    throat("note", "it should be noted that, it is important to note that, it'?s important to note that, it is worth noting that, it'?s worth noting that, it is worth mentioning that, it goes without saying that"),
    throat("fact", "as a matter of fact, in point of fact, the fact of the matter is that, needless to say"),
    throat("ultimately", "when all is said and done, for all intents and purposes"),
)

BE = "am is are was were be been being get gets got getting"
IRREGULAR = (
    "given taken seen done made held kept sent built brought bought caught taught told sold found left lost met paid put read set shown known written driven "
    "chosen broken spoken frozen hidden ridden risen fallen forgotten begun drawn thrown grown flown blown worn torn sworn dealt felt meant spent slept swept "
    "cut hit let shut split spread cost hurt bound led fed bred sat stood understood withheld undertaken overseen overwritten rewritten reset misconfigured"
)
PASSIVE = rf"(?i)\b(?:{'|'.join(BE.split())})\s+(?:\w+ly\s+)?(?:\w+ed|{'|'.join(IRREGULAR.split())})\b"


def hard(name: str, pattern: str, triggers: str, hint: str) -> Rule:
    return Rule(name, either_quote(pattern), "complexity", hint, triggers=frozenset(triggers.split()))


def wordy(name: str, phrases: str, hint: str, triggers: str = "") -> Rule:
    listed = [p.strip() for p in phrases.split(",")]
    return Rule(name, phrase_pattern(listed), "complexity", hint, triggers=frozenset(triggers.split()) or phrase_triggers(listed))


COMPLEXITY: tuple[Rule, ...] = (
    hard("passive", PASSIVE, BE, 'passive voice: name the actor and use an active verb ("the value was cached" -> "the platform caches the value")'),
    hard(
        "nominalisation", r"(?i)\b(?:the|a|an)\s+(\w+(?:tion|sion|ment|ance|ence|ency|ancy|ity|ness|al))\s+of\b", "of",
        'buried verb: turn the noun back into a verb ("the migration of the chargers" -> "migrating the chargers")',
    ),
    wordy(
        "audience-briefing",
        "as you (?:know|are aware|will know|may know), as we (?:all )?know, for context, by way of (?:background|context), for those unfamiliar, to recap, as a reminder, "
        "remember that, bear in mind that, note that, just to be clear, to be clear",
        "briefing a reader who already knows: cut the sentence. Spend the line on what is new to them",
    ),
    hard(
        "benefit-pitch",
        r"(?i)\b(?:what (?:it|this) (?:unlocks|enables|gives us|allows|means)|the benefits?(?: (?:are|is|of this))?|this (?:would )?(?:allow|enable|let)s? (?:us|you|them|operators?)"
        r"|this means (?:you|we|they) (?:can|could|would)|why this matters|the value (?:here )?is)\b",
        "what benefit benefits this value", "selling the benefit: state the problem and the ask, and let the reader draw the value. They can",
    ),
    hard(
        "definition", r"(?<![\w'’])(?:A|An)\s+\w+(?:\s+\w+){0,2}\s+(?:is|are)\s+(?:a|an)\s+\w+", "a an",
        "defining a term for its owner: cut it unless the reader genuinely cannot know it (a customer's own setup, not your product's)",
    ),
    hard(
        "there-is", r"(?<![\w'’])[Tt]here\s+(?:is|are|was|were)\b", "there",
        'expletive opener: start with the real subject ("there are three tenants affected" -> "three tenants are affected")',
    ),
    hard("it-is-that", r"(?i)\bit\s+(?:is|was)\s+(?:\w+\s+)?that\b", "it", "delayed subject: say who does what"),
    wordy(
        "ability-to",
        "has the ability to, have the ability to, had the ability to, has the capability to, have the capability to, had the capability to, is in a position to, are in a position to, "
        "was in a position to, were in a position to",
        'say "can" or "could"; after a modal or "to" say "be able to" ("users will be able to export", never "will can")',
    ),
    wordy("majority-of", "the majority of, a majority of", 'usually "most": "most users", but "most of the users" and "most of what we sell"; a margin ("a majority of 3") stays'),
    wordy("at-this-time", "at this time", '"now" if it means now; leave it when it is a time ("at this time of year", "at this time in 2025")'),
    hard("end-result", r"(?i)\bend\s+results?\b", "end", 'usually just "result"; keep "end" in "front end", "dead end" and "in the end"'),
    wordy(
        "in-terms-of",
        "in terms of, with regard to, with respect to, as regards, in relation to, from the perspective of, in the context of, in connection with",
        'context-dependent clutter: usually "for", "about", or nothing',
    ),
    wordy("for-the-purpose", "for the purposes? of, with the aim of, with a view to, with the intention of", 'collapse to "to" + verb ("for the purpose of testing" -> "to test")'),
    wordy("in-the-process", "in the process of, is currently in the process of", 'cut it: "we\'re in the process of migrating" -> "we\'re migrating"'),
    wordy("vague-quantity", "a number of, a variety of, a range of, a series of, an array of, multiple", 'give the number, or say "several"/"most"'),
    hard("in-a-manner", r"(?i)\bin\s+a\s+\w+\s+(?:manner|fashion|way)\b", "manner fashion way", "collapse to an adverb or a plainer verb"),
    wordy(
        "abstraction",
        "functionality, capability, capabilities, configurability, optimisation, optimization, alignment, visibility, granularity, orchestration, enablement, utilisation, utilization, "
        "scalability, operationalise, operationalize, solutioning, learnings, touchpoint, touchpoints, bandwidth, ecosystem, workstream",
        "abstract noun: name the concrete thing or the actual behaviour",
    ),
    wordy(
        "long-word",
        "commence, terminate, endeavour, endeavor, facilitate, necessitate, ascertain, demonstrate, implement, initiate, sufficient, additional, numerous, approximately, subsequently, "
        "consequently, furthermore, moreover, nevertheless, accordingly, aforementioned, methodology, individuals, purchase, assist, attempt, obtain, require, remainder, component, "
        "modification, notification, identification, verification, prioritise, prioritize, incentivise, incentivize",
        "short word available: start/end/try/help/do/get/need/change/tell/check/about/so/also/but",
    ),
    hard(
        "padding",
        r"(?i)\b(?:very|really|quite|rather(?!\s+than\b)|somewhat|fairly|actually|basically|essentially|literally|simply|just|truly|certainly|definitely|absolutely|obviously|clearly"
        r"|sort\s+of|kind\s+of|a\s+bit|pretty\s+much|in\s+general|generally\s+speaking|as\s+such|that\s+said)\b",
        "very really quite rather somewhat fairly actually basically essentially literally simply just truly certainly definitely absolutely obviously clearly sort kind bit pretty general "
        "generally such said",
        'filler: delete it. Keep only if load-bearing ("just"/"simply" meaning "only", a real contrast in "that said")',
    ),
    wordy(
        "hedge-stack",
        "it (?:may|might|could) be (?:the case )?that, it would (?:appear|seem) that, there is a possibility that, we (?:would|might) potentially",
        "take a position or state the uncertainty in one plain clause",
        "may might could would possibility potentially",
    ),
)
SAME_OPENING = "complexity:same-opening"
SAME_OPENING_HINT = "sentences in a row open with the same word: vary them, or merge them"

#: Typography: (name, pattern, replacement), in order. Lookarounds see one prose span.
TYPOGRAPHY: tuple[tuple[str, str, str], ...] = (
    ("crlf", r"\r\n?", "\n"),
    ("zero_width", "[\u200b\u200c\u200d\ufeff]", ""),
    ("nbsp", "[\u00a0\u202f\u2007]", " "),
    ("curly_double", "[“”„‟]", '"'),
    ("curly_single", "[‘’‚‛]", "'"),
    ("ellipsis", "…", "..."),
    ("endash_range", r"(?<=\d)(?:\s+–\s*|–\s+)(?=\d)", "–"),
    ("endash_clause", r"\s+–\s*|\s*–\s+", ", "),
    ("em_dash", r"\s*—\s*", ", "),
    ("double_hyphen", r"[ \t]+--[ \t]+", ", "),
    ("in_order_to", r"(?i)\bin order to\b", "to"),
    ("comma_at_bol", r"\n[ \t]*,[ \t]*", "\n"),
    ("space_comma", r"[ \t]+,", ","),
    ("double_comma", r",(?:[ \t]*,)+", ","),
    ("comma_stop", r",[ \t]*([.;:!?])", r"\1"),
    ("run_spaces", r"(?<=\S)[ \t]{2,}(?=\S)", " "),
    ("trailing_ws", r"[ \t]+\n", "\n"),
)

# Connectives, in the order in which they take their place.
JOINTS: tuple[tuple[str, str], ...] = (
    ("cause", "which means|this means|that means|which is why|that's why|that is why|as a result|so that|in turn|due to|owing to|because of|it follows that"),
    ("cause", "because|therefore|thus|hence|consequently|thereby"),
    ("cause", "since"),
    ("cause", "so"),
    ("contrast", "even so|on the other hand|even though"),
    ("contrast", "but|however|although|though|whereas|whilst|while|instead|unlike|nevertheless|nonetheless|yet"),
    ("condition", "only when|provided that|as long as|unless|until|if|once"),
)
# Of connectives that may be something else: what has to stand before and after, in one of these ways. Before is searched in
# the last characters before the word, without the blanks next to it; after is matched on what follows. Case is ignored.
_OPENS = r"(?:\A|[,.;:!?])\z"
_SO_IS_NOT = r"(?!-)(?!\s+(?:far|many|much|few|little|long|on|forth|to speak|what|very|too)\b)"
_SO_SUBJECT = (
    r"\s+(?:i|we|you|they|he|she|it|its|the|a|an|this|that|these|those|there|our|your|their|his|her|my|every|each|no|nothing|everyone|people|readers?)\b"
)
_TIME = r"\s+(?:\d|then\b|last\b|yesterday\b|january|february|march|april|may\b|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
CONNECTIVE_GUARDS: dict[str, tuple[tuple[str, str], ...]] = {
    "so": ((_OPENS, _SO_IS_NOT), (r"(?<! or)\z", _SO_IS_NOT + _SO_SUBJECT)),
    "since": ((r"\z", rf"(?!{_TIME})"),),
    "once": ((_OPENS, ""), (r" and\z", "")),
    "but": ((r"(?<!(?:\A| )(?:all|nothing|anything|none|everything|everyone))\z", ""),),
    "while": ((r"(?<!(?:\A| )a)(?<!worth)\z", ""),),
    "yet": ((r"(?<!not)(?<!as)\z", r"(?!\s*another)"),),
}
#: Characters that are looked at before and after a connective.
GUARD_BEFORE, GUARD_AFTER = 24, 48

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()
PROMISE = (
    r"(?i)\b(?:has|have|had|takes?|comes? in|falls? into|needs?|in|are|of)\s+(two|three|four|five|six|seven|eight|nine|ten|[2-9]|1[0-9])\s+(?:main\s+|key\s+|separate\s+|distinct\s+)?"
    r"(parts|steps|stages|reasons|ways|components|elements|kinds|types|phases|rules|principles|questions|regimes|outcomes|needs|moves|pieces|layers|levels|jobs|forces|ingredients|conditions)\b"
)
LIST_ITEM = r"(?m)^\s{0,3}(?:[-*+]|\d+[.)])\s+(\S.*)$"
ORDINAL_OPENER = r"(?i)^\s*(?:first(?:ly)?|second(?:ly)?|third(?:ly)?|fourth|fifth|sixth|seventh|eighth|ninth|tenth|finally|lastly)\b"
LIST_SEPARATOR = r"\s*(?:,|;|\band\b|\bor\b)\s*"
ARTICLE = r"(?i)^(?:a|an|the|and|or)\s+"
BOLD = r"\*\*([^*\n]+)\*\*"
DEFINITION = r"(?i)\b(?:is called|are called|we call|i call|known as|refers to|is defined as|stands for|in other words|what i mean by|by (?:this|that) i mean|that is,|i\.e\.)"
ANTICIPATION = (
    r"(?i)\b(?:you (?:might|may|could) (?:have noticed|(?:be )?(?:wonder|ask|think|expect|object)(?:ing)?)|it'?s tempting to|it is tempting to|at first (?:sight|glance)|the catch is"
    r"|here'?s (?:the problem|the catch)|you don'?t need .{0,40} yet|which raises the question)|(?:^|[.!?]\s+)(?:so|but) why\b"
)
STOP_WORDS = frozenset(
    "the and that this with from have has had are was were for not but its it's they them their there then than what when which who will would can could should into onto our your you she "
    "his her all any each been being does did just only also very more most some such because since while until unless though although however therefore thus hence".split()
)

MONTH = r"jan(?:uary)?|feb(?:ruary)?|(?-i:Mar(?:ch)?)|apr(?:il)?|(?-i:May)|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATE = (
    r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}(?:st|nd|rd|th)?\s+(?:MONTH)\b\.?(?:\s+\d{4})?|(?:MONTH)\b\.?\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?"
    r"|(?:MONTH)\b\.?\s+\d{4}|q[1-4]\s+\d{4}|h[12]\s+\d{4})\b"
).replace("MONTH", MONTH)
NUMBER = r"\d[\d,]*(?:\.\d+)*"
CURRENCY = "£$€"
UNIT = r"[ \t]?(?:%|kWh|kW|MWh|MW|GW|kVA|V|A|km|m|ms|s|h|GB|MB|TB|x|p|k|bn|million|billion)\b|%"
CODE_SPAN = r"`([^`\n]+)`"
LIST_MARKER = r"(?m)^[ \t]*\d+[.)][ \t]"
ORDINAL = r"(?i)(\d)(?:st|nd|rd|th)\b"

# An acronym: two capitals, or a capital first and a digit; never two small letters in a row. Where one may stand.
ACRONYM = r"(?!.*[a-z]{2})(?:(?=(?:.*[A-Z]){2})[a-z]?|(?=[A-Z].*\d))[A-Z][A-Za-z0-9&]*[A-Z0-9]"
ACRONYM_TOKEN = r"(?<![\w/.\-&])[A-Za-z0-9&]++(?![\w\-])"
NOT_PROSE = (r"\]\([^)\n]*\)", r"<[^>\n]+>")
# How a sentence explains an acronym: what ends before it, what follows it (and its plural s), or what stands anywhere.
EXPLAINED: tuple[tuple[str, str, str, str], ...] = (
    ("bracketed", r"\z", r"\s*\(", ""),
    ("in_brackets", "", "", r"\(\s*ACRONYMs?\s*\)"),
    ("gloss", r"(?<!,\s+(?:(?:a|an|the|her|his|its|their|our|your)\s+)?)\z", r",\s+(?:the|a|an)\s", ""),
    ("is_a", r"(?i)\A\s*(?:(?:the|a|an)\s+)?\z", r"\s+(?:is|are)\s+(?:the|a|an)\s", ""),
    ("definition", "", "", DEFINITION),
)
GLOSSARY_LINE = r"(?m)^\*\*([^*\n]+)\*\*:[ \t]*([^\n]*)"
BRACKETED = r"\((?:[^()]++|(?R))*+(?:\)|\z)"
EXPANSION_END = r"(?<=[a-z0-9)])\.(?=\s|\z)"
UNIVERSAL = frozenset("UK US USA EU GB ID PIN QR SIM USB URL GPS LED LCD TV PC PDF FAQ AI VAT ATM AM PM CEO AC DC MW GW MWh GWh TWh".split())
GAP_HINT = "Spell it out, or say what it is, the first time you use it."

SECTIONS = ("Context", "Insight Description", "Significance", "Customer Details")
SIGNIFICANCE = r"(?m)^\s*(Low|Medium|High|Critical)\s*$"
CODE_REFERENCES: tuple[tuple[str, str], ...] = (
    (r"\b[\w/.-]+\.(?:php|py|ts|tsx|js|go|rb|java|kt|yaml|yml)\b(?::\d+(?:-\d+)?)?", "source file path"),
    (r"\b\w+::\w+", "class/static reference"),
    (r"\$\w+->\w+", "object property access"),
)
ESTATE = r"charge\s*points?|chargers?|connectors?|EVSEs?|sites?|locations?|terminals?|sessions?|users?|drivers?|vehicles?|units?"
CUSTOMER_FIGURES: tuple[tuple[str, str], ...] = (
    (r"(?i)\b\d{1,3}(?:,\d{3})+\s+(?:\w+\s+){0,2}(?:ESTATE)\b".replace("ESTATE", ESTATE), "customer estate size"),
    (r"(?i)\b[1-9]\d{3,}\s+(?:\w+\s+){0,2}(?:ESTATE)\b".replace("ESTATE", ESTATE), "customer estate size"),
    (r"(?i)\b(?:ESTATE)\b[^.\n]{0,12}?\b\d{1,3}(?:,\d{3})+\b".replace("ESTATE", ESTATE), "customer estate size"),
    (r"(?i)(?:[£€$]|\b(?:EUR|GBP|USD)\s)\s?\d[\d,.]*\s*[km]?\b", "contract or revenue figure"),
    (r"\b\d{1,3}(?:\.\d+)?\s?%\s+of\s+(?:their|the customer|[A-Z][\w']+'s)\b", "share of the customer's business"),
)
LIMIT_WORDS = r"(?i)\b(?:up to|at most|maximum|max|minimum|min|limit(?:ed|s)? to|cap(?:ped|s)? at|no more than|per call|per operation|per request|per batch|page size|hard limit|rate limit)\b"

#: American endings and their British forms; the Oxford ones apply to any word with three letters before them.
OXFORD_ENDINGS = (
    ("izations", "isations"), ("ization", "isation"), ("izing", "ising"), ("izers", "isers"), ("izer", "iser"), ("izes", "ises"), ("ized", "ised"), ("ize", "ise"), ("yzing", "ysing"), ("yzes", "yses"), ("yzed", "ysed"), ("yze", "yse"),
)
OTHER_ENDINGS = (
    ("orites", "ourites"), ("orite", "ourite"), ("orful", "ourful"), ("oring", "ouring"), ("ored", "oured"), ("ors", "ours"), ("or", "our"), ("ering", "ring"), ("ered", "red"), ("ers", "res"), ("er", "re"), ("elers", "ellers"), ("eler", "eller"), ("eling", "elling"), ("eled", "elled"), ("ogs", "ogues"), ("og", "ogue"),
)
OXFORD_MIN_STEM = 3

# ---- End of the fixed values. ----
