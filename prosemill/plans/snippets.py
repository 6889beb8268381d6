"""Sentences that fire the rules, and near misses, added to documents so that queries over invented prose have rows.

No snippet holds a quotation, so that SQL without one's scan gives the same rewrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.functions.dialect import sql_text

TELLS = (
    "We delve into a tapestry of robust tools. The velocity stays.",
    "It's not just fast, and I think it's cheap. It is not just so.",
    "It's not about speed; it's about care.",
    "They not only ship but also mend. Let's dive into the code and dive deeper.",
    "In today's fast-paced market it's worth noting that prices move.",
    "When it comes to rain, at the end of the day we wait. That being said, needless to say it pours.",
    "In conclusion, this game-changer helps us navigate the market. It plays a key role, more than just a part.",
    "In a world where tools talk, this is where the hinge comes in.",
    "Whether you're new or old, we'll explore the town. The takeaway here is rest; make no mistake.",
    "This isn't a toy. It's a tool. It isn't ready, it's late.",
    "No guesswork. No spreadsheets. Just answers.",
    "Here's the thing: the truth is plain. Let that sink in.",
    "Experts agree that studies show gains. It marks a major milestone, an enduring legacy.",
    "This document aims to help. It serves as a guide, ensuring calm.",
    "Certainly! I hope this helps. Feel free to ask and let me know if it fails. I'd be happy to.",
    "You're absolutely right. Would you like me to go on? As of my last update, my knowledge cutoff holds.",
    "As an AI language model I wait. Here's a quick summary.",
    "# The Great Big Heading Of Words\n\nSomething very plain, really.",
    "The fact that it rains is arguably, somewhat, quite clear.",
    "The landscapes were nuance and vitality, with justice.",
)
HARD = (
    "The value was cached and the door is quickly closed. He got taken in.",
    "The migration of the chargers is a statement of the obvious.",
    "As you know, for context, note that it rains. To be clear, it pours.",
    "This would allow us to wait. Why this matters: the benefits are many.",
    "A hinge is a part. An old brass hinge is a thing.",
    "There are three parts. Therein lies one. It is clear that it fits.",
    "It has the ability to turn. The majority of doors do, at this time, with an end result.",
    "In terms of cost and with a view to saving, we are in the process of moving.",
    "A number of doors open in a quiet manner. Multiple keys fit.",
    "The functionality and the ecosystem need alignment; we facilitate and utilise numerous methods.",
    "It is rather dark, rather than light. It is just a bit late, sort of.",
    "It may be that it would appear that doors open. There is a possibility that they shut.",
    "We open doors. We shut doors. We paint doors. They dry.",
)
CLUTTER = (
    "Due to the fact that it rains we wait. Despite the fact that it is dry we go.",
    "In the event that it stops, in order that we see, whether or not we look.",
    "At this point in time we act; in the near future we rest. Prior to lunch, subsequent to tea, during the course of the day.",
    "It took a period of time, on a daily basis, on a regular basis.",
    "Few in number, a sufficient number of doors, in the field of hinges.",
    "Each and every door, first and foremost, for testing purposes and for other purposes.",
    "The final outcome and past history of future plans. Revert back and plan ahead in advance.",
    "Advance planning joined together an absolutely essential and completely eliminated part.",
    "As of the current time we wait, and as things currently stand we rest.",
    "In close proximity to a new innovation, an added bonus, a brief summary of basic fundamentals.",
)
TYPOGRAPHY = (
    "The doors\u200b open\u00a0wide \u2014 and shut. Pages 3 \u2013 5 \u2013 7 stay.",
    "The rain \u2013 it falls \u2013 stops\u2026 and -- so we hope -- ends.",
    "In order to go , we wait,, then , . leave.  Two  spaces.",
    "We go in order to see.   \nTrailing blanks stay out.\u2009 End.\n, leading comma",
    "It\u2019s a London\u2013Paris run, Mon\u2013Fri.",
)
FACTS = (
    "It cost \u00a318,000 in Q3 2025, or 4.5 kW for 6 weeks.",
    "On 14 October 2026 and 2026-10-15, version v2 had 22 kW.",
    "1. First item of 12\n2. Second item of 1,250.5 sites",
)
INSIGHTS = (
    "Context: a\n\nInsight Description: b\n\nSignificance\n\nHigh\n\nCustomer Details: c",
    "Context only, see src/app.py:12 and Foo::bar\n\nLow\n\nHigh",
    "Insight description: $this->that in main.rs. Significance: none",
    "Context: an estate of 1,200 charge points\n\nTheir sites number 4,500, and 4500 happy drivers pay EUR 3.2m for it. Later in the text: EUR 3.2M again, and 40 % of their bill.",
    "A page may hold up to 5,000 sessions per call, says a.py, b.py, c.go, d.rb and x::y. Far from every such word, the team then counted 5,000  sessions, 7% of Acme's.",
)
GAPS = (
    "The CPO runs it. The OCPP (Open Charge Point Protocol) talks.",
    "An EVSE is the part that charges. Many CPOs use a DNO.",
    "Nothing here is an acronym but the UK.",
    "A G99 form, the network's approval, and the CSMS.",
)
GLOSSARY = (
    "**CPO**: Charge Point Operator. Owns sites.\n**DNO list**: the networks (e.g. north. south) of a country\n**Empty**:",
    "**kWh**: a unit of energy.\nNo **headword** here: none.",
)
EXPLAINING = (
    "The boiler heats the water, so the sensor learns late. It learns late because the pipe is long, which means the room is warm first. If it is cold, wait.",
    "The gate has three parts: a key, a lock and a hinge. The key turns, so the lock holds, but the hinge swings.",
    "It takes two steps.\n\n- open the door\n- shut the door",
    "Due to the fact that it rains, it should be noted that we wait. It is very, really wet.",
    "You might wonder why. But why wait? The catch is the rain, that is, what is known as drizzle; it needs 4 separate conditions and 12 rules.",
    "It has rained since then, since the wind turned. Once it stops, we go, and once is enough; twice or once. All but one left, but not yet: it is worth while, yet another day, while a while passes. So far so good, so to speak, or so they say, so we wait. Even so, because of it we wait until noon.",
)


def injected(docs: DataFrame, snippets: tuple[str, ...]) -> DataFrame:
    """Every document with a snippet after a blank line, by its id in turn."""
    chosen = F.get(F.array(*[F.lit(s) for s in snippets]), F.pmod(F.col("doc_id"), F.lit(len(snippets))).cast("int"))
    return docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), chosen))


def injected_sql(snippets: tuple[str, ...]) -> str:
    """The same as a DuckDB query with doc_id, lang, source and text."""
    return f"SELECT doc_id, lang, source, coalesce(text, '') || chr(10) || chr(10) || [{', '.join(map(sql_text, snippets))}][doc_id % {len(snippets)} + 1] AS text FROM documents"
