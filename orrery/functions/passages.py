"""What a passage of a filing says about a counterparty, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations whose full stop ends no sentence (fixed values).
ABBREVIATIONS = ("Inc.", "Corp.", "Ltd.", "Co.", "U.S.")
#: Cues of each relation, in order of precedence (fixed values).
CUES = {
    "competitor": ("compet",),
    "corporate_action": ("acqui", "sale of"),
    "reversed": ("supplier", "supplied by"),
    "customer": ("customer", "accounted for", "sales to", "represented"),
}
#: Language that marks a customer, a competitor and a supplier near a name (fixed values).
CUSTOMER = (
    r"(?i)\b(our (?:largest |key |significant |principal |end )?customer|end customer|customers include|sales to|revenue from|"
    r"accounted for [^.]{0,40}(?:of (?:our )?(?:net |total )?(?:revenue|sales))|represented [^.]{0,40}(?:of (?:our )?(?:net |total )?(?:revenue|sales)))"
)
COMPETITOR = r"(?i)\b(compet\w+|rival|alternative to|substitutes?)\b"
SUPPLIER = r"(?i)\b(supplier|foundry|we purchase|we source|vendor|manufactured (?:for|by) us|contract manufacturer)\b"

#: Where a sentence ends for quoting: not behind these abbreviations or a single capital, and before a capital, quote or bracket (fixed values).
QUOTE_END = r"(?<!\bInc|\bCorp|\bLtd|\bCo|\bNo|\bU\.S|\s[A-Z])\.\s+(?=[A-Z(\"])"
#: A percentage that is quoted: none that only bounds a share from below (fixed values).
QUOTE_SHARE = r"(\d{1,3}(?:\.\d)?)\s?%(?!\s*(?i:or\s+(?:more|greater|higher)))"


def sentences(passage: Column) -> Column:
    """Sentences of a passage, as an array; abbreviations don't end one."""
    kept = "".join(rf"(?<!{re.escape(a)})" for a in ABBREVIATIONS)
    return F.split(passage, rf"(?<=[.!?]){kept}\s+")


def disclosure(passage: Column, party: Column) -> Column:
    """(says, pct): the first sentence with the party's first word, and the first share in it that isn't a lower bound; null without either."""
    word = F.regexp_replace(F.regexp_extract(party, r"(\S+)", 1), r"^[,.]+|[,.]+$", "")
    says = F.when(word != "", F.get(F.filter(F.split(passage, QUOTE_END), lambda s: F.contains(s, word)), F.lit(0)))
    pct = F.regexp_extract(says, QUOTE_SHARE, 1)
    return F.struct(F.trim(says).alias("says"), F.when(pct != "", pct).alias("pct"))


def naming_sentence(passage: Column, party: Column) -> Column:
    """The first sentence with the party's first word; null if there is none, or either is blank."""
    token = F.regexp_extract(party, r"(\S+)", 1)
    pattern = F.concat(F.lit(r"(?U)\b\Q"), token, F.lit(r"\E\b"))
    return F.when(token != "", F.get(F.filter(sentences(passage), lambda s: F.regexp_like(s, pattern)), F.lit(0)))


def relation(sentence: Column) -> Column:
    """The relation that a naming sentence states: the first cue in order of precedence."""
    low = F.lower(sentence)
    out = F.when(sentence.isNull(), "unnamed")
    for name, cues in CUES.items():
        hit = F.lit(False)
        for cue in cues:
            hit = hit | low.contains(cue)
        out = out.when(hit, name)
    return out.otherwise("unstated")


#: Percentages, tags and entities as passages have them (fixed values).
PERCENTAGE, TAG, ENTITY = r"(\d+(?:\.\d+)?)%", r"<[^>]+>", r"&#\d+;|&[a-z]+;"


def percentage(sentence: Column) -> Column:
    """The first percentage in a sentence, as written; null without one."""
    p = F.regexp_extract(sentence, PERCENTAGE, 1)
    return F.when(p != "", p)


def proximity_label(window: Column, at: Column, radius: int = 120) -> Column:
    """customer if the window says so and no competitor or supplier is spoken of within ``radius`` of the name at ``at`` (from 0)."""
    start = F.greatest(at - radius, F.lit(0))
    near = F.substring(window, start + 1, at + radius - start)
    return F.when(near.rlike(COMPETITOR) | near.rlike(SUPPLIER), "unknown").when(window.rlike(CUSTOMER), "customer").otherwise("unknown")


def clean_html(html: Column) -> Column:
    """Text without tags and entities, white space as single spaces."""
    t = F.regexp_replace(html, TAG, " ")
    return F.regexp_replace(F.regexp_replace(t, ENTITY, " "), r"\s+", " ")


def quotable(sentence: Column) -> Column:
    """Whether a sentence begins with a capital."""
    return F.coalesce(sentence.rlike(r"^\p{Lu}"), F.lit(False))


#: What may follow a company's short name, to tell it from a common word (fixed values).
DESIGNATOR = r"^[\s,.]{0,3}(Inc|Corp|Corporation|Company|Co\b|Ltd|Limited|plc|PLC|LLC|Holdings|Technologies|Technology|Systems|Semiconductor|Group|N\.V|S\.A|AG|SE)\b"


def designated(after: Column) -> Column:
    """Whether the text right behind a name begins with a designator."""
    return F.coalesce(after.rlike(DESIGNATOR), F.lit(False))
