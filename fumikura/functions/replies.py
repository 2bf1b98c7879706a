"""Prompts for a judge and the reading of its replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import settings
from .variants import field, is_json, is_kind
from .words import _col

PARSE_ERROR = "JSON Parse Error"
CALL_ERROR = "API Error: "

# Wording is ours; only the three slots and the two reply keys matter.
PROMPT = (
    "Decide whether the catalogue record below describes notation written to be performed.\n"
    "Answer true if the record makes it certain, false if the record rules it out, "
    "null if the record does not tell.\n"
    "Title: {title}\n"
    "Label: {label}\n"
    "Notes: {description}\n"
    'Reply with one JSON object holding the keys "is_score" and "reason".'
)


def prompt(title: Column, label: Column, description: Column, template: str = PROMPT) -> Column:
    """Fill the three slots of a template; values are not expanded again."""
    slots = {"{title}": title, "{label}": label, "{description}": description}
    pieces, rest = [], template
    while rest:
        found = [(rest.index(s), s) for s in slots if s in rest]
        if not found:
            break
        at, slot = min(found)
        pieces += [F.lit(rest[:at]), F.coalesce(slots[slot].cast("string"), F.lit(""))]
        rest = rest[at + len(slot):]
    return F.concat(*pieces, F.lit(rest))


def parsed_reply(reply: Column | str) -> Column:
    """The reply as JSON, else its braced block as JSON, else NULL."""
    block = F.nullif(F.regexp_extract(reply, settings.BRACED_BLOCK, 0), F.lit(""))
    return F.coalesce(
        F.when(is_json(reply), F.try_parse_json(reply)), F.when(is_json(block), F.try_parse_json(block))
    )


def reply_failure(reply: Column | str, parsed: Column) -> Column:
    """Reason to store when a reply cannot be used, NULL when it can."""
    braced = _col(reply).rlike(settings.BRACED_BLOCK)
    return (
        F.when(_col(reply).isNull(), F.lit(CALL_ERROR + "no reply"))
        .when(parsed.isNull() & braced, F.lit(CALL_ERROR + "braced block is not JSON"))
        .when(parsed.isNull(), F.lit(PARSE_ERROR))
        .when(~is_kind(parsed, "OBJECT"), F.lit(CALL_ERROR + "reply is not an object"))
    )


def reply_verdict(parsed: Column) -> Column:
    """``is_score`` of a parsed reply: true, false or NULL for unknown."""
    return F.when(is_kind(field(parsed, "is_score"), "BOOLEAN"), field(parsed, "is_score", "boolean"))


def reply_reason(parsed: Column) -> Column:
    return F.coalesce(field(parsed, "reason", "string"), F.lit(""))
