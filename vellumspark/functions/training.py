"""Training rows: validity, formats and conversions, as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import params as P

CLAUSE = "struct<clause_type:string,title:string,text:string>"


def valid_example(messages: Column) -> Column:
    """Three or more messages, the last one the assistant's and a clause in JSON."""
    last = F.try_element_at(messages, F.lit(-1))
    parsed = F.from_json(last["content"], "clause_type string, title string, text string")
    return F.coalesce((F.size(messages) >= 3) & (last["role"] == "assistant") & parsed["clause_type"].isNotNull(), F.lit(False))


def instruction_format(messages: Column, limit: int = 1500) -> Column:
    """Struct prompt, response of a chat example; the user's text is cut at ``limit``."""
    said = lambda role: F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]
    prompt = F.concat(F.lit("### Instruction:\n"), F.coalesce(said("system"), F.lit("")), F.lit("\n\n### Input:\n"),
                      F.substring(F.coalesce(said("user"), F.lit("")), 1, limit), F.lit("\n\n### Response:\n"))
    return F.struct(prompt.alias("prompt"), F.coalesce(said("assistant"), F.lit("")).alias("response"))


def instruction_input(prompt: Column) -> Column:
    return F.regexp_extract(prompt, r"(?s)### Input:\n(.*?)\n\n### Response:", 1)


def token_estimate(text: Column) -> Column:
    """Characters over four, rounded up; a tokenizer's count can take its place."""
    return F.ceil(F.length(text) / 4).cast("int")


def within_limit(text: Column, limit: int = P.TOKEN_LIMIT) -> Column:
    """Whether an example is short enough to train on."""
    return F.coalesce(token_estimate(text) <= limit, F.lit(True))


_OPENING, _CLOSING = {"[": "]", "{": "}"}, {"]": "[", "}": "{"}


def _strict(text: str) -> bool:
    """Whether the whole text is JSON, without the constants that JSON lacks."""
    def refused(name: str):
        raise ValueError(name)

    try:
        json.loads(text, parse_constant=refused)
    except (ValueError, RecursionError):
        return False
    return True


def balanced(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of the balanced lists and objects of a text, by their opening sign, in the order of their starts; brackets in strings don't count.

    A quote opens a string only inside brackets, where JSON has strings; a bracket
    of the other kind drops what was open before it.
    """
    found: dict[str, list[tuple[int, int]]] = {"[": [], "{": []}
    stack: list[tuple[str, int]] = []
    quoted, at, n = False, 0, len(text)
    while at < n:
        c = text[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif c == '"' and stack:
            quoted = True
        elif c in _OPENING:
            stack.append((c, at))
        elif c in _CLOSING and stack:
            if stack[-1][0] == _CLOSING[c]:
                found[stack[-1][0]].append((stack.pop()[1], at + 1))
            else:
                stack.clear()
        at += 1
    return {sign: sorted(places) for sign, places in found.items()}


def json_of(text: str | None) -> str | None:
    """JSON text without code fences, or its first balanced list, or else object, that is JSON; null if there is none."""
    if text is None:
        return None
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text).strip()
    if _strict(bare):
        return bare
    places = balanced(bare)
    return next((bare[s:e] for sign in "[{" for s, e in places[sign] if _strict(bare[s:e])), None)


@F.pandas_udf(StringType())
def tolerant_json(texts: pd.Series) -> pd.Series:
    """``json_of`` of each text."""
    return texts.map(json_of)
