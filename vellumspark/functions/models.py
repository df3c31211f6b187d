"""Model calls as interfaces over columns, each with a deterministic default.

A caller with a model passes its own function of the same signature (a pandas
UDF, say); results of defaults are not comparable with a model's.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import contract_text as C


def default_extract(text: Column) -> Column:
    """One clause a chunk: its keyword type, its section as title, its first 4000 characters."""
    return F.struct(F.coalesce(C.clause_type(text), F.lit("other")).alias("clause_type"), F.coalesce(C.section_reference(text), F.lit("")).alias("title"),
                    F.substring(text, 1, 4000).alias("text"))


def default_intent(question: Column) -> Column:
    q = F.trim(F.lower(question))
    return F.when(F.rlike(q, F.lit(r"^(hi|hello|hey|good (morning|afternoon|evening))\b")), "greeting").when(C.query_verdict(question) == "off_topic", "off_topic").otherwise("technical")


def default_summary(text: Column, tables: Column, images: Column) -> Column:
    return F.concat(F.substring(text, 1, 300), F.lit(" [tables: "), tables.cast("string"), F.lit(", images: "), images.cast("string"), F.lit("]"))


def default_judgement(answer: Column, source: Column) -> Column:
    """Struct overall, grounded: the share of the answer's words that its source has stands for both."""
    words = F.array_distinct(C.words3(answer))
    share = F.round(F.coalesce(F.size(F.array_intersect(words, C.words3(source))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0)), 6)
    return F.struct(share.alias("overall"), (share >= 0.7).alias("grounded"))


def described(description: Column) -> Column:
    """An image's description, or null where the describer said to skip it."""
    return F.when(F.upper(F.trim(description)) != "SKIP", description)


def with_retry(call: Callable, transient: tuple[type[Exception], ...], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> Callable:
    """A call that is tried again after 1, 2, 4 ... seconds on transient errors; the last one is raised. For use inside tasks."""

    def run(*args, **options):
        for attempt in range(tries):
            try:
                return call(*args, **options)
            except transient:
                if attempt + 1 == tries:
                    raise
                pause(2**attempt)

    return run


def with_failover(calls: list[Callable], transient: tuple[type[Exception], ...]) -> Callable:
    """The first of several providers that answers, in their order."""

    def run(*args, **options):
        for call in calls[:-1]:
            try:
                return call(*args, **options)
            except transient:
                continue
        return calls[-1](*args, **options)

    return run


@dataclass
class Models:
    """The calls that a pipeline may make."""

    extract: Callable[[Column], Column] = default_extract
    intent: Callable[[Column], Column] = default_intent
    summarise: Callable[[Column, Column, Column], Column] = default_summary
    rerank: Callable[[Column, Column], Column] | None = None
    judge: Callable[[Column, Column], Column] = default_judgement
    prompts: dict[str, tuple[str, str]] = field(default_factory=dict)

    def prompt(self, purpose: str) -> tuple[str, str]:
        """(text, version) of a purpose."""
        if purpose not in self.prompts:
            raise KeyError(f"no prompt for {purpose}")
        return self.prompts[purpose]
