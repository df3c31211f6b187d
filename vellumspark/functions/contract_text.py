"""Facts of contract texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def one_of(c: Column, words) -> Column:
    """Whether a text contains any of the words."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def clause_type(text: Column, keywords: dict[str, list[str]] = P.CLAUSE_KEYWORDS) -> Column:
    """The type with the most distinct keywords in the text; the first listed of equals; null if none occurs."""
    lower = F.lower(text)
    scores = F.array(*[
        F.struct(reduce(lambda a, b: a + b, [F.contains(lower, F.lit(w)).cast("int") for w in words]).alias("score"), F.lit(-i).alias("rank"),
                 F.lit(kind).alias("kind"))
        for i, (kind, words) in enumerate(keywords.items())])
    best = F.array_max(scores)
    return F.when(best["score"] > 0, best["kind"])


def section_reference(text: Column) -> Column:
    """The first section heading in the first 150 characters."""
    return none_if_empty(F.regexp_extract(F.substring(text, 1, 150), P.SECTION, 0))


def _cast_amount(number: Column, suffix: Column) -> Column:
    unit = F.upper(F.substring(suffix, 1, 1))
    factor = F.when(unit == "M", 1e6).when(unit == "K", 1e3).when(unit == "B", 1e9).otherwise(1.0)
    return F.regexp_replace(number, ",", "").try_cast("double") * factor


def liability_cap(text: Column) -> Column:
    """Struct has_cap, basis (fee_based, fixed_amount, other), amount_text, amount_usd, matched_text."""
    trigger = F.regexp_extract(text, P.CAP_TRIGGER, 0)
    capped = F.coalesce((trigger != "") & ~F.rlike(text, F.lit(P.CAP_VETO)), F.lit(False))
    fee = F.regexp_extract(text, P.FEE_CAP, 0)
    place = F.instr(text, trigger)
    start = F.greatest(place - 50, F.lit(1))
    window = F.substring(text, start, place + 200 - start)
    raw = F.trim(F.regexp_extract(window, P.AMOUNT, 0))
    number, suffix = F.regexp_extract(window, P.AMOUNT, 1), F.regexp_extract(window, P.AMOUNT, 2)
    basis = F.when(~capped, None).when(fee != "", "fee_based").when(number != "", "fixed_amount").otherwise("other")
    amount = F.when(basis == "fee_based", F.concat(F.regexp_extract(text, P.FEE_CAP, 1), F.lit("-month fees"))).when(basis == "fixed_amount", raw).when(
        basis == "other", "(amount not parseable)")
    matched = F.when(basis == "fee_based", fee).when(basis == "fixed_amount", F.concat(trigger, F.lit(" "), raw)).when(basis == "other", trigger)
    return F.struct(capped.alias("has_cap"), basis.alias("basis"), amount.alias("amount_text"),
                    F.when(basis == "fixed_amount", _cast_amount(number, suffix)).alias("amount_usd"), matched.alias("matched_text"))


def notice_days(text: Column) -> Column:
    """The shortest notice period, in days, of all that the text names in digits or words."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(P.NOTICE_NUMBER), 1), lambda d: d.try_cast("int"))
    table = F.create_map(*[F.lit(x) for pair in P.WORD_DAYS.items() for x in pair])
    words = F.transform(F.regexp_extract_all(text, F.lit(P.NOTICE_WORD), 1),
                        lambda w: F.try_element_at(table, F.regexp_replace(F.lower(w), r"\s*-\s*", "-")))
    return F.array_min(F.concat(digits, words))


def auto_renewal(text: Column) -> Column:
    """Struct has_auto_renewal, renewal_period, opt_out_days, adequate (30 days at least), matched_text."""
    trigger = F.regexp_extract(text, P.RENEWAL, 0)
    renews = F.coalesce(trigger != "", F.lit(False))
    unit = F.lower(F.regexp_extract(text, P.RENEWAL_TERM, 2))
    count = F.coalesce(none_if_empty(F.regexp_extract(text, P.RENEWAL_TERM, 1)), F.lit("1"))
    period = F.when(unit == "", "").otherwise(F.concat(count, F.lit("-"), F.when(F.rlike(unit, F.lit("year|annual")), "year").otherwise("month")))
    days = notice_days(text)
    return F.struct(renews.alias("has_auto_renewal"), F.when(renews, period).alias("renewal_period"), F.when(renews, days).alias("opt_out_days"),
                    (renews & F.coalesce(days >= 30, F.lit(False))).alias("adequate"), F.when(renews, trigger).alias("matched_text"))


def renews_without_notice(text: Column) -> Column:
    """Whether the text renews automatically with a notice under 30 days or none."""
    renews = F.coalesce(F.regexp_extract(text, P.RENEWAL, 0) != "", F.lit(False))
    return F.when(renews, ~F.coalesce(notice_days(text) >= 30, F.lit(False))).otherwise(F.lit(False))


def governing_law(text: Column) -> Column:
    """The jurisdiction of the first governing-law phrase; case matters."""
    groups = [none_if_empty(F.regexp_extract(text, P.LAW, g)) for g in (1, 2, 3)]
    return F.regexp_replace(F.trim(F.coalesce(*groups)), r"[.,;]+$", "")


def obligors(text: Column) -> Column:
    """Distinct parties that must indemnify, in order; names under three characters don't count.

    Nothing behind the text's last verb can be part of a match, so the pattern,
    which starts at every capital letter, is spared what follows.
    """
    upto = F.regexp_extract(text, P.OBLIGOR_END, 0)
    names = F.transform(F.regexp_extract_all(upto, F.lit(P.OBLIGOR), 1), lambda n: F.regexp_replace(F.trim(n), r"[,.]+$", ""))
    return F.array_distinct(F.filter(names, lambda n: F.length(n) >= 3))


def one_sided_indemnity(text: Column) -> Column:
    return F.coalesce(F.size(obligors(text)) == 1, F.lit(False))


def asked_page(question: Column) -> Column:
    """The page number that a question asks about, by ordinal, word or number."""
    q = F.lower(question)
    words = [(F.rlike(q, F.lit(rf"\b{w}\s+page\b|\bpage\s+{w}\b")), i) for i, group in enumerate(P.PAGE_WORDS, 1) for w in group]
    named = reduce(lambda chain, case: chain.when(case[0], case[1]), words[1:], F.when(*words[0]))
    numbers = [none_if_empty(F.regexp_extract(q, pattern, 1)).try_cast("int") for pattern in P.PAGE_NUMBERS]
    return F.coalesce(named, *numbers)


def question_type(question: Column) -> Column:
    """Clause type of an annotation question: the first listed phrase that it contains, else other."""
    q = F.lower(question)
    (w, kind), *rest = P.QUESTION_TYPES
    return reduce(lambda chain, case: chain.when(F.contains(q, F.lit(case[0])), case[1]), rest, F.when(F.contains(q, F.lit(w)), kind)).otherwise("other")


def category_type(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in P.CATEGORY_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit("other"))


def top_character_share(text: Column) -> Column:
    """Share of the most frequent character, case folded; null for an empty text.

    Characters are sorted and run lengths folded, so the cost is that of a sort.
    """
    letters = F.array_sort(F.split(F.lower(text), ""))
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(acc, c):
        n = F.when(acc["c"] == c, acc["n"] + 1).otherwise(1)
        return F.struct(c.alias("c"), n.alias("n"), F.greatest(acc["best"], n).alias("best"))

    return F.when(F.length(text) > 0, F.aggregate(letters, start, step)["best"] / F.length(text))


def top_ascii_share(text: Column) -> Column:
    """Share of the most frequent of the letters a-z, digits and common marks, case folded, by counting each once."""
    lower = F.lower(text)
    counts = [F.length(lower) - F.length(F.replace(lower, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz0123456789 .-_*#=!?"]
    return F.when(F.length(text) > 0, F.greatest(*counts) / F.length(text))


def top_character_bound(text: Column) -> Column:
    """What ``top_character_share`` is at most: a character is one of the few that are counted, or among all others."""
    lower = F.lower(text)
    counts = [F.length(lower) - F.length(F.replace(lower, F.lit(c), F.lit(""))) for c in " eai"]
    return F.when(F.length(text) > 0, F.greatest(*counts, F.length(lower) - reduce(lambda a, b: a + b, counts)) / F.length(text))


def injection(text: Column) -> Column:
    """Whether a text matches an injection pattern; a pattern runs only over texts that have what each of its matches has."""
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lower, F.lit(held)) & F.rlike(text, F.lit(p)) for held, p in zip(P.INJECTION_HAS, P.INJECTION, strict=True)])


def input_verdict(text: Column) -> Column:
    """Why a text must not be ingested, or null; the first failing check counts."""
    injected = injection(text)
    repeated = (F.length(text) >= P.REPEAT_LEAST) & (top_character_bound(text) > P.REPEAT_SHARE) & (top_character_share(text) > P.REPEAT_SHARE)
    return (F.when(F.length(text) > P.MAX_CONTENT, "too_large").when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
            .when(injected, "injection").when(repeated, "repetitive"))


def query_verdict(question: Column) -> Column:
    """Why a question must not be answered, or null."""
    q = F.lower(question)
    injected = reduce(lambda a, b: a | b, [F.rlike(question, F.lit(p)) for p in P.INJECTION])
    return F.when(injected, "injection").when(one_of(q, P.OFF_TOPIC) & ~one_of(q, P.LEGAL_WORDS), "off_topic")


def words3(text: Column) -> Column:
    """Lower-case words of three and more letters a-z, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.rlike(w, F.lit("^[a-z]{3,}$")))


def bigrams(words: Column) -> Column:
    """Distinct neighbours as 'a b'; a single word stands for itself."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def claims(text: Column) -> Column:
    """Sentences of 20 and more characters with a modal word or four digits."""
    parts = F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    return F.filter(parts, lambda s: (F.length(s) >= 20) & (one_of(F.lower(s), P.MODALS) | F.rlike(s, F.lit(P.FOUR_DIGITS))))


def key_entities(text: Column) -> Column:
    """Capitalised phrases, quoted phrases and words in capitals."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), group) for p, group in P.KEY_ENTITIES])


def factual_entities(text: Column) -> Column:
    """Distinct dollar amounts, dates and party names."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in P.FACTS]))


def file_name(name: Column) -> Column:
    """A file name without its folders and without characters that file systems refuse."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")


def slug(name: Column) -> Column:
    """A collection name of 3 to 63 characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.rpad(F.substring(s, 1, 63), F.greatest(F.length(F.substring(s, 1, 63)), F.lit(3)), F.lit("x"))


def normal_type(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), r"[\s-]+", "_")


def tier(clauses: Column, risks: Column) -> Column:
    return F.when((clauses >= 10) | (risks >= 6), "detailed").when((clauses <= 4) & (risks <= 2), "brief").otherwise("standard")


def report_band(score: Column) -> Column:
    return F.when(score <= 30, "low").when(score <= 55, "medium").when(score <= 75, "high").otherwise("critical")


def dashboard_band(score: Column) -> Column:
    return F.when(score <= 30, "low").when(score <= 60, "medium").when(score <= 80, "high").otherwise("critical")


def grade(share: Column) -> Column:
    return F.when(share >= 0.9, "A").when(share >= 0.8, "B").when(share >= 0.7, "C").when(share >= 0.6, "D").otherwise("F")


def recommendation(grade_of: Column, weak: Column) -> Column:
    """What to do next: nothing for grades A and B, else the weak metrics by name."""
    return F.when(grade_of.isin("A", "B"), "no action").otherwise(F.concat(F.lit("improve: "), F.array_join(weak, "; ")))


def slim_risk(severity: Column, title: Column, description: Column, cap: int = 500) -> Column:
    """JSON of a risk with its description cut, for a prompt."""
    return F.to_json(F.struct(severity.alias("severity"), title.alias("title"), F.substring(F.coalesce(description, F.lit("")), 1, cap).alias("description")))


def slim_analysis(metadata: Column, clauses: Column, key_dates: Column, cap: int = 2000) -> Column:
    """JSON of an analysis for a prompt, clause texts cut. clauses: array of clause_type, title, text, section_reference, page_number, obligations (party, description, type, deadline)."""
    owed = lambda c: F.transform(c["obligations"], lambda o: F.struct(*[o[k].alias(k) for k in ("party", "description", "type", "deadline")]))
    slim = F.transform(clauses, lambda c: F.struct(c["clause_type"].alias("clause_type"), c["title"].alias("title"), F.substring(F.coalesce(c["text"], F.lit("")), 1, cap).alias("text_excerpt"),
                                                   c["section_reference"].alias("section_reference"), c["page_number"].alias("page_number"), owed(c).alias("obligations")))
    return F.to_json(F.struct(metadata.alias("metadata"), slim.alias("clauses"), key_dates.alias("key_dates")), {"ignoreNullFields": "false"})


def judge_clauses(clauses: Column, cap: int = 500) -> Column:
    """JSON of clauses for the judge: texts cut, obligations counted."""
    slim = F.transform(clauses, lambda c: F.struct(c["clause_type"].alias("clause_type"), c["title"].alias("title"), F.substring(F.coalesce(c["text"], F.lit("")), 1, cap).alias("text"),
                                                   c["section_reference"].alias("section_reference"), F.coalesce(F.size(c["obligations"]), F.lit(0)).alias("obligation_count")))
    return F.to_json(F.struct(slim.alias("clauses")), {"ignoreNullFields": "false"})


def judge_risks(score: Column, level: Column, risks: Column, missing: Column, cap: int = 200) -> Column:
    """JSON of a risk report for the judge: descriptions cut. risks: array of severity, category, title, description."""
    items = F.transform(risks, lambda r: F.struct(r["severity"].alias("severity"), r["category"].alias("category"), r["title"].alias("title"),
                                                  F.substring(F.coalesce(r["description"], F.lit("")), 1, cap).alias("description")))
    return F.to_json(F.struct(score.alias("overall_score"), level.alias("risk_level"), items.alias("items"), missing.alias("missing_clauses")), {"ignoreNullFields": "false"})


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def sentence_pack(text: Column, limit: int = P.SENTENCE_CHARS) -> Column:
    """Sentences joined greedily up to ``limit`` characters; a longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, s):
        fits = (acc["open"] == "") | (F.length(acc["open"]) + 1 + F.length(s) <= limit)
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
                        F.when(fits, joined).otherwise(s).alias("open"))

    folded = F.aggregate(F.filter(sentences(text), lambda s: F.trim(s) != ""), start, step)
    return F.when(folded["open"] == "", folded["done"]).otherwise(F.array_append(folded["done"], folded["open"]))


def cut_with_note(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and a note of how many follow."""
    more = F.concat(F.substring(text, 1, limit), F.lit("\n[… truncated "), (F.length(text) - limit).cast("string"), F.lit(" remaining chars …]"))
    return F.when(F.length(text) > limit, more).otherwise(text)


def context_header(document: Column, page: Column, clause: Column, section: Column) -> Column:
    """'[Document: … | Page: … | Clause: … | Section: …]' with absent parts left out."""
    parts = F.concat_ws(" | ", F.concat(F.lit("Document: "), document), F.concat(F.lit("Page: "), page.cast("string")),
                        F.concat(F.lit("Clause: "), clause), F.concat(F.lit("Section: "), section))
    return F.when(parts != "", F.concat(F.lit("["), parts, F.lit("]\n"))).otherwise("")


def cache_key(project: Column, question: Column, k: Column, documents: Column) -> Column:
    return F.sha2(F.concat_ws("|", project, F.lower(F.trim(question)), F.coalesce(k.cast("string"), F.lit("adaptive")), documents.cast("string")), 256)
