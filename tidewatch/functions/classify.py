"""Rule classifiers: categories, severities, tags, languages and kinds from text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    """A pattern whose word edges are those of ASCII words, whatever the Java version takes for a letter.

    An edge before a word needs no word character before it, one behind a word none after it; where a
    pattern has blanks or signs at edges, both sides are looked at.
    """
    if re.search(r"%|\\s\+[|)]", pattern):
        return pattern.replace(r"\b", _EDGE)
    before = re.sub(r"\\b(?=\(|\w|\\d)", "(?<![A-Za-z0-9_])", pattern)
    return before.replace(r"\b", "(?![A-Za-z0-9_])")


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | Column | None) -> Column:
    """The label of the first rule whose pattern is in the text."""
    out = None
    for label, pattern in rules:
        hit = text.rlike(ascii_words(pattern))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def first_word(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """The label of the first rule one of whose words the text contains, in lower case."""
    out, lower = None, F.lower(text)
    for label, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lower, F.lit(word.lower()))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def category(text: Column) -> Column:
    return first_match(F.lower(text), T.CATEGORY_RULES, "other")


def severity(text: Column, category_: Column) -> Column:
    return first_match(F.lower(text), T.SEVERITY_RULES, F.when(category_ == "breaking", "high").when(category_.isin("disaster", "conflict"), "medium").otherwise("low"))


def news_severity(text: Column) -> Column:
    return first_match(F.lower(text), T.NEWS_SEVERITY, "low")


def news_category(text: Column, default: str | Column) -> Column:
    return first_match(F.lower(text), T.NEWS_CATEGORY, default)


def recalibrated(severity_: Column, category_: Column, opinion: Column) -> Column:
    """Soft categories and opinion pieces can't be severe."""
    low = (category_ == "other") & severity_.isin("critical", "high", "medium")
    soft = category_.isin("culture", "sports", "science", "space") | opinion
    return F.when(low, "low").when(soft & severity_.isin("critical", "high"), "medium").otherwise(severity_)


def _told(lower: Column, pattern: str) -> Column:
    """Whether a pattern of plain words, some with word edges at their ends, is in a text: words are looked up as plain strings first, and only those with edges by a pattern then."""
    hit, edged = F.lit(False), F.lit(False)
    for part in pattern.split("|"):
        word = part.replace(r"\b", "")
        if re.search(r"[^a-z ]", word):
            return lower.rlike(ascii_words(pattern))
        if word == part:
            hit = hit | F.contains(lower, F.lit(word))
        else:
            edged = edged | (F.contains(lower, F.lit(word)) & lower.rlike(ascii_words(part)))
    return hit | edged


def tags(text: Column, most: int = 5) -> Column:
    """The first tags of those whose words are in the text."""
    said = lambda lower: F.array_compact(F.array(*[F.when(_told(lower, p), F.lit(t)) for t, p in T.TAG_RULES]))
    # the text is lowered once, as the argument of a function
    return F.slice(F.element_at(F.transform(F.array(F.lower(text)), said), 1), 1, most)


def language(text: Column, default: str = "en") -> Column:
    """By script, else by stop words in the text; the first language with the most of them, the default if there are none."""
    lower = F.lower(text)
    counts = {lang: F.regexp_count(lower, F.lit(rf"(?<![A-Za-z0-9_])(?:{'|'.join(own)})(?![A-Za-z0-9_])")) for lang, own in T.LANGUAGE_WORDS.items()}
    packed = F.struct(*[n.alias(lang) for lang, n in counts.items()])

    def decided(n: Column) -> Column:
        best = F.greatest(*[n[lang] for lang in counts])
        out = F.when(best == 0, default)
        for lang in counts:
            out = out.when(n[lang] == best, lang)
        return out

    # the counts are made once, as the argument of a function
    latin = F.element_at(F.transform(F.array(packed), decided), 1)
    out = None
    for lang, first, last in T.SCRIPTS:
        hit = text.rlike(f"[{chr(first)}-{chr(last)}]")
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out.otherwise(latin)


def bait(title: Column) -> Column:
    """Whether a title baits clicks."""
    out, lower = F.lit(False), F.lower(title)
    for pattern in T.CLICKBAIT:
        out = out | lower.rlike(ascii_words(pattern))
    return out


def slop(host: Column, byline: Column, title: Column, body: Column, busy: Column, bare: Column) -> Column:
    """How likely a page is mass-produced, 0 to 1."""
    n = F.length(F.trim(body))
    points = lambda hit, worth: F.when(hit, worth).otherwise(0.0)
    total = points(host.isin(T.CONTENT_FARMS), 0.40) + points(~byline, 0.15) + points(bait(title), 0.10) + points((n > 0) & (n < 100), 0.10) + points(busy, 0.10) + points(bare, 0.05)
    return F.round(F.least(F.lit(1.0), total), 2)


def bias_label(score: Column) -> Column:
    return (
        F.when(score <= -0.8, "far-left").when(score <= -0.4, "left").when(score <= -0.1, "center-left")
        .when(score < 0.1, "center").when(score < 0.4, "center-right").when(score < 0.8, "right").otherwise("far-right")
    )


def bias(domain: Column) -> Column:
    """score, confidence and method of a domain: known, neutral by its end, that of the domain it belongs to, or by words of its name."""
    known = F.create_map(*[F.lit(x) for pair in T.BIAS.items() for x in pair])
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    parents = F.when(n >= 3, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))
    parent = F.get(F.filter(F.transform(parents, lambda p: F.try_element_at(known, p)), lambda s: s.isNotNull()), F.lit(0))
    ends = lambda x: F.endswith(domain, F.lit(x))
    neutral, state = F.lit(False), F.lit(False)
    for x in T.NEUTRAL_ENDS:
        neutral = neutral | ends(x) | F.contains(domain, F.lit(x + "."))
    for x in T.STATE_ENDS:
        state = state | ends(x)
    words = F.filter(F.split(F.regexp_replace(domain, r"\.[^.]+$", ""), "[-_.]+"), lambda w: F.length(w) > 2)
    left, right = F.size(F.filter(words, lambda w: w.isin(T.LEFT_WORDS))), F.size(F.filter(words, lambda w: w.isin(T.RIGHT_WORDS)))
    net = F.greatest(F.lit(-0.75), F.least(F.lit(0.75), (right - left) * 0.25))
    row = lambda score, confidence, method: F.struct(score.cast("double").alias("score"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    return (
        F.when(F.try_element_at(known, domain).isNotNull(), row(F.try_element_at(known, domain), "high", "seed"))
        .when(neutral, row(F.lit(0.0), "high", "heuristic"))
        .when(parent.isNotNull(), row(parent, "medium", "heuristic"))
        .when(state, row(F.lit(0.0), "low", "heuristic"))
        .when((left > 0) | (right > 0), row(net, "low", "heuristic"))
        .otherwise(row(F.lit(None), "low", "unknown"))
    )


def vessel(title: Column, military: Column) -> Column:
    """carrier (military reports only), dark_ship or vessel."""
    return F.when(military & fleet(title).isNotNull(), "carrier").when(first_word(title, [("x", T.DARK_SHIPS)], None).isNotNull(), "dark_ship").otherwise("vessel")


def fleet(title: Column) -> Column:
    """The fleet of the first carrier that the title names."""
    return first_word(title, T.FLEETS, None)
