"""Text helpers as Column expressions: token sets, keys, similarity, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import EVENT_STOP_WORDS

#: Words that similarity of titles leaves out; a fixed list.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is was are were has have had be been being this that these those it its"
).split()


def words(text: Column, least: int = 3, stop: list[str] | None = None, pattern: str = r"\W+") -> Column:
    """The distinct lower-case words of a text, in their first order; empty for null."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), pattern), lambda w: F.length(w) >= least)
    if stop:
        tokens = F.filter(tokens, lambda w: ~w.isin(stop))
    return F.array_distinct(tokens)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / F.when(union > 0, union)).otherwise(0.0)


def event_fingerprint(title: Column, category: Column) -> Column:
    """The category and the first five of the title's words in order, as 16 hexadecimal digits."""
    bare = F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", "")
    kept = F.filter(F.split(bare, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(EVENT_STOP_WORDS))
    return F.substring(F.md5(F.concat_ws(":", category, F.array_join(F.slice(F.array_sort(kept), 1, 5), ":"))), 1, 16)


def topic_key(title: Column, first: int) -> Column:
    """The first words of more than three letters, then sorted."""
    long_words = F.filter(F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: F.length(w) > 3)
    return F.array_join(F.array_sort(F.slice(long_words, 1, first)), "_")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded with two spaces before and one after."""
    parts = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) > 0)
    padded = F.transform(parts, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters, and without the marks that are left at the end."""
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(bare, r"([?&])(?:utm_[a-z]+|fbclid|gclid|ref|referrer)=[^&]*", "$1")
    bare = F.regexp_replace(bare, r"&&+", "&")
    bare = F.regexp_replace(bare, r"\?&+", "?")
    return F.regexp_replace(bare, r"[?&]+$", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:www\.)?([^/?#]+)", 1))


def attribution(sources: str, shown: int) -> Column:
    n = F.size(sources)
    more = F.when(n > shown, F.concat(F.lit(" and "), (n - shown).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("Based on "), n.cast("string"), F.lit(" sources: "), F.array_join(F.slice(sources, 1, shown), ", "), more)


def first_sentences(text: Column, n: int) -> Column:
    """The first sentences: runs up to a full stop, an exclamation or a question mark."""
    return F.trim(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?])"), F.lit(1)), 1, n), ""))


def title_case(text: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(text, r"\s+", " ")))


def argmax_label(scores: dict[str, Column], default: str) -> Column:
    """The label of the greatest positive score; ties go to the label that comes first."""
    best = F.greatest(*scores.values())
    out = F.when(best <= 0, default)
    for label, score in scores.items():
        out = out.when(score == best, label)
    return out


def fixed(value: Column, places: int) -> Column:
    """A number with so many places, as C and SQL print it: from its exact binary value, a half to the even side.

    ``format_string`` rounds the shortest decimal that reads back as the number, with a half up: 0.25 and 1.15 become 0.3 and 1.2, not 0.2 and 1.1.
    """
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def hits(text: Column, names: list[str]) -> Column:
    """How many of the words occur in a text, in lower case."""
    out = F.lit(0)
    for name in names:
        out = out + F.contains(F.lower(text), F.lit(name)).cast("int")
    return out
