"""Operators on raw pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def media_urls(docs: DataFrame) -> DataFrame:
    """Distinct links of each text with their kind."""
    urls = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"https?://[^\s\"<>]+"), F.lit(0)))).alias("url"))
    kind = F.when(F.col("url").rlike(r"youtube\.com|youtu\.be"), "video").when(F.col("url").rlike(r"\.(mp3|m4a|ogg|wav)($|\?)"), "audio").otherwise("link")
    return urls.withColumn("kind", kind)


#: Elements that are dropped before an article is read, with all they hold, and the places where it is looked for, the best first.
NOISE = "script style noscript iframe svg nav header footer".split()
NOISE_CLASSES = "nav navbar header footer sidebar ad ads advertisement social-share share-buttons related-articles comments comment-section cookie-banner popup modal newsletter".split()
PARAGRAPH, BODY, EXCERPT, LEAST = 40, 3000, 200, 80


#: Elements whose class or id may mark them as noise.
HOLDERS = "div section aside ul p span".split()
#: Where an article stands, where a paragraph begins, and what of it counts.
ARTICLE, BEGIN, TAKEN = r"(?is)<article\b[^>]*>(.*?)</article\s*>", r"(?i)<p\b[^>]*>", r"(?is)^(.*?)(?:</p\s*>|</article|</body|$)"
TITLES = [r"""(?i)<meta\s[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", r"(?is)<article\b.*?<h1\b[^>]*>(.*?)</h1", r"(?is)<title\b[^>]*>(.*?)</title"]


def noise_patterns() -> list[str]:
    """Patterns of what is dropped: noisy elements, and holders with a noisy class or id."""
    classes = "|".join(NOISE_CLASSES)
    marked = rf"""\b[^>]*\s(?:class|id)=["']?(?:[^"'>]*\s)?(?:{classes})(?:\s[^"'>]*)?["']?[^>]*>.*?</"""
    return [rf"(?is)<{x}\b[^>]*>.*?</{x}\s*>" for x in NOISE] + [rf"(?is)<{x}{marked}{x}\s*>" for x in HOLDERS]


def article_text(pages: DataFrame) -> DataFrame:
    """title, body and excerpt of each page: paragraphs of an article, or of the page, of some length, cut at a sentence; pages with little text go.

    Noise that does not nest in itself is dropped by patterns, with built-in functions alone.
    """
    html = F.col("html")
    for pattern in noise_patterns():
        html = F.regexp_replace(html, pattern, " ")
    plain = lambda x: F.trim(F.regexp_replace(decoded(F.regexp_replace(x, "<[^>]*>", "")), r"\s+", " "))

    def paragraphs(x):
        parts = F.split(x, BEGIN)
        own = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda t: plain(F.regexp_extract(t, TAKEN, 1)))
        return F.filter(own, lambda t: F.length(t) > PARAGRAPH)

    rows = pages.select("page_id", "html", html.alias("clean")).select("page_id", "html", paragraphs(F.regexp_extract("clean", ARTICLE, 1)).alias("inner"), paragraphs(F.col("clean")).alias("every"))
    body = F.array_join(F.when(F.size("inner") >= 2, F.col("inner")).otherwise(F.col("every")), "\n\n")
    title = F.coalesce(*[F.nullif(plain(F.regexp_extract("html", x, 1)), F.lit("")) for x in TITLES], F.lit(""))
    rows = rows.select("page_id", title.alias("title"), body.alias("body"))
    head = F.substring("body", 1, BODY)
    stop = F.length(head) - F.instr(F.reverse(head), " .")  # characters up to the last ". "
    cut = F.when((F.instr(F.reverse(head), " .") > 0) & (stop - 1 > 0.6 * BODY), F.substring(head, F.lit(1), stop)).otherwise(head)
    rows = rows.withColumn("body", F.when(F.length("body") > BODY, cut).otherwise(F.col("body"))).filter(F.length("body") >= LEAST)
    start = F.trim(F.substring("body", 1, EXCERPT))
    blank = F.length(start) - F.instr(F.reverse(start), " ")  # characters before the last blank
    return rows.withColumn("excerpt", F.concat(F.when((F.instr(F.reverse(start), " ") > 0) & (blank > 0.7 * EXCERPT), F.substring(start, F.lit(1), blank)).otherwise(start), F.lit("...")))


#: The character references that pages use most.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def decoded(text):
    for name, value in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def feed_items(feeds: DataFrame, most: int = 20) -> DataFrame:
    """(source, xml) -> source, position, title, link: items of RSS and Atom feeds, plain or in CDATA, links as text or href."""
    items = F.slice(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0)), 1, most)
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))
    href = F.regexp_extract("item", r"""<link[^>]*href=["']([^"']+)["']""", 1)
    rows = feeds.select("source", F.posexplode(items).alias("position", "item"))
    return rows.select("source", "position", tag("title").alias("title"), F.coalesce(F.nullif(tag("link"), F.lit("")), href).alias("link"))
