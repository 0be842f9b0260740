"""Scores and labels of single signals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ranks as R

#: Categories by what they can set off, and category families; fixed values.
CAUSES = {
    "disaster": ["health", "climate", "economy", "security", "breaking"],
    "climate": ["disaster", "health", "economy"],
    "science": ["disaster", "climate", "health", "space"],
    "conflict": ["security", "geopolitics", "economy", "disaster", "breaking"],
    "geopolitics": ["conflict", "security", "economy", "elections"],
    "security": ["conflict", "geopolitics", "technology", "economy"],
    "technology": ["security", "economy"],
    "health": ["disaster", "economy", "science"],
    "economy": ["geopolitics", "elections", "security"],
    "elections": ["geopolitics", "conflict", "security"],
    "space": ["science", "security", "technology"],
}
FAMILIES = {
    "conflict": "security", "security": "security", "geopolitics": "security", "elections": "political", "culture": "political", "climate": "environment",
    "disaster": "environment", "science": "science_tech", "technology": "science_tech", "space": "science_tech", "health": "health", "economy": "economy",
    "breaking": "breaking", "sports": "sports", "other": "other",
}


def temporal(hours: Column, window: float = 24.0) -> Column:
    """1 within an hour, then falling to 0 at the window's end."""
    return F.when(hours <= 1, 1.0).when(hours >= window, 0.0).otherwise(1.0 - (hours - 1) / (window - 1))


def geographic(km: Column, radius: float = 200.0) -> Column:
    """1 within 10 km, then falling to 0 at the radius; 0 without a distance."""
    return F.when(km.isNull() | (km >= radius), 0.0).when(km <= 10, 1.0).otherwise(1.0 - (km - 10) / (radius - 10))


def _pairs() -> list[str]:
    return sorted({f"{a}>{b}" for a, effects in CAUSES.items() for b in effects})


def causal(cat_a: Column, cat_b: Column, src_a: Column, src_b: Column) -> Column:
    """1 for a cause and its effect either way, less for a shared category or family."""
    known = _pairs()
    family = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    chain = F.concat_ws(">", cat_a, cat_b).isin(known) | F.concat_ws(">", cat_b, cat_a).isin(known)
    return F.when(chain, 1.0).when((cat_a == cat_b) & (src_a != src_b), 0.7).when(F.try_element_at(family, cat_a) == F.try_element_at(family, cat_b), 0.35).otherwise(0.0)


def keyword(tag_jaccard: Column, word_jaccard: Column, same_place: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * tag_jaccard + 0.3 * word_jaccard + F.when(same_place, 0.3).otherwise(0.0))


def correlation(time: Column, geo: Column, cause: Column, words: Column, located: Column) -> Column:
    return F.when(located, 0.25 * time + 0.30 * geo + 0.25 * cause + 0.20 * words).otherwise(0.35 * time + 0.35 * cause + 0.30 * words)


def correlation_type(time: Column, geo: Column, cause: Column, words: Column) -> Column:
    strong = (geo > 0.5).cast("int") + (cause > 0.5).cast("int") + (time > 0.5).cast("int") + (words > 0.3).cast("int")
    return F.when(strong >= 3, "multi_factor").when(cause >= 0.8, "causal_chain").when((geo >= 0.7) & (time >= 0.5), "geo_temporal").otherwise("keyword_overlap")


def risk(severity: Column, reliability: Column, sources: Column, age_hours: Column) -> Column:
    s = R.by_severity(R.SCORE_RISK, severity, 8)
    r = R.js_round(R.clamp(reliability, 0.0, 1.0) * 25)
    c = F.when(sources >= 4, 20).when(sources == 3, 15).when(sources == 2, 10).otherwise(5)
    t = F.when(age_hours <= 1, 15).when(age_hours <= 6, 12).when(age_hours <= 24, 8).when(age_hours <= 168, 4).otherwise(1)
    return R.clamp((s + r + c + t).cast("long"), 0, 100)


def risk_level(score: Column) -> Column:
    return R.ladder(score, [(75, "critical"), (50, "high"), (25, "medium")], "low")


def band(score: Column) -> Column:
    return R.ladder(score, [(80, "Critical"), (60, "High"), (40, "Elevated"), (20, "Moderate")], "Low")


def reliability(base: Column, severity: Column, category: Column, summary: Column, location: Column, tags: Column, state_media: Column, sources: Column, language: Column) -> Column:
    """A signal's reliability from its source's, without the random part; 0.05 to 0.99, three digits."""
    def points(*steps):
        out = F.when(*steps[0])
        for step in steps[1:]:
            out = out.when(*step)
        return out.otherwise(0.0)

    soft = category.isin("culture", "sports", "other", "space", "science")
    total = (
        base
        + points((summary, 0.02)) + points((location, 0.02)) + points((tags >= 3, 0.01), (tags == 0, -0.02))
        + points((soft & (severity == "critical"), -0.15), (soft & (severity == "high"), -0.08))
        + points((state_media & category.isin("conflict", "geopolitics", "elections", "security"), -0.10), (state_media, -0.03))
        + points(((sources <= 1) & (severity == "critical"), -0.15), ((sources <= 1) & (severity == "high"), -0.08), ((sources <= 1) & (severity == "medium"), -0.03))
        + points((sources >= 3, 0.05), (sources >= 2, 0.02))
        + (tags % 7) * 0.005 + points((summary & location, 0.01)) + points((language != "en", -0.01))
    )
    return F.floor(R.clamp(total, 0.05, 0.99) * 1000 + 0.5) / 1000


def severity_cap(sources: Column, category: Column) -> Column:
    """The most severe label that a number of sources supports."""
    return F.when(sources >= 3, "critical").when(sources >= 2, "high").when(category.isin("disaster", "health", "security"), "high").otherwise("medium")


def capped_severity(severity: Column, sources: Column, category: Column) -> Column:
    return R.severity_of(F.least(R.by_severity(R.RANK_4, severity, 0), R.by_severity(R.RANK_4, severity_cap(sources, category))))


def alert_tier(severity: Column, reliability_: Column, category: Column) -> Column:
    critical = severity == "critical"
    raised = category.isin("breaking", "conflict", "disaster")
    return F.when(critical & ((reliability_ >= 0.65) | (category == "breaking")), "FLASH").when(critical | (severity == "high") | raised, "PRIORITY").otherwise("ROUTINE")


def corroboration_boost(sources: Column, categories: Column, severity: Column) -> Column:
    base = F.least(0.07 * (sources - 1), F.lit(0.20))
    base = F.when(categories >= 3, F.least(base + 0.05, F.lit(0.25))).when(categories >= 2, F.least(base + 0.03, F.lit(0.20))).otherwise(base)
    factor = F.when(severity == "critical", 1.15).when(severity == "high", 1.10).otherwise(1.0)
    return F.when(sources >= 2, F.least(base * factor, F.lit(0.30))).otherwise(0.0)


def virality(sources: Column, age_hours: Column) -> Column:
    """Null below three sources."""
    return F.when(sources >= 8, "viral").when((sources >= 3) & (age_hours < 4), "spreading").when(sources >= 3, "multi_source")


def escalation(current: Column, previous: Column, weighted: Column) -> Column:
    """0 to 100: up to 40 points for volume against the window before, up to 60 for severity."""
    volume = F.least(F.lit(3.0), current / F.when(previous > 0, previous).otherwise(1)) / 3 * 40
    severity = weighted / (F.when(current > 0, current).otherwise(1) * 4) * 60
    return F.when(current == 0, 0).otherwise(R.clamp(R.js_round(volume + severity), 0, 100)).cast("long")


def escalation_level(score: Column) -> Column:
    return R.ladder(score, [(80, "Critical"), (60, "High"), (40, "Elevated"), (20, "Moderate")], "Calm")


def trend(now: Column, before: Column, step: Column | float) -> Column:
    return F.when(now > before + step, "rising").when(now < before - step, "falling").otherwise("stable")


def momentum(delta: Column) -> Column:
    return F.when(delta > 100, "surging").when(delta > 30, "rising").when(delta > -20, "steady").otherwise("cooling")
