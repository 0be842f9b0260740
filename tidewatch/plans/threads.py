"""Narrative threads of reports as they come, and where these stand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bind import AS_OF, Views, with_views
from ..functions import ranks as R
from ..operators import threads as TH
from ..streaming import streams as ST
from .core import RANK4, S
from .joins import TRI
from .registry import query

NOW = f"TIMESTAMP '{AS_OF}'"
_alike = "(len(list_intersect(g, t.g)) / len(list_distinct(list_concat(g, t.g))))"
_base = "(CASE WHEN len(list_intersect(tags, t.tags)) >= 2 THEN least(0.4::DOUBLE, len(list_intersect(tags, t.tags)) * 0.1::DOUBLE) ELSE 0::DOUBLE END + CASE WHEN category = t.category THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN country_code IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN region = t.region THEN 0.1::DOUBLE ELSE 0 END)"
_new = "{'thread': id, 'g': g, 'category': category, 'region': region, 'tags': tags, 'waits': []::VARCHAR[], 'cycle': cycle, 'last': came}"
#: One recursion a country: each step puts its next report into the best active thread, or into a new one.
WALK = f"""r AS (SELECT country_code, id, epoch_us(created_at) AS came, epoch_us(created_at) // 300000000 AS cycle, category, region, list_distinct(tags) AS tags, {TRI.replace("lower(n)", "lower(substr(title, 1, 200))")} AS g, row_number() OVER (PARTITION BY country_code ORDER BY created_at, id) AS k FROM signals),
    walk AS (SELECT DISTINCT country_code, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS thread, NULL::DOUBLE AS relevance, list_filter([{_new}], lambda t: t.last IS NULL) AS threads FROM r
        UNION ALL SELECT country_code, k, id, coalesce(best.thread, id), coalesce(round(best.score, 3), 1.0),
            CASE WHEN best.thread IS NULL THEN list_append(live, {_new}) ELSE list_transform(live, lambda t: CASE WHEN t.thread = best.thread THEN struct_update(t, waits := list_distinct(list_concat(t.waits, tags)), cycle := cycle, last := came) ELSE t END) END
        FROM (SELECT *, list_filter(scored, lambda s: s.score = list_max(list_transform(scored, lambda q: q.score)))[1] AS best
            FROM (SELECT *, list_filter(list_transform(live, lambda t: {{'thread': t.thread, 'score': {_base} + CASE WHEN {_base} > 0.1::DOUBLE AND {_alike} >= 0.35::DOUBLE THEN {_alike} * 0.3::DOUBLE ELSE 0 END}}), lambda s: s.score >= 0.3::DOUBLE) AS scored
                FROM (SELECT r.*, list_transform(list_filter(w.threads, lambda t: t.last >= r.came - 43200000000), lambda t: CASE WHEN t.cycle < r.cycle THEN struct_update(t, tags := list_distinct(list_concat(t.tags, t.waits)), waits := []::VARCHAR[]) ELSE t END) AS live
                    FROM walk w JOIN r ON r.country_code = w.country_code AND r.k = w.k + 1)))),
    placed AS (SELECT id, thread, relevance FROM walk WHERE k > 0)"""
SUMMED = f"""{WALK}, threads AS (SELECT thread, arg_min(title, (created_at, x.id)) AS title, arg_min(category, (created_at, x.id)) AS category, arg_min(region, (created_at, x.id)) AS region, arg_min(country_code, (created_at, x.id)) AS country_code, arg_max(severity, {RANK4}) AS peak,
    count(*) AS n, count(DISTINCT source_id) AS sources, min(created_at) AS first_seen, max(created_at) AS last_seen,
    CASE WHEN date_sub('second', max(created_at), {NOW}) > 648000 THEN 'resolved' WHEN date_sub('second', max(created_at), {NOW}) > 43200 THEN 'stable' WHEN count(*) >= 5 THEN 'escalating' ELSE 'developing' END AS status FROM placed JOIN signals x USING (id) GROUP BY thread)"""


def recursive(body: str) -> str:
    return with_views(body, S).replace("WITH", "WITH RECURSIVE", 1)


def summed(v: Views):
    return TH.summed(TH.assigned(v.signals), v.signals, v.as_of)


@query("k6_online_threads", recursive(f"{WALK} SELECT * FROM placed"))
def _(v: Views):
    """Every report's thread: the best of its country's active ones, or a new one."""
    return TH.assigned(v.signals)


@query("k6_stream_threads", recursive(f"{WALK} SELECT * FROM placed"))
def _(v: Views):
    """The same as a real stream of twelve micro-batches, with the active threads as keyed state."""
    return ST.run_available(ST.threads_of(ST.replayed(v.signals, "created_at")))


@query("k8_thread_lifecycle", recursive(f"{SUMMED} SELECT * FROM threads"))
def _(v: Views):
    """A row a thread, with where it stands."""
    return summed(v)


@query("k3_recent_threads", recursive(f"{SUMMED} SELECT * FROM threads ORDER BY last_seen DESC, thread LIMIT 100"))
def _(v: Views):
    return summed(v).orderBy(F.desc("last_seen"), "thread").limit(100)


@query(
    "w7_thread_momentum",
    recursive(
        f"""{WALK}, t AS (SELECT thread, list({RANK4} + 1 ORDER BY created_at DESC, x.id DESC)[1:6] AS x, count(*) FILTER (created_at > {NOW} - INTERVAL 6 HOURS) AS n, count(*) FILTER (created_at > {NOW} - INTERVAL 12 HOURS AND created_at <= {NOW} - INTERVAL 6 HOURS) AS before FROM placed JOIN signals x USING (id) GROUP BY 1)
    SELECT thread, n, before, CASE WHEN n > 1.5 * before AND n > 0 OR len(x) >= 6 AND list_sum(x[1:3]) > 1.2 * list_sum(x[4:6]) THEN 'escalating' WHEN len(x) >= 6 AND list_sum(x[1:3]) < 0.8 * list_sum(x[4:6]) THEN 'easing' ELSE 'steady' END AS status FROM t"""
    ),
)
def _(v: Views):
    """Threads whose reports of six hours are half as many again as those of the six before, or whose last three are more severe than the three before."""
    rows = TH.assigned(v.signals).join(v.signals.select("id", "created_at", R.by_severity(R.RANK_5).alias("rank")), "id")
    newest = Window.partitionBy("thread").orderBy(F.desc("created_at"), F.desc("id"))
    at, six, twelve = F.col("created_at"), R.hours_before(v.as_of, 6), R.hours_before(v.as_of, 12)
    nth = rows.withColumn("nth", F.row_number().over(newest))
    over = lambda low, high: F.coalesce(F.sum(F.when(F.col("nth").between(low, high), F.col("rank"))), F.lit(0))
    g = nth.groupBy("thread").agg(F.count_if(at > six).alias("n"), F.count_if((at > twelve) & (at <= six)).alias("before"), over(1, 3).alias("late"), over(4, 6).alias("early"), F.count("*").alias("all"))
    full = F.col("all") >= 6
    rises = ((F.col("n") > 1.5 * F.col("before")) & (F.col("n") > 0)) | (full & (F.col("late") > 1.2 * F.col("early")))
    return g.select("thread", "n", "before", F.when(rises, "escalating").when(full & (F.col("late") < 0.8 * F.col("early")), "easing").otherwise("steady").alias("status"))


@query("j29_thread_timeline", recursive(f"{WALK} SELECT thread, id, relevance, severity, row_number() OVER w AS nth, date_sub('second', lead(created_at) OVER w, created_at)::DOUBLE AS since_s FROM placed JOIN signals x USING (id) WINDOW w AS (PARTITION BY thread ORDER BY created_at DESC, id DESC) QUALIFY nth <= 50"))
def _(v: Views):
    """The last fifty reports of each thread, with the time since the one before."""
    return TH.timeline(TH.assigned(v.signals), v.signals)
