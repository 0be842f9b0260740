"""Clusters of correlated reports, what they raise, and their threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bind import AS_OF, Views, with_views
from ..functions import ranks as R
from ..functions.tables import STRATEGIC
from ..operators import clusters as G
from ..session import ensure_checkpoint_dir
from .core import RANK4, S
from .joins import PAIRS9, correlation_pairs
from .registry import query

NOW = f"TIMESTAMP '{AS_OF}'"
ENDS = f"{PAIRS9}, ends AS (SELECT a AS id, b AS other, score, kind FROM pairs UNION ALL SELECT b, a, score, kind FROM pairs)"
STARS = f"""{ENDS}, star AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS nth FROM ends QUALIFY nth < 12),
    skinds AS (SELECT id, kind FROM star GROUP BY id, kind QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(nth)) = 1),
    smem AS (SELECT DISTINCT id, id AS member, 0 AS nth FROM star UNION ALL SELECT id, other, nth FROM star),
    sfull AS (SELECT m.id, m.member, m.nth, x.category, x.source_id, x.severity, x.reliability, {RANK4.replace("severity", "x.severity", 1)} AS rank FROM smem m JOIN signals x ON x.id = m.member),
    ssum AS (SELECT id, count(*) AS n, arg_max(member, (rank, reliability, -nth)) AS primary_id, arg_max(severity, (rank, reliability, -nth)) AS severity, count(DISTINCT category) AS categories, count(DISTINCT source_id) AS sources FROM sfull GROUP BY id),
    stars AS (SELECT ssum.*, score, kind FROM ssum JOIN (SELECT id, round(avg(score), 6) AS score FROM star GROUP BY id) USING (id) JOIN skinds USING (id))"""
MEMBERS = f"""{ENDS}, met AS (SELECT e.id, x.created_at, e.other, e.score, e.kind FROM ends e JOIN signals x ON x.id = e.id JOIN signals y ON y.id = e.other WHERE (y.created_at, y.id) < (x.created_at, x.id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS r FROM met QUALIFY r < 12),
    kinds AS (SELECT id, kind FROM best GROUP BY id, kind QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(r)) = 1),
    arr AS (SELECT row_number() OVER (ORDER BY created_at, id) AS k, id, others, met, kind FROM (SELECT id, min(created_at) AS created_at, list(other ORDER BY r) AS others, avg(score) AS met FROM best GROUP BY id) JOIN kinds USING (id)),
    walk AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS cluster, 0 AS size, []::BIGINT[] AS joined, MAP([]::BIGINT[], []::BIGINT[]) AS owner, MAP([]::BIGINT[], []::INT[]) AS sizes
        UNION ALL SELECT k, id, coalesce(home, id), coalesce(sizes[home], 0), CASE WHEN home IS NULL THEN list_prepend(id, others) WHEN sizes[home] < 12 THEN [id] ELSE [] END,
            CASE WHEN home IS NULL THEN map_concat(owner, map_from_entries(list_transform(list_prepend(id, others), lambda x: {{'k': x, 'v': id}}))) WHEN sizes[home] < 12 THEN map_concat(owner, MAP([id], [home])) ELSE owner END,
            CASE WHEN home IS NULL THEN map_concat(sizes, MAP([id], [len(others)::INT + 1])) WHEN sizes[home] < 12 THEN map_concat(sizes, MAP([home], [sizes[home] + 1])) ELSE sizes END
        FROM (SELECT a.k, a.id, a.others, w.owner, w.sizes, list_filter(list_transform(a.others, lambda x: w.owner[x]), lambda x: x IS NOT NULL)[1] AS home FROM walk w JOIN arr a ON a.k = w.k + 1)),
    entered AS (SELECT w.cluster, w.id AS came, unnest(w.joined) AS id, w.size + unnest(range(1, len(w.joined) + 1)) AS nth, CASE WHEN w.size = 0 THEN 0 ELSE 1 END AS step FROM walk w),
    mem AS (SELECT e.cluster, e.nth, e.step, CASE WHEN e.came = e.id THEN a.met END AS met, CASE WHEN e.came = e.id AND step = 0 THEN a.kind END AS first_kind, x.*, {RANK4.replace("severity", "x.severity", 1)} AS rank FROM entered e JOIN signals x USING (id) LEFT JOIN arr a ON a.id = e.came)"""
CLUSTERS = f"""{MEMBERS}, clusters AS (SELECT cluster, count(*) AS n, arg_max(id, (rank, step = 0, CASE WHEN step = 0 THEN reliability ELSE 0.0 END, -nth)) AS primary_id, arg_max(severity, (rank, step = 0, CASE WHEN step = 0 THEN reliability ELSE 0.0 END, -nth)) AS severity,
    count(DISTINCT category) AS categories, count(DISTINCT source_id) AS sources, round(list_reduce(list(met ORDER BY nth) FILTER (WHERE met IS NOT NULL), lambda m, v: (m + v) / 2), 6) AS score,
    CASE WHEN count(DISTINCT category) >= 3 AND max(step) > 0 THEN 'multi_factor' ELSE max(first_kind) END AS kind FROM mem GROUP BY cluster)"""


def recursive(body: str) -> str:
    return with_views(body, S).replace("WITH", "WITH RECURSIVE", 1)


def reports(v: Views):
    """The members of the extended clusters."""
    ensure_checkpoint_dir(v.spark)
    return G.members(correlation_pairs(v), v.signals)


@query("k1_star_clusters", with_views(f"{STARS} SELECT * FROM stars", S))
def _(v: Views):
    """What each report of the last day finds: at most eleven correlated ones, the main one, their sources and kind."""
    return G.stars(correlation_pairs(v), v.signals)


@query("k2_extended_clusters", recursive(f"{CLUSTERS} SELECT * FROM clusters"))
def _(v: Views):
    return G.clusters(reports(v))


@query(
    "k4_corroboration",
    recursive(
        f"""{CLUSTERS}, base AS (SELECT cluster, severity AS worst, categories, least(0.07 * (sources - 1), 0.20)::DOUBLE AS b FROM clusters WHERE sources >= 2),
    cat AS (SELECT cluster, worst, CASE WHEN categories >= 3 THEN least(b + 0.05, 0.25) WHEN categories >= 2 THEN least(b + 0.03, 0.20) ELSE b END AS b FROM base),
    boost AS (SELECT cluster, least(b * CASE worst WHEN 'critical' THEN 1.15 WHEN 'high' THEN 1.10 ELSE 1.0 END, 0.30) AS boost FROM cat),
    up AS (SELECT id, cluster, boost, status, round(least(reliability + boost, 1.0), 6) AS raised FROM mem JOIN boost USING (cluster))
    SELECT id, cluster, round(boost, 6) AS boost, raised AS reliability, CASE WHEN status = 'pending' AND raised >= 0.65 THEN 'verified' ELSE status END AS status FROM up"""
    ),
)
def _(v: Views):
    rows = reports(v)
    return G.corroborated(rows, G.clusters(rows))


@query(
    "k5_delayed_rescore",
    with_views(
        f"""{STARS}, waiting AS (SELECT * FROM signals WHERE created_at <= {NOW} - INTERVAL 30 MINUTES AND created_at >= {NOW} - INTERVAL 120 MINUTES AND coalesce(source_count <= 1, true) ORDER BY created_at DESC, id DESC LIMIT 50)
    SELECT w.id, k.n IS NOT NULL AS corroborated, coalesce(k.sources, 1) AS sources, CASE WHEN k.sources >= 2 AND w.severity = 'medium' AND w.category IN ({", ".join(f"'{c}'" for c in STRATEGIC)}) THEN 'high' ELSE w.severity END AS severity FROM waiting w LEFT JOIN stars k USING (id)""",
        S,
    ),
)
def _(v: Views):
    late, early = R.hours_before(v.as_of, 0.5), R.hours_before(v.as_of, 2)
    waiting = v.signals.filter((F.col("created_at") <= late) & (F.col("created_at") >= early))
    return G.rescored(waiting, correlation_pairs(v), v.signals)


RANK5 = f"({RANK4} + 1)"


@query(
    "k9_thread_build",
    recursive(
        f"""{MEMBERS}, run AS (SELECT *, floor(avg({RANK5}) OVER (PARTITION BY cluster ORDER BY nth) * 100 + 0.5) / 100 AS mean FROM mem)
    SELECT cluster, arg_max(title, (rank, -nth)) AS title, arg_max(severity, (rank, -nth)) AS peak, arg_min(category, nth) AS category, arg_min(region, nth) AS region, count(*) AS n, count(DISTINCT source_id) AS sources, round(avg(reliability), 6) AS reliability, list(mean ORDER BY nth) AS trajectory, min(created_at) AS first_seen, max(created_at) AS last_seen FROM run GROUP BY cluster"""
    ),
)
def _(v: Views):
    return G.threads(reports(v))
