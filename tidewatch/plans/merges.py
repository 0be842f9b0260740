"""Entity merges and thread assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bind import Views
from ..operators import graph as G
from ..operators import joins as J
from ..operators.components import components
from ..session import ensure_checkpoint_dir
from .core import S
from .joins import TRI
from .registry import query

#: Parts stand for entities: their names get titles and endings, and doubles are mentions.
ENTITIES = """ent AS (SELECT min(p_partkey) AS id, name, type, count(*) AS mentions FROM (SELECT p_partkey, ['', 'president ', 'former prime minister ', 'dr ', 'the ', 'Minister '][1 + p_partkey % 6] || p_name || ['', ' group', ''][1 + p_partkey % 3] AS name, ['person', 'organisation'][1 + p_partkey % 2] AS type FROM part) GROUP BY name, type)"""
_TITLED = G.TITLED.replace("'", "''")
_bare = lambda x: f"regexp_replace(regexp_replace(lower({x}), '{_TITLED}', ''), '{_TITLED}', '')"
NAMES = f"n AS (SELECT id, type, name, mentions, CASE WHEN type = 'person' THEN {_bare('name')} ELSE lower(name) END AS n, {TRI.replace('lower(n)', 'lower(name)')} AS t FROM ent)"
_within = r"length(x.n) >= 4 AND length(y.n) >= 4 AND x.n <> y.n AND ((contains(y.n, x.n) AND length(y.n) > length(x.n) + 2) OR (contains(x.n, y.n) AND length(x.n) > length(y.n) + 2) OR (x.type = 'person' AND regexp_split_to_array(x.n, '\s+')[-1] = regexp_split_to_array(y.n, '\s+')[-1] AND length(regexp_split_to_array(x.n, '\s+')[-1]) >= 4 AND len(regexp_split_to_array(x.n, '\s+')) <> len(regexp_split_to_array(y.n, '\s+'))))"
CANDIDATES = f"""{ENTITIES}, {NAMES},
    spelt AS (SELECT * FROM (SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.t, y.t))::DOUBLE / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))), 6) AS similarity, 'trigram' AS match, 0 AS nth FROM n x JOIN n y ON x.type = y.type AND x.id < y.id WHERE x.name <> y.name AND 5 * len(list_intersect(x.t, y.t)) > 3 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))) ORDER BY similarity DESC, a, b LIMIT 100),
    people AS (SELECT * FROM n WHERE type = 'person' AND mentions >= 2 ORDER BY mentions DESC, id LIMIT 500), bodies AS (SELECT * FROM n WHERE type = 'organisation' AND mentions >= 2 ORDER BY mentions DESC, id LIMIT 300),
    found AS (SELECT * FROM spelt UNION ALL SELECT x.id, y.id, 0.95, 'title_strip', 1 FROM people x JOIN people y ON x.id < y.id AND x.n = y.n AND length(x.n) >= 4
        UNION ALL SELECT x.id, y.id, 0.88, 'containment', 2 FROM people x JOIN people y ON x.id < y.id AND {_within} UNION ALL SELECT x.id, y.id, 0.82, 'containment', 3 FROM bodies x JOIN bodies y ON x.id < y.id AND {_within}),
    best AS (SELECT * FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY nth) = 1) ORDER BY similarity DESC, a, b LIMIT 100),
    c AS (SELECT k.a, k.b, k.similarity::DOUBLE AS similarity, k.match, k.similarity >= CASE k.match WHEN 'title_strip' THEN 0.90 WHEN 'containment' THEN 0.85 ELSE 0.80 END AS merged, length(x.name) - length(y.name) AS longer, x.mentions AS ma, y.mentions AS mb, CASE WHEN x.mentions >= y.mentions THEN k.a ELSE k.b END AS spoken FROM best k JOIN n x ON x.id = k.a JOIN n y ON y.id = k.b),
    cand AS (SELECT a, b, similarity, match, merged, CASE WHEN match = 'trigram' THEN spoken WHEN longer > 0 AND mb < ma * 5 THEN a WHEN longer < 0 AND ma < mb * 5 THEN b ELSE spoken END AS keep FROM c)"""


def entities(v: Views):
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (1 + F.col("p_partkey") % len(words)).cast("int"))
    name = F.concat(pick("", "president ", "former prime minister ", "dr ", "the ", "Minister "), "p_name", pick("", " group", ""))
    rows = v.table("part").select("p_partkey", name.alias("name"), pick("person", "organisation").alias("type"))
    return rows.groupBy("name", "type").agg(F.min("p_partkey").alias("id"), F.count("*").alias("mentions"))


@query("e7_merge_candidates", f"WITH {CANDIDATES} SELECT * FROM cand")
def _(v: Views):
    """Pairs of entities that may be one: by spelling, titles and names in names; merged above their kind's threshold."""
    return G.merge_candidates(entities(v))


@query("e7_merge_components", f"WITH RECURSIVE {CANDIDATES}, u AS (SELECT a, b FROM cand WHERE merged UNION SELECT b, a FROM cand WHERE merged), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a) SELECT node, min(reach) AS kept FROM r GROUP BY node")
def _(v: Views):
    """Merged pairs closed over chains: each entity and the least one of those it is merged with."""
    ensure_checkpoint_dir(v.spark)
    pairs = G.merge_candidates(entities(v)).filter("merged")
    return components(pairs.select("a", "b")).select("node", F.col("label").alias("kept"))


@query("j12_containment", f"WITH {ENTITIES}, {NAMES} SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.type = y.type AND x.id < y.id WHERE {_within}")
def _(v: Views):
    """Names of one type of which one holds the other, over all entities."""
    return G.contained_names(entities(v))


SCORE = "least(0.4, 0.1 * len(list_intersect(s.tags, t.tags))) + CASE WHEN s.category = t.category THEN 0.2 ELSE 0 END + CASE WHEN s.country_code = t.country_code THEN 0.15 ELSE 0 END + CASE WHEN s.region = t.region THEN 0.1 ELSE 0 END"


@query(
    "k6_thread_assignment",
    f"""t AS (SELECT country_code AS thread, country_code, arg_min(category, (created_at, id)) AS category, arg_min(region, (created_at, id)) AS region, arg_min(tags, (created_at, id)) AS tags FROM signals WHERE severity = 'critical' GROUP BY country_code),
    c AS (SELECT s.id, t.thread, round({SCORE}, 4) AS score FROM signals s JOIN t ON s.category = t.category OR s.country_code = t.country_code WHERE s.severity = 'high')
    SELECT id, thread, score::DOUBLE AS score FROM c WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, thread) = 1""",
    S,
)
def _(v: Views):
    """The best of the active threads for each signal, if it is good enough; signals meet threads by category or country."""
    at = F.struct("created_at", "id")
    t = v.signals.filter("severity = 'critical'").groupBy("country_code").agg(*[F.min_by(c, at).alias(f"t_{c}") for c in ("category", "region", "tags")]).withColumnRenamed("country_code", "thread")
    s = v.signals.filter("severity = 'high'").select("id", "category", "country_code", "region", "tags")
    by_category = s.join(t, F.col("category") == F.col("t_category"))
    by_country = s.join(t, F.col("country_code") == F.col("thread"))
    same = lambda a, b, worth: F.when(F.col(a) == F.col(b), worth).otherwise(0.0)
    score = F.least(F.lit(0.4), 0.1 * F.size(F.array_intersect("tags", "t_tags"))) + same("category", "t_category", 0.2) + same("country_code", "thread", 0.15) + same("region", "t_region", 0.1)
    met = by_category.unionByName(by_country).select("id", "thread", F.round(score, 4).alias("score")).distinct().filter("score >= 0.3")
    return J.first_within(met, ["id"], [F.desc("score"), F.asc("thread")])
