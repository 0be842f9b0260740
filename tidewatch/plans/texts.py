"""Text: keys, classification, language, entities, claims, search, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bind import Views
from ..functions import classify as K
from ..functions import ranks as R
from ..functions import tables as W
from ..functions import text as X
from ..operators import basic as B
from ..operators import graph as G
from ..operators import joins as J
from ..operators import pages as P
from ..operators import search as SE
from ..operators import texts as T
from .core import S
from .registry import query

D = "docs"
WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(title), '\W+'), lambda w: length(w) >= 3))"
STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
SIG = rf"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '\W+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP}))))"
EVENT_STOP = ", ".join(f"'{w}'" for w in W.EVENT_STOP_WORDS)
#: A list of strings as SQL.
texts = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def case(expr, rules, default):
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{label}'" for label, p in rules) + f" ELSE {default} END"


def any_word(expr, rules, default):
    """The label of the first rule one of whose words is in the expression, in lower case."""
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({expr}), '{w.lower()}')" for w in words) + f" THEN '{label}'" for label, words in rules) + f" ELSE {default} END"


FULL = "lower(concat_ws(' ', title, body))"
CATEGORY = case(FULL, W.CATEGORY_RULES, "'other'")
PRINT = rf"substr(md5(concat_ws(':', category, array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({EVENT_STOP})))[1:5], ':'))), 1, 16)"
CLASSED = f"c AS (SELECT *, {CATEGORY} AS category FROM docs)"


def full(v: Views):
    return F.concat_ws(" ", "title", "body")


def classed(v: Views):
    return v.docs.withColumn("category", K.category(full(v)))


@query("s1_tokenize", f"SELECT id, {SIG} AS words FROM docs", D)
def _(v: Views):
    return v.docs.select("id", F.array_sort(X.words(F.col("title"), 3, X.STOP_WORDS)).alias("words"))


@query("s2_significant_words", r"SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), '\s+'), lambda w: length(w) >= 3))) AS words FROM docs", D)
def _(v: Views):
    bare = F.regexp_replace(F.lower("title"), r"[^a-z0-9\s-]", "")
    return v.docs.select("id", F.array_sort(X.words(bare, 3, None, r"\s+")).alias("words"))


@query("s3_fingerprint", f"{CLASSED} SELECT id, {PRINT} AS fingerprint FROM c", D)
def _(v: Views):
    return classed(v).select("id", X.event_fingerprint(F.col("title"), F.col("category")).alias("fingerprint"))


def topic_sql(n):
    return rf"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+'), lambda w: length(w) > 3)[1:{n}]), '_')"


@query("s4_topic_key", f"SELECT id, {topic_sql(5)} AS topic FROM docs", D)
def _(v: Views):
    return v.docs.select("id", X.topic_key(F.col("title"), 5).alias("topic"))


@query("s5_feed_key", f"SELECT {topic_sql(6)} AS key, count(*) AS n, min(id) AS first_id FROM docs GROUP BY 1", D)
def _(v: Views):
    return v.docs.groupBy(X.topic_key(F.col("title"), 6).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("s6_title_overlap", rf"w AS (SELECT id, {WORDS} AS w FROM docs) SELECT a.id, round(len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS overlap FROM w a JOIN w b ON b.id = a.id + 1 WHERE len(a.w) + len(b.w) > 0", D)
def _(v: Views):
    w = v.docs.select("id", X.words(F.col("title")).alias("w"))
    nxt = w.select((F.col("id") - 1).alias("id"), F.col("w").alias("x"))
    return w.join(nxt, "id").filter(F.size("w") + F.size("x") > 0).select("id", F.round(X.jaccard(F.col("w"), F.col("x")), 6).alias("overlap"))


NATION_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(n_name), '[^a-z0-9]+'), lambda w: length(w) > 0), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("s30_trigram_similarity", f"WITH t AS (SELECT n_nationkey AS id, {NATION_TRI} AS g FROM nation) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM t a JOIN t b ON a.id < b.id WHERE len(list_intersect(a.g, b.g)) > 0")
def _(v: Views):
    """Names meet by the trigrams that they share, so that only pairs with one are made."""
    t = v.table("nation").select(F.col("n_nationkey").alias("key"), X.trigrams(F.col("n_name")).alias("g")).withColumn("n", F.size("g"))
    grams = t.select("key", "n", F.explode("g").alias("gram"))
    met = J.suffixed(grams, "_a").join(J.suffixed(grams, "_b"), (F.col("gram_a") == F.col("gram_b")) & (F.col("key_a") < F.col("key_b")))
    pairs = met.groupBy("key_a", "key_b", "n_a", "n_b").agg(F.count("*").alias("common"))
    return pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.round(F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")), 6).alias("similarity"))


@query("s20_category_severity", f"{CLASSED} SELECT id, category, {case(FULL, W.SEVERITY_RULES, "CASE WHEN category = 'breaking' THEN 'high' WHEN category IN ('disaster', 'conflict') THEN 'medium' ELSE 'low' END")} AS severity FROM c", D)
def _(v: Views):
    return classed(v).select("id", "category", K.severity(full(v), F.col("category")).alias("severity"))


@query("s20_tags", "SELECT id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches({FULL}, '{p}') THEN '{t}' END" for t, p in W.TAG_RULES) + "], lambda x: x IS NOT NULL)[1:5] AS tags FROM docs", D)
def _(v: Views):
    return v.docs.select("id", K.tags(full(v)).alias("tags"))


@query("s21_recalibration", "SELECT id, CASE WHEN category = 'health' AND severity IN ('critical', 'high', 'medium') THEN 'low' WHEN (category = 'economy' OR k % 13 = 0) AND severity IN ('critical', 'high') THEN 'medium' ELSE severity END AS severity FROM signals", S)
def _(v: Views):
    renamed = F.when(F.col("category") == "health", "other").when(F.col("category") == "economy", "culture").otherwise(F.col("category"))
    return v.signals.select("id", K.recalibrated(F.col("severity"), renamed, F.col("k") % 13 == 0).alias("severity"))


_counts = {lang: f"len(list_filter(w, lambda x: list_contains({texts(own)}, x)))" for lang, own in W.LANGUAGE_WORDS.items()}
_best = f"greatest({', '.join(W.LANGUAGE_WORDS)})"
_scripts = " ".join(f"WHEN regexp_matches(body, '[{chr(a)}-{chr(b)}]') THEN '{lang}'" for lang, a, b in W.SCRIPTS)
_latin = " ".join(f"WHEN {lang} = {_best} THEN '{lang}'" for lang in W.LANGUAGE_WORDS)


@query("s22_language_detect", "c AS (SELECT id, body, regexp_split_to_array(lower(body), '\\W+') AS w FROM docs), n AS (SELECT id, body, " + ", ".join(f"{e} AS {lang}" for lang, e in _counts.items()) + f" FROM c) SELECT id, CASE {_scripts} WHEN {_best} = 0 THEN 'en' {_latin} END AS language FROM n", D)
def _(v: Views):
    return v.docs.select("id", K.language(F.col("body")).alias("language"))


@query("s23_news_ladder", f"SELECT id, {case(FULL, W.NEWS_CATEGORY, 'source')} AS category, {case(FULL, W.NEWS_SEVERITY, chr(39) + 'low' + chr(39))} AS severity FROM docs", D)
def _(v: Views):
    return v.docs.select("id", K.news_category(full(v), F.col("source")).alias("category"), K.news_severity(full(v)).alias("severity"))


#: Texts are invented; each says one place's word besides, or none.
_PLACE_WORDS = [w for *_, ws in W.PLACES for w in ws] + ["nowhere"] * 9
_PLACE_RULES = [(name, ws) for name, *_, ws in W.PLACES]
_places = "p(place, country_code, lat, lng) AS (VALUES " + ", ".join(f"('{n}', '{c}', {a}::DOUBLE, {o}::DOUBLE)" for n, c, a, o, _ in W.PLACES) + ")"


@query("s24_geo_inference", f"{_places}, t AS (SELECT id, source, lower(concat_ws(' ', title, body, {texts(_PLACE_WORDS)}[1 + id % {len(_PLACE_WORDS)}])) AS said FROM docs), f AS (SELECT id, source, {any_word('said', _PLACE_RULES, 'NULL')} AS place FROM t) SELECT id, coalesce(f.place, source) AS place, country_code, lat, lng FROM f LEFT JOIN p ON f.place = p.place", D)
def _(v: Views):
    """The place that a report's words hint at, the first rule wins; else its source's home."""
    word = F.element_at(F.array(*map(F.lit, _PLACE_WORDS)), (1 + F.col("id") % len(_PLACE_WORDS)).cast("int"))
    found = v.docs.select("id", "source", K.first_word(F.concat_ws(" ", "title", "body", word), _PLACE_RULES, None).alias("hint"))
    known = F.create_map(*[x for n, c, a, o, _ in W.PLACES for x in (F.lit(n), F.struct(F.lit(c).alias("code"), F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lng")))])
    at = F.try_element_at(known, F.col("hint"))
    return found.select("id", F.coalesce("hint", "source").alias("place"), at["code"].alias("country_code"), at["lat"].alias("lat"), at["lng"].alias("lng"))


@query("s24_gazetteer", "t AS (SELECT d.id, lower(concat_ws(' ', body, n_name)) AS said FROM docs d JOIN nation ON n_nationkey = d.id % 25), m AS (SELECT t.id, n_name, row_number() OVER (PARTITION BY t.id ORDER BY length(n_name) DESC, n_name) AS r FROM t JOIN nation ON contains(said, lower(n_name))) SELECT id, n_name AS place FROM m WHERE r = 1", D)
def _(v: Views):
    """The longest name of a small gazetteer that is in the text: one pass a name, the longest first."""
    names = v.table("nation").agg(F.array_sort(F.collect_set("n_name")).alias("names"))  # one row, as the gazetteer is small
    home = v.table("nation").select((F.col("n_nationkey").cast("long")).alias("home"), "n_name")
    said = v.docs.select("id", "body", (F.col("id") % 25).alias("home")).join(F.broadcast(home), "home").select("id", F.lower(F.concat_ws(" ", "body", "n_name")).alias("said"))
    found = F.filter("names", lambda n: F.contains("said", F.lower(n)))
    best = F.array_sort(F.transform(found, lambda n: F.struct((-F.length(n)).alias("size"), n.alias("name"))))
    return said.join(F.broadcast(names)).select("id", F.get(best, F.lit(0))["name"].alias("place")).filter("place is not null")


@query("s25_s27_name_candidates", r"c AS (SELECT id, unnest(list_distinct(list_filter(regexp_split_to_array(body, '[^A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}')))) AS name FROM docs) SELECT name, count(*) AS docs FROM c GROUP BY name HAVING count(*) >= 5", D)
def _(v: Views):
    return T.names(v.docs, "[A-Z][a-z]{3,}").groupBy("name").agg(F.count("*").alias("docs")).filter("docs >= 5")


#: Customers stand for persons and get titles.
_TITLES = ["", "Dr. ", "Former Prime Minister ", "mrs ", "Deputy Minister ", "Prof. General ", "CEO  ", "Drive ", "acting chief "]
_titled = G.TITLED.replace("'", "''")


@query("s29_strip_titles", f"SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '(?i){W.HONORIFIC}', ''), '(?i){_titled}', ''), '(?i){_titled}', '')) AS bare FROM (SELECT c_custkey, {texts(_TITLES)}[1 + c_custkey % {len(_TITLES)}] || c_name AS name FROM customer)")
def _(v: Views):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (1 + F.col("c_custkey") % len(_TITLES)).cast("int"))
    return v.table("customer").select(F.col("c_custkey").alias("id"), G.plain_name(F.concat(title, "c_name")).alias("bare"))


_families = " UNION ALL ".join(f"SELECT id, {i} AS family, '{kind}' AS kind, body, unnest(regexp_extract_all(body, '{p}', 1)) AS claim, generate_subscripts(regexp_extract_all(body, '{p}', 1), 1) AS place FROM docs" for i, (kind, p) in enumerate(W.CLAIM_RULES))


CLAIMS = rf"""f AS ({_families}), t AS (SELECT id, family, kind, body, place, regexp_replace(claim, '^\s+|\s+$', '', 'g') AS claim FROM f),
    u AS (SELECT * FROM t WHERE length(claim) BETWEEN 20 AND 500 QUALIFY row_number() OVER (PARTITION BY id, regexp_replace(lower(claim), '\s+', ' ', 'g') ORDER BY family, place) = 1)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY family, place) AS place, kind, claim, substr(body, greatest(strpos(body, claim) - 100, 1), least(strpos(body, claim) - 1, 100) + length(claim) + 100) AS context FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY family, place) <= 50"""


@query(
    "s31_claims",
    CLAIMS,
    D,
)
def _(v: Views):
    return T.claims(v.docs)


@query("s31_claims_in_sql", CLAIMS, D)
def _(v: Views):
    """The same by a table function, called from SQL."""
    name = T.register_claims(v.spark)
    return v.spark.sql(f"SELECT d.id, c.* FROM {{docs}} d, LATERAL {name}(d.body) c", docs=v.docs)


#: Conversations are invented words; every turn says one of these besides.
_SAID = [
    "According to data shows 3.5 percent.", "I think maybe", "In my opinion it was false.", "The official report, like, um, confirmed 500 cases .", "nothing", "Officials denied it and so uh there is no evidence", "You know , it rose.it fell",
    "I MEAN, sort of right", "a million people might personally", "likely liking umbrella",
]
_said = f"said AS (SELECT *, concat_ws(' ', CASE WHEN turn % 3 > 0 THEN substr(text, 1, turn * 30) END, {texts(_SAID)}[1 + (conv_id * 7 + turn) % {len(_SAID)}]) AS said, {texts([k for k, _ in W.CLAIM_RULES])}[1 + (conv_id + turn) % 5] AS kind, (30 + (conv_id * 37 + turn * 11) % 70) / 100 AS trust FROM segments)"
_points = " + ".join(f"CASE WHEN regexp_matches(lower(said), '{p}') THEN {n} ELSE 0 END" for p, n in W.CLAIM_POINTS) + "".join(f" + CASE WHEN kind = '{k}' THEN {n} ELSE 0 END" for k, n in W.CLAIM_KINDS.items())


def spoken(v: Views):
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (1 + n % len(words)).cast("int"))
    own = F.when(F.col("turn") % 3 > 0, F.expr("substr(text, 1, int(turn * 30))"))
    said = F.concat_ws(" ", own, pick(_SAID, F.col("conv_id") * 7 + F.col("turn")))
    return v.segments.select("conv_id", "turn", said.alias("said"), pick([k for k, _ in W.CLAIM_RULES], F.col("conv_id") + F.col("turn")).alias("kind"), ((30 + (F.col("conv_id") * 37 + F.col("turn") * 11) % 70) / F.lit(100.0)).alias("trust"))


@query("s32_claim_confidence", f"{_said} SELECT conv_id, turn, least(100, greatest(0, {W.CLAIM_BASE} + {_points} + CASE WHEN length(said) < {W.CLAIM_SHORT[0]} THEN {W.CLAIM_SHORT[1]} ELSE 0 END + CASE WHEN length(said) > {W.CLAIM_LONG[0]} THEN {W.CLAIM_LONG[1]} ELSE 0 END)) / 100.0::DOUBLE AS confidence FROM said", "segments")
def _(v: Views):
    return spoken(v).select("conv_id", "turn", T.claim_confidence(F.col("said"), F.col("kind")).alias("confidence"))


@query(
    "s33_agreement",
    f"""{_said}, a AS (SELECT conv_id, trust::DOUBLE AS trust, len(list_filter({texts(W.CONTRADICTIONS)}, lambda w: contains(lower(said), w))) = 0 AS agrees FROM said),
    g AS (SELECT conv_id, count(*) FILTER (agrees) AS agree, count(*) FILTER (NOT agrees) AS disagree, round(least(1.0, greatest(0.0, 0.3 + sum(CASE WHEN agrees THEN trust ELSE -0.5 * trust END) / count(*) * 0.7)), 6)::DOUBLE AS score FROM a GROUP BY 1)
    SELECT *, CASE WHEN agree >= 3 AND score >= 0.7 THEN 'verified' WHEN disagree >= 2 THEN 'disputed' WHEN agree + disagree >= 2 AND score >= 0.5 THEN 'mixed' WHEN disagree >= 1 THEN 'disputed' ELSE 'unverified' END AS status FROM g""",
    "segments",
)
def _(v: Views):
    """Turns stand for what other sources say about a conversation's claim."""
    return T.verified(spoken(v).withColumnRenamed("said", "snippet"), "conv_id")


_unfilled = "said"
for _pattern in W.FILLERS:
    _unfilled = f"regexp_replace({_unfilled}, '(?i){_pattern}', ' ', 'g')"


@query("s34_clean_spoken", rf"{_said} SELECT conv_id, turn, regexp_replace(regexp_replace(trim(regexp_replace({_unfilled}, '\s{{2,}}', ' ', 'g')), '\s([.,!?;:])', '\1', 'g'), '([.!?])\s*([a-z])', '\1 \2', 'g') AS clean FROM said", "segments")
def _(v: Views):
    return spoken(v).select("conv_id", "turn", T.clean_spoken(F.col("said")).alias("clean"))


_topics = ", ".join("(" + " + ".join(f"contains(lower(said), '{w}')::INT" for w in ws) + f') AS "{t}"' for t, ws in W.TOPICS.items())
_most = "greatest(" + ", ".join(f'"{t}"' for t in W.TOPICS) + ")"
#: Conversations are invented words; every turn says some word of the list besides.
_SPOKEN = [w for ws in W.TOPICS.values() for w in ws] + ["nothing of note"]


@query("s35_topic_argmax", f"b AS (SELECT conv_id, turn, concat_ws(' ', text, {texts(_SPOKEN)}[1 + (conv_id * 7 + turn) % {len(_SPOKEN)}]) AS said FROM segments), n AS (SELECT conv_id, turn, {_topics} FROM b) SELECT conv_id, turn, CASE WHEN {_most} <= 0 THEN 'General' " + " ".join(f"WHEN \"{t}\" = {_most} THEN '{t}'" for t in W.TOPICS) + " END AS topic FROM n", "segments")
def _(v: Views):
    word = F.element_at(F.array(*map(F.lit, _SPOKEN)), (1 + (F.col("conv_id") * 7 + F.col("turn")) % len(_SPOKEN)).cast("int"))
    said = F.concat_ws(" ", "text", word)
    return v.segments.select("conv_id", "turn", X.argmax_label({t: X.hits(said, ws) for t, ws in W.TOPICS.items()}, "General").alias("topic"))


@query("w11_scene_segmentation", "l AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER w > 3 OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS new FROM segments WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS scene FROM l) SELECT conv_id, CAST(scene AS BIGINT) AS scene, min(start_s) AS start_s, max(end_s) AS end_s, any_value(speaker) AS speaker, string_agg(text, ' ' ORDER BY turn) AS text FROM s GROUP BY conv_id, scene", "segments")
def _(v: Views):
    return T.scenes(v.segments, 3)


HOST = r"lower(regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1))"


_bait = " OR ".join(f"regexp_matches(lower(title), '{p.replace(chr(39), chr(39) * 2)}')" for p in W.CLICKBAIT)
#: Pages stand for reports: some come from known farms and bait clicks, and a hundred of them are published an hour.
_BAIT = ["You won't believe it", "Breaking: news", "a report", "breaking-even", "Top 10 ways", "viral video today", "Stop!!"]


@query(
    "s36_slop_score",
    rf"""WITH p AS (SELECT page_id, url, html, CASE WHEN page_id % 7 = 0 THEN {texts(W.CONTENT_FARMS)}[1 + page_id % {len(W.CONTENT_FARMS)}] ELSE {HOST} END AS host, regexp_extract(html, '<h1>([^<]*)', 1) || ' ' || {texts(_BAIT)}[1 + page_id % {len(_BAIT)}] AS title, regexp_extract(html, '<p>([^<]*)', 1) AS body FROM pages),
    q AS (SELECT *, row_number() OVER (PARTITION BY host, page_id // 100 ORDER BY page_id) AS n FROM p)
    SELECT page_id, round(least(1.0, CASE WHEN list_contains({texts(W.CONTENT_FARMS)}, host) THEN 0.40 ELSE 0 END + 0.15 + CASE WHEN {_bait} THEN 0.10 ELSE 0 END + CASE WHEN length(trim(body)) > 0 AND length(trim(body)) < 100 THEN 0.10 ELSE 0 END + CASE WHEN n > 10 THEN 0.10 ELSE 0 END + CASE WHEN regexp_matches(url, '^https?://[^/]+/?$') THEN 0.05 ELSE 0 END), 2)::DOUBLE AS slop FROM q""",
)
def _(v: Views):
    """Blocklist, byline, nine patterns of titles, thin bodies, cadence by domain and hour, bare paths."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (1 + F.col("page_id") % len(words)).cast("int"))
    host = F.when(F.col("page_id") % 7 == 0, pick(W.CONTENT_FARMS)).otherwise(X.host(F.col("url")))
    p = v.table("pages").select("page_id", "url", host.alias("host"), F.concat_ws(" ", F.regexp_extract("html", "<h1>([^<]*)", 1), pick(_BAIT)).alias("title"), F.regexp_extract("html", "<p>([^<]*)", 1).alias("body"))
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("host", F.floor(F.col("page_id") / 100)).orderBy("page_id")))
    return p.select("page_id", K.slop(F.col("host"), F.lit(False), F.col("title"), F.col("body"), F.col("n") > 10, F.col("url").rlike(r"^https?://[^/]+/?$")).alias("slop"))


@query(
    "s37_domain_verdict",
    rf"""WITH h AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN {texts(W.CONTENT_FARMS)}[1 + page_id % {len(W.CONTENT_FARMS)}] ELSE {HOST} END AS host FROM pages),
    d AS (SELECT host, CASE WHEN min(page_id) % 5 > 0 THEN ((20 + min(page_id) * 37 % 80) / 100)::DOUBLE END AS reliability, list_contains({texts(W.CONTENT_FARMS)}, host) AS farm FROM h GROUP BY host)
    SELECT host, reliability, CASE WHEN farm THEN 'unreliable' WHEN reliability IS NULL THEN 'unknown' WHEN reliability < 0.4 THEN 'unreliable' WHEN reliability < 0.65 THEN 'caution' ELSE 'trusted' END AS verdict,
        CASE WHEN farm THEN 'confirmed' WHEN reliability < 0.4 THEN 'suspected' ELSE 'clean' END AS farm,
        list_filter([CASE WHEN farm THEN host || ' is on the list of known content farms' END, CASE WHEN farm THEN 'Its texts are likely machine-made and unreliable' END,
            CASE WHEN reliability < 0.4 THEN 'Low reliability (' || printf('%.2f', reliability) || '): a poor source' WHEN reliability < 0.65 THEN 'Moderate reliability (' || printf('%.2f', reliability) || '): check claims elsewhere' END], lambda w: w IS NOT NULL) AS warnings FROM d""",
)
def _(v: Views):
    """Hosts, some of them known farms; the first page of a host says how reliable it is, if anything does."""
    farm = F.element_at(F.array(*map(F.lit, W.CONTENT_FARMS)), (1 + F.col("page_id") % len(W.CONTENT_FARMS)).cast("int"))
    first = F.min("page_id")
    d = v.table("pages").groupBy(F.when(F.col("page_id") % 7 == 0, farm).otherwise(X.host(F.col("url"))).alias("host")).agg(F.when(first % 5 > 0, (20 + first * 37 % 80) / F.lit(100.0)).alias("reliability"))
    return d.select("host", "reliability", *T.domain_verdict(F.col("host"), F.col("reliability")))


#: Hosts of the pages are invented; each page's outlet is one of these or its own host.
_OUTLETS = ["opinion.nytimes.com", "reuters.com", "foxnews.com", "data.census.gov", "news.un.org.example", "lse.edu", "sputnik.ru", "daily-liberty-news.com", "progressive-labor-justice.net", "bbc.co.uk", "live.bbc.co.uk", "a.b.infowars.com"]
_KNOWN = "MAP {" + ", ".join(f"'{k}': {s}" for k, s in W.BIAS.items()) + "}"
_hits = lambda words: f"len(list_filter(list_filter(regexp_split_to_array(regexp_replace(host, '\\.[^.]+$', ''), '[-_.]+'), lambda w: length(w) > 2), lambda w: list_contains({texts(words)}, w)))"
_ends = lambda ends: " OR ".join(f"ends_with(host, '{x}')" for x in ends)


@query(
    "s38_source_bias",
    rf"""WITH d AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {texts(_OUTLETS)}[1 + (page_id // 2) % {len(_OUTLETS)}] ELSE {HOST} END AS host FROM pages),
    k AS (SELECT page_id, host, {_KNOWN} AS known, string_split(host, '.') AS parts FROM d),
    p AS (SELECT *, known[host] AS seed, CASE WHEN len(parts) >= 3 THEN list_filter(list_transform(range(2, len(parts)), lambda i: known[array_to_string(parts[i:], '.')]), lambda s: s IS NOT NULL)[1] END AS parent, {_hits(W.LEFT_WORDS)} AS l, {_hits(W.RIGHT_WORDS)} AS r, {_ends(W.NEUTRAL_ENDS)} OR {" OR ".join(f"contains(host, '{x}.')" for x in W.NEUTRAL_ENDS)} AS neutral, {_ends(W.STATE_ENDS)} AS state FROM k),
    x AS (SELECT page_id, host, CASE WHEN seed IS NOT NULL THEN seed WHEN neutral THEN 0 WHEN parent IS NOT NULL THEN parent WHEN state THEN 0 WHEN l > 0 OR r > 0 THEN greatest(-0.75, least(0.75, (r - l) * 0.25)) END::DOUBLE AS score,
        CASE WHEN seed IS NOT NULL OR neutral THEN 'high' WHEN parent IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN seed IS NOT NULL THEN 'seed' WHEN neutral OR parent IS NOT NULL OR state OR l > 0 OR r > 0 THEN 'heuristic' ELSE 'unknown' END AS method FROM p)
    SELECT page_id, score, confidence, method, CASE WHEN score IS NULL THEN 'unknown' WHEN score <= -0.8 THEN 'far-left' WHEN score <= -0.4 THEN 'left' WHEN score <= -0.1 THEN 'center-left' WHEN score < 0.1 THEN 'center' WHEN score < 0.4 THEN 'center-right' WHEN score < 0.8 THEN 'right' ELSE 'far-right' END AS label FROM x""",
)
def _(v: Views):
    pick = F.element_at(F.array(*map(F.lit, _OUTLETS)), (1 + F.floor(F.col("page_id") / 2) % len(_OUTLETS)).cast("int"))
    d = v.table("pages").select("page_id", F.when(F.col("page_id") % 2 == 0, pick).otherwise(X.host(F.col("url"))).alias("host")).withColumn("b", K.bias(F.col("host")))
    return d.select("page_id", "b.score", "b.confidence", "b.method", F.when(F.col("b.score").isNull(), "unknown").otherwise(K.bias_label(F.col("b.score"))).alias("label"))


@query("x16_canonical_url", r"SELECT page_id, substr(md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:utm_[a-z]+|fbclid|gclid|ref|referrer)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '')), 1, 16) AS key FROM pages")
def _(v: Views):
    return v.table("pages").select("page_id", F.substring(F.md5(X.canonical_url(F.col("url"))), 1, 16).alias("key"))


@query("x11_media_urls", r"WITH u AS (SELECT page_id AS doc_id, unnest(list_distinct(regexp_extract_all(url || ' ' || html, 'https?://[^\s\"<>]+'))) AS url FROM pages) SELECT doc_id, url, CASE WHEN regexp_matches(url, 'youtube\.com|youtu\.be') THEN 'video' WHEN regexp_matches(url, '\.(mp3|m4a|ogg|wav)($|\?)') THEN 'audio' ELSE 'link' END AS kind FROM u")
def _(v: Views):
    return P.media_urls(v.table("pages").select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text")))


#: Titles of signals are invented; each says one more word of the lists.
_THREAT_WORDS = [w for _, ws in W.THREATS for w in ws] + [w for _, ws in W.ORIGINS for w in ws] + ["no threat"]
_said = lambda words: f"concat_ws(' ', title, {texts(words)}[1 + id % {len(words)}], {texts(words)}[1 + (id // 7) % {len(words)}])"


def said(words):
    pick = lambda n: F.element_at(F.array(*map(F.lit, words)), (1 + n % len(words)).cast("int"))
    return F.concat_ws(" ", "title", pick(F.col("id")), pick(F.floor(F.col("id") / 7)))


@query("s42_threat_kind", f"t AS (SELECT id, {_said(_THREAT_WORDS)} AS said FROM signals) SELECT {any_word('said', W.THREATS, chr(39) + 'unknown' + chr(39))} AS kind, {any_word('said', W.ORIGINS, 'NULL')} AS origin, count(*) AS n FROM t GROUP BY 1, 2", S)
def _(v: Views):
    t = v.signals.select(said(_THREAT_WORDS).alias("said"))
    return t.groupBy(K.first_word(F.col("said"), W.THREATS, "unknown").alias("kind"), K.first_word(F.col("said"), W.ORIGINS, None).alias("origin")).agg(F.count("*").alias("n"))


@query(
    "s42_digest",
    f"""t AS (SELECT {any_word('title', W.THREATS, chr(39) + 'unknown' + chr(39))} AS kind, {any_word('title', W.ORIGINS, 'NULL')} AS origin, created_at FROM (SELECT {_said(_THREAT_WORDS)} AS title, created_at FROM signals)),
    w AS (SELECT * FROM t WHERE created_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOURS), k AS (SELECT kind, count(*) AS n FROM w WHERE kind <> 'unknown' GROUP BY 1 ORDER BY n DESC, kind LIMIT 1), o AS (SELECT origin, count(*) AS n FROM w WHERE origin IS NOT NULL GROUP BY 1 ORDER BY n DESC, origin LIMIT 1),
    c AS (SELECT count(*) AS n, count(*) FILTER (created_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 HOURS) AS late FROM w)
    SELECT CASE WHEN c.n = 0 THEN 'No threat signals detected in the last 48 hours.' ELSE coalesce(k.n || ' ' || kind || ' signals', c.n || ' signals') || ' detected in 48h' || coalesce(' primarily attributed to ' || origin, '') || ' (stable — ' || late || ' signals in last 6h). Total signals: ' || c.n || '.' END AS digest FROM c LEFT JOIN k ON true LEFT JOIN o ON true""",
    S,
)
def _(v: Views):
    """One sentence about the threats of the last two days."""
    t = B.within_hours(v.signals, v.as_of, 48).select(said(_THREAT_WORDS).alias("said"), "created_at")
    t = t.select(K.first_word(F.col("said"), W.THREATS, "unknown").alias("kind"), K.first_word(F.col("said"), W.ORIGINS, None).alias("origin"), "created_at")
    top = lambda c: t.filter(F.col(c).isNotNull() & (F.col(c) != "unknown")).groupBy(c).agg(F.count("*").alias(f"{c}_n")).orderBy(F.desc(f"{c}_n"), c).limit(1)
    c = t.agg(F.count("*").alias("n"), F.count_if(F.col("created_at") > R.hours_before(v.as_of, 6)).alias("late"))
    row = c.join(F.broadcast(top("kind")), F.lit(True), "left").join(F.broadcast(top("origin")), F.lit(True), "left")  # one row each
    text = lambda x: F.col(x).cast("string")
    led = F.coalesce(F.concat(text("kind_n"), F.lit(" "), F.col("kind"), F.lit(" signals")), F.concat(text("n"), F.lit(" signals")))
    sentence = F.concat(led, F.lit(" detected in 48h"), F.coalesce(F.concat(F.lit(" primarily attributed to "), F.col("origin")), F.lit("")), F.lit(" (stable — "), text("late"), F.lit(" signals in last 6h). Total signals: "), text("n"), F.lit("."))
    return row.select(F.when(F.col("n") == 0, "No threat signals detected in the last 48 hours.").otherwise(sentence).alias("digest"))


_SHIP_WORDS = [w for _, ws in W.FLEETS for w in ws] + W.DARK_SHIPS + ["a ship"]


@query("s43_alias_match", f"t AS (SELECT id, category, {_said(_SHIP_WORDS)} AS said FROM signals), f AS (SELECT id, category, said, {any_word('said', W.FLEETS, 'NULL')} AS fleet FROM t) SELECT id, fleet, CASE WHEN category = 'conflict' AND fleet IS NOT NULL THEN 'carrier' WHEN {any_word('said', [('x', W.DARK_SHIPS)], 'NULL')} IS NOT NULL THEN 'dark_ship' ELSE 'vessel' END AS kind FROM f", S)
def _(v: Views):
    t = v.signals.select("id", "category", said(_SHIP_WORDS).alias("said"))
    return t.select("id", K.fleet(F.col("said")).alias("fleet"), K.vessel(F.col("said"), F.col("category") == "conflict").alias("kind"))


@query("s44_tickers", r"WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z]{3,5}')))) AS ticker FROM documents) SELECT ticker, count(*) AS docs FROM t WHERE ticker NOT IN ('THE', 'AND', 'MIT') GROUP BY ticker HAVING count(*) >= 2")
def _(v: Views):
    t = T.names(v.docs, "[A-Z]{3,5}").filter(~F.col("name").isin("THE", "AND", "MIT"))
    return t.groupBy(F.col("name").alias("ticker")).agg(F.count("*").alias("docs")).filter("docs >= 2")


@query("s45_amounts", "WITH t AS (SELECT o_orderkey, 'Exports → Port: $' || printf('%.1f', o_totalprice / 100000) || CASE o_orderkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'M' ELSE 'K' END AS title FROM orders), r AS (SELECT o_orderkey, regexp_extract(title, '\\$([0-9.]+)([BMK])', 1)::DOUBLE AS n, regexp_extract(title, '\\$([0-9.]+)([BMK])', 2) AS u, trim(split_part(title, '→', 1)) AS origin FROM t) SELECT o_orderkey, origin, round(n * CASE u WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 ELSE 1e3 END, 2) AS amount FROM r")
def _(v: Views):
    unit = F.element_at(F.array(F.lit("B"), F.lit("M"), F.lit("K")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    titles = v.table("orders").select("o_orderkey", F.concat(F.lit("Exports → Port: $"), X.fixed(F.col("o_totalprice") / 100000, 1), unit).alias("title"))
    return T.trade_amounts(titles).select("o_orderkey", "origin", "amount")


@query("s50_summary", "SELECT id, trim(array_to_string(regexp_extract_all(body, '[^.!?]+[.!?]')[1:2], '')) AS summary FROM docs", D)
def _(v: Views):
    return v.docs.select("id", X.first_sentences(F.col("body"), 2).alias("summary"))


@query("s51_date_helpers", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def _(v: Views):
    return v.table("events").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"))


@query("s59_search_fts", f"q AS (SELECT ['the', 'that', 'with'] AS w) SELECT id FROM docs, q WHERE list_has_all(list_distinct(regexp_split_to_array(lower(body), '\\W+')), q.w) AND len(list_filter(list_distinct(regexp_split_to_array(lower(body), '\\W+')), lambda x: starts_with(x, 'thin'))) > 0", D)
def _(v: Views):
    return T.full_text(v.docs, ["the", "that", "with"], prefix="thin").select("id")


@query("s60_ranked_search")
def _(v: Views):
    """Ranked search with BM25 weights and typing errors; checked against a plain scorer in tests."""
    return T.ranked_search(v.docs, ["that", "thin", "onthe"], 20)


#: Searches of documents: each a list of words, the first ones first.
SEARCHES = [["that", "thin", "onthe"], ["license", "software"], ["contact", "adress", "mail"], ["people", "goverment", "with"]]
_asked = ", ".join(f"({q}, {n}, '{w}', {2 if len(w) >= 8 else 1 if len(w) >= 4 else 0})" for q, ws in enumerate(SEARCHES) for n, w in enumerate(ws))
_tokens = lambda n, c: f"SELECT id, {n} AS attribute, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS position FROM (SELECT id, list_filter(regexp_split_to_array(lower({c}), '\\W+'), lambda x: length(x) > 0) AS w FROM docs)"
_each = lambda what: " + ".join(f"CASE WHEN words > {n} THEN {what.format(n=n)} ELSE 0 END" for n in range(3))
_least = lambda column: ", ".join(f"min({column}) FILTER (nth = {n}) AS {column}{n}" for n in range(3))


@query(
    "s60_rule_ranking",
    f"""asked(search, nth, asked, most) AS (VALUES {_asked}), post AS ({_tokens(0, "title")} UNION ALL {_tokens(1, "body")} UNION ALL {_tokens(2, "source")}),
    means AS (SELECT DISTINCT search, nth, word, levenshtein(word, asked) AS edits FROM (SELECT DISTINCT word FROM post) JOIN asked ON levenshtein(word, asked) <= most),
    hits AS (SELECT search, id, attribute, position, nth, edits FROM post JOIN means USING (word)),
    near AS (SELECT a.search, a.id, a.nth, min(CASE WHEN b.position >= a.position THEN greatest(b.position - a.position, 1) ELSE a.position - b.position + 1 END) AS near FROM hits a JOIN hits b ON a.search = b.search AND a.id = b.id AND a.attribute = b.attribute AND b.nth = a.nth + 1 AND b.position BETWEEN a.position - 8 AND a.position + 8 GROUP BY ALL),
    per AS (SELECT search, id, {_least("edits")}, {_least("attribute")} FROM hits GROUP BY ALL),
    lead AS (SELECT *, CASE WHEN edits0 IS NULL THEN 0 WHEN edits1 IS NULL THEN 1 WHEN edits2 IS NULL THEN 2 ELSE 3 END AS words FROM per WHERE edits0 IS NOT NULL),
    scored AS (SELECT l.search, l.id, words, {_each("edits{n}")} AS typos, CASE WHEN words > 1 THEN least(coalesce(x.near, 8), 8) ELSE 0 END + CASE WHEN words > 2 THEN least(coalesce(y.near, 8), 8) ELSE 0 END AS proximity, {_each("attribute{n}")} AS attribute, {_each("(edits{n} = 0)::INT")} AS exact
        FROM lead l LEFT JOIN near x ON x.search = l.search AND x.id = l.id AND x.nth = 0 LEFT JOIN near y ON y.search = l.search AND y.id = l.id AND y.nth = 1)
    SELECT search, id, row_number() OVER (PARTITION BY search ORDER BY words DESC, typos, proximity, attribute, exact DESC, (id * 37) % 70 DESC, id) AS place, words, typos, proximity, attribute, exact FROM scored QUALIFY place <= 25""",
    D,
)
def _(v: Views):
    """The best 25 documents of each search, by rules one after the other."""
    docs = v.docs.withColumn("reliability", (F.col("id") * 37) % 70)
    return SE.ranked(SE.postings(docs, ["title", "body", "source"]), docs, SEARCHES, 25)


@query("s48_hashed_embedding")
def _(v: Views):
    return T.hashed_embedding(v.docs, 64)


@query("o8_federated", "r AS (SELECT 'signal' AS kind, id::VARCHAR AS key, row_number() OVER (ORDER BY id) AS r FROM signals WHERE title ILIKE '%place1%' UNION ALL SELECT 'part', p_partkey::VARCHAR, row_number() OVER (ORDER BY p_partkey) FROM part WHERE p_name ILIKE '%a%' UNION ALL SELECT 'user', c_custkey::VARCHAR, row_number() OVER (ORDER BY c_custkey) FROM customer WHERE c_name ILIKE '%1%') SELECT kind, key FROM r WHERE r <= 10", S)
def _(v: Views):
    hits = [("signal", v.signals.filter(F.col("title").ilike("%place1%")), "id"), ("part", v.table("part").filter(F.col("p_name").ilike("%a%")), "p_partkey"), ("user", v.table("customer").filter(F.col("c_name").ilike("%1%")), "c_custkey")]
    out = None
    for kind, df, key in hits:
        part = df.orderBy(key).limit(10).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


@query("z3_dedup_fingerprint", f"{CLASSED} SELECT {PRINT} AS fingerprint, count(*) AS n, min(id) AS first_id FROM c GROUP BY 1", D)
def _(v: Views):
    return classed(v).groupBy(X.event_fingerprint(F.col("title"), F.col("category")).alias("fingerprint")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("z2_content_hash", "SELECT substr(sha256(lower(trim(text))), 1, 32) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def _(v: Views):
    return v.table("documents").groupBy(F.substring(F.sha2(F.lower(F.trim("text")), 256), 1, 32).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


_q = lambda text: "'" + text.replace("'", "''") + "'"


def _plain(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, value in P.REFERENCES:
        x = f"replace({x}, {_q(name)}, {_q(value)})"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _clean(x: str) -> str:
    for pattern in P.noise_patterns():
        x = f"regexp_replace({x}, {_q(pattern)}, ' ', 'g')"
    return x


def _paragraphs(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {_q(P.BEGIN)})[2:], lambda t: {_plain(f'regexp_extract(t, {_q(P.TAKEN)}, 1)')}), lambda t: length(t) > {P.PARAGRAPH})"


_head, _start = f"body[1:{P.BODY}]", f"trim(body[1:{P.EXCERPT}])"


@query(
    "x10_article_text",
    f"""WITH c AS (SELECT page_id, html, {_clean("html")} AS clean FROM pages), n AS (SELECT page_id, html, clean, regexp_extract(clean, {_q(P.ARTICLE)}, 1) AS article FROM c),
    p AS (SELECT page_id, html, {_paragraphs("article")} AS inside, {_paragraphs("clean")} AS every FROM n),
    b AS (SELECT page_id, coalesce({", ".join(f"nullif({_plain(f'regexp_extract(html, {_q(x)}, 1)')}, '')" for x in P.TITLES)}, '') AS title, array_to_string(CASE WHEN len(inside) >= 2 THEN inside ELSE every END, chr(10) || chr(10)) AS body FROM p),
    k AS (SELECT page_id, title, CASE WHEN length(body) <= {P.BODY} THEN body WHEN strpos(reverse({_head}), ' .') > 0 AND length({_head}) - strpos(reverse({_head}), ' .') - 1 > {0.6 * P.BODY} THEN body[1:{P.BODY} - strpos(reverse({_head}), ' .')] ELSE {_head} END AS body FROM b),
    e AS (SELECT *, {_start} AS start FROM k WHERE length(body) >= {P.LEAST})
    SELECT page_id, title, body, CASE WHEN strpos(reverse(start), ' ') > 0 AND length(start) - strpos(reverse(start), ' ') > {0.7 * P.EXCERPT} THEN start[1:length(start) - strpos(reverse(start), ' ')] ELSE start END || '...' AS excerpt FROM e""",
)
def _(v: Views):
    """Titles, bodies and excerpts by patterns; held against a plain reader in tests, too."""
    return P.article_text(v.table("pages"))
