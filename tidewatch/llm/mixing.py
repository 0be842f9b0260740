"""Mixing sources to target weights, with DataFrame functions only.

1. Each source's documents are dealt out to small groups by a seeded hash, and runs of
   groups make blocks of nearly equal numbers of words.
2. A pass draws every block of a source once, in a random order of its own.  A source with
   target t and size s is passed floor(t / s) times in full; then blocks are drawn until the
   target is met, the last one in part.  The number of draws is the source's quota.
3. A splitting tree deals the quotas out to the output shards: at each node the left half of
   the shards gets a multivariate hypergeometric draw of the node's quotas and the right half
   gets the rest, so every level keeps the quotas exactly.  Draws of many sources are made by
   chunks: first of the chunks' totals, then of the sources in each chunk.
4. A shard takes the next blocks, as many as its quota says, of each source's permuted draws.
   What a document gives is the sum of what shards draw from its block; shards are disjoint,
   and a shard's documents are shuffled by a random key.

There are at most BLOCKS blocks and one a source, whatever the input.  Nothing is ordered
over documents but those of the one group a source in which its last draw ends.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own,
last in the order; repeated doc_ids are separate rows, and rows alike in id and text share a
group and take alike (of the words that are left for m of them each takes an m-th, rounded
down); a source whose documents have no words has target 0; an empty table gives no rows;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import as_row

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of all sources together (besides one a source), and groups of a block.
BLOCKS, GROUPS = 1 << 13, 4
#: Sources whose quotas are split in one row of the tree.
CHUNK = 128
#: Rows of the tables of sources and of draws up to which they are broadcast; beyond, documents are joined to them by shuffles.
BROADCAST = 1 << 17
#: Words of a task's part of a shard, on average.
PART_WORDS = 1 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, weights: Sequence[int] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """(source, source_size) -> one row a source with its rank, weight and target.

    The targets fill like vessels of capacity ``most * source_size`` under one
    common level per unit of weight; the level is found from prefix sums over the
    sources in the order in which they fill.  One row a source: the work is small.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("ratio", "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", pick)
        .withColumn("capacity", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("capacity") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    level = (F.col("wanted") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        ranked.withColumn("level", level)
        .withColumn("open", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
        .withColumn("level", F.first("open", ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select(
            "source", "source_size", "rank", "weight",
            F.least(F.col("capacity"), F.coalesce(F.col("level") * F.col("weight"), F.col("capacity"))).alias("target"),
        )
    )


def _unit(*keys: Column) -> Column:
    """A uniform number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _draw(entries: Column, room: Column, total: Column, *keys: Column) -> Column:
    """A multivariate hypergeometric draw of ``room`` out of entries (id, n), ``total`` in sum: one hypergeometric draw an entry, conditioned on those before it."""

    def draw(state: Column, entry: Column) -> Column:
        blocks = F.when(entry["n"] > 0, F.sequence(F.lit(1).cast("long"), entry["n"])).otherwise(F.array().cast("array<bigint>"))

        def step(inner: Column, i: Column) -> Column:
            took = F.when(_unit(*keys, entry["id"], i) * inner["rest"] < inner["room"], 1).otherwise(0).cast("long")
            return F.struct((inner["room"] - took).alias("room"), (inner["rest"] - 1).alias("rest"), (inner["took"] + took).alias("took"))

        after = F.aggregate(blocks, F.struct(state["room"].alias("room"), state["rest"].alias("rest"), F.lit(0).cast("long").alias("took")), step)
        return F.struct(after["room"].alias("room"), after["rest"].alias("rest"), F.concat(state["out"], F.array(F.struct(entry["id"].alias("id"), after["took"].alias("n")))).alias("out"))

    none = F.array().cast("array<struct<id:int,n:bigint>>")
    return F.aggregate(entries, F.struct(room.alias("room"), total.alias("rest"), none.alias("out")), draw, lambda s: s["out"])


def _sum(entries: Column | str) -> Column:
    return F.aggregate(entries, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def split_quotas(quotas: DataFrame, shards: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(rank, quota) -> (rank, shard, first, blocks): which run of each source's draws a shard owns.

    ``shards`` is a power of two; level k of the tree has 2**k nodes, each in rows of ``chunk`` sources.
    Levels are checkpointed: each uses the one before twice.
    """
    entry = F.struct(F.col("rank").cast("int").alias("id"), F.col("quota").cast("long").alias("n"))
    rows = quotas.groupBy(F.floor(F.col("rank") / chunk).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("quotas")).withColumn("node", F.lit(0)).checkpoint()
    width, level = shards, 0
    while width > 1:
        width, level = width // 2, level + 1
        totals = F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("id"), _sum("quotas").alias("n"))))
        nodes = rows.groupBy("node").agg(totals.alias("chunks")).withColumn("total", _sum("chunks"))
        rooms = nodes.select("node", F.explode(_draw(F.col("chunks"), F.floor(F.col("total") / 2), F.col("total"), F.lit(seed), F.lit(-level), F.col("node"))).alias("room"))
        rooms = rooms.select("node", F.col("room.id").alias("chunk"), F.col("room.n").alias("room"))
        drawn = rows.join(rooms, ["node", "chunk"]).withColumn("left", _draw(F.col("quotas"), F.col("room"), _sum("quotas"), F.lit(seed), F.lit(level), F.col("node")))
        drawn = drawn.withColumn("right", F.zip_with("quotas", "left", lambda q, x: F.struct(q["id"].alias("id"), (q["n"] - x["n"]).alias("n"))))
        rows = drawn.select("chunk", "node", F.posexplode(F.array("left", "right")).alias("side", "quotas")).select("chunk", (F.col("node") * 2 + F.col("side")).alias("node"), "quotas").checkpoint()
    leaves = rows.select(F.col("node").alias("shard"), F.explode("quotas").alias("q")).select("shard", F.col("q.id").alias("rank"), F.col("q.n").alias("blocks"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.select("rank", "shard", F.coalesce(F.sum("blocks").over(before), F.lit(0).cast("long")).alias("first"), "blocks")


def _small(table: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def _before(values: str, keys: list[str], *order: str) -> Column:
    """The sum of the values before a row, in its keys' order."""
    return F.coalesce(F.sum(values).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def _draws(groups: DataFrame, plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """rank, grp, words, shard, pass and share (words of the group that the shard takes in that pass) of all draws.

    groups: rank, grp, words, start (words of the source before the group); plan: a row a source.
    """
    block = F.least(F.floor(F.col("start") * F.col("n_blocks") / F.col("source_size")), F.col("n_blocks") - 1).cast("long")
    cut = groups.join(plan.select("rank", "n_blocks", "source_size"), "rank").select("rank", "grp", "words", block.alias("block"))
    blocks = cut.groupBy("rank", "block").agg(F.sum("words").alias("block_words")).join(plan.select("rank", "passes", "left_over"), "rank")
    passed = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).withColumn("order", F.xxhash64(F.lit(seed), "rank", "pass", "block"))
    in_pass = Window.partitionBy("rank", "pass")
    passed = passed.withColumn("drawn", _before("block_words", ["rank", "pass"], "order", "block")).withColumn("nth", F.row_number().over(in_pass.orderBy("order", "block")) - 1).withColumn("many", F.count("*").over(in_pass))
    drawn = passed.filter((F.col("pass") < F.col("passes")) | (F.col("drawn") < F.col("left_over"))).select(
        "rank", "block", "pass", (F.col("pass") * F.col("many") + F.col("nth")).alias("place"),
        F.when(F.col("pass") < F.col("passes"), F.col("block_words")).otherwise(F.least("block_words", F.col("left_over") - F.col("drawn"))).alias("share"),
    )
    runs = split_quotas(drawn.groupBy("rank").agg(F.count("*").alias("quota")), shards, seed)
    runs = runs.filter("blocks > 0").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("first", "shard"))).alias("runs"))
    owned = drawn.join(runs, "rank").withColumn("shard", F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("place")), -1)["shard"])
    met = cut.withColumn("inside", _before("words", ["rank", "block"], "grp")).join(owned, ["rank", "block"])
    share = F.least(F.col("words"), F.col("share") - F.col("inside"))
    return met.withColumn("share", share).filter("share > 0").select("rank", "grp", "words", "pass", "shard", "share")


def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[int] = (3, 1, 2),
    most: float = 2.0,
    shards: int = 16,
    block_words: int = 1024,
    most_blocks: int = BLOCKS,
    seed: int = 20250101,
    keep: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws (pass, shard and words, an array) of every row; with ``keep`` also key and the row, a struct.

    The sum of ``taken`` over a source is its target, rounded, and at most one document a
    source is taken in part (with its exact copies).  Blocks hold ``block_words`` words, or more where that gives over ``most_blocks``.
    """
    carried = [as_row(docs.columns)] if keep else []
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("key"), *carried)
    targets = source_targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    some = F.when(F.col("source_size") > 0, F.col("source_size"))
    plan = (
        targets.withColumn("quota_words", F.round("target").cast("long"))
        .withColumn("block", F.greatest(F.lit(block_words).cast("long"), F.ceil(F.sum("source_size").over(whole) / F.lit(most_blocks))))
        .withColumn("n_blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / F.col("block"))))
        .withColumn("passes", F.coalesce(F.floor(F.col("quota_words") / some), F.lit(0)).cast("long"))
        .withColumn("left_over", F.col("quota_words") - F.col("passes") * F.col("source_size"))
        .select(F.col("source").alias("s_source"), "rank", "source_size", "target", "n_blocks", "passes", "left_over")
        .checkpoint()
    )
    grp = F.pmod("key", F.col("n_blocks") * GROUPS).alias("grp")
    named = keyed.join(_small(plan), F.col("source").eqNullSafe(F.col("s_source")))
    groups = named.select("rank", grp, "size").groupBy("rank", "grp").agg(F.sum("size").alias("words")).filter("words > 0")
    draws = _draws(groups.withColumn("start", _before("words", ["rank"], "grp")).checkpoint(), plan, shards, seed).checkpoint()

    # the one group a source that is not drawn in full: its documents up to a key, and that key's in part
    edge = draws.filter("share < words").select("rank", "grp", "pass", "share")
    inside = named.select("rank", grp, "key", "size").join(_small(edge), ["rank", "grp"])
    inside = inside.groupBy("rank", "grp", "pass", "share", "key").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).withColumn("before", _before("words", ["rank", "grp", "pass"], "key"))
    ends = inside.filter("before < share and share <= before + words").select("rank", "grp", "pass", F.col("key").alias("end_key"), F.floor((F.col("share") - F.col("before")) / F.col("rows")).alias("end_words"))
    entry = F.struct("pass", "shard", "end_key", "end_words")
    table = draws.join(ends, ["rank", "grp", "pass"], "left").groupBy("rank", "grp").agg(F.array_sort(F.collect_list(entry)).alias("entries")).checkpoint()
    table = table.select(F.col("rank").alias("d_rank"), F.col("grp").alias("d_grp"), "entries")

    rows = named.select("doc_id", "source_size", "target", "key", "rank", grp, "size", *(["row"] if keep else []))
    met = rows.join(_small(table), (F.col("rank") == F.col("d_rank")) & (F.col("grp") == F.col("d_grp")), "left")
    words = lambda x: F.when(x["end_key"].isNull() | (F.col("key") < x["end_key"]), F.col("size")).when(F.col("key") == x["end_key"], F.least("size", x["end_words"])).otherwise(0).cast("long")
    given = F.transform(F.coalesce("entries", F.array().cast(table.schema["entries"].dataType)), lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), words(x).alias("words")))
    given = met.withColumn("draws", F.filter(given, lambda x: x["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return given.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws", *(["key", "row"] if keep else []))


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = 20250101, part_words: int = PART_WORDS, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``, a row for each draw that takes words of a document, cut where it takes it in part.

    Rows come by shard, each shard in one or more parts, and shuffled inside them.
    """
    mixed = mix(docs, keep=True, shards=shards, seed=seed, **options)
    rows = mixed.select("size", "key", "row", F.inline("draws"))
    words = docs.select(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)))).first()[0] or 0
    place = F.xxhash64(F.lit(seed + 1), "key", "pass")
    parts = max(1, -(-words // (4 * shards * part_words)))  # of a shard; a word and its blank take four bytes or more, mostly
    dealt = rows.withColumn("place", place).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts))).repartition("shard", "part").sortWithinPartitions("shard", "part", "place")
    cut = F.col("words") < F.col("size")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(F.col("words"), F.lit(1)).cast("int")), " ")
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == "text":
            value = F.when(cut, head).otherwise(value)
        elif c == "n_chars":
            value = F.when(cut, F.length(head).cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return dealt.select(*columns)
