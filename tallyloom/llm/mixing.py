"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame
operations only.

Words are counted; every source gets a target; targets are cut into blocks of BLOCK
words, and the seats of the mix go to sources by the highest quotients target/(2k+1).
Each source's seats are apportioned again over its shards (documents by a hash of the
id, so that a source with any share of all rows has many shards), giving an integer
quota a shard. In a shard, documents stand in an order drawn from the seed; whole passes
come first, and the rest of the quota is the blocks at the head of that order.

Defined cases: a null text has no words and size 0; a null source is a source of its own,
after all others; sources of size 0 have target 0 and nothing is taken; equal documents
are ordered by a hash of the text as well, and identical rows share what that place gets
in a fixed way, to the word; equal quotients go to the smaller key; a very long text is a
document like others and is cut like them; an empty table gives none. Other columns of the
input, whatever their names, are ignored by mix_sources and carried by mixed_documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.common import cut

#: Words a block, documents a shard on average, weights by rank of the source, size of the mix and most copies of a word.
BLOCK, SHARD_DOCS, WEIGHTS, SHARE, CAP = 4, 512, (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """doc_id, source, shard, place (position in the seeded order) and size of every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.pmod(F.xxhash64(F.lit(seed), key[0]), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64(F.lit(seed + 1), *key).alias("place"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(by_source: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> rank, weight and target. Sources fill up in proportion to
    their weights until they reach cap times their size; the level at which the sum comes
    to share times all sizes follows from running sums over sources in the order in which
    they reach their caps."""
    everything = W.orderBy("reach", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("reach", "rank").rowsBetween(W.unboundedPreceding, -1)
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("rank", rank).withColumn("weight", weight)
    capped = ranked.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("reach", F.col("most") / F.col("weight"))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source that its level does not fill marks the common level; the ones before it are full.
    open_ = capped.withColumn("level", level).withColumn("common", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "rank", "level"))).over(everything)["level"])
    return open_.select("source", "source_size", "rank", F.least("most", F.coalesce("common", F.lit(0.0)) * F.col("weight")).alias("target"))


def _level(seats: Column, over: list[str], key: list[str], votes: str, most: str) -> Column:
    """The factor by which votes fill the parties of a group, each up to most, until they
    hold so many seats together; null where all of them are full before."""
    group = W.partitionBy(*over)
    reach = F.col(most) / F.col(votes)
    before = group.orderBy(reach, *[F.col(k).asc_nulls_last() for k in key]).rowsBetween(W.unboundedPreceding, -1)
    level = (seats - F.coalesce(F.sum(most).over(before), F.lit(0))) / (F.sum(votes).over(group) - F.coalesce(F.sum(votes).over(before), F.lit(0.0)))
    # The first party that its level does not fill has the common one.
    return F.struct(reach.alias("reach"), F.greatest(level, F.lit(0.0)).alias("level"), (level <= reach).alias("fits"))


def apportioned(parties: DataFrame, over: list[str], key: list[str], votes: str, seats: str, most: str) -> DataFrame:
    """Adds column won: the seats that each party (key) of a group (over) gets of the
    group's seats by the highest quotients votes/(2k+1), up to most.

    The result is the rounding of votes times some factor, cut at most. Rounding is off by
    half a seat a party, so the factor that fills n seats less than there are gives each of
    n parties no more than it wins, and the one that fills n seats more no less. Only the
    quotients between the two can decide: they are listed and ranked, and the highest are
    taken; they are a few a party, however many seats there are and wherever limits bind."""
    group = W.partitionBy(*over)
    some = parties.filter((F.col(votes) > 0) & (F.col(most) > 0))
    some = some.withColumn("n", F.count(F.lit(1)).over(group))
    for name, goal in (("low", F.col(seats) - F.col("n")), ("high", F.col(seats) + F.col("n"))):
        some = some.withColumn("at", _level(goal, over, key, votes, most))
        some = some.withColumn(name, F.min(F.when(F.col("at.fits"), F.struct("at.reach", "at.level"))).over(group)["level"])
    low = F.when(F.col("low").isNull(), F.col(most)).otherwise(F.least(F.col(most), F.greatest(F.lit(0), F.floor(F.col(votes) * F.col("low")) - 1)))
    high = F.when(F.col("high").isNull(), F.col(most)).otherwise(F.least(F.col(most), F.ceil(F.col(votes) * F.col("high")) + 1))
    some = some.withColumn("sure", low.cast("long")).withColumn("limit", high.cast("long"))
    some = some.withColumn("open", F.col(seats) - F.sum("sure").over(group))
    listed = some.filter(F.col("sure") < F.col("limit")).withColumn("seat", F.explode(F.sequence(F.col("sure"), F.col("limit") - 1)))
    quotient = F.col(votes) / (F.col("seat") * 2 + 1)
    first = F.row_number().over(group.orderBy(F.desc("quotient"), *[F.col(k).asc_nulls_last() for k in key], F.asc("seat")))
    gains = listed.withColumn("quotient", quotient).withColumn("nth", first).filter(F.col("nth") <= F.col("open")).groupBy(*over, *key).agg(F.count(F.lit(1)).alias("gained"))
    won = _same(some.select(*over, *key, "sure"), gains, [*over, *key], "left").select(*[F.col(f"a.{c}") for c in [*over, *key]], (F.col("a.sure") + F.coalesce(F.col("b.gained"), F.lit(0))).cast("long").alias("won"))
    return _same(parties, won, [*over, *key], "left").select(*[F.col(f"a.{c}") for c in parties.columns], F.coalesce(F.col("b.won"), F.lit(0)).cast("long").alias("won"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a and b, under these names, joined on keys that may be null."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), same, how)


def mix_sources(docs: DataFrame, seed: int = 20240229, block: int = BLOCK, shard_docs: int = SHARD_DOCS, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, place, source, size, source_size, target and taken for each row of docs."""
    shards = max(1, -(-docs.count() // shard_docs))
    each = cut(sizes(docs, shards, seed))
    by_shard = cut(each.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")))
    goal = targets(by_shard.groupBy("source").agg(F.sum("shard_size").alias("source_size")), share, cap, weights)
    # Blocks over all sources, then over each source's shards. No party gets more than cap passes over what it has.
    total = F.sum("target").over(W.partitionBy("all"))
    parties = goal.withColumn("all", F.lit(1)).withColumn("seats", F.round(total / block).cast("long")).withColumn("most", F.floor(F.col("source_size") * cap / block).cast("long"))
    won = apportioned(parties, ["all"], ["source"], "target", "seats", "most").select("source", "source_size", "target", F.col("won").alias("source_seats"))
    spread = by_shard.alias("s").join(won.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source"))).select(
        "s.source", "s.shard", "s.shard_size", "w.source_size", "w.target", "w.source_seats", (F.floor(F.col("s.shard_size") * cap / block)).cast("long").alias("most")
    )
    quota = cut(apportioned(spread, ["source"], ["shard"], "shard_size", "source_seats", "most").withColumn("quota", F.col("won") * block))
    both = each.alias("d").join(quota.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))).select(
        "d.doc_id", "d.source", "d.shard", "d.place", "d.size", "q.source_size", "q.target", "q.shard_size", "q.quota"
    )
    order = W.partitionBy("source", "shard").orderBy("place", "doc_id", "size")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0))
    ahead = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1))
    return (
        both.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
        .withColumn("passes", passes)
        .withColumn("rest", F.col("quota") - F.col("passes") * F.col("shard_size"))
        .select("doc_id", "place", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))).cast("long").alias("taken"))
    )



def mixed_documents(docs: DataFrame, seed: int = 20240229, **settings) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each pass over a document, the
    last one cut after the words that the mix takes; documents that it doesn't take go."""
    plan = mix_sources(docs, seed, **settings).groupBy(F.col("doc_id").alias("id"), F.col("place").alias("key"), F.col("source").alias("owner")).agg(F.max("size").alias("size"), F.sum("taken").alias("sum"), F.count(F.lit(1)).alias("copies")).filter("sum > 0")
    key = F.xxhash64(F.lit(seed + 1), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), key.alias("key"), F.col("source").cast("string").alias("owner"), F.struct(*[F.col(c) for c in docs.columns]).alias("own"))
    rows = _same(rows, plan, ["key", "id", "owner"]).select("a.*", "b.size", "b.sum", "b.copies")
    # Identical rows share to the word: the first ones take one more where it doesn't come out even.
    alone = rows.filter("copies = 1").withColumn("taken", F.col("sum"))
    nth = F.row_number().over(W.partitionBy("key", "id", "owner").orderBy(F.to_json("own")))
    several = rows.filter("copies > 1").withColumn("nth", nth).withColumn("taken", F.expr("sum div copies + if(nth <= sum % copies, 1, 0)")).drop("nth")
    rows = alone.unionByName(several).filter("taken > 0")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("nth") - 1) * F.col("size")
    head = F.concat_ws(" ", F.slice(F.regexp_extract_all("own.text", F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")))
    text = F.when(left < F.col("size"), head).otherwise(F.col("own.text"))
    return rows.select(*[(text if c == "text" else F.col("own")[c]).alias(c) for c in docs.columns])
