"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

1. Sizes are words of the texts; sources in code point order, null last, weigh 5, 2, 1, repeating.
2. Together they get 150 % of all sizes by weight; a target stops at twice its source's size and the excess is shared
   again by weight until none is above: sources are sorted by the level at which they stop, and running sums give the
   level of those that don't.
3. The targets' blocks of BLOCK words are apportioned to sources, each source's blocks to its groups of GROUP shards, and
   a group's blocks to its shards, by the highest quotients size / (2 k + 1). Only quotients near the last that wins are listed, about four a shard: below them all
   win, above them none.
4. A shard's documents stand in an order drawn by SEED, so that any run of blocks is a drawn selection of its documents. A quota of q blocks takes the shard whole as often as it fits,
   and the rest as one run of blocks from a drawn place on, around the end. No document is taken over twice, since no
   quota exceeds twice its shard.

A shard has about SHARD documents by a hash of their ids, so a hot source has many; no window holds a source's documents
or all its shards, but GROUP shards, or the groups, 17 million documents each. The sources meet in one window, one row each.
Null texts and texts without words have size 0 and are taken for 0. Rows without an id are drawn by their size.
Equal rows get what the order gives them; which of them gets more doesn't show. An empty table gives an empty result. Texts are counted whole, however long. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tensorweft.llm.common import materialise, maybe_broadcast, quoted

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST = 2
BLOCK = 4
SHARD = 4096
#: Shards that are apportioned together.
GROUP = 4096
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def drawn(*parts: Column | str) -> Column:
    """A number below 2^32 drawn for the parts, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """sources (source, source_size, n) with target and seats, the blocks of all targets together."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    before = Window.orderBy("stop", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    s = sources.withColumn("weight", weight).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    s = s.withColumn("stop", F.col("cap") / F.col("weight")).withColumn("all", F.sum("source_size").over(whole) * PERCENT / 100)
    s = s.withColumn("level", (F.col("all") - earlier("cap")) / (F.sum("weight").over(whole) - earlier("weight")))
    s = s.withColumn("line", F.max(F.when(F.col("stop") >= F.col("level"), F.col("level"))).over(whole))
    target = F.when(F.col("line").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("line") * F.col("weight")))
    return s.select("source", "source_size", "n", target.alias("target"), F.floor(F.col("all") / block + 0.5).cast("long").alias("seats"))


def apportion(units: DataFrame, votes: str, seats: str, group: list[str], key: list[Column | str], out: str) -> DataFrame:
    """units with their Sainte-Lague seats within their group, as column out; seats: the seats of a unit's group."""
    whole = Window.partitionBy(*group)
    v = F.col(votes).cast("double")
    u = units.withColumn("_sum", F.sum(v).over(whole)).withColumn("_n", F.count("*").over(whole))
    fair = F.when(F.col("_sum") > 0, v * F.col(seats) / F.col("_sum")).otherwise(F.lit(0.0))
    slack = F.when(F.col(seats) > 0, F.col("_n") / (2.0 * F.col(seats))).otherwise(F.lit(0.0))
    u = u.withColumn("_low", F.greatest(F.lit(0.0), F.floor(fair * (1 - slack) - 1.5)).cast("long")).withColumn("_high", (F.ceil(fair * (1 + slack)) + 2).cast("long"))
    u = u.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    tried = u.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_q", v / (2 * F.col("_k") + 1))
    best = Window.partitionBy(*group).orderBy(F.col("_q").desc(), *key, "_k")
    won = tried.withColumn("_won", (F.row_number().over(best) <= F.col("_left")).cast("long"))
    return won.groupBy(*units.columns, "_low").agg(F.sum("_won").alias("_more")).select(*units.columns, (F.col("_low") + F.col("_more")).alias(out))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row for each row of docs."""
    size = F.coalesce(F.regexp_count(quoted(text), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = materialise(docs.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), size.alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aimed = apportion(targets(sources, block), "target", "seats", [], [F.col("source").isNull(), "source"], "blocks")
    aimed = materialise(aimed.withColumnRenamed("source", "_source"), "sources")

    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string")))
    shards = F.ceil(F.col("n") / F.lit(float(shard)))
    dealt = rows.join(maybe_broadcast(aimed), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", "blocks", F.pmod(drawn(F.lit("shard"), named), shards).alias("shard"), drawn(F.lit("order"), named).alias("place")
    )
    sized = materialise(dealt.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("shard_size")).withColumn("grp", F.floor(F.col("shard") / GROUP)), "shards")
    groups = sized.groupBy("source", "grp", "blocks").agg(F.sum("shard_size").alias("grp_size"))
    groups = apportion(groups, "grp_size", "blocks", ["source"], ["grp"], "seats").select(F.col("source").alias("_source"), F.col("grp").alias("_grp"), "seats")
    sized = sized.join(maybe_broadcast(materialise(groups, "groups")), F.col("source").eqNullSafe(F.col("_source")) & (F.col("grp") == F.col("_grp"))).drop("_source", "_grp")
    quotas = apportion(sized, "shard_size", "seats", ["source", "grp"], ["shard"], "quota")
    words, whole = F.least(F.col("quota") * block, MOST * F.col("shard_size")), F.col("shard_size")
    passes = F.when(whole > 0, F.floor(words / whole)).otherwise(F.lit(0)).cast("long")
    first = block * F.pmod(drawn(F.lit("first"), F.coalesce("source", F.lit("")), F.col("shard").cast("string")), F.greatest(F.lit(1), F.ceil(whole / F.lit(float(block)))))
    quotas = materialise(quotas.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", passes.alias("passes"), (words - passes * whole).alias("rest"), first.cast("long").alias("first")), "quotas")

    stand = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.join(maybe_broadcast(quotas), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    found = found.withColumn("end", F.sum("size").over(stand)).withColumn("start", F.col("end") - F.col("size")).withColumn("stop", F.col("first") + F.col("rest"))
    zero = F.lit(0).cast("long")
    part = lambda a, b: F.greatest(zero, F.least(F.col("end"), b) - F.greatest(F.col("start"), a))
    taken = F.col("passes") * F.col("size") + part(F.col("first"), F.least("stop", "shard_size")) + part(zero, F.col("stop") - F.col("shard_size"))
    return found.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
