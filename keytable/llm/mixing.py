"""Mixing sources to target weights.

The words of every source form one stream (documents in a hashed order), packed into
blocks of ``block_words`` words. The mix is written in shards of ``shard_slots`` slots
each. Per shard, source counts are drawn: each source gets the whole part of its
expected count, and the remaining slots are drawn multinomially from the fractional
parts, which keeps totals near their targets. The k-th slot of a source takes block
perm(k mod blocks), where perm is a pseudorandom permutation of the source's block
indices, so a block is used again only after all others; slots beyond three passes are
void, so no document is taken more than three times its size. Blocks are joined by
(source, index).

Only DataFrame functions. Running totals are taken in two levels, so a hot source is
not summed by one task. Draws hash (seed, shard, draw): reruns agree.

Null texts have size 0; documents of size 0 take nothing; a null source is a source of
its own, last in order; repeated rows are documents of their own; no documents, no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keytable.llm.storage import materialize, observed, small, text_column

WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
MOST = 3  # no more than so many times a source's or a document's size
BLOCK_WORDS, SHARD_SLOTS = 256, 4096
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
ROUNDS = 4


def hash32(*parts: Column | str) -> Column:
    """A number below 2**32 from the md5 of the parts."""
    joined = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def running_total(rows: DataFrame, group: str, bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, within ``group`` and in the
    order (bucket, *order): totals of buckets first, then rows within buckets."""
    totals = rows.groupBy(group, bucket).agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = totals.select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), before.alias("__start"))
    inner = W.partitionBy(group, bucket).orderBy(*order)
    own = rows.withColumn("__row", F.row_number().over(inner)).withColumn("__own", F.coalesce(F.sum(value).over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    joined = own.join(starts, (F.col(group) == F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(name, F.col("__start") + F.col("__own")).drop("__g", "__b", "__start", "__own")


def sources_table(sized: DataFrame, block_words: int) -> DataFrame:
    """Per source: its number s, size, target (excess over ``MOST`` times the size is
    reshared by weight) and blocks. One row per source, so its windows are small."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("s", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.array(*[F.lit(w) for w in WEIGHTS])[(F.col("s") % len(WEIGHTS)).cast("int")]
    capped = ranked.withColumn("w", weight).withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "s")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rate = capped.withColumn("rate", (F.sum("source_size").over(every) - before).cast("double") / after)
    # below the first source whose limit the rate of the rest does not reach, all are at their limit
    share = F.min(F.when(F.col("ratio") >= F.col("rate"), F.struct("ratio", "s", "rate"))).over(every)["rate"]
    target = F.coalesce(F.least(F.col("cap").cast("double"), share * F.col("w")), F.col("cap").cast("double"))
    blocks = F.ceil(F.col("source_size") / block_words)
    return rate.select("source", F.col("s").cast("long").alias("s"), "source_size", target.alias("target"), blocks.cast("long").alias("blocks")).withColumn("rounds", round_keys())


def round_keys() -> Column:
    """Per source: (key, odd) of every round of its permutation, from the md5 of its
    number, and the mask and shift of the lower 2**m indices, m being the whole log2
    of its blocks."""
    key = "conv(substr(md5(concat('mix:', s, ':', r)), 1, 10), 16, 10)::bigint"
    m = "(length(bin(greatest(blocks, 1L))) - 1)"
    return F.expr(f"struct(shiftleft(1L, {m}) - 1 as mask, {m} div 2 + 1 as half, transform(sequence(0, {ROUNDS - 1}), r -> struct({key} as key, 2 * ({key} % 524288) + 1 as odd)) as keys)")


def permuted(index: str) -> Column:
    """``index`` permuted within 0..blocks-1: rounds that mix the lower 2**m indices and
    rotate all of them. Every step is a bijection, so no index comes twice."""
    low = "((x ^ (r.key & rounds.mask)) * r.odd & rounds.mask)"
    return F.expr(f"aggregate(rounds.keys, {index}, (x, r) -> (if(x <= rounds.mask, {low} ^ shiftright({low}, cast(rounds.half as int)), x) + r.key) % blocks)")


def draw_slots(sources: DataFrame, *, shard_slots: int, seed: str) -> DataFrame:
    """(s, shard, k, block): the slots of the mix; k counts a source's slots."""
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    slots = F.col("target") * F.col("blocks") / F.col("source_size")
    live = sources.where("source_size > 0").withColumn("slots", slots)
    live = live.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.sum("slots").over(every) / shard_slots)))
    live = live.withColumn("expected", F.col("slots") / F.col("shards")).withColumn("whole", F.floor("expected")).withColumn("part", F.col("expected") - F.col("whole"))
    upto = F.sum("part").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, 0))
    live = materialize(live.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("part")).withColumn("total", F.sum("part").over(every)).withColumn("n", F.count("*").over(every)), "sources")
    base = live.where("whole > 0").select("s", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"), F.col("whole").alias("count"))
    # draws of a shard: the running total of the fractional parts, in whole slots
    head = live.groupBy().agg(F.max("shards").alias("shards"), F.max("total").alias("total"), F.max("n").alias("n"))
    shards = head.where("shards is not null").select("total", "n", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"))
    draws = shards.withColumn("draws", F.floor(F.expr("(shard + 1) * total + 0.5")) - F.floor(F.expr("shard * total + 0.5"))).where("draws > 0")
    draws = draws.select("shard", "total", "n", F.explode(F.expr("sequence(0L, draws - 1)")).alias("i"))
    draws = draws.withColumn("u", hash32(F.lit(seed), F.col("shard"), F.col("i")) / F.lit(4294967296.0) * F.col("total"))
    # intervals and draws meet in cells of a grid, a few per source
    cell = lambda c: F.least(F.col("n") - 1, F.floor(c / F.col("total") * F.col("n")))
    held = live.where("part > 0").select("s", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    drawn = draws.withColumn("cell", cell(F.col("u"))).join(held, "cell").where("u >= lo and u < hi").groupBy("s", "shard").agg(F.count("*").alias("count"))
    counts = base.unionByName(drawn).groupBy("s", "shard").agg(F.sum("count").alias("count")).withColumn("bucket", F.expr("shard div 1024"))
    counts = running_total(counts, "s", "bucket", ["shard"], "count", "start")
    # few rows here, each of thousands of slots: dealt out before they unfold
    counts = counts.select("s", "shard", "start", "count").repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s", "shard")
    found = counts.join(live.select("s", "blocks", "rounds"), "s").select("s", "blocks", "rounds", "shard", F.explode(F.expr("sequence(start, start + count - 1)")).alias("k"))
    return found.where(f"k < {MOST} * blocks").select("s", "shard", "k", permuted("k % blocks").alias("block"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text_column(docs)).alias("hash"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def lay_out(sized: DataFrame, n: int, sources: DataFrame, n_sources: int) -> DataFrame:
    """Each of ``n`` documents with its source's number and its offset in the source's stream."""
    few = small(sources, row_bytes=1024, rows=n_sources)
    numbered = sources.select(F.col("source").alias("__source"), "s", "source_size", "target")
    rows = sized.join(F.broadcast(numbered) if few else numbered, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    # as many buckets as rows in one: neither level of the running totals is long
    buckets = max(1, math.ceil(math.sqrt(n)))
    rows = rows.withColumn("bucket", hash32(F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))  % F.lit(buckets))
    return running_total(rows, "s", "bucket", ["doc_id", "size", "hash"], "size", "offset")


def mix(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    sized, seen = observed(sized_documents(docs), "sized", rows=F.count("*"))
    sources, seen_sources = observed(sources_table(sized, block_words), "sources", rows=F.count("*"))
    placed = lay_out(sized, seen["rows"], sources, seen_sources["rows"])
    used = draw_slots(sources, shard_slots=shard_slots, seed=seed).groupBy("s", "block").agg(F.count("*").alias("times"))
    first, last = F.expr(f"offset div {block_words}"), F.expr(f"(offset + size - 1) div {block_words}")
    parts = placed.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    inside = F.least(F.expr(f"(block + 1) * {block_words}"), F.col("offset") + F.col("size")) - F.greatest(F.expr(f"block * {block_words}"), F.col("offset"))
    parts = parts.withColumn("words", F.when(F.col("block") >= 0, inside).otherwise(F.lit(0)))
    taken = parts.join(used, ["s", "block"], "left").groupBy("s", "bucket", "__row").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"),
    )
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = "mix") -> DataFrame:
    """The mix itself, a row per slot: (shard, source, slot, block, doc_ids, n_words, text).
    slot counts a source's slots; the text is the words of its block, parted by blanks, and
    doc_ids are the documents (those with an id) that they come from, in their order."""
    sized, seen = observed(sized_documents(docs), "sized", rows=F.count("*"))
    sources, seen_sources = observed(sources_table(sized, block_words), "sources", rows=F.count("*"))
    # equal rows have their places together, and one of them takes all
    key = ["doc_id", "source", "hash"]
    places = lay_out(sized, seen["rows"], sources, seen_sources["rows"]).where("size > 0").groupBy(*key).agg(F.collect_list(F.struct("s", "offset")).alias("places"))
    places, seen = observed(places.select(*[F.col(c).alias(f"__{c}") for c in key], "places"), "places", rows=F.count("*"), several=F.count_if(F.size("places") > 1))
    text = text_column(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("hash"), text.alias("text"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    placed = texts.join(F.broadcast(places) if small(places, row_bytes=128, rows=seen["rows"]) else places, on)
    once = placed.where(F.size("places") == 1)
    if seen["several"]:
        once = once.unionByName(placed.where(F.size("places") > 1).dropDuplicates(key))
    rows = once.select(F.explode("places").alias("p"), "doc_id", "text").select("p.s", "p.offset", "doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.select("s", "offset", "doc_id", F.explode(F.expr(f"transform(sequence(offset div {block_words}, (offset + size(words) - 1) div {block_words}), b -> struct(b as block, array_join(slice(words, cast(greatest(b * {block_words} - offset, 0) + 1 as int), cast(least((b + 1) * {block_words} - offset, size(words)) - greatest(b * {block_words} - offset, 0) as int)), ' ') as piece, least((b + 1) * {block_words} - offset, size(words)) - greatest(b * {block_words} - offset, 0) as n))")).alias("b")).select("s", "offset", "doc_id", "b.*")
    # a block holds at most ``block_words`` pieces
    blocks = rows.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece"))).alias("p"), F.sum("n").cast("long").alias("n_words"))
    blocks = blocks.select("s", "block", F.array_distinct(F.array_compact("p.doc_id")).alias("doc_ids"), "n_words", F.array_join("p.piece", " ").alias("text"))
    mixed = draw_slots(sources, shard_slots=shard_slots, seed=seed).join(blocks, ["s", "block"])
    named = sources.select("s", "source")
    return mixed.join(F.broadcast(named) if small(named, row_bytes=1024, rows=seen_sources["rows"]) else named, "s").select("shard", "source", F.col("k").alias("slot"), "block", "doc_ids", "n_words", "text")
