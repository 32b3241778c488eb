"""Mixing sources to target weights: token blocks drawn by index. Native DataFrame functions only.

1. Each source's words, its documents end to end in the order of (doc_id, hash of the text), are cut into
   blocks of ``block`` words. A document is a range of that stream (a running sum over range-partitioned storage),
   so a source with a third of all rows is as many ranges as it needs.
2. Targets: sources in order weigh 1, 2, 3, repeating, and share the words; a target stops at ``most``
   times its source's size, and what is over goes to the others by weight.
3. A slot of an output shard draws its source at random with the sources' shares as chances, so a
   shard's counts are one multinomial draw. Over all shards the draws of a source miss its quota (its target in
   blocks) by a few slots: a pseudorandom choice of those over is given to the sources that are short.
4. A source's slots, numbered over all shards, take its blocks: slot i takes block perm(i mod n) of pass i div n.
   ``permuted`` is a swap-or-not shuffle keyed by source and pass (a bijection on 0..n-1 for any n, computed for an index alone). So
   a block is taken once a pass, and with at most ``most`` passes no document exceeds ``most`` times its size.
5. Slots join blocks on (source, block index), keys that occur ``most`` times at most.

All draws are hashes of numbers, so a rerun gives the same mix.

Cases: a null text has no words; a null source is a source, the last one; a null ``doc_id`` is a document; rows that are
alike are separate documents, and which of them is taken more often is left open; a source without words has target
0 and is not drawn; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import scratch, written
from ledgerlens.operators.rank import exact_row_number, exact_running_sum

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the shuffle; each halves what an index's place still tells of it.
ROUNDS = 16
#: Intervals are looked up by equal parts of their range.
PARTS = 4096


def permuted(df: DataFrame, index: str, size: str, key: str, out: str) -> DataFrame:
    """``df`` with ``out``: a pseudorandom bijection of ``index`` in 0..``size``-1, one for each ``key``.

    Swap-or-not shuffle: each round pairs x with K - x (mod size) and a hash of the pair says whether they swap.
    The columns that it reads are to be stored ones: an expression among them would be computed again in each round.
    """
    size_ = F.col(size)

    def swapped(x: Column, r: Column) -> Column:
        pair = F.pmod(F.pmod(F.xxhash64(key, r), size_) - x, size_)
        return F.when(F.xxhash64(key, r + ROUNDS, F.greatest(x, pair)).bitwiseAND(1) == 1, pair).otherwise(x)

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return df.withColumn(out, F.aggregate(rounds, F.col(index).cast("long"), swapped))


def in_intervals(points: DataFrame, at: str, intervals: DataFrame, total: int) -> DataFrame:
    """Join each point (0 <= ``at`` < ``total``) to the interval ``lo`` <= at < ``hi`` that holds it.

    The range is cut into equal parts, so points spread evenly over the join's keys
    whatever the intervals are; the optimiser broadcasts the intervals if they are small."""
    width = max(1, math.ceil(total / PARTS))
    cut = intervals.filter("lo < hi").withColumn("_part", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    keyed = points.withColumn("_part", F.expr(f"{at} div {width}"))
    return keyed.join(cut, "_part").filter((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("_part", "lo", "hi")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_hash, size) of every document."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words.alias("size"))


def targets(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, number, source_size, weight, target) from ``sized`` documents: sources by code point, null last.

    ``level`` is words per weight; raising it to what the uncapped sources share is repeated until no
    further source is over ``most`` times its size (a round at least caps one, some two or three in all)."""
    spark = docs.sparkSession
    each = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    ranked = exact_row_number(each.withColumn("_null", F.col("source").isNull()), ["_null", "source"], out="number").drop("_null")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    table = written(ranked.withColumn("weight", weight.cast("long")), scratch(spark, "sources"))
    cap = F.col("source_size") * most
    total, shares = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total or 0) / (shares or 1), -1.0
    while level > before:
        full = cap < F.col("weight") * F.lit(level)
        held, left = table.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        before, level = level, (total - held) / left if left else level
    return table.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def streams(docs: DataFrame) -> DataFrame:
    """``sized`` documents with ``start``: words of the source before the document."""
    ends = exact_running_sum(docs, ["doc_id", "text_hash"], ["source"], "size", "end")
    return ends.withColumn("start", F.col("end") - F.col("size")).drop("end")


def drawn(sources: DataFrame, shard_slots: int, most: int, seed: int) -> DataFrame:
    """(shard, slot, number, pass, block): the block of each output slot."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    ends = exact_running_sum(sources, ["number"], weight="quota", out="hi")
    shares = ends.select("number", (F.col("hi") - F.col("quota")).alias("lo"), "hi")
    slots = spark.range(total).select((F.expr(f"id div {shard_slots}")).alias("shard"), (F.col("id") % shard_slots).alias("slot"),
                                      F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("u"))
    draws = written(in_intervals(slots, "u", shares, total).select("shard", "slot", "number"), scratch(spark, "draws"))
    counts = sources.join(draws.groupBy("number").agg(F.count(F.lit(1)).alias("drawn")), "number", "left") \
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    balance = written(counts.select("number", "quota", "n_blocks", "drawn", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)).alias("over"),
                                    F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)).alias("short")), scratch(spark, "balance"))
    spare = balance.agg(F.sum("over")).first()[0] or 0
    over = exact_running_sum(balance, ["number"], weight="over", out="over_end").select(
        "number", "quota", "n_blocks", "drawn", (F.col("over_end") - F.col("over")).alias("over_start"), F.xxhash64(F.lit(seed), F.lit("draws"), "number").alias("key"))

    def stored(df: DataFrame) -> DataFrame:
        return written(df, scratch(spark, "slots"))

    # a slot's number among its source's, over all shards, then its place in a random order of them
    numbered = exact_row_number(draws, ["shard", "slot"], ["number"], "i").withColumn("i", F.col("i") - 1)
    mixed = stored(permuted(stored(numbered.join(over, "number")), "i", "drawn", "key", "p").drop("key", "i"))
    kept = mixed.filter("p < quota").select("shard", "slot", "number", "n_blocks", "p")
    if spare:
        missing = exact_running_sum(balance, ["number"], weight="short", out="hi").select(
            F.col("number").alias("to"), (F.col("hi") - F.col("short")).alias("lo"), "hi", F.col("drawn").alias("from"), F.col("n_blocks").alias("to_blocks"),
            (F.col("hi") - F.col("short")).alias("first"))
        loose = stored(mixed.filter("p >= quota").select("shard", "slot", (F.col("over_start") + F.col("p") - F.col("quota")).alias("k"),
                                                         F.lit(spare).cast("long").alias("spare"), F.xxhash64(F.lit(seed), F.lit("spare")).alias("key")))
        given = in_intervals(stored(permuted(loose, "k", "spare", "key", "u")), "u", missing, spare).select(
            "shard", "slot", F.col("to").alias("number"), F.col("to_blocks").alias("n_blocks"), (F.col("from") + F.col("u") - F.col("first")).alias("p"))
        kept = kept.unionByName(given)
    passed = kept.withColumns({"pass": F.expr("p div n_blocks"), "within": F.col("p") % F.col("n_blocks")})
    keyed = stored(passed.withColumn("key", F.xxhash64(F.lit(seed), F.lit("blocks"), "number", "pass")))
    return stored(permuted(keyed, "within", "n_blocks", "key", "block").select("shard", "slot", "number", "pass", "block"))


def mix(docs: DataFrame, block: int = 64, shard_slots: int = 8192, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
        seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mix, documents, sources).

    mix: (shard, slot, pass, block, number, start, doc_id, source, text_hash, first, words), a row for each part of a
    document in the block of an output slot: ``words`` words from its word ``first`` on. In a
    slot the parts follow each other by ``start``, the document's place in its source.
    documents: (doc_id, source, text_hash, size, number, start). sources: as ``targets``, with n_blocks and quota.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs), scratch(spark, "sizes"))
    blocks = F.expr(f"(source_size + {block - 1}) div {block}")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0.0).cast("long")
    sources = written(targets(sizes, weights, most).withColumn("n_blocks", blocks)
                      .withColumn("quota", F.least(quota, F.col("n_blocks") * most)), scratch(spark, "targets"))
    names = sources.select(F.col("source").alias("_source"), "number")
    placed = streams(sizes).join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    documents = written(placed, scratch(spark, "streams"))
    slots = drawn(sources, shard_slots, most, seed)
    spans = documents.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    from_ = F.greatest(F.col("block") * block, F.col("start"))
    to = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    parts = spans.select("number", "block", "start", "doc_id", "source", "text_hash", (from_ - F.col("start")).alias("first"), (to - from_).alias("words"))
    mixed = slots.join(parts, ["number", "block"])
    return mixed.select("shard", "slot", "pass", "block", "number", "start", "doc_id", "source", "text_hash", "first", "words"), documents, sources


def with_words(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of a mix with ``text``: their words joined by one space."""
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"),
                        F.col("text").alias("_text")).dropDuplicates(["_id", "_source", "_hash"])
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_hash") == F.col("_hash"))
    words = F.regexp_extract_all("_text", F.lit(f"({WORD})"))
    cut = F.slice(words, (F.col("first") + 1).cast("int"), F.col("words").cast("int"))
    return mixed.join(texts, on).withColumn("text", F.array_join(cut, " ")).drop("_id", "_source", "_hash", "_text")


def mix_report(docs: DataFrame, **options: int) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document."""
    mixed, documents, sources = mix(docs, **options)
    taken = mixed.groupBy("number", "start").agg(F.sum("words").alias("taken")).withColumn("_some", F.lit(True))
    known = documents.withColumn("_some", F.col("size") > 0).join(taken, ["number", "start", "_some"], "left")
    figures = sources.select("number", "source_size", "target")
    return known.join(figures, "number").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
