"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is permuted by a seeded hash of doc_id, text and, for rows that are the same, a number, and cut into blocks of about block_words words.  Its target is
met by whole passes over the source plus the head of one more pass, cut at a word.  The blocks that are drawn form
exact integer quotas by source.  A binary tree splits the quotas among the output shards: at each node the left half
receives an exact number of blocks, divided among the sources as a draw without replacement would divide them.  Each
shard then owns disjoint ranges of every source's permuted blocks and is shuffled locally by hash.

Everything is DataFrame and SQL functions.  Prefix sums run in three levels (super-blocks of a source, blocks of a
super-block, rows of a block), so that a source with a third of all rows is never in one task.  Only the table of
sources is gathered in one row, for the tree: its size is the number of distinct sources.

The draw of a node inverts the distribution function within 12 deviations (and 2 units) of the mean.  By Bernstein's bound
the mass beyond is under 10^-6 of any draw; quotas stay exact whatever is drawn.

Defined cases: null text has size 0; a document without a word takes no part; very long texts are counted whole and are in
one block; of equal hashes the smaller doc_id, size, text hash and number come first; a null source is a source of its own and comes last; repeated rows are mixed as
rows of their own; an empty table gives an empty result; a source without words has target 0.  Column names other
than the two that are named are kept as they are, and text columns may be called anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from storyweft.llm.common import WORD, saved, shared_dir, table

SUPER = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> the same with weight and target.

    Water filling: with sources in order of cap over weight, the first j are capped and the rest share what is left by
    weight; the level is the largest that none of the rest exceeds.
    """
    total = W.partitionBy()
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("level_at", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    out = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("level_at", F.col("cap") / F.col("weight"))
    out = out.withColumn("before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("left_w", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    out = out.withColumn("level", (F.sum(F.lit(float(share)) * F.col("source_size")).over(total) - F.col("before")) / F.col("left_w"))
    level = F.max(F.when(F.col("level") <= F.col("level_at"), F.col("level"))).over(total)
    return out.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "weight", "target")


def _uniform(*keys: str) -> str:
    return f"((pmod(xxhash64({', '.join(keys)}), 1099511627776L) + 0.5D) / 1099511627776.0D)"


def _ln_factorial(x: str) -> str:
    return f"IF({x} < 2, 0D, ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}))"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is written and evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hypergeometric(u: str, total: str, own: str, drawn: str) -> str:
    """How many of the drawn come from own of total: inversion of the distribution function, within 12 deviations of the mean."""
    log_p = lambda x: f"(0D - {_ln_factorial(x)} - {_ln_factorial(f'(i.own - {x})')} - {_ln_factorial(f'(i.drawn - {x})')} - {_ln_factorial(f'(i.total - i.own - i.drawn + {x})')})"
    chances = "transform(sequence(r.low, r.high), x -> exp(" + log_p("x") + " - r.top))"
    pick = "r.low + aggregate(c.p, named_struct('sum', 0D, 'n', 0L), (s, x) -> named_struct('sum', s.sum + x, 'n', s.n + IF(s.sum + x < i.u * c.all, 1L, 0L)), s -> s.n)"
    body = _let("c", "named_struct('p', p, 'all', aggregate(p, 0D, (s, x) -> s + x))", f"least(r.high, {pick})")
    body = _let("p", chances, body)
    body = _let("r", "named_struct('low', b.low, 'high', b.high, 'top', " + log_p("b.mode") + ")", body)
    body = _let("b", "named_struct('low', e.low, 'high', e.high, 'mode', least(e.high, greatest(e.low, CAST(m.mean AS BIGINT))))", body)
    body = _let("e", "named_struct('low', greatest(0L, i.drawn + i.own - i.total, CAST(m.mean - m.reach AS BIGINT)), 'high', least(i.own, i.drawn, CAST(m.mean + m.reach AS BIGINT)))", body)
    body = _let("m", "named_struct('mean', i.drawn * i.share, 'reach', 2D + 12D * sqrt(i.drawn * i.share * (1D - i.share) * (i.total - i.drawn) / greatest(i.total - 1, 1L)))", body)
    return _let("i", f"named_struct('u', {u}, 'total', {total}, 'own', {own}, 'drawn', {drawn}, 'share', CAST({own} AS DOUBLE) / greatest({total}, 1L))", body)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """quotas(sid, units) -> sid, ends: how many units of the source the shards up to each one hold together.

    shards is a power of two.  A node keeps the units by source in an array; left gets half of its units exactly.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("sid", "units"))).alias("q"))
    names = nodes.select(F.posexplode("q").alias("i", "s")).select("i", F.col("s.sid").alias("sid"))
    nodes = nodes.selectExpr("1L AS node", "transform(q, s -> s.units) AS q")
    draw = _hypergeometric(_uniform(str(seed), "node", "k"), "a.total", "q[k]", "a.room")
    for _ in range(shards.bit_length() - 1):
        nodes = nodes.where("size(q) > 0").selectExpr("node", "q", "aggregate(q, 0L, (s, x) -> s + x) AS n").selectExpr(
            "node", "q",
            f"""aggregate(sequence(0, size(q) - 1), named_struct('total', n, 'room', n div 2, 'left', CAST(array() AS ARRAY<BIGINT>)),
                (a, k) -> transform(array({draw}), d -> named_struct('total', a.total - q[k], 'room', a.room - d, 'left', concat(a.left, array(d))))[0], a -> a.left) AS l""",
        )
        nodes = nodes.selectExpr("node", "explode(array(named_struct('node', 2 * node, 'q', l), named_struct('node', 2 * node + 1, 'q', zip_with(q, l, (x, y) -> x - y)))) AS k").selectExpr("k.node AS node", "k.q AS q")
    leaves = nodes.select("node", F.posexplode("q").alias("i", "units"))
    leaves = leaves.withColumn("end", F.sum("units").over(W.partitionBy("i").orderBy("node").rowsBetween(W.unboundedPreceding, 0)))
    ends = leaves.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x.end).alias("ends"))
    return names.join(ends, "i").select("sid", "ends")


def _numbered(rows: DataFrame, most: int = 1 << 16) -> DataFrame:
    """rows with a number among rows that are the same.  They are counted first, and a count is dealt in stretches of `most`."""
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    parts = same.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))))
    return parts.withColumn("number", F.explode(F.sequence("lo", F.least(F.col("lo") + most, F.col("n")) - 1))).drop("n", "lo")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block_words: int = 65536, shards: int = 8, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, text_hash, size, source, source_size, target, taken, and draws: an array of (pass, words, shard).

    taken is the sum of the words of the draws: size for every whole pass, fewer for the one document of a source at
    which its last pass ends.  No document is drawn more than ceil(most) times.
    """
    work = shared_dir(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"))
    rows = saved(_numbered(rows).withColumn("u", F.expr(_uniform(str(seed), "doc_id", "text_hash", "number"))), f"{work}/sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = saved(sources.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))), f"{work}/sources")
    has_words = F.col("source_size") > 0
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))).withColumn("passes", F.when(has_words, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = sources.withColumn("rest", F.when(has_words, F.round("target").cast("long") - F.col("passes") * F.col("source_size")).otherwise(0))
    rows = rows.alias("l").join(sources.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "sid", "source_size", "target", "blocks", "passes", "rest").withColumn("block", F.least(F.col("blocks") - 1, F.floor(F.col("u") * F.col("blocks"))))
    by_block = rows.groupBy("sid", "block").agg(F.sum("size").alias("words")).withColumn("top", F.floor(F.col("block") / SUPER))
    before = lambda *by: F.coalesce(F.sum("words").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = by_block.groupBy("sid", "top").agg(F.sum("words").alias("words")).select("sid", "top", before("sid", "top").alias("top_at"))
    by_block = saved(by_block.withColumn("in_top", before("sid", "top", "block")).join(tops, ["sid", "top"]).select("sid", "block", (F.col("in_top") + F.col("top_at")).alias("block_at")), f"{work}/blocks")
    # a source's units in order: all its blocks once for each whole pass, then those that the last pass reaches
    reached = by_block.join(sources, "sid").where("block_at < rest").groupBy("sid").agg(F.max("block").alias("last"))
    quotas = sources.join(reached, "sid", "left").select("sid", (F.col("passes") * F.col("blocks") + F.coalesce(F.col("last") + 1, F.lit(0))).cast("long").alias("units"))
    ends = saved(split_quotas(saved(quotas, f"{work}/quotas"), shards, seed), f"{work}/ends").join(sources.select("sid", F.col("blocks").alias("n"), F.col("passes").alias("whole")), "sid")
    offsets = by_block.join(ends, "sid").select("sid", "block", "block_at", F.expr("transform(sequence(0L, whole), p -> size(filter(ends, e -> e <= p * n + block)))").alias("shard_of"))
    rows = rows.withColumn("in_block", F.coalesce(F.sum("size").over(W.partitionBy("sid", "block").orderBy("u", "doc_id", "size", "text_hash", "number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = rows.join(offsets, ["sid", "block"]).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("block_at") - F.col("in_block"))).cast("long"))
    draws = F.expr("filter(transform(sequence(0L, passes), p -> named_struct('pass', CAST(p AS INT), 'words', IF(p < passes, size, extra), 'shard', shard_of[CAST(p AS INT)])), d -> d.words > 0)")
    return out.withColumn("draws", draws).select("doc_id", "text_hash", "size", "source", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "draws")


def mixed_documents(docs: DataFrame, parts: int | None = None, **options) -> DataFrame:
    """The mix itself: the columns of docs for every draw, dealt to the parts of its shard and shuffled there.

    A shard has `parts` parts (where none is given, as many as give the session's number of shuffle partitions in all), so
    that no task writes a whole shard; a part is in one partition, sorted by shard, part and a seeded hash.  Documents
    without a word have nothing that the mix could take, so they are in no shard.

    docs has doc_id, text and source.  The text of a source's last draw is cut to the words it takes; n_chars, if there
    is one, is counted anew.  Rows that repeat id, text and source are numbered, so that each has draws of its own.
    """
    number = F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy(F.col("source").asc_nulls_last()))
    drawn = mix(docs, **options).select("doc_id", "text_hash", "source", "size", "draws").withColumn("copy", number).drop("source")
    own = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"), F.col("row.source").alias("source")).withColumn("copy", number).drop("source")
    out = own.alias("l").join(drawn.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")) & (F.col("l.copy") == F.col("r.copy")))
    out = out.select("row", F.col("l.doc_id").alias("doc_id"), "size", F.explode("draws").alias("draw"))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("draw.words").cast("int")), "")
    text = F.when(F.col("draw.words") < F.col("size"), cut).otherwise(F.col("row.text"))
    shards, seed = options.get("shards", 8), options.get("seed", 0)
    parts = parts or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    part = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "draw.pass"), F.lit(parts))
    out = out.withColumn("part", part).repartition(shards * parts, "draw.shard", "part").sortWithinPartitions("draw.shard", "part", F.xxhash64(F.lit(seed + 1), "doc_id", "draw.pass"), "doc_id")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    out = out.select(*kept, text.alias("text"))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*[f"`{c}`" for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", F.transform("draws", lambda d: d.shard).alias("shards"))
