"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import cut, table, text_of

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources in ``sizes`` (__source, __total): adds __target and __rank.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times all sizes. A target stops at
    ``most`` times its source's size and the excess is shared again by weight until none is above: with sources in order
    of ``most * size / weight``, those that stop are a prefix of the order. One row a source goes through these windows.
    """
    by_code, by_room = Window.orderBy(F.col("__source").asc_nulls_last()), Window.orderBy("__room", "__rank")
    out = sizes.withColumn("__rank", F.row_number().over(by_code) - 1)
    out = out.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__rank") % len(weights) + 1))
    out = out.withColumn("__cap", F.col("__total") * F.lit(float(most))).withColumn("__room", F.col("__cap") / F.col("__w"))
    every = Window.partitionBy()
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("__rest", F.sum("__total").over(every) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    out = out.withColumn("__rate", F.col("__rest") / F.sum("__w").over(after))
    rate = F.min(F.when(F.col("__room") >= F.col("__rate"), F.struct("__room", "__rate")).otherwise(None)).over(every)["__rate"]
    return out.withColumn("__target", F.least(F.col("__cap"), F.coalesce(rate, F.lit(float("inf"))) * F.col("__w"))).select("__source", "__total", "__rank", "__target")


def _drawn(total: str, good: str, draws: str, u: str) -> str:
    """SQL for a hypergeometric draw by inversion: probabilities relative to the low end of mode +- 12 deviations."""
    return f"""aggregate(array(named_struct('tot', {total}, 'good', {good}, 'drw', {draws}, 'u', {u})), 0L, (_o, g) ->
      aggregate(array(named_struct(
          'mode', least(least(g.good, g.drw), greatest(greatest(0L, g.drw + g.good - g.tot), ((g.drw + 1) * (g.good + 1)) div (g.tot + 2))),
          'w', cast(ceil(12 * sqrt(g.drw * (g.good / greatest(g.tot, 1L)) * (1 - g.good / greatest(g.tot, 1L)) * ((g.tot - g.drw) / greatest(g.tot - 1, 1L)))) as bigint) + 12L)), 0L, (_p, m) ->
        aggregate(array(named_struct('low', greatest(greatest(0L, g.drw + g.good - g.tot), m.mode - m.w), 'high', least(least(g.good, g.drw), m.mode + m.w))), 0L, (_q, e) ->
          aggregate(array(aggregate(sequence(e.low, e.high), named_struct('p', 1D, 'z', 0D),
              (a, k) -> named_struct('p', a.p * cast(g.good - k as double) * cast(g.drw - k as double) / (cast(k + 1 as double) * greatest(cast(g.tot - g.good - g.drw + k + 1 as double), 1D)), 'z', a.z + a.p)).z), 0L, (_r, z) ->
            aggregate(sequence(e.low, e.high), named_struct('p', 1D, 'c', 0D, 'k', e.low),
              (a, k) -> named_struct('p', a.p * cast(g.good - k as double) * cast(g.drw - k as double) / (cast(k + 1 as double) * greatest(cast(g.tot - g.good - g.drw + k + 1 as double), 1D)),
                                     'c', a.c + a.p, 'k', if(a.c < g.u * z AND k > e.low, k, a.k))).k))))"""


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (__shard, __rank, __from, __to): the range of each source's permuted blocks that each shard gets.

    ``quotas`` has (__rank, __blocks), one row a source. The tree starts with all quotas in one row; each level halves the
    range of shards and draws how many blocks of each source go left, so that every shard gets its exact number of blocks.
    """
    nodes = quotas.groupBy().agg(F.expr("transform(array_sort(collect_list(struct(__rank, __blocks))), x -> x.__blocks)").alias("q"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q", F.expr("aggregate(q, 0L, (a, x) -> a + x)").alias("all"))
    before = lambda x: f"(cast({x} as bigint) * all) div {shards}"
    u = f"((shiftrightunsigned(xxhash64({seed}L, lo, hi, size(acc.out)), 12) + 0.5D) * {2.0**-52}D)"
    step = f"aggregate(array({_drawn('acc.tot', 'x', 'acc.drw', u)}), acc, (b, d) -> named_struct('tot', acc.tot - x, 'drw', acc.drw - d, 'out', concat(acc.out, array(d))))"
    left = f"aggregate(q, named_struct('tot', aggregate(q, 0L, (a, x) -> a + x), 'drw', {before('mid')} - {before('lo')}, 'out', cast(array() as array<bigint>)), (acc, x) -> {step}).out"
    halves = "CASE WHEN hi - lo > 1 THEN array(named_struct('lo', lo, 'hi', mid, 'q', l), named_struct('lo', mid, 'hi', hi, 'q', zip_with(q, l, (a, b) -> a - b))) ELSE array(named_struct('lo', lo, 'hi', hi, 'q', q)) END"
    for _ in range((shards - 1).bit_length()):
        nodes = nodes.withColumn("mid", F.expr("cast((lo + hi) div 2 as int)")).withColumn("l", F.expr(f"CASE WHEN hi - lo > 1 THEN {left} END"))
        nodes = cut(nodes.select(F.expr(f"inline({halves})"), "all"))
    leaves = nodes.select(F.col("lo").alias("__shard"), F.posexplode("q").alias("__rank", "__n"))
    ends = F.sum("__n").over(Window.partitionBy("__rank").orderBy("__shard"))
    return leaves.select("__shard", "__rank", (ends - F.col("__n")).alias("__from"), ends.alias("__to"))


def _narrow(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """A row's id, source and size, and two hashes of its id and text, which name it."""
    text = text_of(text_col)
    names = [F.xxhash64(F.lit(seed + k), F.col(id_col), text).alias(name) for k, name in enumerate(("__u", "__v"))]
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    return docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), key.alias("__key"), word_count(text_col).alias("__size"), *names)


def drawn_blocks(spans: DataFrame, sources: DataFrame, shards: int, block_words: int, seed: int, cell_bits: int = 10) -> DataFrame:
    """Rows (__rank, __block, __place, __shard, __give): the blocks that the shards draw, and how many words each gives.

    ``spans`` tile each source's words, all passes end to end: (__rank, __first, __words). They are cut into blocks of
    ``block_words``. Sorting by a hash of seed, source and block permutes a source's blocks; only a short block at the very
    end keeps the last place. The splitting tree gives each shard a range of places, so no block is drawn twice, and places
    beyond all ranges are not drawn. The block at the last drawn place gives what the source's words still lack.

    Places are ranks within ``2 ** cell_bits`` ranges of the hash plus the counts before, so a hot source meets in no task.
    A place finds its shard by an equal-width bucket of places; a bucket overlaps few ranges, as shards get like numbers.
    """
    quotas = sources.select("__rank", "__take", F.expr(f"(__take + {block_words - 1}) div {block_words}").alias("__blocks"), F.expr(f"__total * __passes div {block_words}").alias("__whole"))
    quotas = cut(quotas.withColumn("__stride", F.greatest(F.expr(f"__blocks div {shards}"), F.lit(1))))
    ranges = split_quotas(quotas.select("__rank", "__blocks"), shards, seed).filter("__to > __from").join(quotas.select("__rank", "__stride"), "__rank")
    ranges = cut(ranges.withColumn("__bucket", F.explode(F.expr("sequence(__from div __stride, (__to - 1) div __stride)"))).drop("__stride"))

    starts = spans.filter("__words > 0").withColumn("__a", F.expr(f"(__first + {block_words - 1}) div {block_words}")).withColumn("__z", F.expr(f"(__first + __words - 1) div {block_words}"))
    blocks = starts.filter("__a <= __z").select("__rank", F.explode(F.sequence("__a", "__z")).alias("__block"))
    blocks = blocks.join(quotas, "__rank").withColumn("__h", F.xxhash64(F.lit(seed), "__rank", "__block"))
    cell = F.when(F.col("__block") >= F.col("__whole"), F.lit(1 << cell_bits)).otherwise(F.shiftrightunsigned("__h", 64 - cell_bits))
    blocks = cut(blocks.withColumn("__cell", cell.cast("int")))
    counts = blocks.groupBy("__rank", "__cell").agg(F.count("*").alias("__n"))
    before = counts.select("__rank", "__cell", (F.sum("__n").over(Window.partitionBy("__rank").orderBy("__cell")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__rank", "__cell").orderBy("__h", "__block"))
    placed = blocks.withColumn("__r", rank).join(before, ["__rank", "__cell"]).withColumn("__place", F.col("__before") + F.col("__r") - 1)
    placed = placed.withColumn("__bucket", F.expr("__place div __stride"))
    drawn = placed.join(ranges, ["__rank", "__bucket"]).filter("__place >= __from AND __place < __to")
    give = F.least(F.lit(block_words).cast("long"), F.col("__take") - F.col("__place") * block_words)
    return cut(drawn.select("__rank", "__block", "__place", "__shard", give.alias("__give")))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    shards: int = 32,
    block_words: int = 4096,
    seed: int = 11,
    whole: bool = False,
    cell_bits: int = 12,
) -> DataFrame:
    """One row for each row of ``docs``: __id, __u, __v, size, source_size, target and copies.

    A source's documents lie end to end in hash order, once for each of ``most`` passes, cut into blocks. The splitting
    tree splits the sources' exact block quotas among the shards, and each shard draws its blocks (``drawn_blocks``).
    ``copies`` has a struct (copy, block, shard, order, words) for each drawn block that gives words of the document;
    sorting a shard by ``order`` shuffles it. A source gives exactly ``round(target)`` words. With ``whole`` a pass gives
    all of a document or nothing: all, if a drawn block gives its middle word.

    Hash order is found within ``2 ** cell_bits`` ranges of the hash, whose sums are added up in a small table, so a hot
    source meets in no task. Null sources are one source, the last. Null and empty texts have size 0 and no copies. Rows
    equal in id and text get their words in any order. An empty table gives an empty result. Other columns are ignored. The
    targets and the tree's nodes hold one number a source in one row: sources are many thousands at most.
    """
    rows = cut(_narrow(docs, id_col, source_col, text_col, seed).withColumn("__cell", F.shiftrightunsigned("__u", 64 - cell_bits).cast("int")))
    cells = cut(rows.groupBy("__key", "__cell").agg(F.first("__source").alias("__source"), F.sum("__size").alias("__n")))
    sources = source_targets(cells.groupBy("__key").agg(F.first("__source").alias("__source"), F.sum("__n").alias("__total")).drop("__key"), weights, share, most)
    sources = sources.withColumn("__take", F.least(F.round("__target").cast("long"), F.col("__total") * most)).withColumn("__passes", F.lit(most))
    sources = cut(sources.withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("__source")), F.lit("n"))).drop("__source"))
    starts = cells.drop("__source").withColumn("__at", F.sum("__n").over(Window.partitionBy("__key").orderBy("__cell")) - F.col("__n"))
    starts = cut(starts.join(sources, "__key"))
    spans = starts.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    spans = spans.select("__rank", (F.col("__at") + F.col("__pass") * F.col("__total")).alias("__first"), F.col("__n").alias("__words"))
    drawn = drawn_blocks(spans, sources, shards, block_words, seed)

    order = Window.partitionBy("__key", "__cell").orderBy("__u", "__v", "__size")
    rows = rows.join(starts.select("__key", "__cell", "__at", "__rank", "__total", "__target"), ["__key", "__cell"])
    rows = rows.withColumn("__row", F.row_number().over(order))
    rows = rows.withColumn("__at", F.col("__at") + F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("__start", F.expr("__at + __pass * __total"))
    if whole:
        middle = "__start + (__size - 1) div 2"
        met = f"array(({middle}) div {block_words})"
        words = f"if({middle} < __block * {block_words} + __give, __size, 0L)"
    else:
        met = f"sequence(__start div {block_words}, (__start + __size - 1) div {block_words})"
        words = f"greatest(0L, least(__start + __size, __block * {block_words} + __give) - greatest(__start, __block * {block_words}))"
    rows = rows.withColumn("__block", F.explode_outer(F.expr(f"if(__size > 0, {met}, CAST(NULL AS ARRAY<BIGINT>))")))
    met_blocks = rows.join(drawn, ["__rank", "__block"], "left").withColumn("__words", F.expr(f"if(__shard IS NULL, 0L, {words})"))
    copy = F.struct(
        F.col("__pass").alias("copy"),
        F.col("__block").alias("block"),
        F.col("__shard").alias("shard"),
        F.xxhash64(F.lit(seed + 2), "__u", "__pass", "__block").alias("order"),
        F.col("__words").alias("words"),
    )
    first = [F.first(c).alias(c) for c in ("__id", "__u", "__v", "__size", "__total", "__target")]
    out = met_blocks.groupBy("__rank", "__cell", "__row").agg(*first, F.sort_array(F.collect_list(F.when(F.col("__words") > 0, copy))).alias("copies"))
    return out.select("__id", "__u", "__v", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = 32, seed: int = 11, **parameters) -> DataFrame:
    """The rows of ``docs`` that the mix draws, whole and as often as it draws them, with their columns, shard by shard.

    Rows are exchanged by the shard that drew them and sorted within it by the plan's order: each shard's rows lie in runs
    of consecutive order. Rows are matched with their plan by two hashes of id and text; rows equal in both are told apart
    by number, and which of them gets which part of the plan is open. An empty table gives an empty result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = mix_plan(docs, id_col, source_col, text_col, shards=shards, seed=seed, whole=True, **parameters)
    same = Window.partitionBy("__u", "__v").orderBy("__u", "__v")
    plan = plan.select("__u", "__v", "copies").withColumn("__n", F.row_number().over(same)).alias("p")
    names = [F.xxhash64(F.lit(seed + k), F.col(id_col), text_of(text_col)).alias(name) for k, name in enumerate(("__u", "__v"))]
    rows = docs.select(F.struct("*").alias("__doc"), *names).withColumn("__n", F.row_number().over(same)).alias("d")
    # A difference, since equality would be one more key and deal the texts anew.
    match = (F.col("d.__u") == F.col("p.__u")) & (F.col("d.__v") == F.col("p.__v")) & ((F.col("d.__n") - F.col("p.__n")) == 0)
    out = rows.join(plan.filter(F.size("copies") > 0), match).select("__doc", F.explode("copies").alias("__copy"))
    runs = max(1, -(-4 * parts // shards))
    run = F.floor((F.col("__copy.order").cast("double") * F.lit(2.0**-64) + 0.5) * runs)
    out = out.select("__doc", F.col("__copy.shard").alias("__shard"), run.alias("__run"), F.col("__copy.order").alias("__order"))
    out = out.repartition(parts, "__shard", "__run").sortWithinPartitions("__shard", "__run", "__order")
    return out.select("__doc.*")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, and by which blocks and shards."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    taken = F.expr("aggregate(copies, 0L, (a, c) -> a + c.words)").alias("taken")
    return plan.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", taken, F.col("copies").alias("draws"))
