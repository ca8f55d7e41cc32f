"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import cut, table, text_of

#: Levels of the tables of gamma quantiles, as a power of two.
LEVELS = 13


def gamma_tables(spark: SparkSession) -> DataFrame:
    """Two rows (__which, __r, __log_c), each with the quantiles (i + 1/2) / 2**LEVELS of Gamma(2, 1) and their logarithms.

    One row for the texts and one for the edited texts, by whose number they are broadcast: 128 KB each. The quantiles are
    found by Newton's steps.
    """
    p = f"((i + 0.5D) / {1 << LEVELS})"
    root = f"aggregate(sequence(1, 60), sqrt(2 * {p}), (x, n) -> x - ({p} - 1 + (1 + x) * exp(-x)) / (-x * exp(-x)))"
    table_ = spark.range(2).select(F.col("id").cast("int").alias("__which"), F.expr(f"transform(sequence(0, {(1 << LEVELS) - 1}), i -> coalesce({root}, 0D))").alias("__r"))
    return table_.withColumn("__log_c", F.expr("transform(__r, x -> coalesce(ln(x), 0D))"))


def samples(term: str, log_weight: str, count: int, seed: int) -> list[Column]:
    """For each of ``count`` samples, the logarithm of a in consistent weighted sampling, whose least value names the sample.

    With r and c from Gamma(2, 1) and beta from (0, 1), all from one hash of term and sample:
    t = floor(log_weight / r + beta), log a = log c - r * (t - beta + 1). As log a depends on the term and t alone, two
    documents have the same least value just where they draw the same (term, t): with the chance of their generalised
    Jaccard similarity. The rows have the columns of ``gamma_tables``.
    """
    mask, out = (1 << LEVELS) - 1, []
    for k in range(count):
        h = F.xxhash64(F.col(term), F.lit(seed * 1009 + k))
        r = F.get("__r", h.bitwiseAND(F.lit(mask)).cast("int"))
        log_c = F.get("__log_c", F.shiftright(h, LEVELS).bitwiseAND(F.lit(mask)).cast("int"))
        beta = F.shiftrightunsigned(h, 2 * LEVELS).cast("double") * F.lit(2.0 ** -(64 - 2 * LEVELS))
        t = F.when(F.col(log_weight) == 0, F.lit(0.0)).otherwise(F.floor(F.col(log_weight) / r + beta).cast("double"))
        out.append(log_c - r * (t - beta + 1))
    return out


def likeness(a: str, b: str, count: int) -> Column:
    """The share of equal samples; two texts without terms are alike, a text with and one without are not."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) / {float(count)}D")


def bounds_below(column: str, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below the column, by halving; null for null."""
    if not bounds:
        return F.lit(0)
    values = f"array({', '.join(f'{x}L' for x in bounds)})"
    middle = "cast((s.low + s.high) div 2 as int)"
    right, left = f"named_struct('low', {middle} + 1, 'high', s.high)", f"named_struct('low', s.low, 'high', {middle})"
    step = f"if(s.low >= s.high, s, if(get({values}, {middle}) < {column}, {right}, {left}))"
    steps = len(bounds).bit_length()
    found = f"aggregate(sequence(1, {steps}), named_struct('low', 0, 'high', {len(bounds)}), (s, i) -> {step}).low"
    return F.expr(f"if({column} IS NULL, NULL, {found})")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = 64, seed: int = 1) -> DataFrame:
    """One row for each row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Terms are words (runs without white space), weighed by how often they occur. A fingerprint has ``count`` samples of 16
    bits, in hex; near_* are shares of equal samples. The edited text has its last floor(n / 2) code points replaced by the
    first as many (or all) of the next document in descending order of numeric ids (null ids last, equal ids by a hash of
    the text); after the last comes the first. Null texts are empty; texts without words share one fingerprint. Other
    columns are ignored.

    Ids are cut at approximate quantiles into blocks, four for each partition: a list that the driver holds. Texts are
    shuffled once, by block; ranks, the next text, term counts and samples are all computed within that partitioning. Only
    the first text of each block crosses to its neighbour. No key but a block's gathers rows, and blocks have like
    numbers of rows, so copies and frequent words make no hot task.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = 4 * parts
    base = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    bounds = docs.select(F.expr(f"percentile_approx({id_col}, array({', '.join(f'{i / blocks}D' for i in range(1, blocks))}), 10000)").alias("q")).first()["q"] or []
    bounds = sorted({int(x) for x in bounds})
    base = base.withColumn("__b", F.coalesce(bounds_below("__id", bounds), F.lit(0))).withColumn("__h", F.xxhash64("__text"))
    first = base.groupBy("__b").agg(F.max(F.struct(F.coalesce(F.col("__id").cast("long"), F.lit(-(2**63))).alias("__i"), (-F.col("__h")).alias("__h"))).alias("__f"))
    first = cut(first.select("__b", "__f.*"))
    every = Window.partitionBy()
    lower = F.lag("__b").over(Window.orderBy("__b"))
    links = first.select("__b", "__i", "__h", F.coalesce(lower, F.max("__b").over(every)).alias("__to"))
    heads = base.join(F.broadcast(first.select("__b", "__i", F.col("__h").alias("__neg"))), "__b")
    heads = heads.filter((F.coalesce(F.col("__id").cast("long"), F.lit(-(2**63))) == F.col("__i")) & (-F.col("__h") == F.col("__neg")))
    heads = heads.groupBy("__b").agg(F.first("__text").alias("__head"))
    heads = cut(links.select(F.col("__b").alias("__at"), F.col("__to").alias("__b")).join(heads, "__b").select(F.col("__at").alias("__b"), "__head"))

    order = Window.partitionBy("__b").orderBy(F.col("__id").desc_nulls_last(), "__h")
    rows = base.repartition(parts, "__b").select("__b", "__id", "__text", F.row_number().over(order).alias("__rn"), F.lead("__text").over(order).alias("__next"))
    rows = rows.join(heads, "__b").withColumn("__next", F.coalesce("__next", "__head"))
    rows = rows.withColumn("__n", F.char_length("__text").cast("long"))
    rows = rows.select("__b", "__rn", "__id", "__n", "__text", F.expr("concat(substring(__text, 1, cast(__n - __n div 2 as int)), substring(__next, 1, cast(__n div 2 as int)))").alias("__edited"))
    info = rows.select("__b", "__rn", "__id", "__n", F.sha2(F.col("__edited").cast("binary"), 256).alias("__sha"))

    both = rows.select("__b", "__rn", F.posexplode(F.array("__text", "__edited")).alias("__which", "__t"))
    words = both.select("__b", "__rn", "__which", F.explode(F.split("__t", r"[\x20\x09-\x0D]+")).alias("__word"))
    terms = words.filter("__word <> ''").groupBy("__b", "__rn", "__which", F.xxhash64("__word").alias("__term")).agg(F.ln(F.count("*")).alias("__w"))
    least = [F.min(x).alias(f"__s{k}") for k, x in enumerate(samples("__term", "__w", count, seed))]
    drawn = terms.join(F.broadcast(gamma_tables(spark)), "__which").groupBy("__b", "__rn", "__which").agg(*least)
    bits = [F.xxhash64(f"__s{k}").bitwiseAND(F.lit(0xFFFF)).cast("int") for k in range(count)]
    drawn = drawn.select("__b", "__rn", "__which", F.array(*bits).alias("__fp"))
    info = info.withColumn("__which", F.explode(F.array(F.lit(0), F.lit(1))))
    wordless = F.array_repeat(F.lit(0), count)
    drawn = cut(info.join(drawn, ["__b", "__rn", "__which"], "left").withColumn("__fp", F.coalesce("__fp", wordless)))

    turn = Window.partitionBy("__b").orderBy("__rn", "__which")
    pairs = drawn.select("*", F.lead("__fp", 1).over(turn).alias("__edited_fp"), F.lead("__fp", 2).over(turn).alias("__next_fp")).filter("__which = 0")
    leads = drawn.filter("__rn = 1 AND __which = 0").select(F.col("__b").alias("__to"), F.col("__fp").alias("__head_fp"))
    leads = cut(links.select("__b", "__to").join(leads, "__to").select("__b", "__head_fp"))
    pairs = pairs.join(leads, "__b").withColumn("__next_fp", F.coalesce("__next_fp", "__head_fp"))
    text = lambda c: F.expr(f"array_join(transform({c}, x -> lpad(hex(x), 4, '0')), '')")
    return pairs.select(
        F.col("__id").alias(id_col), F.col("__n").alias("n_chars"), F.col("__sha").alias("edited_sha256"), F.lower(text("__fp")).alias("fingerprint"), F.lower(text("__edited_fp")).alias("edited_fingerprint"),
        likeness("__fp", "__edited_fp", count).alias("near_edited"), likeness("__fp", "__next_fp", count).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
