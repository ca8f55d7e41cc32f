"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import bitmap, components, cut, marked, table, text_of, tidy

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bands_for(similarity: float, recall: float, hashes: int = 160) -> tuple[int, int]:
    """Bands and rows: the most rows a band whose chance to miss a pair just at ``similarity`` is below ``1 - recall``.

    Bands of more rows make fewer false candidates but need more hashes; of those that need no more than ``hashes``, the
    most. One row a band always reaches the recall, with as many bands as it takes.
    """
    needed = {rows: max(1, math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1 for rows in range(1, 33)}
    rows = max((r for r, bands in needed.items() if bands * r <= hashes), default=1)
    return needed[rows], rows


class WordHashes(dict):
    """64-bit hashes of words, remembered for up to 200,000 words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def gram_hashes(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words; of all words together if there are fewer than n."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(words) - k + 1 + i]
        out ^= out >> np.uint64(29)
        out = out * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


class Signatures:
    """One 64-bit hash a band, of the least values that ``rows`` hash functions of the band's own take on a set."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(0, np.int64)
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(grams), 512):
            np.minimum(least, (grams[i : i + 512, None] * self.a + self.b).min(axis=0), out=least)
        out = np.zeros(self.bands, np.uint64)
        for i in range(self.rows):
            out = (out ^ least.reshape(self.bands, self.rows)[:, i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def sharing(bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs share a band; with a ``band`` from 0 on, which share this one and none before it."""
    m = len(bands)
    maybe = np.zeros((m, m), bool)
    for j in range(bands.shape[1]) if band < 0 else range(band, -1, -1):
        order = np.argsort(bands[:, j], kind="stable")
        edges = np.flatnonzero(np.diff(bands[order, j])) + 1
        for part in np.split(order, edges) if len(edges) < m - 1 else ():
            if len(part) > 1:
                maybe[np.ix_(part, part)] = band in (-1, j)
    return maybe


def verified(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, weight: np.ndarray, similarity: float, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Of sets with band hashes: summed weights of each one's links, and the roots of the components that the links form.

    Pairs that share a band (see ``sharing``) are verified on their whole sets. If ``side`` has two values, only pairs
    across are.
    """
    m = len(sets)
    maybe = sharing(bands, band)
    if side.min() != side.max():
        maybe &= side[:, None] != side[None, :]
    np.fill_diagonal(maybe, False)
    size = np.array([len(s) for s in sets])
    links = np.zeros((m, m), bool)
    if maybe.any():
        if m <= 24:
            for i, j in zip(*np.nonzero(np.triu(maybe)), strict=True):
                if min(size[i], size[j]) >= similarity * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    links[i, j] = links[j, i] = both >= similarity * (size[i] + size[j] - both) - 1e-9
        else:
            grams, at = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(m), size)
            times = np.bincount(at, minlength=len(grams))
            keep = times[at] > 1
            place = np.cumsum(times > 1) - 1
            at, owner = place[at[keep]], owner[keep]
            order = np.argsort(at, kind="stable")
            at, owner = at[order], owner[order]
            both = np.zeros((m, m), np.float32)
            width = 2048
            for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
                a, b = np.searchsorted(at, [first, first + width])
                block = np.zeros((m, width), np.float32)
                block[owner[a:b], at[a:b] - first] = 1
                both += block @ block.T
            links = maybe & (both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6)
    root = np.arange(m)
    while True:
        least = np.where(links, root[None, :], m).min(axis=1, initial=m)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return links @ weight, root


def _row_names(id_col: str, text: Column) -> list[Column]:
    """Two hashes of id and text, 128 bits, that name a row; rows equal in both columns are copies of one another."""
    return [F.xxhash64(F.lit(k), F.col(id_col), text).alias(name) for k, name in enumerate(("__row", "__row2"))]


def groups_to_verify(members: DataFrame, block: int) -> DataFrame:
    """Rows (__rep, __groups): for each candidate, the groups (gid, band, parts, part) in which it meets others.

    ``members`` has (__rep, __j, __bucket). Buckets of two or more are joined into candidate components by stars, never
    pairs. A group of m is cut into ceil(m / block) parts that meet in pairs, so it sends m * ceil(m / block) texts. A
    component is one group (band -1) or, where that sends fewer texts, each of its buckets is: chains of buckets, however
    long, are then met bucket by bucket.
    """
    heads = cut(members.groupBy("__bucket").agg(F.count("*").alias("__m"), F.min("__rep").alias("__head")).filter("__m > 1"))
    stars = members.join(heads, "__bucket").filter("__rep <> __head").select(F.col("__rep").alias("a"), F.col("__head").alias("b"))
    found = components(stars).withColumnRenamed("node", "__rep")
    parts = lambda m: F.ceil(F.col(m) / block)
    sizes = found.groupBy("root").agg(F.count("*").alias("__m"))
    costs = heads.join(found.withColumnRenamed("__rep", "__head"), "__head").groupBy("root").agg(F.sum(F.col("__m") * parts("__m")).alias("__cost"))
    plans = sizes.join(costs, "root").withColumn("__split", F.col("__cost") < F.col("__m") * parts("__m"))
    found = cut(found.join(plans.drop("__cost"), "root"))
    group = lambda gid, band: F.struct(F.col(gid).alias("gid"), band.cast("int").alias("band"), parts("__m").cast("int").alias("parts"))
    wholes = found.filter("NOT __split").select("__rep", group("root", F.lit(-1)).alias("__g"))
    split = found.filter("__split").select("__rep")
    buckets = members.join(heads.drop("__head"), "__bucket").join(split, "__rep", "left_semi").select("__rep", group("__bucket", F.col("__j")).alias("__g"))
    part = F.pmod(F.xxhash64("__rep", "__g.band"), F.col("__g.parts")).cast("int")
    rows = wholes.unionByName(buckets).select("__rep", F.struct("__g.*", part.alias("part")).alias("__g"))
    return rows.groupBy("__rep").agg(F.collect_list("__g").alias("__groups"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.995,
    block: int = 384,
    filter_bits: int = 24,
) -> DataFrame:
    """One row for each row of ``docs``: id, class_id, copy_id, n_links, the hashes __row and __row2 that name the row, and __class.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is at least ``similarity``. Rows with equal
    sets form one copy class, which is compared once; copy_id is its largest id. n_links counts the linked rows, copies
    included; class_id is the largest id in the connected component. Words are runs without white space; a text of fewer
    than n words has one gram of all its words, and texts without words (null and empty ones too) are copies of one
    another. Null ids rank lowest. Other columns are ignored; an empty table gives an empty result.

    1. Sets, set hashes and band hashes come from one scan; only hashes are kept. 2. Representatives of copy classes meet
    in the buckets of their bands (``groups_to_verify``). 3. Texts of candidates alone (a bitmap of ``2 ** filter_bits``
    bits drops others at the scan) go to their groups. There pairs that share a band, in a bucket those whose first shared
    band it is, are verified and only counts and a spanning forest come out. No pair is dropped, and none becomes a row.
    """
    bands, rows = bands_for(similarity, recall)
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    base = base.select("__id", "__text", *_row_names("__id", F.col("__text")))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, signatures = WordHashes(), Signatures(bands, rows)
        for frame in frames:
            out = []
            for text in frame["__text"]:
                grams = gram_hashes(text, n, hashes)
                out.append((xxhash.xxh3_128_hexdigest(grams.tobytes()), len(grams), signatures.of(grams)))
            yield frame[["__id", "__row", "__row2"]].assign(__set=[x[0] for x in out], __size=[x[1] for x in out], __bands=[x[2] for x in out])

    every = cut(base.mapInPandas(tidy(hashed), f"__id {kind}, __row long, __row2 long, __set string, __size long, __bands array<long>"))
    classes = every.groupBy("__set").agg(F.count("*").alias("__n"), F.max("__id").alias("__copy"), F.max("__size").alias("__size"), F.min(F.struct("__row", "__row2", "__bands")).alias("__r"))
    classes = cut(classes.select("__set", "__n", "__copy", "__size", "__r.*", F.monotonically_increasing_id().alias("__rep")))
    members = classes.filter("__size > 0").select("__rep", F.posexplode("__bands").alias("__j", "__band"))
    groups = groups_to_verify(members.select("__rep", "__j", F.xxhash64("__j", "__band").alias("__bucket")), block)
    chosen = cut(classes.select("__rep", "__row", "__row2", "__n", "__bands").join(groups, "__rep"))
    name = F.struct("__row", "__row2")
    texts = marked(base, name, bitmap(chosen, name, filter_bits), filter_bits, "__hit").filter("__hit").select("__row", "__row2", "__text")
    sent = texts.join(chosen, ["__row", "__row2"]).select("__rep", "__text", "__n", "__bands", F.explode("__groups").alias("__g"))
    sent = sent.select("__rep", "__text", "__n", "__bands", "__g.*", F.explode(F.sequence(F.lit(0), F.col("__g.parts") - 1)).alias("__other"))
    sent = sent.select("__rep", "__text", "__n", "__bands", "gid", "band", "part", F.least("part", "__other").alias("__a"), F.greatest("part", "__other").alias("__b"))
    keys = ("gid", "band", "__a", "__b")
    sent = sent.repartition(*keys).sortWithinPartitions(*keys, "__rep")

    def checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, hashes = None, {}, WordHashes()

        def flush() -> Iterator[pd.DataFrame]:
            if len(held) > 1 and (key[2] == key[3] or len({x[3] for x in held.values()}) > 1):
                reps = np.array(list(held), dtype=np.int64)
                sets, bands, weight, part = zip(*held.values(), strict=True)
                links, root = verified(sets, np.array(bands), np.array(part), np.array(weight), similarity, key[1])
                some = np.flatnonzero(links)
                if len(some):
                    yield pd.DataFrame({"__rep": reps[some], "__links": links[some].astype(np.int64), "__root": reps[root[some]]})

        for frame in frames:
            for rep, text, weight, band, part, *now in zip(*(frame[c] for c in ("__rep", "__text", "__n", "__bands", "part", *keys)), strict=True):
                if key != now:
                    yield from flush()
                    key, held = now, {}
                if rep not in held:  # rows equal in id and text come more than once
                    held[rep] = (gram_hashes(text, n, hashes), band, weight, part)
        yield from flush()

    links = cut(sent.mapInPandas(tidy(checked), "__rep long, __links long, __root long"))
    counts = links.groupBy("__rep").agg(F.sum("__links").alias("__links"))
    joined = components(links.select(F.col("__rep").alias("a"), F.col("__root").alias("b"))).withColumnRenamed("node", "__rep")
    copies = classes.select("__set", "__n", "__copy", "__rep").join(counts, "__rep", "left").join(joined, "__rep", "left")
    copies = copies.withColumn("root", F.coalesce("root", "__rep"))
    tops = copies.groupBy("root").agg(F.max("__copy").alias("class_id"))
    copies = cut(copies.join(tops, "root").select("__set", F.col("root").alias("__class"), F.col("__copy").alias("copy_id"), "class_id", (F.coalesce("__links", F.lit(0)) + F.col("__n") - 1).alias("n_links")))
    return every.select("__id", "__row", "__row2", "__set").join(copies, "__set").select(F.col("__id").alias(id_col), "class_id", "copy_id", "n_links", "__row", "__row2", "__class")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class, a row with the largest id.

    Where rows of a class share that id, the one with the least hash of id and text stays, and of equal ones any.
    """
    rows = near_duplicates(docs, id_col, text_col, **parameters)
    names = ["__row", "__row2"]
    best = rows.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy("__class").agg(F.min(F.struct(*names)).alias("__best"), F.count("*").alias("__n"))
    best = cut(best)
    stay = docs.select("*", *_row_names(id_col, text_of(text_col)))
    out = stay.join(best.select("__best.*"), names, "left_semi")
    if best.filter("__n > 1").isEmpty():
        return out.select(*docs.columns)
    return out.dropDuplicates(names).select(*docs.columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-copy class and the number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("__row", "__row2", "__class")
