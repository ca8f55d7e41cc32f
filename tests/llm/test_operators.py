"""Each operator against a brute-force version, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import exact_dedup, fingerprints, language_id, line_dedup, ngram_join, packing, quality, sharding, source_mix, url_filter
from folioframe.llm.common import chosen, components, is_training_row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, shard string"
WORDS = "amber birch cedar dune ember fjord grove harbor inlet jetty kelp lagoon meadow nectar orchard prairie quarry ridge summit tundra".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", ","]) for _ in range(n))


def corpus(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([3, 40, 120])) for _ in range(60)]
    near = prose(rng, 150).split()
    for i in range(12):
        x = list(near)
        x[7 * i + 3] = f"changed{i}"
        texts.append(" ".join(x))
    texts += [texts[0], texts[0], texts[3], "", None, None, " \n ", "é" * 5000, prose(rng, 4000), "one two", "one two"]
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", 1, i % 2 == 0, 3, "x") for i, t in enumerate(texts)]
    rows += [rows[10], (None, texts[5], None, None, None, None, None, None), (None, "alone", None, "s1", 0, True, 1, "y"), (2, "another text of id two", "en", "s2", 0, True, 1, "y")]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def low(i):
    return -1 if i is None else i


def test_exact_dedup(docs, nothing):
    df, rows = docs
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(low(r[0]))
    want = Counter((low(r[0]), max(groups[r[1] or ""]), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    out = exact_dedup.exact_dedup(df, digest=True, bits=10).collect()
    assert Counter((low(r["doc_id"]), low(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups)
    assert all(low(r["doc_id"]) == low(r["keep_id"]) for r in out if r["kept"])
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_drop_exact_copies(docs, nothing):
    df, rows = docs
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted((r["text"] or "") for r in got) == sorted({r[1] or "" for r in rows})
    top = {}
    for r in rows:
        top[r[1] or ""] = max(top.get(r[1] or "", -1), low(r[0]))
    assert all(low(r["doc_id"]) == top[r["text"] or ""] for r in got)
    assert exact_dedup.drop_exact_copies(nothing).count() == 0


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def test_drop_exact_copies_hashes_only_what_may_repeat(spark, capfd):
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(20)] + [(20, "x"), (21, None), (22, "")], "doc_id long, text string")
    out = exact_dedup.drop_exact_copies(df)
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(1, 21), 22]
    out.explain("extended")
    plan = capfd.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("sha2(") == plan.count("THEN sha2(") > 0


def similarity(a, b):
    a, b = Counter(SPACE.findall(a)), Counter(SPACE.findall(b))
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def test_fingerprints(spark, nothing):
    rng = random.Random(8)
    texts = [prose(rng, rng.choice([1, 30, 200])) for _ in range(80)] + ["", None, " ", "a a a b", "a b b b"]
    df = spark.createDataFrame([(i * 3, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    assert len(out) == len(texts)
    errors = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = out[3 * i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r["near_edited"] - similarity(t, edited), r["near_next"] - similarity(t, after)]
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.09
    assert out[3 * 80]["fingerprint"] == out[3 * 81]["fingerprint"] == out[3 * 82]["fingerprint"]
    assert fingerprints.fingerprints(nothing).count() == 0
    single = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "x y")], "doc_id long, text string")
    assert sorted(r["n_chars"] for r in fingerprints.fingerprints(single).collect()) == [3, 7, 7]


def test_bounds_are_found_by_halving(spark):
    for bounds in ([], [5], [1, 4, 9], [0, 2, 4, 6, 8, 10, 12, 14]):
        rows = spark.range(-2, 18).select("id", fingerprints.bounds_below("id", bounds).alias("n")).collect()
        assert all(r["n"] == sum(b < r["id"] for b in bounds) for r in rows)


def water(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest, mass = total - sum(most * sizes[s] for s in full), sum(w[s] for s in order if s not in full)
        new = {s for s in order if s not in full and rest * w[s] / mass > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else rest * w[s] / mass for s in order}
        full |= new


def words_taken(plan):
    return {(r["__u"], r["__v"]): sum(c["words"] for c in r["copies"]) for r in plan.collect()}


def test_source_mix(docs, nothing):
    df, rows = docs
    size = lambda t: len(SPACE.findall(t or ""))
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    want = water(totals)
    plan = source_mix.mix_plan(df, shards=8, block_words=64)
    got = plan.select("__id", "size", "source_size", "target", "copies").collect()
    assert Counter((low(r["__id"]), r["size"]) for r in got) == Counter((low(r[0]), size(r[1])) for r in rows)
    by_total = {v: k for k, v in totals.items()}
    assert len(by_total) == len(totals)
    taken, blocks, places = Counter(), {}, defaultdict(lambda: defaultdict(int))
    for r in got:
        source = by_total[r["source_size"]]
        assert r["target"] == pytest.approx(want[source])
        assert sum(c["words"] for c in r["copies"]) <= 2 * r["size"]
        for c in r["copies"]:
            assert c["words"] > 0 and blocks.setdefault((source, c["block"]), c["shard"]) == c["shard"]
            places[source, c["copy"]][r["__id"], c["block"]] += c["words"]
            taken[source] += c["words"]
    assert all(taken[s] == round(want[s]) for s in totals)
    per_block = Counter()
    for r in got:
        for c in r["copies"]:
            per_block[by_total[r["source_size"]], c["block"]] += c["words"]
    assert max(per_block.values()) <= 64
    shards = Counter(x for x in blocks.values())
    assert max(shards.values()) - min(shards[k] for k in range(8)) <= 1
    again = source_mix.mix_plan(df, shards=8, block_words=64).select("__id", "size", "copies").collect()
    assert Counter(map(str, again)) == Counter(str(r) for r in plan.select("__id", "size", "copies").collect())
    assert source_mix.mix_plan(nothing).count() == 0


def test_source_mix_takes_what_the_tree_deals_out(docs, monkeypatch):
    df, _ = docs
    plan = lambda **more: source_mix.mix_plan(df, shards=8, block_words=64, **more)
    before, shards = words_taken(plan()), {(r["__u"], c["block"]): c["shard"] for r in plan().collect() for c in r["copies"]}
    of_shard = {k: sum(c["words"] for r in plan().collect() for c in r["copies"] if c["shard"] == k) for k in range(8)}
    split = source_mix.split_quotas
    monkeypatch.setattr(source_mix, "split_quotas", lambda *a: split(*a).filter("__shard <> 3"))
    assert sum(before.values()) - sum(words_taken(plan()).values()) == of_shard[3] > 0
    monkeypatch.setattr(source_mix, "split_quotas", lambda q, n, seed: split(q, n, seed + 1))
    other = {(r["__u"], c["block"]): c["shard"] for r in plan().collect() for c in r["copies"]}
    assert words_taken(plan()) == before and other.keys() == shards.keys() and other != shards


def test_mixed_documents(spark, docs, nothing):
    df, rows = docs
    mixed = source_mix.mixed_documents(df, shards=4, block_words=64)
    assert mixed.columns == df.columns
    plan = source_mix.mix_plan(df, shards=4, block_words=64, whole=True)
    want = Counter()
    for r in plan.collect():
        assert all(c["words"] == r["size"] for c in r["copies"])
        want[low(r["__id"])] += len(r["copies"])
    got = Counter(low(r["doc_id"]) for r in mixed.collect())
    assert got == +want and 1.2 * len(rows) < sum(got.values()) < 1.8 * len(rows)
    one = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(10)), f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    order = {(r["__id"], c["copy"]): (c["shard"], c["order"]) for r in source_mix.mix_plan(one, shards=3, block_words=40, whole=True).collect() for c in r["copies"]}
    lines = one.transform(lambda d: source_mix.mixed_documents(d, shards=3, block_words=40)).select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).collect()
    assert Counter(r["doc_id"] for r in lines) == Counter(i for i, _ in order)
    of, by_place = defaultdict(set), defaultdict(list)
    for (i, _), x in order.items():
        of[i].add(x)
    for r in sorted(lines, key=lambda r: r["i"]):
        by_place[r["p"]].append(r["doc_id"])
    shuffled = [i for p in sorted(by_place) for i in by_place[p]]
    assert shuffled != sorted(shuffled) and all(len({min(of[i])[0] for i in p}) >= 1 for p in by_place.values())
    assert source_mix.mixed_documents(nothing).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ", None)], "doc_id long, text string, source string")
    assert source_mix.mixed_documents(empty).count() == 0 and source_mix.mix_plan(empty).count() == 3


def test_source_mix_of_a_very_long_text(spark):
    rows = [(1, "w " * 400_000, "a"), (2, "w " * 300, "a"), (3, "w " * 100_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["__id"]: (sum(c["words"] for c in r["copies"]), r["target"]) for r in source_mix.mix_plan(df).collect()}
    assert abs(got[1][0] + got[2][0] - got[1][1]) <= 0.5 and abs(got[3][0] - got[3][1]) <= 0.5


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_splitting_tree_keeps_its_margins(spark, shards):
    quotas = [37, 0, 5, 120, 1]
    rows = source_mix.split_quotas(spark.createDataFrame(list(enumerate(quotas)), "__rank int, __blocks long"), shards, 3).collect()
    per_shard, ranges = Counter(), defaultdict(list)
    for r in rows:
        per_shard[r["__shard"]] += r["__to"] - r["__from"]
        ranges[r["__rank"]].append((r["__from"], r["__to"]))
    assert max(per_shard.values()) - min(per_shard.values()) <= 1 and len(per_shard) == shards
    for k, q in enumerate(quotas):
        parts = sorted(ranges[k])
        assert parts[0][0] == 0 and parts[-1][1] == q and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_hypergeometric_draws(spark):
    rng = np.random.default_rng(4)
    x = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 4000) for _ in range(400)]
    assert abs(np.mean(x) - 3000) < 6 and 20 < np.std(x) < 34
    n = spark.range(4000).select(F.expr(source_mix._drawn("90L", "30L", "20L", "(id + 0.5) / 4000D")).alias("k")).toPandas()["k"]
    assert abs(n.mean() - 20 * 30 / 90) < 0.01 and abs(n.var() - 20 * (1 / 3) * (2 / 3) * 70 / 89) < 0.05 and n.is_monotonic_increasing


RULES = url_filter.RULES


def ruled(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(v, h, p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
    return host, path, best


def test_url_filter(spark):
    rng = random.Random(2)
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['a', 'B.c', 'www'])}.{rng.choice(['example.com', 'example.net', 'site.org', 'x.io'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(['7', '8', '12'])}{rng.choice(['', '?q=/en/', '#x', '/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://", "http://com/en/", "http://xcom/en/", "x://a?b", "http://é.com/en/x"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    out = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    for i, u in enumerate(urls):
        host, path, best = ruled(u)
        assert (out[i]["host"], out[i]["path"]) == (host, path)
        assert out[i]["rule"] == (best[1] + best[2] if best else None)
        assert out[i]["verdict"] == best[0] if best else out[i]["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages.filter("url LIKE '%x.io%'")).collect()} == {"allow"}


def plain_ratio(url, counts, order, weight):
    """Mean log2 ratio by dictionaries of contexts: counts[label] has (context, character) and (context, None)."""
    text, total = url + "\x02", 0.0
    for i, c in enumerate(text):
        logs = []
        for label in (0, 1):
            p = 1 / 256
            for k in range(order + 1):
                context = ("\x01" * order + text)[order + i - k : order + i]
                p = (counts[label][k, context, c] + weight * p) / (counts[label][k, context, None] + weight)
            logs.append(math.log2(p))
        total += logs[0] - logs[1]
    return total / len(text)


def test_url_model_equals_plain_counts(spark):
    import pandas as pd

    rng, order, bins, weight = random.Random(11), 3, 1 << 22, 2.0
    urls = [(f"http://{rng.choice(['ab', 'ba', 'abc'])}{rng.randint(0, 99)}.org/{rng.choice(['x', 'yy'])}", rng.randint(0, 1)) for _ in range(300)]
    rows = spark.createDataFrame([(u, (u, "block" if y else "allow")) for u, y in urls], "__u string, __rule struct<rule:string,verdict:string>")
    got, _ = url_filter.fit_urls(rows, order, bins, weight, "__u")
    counts = (Counter(), Counter())
    for u, y in urls:
        if zlib.crc32(u.encode()) % 4 == 2:
            continue
        text = u + "\x02"
        for i, c in enumerate(text):
            for k in range(order + 1):
                context = ("\x01" * order + text)[order + i - k : order + i]
                counts[y][k, context, c] += 1
                counts[y][k, context, None] += 1
    asked = [u for u, _ in urls[:40]] + ["", "ftp://nothing.like/it?", "http://ab1.org/x"]
    want = [plain_ratio(u, counts, order, weight) for u in asked]
    assert url_filter.log_ratio(pd.Series(asked), got, order, bins, weight) == pytest.approx(want, abs=1e-9)


def test_url_filter_takes_very_long_and_repeated_urls(spark):
    long = "http://x.io/" + "a" * 300_000
    rows = [(1, long), (2, long), (3, None), (3, None), (4, "http://example.com/en/7"), (5, "http://example.com/en/8"), (6, "http://example.net/de/8")]
    out = [(r["page_id"], r["verdict"], r["log_ratio"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    by = {i: (v, x) for i, v, x in out}
    assert len(out) == 7 and by[1] == by[2] and by[4][0] == "allow" and by[5][0] == by[6][0] == "block"


def test_url_model_tells_its_classes_apart():
    import pandas as pd

    good, bad = pd.Series([f"http://library.edu/books/{i}" for i in range(200)]), pd.Series([f"http://win-cash-{i}.biz/spin" for i in range(200)])
    bins, order = 1 << 14, 5
    counts = np.zeros((2, 2, bins))
    for label, urls in enumerate((good[:150], bad[:150])):
        for k, at in enumerate(url_filter._context_hashes(*url_filter._windows(urls, order), order, bins)):
            counts[label, k] = np.bincount(at.ravel(), minlength=bins)
    assert (url_filter.log_ratio(good[150:], counts, order, bins, 2.0) > 0.5).all() and (url_filter.log_ratio(bad[150:], counts, order, bins, 2.0) < -0.5).all()


def grams(text):
    words = SPACE.findall(text or "")
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


@pytest.mark.parametrize("block", [192, 4])
def test_ngram_join(docs, nothing, block):
    df, rows = docs
    sets = [grams(r[1]) for r in rows]
    linked = [[j for j in range(len(rows)) if j != i and (sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])))] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(rows))]
    top = defaultdict(lambda: -1)
    for i, r in enumerate(rows):
        top[root[i]] = max(top[root[i]], low(r[0]))
    want = Counter((low(r[0]), top[root[i]], len(linked[i])) for i, r in enumerate(rows))
    out = ngram_join.near_duplicates(df, block=block).collect()
    assert Counter((low(r["doc_id"]), low(r["class_id"]), r["n_links"]) for r in out) == want
    kept = ngram_join.drop_near_copies(df, block=block)
    assert kept.columns == df.columns and kept.count() == len(set(root))
    assert ngram_join.near_duplicates(nothing).count() == 0 and ngram_join.drop_near_copies(nothing).count() == 0


def test_pairs_are_met_in_the_first_band_they_share():
    rng = np.random.default_rng(9)
    bands = rng.integers(0, 4, (30, 5))
    any_band, firsts = ngram_join.sharing(bands, -1), [ngram_join.sharing(bands, j) for j in range(5)]
    for i, k in itertools.combinations(range(30), 2):
        shared = [j for j in range(5) if bands[i, j] == bands[k, j]]
        assert any_band[i, k] == bool(shared) and [j for j in range(5) if firsts[j][i, k]] == shared[:1]


def test_chains_met_bucket_by_bucket_give_the_same_links(spark, monkeypatch):
    """A window of words that slides over a long text chains its candidates; few bands make buckets the cheaper way."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[9 * i : 9 * i + 120])) for i in range(20)] + [(200 + i, " ".join(words[:40] + [f"x{i}"])) for i in range(12)]
    df, kinds, plan = spark.createDataFrame(rows, "doc_id long, text string"), [], ngram_join.groups_to_verify

    def watched(members, block):
        out = plan(members, block)
        kinds.append({g["band"] >= 0 for r in out.collect() for g in r["__groups"]})
        return out

    monkeypatch.setattr(ngram_join, "groups_to_verify", watched)
    links = lambda block: {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.near_duplicates(df, recall=0.5, block=block).collect()}
    assert links(384) == links(1)
    assert kinds[0] == {False} and True in kinds[1]


def test_bands_reach_their_recall():
    for similarity in (0.05, 0.3, 0.5, 0.8, 0.95, 1.0):
        for recall in (0.9, 0.995):
            bands, rows = ngram_join.bands_for(similarity, recall)
            assert 1 - (1 - similarity**rows) ** bands >= recall - 1e-12


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x in got} and all(x in got for a, b in edges if a != b for x in (a, b))


def test_language_id(spark, nothing):
    rng = random.Random(6)
    vocab = {"aa": ["kato", "mira", "solu", "tepi"], "bb": ["brugh", "schnok", "wulft", "kraam"], "ru": ["дом", "река", "поле"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(30)), lang) for i, lang in enumerate(rng.choice(list(vocab)) for _ in range(200))]
    rows += [(900, None, "aa"), (901, "123 -- ²", "aa"), (902, "kato mira solu tepi " * 10 + "brugh schnok wulft kraam " * 20, None), (903, "", None), (None, "река", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("spans", F.lit(1))
    model = language_id.fit_languages(df)
    out = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert [out[i]["lang_pred"] for i in (900, 901, 903)] == ["und"] * 3 and out[None]["lang_pred"] == "ru"
    assert [s["lang"] for s in out[902]["spans"]] == ["aa", "bb"] and out[902]["lang_pred"] == "bb" and 0 < out[902]["score"] <= 1
    empty = nothing.select("doc_id", "text", "lang")
    assert language_id.identify(empty, language_id.fit_languages(empty)).count() == 0


def pieces(word):
    """The pieces of a word that the language model counts: 2 to 5 bytes between marks of its ends, and the whole."""
    raw = b"\x02" + word.lower().encode() + b"\x03"
    return [raw[i : i + n] for n in (2, 3, 4, 5) for i in range(len(raw) - n + 1)] + [("whole", raw)]


def test_word_scores_equal_plain_counts(spark):
    rng, bins = random.Random(12), 1 << 22
    vocab = {"aa": ["kato", "mira", "solu", "tepi", "été"], "bb": ["brugh", "schnok", "wulft", "kraam", "mira"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs, bins=bins)
    counts, held = {"aa": Counter(), "bb": Counter()}, {r[0] for r in docs.filter(~is_training_row()).collect()}
    for i, text, lang in rows:
        if i not in held:
            for w in text.split():
                counts[lang].update(pieces(w))
    log = lambda lang, x: math.log((counts[lang][x] + 0.5) / (sum(counts[lang].values()) + 0.5 * bins))
    words = ["kato", "mira", "brugh", "unseen", "été", "KATO"]
    scores = language_id.WordScores(model)
    scores.learn([words])
    for w in words:
        sums = [sum(log(lang, x) for x in pieces(w)) for lang in ("aa", "bb")]
        assert scores.of([w])[0][0] == pytest.approx([x - max(sums) for x in sums], abs=2e-3)


def test_language_of_equal_and_very_long_texts(spark):
    rows = [(i, " ".join(["kato mira solu", "brugh schnok wulft"][i % 2].split() * 8), ["aa", "bb"][i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = [(1, rows[0][1]), (1, rows[0][1]), (2, rows[0][1]), (3, "kato mira " * 300_000), (4, "brugh" * 200_000)]
    out = [tuple(r)[:3] for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), language_id.fit_languages(docs)).collect()]
    assert len(out) == 5 and len({x[1:] for x in out if x[0] < 3}) == 1 and {x[0]: x[1] for x in out} == {1: "aa", 2: "aa", 3: "aa", 4: "bb"}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        n, k = rng.integers(1, 40), rng.integers(1, 5)
        s = -rng.exponential(3, (n, k))
        if rng.random() < 0.5:
            s = s - np.repeat(rng.exponential(5, (8, k)), 5, 0)[:n]
        s, penalty = s - s.max(1, keepdims=True), rng.choice([0.5, 2, 6, 12])
        path, value = language_id.viterbi(s, penalty), s[0].copy()
        for t in range(1, n):
            value = s[t] + np.maximum(value, value.max() - penalty)
        assert s[np.arange(n), path].sum() - penalty * (np.diff(path) != 0).sum() == pytest.approx(value.max())


def test_pack_histogram():
    rng = np.random.default_rng(3)
    for hist in ({}, {2048: 4}, {1: 5000}, {1500: 40, 548: 39}, dict(Counter(rng.integers(1, 2049, 3000).tolist()))):
        plan, got = packing.pack_histogram(hist, 2048), Counter()
        for pattern, n in plan:
            assert sum(pattern) <= 2048 and n > 0
            for x in pattern:
                got[x] += n
        assert got == Counter(hist)
        least, n = -(-sum(k * v for k, v in hist.items()) // 2048), sum(n for _, n in plan)
        assert least <= n <= 1.03 * max(least, sum(v for k, v in hist.items() if k > 1024)) + 1


def test_knapsacks_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        size, n = 30, int(rng.integers(1, 6))
        lengths = rng.choice(np.arange(1, 30), n, replace=False)
        prices, bounds = rng.random(n), rng.integers(1, 5, n)
        want = np.full(size + 1, -np.inf)
        for times in itertools.product(*(range(b + 1) for b in bounds)):
            filled = int((lengths * times).sum())
            if filled <= size:
                want[filled] = max(want[filled], float((prices * times).sum()))
        best = packing.Knapsacks(lengths, prices, bounds, size)
        assert np.allclose(np.where(np.isinf(want), -1, want), np.where(np.isinf(best.value), -1, best.value))
        items = best.filling(size)
        assert all(k <= bounds[i] for i, k in items.items())
        assert sum(prices[i] * k for i, k in items.items()) == pytest.approx(want.max())


def test_program_covers_its_demand_and_places_most_sequences():
    rng = np.random.default_rng(3)
    lengths = np.unique(np.clip(rng.lognormal(5.5, 0.9, 400).astype(int), 1, 2047))
    demand = rng.integers(1, 40, len(lengths))
    x = packing.configuration_program(lengths, demand, 2048)
    got = Counter()
    for config, v in x.items():
        assert v > 0 and sum(k * n for k, n in config) <= 2048
        for k, n in config:
            got[k] += n * v
    assert all(got[int(k)] == pytest.approx(d, rel=1e-6) for k, d in zip(lengths, demand, strict=True))
    least = -(-int((lengths * demand).sum()) // 2048)
    assert sum(x.values()) <= 1.01 * least
    left = {int(k): int(d) for k, d in zip(lengths, demand, strict=True)}
    begun = packing.round_program(dict(left), 2048, 0.08, 0.9999)
    total = sum(n for _, n in packing.pack_histogram(left, 2048))
    assert total <= 1.01 * least + 1 and sum(begun.values()) >= 0.9 * total


def test_packing(docs, nothing):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    df, rows = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenizers.Tokenizer.from_file(path)
    ids = [[*own.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows]
    want = Counter()
    for r, x in zip(rows, ids, strict=True):
        first = (len(x) - 1) % 512 + 1
        for i, a in enumerate([0, *range(first, len(x), 512)]):
            b = first if i == 0 else a + 512
            want[(low(r[0]), i, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += 1
    out = packing.pack(df, path, size=512).collect()
    assert Counter((low(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        ends = np.cumsum([0, *(n for _, n in sorted(p))])
        assert [o for o, _ in sorted(p)] == ends[:-1].tolist() and ends[-1] <= 512
    assert packing.pack(nothing, path).count() == 0


def test_encoder_gives_the_tokenizers_ids():
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(1)
    own, fast = tokenizers.Tokenizer.from_file(path), packing.byte_pair_encoder(path)
    alphabet = "aZé ß\n\t 1²½१'sll`re…—👍🏽한漢ع\u00a0\u3000\u200b\r<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["<|endoftext|>", " " * 300, "a" * 3000, "it's we'll I'M", "\x00\x7f"]
    assert all(own.encode(t, add_special_tokens=False).ids == fast.encode(t, allowed_special="all") for t in texts)


def test_packing_gives_added_tokens_their_ids(spark):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    own, fast = tokenizers.Tokenizer.from_file(path), packing.byte_pair_encoder(path)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  \n", "a", "it's", "é", "7"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(500))]
    assert fast.encode(texts[0], allowed_special="all") == [64, 220, 50256, 275]
    want = Counter()
    for i, t in enumerate(texts):
        x = [*own.encode(t, add_special_tokens=False).ids, 0]
        first = (len(x) - 1) % 16 + 1
        for k, a in enumerate([0, *range(first, len(x), 16)]):
            b = first if k == 0 else a + 16
            want[(i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += 1
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, size=16).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want


def junk(rng):
    return rng.choice([lambda: " | ".join(rng.choices(WORDS, k=60)), lambda: " ".join(["Amber"] * 80), lambda: " ".join(w.upper() + "!!" for w in rng.choices(WORDS, k=70)), lambda: " ".join(w + "###" for w in rng.choices(WORDS, k=70))])()


def test_quality(spark, nothing):
    rng = random.Random(9)
    rows = [(i, junk(rng) if i % 6 == 0 else ". ".join(prose(rng, rng.randint(5, 14)).capitalize() for _ in range(9)) + ".") for i in range(900)]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows] + [(5000, None, 0.0), (5001, "", 0.0), (None, "Plain words here.", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(0, 900, 2)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert len(out) == 903 and all(0 <= s <= 1 for s in out.values())
    held = {r[0] for r in docs.filter(~is_training_row()).select("doc_id").collect()} - {None, 5000, 5001}
    assert np.mean([(out[i] >= 0.7) == (i % 6 != 0) for i in held]) > 0.95
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in out.items() if s >= 0.7}
    assert quality.fit_quality(nothing, labels) is None and quality.score_quality(nothing, None).count() == 0
    assert quality.drop_rejected(docs, labels.limit(0)).count() == 903


def plain_risk(positive, unlabelled, prior):
    loss = lambda z: math.log1p(math.exp(-z))
    mean = lambda xs: sum(xs) / len(xs)
    return prior * mean([loss(z) for z in positive]), mean([loss(-z) for z in unlabelled]) - prior * mean([loss(-z) for z in positive])


def test_risk_and_its_slopes():
    rng = np.random.default_rng(8)
    signs = set()
    for _ in range(40):
        p, u, prior = rng.normal(1, 2, 5), rng.normal(-1, 2, 7), rng.uniform(0.1, 0.9)
        own, rest = plain_risk(p, u, prior)
        risk, gp, gu = quality.risk_slopes(p, u, prior)
        assert risk == pytest.approx(own + max(0, rest))
        signs.add(rest >= 0)
        for x, g, of in ((p, gp, lambda z: (z, u)), (u, gu, lambda z: (p, z))):
            for i in range(len(x)):
                up, down = x.copy(), x.copy()
                up[i] += 1e-5
                down[i] -= 1e-5
                a, b = plain_risk(*of(up), prior), plain_risk(*of(down), prior)
                want = (sum(a) - sum(b)) if rest >= 0 else -(a[1] - b[1])
                assert g[i] == pytest.approx(want / 2e-5, abs=1e-6)
    assert signs == {True, False}


def test_class_prior():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85):
        positive = rng.normal(3, 1, 4000)
        unlabelled = np.where(rng.random(6000) < share, rng.normal(3, 1, 6000), rng.normal(-2, 1, 6000))
        assert quality.class_prior(positive, unlabelled) == pytest.approx(share, abs=0.06)


def test_fit_samples_are_there_at_any_size(spark):
    """A share of 1e-7, as of 10,000 rows among 1e11, still picks rows; few rows are all picked."""
    picked = spark.range(60_000_000).filter(chosen("language", F.col("id"), 10_000, 10**11)).count()
    assert 0 < picked < 30
    assert spark.range(50).filter(chosen("language", F.col("id"), 10_000, 50)).count() == 50
    assert 350 < spark.range(4000).filter(chosen("x", F.col("id"), 400, 4000)).count() < 450


def test_pick_rows_keeps_small_classes(spark):
    rows = [(i, f"text {i}", "big" if i % 100 else "small") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r["__lang"] for r in language_id.pick_rows(docs, 200, "doc_id", "text", "lang").collect())
    assert got["small"] == sum(1 for r in docs.filter(is_training_row()).collect() if r["lang"] == "small") and 150 < got["big"] < 250
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i in range(6000)] + [(1, None), (None, 1)], "doc_id long, quality int")
    picked = quality.pick_rows(docs, labels, 200, "doc_id", "quality").collect()
    assert sum(r["__p"] for r in picked) == got["small"] and 150 < sum(r["__u"] for r in picked) < 250 and all(r["lang"] == "small" for r in picked if r["__p"])


def test_quality_of_equal_odd_and_very_long_texts(spark):
    rng = random.Random(4)
    rows = [(i, junk(rng) if i % 6 == 0 else ". ".join(prose(rng, 9).capitalize() for _ in range(9)) + ".") for i in range(300)]
    long = " ".join(prose(rng, 12).capitalize() + "." for _ in range(40_000))
    rows += [(400, rows[1][1]), (401, rows[1][1]), (401, rows[1][1]), (402, long), (403, "x" * 3_000_000), (404, "\ud83d\ude00 " * 50), (405, " \n\t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(i, int(i % 6 != 0)) for i in range(300)], "doc_id long, quality int"))
    out = [(r["doc_id"], r["score"]) for r in quality.score_quality(docs, model).collect()]
    by = dict(out)
    assert len(out) == len(rows) and all(0 <= s <= 1 for _, s in out) and by[400] == by[401] == by[1] and by[402] > 0.5


def test_sharding(docs, nothing):
    df, rows = docs
    out = sharding.shard_rows(df, shards=5, rows_per_sort=7).collect()
    assert Counter((low(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == Counter((low(r[0]), 8 + len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots[k]) for k in range(5)) <= 1
    assert sharding.shard_rows(nothing).count() == 0


def test_matrix_in_two_steps_keeps_its_margins(spark):
    sent, counts = [], [5, 0, 17, 40, 3, 9, 22, 1, 30, 12]
    for seed in range(30):
        frame = spark.createDataFrame([(i, n) for i, n in enumerate(counts) if n], "__part int, count long")
        rows = {r["__part"]: np.diff([0, *r["__ends"]]) for r in sharding.matrix_rows(frame, [47, 46, 46], len(counts), seed).collect()}
        assert all(rows[i].sum() == n and (rows[i] >= 0).all() for i, n in enumerate(counts) if n)
        assert np.sum(list(rows.values()), axis=0).tolist() == [47, 46, 46]
        sent.append(rows[3][0])
    assert abs(np.mean(sent) - 40 * 47 / 139) < 2 and np.std(sent) > 1


def test_communication_matrix_keeps_its_margins():
    m = sharding.communication_matrix([5, 0, 17, 40], [21, 21, 20], 1)
    assert m.sum(1).tolist() == [5, 0, 17, 40] and m.sum(0).tolist() == [21, 21, 20] and (m >= 0).all()
    first = np.mean([sharding.communication_matrix([10, 10], [10, 10], s)[0, 0] for s in range(500)])
    assert abs(first - 5) < 0.2


def test_line_dedup(spark, nothing):
    rng = random.Random(7)
    common = [f"{prose(rng, 8)} and this line is long enough {i}" for i in range(4)]
    rows = []
    for i in range(40):
        lines = [rng.choice([*common, "short", "", f"  {common[0].upper()}\t", prose(rng, 12)]) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(lines), "x"))
    rows += [(50, None, "x"), (51, "", "x"), rows[3], (None, "\n".join(common), "x"), (None, common[1], "x")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(low(i))
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    want = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), low(i)) == low(i)]
        want[(low(i), "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    assert any(k[3] for k in want)
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    for first_docs, growth, fan_in in ((512, 16, 4), (3, 2, 2), (9, 3, 3)):
        out = line_dedup.line_dedup(df, first_docs=first_docs, growth=growth, fan_in=fan_in, bits=10).collect()
        assert Counter((low(r["doc_id"]), r["kept_text"], r["n_lines"], r["n_dropped"]) for r in out) == want
    assert line_dedup.line_dedup(nothing).count() == 0
    assert line_dedup.line_dedup(df.filter("doc_id IN (50, 51)")).agg(F.sum("n_lines"), F.sum("n_dropped")).first()[:] == (2, 0)


def test_runs_compact_and_tell_novel_keys(spark):
    runs = line_dedup.LineRuns(spark, 2)
    rows = spark.createDataFrame([(i, bytes([i % 5])) for i in range(20)], "__id long, __key binary").cache()
    novel = [runs.add(rows.filter(f"__id div 4 = {4 - k}")).filter("__top IS NOT NULL").count() for k in range(5)]
    assert novel == [4, 1, 0, 0, 0] and [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["__docs"], r["__top"][0]) for r in runs.merged().collect()} == {(4, 15), (4, 16), (4, 17), (4, 18), (4, 19)}
    runs.close()


def test_line_dedup_keeps_what_the_anti_join_calls_novel(spark, monkeypatch):
    """The line stays where a batch found its key novel: a run that forgets its founders changes the result."""
    line = "a line that is long enough to be looked at by the operator"
    df = spark.createDataFrame([(i, line) for i in range(20)], "doc_id long, text string")
    kept = lambda: sorted(r["doc_id"] for r in line_dedup.line_dedup(df, first_docs=3, growth=2).filter("n_dropped = 0").collect())
    assert kept() == [19]
    write = line_dedup.LineRuns._write
    monkeypatch.setattr(line_dedup.LineRuns, "_write", lambda self, rows: write(self, rows.withColumn("__top", F.expr("CAST(NULL AS STRUCT<__id: BIGINT>)"))))
    assert kept() == []


def test_hot_and_rare_lines_are_lost_alike(spark):
    line = "a line that is long enough to be looked at by the operator"
    rows = [(i, f"{line} of all\n{line} number {i % 60}\nown {i} {line}") for i in range(300)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), first_docs=50, growth=2)
    assert Counter(r["n_dropped"] for r in out.collect()) == {2: 240, 1: 59, 0: 1}


def test_many_lines(spark):
    """A text of many megabytes, beside documents that share some of its lines."""
    line = "this is the line with the number {} that stands in many texts"
    big = "\n".join(line.format(i) for i in range(60_000))
    rows = [(9, big), *((i, "\n".join([line.format(7 * i + k) for k in range(14)] + [line.format(5)])) for i in range(8))]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[9]["n_lines"], out[9]["n_dropped"]) == (60_000, 0) and [out[i]["n_dropped"] for i in range(8)] == [2, *[1] * 7]
