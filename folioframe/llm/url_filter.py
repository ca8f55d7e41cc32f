"""URL filter: rules for hosts and paths, and elsewhere the ratio of two character language models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import LOWER, UPPER, cut, table

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The rule that holds for (host, path), as a struct (rule, verdict), else null.

    A rule fits its host and all subdomains, if the path starts with the rule's. The longest wins: the longer host and
    path together, then the longer host, then the first.
    """
    longest = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    out = F.lit(None)
    for i in reversed(longest):
        verdict, host, path = rules[i]
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _windows(urls: pd.Series, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all URLs end to end, each after ``order`` marks and closed by one, and how many characters each has."""
    raw = [u.encode("utf-8", "replace") for u in urls]
    data = np.frombuffer(b"".join(b"\x01" * order + u + b"\x02" for u in raw), dtype=np.uint8)
    return data, np.array([len(u) + 1 for u in raw])


def _context_hashes(data: np.ndarray, sizes: np.ndarray, order: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each character but the marks: bins of its contexts of 0 to ``order`` characters, alone and with the character."""
    ends = np.cumsum(sizes + order)
    inside = np.ones(len(data), bool)
    for k in range(order):
        inside[ends - sizes - order + k] = False
    at = np.flatnonzero(inside)
    contexts, whole = [], []
    h = np.full(len(at), 14695981039346656037, dtype=np.uint64)
    for k in range(order + 1):
        if k:
            h = (h ^ data[at - k].astype(np.uint64)) * np.uint64(1099511628211)
        mix = h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        both = (mix ^ (data[at].astype(np.uint64) + np.uint64(257))) * np.uint64(0xC2B2AE3D27D4EB4F)
        mix = mix * np.uint64(0xC2B2AE3D27D4EB4F)
        contexts.append(((mix >> np.uint64(33)) % np.uint64(bins)).astype(np.int64))
        whole.append(((both >> np.uint64(33)) % np.uint64(bins)).astype(np.int64))
    return np.array(contexts), np.array(whole)


def log_ratio(urls: pd.Series, counts: np.ndarray, order: int, bins: int, weight: float) -> np.ndarray:
    """Mean log2 of accepted over rejected likelihood, for each character of a URL.

    The model of order k is the model of order k - 1 as a Dirichlet prior of ``weight``, updated by the counts after the
    last k characters; order -1 is uniform over 256.
    """
    if not len(urls):
        return np.zeros(0)
    data, sizes = _windows(urls, order)
    contexts, whole = _context_hashes(data, sizes, order, bins)
    logs = []
    for label in (0, 1):
        p = np.full(contexts.shape[1], 1 / 256)
        for k in range(order + 1):
            p = (np.minimum(counts[label, 1, whole[k]], counts[label, 0, contexts[k]]) + weight * p) / (counts[label, 0, contexts[k]] + weight)
        logs.append(np.log2(p))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(logs[0] - logs[1], starts) / sizes


def fit_urls(pages: DataFrame, order: int, bins: int, weight: float, url_col: str) -> tuple[np.ndarray, float]:
    """Character counts of the accepted and the rejected URLs, and the threshold of the mean log ratio.

    Learns from every URL that a rule judges (column __rule): three quarters of the URLs, by crc32, are counted, all of
    them on the executors, into ``bins`` bins a class and kind; the driver gets at most ``4 * bins`` counts. On the other
    quarter, scores in a histogram of 2,000 bins set the threshold: the one with the least sum of the two error rates, the
    middle of its range. Without rejected or accepted URLs the threshold is such that all, or none, are accepted.
    """
    ruled = pages.filter("__rule IS NOT NULL").select(F.col(url_col).alias("__url"), (F.col("__rule.verdict") == "block").cast("int").alias("__label"), (F.crc32(F.col(url_col).cast("binary")) % 4 == 2).alias("__held"))
    ruled = cut(ruled)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 2, bins), np.int64)
        for frame in frames:
            for label in (0, 1):
                urls = frame["__url"][frame["__label"] == label]
                if len(urls):
                    for i, at in enumerate(_context_hashes(*_windows(urls, order), order, bins)):
                        total[label, i] += np.bincount(at.ravel(), minlength=bins)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total.ravel()[at]})

    got = ruled.filter("NOT __held").select("__url", "__label").mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(4 * bins)
    counts[got["at"].to_numpy(dtype=int)] = got["n"].to_numpy(dtype=float)
    counts = counts.reshape(2, 2, bins)
    if not counts[0].any() or not counts[1].any():
        return counts, -np.inf if not counts[1].any() else np.inf

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ratio = log_ratio(frame["__url"], counts, order, bins, weight)
            yield pd.DataFrame({"label": frame["__label"], "step": np.clip(np.floor(ratio * 100) + 1000, 0, 1999).astype(int)})

    hist = ruled.filter("__held").select("__url", "__label").mapInPandas(scored, "label int, step int").groupBy("label", "step").count().toPandas()
    by = np.zeros((2, 2000))
    by[hist["label"].to_numpy(dtype=int), hist["step"].to_numpy(dtype=int)] = hist["count"].to_numpy(dtype=float)
    if not by[0].any() or not by[1].any():
        return counts, 0.0
    share = by / by.sum(1, keepdims=True)
    wrong = np.concatenate([[0], share[0].cumsum()]) + np.concatenate([share[1][::-1].cumsum()[::-1], [0]])
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return counts, float((least.mean() - 1000) / 100)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, order: int = 5, bins: int = 1 << 18, weight: float = 2.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict and log_ratio (where no rule holds).

    Without a rule, a URL is allowed if its mean log ratio is at least the threshold. A null URL is scored as empty text.
    Other columns are ignored; an empty table gives an empty result.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("__id"), url.alias("__u"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("__rule", rule_column(rules))
    counts, threshold = fit_urls(rows.filter(F.col("__u").isNotNull()), order, bins, weight, "__u")

    @F.pandas_udf("double")
    def ratio(urls: pd.Series) -> pd.Series:
        return pd.Series(log_ratio(urls, counts, order, bins, weight), dtype=float)

    rows = rows.withColumn("__ratio", ratio(F.coalesce("__u", F.lit(""))))
    verdict = F.when(F.col("__rule").isNotNull(), F.col("__rule.verdict")).when(F.col("__ratio") >= threshold, "allow").otherwise("block")
    return rows.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("__rule").isNull(), F.col("__ratio")).alias("log_ratio"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages"))
