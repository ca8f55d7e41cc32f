"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.common import chosen, is_training_row, table

WORD = re.compile(r"[^\W\d_]+")
#: Unicode blocks of scripts: first and last code point. Fixed values of the Unicode standard; all else is script 0.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF))), ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))), ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)), ("hebrew", ((0x590, 0x5FF),)), ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))), ("devanagari", ((0x900, 0x97F),)), ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)), ("telugu", ((0xC00, 0xC7F),)), ("thai", ((0xE00, 0xE7F),)), ("georgian", ((0x10A0, 0x10FF),)), ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))), ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))), ("ethiopic", ((0x1200, 0x137F),)), ("khmer", ((0x1780, 0x17FF),)),
)


def script_of(word: str) -> int:
    at = ord(word[0])
    for i, (_, blocks) in enumerate(SCRIPTS, 1):
        if any(a <= at <= b for a, b in blocks):
            return i
    return 0


def grams_of(words: list[str], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pieces of 2 to 5 bytes of the words in lower case between marks of their ends, and the words as wholes.

    Returns the bins of all pieces, word after word, and where each word's begin.
    """
    raw = [b"\x02" + w.lower().encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw) + b"\0" * 5, dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in raw])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data) - 5)
    h = data[:-5] + np.uint64(0x100)
    parts, owners = [], []
    of = np.repeat(np.arange(len(words)), sizes)
    for n in (2, 3, 4, 5):
        h = h * np.uint64(0x100000001B3) + data[n - 1 : n - 1 + len(h)] + np.uint64(1)
        inside = left >= n
        parts.append(h[inside] ^ np.uint64(n << 56))
        owners.append(of[inside])
    parts.append(np.array([zlib.crc32(w) for w in raw], dtype=np.uint64))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    mixed = (np.concatenate(parts)[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    return (mixed % np.uint64(bins)).astype(np.int64), starts


class WordScores(dict):
    """Rows of word scores by word: log likelihoods by language less the largest, and the word's length.

    ``learn`` scores new words together. Up to ``most`` words are remembered; then the memory starts anew.
    """

    def __init__(self, model: dict, most: int = 800_000):
        super().__init__()
        self.model, self.most = model, most
        self.scores, self.sizes = np.zeros((1024, len(model["langs"])), np.float32), np.zeros(1024, np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self) >= self.most:
            self.clear()
        new = list({w for words in texts for w in words if w not in self})
        if not new:
            return
        n, m = len(self), len(self) + len(new)
        while m > len(self.scores):
            self.scores, self.sizes = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        at, starts = grams_of(new, self.model["bins"])
        found = np.add.reduceat(self.model["logs"][at], starts, axis=0)
        fits = self.model["scripts"][[script_of(w) for w in new]]
        found = np.where(fits, found, found.min(axis=1, keepdims=True) - 50.0)
        found[~fits.any(axis=1)] = 0
        self.scores[n:m] = found - found.max(axis=1, keepdims=True)
        self.sizes[n:m] = [len(w) for w in new]
        self.update(zip(new, range(n, m), strict=True))

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = [self[w] for w in words]
        return self.scores[at], self.sizes[at]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The labels of the words whose sum of scores less ``penalty`` for each switch is the largest.

    Scores are at most 0, with 0 for a word's best label.

    Where no run of words gains more than half the penalty by another label than the best for all, that label holds
    throughout: a path with j other runs pays j - 1 penalties at least, and one of a single label gains nothing.
    """
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gain = np.vstack([np.zeros((1, k)), np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)])
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2:
        return np.full(n, best)
    rows, after = scores.tolist(), {}

    def until(label: int, t: int) -> int:
        """The first word from t on for which the label isn't the best."""
        if label not in after:
            places = np.where(scores[:, label] < 0, np.arange(n), n)
            after[label] = np.minimum.accumulate(places[::-1])[::-1]
        return int(after[label][t])

    value, trail, t = rows[0], [], 1
    while t < n:
        top = max(value)
        label, switch = value.index(top), top - penalty
        if sum(v > switch for v in value) == 1 and (end := until(label, t)) > t:
            # No other label is ahead of a switch, nor can be while this one is the best: all come from it at the end.
            trail.append((t, end, label, None))
            value = [switch + x for x in rows[end - 1]]
            value[label] = top
            t = end
            continue
        trail.append((t, t + 1, label, value))
        value = [(v if v >= switch else switch) + x for v, x in zip(value, rows[t], strict=True)]
        t += 1
    out = np.empty(n, dtype=np.int64)
    out[-1] = state = value.index(max(value))
    for t, end, label, value in reversed(trail):
        if value is None or value[state] < value[label] - penalty:
            state = label
        out[t - 1 : end - 1] = state
    return out


def label_text(text: str | None, found: list[str], model: dict, words: WordScores) -> tuple[str, float, list[tuple[str, int, int]]]:
    """For a text and its words: the language of most letters, the share of letters in it weighed by certainty, and the spans (lang, start, end) in code points."""
    langs = model["langs"]
    if not found or not langs or not any(map(str.isalpha, text)):
        return "und", 0.0, []
    scores, sizes = words.of(found)
    path = viterbi(scores, model["penalty"])
    letters = np.bincount(path, weights=sizes, minlength=len(langs))
    top = int(letters.argmax())
    changes = np.flatnonzero(np.diff(path)) + 1
    if len(changes):
        at = [m.span() for m in WORD.finditer(text)]
        cuts = [0, *changes.tolist(), len(found)]
        spans = [(langs[path[a]], at[a][0], at[b - 1][1]) for a, b in zip(cuts, cuts[1:], strict=False)]
        own = scores[path == top].sum(0, dtype=np.float64)
    else:
        last = found[-1]
        spans = [(langs[top], text.index(found[0]), text.rindex(last) + len(last))]
        own = scores.sum(0, dtype=np.float64)
    sure = 1.0 / np.exp(np.clip(own - own[top], -50, 50)).sum()
    return langs[top], float(letters[top] / sizes.sum() * sure), spans


def pick_rows(docs: DataFrame, fit_rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (__text, __lang) to learn from: about ``fit_rows`` rows of the training fold a language, by a hash of the id.

    All where a language has fewer. The shares are doubles, so there are rows to learn from at any size of the table.
    Languages are few: their counts, a row each, are collected and sent back.
    """
    rows = docs.filter(is_training_row(id_col)).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col(lang_col) == lang) & chosen("language", F.col(id_col), fit_rows, n))
    return rows.filter(keep).select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))


def fit_languages(docs: DataFrame, fit_rows: int = 3_000, bins: int = 1 << 16, penalty: float = 12.0, least_script: float = 0.005, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Smoothed log frequencies of hashed word pieces by language and the scripts that each language uses.

    Learns from the rows of ``pick_rows``; their whole texts are counted on the executors into ``bins`` bins a language,
    and the counts (at most ``bins`` rows a language and task) are added up by language and bin. Languages are in the order
    of their names.
    """
    picked = pick_rows(docs, fit_rows, id_col, text_col, lang_col)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, texts in frame.groupby("__lang")["__text"]:
                total = counts.setdefault(lang, np.zeros(bins + len(SCRIPTS) + 1, np.int64))
                words = Counter(w for t in texts for w in WORD.findall(t))
                if words:
                    at, starts = grams_of(list(words), bins)
                    times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
                    total[:bins] += np.bincount(at, weights=np.repeat(times, np.diff([*starts, len(at)])), minlength=bins).astype(np.int64)
                    total[bins:] += np.bincount([script_of(w) for w in words], weights=times, minlength=len(SCRIPTS) + 1).astype(np.int64)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": total[at]})

    rows = picked.mapInPandas(counted, "lang string, bin int, n long")
    table_ = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table_["lang"].unique())
    counts = np.zeros((bins + len(SCRIPTS) + 1, len(langs)))
    counts[table_["bin"].to_numpy(dtype=int), np.searchsorted(langs, table_["lang"].to_numpy(dtype=str)) if langs else []] = table_["n"].to_numpy(dtype=float)
    grams, scripts = counts[:bins], counts[bins:]
    logs = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * bins)) if langs else grams
    return {"langs": langs, "bins": bins, "logs": logs.astype(np.float32), "scripts": scripts >= np.maximum(1, least_script * scripts.sum(0)), "penalty": penalty}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, lang_pred, score and spans (lang, start, end) in code points.

    A text that is null or has no letter is ``und`` with score 0 and no spans. Words of a script that no learned language
    uses say nothing. Ties go to the first language by name. Rows with equal texts have equal results. Other columns are
    ignored; an empty table gives an empty result, and a model without languages calls every text ``und``.
    """

    def labelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordScores(model)
        for frame in frames:
            out = []
            for i in range(0, len(frame), 256):
                texts = frame["__text"].iloc[i : i + 256].tolist()
                found = [WORD.findall(t) if t else [] for t in texts]
                if model["langs"]:
                    words.learn(found)
                out += [label_text(t, w, model, words) for t, w in zip(texts, found, strict=True)]
            yield pd.DataFrame({"__id": frame["__id"], "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "spans": [x[2] for x in out]})

    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("__id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInPandas(labelled, schema).withColumnRenamed("__id", id_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and its spans."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_languages(docs))
    return out.select("doc_id", (~is_training_row("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
