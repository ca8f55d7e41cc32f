"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights, then rounded."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.common import cut, table, text_of


def byte_pair_encoder(path: str):
    """The encoder of a byte-level BPE file in the JSON format of the tokenizers library.

    The file's vocabulary is run by tiktoken, which gives the same ids several times faster. Where a text holds an added
    token's content, ``encode`` with all special tokens allowed gives that token's id, as the library does.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    split = model.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("normalizer"):
        raise ValueError("only files that split text by the byte-level rule alone")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = model.get("added_tokens", [])
    if any(x[k] for x in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that look at the text around them")
    special = {x["content"]: x["id"] for x in added}
    ranks = {bytes(chars[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    # The byte-level rule of the library, which files name but do not hold: a fixed value.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (__id, piece, start, length, ids_crc32): a document's ids and ``end_id``, cut where it is longer than ``size``.

    The first piece is the shorter one; all others have ``size`` ids.
    """

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_pair_encoder(tokenizer)
        for frame in frames:
            out = []
            for key, text in zip(frame["__id"], frame["__text"], strict=True):
                ids = np.array([*encoder.encode(text, allowed_special="all"), end_id], dtype="<u4")
                ends = list(range((len(ids) - 1) % size + 1, len(ids) + 1, size))
                out += [(key, i, b - a, a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pd.DataFrame({"__id": pd.Series(columns[0], dtype=frame["__id"].dtype), "piece": columns[1], "length": columns[2], "start": columns[3], "ids_crc32": columns[4]})

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    return rows.mapInPandas(cut_up, f"__id {kind}, piece int, length long, start long, ids_crc32 long").select("__id", "piece", "start", "length", "ids_crc32")


class Knapsacks:
    """The dearest fillings of every exact capacity up to ``size``, by dynamic programming.

    Length i may be taken ``bounds[i]`` times; it is split into items of 1, 2, 4, ... times and the rest.
    """

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, bounds: np.ndarray, size: int):
        items = [(i, n) for i, bound in enumerate(bounds.tolist()) for n in self._times(bound)]
        self.kinds, self.times = np.array(items, dtype=np.int64).T.reshape(2, -1)
        self.weights, worth = lengths[self.kinds] * self.times, prices[self.kinds] * self.times
        self.value = np.full(size + 1, -np.inf)
        self.value[0] = 0.0
        took = np.zeros((len(items), size + 1), dtype=bool)
        for j, (weight, price) in enumerate(zip(self.weights.tolist(), worth.tolist(), strict=True)):
            new = self.value[:-weight] + price
            np.greater(new, self.value[weight:], out=took[j, weight:])
            np.maximum(new, self.value[weight:], out=self.value[weight:])
        self._took = np.ascontiguousarray(took.T)
        #: The best value with at most so much capacity, and the capacity that has it.
        self.top = np.maximum.accumulate(self.value)
        self.at = np.maximum.accumulate(np.where(self.value >= self.top, np.arange(size + 1), 0))

    @staticmethod
    def _times(bound: int) -> list[int]:
        out, n = [], 1
        while bound > 0:
            out.append(min(n, bound))
            bound, n = bound - out[-1], 2 * n
        return out

    def filling(self, capacity: int) -> dict[int, int]:
        """How often the best filling with at most ``capacity`` takes each length."""
        out, c, j = {}, int(self.at[capacity]), len(self.kinds)
        while c > 0:
            j = j - 1 - int(self._took[c, :j][::-1].argmax())
            k = int(self.kinds[j])
            out[k] = out.get(k, 0) + int(self.times[j])
            c -= int(self.weights[j])
        return out


def configuration_program(lengths: np.ndarray, demand: np.ndarray, size: int, eta: float = 4.0, near: float = 0.98, seed: int = 1) -> dict[tuple[tuple[int, int], ...], float]:
    """The program's solution by multiplicative weights: configurations of (length, times) and how often each is used.

    A length's price is its share of ``size`` times exp(-eta * the part of its demand that is covered). Each round prices
    the open lengths with one knapsack program. For each open length from the dearest on, the best configuration with it is
    used, if it is worth at least ``near`` of the round's best, until a length in it has gained ``1 / eta`` of its demand in
    this round or is covered. No configuration takes more of a length than there is, so that it can be used whole. The
    rounds go on until all demand is covered: exactly, as no length gets more than its demand.
    """
    rng, covered, need, x = np.random.default_rng(seed), np.zeros(len(lengths)), demand.astype(float), {}

    def use(which: np.ndarray, times: np.ndarray, most: np.ndarray) -> bool:
        step = float(((most[which] - covered[which]) * need[which] / times).min())
        if step <= 1e-9:
            return False
        covered[which] += step * times / need[which]
        key = tuple(sorted(((int(lengths[i]), int(n)) for i, n in zip(which, times, strict=True)), reverse=True))
        x[key] = x.get(key, 0.0) + step
        return True

    while len(live := np.flatnonzero(covered < 1 - 1e-9)):
        live = rng.permutation(live)
        open_lengths, bounds = lengths[live], np.minimum(demand[live], size // lengths[live])
        prices = open_lengths / size * np.exp(-eta * (covered[live] - covered[live].min()))
        best = Knapsacks(open_lengths, prices, bounds, size)
        worth = prices + best.top[size - open_lengths]
        most, used = np.minimum(covered + 1 / eta, 1.0), False
        order = np.argsort(-worth, kind="stable")
        for k in order[worth[order] >= near * worth[order[0]]].tolist():
            if covered[live[k]] >= most[live[k]] - 1e-12:
                continue
            items = best.filling(size - int(open_lengths[k]))
            items[k] = items.get(k, 0) + 1
            which, times = np.array(list(items)), np.array(list(items.values()))
            if (times <= bounds[which]).all():
                used |= use(live[which], times, most)
        if not used:
            items = best.filling(size)
            use(live[np.array(list(items))], np.array(list(items.values())), most)
    return x


def best_fit(left: dict[int, int], size: int, begun: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing of a histogram into sequences that are ``begun`` or new; such as are filled alike go together."""
    groups: dict[int, dict[tuple[int, ...], int]] = {}

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = groups.setdefault(size - sum(pattern), {})
        room[pattern] = room.get(pattern, 0) + n

    for pattern, n in begun.items():
        put(pattern, n)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r, g in groups.items() if r >= length and g), default=None)
            if room is None:
                fits = size // length
                put((length,) * min(n, fits), max(1, n // fits))
                n -= min(n, fits) * max(1, n // fits)
                continue
            pattern, have = next(iter(groups[room].items()))
            used = min(n, have)
            groups[room][pattern] -= used
            if not groups[room][pattern]:
                del groups[room][pattern]
            put((*pattern, length), used)
            n -= used
    out: dict[tuple[int, ...], int] = {}
    for g in groups.values():
        for pattern, n in g.items():
            out[pattern] = out.get(pattern, 0) + n
    return out


def round_program(left: dict[int, int], size: int, rest: float, full: float) -> dict[tuple[int, ...], int]:
    """Whole numbers of the program's configurations; takes their pieces out of ``left``.

    Each configuration that is at least ``full`` full (or as full as the mean one, where that is less) is rounded down;
    then those with the largest remainders are rounded up, while their pieces last. The program for the residual demand is
    rounded in the same way, and so on, until less than ``rest`` of the tokens are left or a program places nothing.
    """
    out: dict[tuple[int, ...], int] = {}
    tokens = remaining = sum(k * v for k, v in left.items())
    goal = rest * tokens

    def use(config: tuple[tuple[int, int], ...], most: int) -> int:
        nonlocal remaining
        filled = sum(k * n for k, n in config)
        count = min(most, int((remaining - goal) // filled) + 1, *(left.get(k, 0) // n for k, n in config))
        if count <= 0 or remaining <= goal:
            return 0
        pattern = tuple(k for k, n in config for _ in range(n))
        out[pattern] = out.get(pattern, 0) + count
        remaining -= count * filled
        for k, n in config:
            left[k] -= n * count
            if not left[k]:
                del left[k]
        return count

    while remaining > goal:
        lengths = np.array(sorted(left), dtype=np.int64)
        x = configuration_program(lengths, np.array([left[int(k)] for k in lengths]), size)
        fill = {c: sum(k * n for k, n in c) / size for c in x}
        least = min(full, sum(fill[c] * v for c, v in x.items()) / sum(x.values()))
        good = [c for c in x if fill[c] >= least - 1e-9]
        placed = sum(use(c, int(x[c] + 1e-9)) for c in sorted(good, key=lambda c: (-x[c], c)))
        placed += sum(use(c, 1) for c in sorted(good, key=lambda c: (int(x[c]) - x[c], -fill[c], c)))
        if not placed:
            break
    return out


def pack_histogram(histogram: dict[int, int], size: int, rest: float = 0.08, full: float = 0.9999) -> list[tuple[tuple[int, ...], int]]:
    """How many sequences of each configuration hold exactly the pieces of ``histogram`` (length to count).

    The program places all but ``rest`` of the tokens; best-fit decreasing puts what its rounding leaves into the gaps of
    these sequences and into new ones.
    """
    left = {k: int(v) for k, v in histogram.items() if v and k < size}
    begun = round_program(left, size, rest, full)
    out = best_fit(left, size, begun)
    if histogram.get(size):
        out[(size,)] = out.get((size,), 0) + int(histogram[size])
    return sorted(out.items())


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, where the pieces of rank r go: arrays (first rank, first sequence, pieces a sequence, first offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, n in plan:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            out.setdefault(length, []).append((taken.get(length, 0), base, each, at))
            taken[length] = taken.get(length, 0) + each * n
            at += each * length
        base += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cell_bits: int = 8) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of ``end_id``. The driver gets the histogram of lengths, at most ``size`` rows, solves
    the program for it and sends back the slots: one row for each used configuration and length, whose number depends on
    the number of lengths, not on that of documents. Pieces of a length are ranked within ``2 ** cell_bits`` ranges of a
    hash, whose counts are added up, so a hot length meets in no task. Rows that share an id are packed one by one. Other
    columns are ignored; an empty table gives an empty result.
    """
    pieces = pieces_of(docs, tokenizer, size, end_id, id_col, text_col)
    mixed = F.xxhash64(F.monotonically_increasing_id(), F.col("start"))
    pieces = cut(pieces.withColumn("__u", mixed).withColumn("__cell", F.shiftrightunsigned("__u", 64 - cell_bits).cast("int")))
    counts = cut(pieces.groupBy("length", "__cell").count())
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    slots = slots_of(pack_histogram(histogram, size))
    starts = counts.withColumn("__first", F.sum("count").over(Window.partitionBy("length").orderBy("__cell")) - F.col("count")).drop("count")
    rows = pieces.join(starts, ["length", "__cell"])
    rank = F.row_number().over(Window.partitionBy("length", "__cell").orderBy("__u", "ids_crc32")) - 1
    rows = rows.select("__id", "piece", "start", "length", "ids_crc32", (F.col("__first") + rank).alias("__rank"))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            length, rank = frame["length"].to_numpy(), frame["__rank"].to_numpy()
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, base, each, start = slots[int(k)]
                which = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[which]
                sequence[at] = base[which] + within // each[which]
                offset[at] = start[which] + within % each[which] * k
            yield frame.drop(columns="__rank").assign(sequence_id=sequence, offset=offset)

    kind = dict(docs.dtypes)[id_col]
    out = rows.mapInPandas(placed, f"__id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("__id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2,048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
