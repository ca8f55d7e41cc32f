"""The pipeline's stages take effect, and its queries match SQL where they have any."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from folioframe.llm.common import table
from folioframe.llm.queries import ORACLES, QUERIES
from tests.helpers import normal, oracle
from tests.llm.test_operators import grams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(oracle(ORACLES[name], SF))


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = before = table(spark, sf_dir, "documents")
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas())
        frames[name] = docs.toPandas()
        if name != "packing":
            assert sorted(docs.columns) == sorted(before.columns)
    labels = table(spark, sf_dir, "labels").toPandas().set_index("doc_id")["quality"]
    kept = set(frames["quality"]["doc_id"])
    known = [i for i in before.toPandas()["doc_id"] if i in labels.index]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.97 * len(known)
    exact = frames["exact_copies"]
    assert exact["text"].is_unique and set(exact["text"]) == set(frames["quality"]["text"])
    sets = {t: grams(t) for t in exact["text"]}
    having = defaultdict(list)
    for t, g in sets.items():
        for x in g:
            having[x].append(t)
    near = {t: {u for u, n in Counter(u for x in g for u in having[x]).items() if u != t and n >= 0.8 * len(g | sets[u])} for t, g in sets.items()}
    left = set(frames["near_copies"]["text"])
    assert not any(near[t] & left for t in left)
    assert all(near[t] or not sets[t] for t in set(sets) - left)
    counts = frames["source_mix"].groupby("doc_id").size()
    assert counts.max() == 2 and set(counts.index) <= set(frames["near_copies"]["doc_id"])
    assert len(frames["packing"].query("piece == 0")) == len(frames["source_mix"])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("rows", [[], [(1, None, "en", None, 0), (2, None, None, "a", 0), (3, "", "en", "a", 0), (4, " \n ", "de", "b", 3), (None, "a few words of text", "en", "b", 19)]])
def test_run_on_empty_tables_and_without_labels(spark, tmp_path, rows):
    def write(name, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", [], "doc_id long, quality int, toxic int")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == ({None} if rows else set())
