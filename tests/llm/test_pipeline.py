"""The pipeline's stages: what they keep, and that they cope with empty tables and odd rows."""

import subprocess
import sys

import corpus_pipeline as P
import numpy as np
import psutil
import pytest
from conftest import SF

from tickloom.llm.common import giving_back, stored, table
from tickloom.llm.decontam import contaminated
from tickloom.llm.jaccard import jaccard_components
from tickloom.llm.packing import best_fit_packing
from tickloom.llm.passages import repeated_passages
from tickloom.llm.quality import quality_rules
from tickloom.llm.queries import tokenizer_path


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    stage = dict(P.STAGES)
    assert list(stage) == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    kept = {r.doc_id for r in quality_rules(docs).where("kept").collect()}
    docs1 = stored(stage["quality rules"](spark, docs, SF))
    assert docs1.columns == names and sorted(r.doc_id for r in docs1.collect()) == sorted(kept)
    first = {r.component_id for r in jaccard_components(docs1).collect()}
    docs2 = stored(stage["n-gram Jaccard join"](spark, docs1, SF))
    assert docs2.columns == names and sorted(r.doc_id for r in docs2.collect()) == sorted(first)
    spans = {r.doc_id for r in repeated_passages(docs2).collect()}
    docs3 = stored(stage["substring dedup"](spark, docs2, SF))
    old, new = {r.doc_id: r for r in docs2.collect()}, {r.doc_id: r for r in docs3.collect()}
    assert docs3.columns == names and set(old) - set(new) <= spans and all(new[i] == old[i] for i in new if i not in spans)
    assert all(new[i].n_chars == len(new[i].text) < len(old[i].text) for i in new if i in spans)
    bad = {r.doc_id for r in contaminated(docs3, table(spark, SF, "benchmark")).collect()}
    docs4 = stored(stage["benchmark decontamination"](spark, docs3, SF))
    assert {r.doc_id for r in docs4.collect()} == set(new) - bad
    want = {(r.doc_id, r.piece, r.length) for r in best_fit_packing(docs4, tokenizer_path()).collect()}
    assert {(r.doc_id, r.piece, r.length) for r in stage["best-fit packing"](spark, docs4, SF).collect()} == want


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_stage_edges(spark, k):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (None, text, None, "b", 2), (3, "", "fr", "a", 0)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node long, component_id string")
    stage = P.STAGES[k][1]
    out = stage(spark, docs, SF)
    assert out.count() <= 5
    if k < len(P.STAGES) - 1:
        assert out.columns == docs.columns
    if k == 1:
        assert out.where("doc_id = 1").count() == 1
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_texts_that_share_a_doc_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(5, a), (5, b), (7, a), (3, b + " more"), (9, None), (9, ""), (None, a), (None, "c " * 60)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in P.STAGES[1][1](spark, docs, SF).collect())
    assert kept == sorted([(5, a), (3, b + " more"), (9, ""), (9, ""), (0, "c " * 60)])


def test_passages_leave_other_texts_of_a_doc_id_alone(spark):
    import random

    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    part = words(60)
    holds, others = [f"{words(70)} {part} {words(50)}" for _ in range(3)], [words(160) for _ in range(3)]
    rows = [(i, t, "en", "s", len(t), 1) for i, t in zip([5, None, 7, 5, None, 7], holds + others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_hash long")
    out = P.STAGES[2][1](spark, docs, SF).collect()
    texts = [r.text for r in out]
    assert len(out) == 6 and set(others) <= set(texts) and sum(part in t for t in texts) == 1
    assert all(r.n_chars == len(r.text) and r.text_hash == 1 for r in out)
    for t, own in zip(holds, [t.replace(part + " ", "") for t in holds]):
        assert t in texts or own in texts  # no word but the passage's is cut


def test_freed_memory_goes_back_to_the_system():
    def run(batches):
        for _ in batches:
            made = [np.ones(60_000, np.uint8) for _ in range(4000)]
            held.append(made[-1])  # above what is freed
            yield len(made)

    held, before = [], psutil.Process().memory_info().rss
    assert list(giving_back(run)([1, 2])) == [4000, 4000]
    assert psutil.Process().memory_info().rss - before < 60e6


def test_idle_workers_keep_neither_encoder_nor_tables():
    """In a process of its own, as the workers of the other tests have run other tasks."""
    code = """
import sys
import corpus_pipeline as P
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def held(batches):
    import pyarrow as pa
    from tickloom.llm import common, tokens
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"n": [len(common._powers) + len(tokens._encoders)]})
docs = spark.createDataFrame([(i, " ".join(f"word{j * j % (i + 7)}" for j in range(99))) for i in range(9)], "doc_id long, text string")
for name, stage in P.STAGES[1:]:
    stage(spark, docs, sys.argv[1]).count()
    print("HELD", name, sum(r.n for r in spark.range(0, 400, 1, 8).mapInArrow(held, "n long").collect()))
"""
    said = subprocess.run([sys.executable, "-c", code, SF], capture_output=True, text=True, timeout=600)
    found = [x for x in said.stdout.splitlines() if x.startswith("HELD")]
    assert found == [f"HELD {name} 0" for name, _ in P.STAGES[1:]], said.stderr[-2000:]
