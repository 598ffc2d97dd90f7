import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagloom.llm import simhash, templates, toxicity
from lagloom.llm.common import id_and_text
from tests.llm.test_dedup import brute_lines


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before and after each stage."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet").cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def test_columns_and_order(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "n_tokens", "ids", "decoded"] and stages[-1].count() == stages[-2].count()


def test_toxic_documents_go(spark, sf_dir, stages):
    before = {r.doc_id for r in stages[0].collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = before - {r.doc_id for r in stages[1].collect()}
    texts = id_and_text(stages[0])
    model = toxicity.fit(texts.where(~toxicity.held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert gone == {r.doc_id for r in toxicity.evidence(texts, model).where("score >= 0.5").collect()}
    assert sum(labels.get(i) == 0 for i in gone) <= 1


def test_lines_go(stages):
    want = {r[0]: r for r in brute_lines([(r.doc_id, r.text) for r in stages[1].collect()])}
    after = stages[2].select("doc_id", "n_chars", "text", F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in after} == {i: w[3] for i, w in want.items()} and all(len(r.text) == r.n_chars for r in after)


def test_near_copies_go(stages):
    docs = {r.doc_id: r.text or "" for r in stages[2].collect()}
    sets = {i: set(simhash.shingle_hashes(simhash.folded_words(t), 5)) for i, t in docs.items()}
    part = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and part[a] != part[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = part[b], part[a]
                part = {i: new if p == old else p for i, p in part.items()}
    least = {}
    for i, p in part.items():
        least[p] = min(i, least.get(p, i))
    assert {r.doc_id for r in stages[3].collect()} == set(least.values())


def test_leaks_go(spark, sf_dir, stages):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    after = {r.doc_id for r in stages[4].collect()}
    held = {r.doc_id for r in stages[3].collect() if any(i.lower() in (r.text or "").lower() for i in items)}
    assert not held & after
    found = {r.doc_id for r in templates.leaks(stages[3], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in stages[3].collect()} - after == found


def test_odd_tables(spark, sf_dir, odd, none):
    for frame in (odd, none):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() <= frame.count()
