"""Registered queries and the pipeline on the smallest driver table."""

import numpy as np
import pytest

import corpus_pipeline
from courtstats.llm import decontam, langid, mixing, secret_scan, simhash
from courtstats.llm.queries import ORACLES, QUERIES
from courtstats.sources.tables import table
from courtstats.testing import compare, duck_connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_on_the_whole_table(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ok, msg = compare(df, duck_connect(SF), ORACLES[name])
        assert ok, msg
    n = df.count()
    if name.startswith(("op10_", "op12_", "op13_")):
        assert n > 0
    else:
        src = "embeddings" if name.startswith("op9_") else "documents"
        assert n == table(spark, SF, src).count()


def test_pipeline_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    fine = {i for i, (_, _, out) in zip(texts, langid._label(list(texts.values()), model)) if not out}
    kept = corpus_pipeline.materialise(stage["language_id"](spark, docs, SF), "t")
    assert {r.doc_id for r in kept.collect()} == fine and kept.columns == docs.columns

    fp = {i: simhash.fingerprint((texts[i] or "").encode()) & (1 << 64) - 1 for i in fine}
    root = {i: i for i in fine}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    order = sorted(fine)
    for n, a in enumerate(order):
        for b in order[n + 1:]:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    kept = corpus_pipeline.materialise(stage["simhash_near_dedup"](spark, kept, SF), "t")
    first = {find(i) for i in fine}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first) and kept.columns == docs.columns

    def words(t):
        t = np.frombuffer((t or "").encode(), np.uint8)
        return decontam.words(t, np.array([0, len(t)]))[0]
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {i for i in first if not any(
        np.isin(x, words(texts[i])).sum() >= len(x) / 2 and decontam.align(x, words(texts[i])) >= len(x) for x in items)}
    kept = corpus_pipeline.materialise(stage["benchmark_decontamination"](spark, kept, SF), "t")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean) and kept.columns == docs.columns

    found = {r.doc_id: r.found for r in secret_scan.scan(kept).collect()}
    kept = corpus_pipeline.materialise(stage["secret_scans"](spark, kept, SF), "t")
    assert kept.columns == docs.columns
    for r in kept.collect():
        want, at = "", 0
        for s in found[r.doc_id]:
            if s.start >= at:
                want += texts[r.doc_id][at:s.start] + "[secret]"
            at = max(at, s.end)
        assert r.text == want + texts[r.doc_id][at:] and r.n_chars == (len(r.text) if found[r.doc_id] else r.n_chars)

    con = duck_connect(SF)
    con.register("kept", kept.select("doc_id", "text", "source").toArrow())
    ok, msg = compare(stage["mixing_sources"](spark, kept, SF), con, mixing.oracle(table="kept"))
    assert ok, msg


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "mixing_sources"]
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= table(spark, SF, "documents").count()
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(out.columns)


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "t")
        assert docs.count() == 0
