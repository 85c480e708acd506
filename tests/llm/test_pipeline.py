"""The pipeline's stages against plain versions, on the smallest tables."""

from collections import Counter

import corpus_pipeline
from cliploom.llm import lines, minhash, packing, quality, templates
from cliploom.llm.common import stash, table

TINY = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, TINY, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near dedup", "benchmark decontamination", "packing"]
    good = stash(quality.stage(spark, docs, TINY), "good")
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.query(spark, TINY).where("kept").collect()}
    cut = stash(lines.stage(spark, good, TINY), "cut")
    assert cut.columns == columns and cut.count() == good.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    single = stash(minhash.stage(spark, cut, TINY), "single")
    classes = minhash.classes(cut).collect()
    assert single.columns == columns
    assert Counter(r.doc_id for r in single.collect()) == Counter({r.class_id for r in classes})
    clean = stash(templates.stage(spark, single, TINY), "clean")
    leaked = {r.doc_id for r in templates.leaks(single, table(spark, TINY, "benchmark")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    packed = packing.stage(spark, clean, TINY).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    again = corpus_pipeline.run(spark, TINY).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, packed))
