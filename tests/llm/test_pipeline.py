from __future__ import annotations

import corpus_pipeline
from helpers import awkward, table

from tableforge.llm.language import detect, train
from tableforge.llm.texts import read, stored

SMALL = "/root/testdata/sf0.001"


def test_stages_on_a_small_corpus(spark):
    docs = read(spark, SMALL, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "source_mix", "pieces"]
    stages = dict(corpus_pipeline.STAGES)
    judged = detect(docs, train(docs))
    out = stored(stages["language_id"](spark, docs, SMALL), "test")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in judged.filter("found.accepted").collect()}
    for name in names[1:-1]:
        out = stored(stages[name](spark, out, SMALL), "test")
        assert out.columns == docs.columns and not out.isEmpty()
    last = stages["pieces"](spark, out, SMALL)
    assert last.count() == out.count() and last.filter("NOT round_trip").isEmpty()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_pieces", "score", "round_trip", "ids"] and out.count() > 200


def test_awkward_and_empty_tables_pass_every_stage(spark):
    for rows in (awkward(), []):
        out = table(spark, rows)
        columns = out.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, out, SMALL), "test")
            assert out.columns == columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, out, SMALL).count() == out.count()
