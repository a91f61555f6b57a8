"""The pipeline on a small table: what each stage keeps, changes and drops."""

import corpus_pipeline

from ..conftest import SF


def test_stages(spark):
    r = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    words = r.split()
    a = " ".join(words[(k * 7) % 24] + str(k) for k in range(120))
    b = " ".join(words[(k * 5) % 24] + str(k * 3) for k in range(150))
    rows = [(1, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (3, a.replace("alpha0", "zzz"), "en", "s", 9), (4, None, "en", "s", 0), (5, "12 34", "fr", "s", 5), (6, f"{b}\npassword=hunter2secret", "fr", "s", 0), (7, f"c {a[:400]} {b[::-1]}", "fr", "s", 0), (None, "words of no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            docs = corpus_pipeline.staged(out)[0]
            at[name] = {x.doc_id: x for x in docs.collect()}
    assert set(at["language ID"]) == {1, 2, 3, 6, 7, None}
    assert set(at["SimHash near-dedup"]) == {1, 6, 7, None}
    assert at["substring dedup"][1].text == a and len(at["substring dedup"][7].text) < len(rows[6][1]) and "\n" in at["substring dedup"][6].text
    assert "hunter2" not in at["secret scans"][6].text and "[SECRET]" in at["secret scans"][6].text and at["secret scans"][1].text == a
    assert {x.doc_id for x in out.collect()} == {1, 6, 7, None}


def test_near_duplicates_of_rows_that_share_an_id(spark):
    said = [" ".join(f"{w}{k}" for k in range(60)) for w in ("one", "two", "three", "four", "five")]
    rows = [(None, said[0]), (None, said[1]), (7, said[2]), (7, said[3]), (8, said[0]), (9, said[1]), (10, said[4]), (10, said[4]), (11, said[4])]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    want = [(None, said[0]), (None, said[1]), (7, said[2]), (7, said[3]), (10, said[4])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, want))


def test_clashing_column_names(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, f"{text} password=hunter2secret", "en", 1, 2, 3, 4, 5, 6, 7, 8), (2, text, "en", 1, 2, 3, 4, 5, 6, 7, 8), (3, " ".join(f"other{k}" for k in range(60)), "en", 1, 2, 3, 4, 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, pred int, score int, ambiguous int, key int, row int, owner int, at int, node int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = corpus_pipeline.staged(out)[0]
    kept = sorted(tuple(r)[3:] for r in docs.collect())
    assert kept == [(1, 2, 3, 4, 5, 6, 7, 8)] * 2 and stage is not None


def test_whole_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 150
