"""Every stage of the corpus pipeline against a plain version over the stage's own input."""

import corpus_pipeline
import numpy as np
from test_text_operators import BASE, SF, brute_force_hits, brute_force_lines, brute_force_links


def test_stages(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        if name == "packing":
            ends = {}
            for r in out.collect():
                ends[r.doc_id] = max(ends.get(r.doc_id, 0), r.start + r.length)
            assert set(ends) == set(before) and np.all(np.array(list(ends.values())) > 0)
            break
        assert out.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            assert sorted(after.items()) == [(i, t) for i, _, _, t in brute_force_lines(list(before.items()), 10)]
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "jaccard_join":
            links = brute_force_links(list(before.items()))
            assert after == {i: t for i, t in before.items() if links[i][0] == i}
        else:
            assert after == {i: t for i, t in before.items() if not brute_force_hits(t, bench)[1]}
        docs = out


def test_near_duplicates_of_ids_with_several_texts_and_repeated_rows(spark):
    other = " ".join(f"sonst{i}" for i in range(60))
    rows = [(0, BASE), (0, BASE), (1, other), (1, BASE), (2, BASE.upper()), (3, None), (3, None), (4, "kurz"), (None, BASE), (None, BASE)]
    docs = spark.createDataFrame([(i, t, "de", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(0, BASE), (1, other), (3, None), (4, "kurz"), (None, BASE), (None, BASE)], key=str)


def test_run_writes_and_rereads(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and {"doc_id", "ids", "sequence_id", "offset"} <= set(found.columns)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and letterless texts, repeated rows, further columns, no rows at all."""
    rows = [(0, BASE, "de"), (0, BASE, "de"), (1, None, None), (2, "", "de"), (3, "12 ...", None), (None, "nur Text", None), (4, "漢字", None), (5, "x\ny\n" * 40, "de")]
    docs = spark.createDataFrame([(i, t, x, None, None, "z") for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, kept_text string")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    lettered = [(i, t) for i, t, _ in rows if any(c.isalpha() for c in t or "")]
    assert texts(corpus_pipeline.identify_language(spark, docs, SF)) == sorted(lettered, key=str)
    # without any label nothing can be learned, and documents with letters stay as they are
    unlabelled = docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert texts(corpus_pipeline.identify_language(spark, unlabelled, SF)) == sorted(lettered, key=str)
    assert corpus_pipeline.identify_language(spark, unlabelled, SF).where("lang IS NOT NULL").count() == 0
    everything = sorted(((i, t) for i, t, _ in rows), key=str)
    assert texts(corpus_pipeline.drop_contaminated(spark, docs, SF)) == everything
    assert [(i, t or "") for i, t in texts(corpus_pipeline.drop_shared_lines(spark, docs, SF))] == [(i, t or "") for i, t in everything]
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert len(pieces) >= len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
