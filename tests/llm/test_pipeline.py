import pytest

from .conftest import edge_rows


def test_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(*r[:4], len(r[1] or "")) for r in edge_rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = stages["quality_rules"](spark, held, str(tmp_path))
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert ids == [-5, 0, 0, 1, 2, 2, 3, 7, 8, 9]
    one = stages["simhash_near_dedup"](spark, held, str(tmp_path)).collect()
    assert [r.doc_id for r in one if r.text and r.text.lower() == edge_rows()[0][1].lower()] == [1]
    cut = {r.doc_id: r for r in stages["suffix_array_dedup"](spark, held, str(tmp_path)).collect() if r.doc_id is not None}
    assert 2 not in cut and cut[9].n_chars == len(cut[9].text) < len(edge_rows()[11][1]) and cut[1].text == edge_rows()[0][1]
    clean = {r.doc_id: r for r in stages["secret_scans"](spark, held, str(tmp_path)).collect()}
    assert "hunter22" not in clean[13].text and clean[7].text == edge_rows()[7][1] and len(clean) == len({r[0] for r in rows})
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces if p.doc_id is not None} <= {-5, 1, 7, 8, 9}
    assert sum(p.length for p in pieces if p.doc_id == 7) == next(p.doc_tokens for p in pieces if p.doc_id == 7)


def test_repeats_are_cut_at_whole_characters(spark):
    """Against brute force; marks that the text held before stay, and columns of any name."""
    import corpus_pipeline

    from .test_pairs import brute_gone

    passage = "é genuine \ufffd mark " * 6
    texts = ["ü" + passage + "ab", "x" + passage + "日本 and more", "é" * 60, "à" + "é" * 60 + "ê", "plain", None, ""]
    rows = [(i, t, "en", "s", len(t or ""), "own", i, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, removed int, n_bytes int")
    got = {r.doc_id: r for r in corpus_pipeline.suffix_array_dedup(spark, df, "").collect()}
    for i, (t, gone) in enumerate(zip(texts, brute_gone([r[:2] for r in rows]))):
        at, left = 0, ""
        for c in t or "":
            size = len(c.encode())
            left += "" if any(gone[at : at + size]) else c
            at += size
        if any(gone) and not left.strip():
            assert i not in got
            continue
        assert got[i].text == (None if t is None else left) and got[i].n_chars == len(left)
        assert (got[i].kept, got[i].removed, got[i].n_bytes) == ("own", i, 7)
    assert "\ufffd" in got[0].text and got[1].text == "x日本 and more"


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables(spark, stage):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.STAGES[stage][1](spark, none, "").collect() == []
