import random

import corpus_pipeline as cp


def test_stages_decide_and_keep_columns(spark):
    r = random.Random(2)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    base = text(100)
    near = " ".join([*base.split()[:-2], "x1", "x2"])
    secret = text(60) + ' token = "abcdef0123456789"'
    rows = [(1, base), (2, base.replace(" ", "  ")), (3, near), (4, secret), (5, "too short"), (6, None), (7, text(300))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, f in cp.STAGES[:4]:
        out = f(spark, docs, "")
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        docs = cp.stage(out, name)
        kept.append({x.doc_id: x.text for x in docs.collect()})
    assert set(kept[0]) == {1, 2, 3, 4, 7}
    assert set(kept[1]) == {2, 3, 4, 7}  # the longer original stays
    assert set(kept[2]) == {2, 4, 7}
    assert set(kept[3]) == {2, 4, 7} and "abcdef0123456789" not in kept[3][4] and kept[3][7] == rows[6][1]
    pieces = cp.packed(spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == {2, 4, 7}


ODD = "doc_id long, text string, lang string, source string, n_chars long, row_seq string, hits array<int>, judged string, row_tag long, __tag int, tag string"


def odd_rows():
    words = " ".join(f"w{i:05d}" for i in range(80))
    long = " ".join(f"v{i:06d}" for i in range(150_000))
    secret = words.replace("w00003 ", "q ") + ' token = "abcdef0123456789"'
    rows = [(1, words), (1, words), (2, words + " "), (None, words.replace("w", "n")), (3, None), (4, ""), (5, secret), (5, secret), (6, long), (None, None)]
    return [(i, t, "en", None if i == 5 else "s", len(t or ""), "r", [1], "j", 7, 8, "t") for i, t in rows]


def test_stages_with_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    spark.createDataFrame(odd_rows(), ODD).write.parquet(str(tmp_path / "d"))
    for docs in (spark.createDataFrame(odd_rows(), ODD).repartition(3), spark.read.parquet(str(tmp_path / "d"))):
        left = []
        for name, f in cp.STAGES[:4]:
            out = cp.stage(f(spark, docs, ""), name)
            assert out.columns == docs.columns
            rows = out.collect()
            assert all((r.row_seq, r.hits, r.judged, r.row_tag, r["__tag"], r.tag) == ("r", [1], "j", 7, 8, "t") for r in rows)
            left.append(sorted((r.doc_id or 0) for r in rows))
            docs = out
        assert left[0] == [0, 1, 1, 2, 5, 5, 6]  # texts without words go
        assert left[1] == [0, 2, 5, 6]  # the longest of the equal ones, then one of the repeated rows
        assert left[2] in ([0, 2, 5, 6], [0, 2, 6]) and left[3] == left[2]
        assert not any("abcdef0123456789" in r.text for r in docs.collect())
        assert cp.packed(spark, docs, "").count() >= len(left[3])


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for name, f in cp.STAGES[:4]:
        docs = cp.stage(f(spark, docs, ""), name)
        assert docs.columns == spark.createDataFrame([], ODD).columns and docs.count() == 0
    assert cp.packed(spark, docs, "").count() == 0
