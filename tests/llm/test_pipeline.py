"""The corpus pipeline on a small table with planted cases."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + ".\n"
    rows, labels = [], []
    for i in range(120):
        if i % 6 == 5:
            text = " ".join(w + "$$$ %%% ###" for w in prose(80).split())
        else:
            text = "".join(prose(30) for _ in range(5))
        rows.append([i, text, "en", "s", len(text)])
        labels.append((i, int(i % 6 != 5), 0))
    passage = prose(60)
    rows[2][1] += passage
    rows[7][1] += passage
    rows[8][1] += " password=abcdef123456 "
    rows.append([500, rows[0][1], "en", "s", 1])  # exact copy
    near = rows[1][1].split(" ")
    near[-1] = "changed"  # one shingle of about 150
    rows.append([501, " ".join(near), "en", "s", 1])
    rows.append([None, rows[3][1], "en", "s", 1])
    rows += [[502, None, None, None, None], [503, "", "", "", 0]]
    docs = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    docs.selectExpr("*", "1 as spans", "2 as score", "3 as id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i in range(120) if i % 6 != 5}
    assert {i for i in seen["quality_classifier"] if i is not None and i < 120} == good
    kept = set(seen["near_dedup"])
    assert good <= kept and not kept & {500, 501, None}
    cut = seen["substring_dedup"]
    assert passage in cut[2] and passage not in cut[7] and cut[8] == rows[8][1]
    safe = seen["secret_scan"]
    assert "password" not in safe[8] and "[SECRET]" in safe[8] and safe[2] == cut[2]
    packed = docs.groupBy("doc_id").sum("length").count()
    assert packed == len(safe)


def test_near_dedup_keeps_one_row_of_each_group(spark, tmp_path):
    rows = [(5, "some words here", "en", "s", 1), (5, "some words here", "en", "s", 1), (None, "some words here", None, None, None),
            (None, "alone", None, "s", 1), (None, "alone", None, "s", 1), (2, None, "x", None, 0), (1, "", "x", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [(1, ""), (5, "some words here"), (None, "alone")]
    for given in (docs, docs.selectExpr("*", "1 as fingerprint", "2 as component_id", "3 as file")):
        got = corpus_pipeline.near_dedup(spark, given, "")
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
        assert got.columns == corpus_pipeline.COLUMNS
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_stages_remove_what_the_stage_before_left(spark, tmp_path):
    from costlake.llm import common

    own = common.written(spark.range(5), "own")
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)], SCHEMA)
    corpus_pipeline.near_dedup(spark, docs, "").write.parquet(str(tmp_path / "near"))
    left = list(corpus_pipeline._LEFT)
    assert left and set(left) <= set(common.tables())
    found = corpus_pipeline.secret_scan(spark, spark.read.parquet(str(tmp_path / "near")), "")
    assert found.count() == 1 and own.count() == 5 and not set(left) & set(common.tables())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
