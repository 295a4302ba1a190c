import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_columns_and_decide(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert docs.count() <= kept
        kept = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).cache()
    assert mixed.count() == kept
    assert mixed.exceptAll(mixed).count() == 0 and mixed.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    assert docs.select("doc_id").distinct().count() == kept


def test_stages_with_nulls_and_repeats(spark, tmp_path):
    """Null and repeated ids are judged by their texts; rows that are repeated stay once, empty ones as they are."""
    import numpy as np
    from gleaner.llm import stages

    rng = np.random.default_rng(3)
    words = "the and house with that river under green stone small table window".split()
    say = lambda n: " ".join(str(w) for w in rng.choice(words, n))
    item = " ".join(f"{w}{i}" for i, w in enumerate(rng.choice(words, 30)))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, host string, row long"
    a, b, c = say(60), say(60), say(60)
    leak = f"{say(30)} {item} {say(30)}"
    row = lambda i, t, source="s": (i, t, "en", source, len(t) if t else None, 1, "h", 2)
    rows = [
        row(1, a), row(2, a), row(3, b), row(3, b), row(3, c), row(None, a), row(None, say(70)), row(None, leak), row(8, leak), row(9, ""),
        row(9, ""), row(10, None, None), row(11, "7" * 500_000),
    ]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    kept = stages.one_of_each(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted(
        [(1, a), (3, b), (3, c), (None, rows[6][1]), (8, leak), (9, ""), (9, ""), (10, None), (11, "7" * 500_000)], key=repr,
    )
    clean = stages.decontaminated(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] or -1 for r in clean.collect()) == [-1, -1, 1, 2, 3, 3, 3, 9, 9, 10, 11]
    known = stages.known_language(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] or -1 for r in known.collect()) == [-1, -1, -1, 1, 2, 3, 3, 3, 8]
    counted = stages.mixed(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"], r["size"]) for r in counted.collect()), key=repr) == sorted(
        ((r["doc_id"], r["text"], len((r["text"] or "").split())) for r in docs.collect()), key=repr,
    )
    assert counted.columns[:6] == ["doc_id", "source", "size", "source_size", "target", "taken"] and set(counted.columns) == {
        *docs.columns, "size", "source_size", "target", "taken",
    }
    assert stages.mixed(spark, docs.where("false"), str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        stages.numbered(docs.withColumn("__row", docs["row"]))
    for stage in (stages.known_language, stages.one_of_each, stages.decontaminated, stages.private_masked):
        none = stage(spark, docs.where("false"), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_leaves_its_result_only(spark):
    import corpus_pipeline
    from gleaner.llm._store import shared_dir

    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    done = corpus_pipeline.run(spark, SF)
    left = {f for f in set(os.listdir(at)) - before if "-" in f and not f.count("-") == 4}
    assert len([f for f in left if f.startswith("stage-")]) == 1 and {f.split("-")[0] for f in left} == {"stage"}, left
    assert done.count() > 0 and done.columns[:6] == [
        "doc_id", "source", "size", "source_size", "target", "taken",
    ] and "text" in done.columns
