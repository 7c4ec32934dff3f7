"""The pipeline end to end, each stage held to what its operator decides alone."""

import corpus_pipeline
from corpusloom.llm import mixing, near_join, quality
from corpusloom.runtime import Scratch, read


def test_stages(spark, small):
    docs, scratch = read(spark, small, "documents"), Scratch(spark, "t")
    columns, labels = docs.columns, read(spark, small, "labels")
    good = scratch.save(corpus_pipeline.quality_rules(spark, docs, small), "a")
    assert good.columns == columns
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(r[0] for r in quality.assess(docs, labels).where("kept").select("doc_id").collect())
    one = scratch.save(corpus_pipeline.near_duplicates(spark, good, small), "b")
    assert one.columns == columns
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(r[0] for r in near_join.near_components(good, scratch).where("doc_id = component_id").select("doc_id").collect())
    clean = scratch.save(corpus_pipeline.personal_data(spark, one, small), "c")
    assert clean.columns == columns and clean.count() == one.count() and not clean.where("text rlike '[a-z]@[a-z0-9]+[.]example'").count()
    mixed = scratch.save(corpus_pipeline.mix(spark, clean, small), "d")
    assert mixed.columns == columns
    assert mixed.count() == sum(r["copies"] for r in mixing.assign(clean.select("doc_id", "text", "source"), scratch).select("copies").collect())
    packed = corpus_pipeline.pack(spark, mixed, small)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in mixed.select("doc_id").collect()}


def test_run_is_repeatable(spark, small):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) for _ in range(2))
    assert a and a == b


def test_stages_of_odd_rows(spark, small, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ties pass each stage with their columns."""
    good = read(spark, small, "documents").select("text").where("length(text) between 400 and 2000").orderBy("doc_id").limit(30)
    texts = [r[0] for r in good.collect()]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)] + [(40, texts[0], None, None, None), (41, " ".join(texts) * 40, "en", "s1", 1)]
    rows += [(0, texts[0], "en", "s0", len(texts[0]))] * 2 + [(50, None, "en", "s0", 0), (51, "", "en", "s0", 0), (None, texts[1], "en", "s1", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, small, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    at, scratch = read(spark, str(tmp_path), "documents"), Scratch(spark, "t")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = scratch.save(stage(spark, at, str(tmp_path)), f"{number}")
        assert made.schema.names == docs.columns, name
        if name == "near duplicates":
            ids = [r[0] for r in made.select("doc_id").collect()]
            assert ids.count(0) == 1 and 40 not in ids and ids.count(1) == 1 and None not in ids
        at = made
    packed = corpus_pipeline.pack(spark, at, str(tmp_path)).collect()
    assert packed and all(r["offset"] + r["length"] <= 2048 for r in packed)


def test_run_of_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels"):
        read(spark, small, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    read(spark, small, "documents").write.parquet(f"{tmp_path}/x/documents.parquet")
    read(spark, small, "labels").limit(0).write.parquet(f"{tmp_path}/x/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/x").count() > 0


def test_stages_give_back_heap(spark, small):
    """Before its own work each stage collects what earlier ones left; readers hold few rows at once."""
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    full = lambda: next(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = read(spark, small, "documents").limit(50)
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, small)
        assert full() > before, name
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= corpus_pipeline.READ_ROWS
