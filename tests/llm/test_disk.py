"""What operators leave on disk."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.llm import metric_join, store


def tables(spark):
    at = f"{store.shared_dir(spark).removeprefix('file://')}/tidemark"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def shuffled(spark):
    """Bytes of shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def kinds(names):
    return sorted(n.rsplit("-", 1)[0] for n in names)


def test_f1_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = spark.range(200_000).repartition(4, F.col("id") % 1000)
    kept = [store.materialize(rows, "rows")]
    assert kept[0].count() == 200_000 and rows is not None
    assert shuffled(spark) <= before + 100_000  # the table's own is some MB
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_f1_scopes_remove_all_but_what_is_kept(spark):
    before = tables(spark)
    with store.scope() as outer:
        with store.scope() as inner:
            store.materialize(spark.range(3), "one")
            two = inner(store.materialize(spark.range(4), "two"))
        assert kinds(tables(spark) - before) == ["two"] and two.count() == 4
        three = outer(store.materialize(spark.range(5), "three"))
    assert kinds(tables(spark) - before) == ["three"] and three.count() == 5
    with pytest.raises(ValueError), store.scope():
        store.materialize(spark.range(3), "lost")
        raise ValueError
    assert kinds(tables(spark) - before) == ["three"]
    assert store.materialize(spark.range(3), "free").count() == 3


def test_f1_near_duplicates_leave_what_their_result_reads(spark, docs):
    before = tables(spark)
    found = metric_join.join(docs, size=5, percent=80)
    assert kinds(tables(spark) - before) == ["known-as", "sets"]
    assert found.count() == docs.count()


def test_f1_the_pipeline_leaves_its_result(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "nothing here that any of the documents holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = tables(spark)
    found = pipeline.run(spark, str(tmp_path))
    assert kinds(tables(spark) - before) == ["stage-4", "tokens"]
    assert found.count() > 0
