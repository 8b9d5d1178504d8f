"""Copies of benchmark items in other letter case, dense in slots, re-priced or short."""

import pytest

from tidemark.llm import decontamination

APPLES = "Yesterday Tom bought 5 kg of red apples and gave 5 kg to Anna at home again"
CAPITALS = "Name the capital of France, Germany, Spain, Italy, Portugal, Poland and Greece"
PRICES = "A ticket costs $5 and a meal costs $12 and a room costs $80 here"
ITEMS = [(1, APPLES), (2, CAPITALS), (3, "Buy milk now"), (4, PRICES), (5, "..."), (6, None)]
TEXTS = [
    APPLES.upper(), f"foo bar {CAPITALS} and more", CAPITALS.replace("France", "Peru").replace("Greece", "Chile"), CAPITALS.lower(), "please, buy MILK now!", PRICES.replace("5", "7").replace("12", "31"),
    "Name the capital of Peru", "buy now milk", None, "... -", APPLES.replace("5 kg", "7 lbs", 1).replace("apples", "pears"), APPLES.replace("5 kg", "7 lbs"),
]


@pytest.mark.parametrize("broadcast", [decontamination.BROADCAST_ROWS, 0])
def test_whole_copies_are_found(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), literal=True)
    assert {(r.doc_id, r.item_id): r.exact for r in got.collect()} == {(0, 1): True, (1, 2): True, (2, 2): False, (3, 2): True, (4, 3): True, (5, 4): False, (11, 1): False}


def test_query_and_pipeline_find_literal_copies(spark, tmp_path):
    import corpus_pipeline
    from tidemark.llm import queries

    docs = spark.createDataFrame([(0, APPLES.upper()), (1, "nothing of it")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, APPLES)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in queries.op7_benchmark_decontamination(spark, str(tmp_path)).collect()] == [0]
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [1]
