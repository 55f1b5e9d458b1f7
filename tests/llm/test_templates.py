"""Passages with altered values, and short items."""

from conftest import sentence

from tallyflow.llm import templates


def found(spark, docs, items):
    docs = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    items = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    return {(r.id, r.item_id): (r.n_windows, r.exact) for r in templates.matches(docs, items).collect()}


def test_verbatim_windows_count_beside_an_altered_value(spark):
    item = f"Early on Monday Tom walks to the mill, and {sentence(4, 30)} until Tom comes home with 12 sacks of flour"
    altered = item.replace("until Tom", "until Bob")
    got = found(spark, {1: item, 2: altered}, {7: item})
    windows = len(item.split()) - 9
    assert got == {(1, 7): (windows, True), (2, 7): (windows - 8, True)}  # 8 windows hold the altered name


def test_short_items_and_items_within_lines(spark):
    items = {1: "What is the capital of France?", 2: "Eiffel Tower", 3: "法国的首都是什么城市呢？", 4: "フランスの首都はどこですか"}
    docs = {
        1: "- What is the capital of France?", 2: "Q12 What is the capital of France? Paris", 3: "Quiz\nWhat is the capital of France?",
        4: "he saw the Eiffel Tower at night", 5: "he saw the Eiffel bridge and a Tower", 6: "请回答：法国的首都是什么城市呢？谢谢",
        7: "問題：フランスの首都はどこですか。東京", 8: "法国的首都很大", 9: "he asked\nWhat is the largest town of France?",
    }
    want = {(1, 1), (2, 1), (3, 1), (4, 2), (6, 3), (7, 4)}
    assert found(spark, docs, items).keys() == want
    assert [r.doc_id for r in templates.decontaminated(
        spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"),
        spark.createDataFrame(list(items.items()), "item_id bigint, text string")).sort("doc_id").collect()] == [5, 8, 9]
