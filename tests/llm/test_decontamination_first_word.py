"""Short benchmark items that stand inside a text, after a word or a number."""

from prefscan.llm import templates
from tests.llm.conftest import frame

ITEMS = [(1, "What is the capital of France?"), (2, "A train leaves at noon today."), (3, "Name the largest moon there is.")]


def test_short_items_inside_texts(spark):
    docs = [(1, "so he asked What is the capital of France? and went"), (2, "1) What is the capital of France?"),
            (3, 'he said "What is the capital of France?"'), (4, "What is the capital of France?"),
            (5, "Question 7 A train leaves at noon today."), (6, "x A train leaves at noon today. y"),
            (7, "then Name the largest moon there is."), (8, "what is the capital of France"),
            (9, "so he asked When is the capital of France? and went"), (10, "so he asked What is the capital of it")]
    found = templates.leaks(frame(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [
        (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3), (8, 1)]
