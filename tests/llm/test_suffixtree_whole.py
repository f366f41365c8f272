import pytest

from prefscan.llm import suffixtree
from tests.llm.conftest import frame
from tests.llm.test_suffixtree import check, held, made


@pytest.mark.parametrize("depth,p_min,head,bucket", [(3, 0.0, 2_000_000, 40), (3, 0.0, 5, 300), (2, 0.002, 0, 25), (1, 0.0, 9, 100)])
def test_buckets_of_a_few_positions_equal_brute_force(spark, depth, p_min, head, bucket):
    rows = made()
    found = suffixtree.score_split(
        frame(spark, rows).repartition(3), depth=depth, p_min=p_min, head_words=head, bucket=bucket)
    check(found.collect(), rows, depth, p_min)


def test_strings_that_occur_twice_count_at_any_size(spark):
    rows = [(i, "x " * 29_999) for i in range(140)]
    free = [i for i in range(200, 230) if not held(i)]
    twice = [(i, " ".join(f"v{k}" for k in range(60))) for i in free[:2]]
    once = (free[2], " ".join(f"u{k}" for k in range(60)))
    found = {r.doc_id: r for r in suffixtree.score_split(frame(spark, rows + twice + [once]).repartition(4)).collect()}
    assert found[once[0]].train_tokens > 3_000_000  # a millionth of them is more than two
    for i, _ in twice:  # only the first word is a surprise
        assert found[i].score > found[i].base_score / 4
    assert found[once[0]].score == pytest.approx(found[once[0]].base_score)
