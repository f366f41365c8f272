"""Misspellings of words whose beginnings a fitted lexicon holds."""

import random

from prefscan.llm import toxicity
from prefscan.llm.labelled import held_out
from tests.llm.conftest import frame


def test_misspellings_on_a_fitted_lexicon(spark):
    rng = random.Random(4)
    calm = [" ".join(rng.choices("alpha beta gamma delta epsilon the of and".split(), k=30)) for _ in range(120)]
    vile = ["stupid", "pathetic", "disgusting", "worthless"]
    docs = [*enumerate(calm), *((200 + i, t + " " + " ".join(rng.sample(vile, 2))) for i, t in enumerate(calm))]
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in docs], "doc_id long, toxic int")
    lexicon = toxicity.fit(frame(spark, docs), labels, held_out("doc_id", 5, 1))
    assert {t for t, prefix in lexicon.terms if prefix} >= {"stup", "path", "disg", "wort"}
    matcher = lexicon.matcher()
    for word in ("stpid", "stuupid", "$tupid", "stqpid", "pthetic", "pqthetic", "dsgusting", "wqrthless"):
        assert matcher.token(word) is not None, word
    assert matcher.token("stupidly") is not None and matcher.token("gammas") is None
