"""Bands over windows: the stated collision probability, and the window rule itself."""

import random

from prefscan.llm import licences
from tests.llm.conftest import frame


def test_stated_probability_covers_every_template():
    sizes = [len(t.split()) for t in licences.TEMPLATES.values()]
    assert all(licences.collision_probability(max(1, n)) >= 0.9995 for n in [*sizes, 1, 2, 3, 10, 100, 300])


def test_windows_cover_every_place_and_fail_as_seldom_as_stated():
    rng = random.Random(1)
    for n in (1, 3, 20, 100):
        lost = trials = 0
        for _ in range(400):
            at, own = rng.randrange(0, 500), [rng.getrandbits(60) for _ in range(n)]
            text = [rng.getrandbits(60) for _ in range(at)] + own + [rng.getrandbits(60) for _ in range(300)]
            k = max(0, at // n - (licences.SPAN - 2))
            window = text[k * n:(k + licences.SPAN) * n]
            assert own == [x for x in window if x in set(own)]  # a window holds the template whole
            for h in own:
                trials += 1
                lost += min(x for x in window if x % licences.BANDS == h % licences.BANDS) != h
        assert lost / trials <= licences.SPAN * n / (2 * licences.BANDS) * 1.5 + 3 / trials ** 0.5 / 10


def test_scattered_and_repeated_templates_in_long_texts(spark):
    rng = random.Random(6)
    filler = [f"f{i}" for i in range(500)]
    docs = []
    for i, (name, notice) in enumerate(licences.TEMPLATES.items()):
        ws = notice.split()
        half = len(ws) // 2 + 4  # two overlapping halves, far apart
        docs.append((i, " ".join([*ws[:half], *rng.choices(filler, k=5000), *ws[max(0, half - 8):], "end"])))
        docs.append((100 + i, " ".join([*rng.choices(filler, k=2000), *ws, "and"] * 3)))
    rows = licences.scan(frame(spark, docs), licences.default_templates(spark)).collect()
    found = {(r.doc_id % 100, r.licence) for r in rows if r.doc_id >= 100}
    assert found >= {(i, name) for i, name in enumerate(licences.TEMPLATES)}
    assert {(r.doc_id, r.licence) for r in rows if r.doc_id < 100} >= {
        (i, name) for i, name in enumerate(licences.TEMPLATES) if len(licences.TEMPLATES[name].split()) > 20}
