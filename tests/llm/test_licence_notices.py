"""Licence notices that are wrapped over lines or stand inside longer sentences."""

import random

import duckdb
import pandas as pd

from prefscan.llm import licences, sql
from tests.llm.conftest import frame


def test_wrapped_and_embedded_notices_equal_sql(spark):
    rng = random.Random(5)
    filler = [f"word{i}" for i in range(60)]
    texts = ["Released under the\nMIT License.", "Released. Under the! MIT? License",
             "This project is released under the MIT License, see LICENSE for details"]
    for name, notice in licences.TEMPLATES.items():
        ws = notice.split()
        texts.append("\n".join(ws))
        texts.append("\n".join(" ".join(ws[i:i + 4]) for i in range(0, len(ws), 4)))
        for n in (3, 30, 300):
            texts.append(" ".join([*rng.choices(filler, k=n), notice.replace(".", ""), *rng.choices(filler, k=n)]))
        texts.append(" ".join(w for i, w in enumerate(ws) if i != 2))
    docs = list(enumerate(texts))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    want = con.execute(sql.licence_scan()).fetchall()
    rows = licences.scan(frame(spark, docs), licences.default_templates(spark)).collect()
    got = [(r.doc_id, r.licence, r.matched, r.shingles, round(r.containment, 6)) for r in rows]
    assert sorted(got) == sorted(want) and {(i, "MIT") for i in range(3)} <= {r[:2] for r in got}
