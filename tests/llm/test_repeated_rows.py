"""Repeated rows and copies without doc_id through the near-duplicate and substring stages."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_one_row_of_each_group_survives_both_dedup_stages(spark):
    rng = random.Random(2)
    repeated, copied, lonely, near, short, other = (_prose(rng, n) for n in (80, 80, 80, 80, 8, 80))
    changed = near.replace(near.split()[40], "changed", 1)
    rows = [(1, repeated)] * 3 + [(2, copied), (None, copied)] + [(None, lonely)] * 3 + [(3, near), (None, changed)] + [(4, short)] * 2 + [(5, other)]
    rows += [(6, None), (6, None), (None, " ")]
    want = {(1, repeated), (None, copied), (None, lonely), (None, changed), (4, short), (5, other), (6, None), (None, " ")}
    docs = _docs(spark, rows)
    for k in (1, 2):
        docs = pipeline.STAGES[k][1](spark, docs, "")
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert set(got) == want and len(got) == len(want) + 1
