"""The licence scan against the same rules in plain Python, wrapped notices, and rows that are hard to tell apart."""

import math
import random
import textwrap

import pytest

from meshrel.llm import licenses as L


@pytest.fixture(scope="module")
def model():
    return L.fit(["ti wh en the of and onal", "an attion of the and in"] * 40)


def judge(words, model):
    found = L.features_of(words)
    rows = [w for f, w in zip(model["features"], model["weight"]) if f in found]
    if not rows:
        return None
    logits = [sum(r[i] for r in rows) + b for i, b in enumerate(model["bias"])]
    top = max(logits)
    family = model["classes"][logits.index(top)]
    p = 1 / sum(math.exp(x - top) for x in logits)
    if family == L.UNKNOWN or p < L.LEAST_PROBABILITY:
        return None
    share = L.template_share(words, family)
    return (share, p, family) if share >= L.LEAST_TEMPLATE else None


def brute(text, model):
    telling, lines, hits = set(L.telling_words(model)), (text or "").split("\n"), []
    for i, line in enumerate(lines):
        if not telling & set(L.words_of(line)):
            continue
        found = [(round(j[0], 6), round(j[1], 6), -n, j[2]) for n in {min(n, len(lines) - i) for n in L.SPANS} if (j := judge(L.words_of(" ".join(lines[i : i + n])), model))]
        if found:
            share, p, n, family = max(found)
            hits.append((family, i, i - n - 1, p, share))
    out = []
    for family, first, last, p, share in sorted(hits):
        if out and out[-1][0] == family and first <= out[-1][2]:
            f, a, b, q, s = out[-1]
            out[-1] = (f, a, max(b, last), max(p, q), max(s, share))
        else:
            out.append((family, first, last, p, share))
    return out


def texts():
    rng = random.Random(3)
    out = [None, "", " \n\n ", "She has a license to teach.\nRights and duties."]
    for family, notices in L.TEMPLATES.items():
        for notice in notices:
            out.append("some prose ti wh\n" + "\n".join(textwrap.wrap(notice, rng.randint(60, 80))) + "\nmore prose onal")
    out.append("\n".join(["enndst onble"] * 3000 + ["Licensed under CC BY 4.0."] + ["ti wh"] * 3000 + ["All rights reserved"]))
    return out


def test_against_brute_force(spark, model):
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(None, "Released under the MIT License", 1), (7, "x", 1), (7, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    found = L.scan(docs, model).collect()
    got = sorted((str(r.doc_id), r.family, r.first_line, r.last_line, round(r.probability, 4), round(r.template_share, 4)) for r in found)
    want = sorted((str(i), f, a, b, round(p, 4), round(s, 4)) for i, t, _ in rows for f, a, b, p, s in brute(t, model))
    assert got == want
    assert L.scan(docs.limit(0), model).collect() == []


def test_wrapped_notices_get_their_family(spark, model):
    assert model["held_out"] > 0.9
    wrapped = [(f"{f} {j}", f, "\n".join(textwrap.wrap(t, 70))) for f, ts in L.TEMPLATES.items() for j, t in enumerate(ts)]
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(wrapped)], "doc_id long, text string")
    got = {}
    for r in L.scan(docs, model).collect():
        got.setdefault(r.doc_id, set()).add(r.family)
    wrong = [n for i, (n, f, _) in enumerate(wrapped) if f not in got.get(i, ())]
    assert not wrong
