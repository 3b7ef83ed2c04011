import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from meshrel.llm import suffixes


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "straße", "naïve", "a", "lorem", "ipsum", "\n", "x" * 9]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n // 3)]
    out = ["", None, "a" * 300, "ab" * 150, base[0], base[0]]
    for _ in range(n):
        parts = [rng.choice(base)[rng.randint(0, 40) :][: rng.randint(0, 200)] for _ in range(rng.randint(1, 4))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("crowd", [2_000, 2])
def test_against_brute_force(spark, crowd):
    texts = texts_of(crowd)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, t1 string, spans string")
    rows = suffixes.repeated_substrings(docs, 40, crowd).collect()
    got = {}
    for r in rows:
        raw = (r.text or "").encode()
        keep = np.ones(len(raw), bool)
        for s in r.spans:
            keep[s.lo : s.hi] = False
        got[r.doc_id] = (len(raw), int((~keep).sum()), len(r.spans), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[keep])).hexdigest())
    want = brute([(t or "").encode() for t in texts], 40)
    assert [got[i] for i in range(len(texts))] == want


def test_multikey_sort_orders_and_measures_common_prefixes():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    order, shared = suffixes.multikey_sort(strings, 30)
    for least in range(0, 25):
        groups = suffixes._ranks_at(order, shared, least)
        for i in range(0, 300, 7):
            for j in range(300):
                if i != j and len(strings[i]) >= least and len(strings[j]) >= least:
                    assert (groups[i] == groups[j]) == (strings[i][:least] == strings[j][:least])


def test_empty_table(spark):
    assert suffixes.repeated_substrings(spark.createDataFrame([], "doc_id long, text string"), 40).collect() == []
