import random
import re

import pytest

from meshrel.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, k, per):
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per * len(sets[a] | sets[b]):
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
                x, y = label[a], label[b]
                label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i], len(links[i])) for i in sets}


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "naïve", "A"]
    rows = [(0, None), (1, ""), (2, " \t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x " * 50), (7, "x " * 90)]
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(copy)))
    return rows


@pytest.mark.parametrize("k, per, block", [(4, 85, 384), (5, 80, 3)])
def test_against_brute_force(spark, monkeypatch, k, per, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = rows_of(block)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, cluster string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_links(docs, k, per).collect()}
    assert got == brute(rows, k, per)


def test_overlaps_sum_over_fragments():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert jaccard.overlaps(sets[:4], sets[4:], cells=40).tolist() == want


def test_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.jaccard_links(docs).collect())
    assert got == [("1", 1), ("1", 1), ("None", None)]
    assert jaccard.keep_one(docs).where("doc_id is null").count() == 1
