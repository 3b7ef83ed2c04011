import random

import numpy as np
import pyarrow as pa

from meshrel.llm import decontamination as D


def _judge(items, docs):
    tests = D.Tests(list(range(len(items))), items, D.MASKS)
    return {(lo + r, t, same) for lo, _, w, off in D._words(pa.array(docs, pa.large_string())) for r, t, _, _, same in tests.spans(w, off, D.LEAST_WORDS, D.LEAST_SHARE)}


def test_every_overlap_of_the_rule_is_found():
    rng = random.Random(4)
    items, docs, want = [], [], set()
    for k, (size, changed) in enumerate([(15, 2), (15, 3), (20, 4), (25, 5), (12, 0), (40, 8)] * 150):
        words = [f"i{k}w{j}" for j in range(size)]
        items.append(" ".join(words))
        for j in rng.sample(range(size), changed):
            words[j] = f"x{j}"
        docs.append(" ".join(["a b c", *words, "d e f"]))
        want.add((k, k, size - changed))
    assert _judge(items, docs) == want


def test_the_one_overlap_without_four_equal_words_in_a_row_and_short_items():
    item = [f"w{j}" for j in range(15)]
    changed = ["x" if j % 4 == 3 else w for j, w in enumerate(item)]
    items = [" ".join(item), "alpha beta gamma", "one two three four five six"]
    docs = [" ".join(changed), "say alpha Beta gamma now", "alpha beta", "zero one two three four five six", "one two three four five"]
    assert _judge(items, docs) == {(0, 0, 12), (1, 1, 3), (3, 2, 6)}


def test_windows_against_all_windows():
    rng = np.random.default_rng(3)
    for _ in range(300):
        equal = rng.random(rng.integers(1, 60)) < rng.choice([0.6, 0.8, 0.9])
        best = max((int(equal[i:j].sum()) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if 5 * equal[i:j].sum() >= 4 * (j - i)), default=0)
        got = D._windows(equal, 12, 0.8)
        assert (got[0][2] if got else 0) == (best if best >= 12 else 0)
        assert all(same == equal[lo:hi].sum() and 5 * same >= 4 * (hi - lo) for lo, hi, same in got)
