import hashlib
import random
from collections import Counter

from meshrel.llm import fingerprints


def test_against_exact_likeness(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["é", "ß"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 400))) for _ in range(40)] + ["", None, " ", "same text", "same text"]
    docs = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket int").repartition(5)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs).collect()}
    assert len(got) == len(texts)
    errors = []
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = got[i * 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (following, r.near_next)):
            a, b = Counter(t.split()), Counter(other.split())
            total = sum((a | b).values())
            errors.append(abs(near - (sum((a & b).values()) / total if total else 1.0)))
    assert sum(errors) / len(errors) < 0.06 and max(errors) < 0.3
    assert got[43 * 3].fingerprint == got[44 * 3].fingerprint
    assert fingerprints.compare_with_next(docs.limit(0)).collect() == []
    one = fingerprints.compare_with_next(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
