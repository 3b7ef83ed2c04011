"""Operators that SQL cannot express, against plain Python or held-out rows; rows that are hard to tell apart."""

import math
import random

import numpy as np

from meshrel.llm import chunks, decontamination, jaccard, languages, quality, suffixes
from meshrel.llm.textkernel import span_hashes


def test_quality_against_plain_python_and_held_out_rows(spark):
    rng = random.Random(2)
    good, bad = [f"calm{i}" for i in range(60)], [f"CLICK{i}" for i in range(60)]
    rows = []
    for i in range(300):
        label = i % 2
        words = [rng.choice(good if rng.random() < (0.7 if label else 0.3) else bad) for _ in range(30)]
        rows.append((i, " ".join(words), label))
    train, test = rows[:200], rows[200:]
    model = quality.fit_quality(spark.createDataFrame(train, "doc_id long, text string, label int"))
    got = {r.doc_id: r for r in quality.score_quality(spark.createDataFrame(test, "doc_id long, text string, label int"), model).collect()}
    assert sum(got[i].predicted == y for i, _, y in test) >= 0.9 * len(test)
    for i, text, _ in test[:20]:
        data = np.frombuffer(text.encode(), np.uint8)
        found = quality.features(data, np.array([0, len(data)]), model["bits"])[0]
        norm = math.sqrt(sum(float(model["ratio"][f]) ** 2 for f in found))
        margin = sum(float(model["ratio"][f]) * float(model["weight"][f]) for f in found) / norm + model["bias"]
        assert abs(got[i].score - 1 / (1 + math.exp(-model["slope"] * margin))) < 1e-6
    # The log-count ratios are those of all labelled rows.
    count = np.ones((2, 1 << model["bits"]))
    for _, text, y in train:
        data = np.frombuffer(text.encode(), np.uint8)
        count[y, quality.features(data, np.array([0, len(data)]), model["bits"])[0]] += 1
    want = np.log((count[1] / (100 + 2)) / (count[0] / (100 + 2)))
    assert np.allclose(model["ratio"], want, atol=1e-5)


def test_overlaps_against_all_windows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    items, docs = [], []
    for i in range(60):
        item = [rng.choice(words) for _ in range(rng.randint(3, 30))]
        items.append((i, " ".join(item)))
        body = list(item)
        for j in rng.sample(range(len(body)), rng.randint(0, max(0, len(body) // 4))):
            body[j] = rng.choice(words)
        docs.append((i, " ".join([rng.choice(words) for _ in range(20)] + body + [rng.choice(words) for _ in range(20)])))
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)] + [(None, docs[0][1])]

    def hit(doc, item):
        """Whether some window of a diagonal has the share, and the least words or all of a shorter item's."""
        least = min(decontamination.LEAST_WORDS, len(item))
        for d in range(-len(item) + 1, len(doc)):
            lo, hi = max(0, d), min(len(doc), d + len(item))
            same = [doc[x] == item[x - d] for x in range(lo, hi)]
            if sum(same) < least:
                continue
            for a in range(len(same)):
                n = 0
                for b in range(a, len(same)):
                    n += same[b]
                    if n >= least and n >= decontamination.LEAST_SHARE * (b - a + 1):
                        return True
        return False

    want = {(d, i) for d, t in docs for i, s in items if hit(t.split(), s.split())}
    found = decontamination.contaminated_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 30


def test_languages_of_held_out_rows_and_page_evidence(spark):
    rng = random.Random(6)
    vocabulary = {"en": "the house and a garden with many old trees stands near water".split(), "de": "das haus und ein garten mit vielen alten bäumen steht am wasser".split(), "fr": "la maison et un jardin avec beaucoup de vieux arbres près de l'eau".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(25)), lang, f"s{i % 5}") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    train, test = rows[:90], rows[90:]
    schema = "doc_id long, text string, lang string, source string"
    model = languages.fit_languages(spark.createDataFrame(train, schema))
    got = {r.doc_id: r.lang for r in languages.identify(languages._documents(spark.createDataFrame(test, schema)), model, ["doc_id"]).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in test) >= 0.98 * len(test)
    assert languages.fit_languages(spark.createDataFrame(train, schema).limit(0))["languages"] == []
    # Of a language beyond the bound about that many rows are used; a rare one is used whole.
    rare = languages.fit_languages(spark.createDataFrame([*train, (999, "zzz qqq zzz", "xx", "s")], schema), most_rows=3)
    assert rare["languages"] == ["de", "en", "fr", "xx"]
    html = "<html lang='de'><head><script>the the the</script></head><body>12 <b>34</b></body></html>"
    pages = spark.createDataFrame([(1, "http://x.org/a", html), (2, "http://x.fr/a", "<p>1</p>"), (3, None, None), (4, "http://x.org/b", "<p>the house and a garden</p>")], "page_id long, url string, html string")
    judged = {r.page_id: (r.lang, r.letters) for r in languages.identify(languages.page_evidence(pages), model, ["page_id"]).collect()}
    assert judged[1] == ("de", 0) and judged[2] == ("fr", 0) and judged[3] == (None, 0) and judged[4][0] == "en"


def test_a_row_is_no_evidence_for_itself(spark):
    """The prior of a host comes from its other rows: a single row gets the prior of all others."""
    train = [(i, t, lang, "h") for i, (t, lang) in enumerate([("the house", "en"), ("das haus", "de")] * 20)]
    schema = "doc_id long, text string, lang string, source string"
    model = languages.fit_languages(spark.createDataFrame(train, schema))
    rows = spark.createDataFrame([(1, "the house", None, "alone"), (2, "the house", None, None)], schema)
    got = {r.doc_id: r.posterior for r in languages.identify(languages._documents(rows), model, ["doc_id"]).collect()}
    assert abs(got[1] - got[2]) < 1e-6


def test_structured_words_do_not_collide():
    a = bytes(b"ab"[bin(i).count("1") % 2] for i in range(2048))
    b = bytes(b"ba"[bin(i).count("1") % 2] for i in range(2048))
    data = np.frombuffer(a + b, np.uint8)
    x, y = span_hashes(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert x != y


def test_columns_that_clash_with_helpers(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randrange(1000)) for _ in range(80))
    schema = "doc_id long, text string, _text string, t1 long, _t1 long, spans string, row long, cut int, n_chars int"
    rows = [(None, f"x {text} y", "keep", 1, 2, "s", 3, 4, 7), (2, f"z {text} w", "keep", 1, 2, "s", 3, 4, 8), (3, "short", "keep", 1, 2, "s", 3, 4, 5), (4, None, "keep", 1, 2, "s", 3, 4, None)]
    docs = spark.createDataFrame(rows, schema)
    got = suffixes.cut_repeats(docs, 200).collect()
    assert len(got) == 4 and all(r["_text"] == "keep" and r["t1"] == 1 and r["_t1"] == 2 and r["spans"] == "s" and r["row"] == 3 and r["cut"] == 4 for r in got)
    by = {r.doc_id: r for r in got}
    assert text not in by[None].text and by[None].text.startswith("x") and by[None].n_chars == len(by[None].text)
    assert by[3].text == "short" and by[4].text is None
    kept = jaccard.keep_one(docs.withColumn("sig", docs.text).withColumn("label", docs.row), 5, 80).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 4]


def test_empty_tables_and_whole_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (2, "a b c"), (None, None)], "doc_id long, text string")
    assert jaccard.jaccard_links(docs.limit(0)).collect() == [] and chunks.repeated_chunks(docs.limit(0)).collect() == []
    assert suffixes.repeated_substrings(docs.limit(0)).collect() == []
    # A whole text that repeats an earlier one goes, however short; repeated rows are one place.
    got = sorted(((r.doc_id or 0), [(s.lo, s.hi) for s in r.spans]) for r in chunks.repeated_chunks(docs).collect())
    assert got == [(0, []), (1, []), (2, [(0, 5)]), (2, [(0, 5)])]
