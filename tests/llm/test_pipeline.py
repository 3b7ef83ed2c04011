"""Each stage of the corpus pipeline against a plain computation over its own input, and the run as a whole."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"en": "the and ing tion er ous ly ment ash wick stone brook".split(), "de": "der ung keit sch ein heit lich zen burg feld mann straß".split()}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, _prose(rng, "en", 40)) for i in range(3)]
    passage = _prose(rng, "de", 70)
    texts = [(rng.choice(["en", "de"]), None) for _ in range(60)]
    rows = []
    for i, (lang, _) in enumerate(texts):
        rows.append([i, _prose(rng, lang, rng.randint(30, 200)), lang, rng.choice("abc")])
    rows[10][1:3] = rows[4][1:3]
    near = rows[5][1].split()
    near[7] = "changed"
    rows[11][1:3] = " ".join(near), rows[5][2]
    for i in (20, 21, 22):
        rows[i][1:3] = f"{_prose(rng, 'de', 40)} {passage} {_prose(rng, 'de', 40)}", "de"
    rows[30][1:3] = f"{_prose(rng, 'en', 50)} {items[1][1]} {_prose(rng, 'en', 50)}", "en"
    rows += [[60, None, "en", "a"], [61, "", "de", None], [62, "1234 5678 !!!", "en", "b"]]
    folder = tmp_path_factory.mktemp("tables")
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


def _shingles(text, k=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _cut(texts, length):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen: dict[bytes, int] = {}
    for t in raw.values():
        for a in range(len(t) - length + 1):
            seen[t[a : a + length]] = seen.get(t[a : a + length], 0) + 1
    out = {}
    for i, t in raw.items():
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        # A character stays whole if any of its bytes does.
        kept, at = [], 0
        for c in t.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = _rows(docs)

    def stage(k, docs):
        return pipeline.STAGES[k][1](spark, docs, tables)

    named = stage(0, docs)
    got = _rows(named)
    assert named.columns == COLUMNS
    assert set(before) - set(got) == {60, 61, 62} and all(got[i] == before[i] for i in got)

    apart = stage(1, named)
    kept, sets = _rows(apart), {i: _shingles(r.text) for i, r in got.items()}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert apart.columns == COLUMNS and set(kept) == {i for i, x in label.items() if i == x} and not {10, 11} & set(kept)

    cut = stage(2, apart)
    left = _rows(cut)
    want = {i: t for i, t in _cut({i: r.text for i, r in kept.items()}, pipeline.REPEAT_BYTES).items() if WORD.search(t)}
    assert cut.columns == COLUMNS and {i: r.text for i, r in left.items()} == want
    assert all(r.n_chars == len(r.text) for r in left.values()) and len(left[20].text) < len(kept[20].text)

    clean = stage(3, cut)
    assert clean.columns == COLUMNS and set(left) - set(_rows(clean)) == {30}

    mixed = _rows(stage(4, clean))
    size = {i: len(WORD.findall(r.text)) for i, r in _rows(clean).items()}
    sources = {i: r.source for i, r in _rows(clean).items()}
    for r in mixed.values():
        assert r.copies > 0 and r.size == size[r.doc_id] and r.taken == r.size * r.copies
        own = [i for i in size if sources[i] == r.source]
        assert r.source_size == sum(size[i] for i in own)
        taken = sum(mixed[i].taken for i in own if i in mixed)
        assert abs(taken - r.target) <= max(size[i] for i in own)


def test_run_is_the_stages_in_turn(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, tables)
    assert sorted(pipeline.run(spark, tables).collect()) == sorted(docs.collect())
