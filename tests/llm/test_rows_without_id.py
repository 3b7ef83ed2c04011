"""Rows without doc_id, and rows that share one, are judged by themselves."""

from meshrel.llm import decontamination, languages


def test_rows_without_id_are_judged(spark):
    item = " ".join(f"t{i}" for i in range(30))
    rows = [(i, f"the cat number {i} sat on the mat", "en", "a") for i in range(9)] + [(20 + i, f"der hund {i} und die katze", "de", "a") for i in range(9)]
    rows += [(None, f"the cat {item}", "en", "a"), (None, "the cat sat on the mat", "en", "a"), (None, "1234 5678", "en", "a"), (None, None, "en", "a")]
    rows += [(50, f"the cat {item}", "en", "a"), (50, "the cat sat there", "en", "a"), (50, "12 34", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    named = sorted((str(r.doc_id), r.text) for r in languages.keep_identified(docs).collect())
    assert named == sorted((str(i), t) for i, t, _, _ in rows if t not in (None, "1234 5678", "12 34"))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = sorted((str(r.doc_id), str(r.text)) for r in decontamination.decontaminate(docs, items).collect())
    assert clean == sorted((str(i), str(t)) for i, t, _, _ in rows if item not in (t or ""))
