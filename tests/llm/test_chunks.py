import random
import time
from pathlib import Path

import numpy as np

from meshrel.llm import chunks


def test_gear_hash_is_the_recurrence():
    data = np.frombuffer(bytes(random.Random(1).randbytes(500)), np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(chunks.GEAR[b])) % 2**64
        want.append(h)
    assert chunks.gear_hashes(data).tolist() == want


def test_chunks_cover_and_resist_insertions():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefghij \n") for _ in range(5000))
    ends = chunks.chunk_ends(np.frombuffer(text, np.uint8))
    sizes = np.diff(np.concatenate(([0], ends)))
    assert ends[-1] == len(text) and sizes[:-1].min() >= 16 and sizes.max() <= 256
    moved = chunks.chunk_ends(np.frombuffer(b"inserted" + text, np.uint8))
    old = {text[a:b] for a, b in zip(np.concatenate(([0], ends)), ends)}
    new = {(b"inserted" + text)[a:b] for a, b in zip(np.concatenate(([0], moved)), moved)}
    assert len(old & new) > 0.9 * len(old)


def test_later_copies_of_a_passage_go(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = make(600)
    rows = [(1, make(300) + passage + make(300)), (2, make(500) + passage), (3, make(900)), (4, None), (5, ""), (6, passage + make(50) + passage)]
    docs = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, row string")
    got = {r.doc_id: r for r in chunks.repeated_chunks(docs).collect()}
    gone = {i: sum(s.hi - s.lo for s in r.spans) for i, r in got.items()}
    assert gone[1] == gone[3] == gone[4] == gone[5] == 0
    assert 400 <= gone[2] <= 600 and 800 <= gone[6] <= 1250
    for i, start in ((2, 500),):
        assert all(s.lo >= start for s in got[i].spans)


def _short_passages(number):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for i in range(number):
        passage = prose(51 + i % 10)
        for j in (0, number):
            head = f"{prose(40)} {j} "
            rows.append((i + j, f"{head}{passage} {j} {prose(40)}"))
        want[number + i] = len(head), len(head) + len(passage)
    return rows, want


def test_short_passages_go_whole_in_any_surroundings(spark):
    rows, want = _short_passages(200)
    got = {r.doc_id: r.spans for r in chunks.repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[i] for i in range(200))
    assert all(len(got[i]) == 1 and got[i][0].lo <= lo and got[i][0].hi >= hi and got[i][0].hi - got[i][0].lo <= hi - lo + 2 for i, (lo, hi) in want.items())


def test_growth_goes_on_beyond_one_round(spark):
    rows, want = _short_passages(30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    far = {r.doc_id: r.spans for r in chunks.repeated_chunks(docs, reach=2).collect()}
    assert far == {r.doc_id: r.spans for r in chunks.repeated_chunks(docs).collect()} and all(far[i] for i in want)


def test_shuffle_files_go_once_their_step_is_settled(spark):
    folders = [Path(p) for p in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p: p.stat().st_size for f in folders for p in f.rglob("shuffle_*.data") if p.exists()}
    docs = spark.createDataFrame(_short_passages(100)[0], "doc_id long, text string")
    before = files()
    rows = chunks.repeated_chunks(docs)
    for _ in range(50):
        left = sum(size for p, size in files().items() if p not in before)
        if left < 5_000:  # counts of one row a task stay
            break
        time.sleep(0.2)
    assert left < 5_000 and sum(len(r.spans) for r in rows.collect()) == 100
