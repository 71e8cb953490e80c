"""Passages that repeat across documents, against brute force over every pair of documents."""

import random

import pytest

from proofline.llm import paragraph_dedup, passages, queries
from proofline.llm.paragraph_dedup import duplicates

SF = "/root/testdata/sf0.001"


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()


def shared(rows, length):
    """doc_id -> word positions covered by runs of `length` words that stand in another document too."""
    where = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            where.setdefault(tuple(w[k : k + length]), set()).add((i, k))
    out = {}
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                out.setdefault(i, set()).update(range(k, k + length))
    return out


def alike(a, b):
    s, t = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(s & t) >= 0.8 * len(s | t)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def run(spark, rows, **kw):
    return passages.passages(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()


def covered(found):
    out = {}
    for r in found:
        out.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    return out


def check(rows, found):
    got = covered(found)
    least = passages.BLOCK + passages.REACH - 1
    for i, want in shared(rows, least).items():
        # Every window of so many shared words holds a block, so what is left bare is shorter than a block's reach.
        bare = sorted(want - got.get(i, set()))
        assert i in got
        longest = run_ = 0
        for a, b in zip(bare, bare[1:] + [None]):
            run_ += 1
            longest, run_ = max(longest, run_), run_ if b == a + 1 else 0
        assert longest < least
    exact = shared(rows, passages.BLOCK)
    return got, exact


def test_every_shared_run_of_real_documents_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows_of(docs)
    found = passages.passages(docs).collect()
    got, exact = check(rows, found)
    text = {i: words(t) for i, t in rows}
    # What is found beyond equal runs is near: some block of it is like a run of another document.
    for i, places in got.items():
        rest = places - exact.get(i, set())
        if rest:
            lo = min(rest)
            ok = any(alike(text[i][a : a + 24], w[k : k + 24]) for a in range(max(0, lo - 23), lo + 1) for j, w in text.items() if j != i for k in range(len(w) - 23))
            assert ok
    assert {r.doc_id for r in found if r.removed} and all(r.keep_doc_id < r.doc_id for r in found if r.removed)


def test_planted_passages_in_lines_of_any_shape(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(2000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    planted = [text(n) for n in (51, 60, 80)]
    rows, carriers = [], set()
    for i in range(60):
        w = text(rng.randrange(30, 300))
        if i % 3 == 0:
            p = planted[i // 3 % 3]
            k = rng.randrange(len(w))
            w = w[:k] + [x.upper() if i % 2 else x for x in p] + w[k:]
            carriers.add(i)
        rows.append((i, "".join(x + rng.choice(" \n\t  ") for x in w)))
    found = run(spark, rows)
    check(rows, found)
    assert {r.doc_id for r in found} == carriers
    assert sum(not r.removed for r in found) == 3  # the first carrier of each keeps it
    assert {r.keep_doc_id for r in found} == {0, 3, 6}


def test_a_passage_with_a_changed_word_is_near(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    hit = 0
    for k in range(20):
        p = text(120)
        q = list(p)
        q[60] = "other"
        rows = [(2 * k, " ".join(text(40) + p + text(40))), (2 * k + 1, " ".join(text(30) + q + text(50)))]
        hit += len({r.doc_id for r in run(spark, rows)}) == 2
        if k == 4:
            break
    assert hit == 5


@pytest.mark.parametrize("size", [400, 2_000_000])
def test_pieces_of_long_texts(spark, monkeypatch, size):
    rng = random.Random(1)
    text = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    p = text(50)
    texts = [text(300) + " " + p + " " + text(20), text(10), text(37) + " " + p + " " + text(400), text(500)]
    whole = {(int(r), int(s), int(i)) for row, start, ids, *_ in passages.winnowed(texts) for r, s, i in zip(row, start, ids)}
    plain = passages.blocks
    monkeypatch.setattr(passages, "blocks", lambda t: plain(t, size))
    pieces = {(int(r), int(s), int(i)) for row, start, ids, *_ in passages.winnowed(texts) for r, s, i in zip(row, start, ids)}
    assert whole <= pieces or size == 400 and {x for x in whole if x not in pieces} == set()
    ids = [{i for r, _, i in pieces if r == k} for k in (0, 2)]
    assert ids[0] & ids[1]


def test_edges(spark):
    same = " ".join(f"t{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, same), (4, same), (4, same), (5, "word " * 400), (6, "word " * 300), (7, "short text"), (8, "short text"), (9, "a b " * 100 + same)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rid string, key long")
    found = passages.passages(df).collect()
    assert {r.doc_id for r in found} == {None, 4, 5, 6, 9}
    assert {(r.doc_id, r.removed) for r in found} == {(None, False), (4, True), (5, False), (6, True), (9, True)}
    one = spark.createDataFrame([(4, same), (4, same)], "doc_id long, text string")
    assert passages.passages(one).isEmpty()  # a repeated row is no other document
    assert passages.passages(df.limit(0)).isEmpty() and passages.substrings(df.limit(0), 20).isEmpty()


def test_the_query_is_both(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op3_substring_dedup(spark, SF).collect()
    lines = {(r.doc_id, r.place, r.removed) for r in rows if r.kind == "paragraph"}
    assert lines == {(r.doc_id, r.line, r.removed) for r in duplicates(docs, 20).collect()}
    assert {(r.doc_id, r.place) for r in rows if r.kind == "passage"} == {(r.doc_id, r.start) for r in passages.passages(docs).collect()}


def test_paragraphs_of_long_texts_come_in_pieces(monkeypatch):
    rng = random.Random(4)
    line = lambda: " ".join(f"z{rng.randrange(99)}" for _ in range(rng.randrange(0, 30)))
    texts = ["\n".join(line() for _ in range(60)), None, "one line " * 50, "\n\n", "\n".join(line() for _ in range(40)) + "\n"]
    seen = lambda: {(int(r), int(x), int(n), int(w)) for row, at, size, whole, _, _ in paragraph_dedup.shingled(texts, 1) for r, x, n, w in zip(row, at, size, whole)}
    whole = seen()
    monkeypatch.setattr(paragraph_dedup, "PIECE_BYTES", 100)
    assert seen() == whole and len(whole) > 80
