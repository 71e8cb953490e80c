"""Shingles that are dealt in packs, against sets of words."""

import random
from collections import Counter

import pytest

from proofline.operators import free_text, joins
from proofline.operators.shingles import hashed, packs, _Words


@pytest.fixture(scope="module")
def texts(spark):
    """Families of near copies and of copies, short texts, and texts without a token."""
    rng, rows = random.Random(5), [("none", None), ("blank", " .. "), ("a", "one"), ("b", "ONE"), ("c", "one two three"), ("d", "one two three")]
    for f in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        for k in range(f + 2):
            own = list(base)
            for _ in range(k % 3):
                own[rng.randrange(60)] = f"x{k}"
            rows.append((f"{f}-{k}", "Dear reader please note the following lines " + " ".join(own)))
    return rows, spark.createDataFrame(rows, "item_id string, text string").repartition(4)


def words(text):
    w = (text or "").lower().replace(".", " ").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pairs_are_those_of_all_sets(texts, monkeypatch):
    """and no table of the sets is written, nor are they dealt a shingle a row."""
    rows, df = texts
    wrote, put = [], free_text.stored
    monkeypatch.setattr(free_text, "stored", lambda t, name: wrote.append(t.dtypes) or put(t, name))
    have = {i: words(t) for i, t in rows}
    n = Counter(x for s in have.values() for x in s)
    for most in (6, 200, None):
        want = {}
        for a in have:
            for b in have:
                both = have[a] & have[b]
                if a < b and any(most is None or n[x] <= most for x in both) and len(both) / len(have[a] | have[b]) >= 0.8:
                    want[a, b] = round(len(both) / len(have[a] | have[b]), 6)
        assert {(r.left, r.right): r.similarity for r in free_text.boilerplate(df, postings=most).collect()} == want
    best = {}
    for (a, b), j in want.items():
        best[a], best[b] = max(j, best.get(a, 0)), max(j, best.get(b, 0))
    assert {r.item_id: r.score for r in free_text.alike(df).collect()} == best
    assert not any(kind.startswith("array") for t in wrote for _, kind in t)


def test_two_copies_stand_for_all(texts, spark, monkeypatch):
    """an audit took every pair of copies; scores and the bound on texts that share a shingle are those of all texts."""
    rows, df = texts
    for most in (3, 6, 200):
        best = {}
        for r in free_text.boilerplate(df, postings=most).collect():
            for i in (r.left, r.right):
                best[i] = max(r.similarity, best.get(i, 0))
        assert best and {r.item_id: r.score for r in free_text.alike(df, postings=most).collect()} == best
    near, put = [], free_text.stored
    monkeypatch.setattr(free_text, "stored", lambda t, name: near.append(put(t, name)) or near[-1])
    same = spark.createDataFrame([(f"{k:03}", f"{k % 2} " + "one and the same words for a hundred and more") for k in range(150)], "item_id string, text string")
    assert {r.score for r in free_text.alike(same, 0.7, 150).collect()} == {1.0} and near[-1].count() <= 6
    assert free_text.alike(same, 0.7, 74).count() == 0 and free_text.alike(same, 0.7, 75).count() == 150


def test_shared_shingles_are_those_of_all_sets(texts):
    """a shingle is dealt once, in a pack; shingles were written, dealt to be counted and dealt again to be joined."""
    rows, df = texts
    have = {i: words(t) for i, t in rows}
    n = Counter(x for s in have.values() for x in s)
    for most in (6, 200):
        want = {i: k for i, s in have.items() if (k := sum(2 <= n[x] <= most for x in s))}
        got = joins.texts_by_shingle(df, most)
        assert {r.item_id: r.shared for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and packs(df).filter("bucket < 0").count() == 0


def test_hashes_tell_texts_apart():
    known = _Words()
    assert len(hashed(b"a b c d e a b c d e", known)) == 5 and len(hashed(b"", known)) == 0
    assert len({int(hashed(t, known)[0]) for t in (b"a", b"a a", b"a b", b"b a", b"ab", b"a b c d e", b"e d c b a")}) == 7
