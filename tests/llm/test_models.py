"""The fitted operators' whole-table queries against scores that are computed one text, one token at a time."""

import math
import re

import numpy as np
import pytest

from proofline.llm import hilbert, quality, queries, secrets, toxicity
from proofline.llm.common import span_hashes

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def hashed(raw: bytes) -> int:
    return int(span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]) if raw else 0


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def quality_features(text, bits=quality.BITS):
    def kind(b):
        return 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 2 if b > 122 else 4

    out, before, shift = [], None, 64 - bits
    for token in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        word = hashed(token) >> shift
        tail = ((hashed(token[-3:]) ^ 0xA5A5A5A5A5A5A5A5) * 0xD6E8FEB86659FD93 & M64) >> shift
        shape = (kind(token[0]) * 25 + kind(token[min(1, len(token) - 1)]) * 5 + kind(token[-1]) + 1) * 0x9E3779B97F4A7C15 & M64
        out += [word, tail, (0x5851F42D4C957F2D if word == before else shape) >> shift]
        before = word
    return out


def test_quality_of_every_document(spark):
    docs, labels = tables(spark)
    model = quality.train(docs, labels)
    want = {}
    for r in docs.collect():
        f = quality_features(r.text)
        eta = 3 * sum(float(model.weights[k]) for k in f) / (len(f) + quality.PRIOR)
        up = [1 / (1 + math.exp(-(eta - t))) for t in model.thresholds]
        want[r.doc_id] = (model.grades[0] + sum(u * (b - a) for u, a, b in zip(up, model.grades, model.grades[1:])), up[0])
    got = {r.doc_id: r for r in queries.op2_quality(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (expected, tail) in want.items():
        assert got[i].expected_grade == pytest.approx(expected, abs=1e-6) and got[i].tail_probability == pytest.approx(tail, abs=1e-6)
        assert abs(tail - 0.5) < 1e-6 or got[i].keep == (tail >= 0.5)


def test_the_quality_fit_follows_the_likelihood():
    """The fitted loss is below that of small moves of every threshold and of the heaviest weights."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 120)
    texts = [" ".join(rng.choice([["low", "poor"], ["mid", "even"], ["top", "fine"]][k] + ["a", "the"], 40)) for k in y]
    m = quality.fit(texts, y.tolist())

    def loss(w, theta):
        total = 0.0
        for t, g in zip(texts, y):
            f = quality_features(t)
            eta = 3 * sum(w[k] for k in f) / (len(f) + quality.PRIOR)
            up = [1.0, *(1 / (1 + math.exp(-(eta - x))) for x in theta), 0.0]
            total -= math.log(max(up[g] - up[g + 1], 1e-9))
        return total / len(texts)

    w, theta = m.weights.astype(float), m.thresholds
    assert loss(w, theta) < 0.5 * loss(np.zeros_like(w), np.log([0.5, 2.0]))
    top = np.argsort(-np.abs(w))[:3]
    for k in top:
        for d in (-1.5, 1.5):
            v = w.copy()
            v[k] += d
            assert loss(v, theta) > loss(w, theta) - 0.02


def test_grades_of_any_scale(spark):
    docs, labels = tables(spark)
    half = labels.selectExpr("doc_id", "quality / 2.0 AS quality")
    assert quality.train(docs, half).grades.tolist() == [0.0, 0.5]
    with pytest.raises(ValueError):
        quality.train(docs, labels.selectExpr("doc_id", "doc_id AS quality"))


def test_toxicity_of_every_document(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels)

    def logit(sentence):
        cells = {}
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence):
            w = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
            for h in (hashed(w), *(hashed(w[:n]) ^ (n * 0x9E3779B97F4A7C15 & M64) for n in toxicity.STEMS)):
                c = h >> (64 - toxicity.BITS)
                if int(model.tags[c]) == h & 0xFFFFFFFF:
                    cells[c] = float(model.weights[c])
        return model.bias + sum(cells.values())

    for r, d in zip(queries.op7_toxicity(spark, SF).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        raw = (d.text or "").encode()
        parts = [p for p in re.split(rb"[.!?\n]", raw) if re.search(rb"[0-9A-Za-z\x80-\xff]", p)] or [b""]
        clean = 1.0
        for p in parts:
            clean *= 1 / (1 + math.exp(logit(p)))
        assert r.doc_id == d.doc_id and r.score == pytest.approx(1 - clean, abs=1e-5)
        assert abs(r.score - 0.7) < 1e-9 or r.predicted == (r.score >= 0.7)
        if r.worst_start is not None:
            assert logit(raw[r.worst_start : r.worst_stop]) == pytest.approx(max(map(logit, parts)), abs=1e-4)


@pytest.mark.parametrize(
    "text,found",
    [
        ("docs/example/keys/4eC39HqLyjWDarjtT1zdp7dc", True),
        ("sk_live_4eC39HqLyjWDarjtT1zxxxxdp7dcQ9", True),
        ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", False),
        ("sk_live_4eC39HqLyjWDarjtT1zdxxxxxxxxxxxx", False),
        ("sha256-4eC39HqLyjWDarjtT1zdp7dc4eC39HqLyjWD=", False),
        ("files/sha256-old_keys/4eC39HqLyjWDarjtT1zdp7dc", True),
        ("123e4567-e89b-12d3-a456-426614174000", False),
    ],
)
def test_what_the_allow_list_lets_pass(spark, text, found):
    row = secrets.scan(spark.createDataFrame([(1, f"see {text} here")], "doc_id long, text string")).first()
    assert ("entropy:" in row.spans) == found
    kept = secrets.redact(spark.createDataFrame([(1, f"see {text} here")], "doc_id long, text string")).first().text
    assert (text not in kept) == found


def test_names_that_begin_alike_are_told_apart(spark):
    rows = [(i, "t", "en", f"https://www.example.org/{chr(97 + i % 26)}", 5) for i in range(520)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = hilbert.shards(df, 26, ("source",)).collect()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, set()).add(rows[r.doc_id][3])
    assert len(by_shard) == 26 and all(len(s) <= 2 for s in by_shard.values())


def test_a_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    from proofline.llm.common import shared_dir

    spark = MagicMock()
    spark.sparkContext._jsc.sc.return_value.getCheckpointDir.return_value.isEmpty.return_value = True
    spark.sparkContext.master, spark.conf.get.return_value = "spark://host:7077", None
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)
    spark.conf.get.return_value = "hdfs://shared/folder"
    shared_dir(spark)
    spark.sparkContext.setCheckpointDir.assert_called_once_with("hdfs://shared/folder")
