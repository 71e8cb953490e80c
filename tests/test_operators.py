import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.functions import gates, settings, taxonomy
from proofline.operators import assigned, copied, evidence as E, free_text, guardrails, judging, metrics, ranking, runs, runs as R
from proofline.sources import readers, writers
from proofline.streaming import live


def test_longest_shared_run_is_that_of_dynamic_programming(spark):
    rng = random.Random(3)
    rows = [(str(k), " ".join(rng.choices("abcde", k=30)), " ".join(rng.choices("abcde", k=20))) for k in range(30)] + [("blank", "", "a b"), ("same", "a a a a", "a a a a")]

    def run(a, b):
        best, row = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, max(row))
        return best

    got = {r.item_id: r.run for r in free_text.longest_shared_run(spark.createDataFrame(rows, "item_id string, source string, written string")).collect()}
    assert got == {i: run(a.split(), b.split()) for i, a, b in rows}


@pytest.mark.parametrize("text,want", [("2026-03-03", date(2026, 3, 3)), ("March 3, 2026", date(2026, 3, 3)), ("Mar. 3, 2026", date(2026, 3, 3)), ("3rd March 2026", date(2026, 3, 3)), ("04/05/2026", None), ("2026-02-30", None), ("2026-02-30 or March 3, 2026", None)])
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(copied.parse_date(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text,want", [("$1,234.50", 1234.5), ("1234.5", 1234.5), ("1.2.3", None), ("none", None), ("-3", -3.0)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(copied.parse_number(F.col("t"))).first()[0] == want


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 9, 300).astype(float), rng.random(300) < 0.3
    got = ranking.auc(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "score double, error boolean")).first()
    pos, neg = s[y], s[~y]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got.auc == pytest.approx(want, abs=1e-6)
    assert ranking.auc(spark.createDataFrame([(1.0, True)], "score double, error boolean")).first().auc is None


def test_bootstrap_interval_holds_the_point(spark):
    rows = [(float(k % 17), k % 3 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "score double, error boolean")
    b, point = ranking.bootstrap_auc(df, 300).first(), ranking.auc(df).first().auc
    assert b.low < point < b.high


def test_recall_shares_ties_at_the_cut(spark):
    df = spark.createDataFrame([(str(k), 1.0, k < 5) for k in range(10)], "item_id string, score double, error boolean")
    assert {r.budget: r.recall for r in ranking.recall_at_budget(df, (0.2, 0.5)).collect()} == {0.2: 0.2, 0.5: 0.5}


def test_sigmoid_recovers_rates():
    rng = np.random.default_rng(0)
    s = rng.random(5000)
    a, b = ranking.fit_sigmoid(s, rng.random(5000) < 1 / (1 + np.exp(-(4 * s - 2))))
    assert a == pytest.approx(-4, abs=0.4) and b == pytest.approx(2, abs=0.3)


def test_constant_judge_has_no_correlation(spark):
    rows = [(str(k), j, "pass" if j == "a" or k % 2 else "fail") for k in range(20) for j in "ab"]
    r = metrics.pairwise_agreement(spark.createDataFrame(rows, "item_id string, judge string, status string")).first()
    assert r.phi is None and r.agreement == 0.5


def test_unscored_is_no_pass(spark):
    rows = [("1", "a", "pass"), ("1", "b", "unscored"), ("2", "a", "fail"), ("3", "a", "unscored")]
    r = metrics.grain_rates(spark.createDataFrame(rows, "item_id string, check string, status string")).first()
    assert (r.findings, r.items, r.field_rate, r.item_rate) == (2, 2, 0.5, 0.5)


def test_labels_do_not_reach_a_ranker(spark):
    with pytest.raises(gates.LabelLeak):
        gates.assert_no_labels(spark.createDataFrame([("1", "x")], "item_id string, label string"))


def test_gate_two_needs_a_clear_lead():
    assert gates.gate_two({"low": 0.6}, {"random": 0.5, "length": None})[0] == "pass"
    assert gates.gate_two({"low": 0.5}, {"random": 0.5})[0] == "stop"
    assert gates.gate_two({"low": 0.5}, {"random": None})[0] == "unscored"


TREE = {"id": "t", "version": 1, "nodes": {"a": {"definition": "first", "children": {"b": {"definition": "below", "examples": ["x"]}}}, "c": {"definition": "other"}}}


def test_taxonomy_rules(spark):
    t = taxonomy.parse(TREE)
    assert t.ancestors("a.b") == ("a",) and t.leaves() == ("a.b", "c") and t.table(spark).count() == 3
    assert ("", "leaves of uneven depth") in taxonomy.health(t) and ("c", "no examples") in taxonomy.health(t)
    with pytest.raises(taxonomy.BadTaxonomy):
        taxonomy.parse({"id": "t", "version": 1, "nodes": {"abstain": {"definition": "x"}}})
    with pytest.raises(taxonomy.BadTaxonomy):
        taxonomy.check_digest(t, {"t@v1": "0"})


def test_settings_know_their_source():
    assert settings.resolve("max_copy_ratio", {"max_copy_ratio": 0.6}, {"max_copy_ratio": 0.7}) == settings.Resolved(0.6, "field")
    assert settings.resolve("max_copy_ratio", None, settings.load("max_copy_ratio: 0.7")).source == "settings"
    with pytest.raises(settings.BadSetting):
        settings.load("max_copy_ratio: 7")


def test_readers(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"id": "1", "text": "a", "lang": "en"}\n\n{"id": "2", "text": "b", "lang": "fr"}\n')
    (tmp_path / "o.csv").write_text("item_id,label,confidence\n1,x,0.5\n2,,\n")
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n[1]\n')
    items = readers.read_items(spark, str(tmp_path / "i.jsonl"))
    assert sorted((r.item_id, r.text, r.metadata["lang"]) for r in items.collect()) == [("1", "a", "en"), ("2", "b", "fr")]
    out = readers.read_outputs(spark, str(tmp_path / "o.csv"))
    assert {r.item_id: (r.label, r.confidence) for r in out.collect()} == {"1": ("x", 0.5), "2": (None, None)}
    assert readers.outputs_long(out).count() == 4
    with pytest.raises(readers.BadInput):
        readers.read_source(spark, str(tmp_path / "bad.jsonl"))
    with pytest.raises(readers.BadInput):
        readers.read_labels(spark, [{"item_id": "1", "field": "f", "label": "", "annotator": "x"}])
    with pytest.raises(ValueError):
        runs.index_items(spark.createDataFrame([("1",), ("1",)], "item_id string"))


def test_writers(spark, tmp_path):
    assert writers.run_name("r", datetime(2026, 1, 2, 3, 4)) == "2026-01-02_0304_r"
    assert writers.run_name("r", datetime(2026, 1, 2, 3, 4), {"2026-01-02_0304_r"}) == "2026-01-02_0304_r-2"
    for k in (1, 2):
        writers.append_index(spark, str(tmp_path / "index"), {"project": "p", "run_id": f"r{k}", "at": datetime(2026, 1, k)})
    assert writers.latest_run(spark.read.parquet(str(tmp_path / "index")), "p").first().run_id == "r2"


def test_only_new_questions_are_asked(spark):
    q = spark.createDataFrame([("1", "k1"), ("2", "k2"), ("3", "k2")], "item_id string, key string")
    assert [r.key for r in runs.to_ask(q, spark.createDataFrame([("k1",)], "key string")).collect()] == ["k2"]


def test_stream_counts_what_a_batch_counts(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src).select("ts", F.col("event_type").alias("label")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, label string").parquet(str(tmp_path / "in"))
    q = live.windowed_shares(stream, "1 day", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("shares").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from shares").first()[0] == spark.read.parquet(src).count()


def test_empty_outputs_are_unscored(spark):
    assert assigned.abstention_rate(spark.createDataFrame([], "item_id string, value string")).first().status == "unscored"


def test_claims_and_verdicts_from_replies(spark):
    rows = [("a", 'x {"claims": [{"claim": "p", "supported": true}, {"claim": "q", "supported": 0}, {"claim": "r"}], "missing": " m "} y'), ("b", "{}"), ("c", None), ("d", '{"claims": [{"supported": null}]}'), ("e", '{"claims": [{"supported": "yes"}]}')]
    got = {r.item_id: tuple(r)[1:] for r in E.parse_claims(spark.createDataFrame(rows, "item_id string, reply string")).collect()}
    assert got["a"] == (2, 1, 0.5, "fail", 0.5, "m") and got["b"] == got["c"] == (None, None, None, "unparseable", None, None)
    assert got["d"][3:5] == ("fail", 1.0) and got["e"][3:5] == ("pass", 1.0)
    said = R.parse_replies(spark.createDataFrame([("a", '{"correct": "cannot_decide"}'), ("b", '{"correct": "true"}')], "item_id string, reply string"))
    assert sorted(r.status for r in said.collect()) == ["cannot_decide", "unparseable"]


def test_resampled_intervals_hold_the_point(spark):
    rows = [(str(i), float(i % 7)) for i in range(300)] + [(str(i), float(i % 5)) for i in range(300)]
    r = E.bootstrap_ci(spark.createDataFrame(rows, "item_id string, value double"), E.weighted_mean, resamples=200).first()
    assert r.low < sum(v for _, v in rows) / 600 < r.high and r.resamples == 200
    scored = spark.createDataFrame([(float(i), i % 3 == 0 or i > 250) for i in range(300)], "score double, error boolean")
    q = E.recall_interval(scored, 0.1, 200).first()
    assert q.low < 30 / 133 < q.high
    assert E.recall_interval(scored.limit(50), 0.1, 20).first().resamples == 0


def test_a_provider_over_http_waits_and_gives_up():
    seen, waits = [], []

    def send(answers):
        it = iter(answers)

        def one(body):
            seen.append(body["prompt"])
            a = next(it)
            if isinstance(a, Exception):
                raise a
            return a

        return one

    ask = lambda answers: judging.over_http(send(answers), "m", sleep=waits.append)("q")
    assert ask([(429, ""), TimeoutError(), (503, ""), (200, "yes")]) == "yes" and len(seen) == 4
    assert len(waits) == 3 and waits[0] < waits[1] < waits[2]
    with pytest.raises(judging.ProviderFailed, match="401"):
        ask([(401, "")])
    with pytest.raises(judging.ProviderFailed, match="500"):
        ask([(500, "")] * 4)


@pytest.mark.parametrize("reply,want", [('so {"a": "x"} end', "x"), ('{"a": null}', None), ("{}", None), ("[1]", None), ("{bad}", None), ("} {", None), (None, None), ('{"a": 3}', "3")])
def test_a_field_of_a_reply(reply, want):
    assert judging.read_field(reply, "a") == want


def test_one_question_is_asked_once_by_the_first_pass(spark):
    rows = spark.createDataFrame([("1", "t", "v"), ("2", "u", "w"), ("3", "x", None), ("4", "x", " ")], "item_id string, text string, value string")
    q = lambda kind="assigned", judges=("a",): judging.questions(rows, kind, "f", list(judges))
    assert q().count() == 2 and q("copied", ("a", "b")).count() == 4
    todo = judging.collect_run(q(), q(judges=("a", "b")), q(judges=("b", "c")), q().filter("item_id = '1'")).collect()
    assert sorted((r.item_id, r.judge, r.selected_by) for r in todo) == [("1", "b", "panel"), ("1", "c", "gated"), ("2", "a", "triage"), ("2", "b", "panel"), ("2", "c", "gated")]


def test_an_estimate_beats_only_what_its_interval_clears(spark):
    rows = [("a", 0.9, 0.8, 1.0, 50), ("b", 0.7, 0.65, 0.75, 20), ("c", None, None, None, 0)]
    got = {r.name: (r.beats, r.under_floor) for r in guardrails.estimates(spark.createDataFrame(rows, "name string, value double, low double, high double, n long")).collect()}
    assert got == {"a": (True, False), "b": (False, True), "c": (False, True)}


def test_health_flags_are_independent(spark):
    rows = [("a", None, 0.0), ("b", 0.99, 0.06), ("c", 0.9, 0.03), ("d", 0.5, 0.0)]
    got = {tuple(r) for r in guardrails.health_flags(spark.createDataFrame(rows, "judge string, approval double, unreadable double")).collect()}
    assert got == {("a", "stop", "scored nothing"), ("b", "stop", "one-sided"), ("b", "stop", "unreadable"), ("c", "warn", "leaning"), ("c", "warn", "unreadable")}


def test_public_names_are_there():
    from proofline import api

    assert all(hasattr(api, n) for n in api.__all__) and {"read_items", "run", "screen", "auc"} <= set(api.__all__)


def test_lines_of_an_object_keep_nulls(spark, tmp_path):
    writers.write_lines(spark.createDataFrame([("1", None)], "a string, b string"), str(tmp_path / "x.jsonl"))
    assert spark.read.text(str(tmp_path / "x.jsonl")).first().value == '{"a":"1","b":null}'


def test_gate_two_speaks_of_a_poor_target_alone(spark):
    rows = [(str(i), i % 20 == 0, float(i % 20 == 0)) for i in range(100)]
    target = spark.createDataFrame([(i, e) for i, e, _ in rows], "item_id string, error boolean")
    rank = lambda t, right: {"mine": t.selectExpr("item_id", "CAST(error AS double) AS score" if right else "CAST(hash(item_id) AS double) AS score"), "other": t.selectExpr("item_id", "CAST(length(item_id) AS double) AS score")}

    def gate(t, right):
        s = guardrails.scored_strategies(rank(t, right), t)
        return {(r.id, r.severity) for r in guardrails.gate_two_rows(s, "mine", guardrails.normal_low(s, "mine"), t).collect()}

    assert gate(target, True) == {("degenerate_target", "stop")}
    better = spark.createDataFrame([(str(i), i % 3 == 0) for i in range(300)], "item_id string, error boolean")
    assert gate(better, True) == set() and gate(better, False) == {("loses_to_baseline", "stop")}
