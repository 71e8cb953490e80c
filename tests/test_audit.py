"""An audit of three kinds of fields on a handful of rows whose findings can be read off."""

import pytest
from pyspark.sql import functions as F

from proofline.functions.settings import BadSetting
from proofline.operators import free_text
from proofline.plans.audit import Field, audit, questions, suspicious
from proofline.plans.registry import ORACLES
from proofline.sources.readers import BadInput


@pytest.fixture(scope="module")
def rows(spark):
    tree = spark.createDataFrame([("warm", "warm", "kind glowing words", None, True), ("cold", "cold", "curt words", None, False), ("cold.rude", "rude", "angry words", "cold", True)], "path string, name string, definition string, parent string, is_leaf boolean")
    items = spark.createDataFrame([("1", "paid 12.50 on 2024-01-02 glowing"), ("2", "paid 7 and 8"), ("3", "nothing here"), ("4", "sum 3"), ("5", None)], "item_id string, text string")
    outputs = spark.createDataFrame(
        [("1", "warm", "a glowing note", "12.5"), ("2", "cold", "", "8"), ("3", "odd", "nothing here", "9"), ("4", None, None, None), ("5", "warm", "words", "1"), ("9", "warm", "no item", "1")],
        "item_id string, tone string, note string, total string",
    )
    fields = [Field("tone", "assigned", tree, settings={"allow_abstain": False}), Field("note", "free_text", agrees_with="tone", settings={"min_words": 2}), Field("total", "copied", value_type="number")]
    return items, outputs, fields


def test_findings_of_every_kind(rows):
    items, outputs, fields = rows
    got = {(r.field, r.check, r.item_id): r.status for r in audit(items, outputs, fields).collect()}
    assert {k[2]: v for k, v in got.items() if k[1] == "label_in_taxonomy"} == {"1": "pass", "2": "pass", "3": "fail", "5": "pass"}
    assert got["tone", "valid_leaf", "2"] == "fail" and got["tone", "valid_leaf", "1"] == "pass" and got["tone", "abstention_allowed", "4"] == "fail"
    assert got["note", "length_in_bounds", "1"] == "pass" and got["note", "length_in_bounds", "2"] == got["note", "length_in_bounds", "5"] == "fail"
    assert got["note", "copy_ratio", "3"] == "fail" and got["note", "copy_ratio", "1"] == "pass" and ("note", "copy_ratio", "2") not in got
    assert got["note", "cross_field_agreement", "1"] == "pass" and got["note", "cross_field_agreement", "3"] == "unscored"
    assert got["total", "value_in_source", "1"] == got["total", "value_in_source", "2"] == "pass" and got["total", "value_in_source", "3"] == "fail"
    assert {k[2] for k in got if k[1] == "ambiguous"} == {"2"} and got["total", "grounding_rate", None] == "fail"
    assert not any(k[2] == "9" for k in got)  # no item


def test_questions_follow_suspicion(rows):
    items, outputs, fields = rows
    found = audit(items, outputs, fields)
    assert {r.item_id for r in suspicious(found, "total").collect()} == {"2", "3", "5"}
    asked = {(r.field, r.item_id, r.selected_by) for r in questions(items, outputs, found, fields, ["j"], {"audit_rate": 0.1}).collect()}
    assert {a[1] for a in asked if a[0] == "tone"} == {"1", "2", "3", "5"}
    assert {a for a in asked if a[0] == "total"} == {("total", "2", "flagged"), ("total", "3", "flagged"), ("total", "5", "flagged"), ("total", "1", "audit")}


def test_bad_fields_are_refused(rows):
    items, outputs, fields = rows
    for bad in (lambda: Field("x", "guess"), lambda: Field("x", "assigned"), lambda: audit(items, outputs, [Field("gone", "free_text")]), lambda: audit(items, outputs, [Field("note", "free_text", agrees_with="total"), fields[2]])):
        with pytest.raises(BadInput):
            bad()
    with pytest.raises(BadSetting):
        Field("note", "free_text", settings={"wrong": 1})


def test_free_text_is_read_where_it_is(rows):
    """sources were dealt out a token a row, by item and token, to be compared with what was written."""
    items, outputs, _ = rows
    pairs = items.join(outputs, "item_id").select("item_id", items.text.alias("source"), outputs.note.alias("written"))
    plan = free_text.copy_ratio(pairs.filter("item_id IS NOT NULL"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "MapInArrow" in plan


def test_findings_are_worked_out_once_for_all_questions(rows, spark):
    """each gated field, and each use of it, worked the findings out anew."""
    items, outputs, fields = rows
    found, n = audit(items, outputs, fields), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    seen = found.coalesce(1).mapInArrow(counted, found.schema)
    total = found.count()
    questions(items, outputs, seen, fields, ["j"]).collect()
    assert n.value <= total


def test_long_runs_of_odd_tokens(spark):
    """a long copy, tokens that begin others, and an apostrophe of three bytes."""
    many = " ".join(f"w{k % 97}" for k in range(3000))
    rows = [("long", "x " + many, many), ("part", "abc abcd", "ab abc"), ("mark", "It’s Lou’s-own day", "lou’s-own DAY"), ("none", None, "a"), ("void", "a", None)]
    got = {r.item_id: r.run for r in free_text.longest_shared_run(spark.createDataFrame(rows, "item_id string, source string, written string")).collect()}
    assert got == {"long": 3000, "part": 1, "mark": 2, "none": 0, "void": 0}


def test_boilerplate_of_any_number_of_texts(spark):
    """texts were not held for boilerplate once more than 200 of them shared their shingles."""
    same = "thank you for your order we will get back to you soon"
    number = F.col("item_id").cast("int")
    items = spark.createDataFrame([(str(k), "source") for k in range(260)], "item_id string, text string")
    outputs = items.select("item_id", F.when(number < 120, F.lit(same)).when(number < 230, F.concat(F.lit(f"{same} number "), "item_id")).otherwise(F.concat_ws(" ", *(F.concat(F.lit(w), "item_id") for w in "abcdefg"))).alias("note"))
    want = {r.item_id for r in outputs.filter(F.col("note").startswith(same)).collect()}
    got = {r.item_id: r.score for r in audit(items, outputs, [Field("note", "free_text")]).filter("check = 'boilerplate'").collect()}
    assert len(want) > 200 and set(got) == want and got["1"] == 1 and 0.8 <= got["200"] < 1
    assert ORACLES["b04c_audit_questions"].count("BETWEEN 2 AND 200") == 0


def test_rare_words_are_counted_where_they_are(spark):
    """every word of every source was dealt by its token, and again by its item."""
    pairs = spark.createDataFrame([(str(k), f"all say this and own{k}", f"own{k}" if k % 2 else "all") for k in range(40)] + [("none", None, "all")], "item_id string, source string, written string")
    got = free_text.specificity(pairs)
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan
    assert {(r.item_id, r.available, r.used, r.status) for r in got.collect()} == {(str(k), 1, k % 2, "pass" if k % 2 else "fail") for k in range(40)} | {("none", 0, 0, "unscored")}


def test_outputs_are_read_once(rows, spark):
    """each check, and each step of boilerplate, read the outputs and what they come from anew."""
    items, outputs, fields = rows
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    found = audit(items, outputs.coalesce(1).mapInArrow(counted, outputs.schema), fields, postings=200)
    assert found.count() == audit(items, outputs, fields, postings=200).count() and n.value == outputs.count()
