"""A small project from its files to two runs and their comparison, by the command line's own functions."""

import json
from datetime import datetime

import pytest
import yaml

from proofline.__main__ import main
from proofline.functions import taxonomy
from proofline.operators.runs import scripted_provider
from proofline.plans import project
from proofline.sources.readers import BadInput

TREE = {"id": "tone", "version": 1, "nodes": {"good": {"definition": "pleased", "children": {"warm": {"definition": "kind words"}, "brief": {"definition": "short thanks"}}}, "bad": {"definition": "annoyed"}}}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("project")
    says = ["good.warm", "good.brief", "bad", "good", "odd", None]
    lines = lambda rows: "\n".join(map(json.dumps, rows))
    (d / "items.jsonl").write_text(lines({"id": str(i), "text": f"words of item {i}"} for i in range(60)))
    (d / "outputs.jsonl").write_text(lines({"item_id": str(i), "tone": says[i % 6]} for i in range(60)))
    (d / "labels.jsonl").write_text(lines({"item_id": str(i), "field": "tone", "label": "bad" if i % 4 == 2 else "good.warm", "annotator": "x"} for i in range(50)))
    (d / "tree.yml").write_text(yaml.safe_dump(TREE))
    config = {"project": "p", "items": str(d / "items.jsonl"), "outputs": str(d / "outputs.jsonl"), "labels": str(d / "labels.jsonl"), "taxonomy": str(d / "tree.yml"), "field": "tone", "judges": ["judge-a", "judge-b"]}
    (d / "project.yml").write_text(yaml.safe_dump(config))
    return d, project.load(yaml.safe_dump(config)), taxonomy.parse(TREE)


def test_run_analyse_evaluate_compare(spark, files):
    d, config, tree = files
    ask = {j: scripted_provider(j) for j in config["judges"]}
    assert project.plan(spark, config, tree).first().calls == 100
    a = project.run(spark, config, tree, str(d / "out"), ask, datetime(2024, 1, 1))
    refuse = {j: None for j in config["judges"]}
    b = project.run(spark, config, tree, str(d / "out"), refuse, datetime(2024, 1, 2), reuse=spark.read.parquet(f"{a}/verdicts"))
    assert spark.read.parquet(f"{b}/verdicts").count() == 100
    shown = dict(project.analyse(spark, a, config, tree))
    assert shown["findings"] == 90 and shown["accuracy"] is not None and dict(project.analyse(spark, a))["accuracy"] is None
    table = project.triage_eval(spark, a, config, tree).collect()
    assert {r.strategy for r in table} == {"raw_confidence", "panel_disagreement", "output_length", "random"} and all(0 <= r.recall <= 1 for r in table)
    changes, shift = project.compare(spark, a, b)
    assert [tuple(r) for r in changes.collect()] == [("unchanged", 50)] and all(r.delta == 0 for r in shift.collect())
    assert spark.read.parquet(str(d / "out/index")).count() == 2


def test_command_line_refuses_bad_input(files, capsys):
    d, _, _ = files
    assert main(["check", str(d / "tree.yml")]) == 0 and "no examples" in capsys.readouterr().out
    (d / "bad.yml").write_text("project: p\n")
    assert main(["plan", str(d / "bad.yml")]) == 2 and "error" in capsys.readouterr().err
    with pytest.raises(BadInput):
        project.load(yaml.safe_dump({k: "x" for k in (*project.NEEDED, "colour")}))


def test_a_report_has_gates_and_what_they_withhold(spark, files):
    d, config, tree = files
    path = project.run(spark, config, tree, str(d / "gated"), {j: (lambda prompt: '{"correct": true, "confidence": 0.9}') for j in config["judges"]}, datetime(2024, 2, 1))
    bare, full = dict(project.analyse(spark, path)), dict(project.analyse(spark, path, config, tree))
    assert bare["gate: no_label_leakage"] == "note, ok" and bare["gate: judge_health"].startswith("stop, ") and "panel.agreement" in "".join(bare)
    assert "calibration gap" in bare and bare["calibration gap"] is None and full["calibration gap"] is not None and "area of random" in full
    assert 0 <= full["passed label_in_taxonomy"] <= 1 and any(k.startswith("withheld: ") for k in full)
