"""python -m proofline run|plan|analyse|triage-eval|compare|check|list|query; errors of the input end with 2."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from proofline.functions import gates, settings, taxonomy as trees
from proofline.operators.runs import scripted_provider
from proofline.plans import project, registry
from proofline.sources.readers import BadInput


#: Each command with what it needs.
COMMANDS = {"run": ("config",), "plan": ("config",), "analyse": ("directory",), "triage-eval": ("directory", "config"), "compare": ("a", "b"), "check": ("taxonomy",), "list": (), "query": ("name", "tables")}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="proofline")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, names in COMMANDS.items():
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
        if name in ("run", "query"):
            p.add_argument("--out", default="out" if name == "run" else None)
        if name == "run":
            p.add_argument("--reuse", help="a run's folder whose verdicts are not asked for again")
        if name == "analyse":
            p.add_argument("--config")
        if name == "compare":
            p.add_argument("--migration", help="a file of old: new labels")
    return parser


def _project(path: str) -> tuple[dict, trees.Taxonomy]:
    config = project.load(Path(path).read_text())
    return config, trees.parse(yaml.safe_load(Path(config["taxonomy"]).read_text()))


def _act(args: argparse.Namespace) -> None:
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    if args.command == "check":
        found = trees.health(trees.parse(yaml.safe_load(Path(args.taxonomy).read_text())))
        print("\n".join(f"{p or 'tree'}: {what}" for p, what in found) or "nothing to say")
        return
    spark = SparkSession.builder.appName("proofline").getOrCreate()
    if args.command == "query":
        if args.name not in registry.QUERIES:
            raise BadInput(f"no query {args.name}")
        df = registry.QUERIES[args.name](spark, args.tables)
        df.write.parquet(args.out) if args.out else df.show(50, truncate=False)
    elif args.command == "plan":
        project.plan(spark, *_project(args.config)).show()
    elif args.command == "run":
        config, tree = _project(args.config)
        reuse = spark.read.parquet(f"{args.reuse}/verdicts") if args.reuse else None
        print(project.run(spark, config, tree, args.out, {j: scripted_provider(j) for j in config["judges"]}, reuse=reuse))
    elif args.command == "analyse":
        print(gates.render(args.directory, project.analyse(spark, args.directory, *(_project(args.config) if args.config else ()))))
    elif args.command == "triage-eval":
        project.triage_eval(spark, args.directory, *_project(args.config)).orderBy("strategy", "budget").show(100, truncate=False)
    else:
        mapping = yaml.safe_load(Path(args.migration).read_text()) if args.migration else None
        table = spark.createDataFrame(list(mapping.items()), "old string, new string") if mapping else None
        for df in project.compare(spark, args.a, args.b, table):
            df.show(100, truncate=False)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        _act(args)
    except (BadInput, settings.BadSetting, trees.BadTaxonomy, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
