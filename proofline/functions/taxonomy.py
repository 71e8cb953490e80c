"""Versioned label trees: parsing, rules, content digest, health, migration."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession, functions as F

NAME = re.compile(r"[a-z][a-z0-9_]*")
ALLOWED = {"definition", "examples", "not_this", "children"}


class BadTaxonomy(ValueError):
    """A tree that breaks a rule."""


@dataclass(frozen=True)
class Node:
    path: str
    definition: str
    examples: tuple[str, ...] = ()
    not_this: tuple[str, ...] = ()
    children: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]

    @property
    def parent(self) -> str | None:
        return self.path.rpartition(".")[0] or None


@dataclass(frozen=True)
class Taxonomy:
    id: str
    version: int
    nodes: Mapping[str, Node] = field(default_factory=dict)

    @property
    def ref(self) -> str:
        return f"{self.id}@v{self.version}"

    def ancestors(self, path: str) -> tuple[str, ...]:
        parts = path.split(".")
        return tuple(".".join(parts[:k]) for k in range(1, len(parts)))

    def siblings(self, path: str) -> tuple[str, ...]:
        return tuple(p for p, n in self.nodes.items() if n.parent == self.nodes[path].parent and p != path)

    def leaves(self) -> tuple[str, ...]:
        return tuple(p for p, n in self.nodes.items() if not n.children)

    def digest(self) -> str:
        plain = {p: [n.definition, sorted(n.examples), sorted(n.not_this)] for p, n in self.nodes.items()}
        return hashlib.sha256(json.dumps([self.id, plain], sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, n.name, n.definition, n.parent, not n.children) for p, n in self.nodes.items()]
        return spark.createDataFrame(rows, "path string, name string, definition string, parent string, is_leaf boolean")


def parse(body: Mapping) -> Taxonomy:
    """A tree from plain mappings: names are lower-case words, every node has a definition, `abstain` is no label."""

    def walk(nodes: Mapping, above: str) -> Iterator[Node]:
        for name, node in nodes.items():
            path = f"{above}.{name}" if above else name
            if not NAME.fullmatch(name) or name == "abstain":
                raise BadTaxonomy(f"{path}: not a name for a label")
            if unknown := set(node) - ALLOWED:
                raise BadTaxonomy(f"{path}: unknown keys {sorted(unknown)}")
            if not str(node.get("definition") or "").strip():
                raise BadTaxonomy(f"{path}: no definition")
            below = node.get("children") or {}
            yield Node(path, node["definition"], tuple(node.get("examples") or ()), tuple(node.get("not_this") or ()), tuple(f"{path}.{c}" for c in below))
            yield from walk(below, path)

    if "id" not in body or "version" not in body or not body.get("nodes"):
        raise BadTaxonomy("a taxonomy needs id, version and nodes")
    return Taxonomy(body["id"], int(body["version"]), {n.path: n for n in walk(body["nodes"], "")})


def from_table(nodes: DataFrame, id: str, version: int, most: int = 10_000) -> Taxonomy:
    """A tree from its table (path, definition, parent); one of over `most` nodes is no tree for people and raises."""
    rows = nodes.select("path", "definition", "parent").orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise BadTaxonomy(f"more than {most} nodes")
    below: dict[str, list[str]] = {}
    for r in rows:
        below.setdefault(r.parent, []).append(r.path)
    return Taxonomy(id, version, {r.path: Node(r.path, r.definition, children=tuple(below.get(r.path, ()))) for r in rows})


def problems(nodes: DataFrame) -> DataFrame:
    """(path, problem) of a table of nodes (path, definition, parent) that parse() would refuse, the first problem of each."""
    name = F.substring_index("path", ".", -1)
    above = nodes.select(F.col("path").alias("parent"), F.lit(True).alias("held"))
    bad = F.when((name == "abstain") | ~F.rlike(name, F.lit("^[a-z][a-z0-9_]*$")), "not a name for a label").when(F.trim(F.coalesce("definition", F.lit(""))) == "", "no definition").when(F.col("parent").isNotNull() & F.col("held").isNull(), "no node above")
    return nodes.join(above, "parent", "left").select("path", bad.alias("problem")).filter("problem IS NOT NULL")


def check_digest(taxonomy: Taxonomy, recorded: Mapping[str, str]) -> None:
    if recorded.get(taxonomy.ref, taxonomy.digest()) != taxonomy.digest():
        raise BadTaxonomy(f"{taxonomy.ref} has changed under the same version")


def health(taxonomy: Taxonomy, alike: float = 0.8) -> list[tuple[str, str]]:
    """(path, what is wrong), in order: no examples, names used twice, definitions too alike, siblings without a boundary."""
    out, nodes = [], list(taxonomy.nodes.values())
    out += [(p, "no examples") for p in taxonomy.leaves() if not taxonomy.nodes[p].examples]
    names: dict[str, list[str]] = {}
    for n in nodes:
        names.setdefault(n.name, []).append(n.path)
    out += [(p, "name used twice") for paths in names.values() if len(paths) > 1 for p in paths]
    for i, a in enumerate(nodes):
        out += [(a.path, f"defined like {b.path}") for b in nodes[i + 1 :] if SequenceMatcher(None, a.definition.lower(), b.definition.lower()).ratio() >= alike]
    out += [(p, "no boundary to its siblings") for p in taxonomy.leaves() if taxonomy.siblings(p) and not taxonomy.nodes[p].not_this]
    depth = {p.count(".") for p in taxonomy.leaves()}
    return sorted(out + ([("", "leaves of uneven depth")] if len(depth) > 1 else []))


def migration(spark: SparkSession, old: Taxonomy, new: Taxonomy, mapping: Mapping[str, str | None]) -> DataFrame:
    """(old, new) table; every old label must be covered and every target known."""
    if missing := set(old.nodes) - set(mapping):
        raise BadTaxonomy(f"no target for {sorted(missing)}")
    if bad := {t for t in mapping.values() if t is not None} - set(new.nodes):
        raise BadTaxonomy(f"unknown targets {sorted(bad)}")
    return spark.createDataFrame(list(mapping.items()), "old string, new string")
