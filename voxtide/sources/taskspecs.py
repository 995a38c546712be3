"""Task specifications: what a task asks for, from version 1 JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession

from voxtide.extract import TaskSpec

# The kind of each task, and the fields that its specification must have.
TASKS = {
    "picture_desc_1": ("picture", ("concept_aliases", "entity_groups", "action_groups")),
    "picture_desc_2": ("picture", ("concept_aliases", "entity_groups", "action_groups")),
    "immediate_recall": ("recall", ("idea_aliases",)),
    "delayed_recall": ("recall", ("idea_aliases",)),
    "phonemic_fluency": ("phonemic", ("initials", "exclusions")),
    "semantic_fluency": ("semantic", ("item_aliases", "subcategories")),
}
#: A specification is configuration: a longer file is refused.
MOST_CHARACTERS = 10_000_000


class InvalidTaskSpec(ValueError):
    """A specification that can't be used; the message names the field, never a value."""


def parse(text: str, task: str | None = None) -> TaskSpec:
    """The specification in ``text``; ``task`` stands in where it names none."""
    if len(text) > MOST_CHARACTERS:
        raise InvalidTaskSpec("task specification is too long")
    try:
        spec = json.loads(text)
    except ValueError:
        raise InvalidTaskSpec("task specification is not JSON") from None
    if not isinstance(spec, dict):
        raise InvalidTaskSpec("task specification must be an object")
    if spec.get("version") != 1 or isinstance(spec.get("version"), bool):
        raise InvalidTaskSpec("task specification must have version 1")
    name = spec.get("task", task)
    if name not in TASKS:
        raise InvalidTaskSpec("task specification names no known task")
    kind, fields = TASKS[name]
    if missing := [f for f in fields if f not in spec]:
        raise InvalidTaskSpec(f"task specification lacks {', '.join(missing)}")
    aliases = spec.get("concept_aliases") or spec.get("idea_aliases") or spec.get("item_aliases")
    if aliases is not None and not (isinstance(aliases, dict) and all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in aliases.values())):
        raise InvalidTaskSpec("aliases must be lists of texts by key")
    groups = {f: spec.get(f) for f in ("entity_groups", "action_groups")}
    if any(g is not None and not (isinstance(g, dict) and all(isinstance(v, list) for v in g.values())) for g in groups.values()):
        raise InvalidTaskSpec("groups must be lists of keys by name")
    parts = spec.get("subcategories")
    if parts is not None and not isinstance(parts, dict):
        raise InvalidTaskSpec("subcategories must be an object")
    # Written by category as lists of keys, or by key as its category.
    categories = {k: c for c, ks in (parts or {}).items() for k in (ks if isinstance(ks, list) else [c])} if parts and any(isinstance(v, list) for v in parts.values()) else parts
    return TaskSpec(kind, aliases, **groups, initials=tuple(spec.get("initials", ())), exclusions=tuple(spec.get("exclusions", ())), categories=categories)


def read(spark: SparkSession, path: str, task: str | None = None) -> TaskSpec:
    """The specification in the file at ``path``."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise InvalidTaskSpec("a task specification is one file")
    return parse(rows[0].value, task)


def digest(text: str) -> str:
    """SHA-256 of a specification's canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
