"""Workstream rules: exact overrides, then the first pattern that matches."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule file that cannot be used."""


def parse_rules(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(overrides, rules) of a TOML text; unknown keys and a star anywhere but at the end are errors."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise RuleError(str(e)) from e
    out = []
    for table, subject in (("override", "workspace"), ("rule", "match")):
        rows = []
        for entry in doc.pop(table, []):
            if not isinstance(entry, dict) or set(entry) != {subject, "workstream"} or not all(isinstance(v, str) for v in entry.values()):
                raise RuleError(f"a {table} has exactly the texts {subject} and workstream")
            if table == "rule" and "*" in entry[subject][:-1]:
                raise RuleError(f"a star may only end a pattern: {entry[subject]}")
            rows.append((entry[subject], entry["workstream"]))
        out.append(rows)
    if doc:
        raise RuleError(f"unknown keys: {', '.join(sorted(doc))}")
    return out[0], out[1]


def load_rules(path: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Rules of a file; an absent file has none."""
    if not os.path.exists(path):
        return [], []
    with open(path, encoding="utf-8") as f:
        return parse_rules(f.read())


def workstream(repository: Column, overrides: list[tuple[str, str]], rules: list[tuple[str, str]]) -> Column:
    """The workstream of a repository, null where no rule applies."""
    tests = [(repository == name, ws) for name, ws in overrides]
    tests += [(repository.startswith(m[:-1]) if m.endswith("*") else repository == m, ws) for m, ws in rules]
    out = F.lit(None).cast("string")
    for test, ws in reversed(tests):
        out = F.when(test, F.lit(ws)).otherwise(out)
    return out
