"""Scalar rules of normalisation: pseudonyms, buckets, families, workspaces, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import EVENT_FORM

#: Tool names of each vendor and their family.
CLAUDE_TOOLS = {"Bash": "shell", "Shell": "shell", "Edit": "edit", "Write": "edit", "MultiEdit": "edit", "Read": "read",
                "Grep": "search", "Glob": "search", "WebFetch": "web", "WebSearch": "web"}
CODEX_TOOLS = {"shell": "shell", "local_shell": "shell", "exec_command": "shell", "unified_exec": "shell", "apply_patch": "edit",
               "view_image": "read", "web_search": "web"}
HOME = "/home/dev"


def pseudonym(prefix: str, value: Column) -> Column:
    """``prefix_`` and the first 20 hex digits of the value's SHA-256; null for null."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(value, 256), 1, 20))


def count_bucket(n: Column) -> Column:
    """Size class of a count; null stays null, 0 is a measurement, negative numbers are none."""
    out = F.when(n == 0, "0")
    for top, name in ((10, "1-9"), (100, "10-99"), (1_000, "100-999"), (10_000, "1000-9999")):
        out = out.when((n > 0) & (n < top), name)
    return out.when(n >= 10_000, "10000+")


def tool_family(name: Column, table: dict[str, str]) -> Column:
    """Family of a tool name; ``mcp__`` names are mcp, unknown and null names other."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(known[name], F.when(name.startswith("mcp__"), "mcp"), F.lit("other"))


def resolve_cwd(cwd: Column, home: str = HOME) -> tuple[Column, Column]:
    """(repository, workspace) of a working directory below ``<home>/ghq/``, else nulls."""
    base = home.rstrip("/") + "/ghq/"
    rest = F.when(cwd.startswith(base), F.substring(cwd, len(base) + 1, 1_000_000))
    parts = F.filter(F.split(rest, "/"), lambda x: x != "")
    repository = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "/"))
    branch = F.when((F.get(parts, F.lit(3)) == ".worktrees") & (F.size(parts) >= 5), F.get(parts, F.lit(4)))
    return repository, F.when(branch.isNotNull(), F.concat_ws("@", repository, branch)).otherwise(repository)


def repository_path(repository: Column, home: str = HOME) -> Column:
    """Directory of a repository of exactly three safe segments, else null."""
    safe = repository.rlike(r"^[^/]+/[^/]+/[^/]+$") & ~repository.rlike(r"(^|/)\.{1,2}(/|$)")
    return F.when(safe, F.concat(F.lit(home.rstrip("/") + "/ghq/"), repository))


def session_ref(subject: Column) -> Column:
    """The session named by a subject, else null."""
    return F.nullif(F.regexp_extract(subject, r"^session/([^/]*)", 1), F.lit(""))


def short_event(event_type: Column, namespace: str | None = None) -> Column:
    """The short name of a full event type, of one namespace or of any; empty for any other text."""
    form = EVENT_FORM if namespace is None else EVENT_FORM.replace("[a-z]+", re.escape(namespace))
    return F.regexp_extract(event_type, form, 1)


def plausible_label(label: Column) -> Column:
    """The label if it is 1 to 64 of ``[A-Za-z0-9_:-]``, else null."""
    return F.when(label.rlike(r"^[A-Za-z0-9_:-]{1,64}$"), label)


def end_reason(reason: Column) -> Column:
    """A known reason a session ended, else unknown."""
    return F.when(reason.isin("completed", "aborted", "timeout", "crash"), reason).otherwise("unknown")


def record_kind(outer: Column, inner: Column) -> Column:
    """Kind of a rollout record: the type, with the payload's type for messages and items."""
    nested = outer.isin("event_msg", "response_item")
    return F.when(nested, F.concat(outer, F.lit(":"), F.coalesce(inner, F.lit("")))).otherwise(F.coalesce(outer, F.lit("")))


def dedupe_key(*parts: Column) -> Column:
    """Parts joined by bars, absent parts left out."""
    return F.concat_ws("|", *parts)


def variant_string(v: Column, path: str) -> Column:
    """A variant's string at a path; null where the value is absent or of any other type."""
    held = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(v, path, "string"))


def variant_present(v: Column, path: str) -> Column:
    """Whether a path exists and holds something other than null."""
    held = F.try_variant_get(v, path, "variant")
    return held.isNotNull() & ~F.is_variant_null(held)


def variant_integer(v: Column, path: str) -> Column:
    """A variant's whole number at a path; null for any other type."""
    held = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(held) == "BIGINT", F.try_variant_get(v, path, "bigint"))
