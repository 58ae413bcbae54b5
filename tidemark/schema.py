"""Constants and names of the observation model."""

from __future__ import annotations

#: Seconds before and after a prompt that count as attention, and the largest gap inside a cluster.
BEFORE, AFTER = 60, 300
CLUSTER_GAP = 300
DAY = 86_400
#: Fixed value: quartiles are only given from this many measurements on.
LEAST_MEASURED = 12
#: Strip bucket widths in seconds, narrowest first, and the width of a line.
LADDER = (600, 900, 1200, 1800, 3600)
LINE = 100

#: Short event names used by the operators.
PROMPT, RESPONSE = "prompt.submitted", "response.completed"
SESSION_STARTED = "session.started"
TOOL_STARTED, TOOL_FINISHED = "tool.started", "tool.finished"
COMMIT, GAP = "commit.observed", "source.gap"
#: Time bases that say when a thing happened (absent counts too).
LIVE_BASES = ("occurred_at", "received_at")
#: Prompt origins that open no attention window.
DENIED_ORIGINS = ("subagent", "scheduled")
#: Tool families and short event names.
FAMILIES = ("shell", "edit", "read", "search", "web", "mcp", "other")
EVENT_TYPES = (
    SESSION_STARTED, "session.ended", PROMPT, RESPONSE, TOOL_STARTED, TOOL_FINISHED, "turn.completed", COMMIT, GAP,
    "approval.requested", "approval.resolved", "command.finished", "device.active", "source.duplicate",
)

#: Fixed value: the form of a full event type of any namespace; the group is its short name.
EVENT_FORM = r"^dev\.[a-z]+\.(.+)\.v1$"


def event_name(short: str, namespace: str) -> str:
    """The full event type of a short name."""
    return f"dev.{namespace}.{short}.v1"
