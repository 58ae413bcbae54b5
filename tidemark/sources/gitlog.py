"""Commit logs of repositories as a data source: one task per repository, bounded in time, commits and bytes."""

from __future__ import annotations

import json
import os
import signal
import subprocess
import threading
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.live import MOST_COMMITS, SINCE_DAYS, parse_log

#: Seconds any call may run, bytes of one log, and the references walked. A detached head is not walked.
SECONDS, BYTES = 20, 8 * 1024 * 1024
REFS = ("--branches", "--tags", "--remotes")
#: What a log prints of each commit, and that it is walked without merges, oldest first, addresses taken literally.
LOG = ("log", "--format=%H%x09%aI", "--shortstat", "--no-merges", "--reverse", "--fixed-strings")
#: Why a repository gave no commits.
OUTCOMES = ("missing", "not_a_repository", "no_commits_yet", "no_identity", "unreadable", "timed_out")
SCHEMA = "repository string, outcome string, truncated boolean, line_no bigint, line string"


class _Late(Exception):
    """A call took too long."""


def _git(path: str, args: list[str], seconds: float, most: int = BYTES) -> tuple[int, bytes, bool]:
    """(exit code, at most ``most`` bytes of output, whether there was more) of a call that asks nobody for anything."""
    env = {**os.environ, "LC_ALL": "C", "GIT_TERMINAL_PROMPT": "0", "GIT_OPTIONAL_LOCKS": "0"}
    with subprocess.Popen(["git", "-C", path, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, stdin=subprocess.DEVNULL, env=env, start_new_session=True) as p:
        late = threading.Event()
        end = lambda: os.killpg(p.pid, signal.SIGKILL)  # noqa: E731  # what the call started holds its output open too
        timer = threading.Timer(seconds, lambda: (late.set(), end()))
        timer.start()
        try:
            out = p.stdout.read(most + 1)
            if len(out) > most:
                end()
            code = p.wait()
        finally:
            timer.cancel()
        if late.is_set():
            raise _Late
        return code, out[:most], len(out) > most


def scan(repository: str, path: str | None, days: int, most: int, seconds: float) -> tuple[str, bool, list[str]]:
    """(outcome, truncated, log lines) of one repository; the outcome is ``collected`` or the first of OUTCOMES that holds.

    The log has no merges, only commits by the addresses configured for the repository, not older than ``days``, and one commit
    more than ``most``, oldest first, so that a longer history can be told from one of exactly that length.
    """
    if path is None or not os.path.exists(path):
        return "missing", False, []
    try:
        head, _, _ = _git(path, ["rev-parse", "--quiet", "--verify", "HEAD"], seconds)
        if head:
            return ("no_commits_yet" if head == 1 else "not_a_repository"), False, []
        code, out, _ = _git(path, ["config", "--get-all", "user.email"], seconds)
        if code not in (0, 1):
            return "unreadable", False, []
        emails = list(dict.fromkeys(x.strip() for x in out.decode("utf-8", "replace").splitlines() if x.strip()))
        if not emails:
            return "no_identity", False, []
        bounds = [f"--since={days}.days.ago", f"--max-count={most + 1}"]
        code, out, cut = _git(path, [*LOG, *bounds, *REFS, *[f"--author=<{e}>" for e in emails]], seconds)
    except _Late:
        return "timed_out", False, []
    except OSError:
        return "unreadable", False, []
    if code and not cut:
        return "unreadable", False, []
    lines = out.decode("utf-8", "replace").split("\n")
    return "collected", cut, lines[:-1] if cut else lines


class _Repository(InputPartition):
    def __init__(self, name: str, path: str | None):
        self.name, self.path = name, path


class GitLogReader(DataSourceReader):
    """One partition per repository of the option ``repositories``, a JSON object of names and directories."""

    def __init__(self, options: dict):
        self.repositories = json.loads(options.get("repositories", "{}"))
        self.days, self.most = int(options.get("days", SINCE_DAYS)), int(options.get("most", MOST_COMMITS))
        self.seconds = float(options.get("seconds", SECONDS))

    def partitions(self) -> list[InputPartition]:
        return [_Repository(n, p) for n, p in sorted(self.repositories.items())]

    def read(self, partition: _Repository) -> Iterator[tuple]:
        outcome, cut, lines = scan(partition.name, partition.path, self.days, self.most, self.seconds)
        yield partition.name, outcome, cut, 0, ""
        for i, line in enumerate(lines, 1):
            yield partition.name, outcome, cut, i, line


class GitLog(DataSource):
    """``spark.read.format("tidemark_gitlog")``: the raw log lines of repositories with each scan's outcome; line 0 is always there."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


def read_logs(spark: SparkSession, repositories: dict[str, str | None], **limits: float) -> DataFrame:
    """The log lines of named repositories; ``limits`` are days, most and seconds."""
    spark.dataSource.register(GitLog)
    return spark.read.format("tidemark_gitlog").options(repositories=json.dumps(repositories), **{k: str(v) for k, v in limits.items()}).load()


def commits_of(lines: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """``repository, commit, author_time, files_changed, insertions, deletions`` of log lines, the oldest above ``most`` left out."""
    parsed = parse_log(lines.where((F.col("outcome") == "collected") & (F.col("line_no") > 0)))
    # One commit more than the ceiling was asked for; the log is bounded, so a repository's commits are few.
    newest = F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("author_time"), "commit"))
    return parsed.withColumn("__r", newest).where(F.col("__r") <= most).drop("__r")


def scan_report(lines: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """``repository, outcome, commits, truncated`` of every scan."""
    header: Column = F.col("line").rlike(r"^[0-9a-f]{40}\t")
    per = lines.groupBy("repository", "outcome").agg(F.count_if(header).alias("seen"), F.max("truncated").alias("cut"))
    return per.select("repository", "outcome", F.least("seen", F.lit(most)).alias("commits"), (F.col("cut") | (F.col("seen") > most)).alias("truncated"))
