"""Queries of whole-file facts, cursors, labels and single periods, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.plans import attention as A
from tidemark.plans import ingest as I
from tidemark.plans import params
from tidemark.plans import report as R
from tidemark.functions.timecols import epoch_seconds
from tidemark.sources import files, ledger, rollouts, snapshots, transcripts
from tidemark.sources.events import EVENTS_SQL, events_as_observations
from tidemark.scratch import Scratch
from tidemark.tables import table

MONTH = params.month("2024-01")


def tool_start_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Family and start time of every tool use of a transcript file; the last line wins."""
    return transcripts.tool_starts(table(spark, d, "transcripts"))


def rollout_file_facts(spark: SparkSession, d: str) -> DataFrame:
    """Session, repository and workspace of every rollout file."""
    facts = rollouts.file_facts(rollouts.with_fields(table(spark, d, "rollouts")))
    return facts.select(F.col("f_file").alias("file_ref"), "file_session", "file_repository", "file_workspace")


def rollout_call_starts(spark: SparkSession, d: str) -> DataFrame:
    """Call reference and family under both spellings of a call."""
    return rollouts.call_starts(rollouts.with_fields(table(spark, d, "rollouts"))).select(
        F.col("c_file").alias("file_ref"), F.col("c_key").alias("key"), "tool", F.col("start_family").alias("family")
    )


def latest_lines(spark: SparkSession, d: str) -> DataFrame:
    """The newest line of every meta file by line id."""
    lines = table(spark, d, "meta_lines").select(F.col("file_ref").alias("locator"), F.col("line_id").alias("snapshot_id"), "vendor", "line_no")
    return files.latest(lines)


def next_cursors(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints after all meta lines up to the middle id and then all others were written."""
    lines = table(spark, d, "meta_lines").select(F.col("file_ref").alias("locator"), F.col("line_id").alias("snapshot_id"), F.col("line_no").alias("cursor"))
    early = F.col("snapshot_id") % 2 == 0
    return files.advance(lines.where(early), lines.where(~early))


def repository_labels(spark: SparkSession, d: str) -> DataFrame:
    """The shortest path suffix of every repository that no other repository shares, as a distributed count of suffixes."""
    names = table(spark, d, "block_parts").where("repository is not null").select("repository").distinct()
    parts = F.split("repository", "/")
    sizes = F.sequence(F.lit(1), F.size(parts))
    suffixes = names.select("repository", F.explode(F.transform(sizes, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, -n, n), "/").alias("s")))).alias("x"))
    alone = suffixes.groupBy("x.s").agg(F.count(F.lit(1)).alias("k")).where("k = 1")
    best = suffixes.select("repository", "x.n", "x.s").join(alone, "s").groupBy("repository").agg(F.min(F.struct("n", "s")).alias("b"))
    return names.join(best, "repository", "left").select("repository", F.coalesce("b.s", "repository").alias("label"))


def repository_paths(spark: SparkSession, d: str) -> DataFrame:
    """Directory of every repository of block_parts."""
    return table(spark, d, "block_parts").select("part_id", S.repository_path(F.col("repository")).alias("path"))


def report_month(spark: SparkSession, d: str) -> DataFrame:
    """Repository rows of one month, computed over its own observations."""
    start, end = MONTH.utc_window(A.OFFSET)
    return R.repository_rows(R.routed(R.within(events_as_observations(spark, d), start, end)))


def report_averages(spark: SparkSession, d: str) -> DataFrame:
    """Attention per calendar day of a month and per active day."""
    start, end = MONTH.utc_window(A.OFFSET)
    rows = R.routed(R.within(events_as_observations(spark, d), start, end))
    whole = R.totals(rows, A.OFFSET).where("metric = 'attention_union_seconds'").select(F.col("value").alias("total"))
    days = R.coverage(rows, A.OFFSET).select("active_days").scalar()
    return whole.select(
        "total", F.floor(F.col("total") / F.lit(MONTH.days)).cast("bigint").alias("per_day"),
        F.when(days > 0, F.floor(F.col("total") / days).cast("bigint")).alias("per_active_day"),
    )


def observation_activity(spark: SparkSession, d: str) -> DataFrame:
    """Observations and prompts per repository and integrity state, null repositories kept apart."""
    prompt = S.short_event(F.col("event_type")) == "prompt.submitted"
    return table(spark, d, "observations").groupBy("repository_ref", "integrity_state").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(prompt).alias("prompts"), F.count_distinct("subject").alias("subjects")
    )


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The meta lines as snapshots of their files."""
    lines = table(spark, d, "meta_lines")
    return lines.select(F.col("line_id").alias("snapshot_id"), F.col("vendor").alias("kind"), F.col("file_ref").alias("locator"), F.col("received_at").alias("acquired_at"))


def _observed(spark: SparkSession, d: str) -> DataFrame:
    obs = table(spark, d, "observations")
    return obs.select("row_id", F.col("row_id").alias("snapshot_id"), S.short_event(F.col("event_type")).alias("event_type"), F.col("obs_time").alias("occurred_at"), "obs_id", "dedupe_key")


def snapshots_found(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of one vendor below a prefix, acquired in a span of time."""
    at = lambda t: F.lit(t).cast("timestamp")
    return snapshots.find(_snapshots(spark, d), "codex", "raw_", at("2023-03-01T00:00:00Z"), at("2023-12-01T00:00:00Z")).select("snapshot_id", "locator")


def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots and files of each kind."""
    return snapshots.counts(_snapshots(spark, d))


def snapshot_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations with the kind and file of their snapshot."""
    return snapshots.with_snapshot(_observed(spark, d), _snapshots(spark, d)).select("row_id", "snapshot_kind", "locator")


def capture_range(spark: SparkSession, d: str) -> DataFrame:
    """First and last time text observed through one kind of snapshot."""
    return snapshots.channel_range(_observed(spark, d), _snapshots(spark, d), "codex")


def observed_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether any source was observed in the month of the report, and in a year before all of them."""
    ranges = I.source_ranges(spark, d)
    seen = lambda first, last, name: snapshots.within_observed_range(ranges, first, last, epoch_seconds).select(F.lit(name).alias("period"), "within")
    start, end = MONTH.utc_window(A.OFFSET)
    return seen(start, end, MONTH.label).unionByName(seen(0, 365 * 86_400, "1970"))


def keys_present(spark: SparkSession, d: str) -> DataFrame:
    """Which dedupe keys of the observations a ledger of the first-person profile holds, and under which id."""
    obs = table(spark, d, "observations").where("dedupe_key is not null")
    return snapshots.present(obs, obs.where("profile = 'client'"))


def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stand for several dedupe keys; the subjects stand in for ids."""
    obs = table(spark, d, "observations")
    return snapshots.id_collisions(obs.select(F.col("subject").alias("obs_id"), "dedupe_key"), obs.where("profile = 'client'").select(F.col("subject").alias("obs_id"), "dedupe_key"))


def identity_registry(spark: SparkSession, d: str) -> DataFrame:
    """Repositories not seen through one profile yet, with the display of their first sighting."""
    seen = table(spark, d, "observations").where("repository_ref is not null")
    refs = seen.select(F.sha2("repository_ref", 256).alias("ref"), F.col("repository_ref").alias("display"), F.col("observed_at").alias("first_seen"), "profile")
    known = refs.where("profile = 'client'").select("ref").distinct()
    return ledger.register_identities(known, refs.drop("profile")).select("ref", "display")


def identity_displays(spark: SparkSession, d: str) -> DataFrame:
    """Number of observations per repository, by its registered display or else its own reference."""
    obs = table(spark, d, "observations").withColumn("ref", F.sha2("repository_ref", 256))
    return ledger.with_display(obs, identity_registry(spark, d), "ref", "name").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def legacy_rows(spark: SparkSession, d: str) -> DataFrame:
    """Meta lines of a legacy table the ledger does not know yet, by file and line; those of one vendor are known."""
    lines = table(spark, d, "meta_lines")
    return ledger.new_rows_only(lines, lines.where("vendor = 'codex'"), ["file_ref", "line_no"]).select("line_id")


def _raw_files(spark: SparkSession, d: str) -> str:
    """The meta lines written as raw files, a folder per vendor, in the shared folder; returns its root."""
    lines = table(spark, d, "meta_lines").where("body is not null").select(F.col("vendor").alias("kind"), F.col("body").alias("value"))
    return Scratch(spark).text(lines, "raw", ["kind"])


def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the raw files of each vendor, and whether each object is what its id names, after discovery and archiving."""
    root = _raw_files(spark, d)
    found = files.discover(spark, {k: f"{root}/kind={k}" for k in ("codex", "claude-code", "absent")}, "*.txt")
    none = spark.createDataFrame([], "locator string, object_id string, content binary")
    objects, fresh, _ = files.archive(found, none.select("object_id", "content"), none.select("locator", "object_id"))
    held = snapshots.read_objects(fresh, objects)
    return held.groupBy("kind").agg(F.sum(F.octet_length("content")).cast("bigint").alias("bytes"), F.min("intact").alias("intact"))


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Number and length of the lines of the raw files of each vendor, read by splits and numbered, and the lines whose number repeats (none)."""
    lines = files.numbered_lines(spark, _raw_files(spark, d), "*.txt").withColumn("kind", F.regexp_extract("locator", "kind=([^/]+)", 1))
    per_file = lines.groupBy("kind", "locator").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"), F.count_distinct("line_no").alias("numbers"), F.sum(F.octet_length("line")).alias("b"))
    odd = F.when((F.col("n") != F.col("last")) | (F.col("n") != F.col("numbers")), 1).otherwise(0)
    return per_file.groupBy("kind").agg(F.sum("n").alias("n_lines"), F.sum("b").cast("bigint").alias("bytes"), F.sum(odd).cast("bigint").alias("odd_files"))


QUERIES = {
    f.__name__: f
    for f in (
        tool_start_lookup, rollout_file_facts, rollout_call_starts, latest_lines, next_cursors, repository_labels, repository_paths, report_month,
        report_averages, observation_activity, snapshots_found, snapshot_counts, snapshot_observations, capture_range, observed_within, keys_present, id_collisions,
        identity_registry, identity_displays, legacy_rows, discovered_files, file_lines,
    )
}

_START, _END = MONTH.utc_window(A.OFFSET)
_MONTH_SQL = EVENTS_SQL.replace("FROM obs)", f"FROM obs WHERE instant >= {_START} AND instant < {_END})")
_MAPPED = ", ".join(repr(k) for k in rollouts.MAPPED)

SQL = {
    "tool_start_lookup": I._TRANSCRIPTS[: I._TRANSCRIPTS.index("res AS (")].rstrip().rstrip(",")
    + """ SELECT s.file_ref, s.id AS tool_use_id, s.family AS start_family, l.ts_raw AS started_at FROM starts s
      JOIN (SELECT file_ref, id, arg_max({'t': ts_raw}, (row_id, pos)).t AS ts_raw FROM uses GROUP BY file_ref, id) l USING (file_ref, id)""",
    "rollout_file_facts": I._ROLLOUTS[: I._ROLLOUTS.index("calls AS (")].rstrip().rstrip(",")
    + " SELECT file_ref, fs.v AS file_session, place.r AS file_repository, place.w AS file_workspace FROM files",
    "rollout_call_starts": I._ROLLOUTS[: I._ROLLOUTS.index("begun AS (")].rstrip().rstrip(",") + " SELECT file_ref, k AS key, s.t AS tool, s.f AS family FROM calls",
    "latest_lines": """SELECT file_ref AS locator, max(line_id) AS snapshot_id, arg_max(vendor, line_id) AS vendor, arg_max(line_no, line_id) AS line_no
        FROM meta_lines GROUP BY file_ref""",
    "next_cursors": "SELECT file_ref AS locator, max(line_id) AS snapshot_id, arg_max(line_no, line_id) AS cursor FROM meta_lines GROUP BY file_ref",
    "repository_labels": """WITH n AS (SELECT DISTINCT repository, string_split(repository, '/') AS p FROM block_parts WHERE repository IS NOT NULL),
        s AS (SELECT repository, i, array_to_string(p[len(p) - i + 1:], '/') AS s FROM n, unnest(range(1, len(p) + 1)) AS t(i)),
        a AS (SELECT s FROM s GROUP BY s HAVING count(*) = 1), b AS (SELECT repository, arg_min(s, i) AS label FROM s WHERE s IN (SELECT s FROM a) GROUP BY repository)
        SELECT n.repository, coalesce(b.label, n.repository) AS label FROM n LEFT JOIN b USING (repository)""",
    "repository_paths": """SELECT part_id, CASE WHEN regexp_matches(repository, '^[^/]+/[^/]+/[^/]+$') AND NOT regexp_matches(repository, '(^|/)\\.{1,2}(/|$)')
        THEN '/home/dev/ghq/' || repository END AS path FROM block_parts""",
    "report_month": A._REPOSITORY.replace(EVENTS_SQL, _MONTH_SQL) + " SELECT * FROM repositories",
    "report_averages": A._ANCHORS.replace(EVENTS_SQL, _MONTH_SQL) + A._islands("w", "anchors", "", 360, 60, 300)
    + f""", t AS (SELECT CAST(coalesce(sum(to_s - from_s), 0) AS BIGINT) AS total FROM w),
      d AS (SELECT count(DISTINCT (instant + {A.OFFSET}) // 86400) AS n_day FROM live)
      SELECT total, total // {MONTH.days} AS per_day, CASE WHEN n_day > 0 THEN total // n_day END AS per_active_day FROM t, d""",
    "observation_activity": f"""SELECT repository_ref, integrity_state, count(*) AS observations,
        count(*) FILTER ({I._SHORT} = 'prompt.submitted') AS prompts, count(DISTINCT subject) AS subjects FROM observations GROUP BY ALL""",
    "import_outcomes": f"""WITH dr AS ({I._ROLLOUTS}), r AS (SELECT *, CASE WHEN rec_type IN ('event_msg','response_item') THEN rec_type || ':' || coalesce(payload_type, '') ELSE coalesce(rec_type, '') END AS kind FROM rollouts),
        f AS (SELECT file_ref, arg_min({{'v': coalesce({I._STR('session_id')}, {I._STR('id')})}}, (line_no, row_id)) FILTER (kind = 'session_meta') AS fs FROM r GROUP BY file_ref),
        o AS (SELECT CASE WHEN r.row_id IN (SELECT row_id FROM dr) THEN 'drafts' WHEN kind NOT IN ({_MAPPED}) THEN 'unmapped_kind'
            WHEN ts_raw IS NULL OR payload_json IS NULL OR coalesce({I._STR('session_id')}, f.fs.v) IS NULL THEN 'missing_field' ELSE 'skipped' END AS outcome, kind, ts_raw, payload_json FROM r LEFT JOIN f USING (file_ref))
        SELECT outcome, CASE outcome WHEN 'unmapped_kind' THEN CASE WHEN regexp_matches(kind, '^[A-Za-z0-9_:-]{{1,64}}$') THEN kind END
            WHEN 'missing_field' THEN CASE WHEN ts_raw IS NULL THEN 'timestamp' WHEN payload_json IS NULL THEN 'payload' ELSE 'session_id' END END AS detail, count(*) AS n FROM o GROUP BY ALL""",
    "snapshots_found": """SELECT line_id AS snapshot_id, file_ref AS locator FROM meta_lines WHERE vendor = 'codex' AND starts_with(file_ref, 'raw_')
        AND received_at >= TIMESTAMPTZ '2023-03-01 00:00:00+00' AND received_at < TIMESTAMPTZ '2023-12-01 00:00:00+00'""",
    "snapshot_counts": "SELECT vendor AS kind, count(*) AS snapshots, count(DISTINCT file_ref) AS locators FROM meta_lines GROUP BY vendor",
    "snapshot_observations": "SELECT row_id, vendor AS snapshot_kind, file_ref AS locator FROM observations JOIN meta_lines ON line_id = row_id",
    "capture_range": f"""SELECT min(obs_time) AS earliest, max(obs_time) AS latest FROM observations JOIN meta_lines ON line_id = row_id
        WHERE vendor = 'codex' AND {I._SHORT} <> 'source.gap' AND event_type <> 'source.gap' HAVING min(obs_time) IS NOT NULL""",
    "observed_within": f"""WITH m AS (SELECT row_id, ms FROM {I._times('observations', 'row_id', 'obs_time')}), r AS (SELECT source_kind, min(obs_time) AS lo, max(obs_time) AS hi FROM observations WHERE {I._SHORT} <> 'source.gap' GROUP BY source_kind),
        s AS (SELECT r.source_kind, (SELECT max(ms) FROM m JOIN observations o USING (row_id) WHERE o.obs_time = r.lo) AS lo, (SELECT max(ms) FROM m JOIN observations o USING (row_id) WHERE o.obs_time = r.hi) AS hi FROM r),
        p(period, a, b) AS (VALUES ('{MONTH.label}', {_START}, {_END}), ('1970', 0, {365 * 86_400}))
        SELECT period, coalesce(bool_or(floor(lo / 1000.0) < b AND floor(hi / 1000.0) >= a), false) AS within FROM p, s GROUP BY period""",
    "keys_present": """WITH l AS (SELECT dedupe_key, min(obs_id) AS obs_id FROM observations WHERE profile = 'client' AND dedupe_key IS NOT NULL GROUP BY dedupe_key)
        SELECT DISTINCT o.dedupe_key, l.dedupe_key IS NOT NULL AS present, l.obs_id FROM observations o LEFT JOIN l ON l.dedupe_key = o.dedupe_key WHERE o.dedupe_key IS NOT NULL""",
    "id_collisions": "SELECT subject AS obs_id, count(DISTINCT dedupe_key) AS keys FROM observations WHERE subject IS NOT NULL GROUP BY subject HAVING count(DISTINCT dedupe_key) > 1",
    "identity_registry": """SELECT DISTINCT sha256(repository_ref) AS ref, repository_ref AS display FROM observations WHERE repository_ref IS NOT NULL
        AND repository_ref NOT IN (SELECT repository_ref FROM observations WHERE profile = 'client' AND repository_ref IS NOT NULL)""",
    "identity_displays": """WITH k AS (SELECT repository_ref FROM observations WHERE profile = 'client' AND repository_ref IS NOT NULL)
        SELECT CASE WHEN repository_ref IN (FROM k) THEN sha256(repository_ref) ELSE repository_ref END AS name, count(*) AS n FROM observations GROUP BY 1""",
    "legacy_rows": """SELECT line_id FROM meta_lines a WHERE NOT EXISTS (FROM meta_lines b WHERE b.vendor = 'codex' AND b.file_ref = a.file_ref AND b.line_no = a.line_no)""",
    "discovered_files": "SELECT vendor AS kind, CAST(sum(strlen(body) + 1) AS BIGINT) AS bytes, true AS intact FROM meta_lines WHERE body IS NOT NULL AND vendor IN ('codex', 'claude-code') GROUP BY vendor",
    "file_lines": "SELECT vendor AS kind, count(*) AS n_lines, CAST(sum(strlen(body)) AS BIGINT) AS bytes, 0::BIGINT AS odd_files FROM meta_lines WHERE body IS NOT NULL GROUP BY vendor",
}
