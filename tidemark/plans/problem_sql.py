"""SQL of the general data problems, written from their statements and not from the operators."""

from __future__ import annotations


def uuid_text(column: str) -> str:
    """SQL of the one writing of a UUID; any other text stays as it is."""
    parts = "([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})"
    form = r"^(?:urn:uuid:)?\{?" + parts + r"\}?$"
    return rf"CASE WHEN regexp_matches(lower({column}), '{form}') THEN regexp_replace(lower({column}), '{form}', '\1-\2-\3-\4-\5') ELSE {column} END"


KEPT_TRANSCRIPTS = f"""t0 AS (SELECT *, {uuid_text('session_id')} AS s, {uuid_text('rec_uuid')} AS u FROM transcripts),
  kept AS (SELECT * FROM t0 QUALIFY s IS NULL OR u IS NULL OR row_number() OVER (PARTITION BY s, u ORDER BY row_id) = 1)"""

#: Minutes east of UTC of the zone names in use, by the region of the device where a name is shared.
_ABBREVIATIONS = """abbreviation(a, region, minutes) AS (VALUES ('CET','',60),('CEST','',120),('EET','',120),('EEST','',180),('WET','',0),('WEST','',60),('MSK','',180),
  ('JST','',540),('KST','',540),('HKT','',480),('SGT','',480),('AEST','',600),('AEDT','',660),('NZST','',720),('NZDT','',780),('BRT','',-180),('PDT','',-420),('MDT','',-360),
  ('PST','America',-480),('MST','America',-420),('CST','America',-360),('CST','Asia',480),('CDT','America',-300),('EST','America',-300),('EST','Australia',600),('EDT','America',-240),
  ('EDT','Australia',660),('BST','Europe',60),('BST','Asia',360),('IST','Asia',330),('IST','Europe',60),('SAST','',120))"""

#: Views ``texts(src_table, row_id, x, tz)`` to ``instants(src_table, row_id, us)``.
INSTANTS = (
    _ABBREVIATIONS
    + r""",
  cut AS (SELECT *, trim(x) AS y, regexp_extract(trim(x), '\d( ?(?:Z|z|[+-]\d\d(?::?\d\d)?|[A-Z]{2,5}|[A-Z][A-Za-z]+/[A-Za-z_/]+))?(?:\[([A-Za-z_/]+)\])?$', 1) AS zone,
      regexp_extract(trim(x), '\[([A-Za-z_/]+)\]$', 1) AS bracket FROM texts),
  body AS (SELECT *, CASE WHEN regexp_matches(y, ' [AaPp][Mm]$') THEN '' ELSE trim(zone) END AS z,
      CASE WHEN regexp_matches(y, ' [AaPp][Mm]$') THEN y ELSE substr(y, 1, length(y) - length(zone) - CASE WHEN bracket = '' THEN 0 ELSE length(bracket) + 2 END) END AS b FROM cut),
  frac AS (SELECT *, regexp_extract(b, '\d[.,](\d+)$', 1) AS f, upper(regexp_replace(b, '[.,]\d+$', '')) AS c FROM body WHERE NOT regexp_matches(y, '^[+-]?\d+(\.\d+)?$')),
  read AS (SELECT *, CASE
      WHEN regexp_matches(c, '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d$') THEN try_strptime(replace(c, 'T', ' '), '%Y-%m-%d %H:%M:%S')
      WHEN regexp_matches(c, '^\d{8}T\d{6}$') THEN try_strptime(c, '%Y%m%dT%H%M%S')
      WHEN regexp_matches(b, '^\d\d?\.\d\d?\.\d{4} \d\d?:\d\d:\d\d$') THEN try_strptime(b, '%d.%m.%Y %H:%M:%S')
      WHEN regexp_matches(c, '^\d\d?/[A-Z]{3}/\d{4}:\d\d:\d\d:\d\d$') THEN try_strptime(c, '%d/%b/%Y:%H:%M:%S')
      WHEN regexp_matches(c, '^([A-Z]{3}, )?\d\d? [A-Z]{3} \d{4} \d\d:\d\d:\d\d$') THEN try_strptime(regexp_replace(c, '^[A-Z]{3}, ', ''), '%d %b %Y %H:%M:%S')
      WHEN regexp_matches(c, '^[A-Z]{3} \d\d?, \d{4},? \d\d?:\d\d:\d\d [AP]M$') THEN try_strptime(replace(c, ',', ''), '%b %d %Y %I:%M:%S %p') END AS l FROM frac),
  zoned AS (SELECT r.*, epoch_us(l) + CASE WHEN f = '' THEN 0 ELSE CAST(rpad(substr(f, 1, 6), 6, '0') AS BIGINT) END AS lus,
      CASE WHEN z IN ('Z', 'z', 'UTC', 'GMT', 'UT') THEN 0 WHEN regexp_matches(z, '^[+-]') THEN
        CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (CAST(substr(replace(z, ':', ''), 2, 2) AS INT) * 60 + coalesce(TRY_CAST(substr(replace(z, ':', ''), 4, 2) AS INT), 0))
        ELSE coalesce(a1.minutes, a0.minutes) END AS off,
      CASE WHEN z = '' AND bracket = '' THEN tz WHEN z = '' THEN bracket WHEN z LIKE '%/%' THEN z END AS place FROM read r
    LEFT JOIN abbreviation a1 ON a1.a = z AND a1.region = split_part(tz, '/', 1) LEFT JOIN abbreviation a0 ON a0.a = z AND a0.region = '' WHERE l IS NOT NULL),
  around AS (SELECT *, epoch_us(l - INTERVAL 1 DAY) - epoch_us(timezone(place, l - INTERVAL 1 DAY)) AS o1, epoch_us(l + INTERVAL 1 DAY) - epoch_us(timezone(place, l + INTERVAL 1 DAY)) AS o2 FROM zoned),
  both_ways AS (SELECT *, lus - o1 AS c1, lus - o2 AS c2, epoch_us(timezone(place, make_timestamptz(epoch_us(l) - o1))) = epoch_us(l) AS ok1,
      epoch_us(timezone(place, make_timestamptz(epoch_us(l) - o2))) = epoch_us(l) AS ok2 FROM around),
  numbers AS (SELECT src_table, row_id, regexp_extract(y, '^([+-]?)', 1) AS sign, TRY_CAST(regexp_extract(y, '^[+-]?(\d+)', 1) AS HUGEINT) AS n,
      CAST(rpad(substr(regexp_extract(y, '\.(\d+)$', 1), 1, 6), 6, '0') AS BIGINT) AS f FROM body WHERE regexp_matches(y, '^[+-]?\d{1,19}(\.\d+)?$')),
  instants AS (SELECT src_table, row_id, CASE WHEN off IS NOT NULL THEN lus - CAST(off AS BIGINT) * 60000000 WHEN o1 = o2 OR (NOT ok1 AND NOT ok2) THEN c1
        WHEN ok1 AND ok2 THEN least(c1, c2) WHEN ok1 THEN c1 ELSE c2 END AS us FROM both_ways WHERE off IS NOT NULL OR place IS NOT NULL
    UNION ALL SELECT src_table, row_id, CAST(CASE WHEN sign = '-' THEN -1 ELSE 1 END * CASE WHEN n < 100000000000 THEN n * 1000000 + f WHEN n < 100000000000000 THEN n * 1000 + f // 1000
        WHEN n < 100000000000000000 THEN n ELSE n // 1000 END AS BIGINT) FROM numbers)"""
)
_DEVICE = "regexp_extract(source_uri, '^[a-z]+://device/([^/]+)', 1)"
P2 = (
    f"""WITH raw AS (SELECT 'transcripts' AS src_table, row_id, ts_raw AS x, device_ref AS d FROM transcripts UNION ALL SELECT 'rollouts', row_id, ts_raw, device_ref FROM rollouts
    UNION ALL SELECT 'observations', row_id, obs_time, {_DEVICE} FROM observations),
  texts AS (SELECT src_table, row_id, x, tz_name AS tz FROM raw LEFT JOIN devices ON d = device_ref
    WHERE NOT regexp_matches(x, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?Z$')), """
    + INSTANTS
    + " SELECT src_table, row_id, us AS epoch_us FROM instants WHERE us IS NOT NULL"
)
P5 = (
    f"""WITH k AS (SELECT row_id, source_kind, obs_time, {_DEVICE} AS d, regexp_extract(subject, '^session/([^/]+)', 1) AS session_ref FROM observations
    QUALIFY dedupe_key IS NULL OR row_number() OVER (PARTITION BY dedupe_key ORDER BY row_id) = 1),
  texts AS (SELECT 'observations' AS src_table, row_id, obs_time AS x, tz_name AS tz FROM k LEFT JOIN devices ON d = device_ref WHERE session_ref <> ''), """
    + INSTANTS
    + """, e AS (SELECT source_kind, session_ref, us FROM instants JOIN k USING (row_id) WHERE us IS NOT NULL),
  g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 300000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY source_kind, session_ref ORDER BY us)),
  n AS (SELECT *, sum(new) OVER (PARTITION BY source_kind, session_ref ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM g)
  SELECT source_kind, session_ref, min(us) AS start_us, max(us) AS end_us, count(*) AS event_count FROM n GROUP BY source_kind, session_ref, no"""
)


def blocks_of(json: str) -> str:
    """SQL of the list of positions of a content value: objects, and null where a position holds none."""
    text = f"({json}->>'$')"
    inner = f"CASE WHEN starts_with(ltrim({text}), '[') AND json_valid({text}) THEN from_json({text}::JSON, '[\"JSON\"]') END"
    plain = f"[json_object('type', 'text', 'text', {text})]"
    return f"""CASE json_type({json}) WHEN 'ARRAY' THEN from_json({json}, '["JSON"]') WHEN 'OBJECT' THEN [{json}]
      WHEN 'VARCHAR' THEN CASE WHEN {inner} IS NOT NULL AND list_bool_and(list_transform({inner}, lambda q: q IS NULL OR json_type(q) IN ('OBJECT', 'NULL'))) IS DISTINCT FROM false THEN {inner} ELSE {plain} END END"""


_TEXT_OF = lambda f: f"CASE json_type(b, '$.{f}') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN b->>'$.{f}' ELSE b->>'$.{f}' END"
P3 = f"""WITH RECURSIVE {KEPT_TRANSCRIPTS},
  top AS (SELECT row_id, s, CASE WHEN json_valid(content_json) THEN content_json::JSON END AS j FROM kept),
  n AS (SELECT row_id, s, '' AS base, j FROM top WHERE j IS NOT NULL
    UNION ALL SELECT row_id, s, base || CASE WHEN base = '' THEN '' ELSE '.' END || (p - 1), b->'$.content' FROM (SELECT row_id, s, base, unnest(l) AS b, generate_subscripts(l, 1) AS p
      FROM (SELECT row_id, s, base, {blocks_of('j')} AS l FROM n)) WHERE json_type(b) = 'OBJECT' AND json_type(b, '$.content') <> 'NULL'),
  blocks AS (SELECT row_id, s, base || CASE WHEN base = '' THEN '' ELSE '.' END || (p - 1) AS path, b FROM (SELECT row_id, s, base, unnest(l) AS b, generate_subscripts(l, 1) AS p
      FROM (SELECT row_id, s, base, {blocks_of('j')} AS l FROM n)) WHERE json_type(b) = 'OBJECT'),
  e AS (SELECT row_id, s, path, {_TEXT_OF('type')} AS kind, {_TEXT_OF('id')} AS id, {_TEXT_OF('tool_use_id')} AS use FROM blocks),
  uses AS (SELECT s, id, row_id, path FROM e WHERE kind = 'tool_use' AND id IS NOT NULL AND s IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY s, id ORDER BY row_id, list_transform(string_split(path, '.'), lambda q: q::INT)) = 1)
  SELECT e.row_id, e.path AS block_path, coalesce(e.kind, '') AS block_type, coalesce(v.row_id, -1) AS use_row_id, coalesce(v.path, '') AS use_path
  FROM e LEFT JOIN uses v ON e.kind = 'tool_result' AND v.s = e.s AND v.id = e.use"""

#: View ``leaf(line_id, vendor, ver, path, kind, val)``: the leaves of every readable record.
_LEAVES = r"""WITH r AS (SELECT line_id, vendor, CASE WHEN json_valid(body) THEN CASE vendor WHEN 'codex' THEN body::JSON->'$.payload' WHEN 'claude-code' THEN body::JSON END END AS rec,
    CASE vendor WHEN 'codex' THEN 'cli_version' ELSE 'version' END AS vf FROM meta_lines),
  v AS (SELECT line_id, vendor, vf, rec, CASE WHEN json_type(rec->vf) = 'VARCHAR' AND regexp_matches(rec->>vf, '^\s*[vV]?\d+\.\d+\.\d+([^\d.]|$)')
    THEN list_transform(regexp_extract_all(regexp_extract(rec->>vf, '\d+\.\d+\.\d+'), '\d+'), lambda x: x::INT) END AS ver FROM r WHERE json_type(rec) = 'OBJECT'),
  t AS (SELECT line_id, vendor, ver, vf, j.fullkey, j.type, j.value FROM v, json_tree(rec) AS j
    WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT regexp_matches(j.path, '\[\d+\]') AND NOT regexp_matches(j.fullkey, '\[\d+\]$')),
  leaf AS (SELECT line_id, vendor, ver, replace(substr(fullkey, 3), '"', '') AS path,
    CASE WHEN type IN ('VARCHAR', 'BOOLEAN', 'ARRAY') THEN CASE type WHEN 'VARCHAR' THEN 'string' ELSE lower(type) END ELSE 'number' END AS kind,
    CASE WHEN type = 'VARCHAR' THEN value->>'$' ELSE value::VARCHAR END AS val FROM t WHERE replace(substr(fullkey, 3), '"', '') <> vf)"""
P4_FIELDS = _LEAVES + " SELECT vendor, array_to_string(ver, '.') AS cli_version, path AS field_path, kind AS json_type, count(*) AS n FROM leaf GROUP BY ALL"
#: Every pair of a field that goes and one that comes is compared on its exact sets of values and forms.
P4_FOUND = (
    _LEAVES
    + r""",
  f AS (SELECT vendor, ver, path, CASE WHEN count(DISTINCT kind) = 1 THEN any_value(kind) WHEN bool_or(kind = 'array') THEN 'array' ELSE 'string' END AS kind, count(*) AS n,
    count(DISTINCT val) AS d FROM leaf WHERE ver IS NOT NULL GROUP BY vendor, ver, path),
  s AS (SELECT *, lag(ver) OVER (PARTITION BY vendor ORDER BY ver) AS prev FROM (SELECT DISTINCT vendor, ver FROM f)),
  old AS (SELECT s.ver AS later, f.* FROM f JOIN s ON s.vendor = f.vendor AND s.prev = f.ver),
  new AS (SELECT s.ver AS later, f.* FROM f JOIN s ON s.vendor = f.vendor AND s.ver = f.ver AND s.prev IS NOT NULL),
  gone AS (SELECT * FROM old o WHERE NOT EXISTS (FROM new n WHERE n.vendor = o.vendor AND n.later = o.later AND n.path = o.path)),
  come AS (SELECT * FROM new n WHERE NOT EXISTS (FROM old o WHERE n.vendor = o.vendor AND n.later = o.later AND n.path = o.path)),
  vals AS (SELECT DISTINCT vendor, ver, path, val, regexp_replace(val, '[0-9A-Za-z]+', '', 'g') || '#' || length(val) AS form FROM leaf WHERE ver IS NOT NULL),
  forms AS (SELECT DISTINCT vendor, ver, path, form FROM vals),
  nf AS (SELECT vendor, ver, path, count(*) AS d FROM forms GROUP BY ALL),
  p AS (SELECT g.vendor, g.later, g.path AS a, c.path AS b, g.d AS da, c.d AS db, g.n AS na, c.n AS nb, fa.d AS fa, fb.d AS fb,
      (SELECT count(*) FROM vals x JOIN vals y ON x.vendor = y.vendor AND x.val = y.val WHERE x.vendor = g.vendor AND x.ver = g.ver AND x.path = g.path AND y.ver = c.ver AND y.path = c.path) AS i,
      (SELECT count(*) FROM forms x JOIN forms y ON x.vendor = y.vendor AND x.form = y.form WHERE x.vendor = g.vendor AND x.ver = g.ver AND x.path = g.path AND y.ver = c.ver AND y.path = c.path) AS fi
    FROM gone g JOIN come c ON g.vendor = c.vendor AND g.later = c.later AND g.kind = c.kind
    JOIN nf fa ON fa.vendor = g.vendor AND fa.ver = g.ver AND fa.path = g.path JOIN nf fb ON fb.vendor = c.vendor AND fb.ver = c.ver AND fb.path = c.path),
  q AS (SELECT *, greatest(i / (da + db - i), i / least(da, db)) + fi / (fa + fb - fi) AS score FROM p
    WHERE i / (da + db - i) >= 0.2 OR i / least(da, db) >= 0.5 OR ((da > 0.5 * na OR db > 0.5 * nb) AND fi / (fa + fb - fi) >= 0.5)),
  ren AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY vendor, later, a ORDER BY score DESC, a, b) = 1 AND row_number() OVER (PARTITION BY vendor, later, b ORDER BY score DESC, a, b) = 1),
  c AS (SELECT vendor, later, a AS path, 'renamed' AS kind, b AS np FROM ren
    UNION ALL SELECT vendor, later, path, 'removed', '' FROM gone g WHERE NOT EXISTS (FROM ren r WHERE r.vendor = g.vendor AND r.later = g.later AND r.a = g.path)
    UNION ALL SELECT vendor, later, path, 'added', '' FROM come g WHERE NOT EXISTS (FROM ren r WHERE r.vendor = g.vendor AND r.later = g.later AND r.b = g.path)
    UNION ALL SELECT o.vendor, o.later, o.path, 'retyped', '' FROM old o JOIN new n ON o.vendor = n.vendor AND o.later = n.later AND o.path = n.path WHERE o.kind <> n.kind)
  SELECT vendor, array_to_string(later, '.') AS cli_version, path AS field_path, kind AS change_kind, np AS new_path FROM c"""
)
#: The fields of the meta lines and the types of those that are no text.
_FIELDS = """agent.label agent_nickname agent_path approval base_instructions client_name context_window costUSD ctx_limit cwd dynamic_tools forked_from_id git.branch git.commit_hash git.head_sha
  git.repository_url gitBranch git_branch history_mode id isMeta isSidechain message.content message.role message.usage.output_tokens model_provider multi_agent_version originator parent_thread_id
  promptSource sandbox sessionId session_id source thread_source timestamp tools type userType uuid""".split()
_TYPES = {"ctx_limit": "BIGINT", "message.usage.output_tokens": "BIGINT", "isMeta": "BOOLEAN"}


def _names(fields: list[str]) -> list[str]:
    """Column names: two that differ in case alone are told apart by a number."""
    out: list[str] = []
    for f in fields:
        plain, taken = f.replace(".", "__"), {x.lower() for x in out}
        out.append(plain if plain.lower() not in taken else f"{plain}__2")
    return out


P4_TABLE = (
    _LEAVES
    + " SELECT v.line_id, v.vendor, array_to_string(v.ver, '.') AS cli_version, "
    + ", ".join(f"CAST(max(val) FILTER (path = '{f}') AS {_TYPES.get(f, 'VARCHAR')}) AS \"{n}\"" for f, n in zip(_FIELDS, _names(_FIELDS), strict=True))
    + " FROM v LEFT JOIN leaf ON leaf.line_id = v.line_id GROUP BY v.line_id, v.vendor, v.ver"
)
