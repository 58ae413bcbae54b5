"""The general problems against brute force, on the smallest tables and on hand-made edge rows."""

import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import brute as B
from tidemark.operators.activity import activity_sessions
from tidemark.operators.blocks import block_table, json_text, read_deep, read_json
from tidemark.operators.copies import deduplicate, duplicate_rows, kept_rows, transcript_key
from tidemark.operators.drift import _form, column_names, field_profiles, promote, schema_changes, union_schema, unified_table
from tidemark.operators.instants import CANONICAL, normalise_instants
from tidemark.operators.periods import periods_and_gaps
from tidemark.plans import problems as P


def rows(data, table, *cols):
    got = duckdb.sql(f"select {', '.join(cols)} from '{data}/{table}.parquet'").fetchall()
    return [dict(zip(cols, r)) for r in got]


def device(uri):
    return re.search("device/([^/]+)", uri)[1]


def test_instants_of_all_tables(spark, data):
    zones = dict(duckdb.sql(f"select device_ref, tz_name from '{data}/devices.parquet'").fetchall())
    expected = set()
    for name, text, dev in (("transcripts", "ts_raw", "device_ref"), ("rollouts", "ts_raw", "device_ref"), ("observations", "obs_time", "source_uri")):
        for r in rows(data, name, "row_id", text, dev):
            d = device(r[dev]) if dev == "source_uri" else r[dev]
            if r[text] is not None and not re.match(CANONICAL, r[text]) and (us := B.instant(r[text], zones.get(d))) is not None:
                expected.add((name, r["row_id"], us))
    assert {tuple(r) for r in P.p2_found(spark, data).collect()} == expected


@pytest.mark.parametrize(
    ("text", "device", "expected"),
    [
        ("2024-03-10 02:30:00", "ny", 1710055800000000),  # does not occur: offset before the change
        ("2024-11-03 01:30:00", "ny", 1730611800000000),  # occurs twice: the earlier
        ("2024-02-29 12:00:00", "ny", 1709226000000000),
        ("2023-02-29 12:00:00", "ny", None),
        ("2024-02-30T12:00:00Z", "ny", None),
        ("2024-01-01T24:00:00Z", "ny", None),
        ("2024-01-01T00:00:00+25:00", "ny", None),
        ("2024-01-01 00:00:00 Mars/Base", "ny", None),
        ("2024-01-01 00:00:00 XYZ", "ny", None),
        ("2024-01-01 00:00:00", None, None),
        ("2024-01-01 00:00:00", "nowhere", None),
        ("2024-01-01 00:00:00 IST", "in", 1704047400000000),
        ("2024-01-01T00:00:00.1234567899Z", None, 1704067200123456),
        ("1710409911.752", None, 1710409911752000),
        ("1710306579634", None, 1710306579634000),
        ("1710306579634888", None, 1710306579634888),
        ("1710306579634888123", None, 1710306579634888),
        ("-1.5", None, -1500000),
        ("99999999999999999999", None, None),
        ("", "ny", None),
        (None, "ny", None),
        ("x" * 100_000, "ny", None),
        ("Jan 5, 2024 12:00:00 AM", "utc", 1704412800000000),
        ("Jan 5, 2024 13:00:00 AM", "utc", None),
        ("05/Jan/2024:10:00:00 +0100", None, 1704445200000000),
        ("Fri, 05 Jan 2024 10:00:00 -0300", None, 1704459600000000),
        ("20240105T100000Z", None, 1704448800000000),
    ],
)
def test_one_instant(spark, text, device, expected):
    zones = spark.createDataFrame(
        [("ny", "America/New_York"), ("ny", "America/New_York"), ("in", "Asia/Kolkata"), ("utc", "UTC"), ("nowhere", "Not/AZone"), (None, "UTC"), ("n", None)],
        "device_ref string, tz_name string",
    )
    df = spark.createDataFrame([(text, device, 1)], "text string, device string, tz_name int")
    (got,) = normalise_instants(df, zones, "text", "device").collect()
    assert got.epoch_us == expected and got.tz_name == 1


def test_copies(spark, data):
    t = rows(data, "transcripts", "row_id", "session_id", "rec_uuid")
    o = rows(data, "observations", "row_id", "dedupe_key")
    expected = {("transcripts", i) for i in B.copies(t, B.transcript_key)} | {("observations", i) for i in B.copies(o, lambda r: r["dedupe_key"])}
    assert {tuple(r) for r in P.p7_found(spark, data).collect()} == expected


def test_copies_of_edge_rows(spark):
    df = spark.createDataFrame(
        [(1, "s", "A1B2C3D4-0000-0000-0000-000000000001"), (2, "s", "{a1b2c3d400000000000000000000 0001}"), (3, "s", "urn:uuid:a1b2c3d4-0000-0000-0000-000000000001"),
         (4, "s", None), (5, "s", None), (6, None, "x"), (7, None, "x"), (8, "s", ""), (9, "s", "")],
        "row_id bigint, session_id string, rec_uuid string",
    )
    assert {r.row_id for r in duplicate_rows(df, transcript_key(), F.col("row_id")).collect()} == {3, 9}
    assert {r.row_id for r in kept_rows(df, transcript_key(), F.col("row_id")).collect()} == {1, 2, 4, 5, 6, 7, 8}
    assert duplicate_rows(df.limit(0), transcript_key(), F.col("row_id")).count() == 0


def test_deduplicate_ties(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", 1, "a"), ("k", 2, "c"), (None, 1, "d"), (None, 1, "d"), ("one", None, "e")], "k string, at int, first string")
    got = sorted((r.k or "", r.at or 0, r.first) for r in deduplicate(df, ["k"], ["at"]).collect())
    assert len(got) == 4 and got[:2] == [("", 1, "d"), ("", 1, "d")] and got[3] == ("one", 0, "e") and got[2][:2] == ("k", 1)


def test_one_key_of_many_copies(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    assert kept_rows(df, [F.col("k")], F.col("row_id")).count() == 13_334


def test_blocks(spark, data):
    t = rows(data, "transcripts", "row_id", "session_id", "rec_uuid", "content_json")
    assert {tuple(r) for r in P.p3_found(spark, data).collect()} == B.blocks(t)


def test_blocks_of_edge_content(spark):
    deep = "[" * 3000
    content = [None, "", '""', '"x"', "null", "3", "[]", '[null, {"type": "text"}]', '{"content": "[{\\"type\\": \\"a\\"}]"}', '"[1, 2]"', '"{\\"a\\": 1}"', "{torn", deep,
               '[{"type": 5, "content": [null, "x", {"content": ""}]}]', '{"type": "tool_result", "tool_use_id": "u"}', '[{"type": "tool_use", "id": "u"}]',
               '{"type": "text", "text": "\\ud800"}', '"' + "y" * 200_000 + '"', '[{"type": "tool_use", "id": "u"}]']
    df = spark.createDataFrame([(i, "s" if i != 14 else "s", c) for i, c in enumerate(content)], "row_id bigint, session_id string, content_json string")
    got = {tuple(r) for r in block_table(df, "row_id", "session_id", "content_json").collect()}
    none = (-1, "")
    assert got == {
        (2, "0", "text", *none), (3, "0", "text", *none), (7, "1", "text", *none), (8, "0", "", *none), (8, "0.0", "a", *none), (9, "0", "text", *none),
        (10, "0", "text", *none), (13, "0", "5", *none), (13, "0.2", "", *none), (13, "0.2.0", "text", *none), (14, "0", "tool_result", 15, "0"),
        (15, "0", "tool_use", *none), (16, "0", "text", *none), (17, "0", "text", *none), (18, "0", "tool_use", *none),
    }
    assert block_table(df.limit(0), "row_id", "session_id", "content_json").count() == 0


def test_activity(spark, data):
    zones = dict(duckdb.sql(f"select device_ref, tz_name from '{data}/devices.parquet'").fetchall())
    obs = rows(data, "observations", "row_id", "dedupe_key", "source_kind", "obs_time", "subject", "source_uri")
    drop = B.copies(obs, lambda r: r["dedupe_key"])
    events = []
    for r in obs:
        m = re.match("session/([^/]+)", r["subject"] or "")
        us = B.instant(r["obs_time"], zones.get(device(r["source_uri"])))
        if r["row_id"] not in drop and m and us is not None:
            events.append(((r["source_kind"], m[1]), us))
    assert {tuple(r) for r in P.p5_found(spark, data).collect()} == B.stretches(events, 300_000_000)


def test_activity_across_buckets(spark):
    random.seed(3)
    events = [(random.choice(["a", None, "b"]), random.randrange(0, 4000) * 10) for _ in range(1500)] + [("t", 0), ("t", 300), ("t", 601), ("t", None), ("t", -5)]
    df = spark.createDataFrame(events, "k string, at bigint")
    got = {tuple(r) for r in activity_sessions(df, ["k"], "at", 300).collect()}
    assert got == B.stretches([((k,), t) for k, t in events if t is not None], 300)
    assert activity_sessions(df.limit(0), ["k"], "at").count() == 0


def test_periods(spark, data):
    spans = duckdb.sql(f"select repository, span_start, span_end from '{data}/block_parts.parquet'").fetchall()
    assert {tuple(r) for r in P.p6_found(spark, data).collect()} == B.periods(spans)


def test_periods_of_random_spans(spark):
    random.seed(5)
    spans = []
    for _ in range(600):
        s = random.randrange(-3000, 3000)
        spans.append((random.choice(["a", "b", None, "c"]), random.choice([s, s, s, None]), random.choice([s + random.randrange(-3, 40), None, s])))
    spans += [("touch", 0, 10), ("touch", 10, 20), ("touch", 0, 10)]
    df = spark.createDataFrame([(i, 7, *x) for i, x in enumerate(spans)], "e int, rank int, repository string, span_start bigint, span_end bigint")
    for width in (7, 86_400):
        assert {tuple(r) for r in periods_and_gaps(df, width=width).collect()} == B.periods(spans)
    assert periods_and_gaps(df.limit(0)).count() == 0


def test_schema_changes(spark):
    def line(version, **fields):
        import json

        return ("claude-code", json.dumps({"version": version, **fields}))

    ids = [f"u-{i:08d}" for i in range(60)]
    lines = [line(" v1.2.0+b7", oldId=i, mode="fast", n=1, gone=True, sub={"x": None}) for i in ids]
    lines += [line("1.10.0", new_id=i.replace("u-", "w-"), mode=["fast"], n="1", extra="else", sub={"x": 1}) for i in ids]
    lines += [line(None, ghost=1), ("claude-code", '{"version": "1.10.0", "torn'), ("other", "{}"), (None, None), ("claude-code", "[1]"), ("claude-code", "")]
    df = spark.createDataFrame(lines, "vendor string, body string").withColumn("line_id", F.monotonically_increasing_id())
    got = {tuple(r) for r in schema_changes(field_profiles(df)).collect()}
    v = ("claude-code", "1.10.0")
    assert got == {(*v, "oldId", "renamed", "new_id"), (*v, "mode", "retyped", ""), (*v, "n", "retyped", ""), (*v, "gone", "removed", ""), (*v, "extra", "added", ""), (*v, "sub.x", "added", "")}
    assert schema_changes(field_profiles(df.limit(0))).count() == 0
    fields = union_schema(field_profiles(df))
    table = unified_table(df, fields)
    assert table.count() == 121 and dict(fields)["n"] == "string" and "sub__x" in table.columns
    assert promote("number", "boolean") == "string" and promote("array", "string") == "array"


def test_all_changes_of_the_data(spark, data):
    got = P.p4_found(spark, data.replace("sf0.001", "sf0.01"))
    kinds = {(r.field_path, r.new_path) for r in got.where("change_kind = 'renamed'").collect()}
    assert ("sessionId", "session_id") in kinds and ("originator", "client_name") in kinds


def test_content_deeper_than_the_json_library(spark):
    n, top = 20_000, '[{"type": "text", "text": "x"}, {"type": "tool_result", "tool_use_id": "u", "content": '
    deep = top + '[{"type": "b", "content": ' * n + "[]" + "}]" * n + "}]"
    with pytest.raises(RecursionError):
        json.loads(deep)
    assert [b.get("type") for b in read_json(deep)] == ["text", "tool_result"]
    plain = '{"b": [1, {"d": "\u00e9", "c": []}], "a": {}}'
    assert read_deep(plain) == json.loads(plain) and json_text(read_deep("[" * n + plain + "]" * n), ensure_ascii=False) == "[" * n + plain + "]" * n
    for bad in ("[1,]", "[1 2]", '{"a"}', "{1: 2}", "[1}", "[] []", "", "[NaN]", "[" * n):
        with pytest.raises(ValueError):
            read_deep(bad)
    rows = spark.createDataFrame([(1, "s", top + '[{"type": "b", "content": ' * 6_000 + "[]" + "}]" * 6_000 + "}]")], "row_id bigint, session_id string, content_json string")
    kinds = {r.block_path: r.block_type for r in block_table(rows, "row_id", "session_id", "content_json").where("length(block_path) < 4").collect()}
    assert kinds == {"0": "text", "1": "tool_result", "1.0": "b"}


def test_renames_between_sides_of_unlike_size(spark):
    def line(version, **fields):
        return ("claude-code", json.dumps({"version": version, **fields}))

    word = lambda i: "".join(chr(97 + i * k % 26) for k in (3, 5, 7)) * (1 + i % 9)
    lines = [line("1.0.0", place=word(i % 200), code=f"k-{i % 300:06d}") for i in range(3_000)]
    lines += [line("2.0.0", site=word(i % 200), label=f"z-{i + 900:06d}") for i in range(30)]
    df = spark.createDataFrame(lines, "vendor string, body string")
    got = {(r.field_path, r.change_kind, r.new_path) for r in schema_changes(field_profiles(df)).collect()}
    assert got == {("place", "renamed", "site"), ("code", "renamed", "label")}
    assert _form("-" * 41 + "..") != _form("-" * 41 + "==")


def test_union_table_loses_nothing(spark):
    def line(**fields):
        return ("claude-code", json.dumps(fields))

    big = 2**53 + 1
    lines = [
        line(version="1.0.0", n=big, m=1, h=2**70, mix=big, vendor="v", userId="u1"), line(version="1.0.0", n=3, m=1.5, h=1, mix=0.5),
        line(ghost="only here"), line(**{"version": "2.0.0", "a": {"b": 1}, "a__b": 2, "A__B": 3, "": 4}),
    ]
    df = spark.createDataFrame(lines, "vendor string, body string").withColumn("line_id", F.monotonically_increasing_id())
    fields = union_schema(field_profiles(df))
    assert dict(fields) == {"": "integer", "A__B": "integer", "a.b": "integer", "a__b": "integer", "ghost": "string", "h": "string", "m": "number",
                            "mix": "string", "n": "integer", "userId": "string", "vendor": "string"}
    names = dict(zip([p for p, _ in fields], column_names(fields), strict=True))
    assert len({n.lower() for n in names.values()}) == len(names) and names["A__B"] == "A__B" and names["a.b"] == "a__b__2" and names["vendor"] == "vendor__2"
    got = [r.asDict() for r in unified_table(df, fields).collect()]
    pick = lambda path: [r[names[path]] for r in got if r[names[path]] is not None]
    assert pick("n") == [big, 3] and pick("m") == [1.0, 1.5] and pick("h") == [str(2**70), "1"] and pick("mix") == [str(big), "0.5"]
    assert pick("ghost") == ["only here"] and pick("a.b") == [1] and pick("a__b") == [2] and pick("A__B") == [3] and pick("") == [4] and pick("vendor") == ["v"]


def test_a_restyled_name_with_other_values_is_no_rename(spark):
    lines = [("claude-code", json.dumps({"version": "1.0.0", "userId": f"u-{i % 40}"})) for i in range(400)]
    lines += [("claude-code", json.dumps({"version": "2.0.0", "user_id": "/" + "x" * (i % 40)})) for i in range(400)]
    got = {(r.field_path, r.change_kind) for r in schema_changes(field_profiles(spark.createDataFrame(lines, "vendor string, body string"))).collect()}
    assert got == {("userId", "removed"), ("user_id", "added")}


def test_deduplicate_stored_and_new(spark):
    cols = "k string, at int, x string, a__b string"
    stored = spark.createDataFrame([("a", 5, "old", None), ("b", 1, "b1", ""), (None, 1, "n", None)], cols)
    new = spark.createDataFrame([("a", 1, "late"), ("c", 2, "c2"), ("c", 2, "c2"), ("c", 1, None), (None, 1, "n")], "k string, at int, x string")
    got = sorted(tuple(r)[:3] for r in deduplicate(stored, ["k"], ["at"], new).where("k is not null").collect())
    assert got == [("a", 5, "old"), ("b", 1, "b1"), ("c", 1, None)]
    assert deduplicate(stored, ["k"], ["at"], new).where("k is null").count() == 2
    assert deduplicate(stored.limit(0), ["k"], ["at"], new.limit(0)).count() == 0


def test_a_group_larger_than_one_task_ranks(spark, monkeypatch):
    from tidemark.operators import copies

    monkeypatch.setattr(copies, "GROUP_AT_ONCE", 50)
    df = spark.range(3_000).select((F.col("id") * 7919 % 3_000).alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 700).cast("string")).alias("k"))
    pairs = [(r.k, r.row_id) for r in df.collect()]
    first = {k: min(i for q, i in pairs if q == k) for k, _ in pairs}
    assert {(r.k, r.row_id) for r in kept_rows(df, [F.col("k")], F.col("row_id")).collect()} == set(first.items())
    assert {r.row_id for r in duplicate_rows(df, [F.col("k")], F.col("row_id")).collect()} == {i for k, i in pairs if first[k] != i}
    assert deduplicate(spark.range(500).selectExpr("'x' k", "1 at"), ["k"], ["at"]).count() == 1


def test_a_shared_folder_is_asked_for(spark, monkeypatch, tmp_path):
    from types import SimpleNamespace

    from tidemark import scratch

    unset = SimpleNamespace(isDefined=lambda: False)
    ask = lambda master, made, conf=None: scratch.shared_dir(SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: conf), sparkContext=SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: made)))))
    with pytest.raises(scratch.NoSharedFolder):
        ask("spark://host:7077", unset)
    with pytest.raises(scratch.NoSharedFolder):
        ask("local-cluster[2,1,1024]", unset)
    made = SimpleNamespace(isDefined=lambda: True, get=lambda: "file:/shared/x/")
    assert ask("yarn", made) == "file:/shared/x" and ask("yarn", made, "hdfs:/set") == "hdfs:/set" and "tidemark-" in ask("local[4]", unset)
    kept = scratch.Scratch(spark)
    frame = kept.cut(spark.range(3), "t")
    assert frame.count() == 3 and scratch.release_all(spark) >= 1
    assert not kept._fs(kept.root).exists(kept._path(kept.root))


def test_rename_signatures_find_like_values():
    """Recall of the minimum-hash test over random pairs of value sets that are alike, and its silence over pairs that are not."""
    from types import SimpleNamespace

    from tidemark.operators.drift import _h64, _signature, same_kind

    rng = random.Random(5)

    def profile(values, n):
        hashes = {_h64(v) for v in values}
        return SimpleNamespace(json_type="string", n=n, field_path="x", values_=_signature(hashes), forms=_signature({_h64(v[:1] + str(len(v))) for v in values}))

    def judged(share, forms_alike):
        hits = 0
        for k in range(200):
            size = rng.randrange(20, 400)
            common = [f"{k}-c{i}" + "z" * (i % 40) for i in range(round(size * share))]
            rest = size - len(common)
            old = [*common, *(f"{k}-a{i}" + "z" * (i % 40) for i in range(rest))]
            new = [*common, *((f"{k}-b{i}" if forms_alike else f"#{k}{i}" * 9) + "z" * (i % 40) for i in range(rest))]
            # Values repeat, so forms alone decide nothing.
            hits += same_kind(profile(old, 10 * size), profile(new, 10 * size)) > 0
        return hits / 200

    assert judged(0.6, True) > 0.97 and judged(0.5, True) > 0.9
    assert judged(0.02, False) < 0.05 and judged(0.0, True) == 0


def test_activity_of_keys_with_any_name(spark):
    df = spark.createDataFrame([(1, 2, 0, 9), (1, 2, 200, 9), (1, None, 900, 9), (1, 2, 900, 9)], "a int, n int, cell bigint, b int")
    got = {tuple(r) for r in activity_sessions(df, ["a", "n"], "cell", 300).collect()}
    assert got == {(1, 2, 0, 200, 2), (1, 2, 900, 900, 1), (1, None, 900, 900, 1)}
    assert {tuple(r) for r in activity_sessions(df, ["a", "b"], "cell", 300, "n").collect()} == {(1, 9, 0, 200, 4), (1, 9, 900, 900, 2)}
