"""Conversations, encoding, packing and look-alike text against brute force and round trips."""

import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm import brute_text as B
from tidemark.llm import queries as Q
from tidemark.llm.components import connected_components
from tidemark.llm.conversations import rebuild_conversations
from tidemark.llm.encode import decode, encode, load, token_counts, token_offsets, tokenizer_path
from tidemark.llm.lookalike import Transducer, build_mapping, consistent_text, look_alike_pairs, text_classes
from tidemark.llm.packing import pack, plan_tiers, step_balance
from tidemark.scratch import Scratch

COLS = "row_id bigint, session_id string, rec_uuid string, parent_uuid string, rec_type string, msg_role string, is_sidechain boolean, content_json string"
NAMES = [c.split()[0] for c in COLS.split(", ")]


def chat(spark, rows):
    return spark.createDataFrame(rows, COLS)


def found(df):
    return {(r.session_id, r.msg_no, r.rec_uuid) for r in rebuild_conversations(df).where("session_id is not null").collect()}


def test_conversations_of_the_data(spark, data):
    got = duckdb.sql(f"select {', '.join(NAMES)} from '{data}/transcripts.parquet'").fetchall()
    expected = B.conversations([dict(zip(NAMES, r)) for r in got])
    assert {tuple(r) for r in Q.p1_found(spark, data).collect()} == expected and expected


def test_random_conversations(spark):
    random.seed(4)
    rows, i = [], 0
    for s in range(60):
        n = random.choice([1, 2, 3, 4, 9, 30])
        names = [f"{s}-{k}" for k in range(n)]
        for k in range(n):
            parent = names[k - 1] if k else random.choice([None, "", None, "gone", names[-1]])
            if random.random() < 0.04:
                parent = random.choice([*names, "gone", None])
            kind = random.choice(["user", "assistant"]) if random.random() < 0.05 else ("user", "assistant")[k % 2]
            side = random.random() < 0.05
            role = random.choice([kind, f" {kind.upper()} ", None])
            content = random.choice(['"x"', '[{"type": "tool_use", "id": "1"}]', '" "']) if random.random() < 0.2 else '"said"'
            rows.append((i := i + 1, f"session {s}", names[k], parent, kind if not side else "attachment", role, side, content))
    random.shuffle(rows)
    assert found(chat(spark, rows)) == B.conversations([dict(zip(NAMES, r)) for r in rows])


def test_conversation_edges(spark):
    u, a = '"ask"', '"reply"'
    rows = [
        (1, "cycle", "a", "b", "user", None, None, u), (2, "cycle", "b", "a", "assistant", None, None, a),
        (3, "chain and cycle", "r", None, "user", None, None, u), (4, "chain and cycle", "s", "r", "assistant", None, None, a),
        (5, "chain and cycle", "x", "y", "assistant", None, None, a), (6, "chain and cycle", "y", "x", "assistant", None, None, a),
        (7, "pass", "r", "n2", "assistant", None, None, None), (8, "pass", "n1", "", "summary", None, None, None), (9, "pass", "n2", "n1", "assistant", None, True, a),
        (10, "self", "z", "z", "assistant", None, None, a), (11, "none", "q", None, "summary", None, None, None),
        (12, "passcycle", "m", "p1", "assistant", None, None, a), (13, "passcycle", "p1", "p2", "summary", None, None, None), (14, "passcycle", "p2", "p1", "summary", None, None, None),
        (15, "last", "v", None, "user", None, None, u), (16, "last", None, "v", "assistant", None, None, a),
        (17, None, "l1", None, "user", None, None, u), (18, None, "l2", "l1", "assistant", None, None, a), (19, None, "l3", "gone", "assistant", None, None, a),
        (20, "empty", "e", None, "user", None, None, u), (21, "empty", "f", "e", "assistant", None, None, '[{"type": "text", "text": " \\n"}]'),
    ]
    df = chat(spark, rows).withColumn("component", F.lit(1)).withColumn("id", F.lit("x"))
    assert found(df) == {("pass", 1, "r"), ("last", 1, "v"), ("last", 2, None)}
    loose = rebuild_conversations(df).where("session_id is null").orderBy("msg_no").collect()
    assert [(r.component, r.msg_no, r.rec_uuid) for r in loose] == [(17, 1, "l1"), (17, 2, "l2")]
    assert rebuild_conversations(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(i, "s", f"m{i}", f"m{i - 1}" if i else None, ("user", "assistant")[i % 2], None, None, '"x"') for i in range(3000)]
    assert found(chat(spark, rows)) == {("s", i + 1, f"m{i}") for i in range(3000)}


def test_short_and_long_ways_agree(spark, monkeypatch):
    from tidemark.llm import conversations

    rows = [(i, f"s{i % 7}", f"m{i}", f"m{i - 7}" if i >= 7 else None, "user" if i // 7 % 2 == 0 else "assistant", None, None, '"x"') for i in range(7 * 20)]
    rows += [(500, "s1", "odd", "odd2", "user", None, None, '"x"'), (501, "s1", "odd2", "odd", "assistant", None, None, '"x"')]
    df = chat(spark, rows)
    short = found(df)
    monkeypatch.setattr(conversations, "SMALL", 3)
    assert found(df) == short == {(f"s{k}", n + 1, f"m{k + 7 * n}") for k in range(7) if k != 1 for n in range(20)}


def test_quotes_join_rows_without_a_session(spark):
    said = ("user", None, None, '"x"'), ("assistant", None, None, '"x"')
    rows = [(1, None, "a", None, *said[0]), (2, None, "b", "a", *said[1]), (3, None, "c", None, *said[0]), (4, None, "d", "c", *said[1]), (5, "s", "e", None, *said[0]), (6, "s", "f", "e", *said[1])]
    apart = {(r.conversation, r.msg_no, r.id) for r in rebuild_conversations(chat(spark, rows)).collect()}
    assert apart == {("component/1", 1, 1), ("component/1", 2, 2), ("component/3", 1, 3), ("component/3", 2, 4), ("session/s", 1, 5), ("session/s", 2, 6)}
    quotes = spark.createDataFrame([(4, 1), (6, 2)], "u bigint, v bigint")
    joined = {r.conversation for r in rebuild_conversations(chat(spark, rows), quotes).collect()}
    assert joined == {"session/s"}  # two first messages in one conversation


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2100)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    linked = set()
    for u, v in edges:
        if u is not None and u != v:
            linked |= {u, v}
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in linked}


TEXTS = [None, "", " ", "plain", "naïve 👩‍💻 日本語", "<|endoftext|> is text", "é​ﬁ", "x" * 120_000, "ключ ref", "a\r\n\tb\x00c", "\U0001f1ea\U0001f1fa"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int")


def test_encoding_and_back(spark):
    path = tokenizer_path()
    d = docs(spark, TEXTS)
    got = {r.doc_id: r.ids for r in encode(d, path).collect()}
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in decode(encode(d, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in token_counts(d, path).collect()} == {i: len(x) for i, x in got.items()}
    assert encode(d.limit(0), path).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [got[4][-1]])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in decode(lists, path).collect()}.keys() == {1, 2, 3}


def test_offsets_cover_the_text(spark):
    path = tokenizer_path()
    spans = {}
    for r in token_offsets(docs(spark, TEXTS), path).orderBy("doc_id", "pos").collect():
        spans.setdefault(r.doc_id, []).append((r.char_from, r.char_to))
    assert set(spans) == {i for i, t in enumerate(TEXTS) if t}
    for i, found_spans in spans.items():
        assert found_spans[0][0] == 0 and found_spans[-1][1] == len(TEXTS[i]) and all(b[0] <= a[1] for a, b in zip(found_spans, found_spans[1:]))
    assert load(path).id_to_token(0) is not None


def check_packing(packed, counts, capacity):
    fill, seen = {}, {}
    for r in packed:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.token_to - r.token_from
        seen.setdefault(r.doc_id, []).append((r.piece_no, r.token_from, r.token_to))
    assert all(0 < n <= capacity for n in fill.values()) and sorted(fill) == list(range(len(fill)))
    for doc, n in counts:
        pieces = sorted(seen.pop(doc, []))
        if not n:
            assert not pieces
            continue
        assert [p[0] for p in pieces] == list(range(-(-n // capacity))) and pieces[0][1] == 0 and pieces[-1][2] == n
        assert all(a[2] == b[1] for a, b in zip(pieces, pieces[1:])) and (len(pieces) == 1 or all(p[2] - p[1] == capacity for p in pieces[:-1]))
    assert not seen
    return len(fill)


def best_fit(sizes, capacity):
    """Containers that plain best fit by falling size needs."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= size]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= size
        else:
            gaps.append(capacity - size)
    return len(gaps)


def test_packing(spark):
    random.seed(6)
    sizes = [None, 0, 1, 2048, 2049, 4096, 10_000] + [random.choice([random.randrange(1, 60), random.randrange(1, 2049), 700, 683]) for _ in range(1200)]
    counts = list(enumerate(sizes))
    df = spark.createDataFrame([(d, n, "x") for d, n in counts], "doc_id bigint, n_tokens bigint, size string")
    packed = pack(df).collect()
    used = check_packing(packed, counts, 2048)
    assert used <= best_fit([p for n in sizes for p in [2048] * ((n or 0) // 2048) + [(n or 0) % 2048] if p], 2048)
    assert all(r.tier >= r.token_to - r.token_from for r in packed)
    balance = step_balance(pack(df)).collect()
    assert sum(r.containers for r in balance) == used and max(r.containers for r in balance) - min(r.containers for r in balance) <= 1
    small = pack(df, 64, (16, 32, 64)).collect()
    check_packing(small, counts, 64)
    assert pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(df, 100)


def test_tiers_change_the_plan(spark):
    random.seed(8)
    counts = [(i, random.choice([random.randrange(1, 40), random.randrange(1, 257), random.randrange(1, 2049)])) for i in range(3000)]
    df = spark.createDataFrame(counts, "doc_id bigint, n_tokens bigint")
    tiered, plain = pack(df).collect(), pack(df, tiers=(2048,)).collect()
    total = sum(n for _, n in counts)
    for packed in (tiered, plain):
        assert check_packing(packed, counts, 2048) <= 1.01 * -(-total // 2048) + 1
    place = lambda packed: {r.doc_id: r.container_id for r in packed}
    assert place(tiered) != place(plain)
    held, inside = {}, {}
    for r in tiered:
        held[r.window_id, r.window] = held.get((r.window_id, r.window), 0) + r.token_to - r.token_from
        inside.setdefault(r.window_id, set()).add(r.container_id)
    assert all(n <= window for (_, window), n in held.items()) and all(len(c) == 1 for c in inside.values())
    assert {w for _, w in held} >= {256, 1024, 2048} and {r.window for r in plain} == {2048}
    assert [w.count for w in plan_tiers({400: 8, 100: 20}).windows] == [6, 8, 0, 0] and plan_tiers({400: 8, 100: 20}).containers == 3
    assert any(r.window > r.tier for r in tiered) and all(r.window >= r.tier for r in tiered)


def test_one_length_holds_a_third():
    plan = plan_tiers({1: 10**9, 2048: 5, 1025: 10**9, 1023: 10**9})
    assert plan.containers == 10**9 + 5 + -(-(10**9) // 2048)
    assert len(plan.runs) < 20


def test_mapping_is_consistent():
    mapping = build_mapping()
    t = Transducer(mapping)
    assert all("".join(mapping.get(c, c) for c in target) == target for target in mapping.values())
    same = [("ﬁle", "file"), ("ＡＢＣ１", "ABC1"), ("é", "é"), ("soft­hyphen", "softhyphen"), ("а​bс", "abc"), ("a b　c", "a b c"), ("non‑break", "non-break"),
            ("ｶﾞ", "ガ"), ("한", "한"), ("Å", "Å"), ("e͏́", "é"), ("q̣̇", "q̣̇"), ("օbject", "object"), ("ΑΒ", "AB")]
    for a, b in same:
        assert t.apply(a) == t.apply(b), (a, b)
    other = [("²", "2"), ("①", "1"), ("é", "e"), ("A", "a"), ("l", "I"), ("0", "O"), ("-", "–"), ("a b", "a  b"), ("👩‍💻", "👩💻"), ("™", "TM"), ("½", "1/2"), ("n", "m"), ("−", "-")]
    for a, b in other:
        assert t.apply(a) != t.apply(b), (a, b)
    for text in ("ﬁ а é Ω 👩‍💻 하", "x́​̂", "́lone", "각"):
        once = t.apply(text)
        assert t.apply(once) == once == unicodedata.normalize("NFC", once)


def test_pairs(spark):
    texts = ["abc", "аbc", "abc", "ab​c", None, "", " ", "​", "ABC", "ａｂｃ", "abć", "abć", " "]
    d = docs(spark, texts)
    got = {tuple(r) for r in look_alike_pairs(d).collect()}
    assert got == {(0, 1), (0, 3), (0, 9), (1, 3), (1, 9), (3, 9), (1, 2), (2, 3), (2, 9), (10, 11)}
    classes = {r.doc_id: (r.class_id, r.text_id) for r in text_classes(d).collect()}
    assert classes[2] == (0, 0) and classes[9] == (0, 9) and classes[11] == (10, 11) and set(classes) == {0, 1, 2, 3, 8, 9, 10, 11}
    shown = {r.doc_id: r.consistent for r in consistent_text(d).collect()}
    assert shown[4] is None and shown[5] == "" and shown[9] == "abc"
    assert look_alike_pairs(d.limit(0)).count() == 0


def test_pairs_of_the_data(spark, data):
    rows = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet' where text is not null").fetchall()
    t = Transducer()
    by = {}
    for i, x in rows:
        by.setdefault(t.apply(x), {}).setdefault(x, []).append(i)
    expected = set()
    for form, variants in by.items():
        if form.strip():
            for x, ids in variants.items():
                for y, others in variants.items():
                    if x != y:
                        expected |= {tuple(sorted((i, min(others)))) for i in ids}
    assert {tuple(r) for r in Q.p10_found(spark, data).collect()} == expected


def test_queries_run(spark, data):
    assert Q.p8_round_trip(spark, data).count() == 0
    assert Q.p9_steps(spark, data).count() >= 1


def test_sequences_and_wider_letters():
    t = Transducer()
    assert max(map(len, t.mapping)) > 1 and all(t.apply(x) == x for x in t.mapping.values())
    same = [("o\u0338re", "øre"), ("\u0131\u0307", "i"), ("\u0456\u0307", "i"), ("l\u200b\u0338", "ł"), ("ｄ\u0335", "đ"), ("α", "a"), ("ρ", "р"), ("ι", "i"), ("γ", "у"), ("т", "τ"),
            ("π", "п"), ("ⲟ", "o"), ("ꓐ", "B"), ("о\u0338", "ø"), ("o\u0338\u0301", "ǿ")]
    for a, b in same:
        assert t.apply(a) == t.apply(b), (a, b)
    for a, b in [("ø", "o"), ("ł", "l"), ("đ", "d"), ("ı", "i"), ("ä", "a"), ("ё", "e"), ("β", "ß"), ("ж", "x")]:
        assert t.apply(a) != t.apply(b), (a, b)
    with pytest.raises(ValueError):
        from tidemark.llm import lookalike

        before = lookalike.SEQUENCES
        try:
            lookalike.SEQUENCES = {"\uff21": "B"}
            build_mapping()
        finally:
            lookalike.SEQUENCES = before


def test_readable_text_keeps_scripts():
    from tidemark.llm.lookalike import Reader

    r = Reader()
    kept = ["Сессия сохранена на диске", "λόγος και α", "ключ ref", "日本語", "naïve", ""]
    assert [r.apply(x) for x in kept] == kept
    assert r.apply("Тһе рrоmрt") == "The prompt" and r.apply("cохрaнeно ключ") == "сохранено ключ" and r.apply("ｆｕｌｌ\u00a0w\u00adidth") == "full width"
    t = Transducer()
    assert all(t.apply(r.apply(x)) == t.apply(x) for x in [*kept, "Тһе рrоmрt", "cохрaнeно ключ"])


def test_forms_of_documents(spark):
    got = {r.doc_id: (r.consistent, r.readable) for r in consistent_text(docs(spark, [None, "", "ключ", "Тһе"])).collect()}
    assert got[0] == (None, None) and got[1] == ("", "") and got[2][1] == "ключ" and got[2][0] == Transducer().apply("ключ") and got[3] == ("The", "The")


def test_tokenizer_is_read_from_the_sent_copy(spark):
    from tidemark.llm import encode as E

    path = E.send(docs(spark, ["x"]), tokenizer_path())
    missing = "/no/such/folder/" + path.rsplit("/", 1)[-1]
    assert E.load(missing).get_vocab_size() == load(path).get_vocab_size()
