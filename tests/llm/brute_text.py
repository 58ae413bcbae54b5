"""Plain single-process version of the conversation rules, written from the problem statement."""

from __future__ import annotations

from collections import defaultdict

from tests.brute import content_blocks, copies, transcript_key, uuid_form


def holds(text):
    for _, b in content_blocks(text):
        if b.get("type") != "text" or (isinstance(b.get("text"), str) and b["text"].strip()):
            return True
    return False


def conversations(rows):
    """(session, number, uuid) of the messages of good conversations."""
    drop = copies(rows, transcript_key)
    sessions = defaultdict(list)
    for r in rows:
        if r["row_id"] not in drop and r["session_id"] is not None:
            sessions[uuid_form(r["session_id"])].append(r)
    out = set()
    for session, members in sessions.items():
        by_uuid = {uuid_form(r["rec_uuid"]): r for r in members if r["rec_uuid"] is not None}

        def role(r):
            text = r["msg_role"] if r["msg_role"] is not None else r["rec_type"]
            text = (text or "").strip().lower()
            return text if text in ("user", "assistant") and r["is_sidechain"] is not True else None

        def parent(r):
            seen = 0
            while True:
                p = r["parent_uuid"]
                if not p:
                    return "root"
                r = by_uuid.get(uuid_form(p))
                if r is None or seen > len(members):
                    return "absent"
                if role(r):
                    return r["row_id"]
                seen += 1

        msgs = {r["row_id"]: r for r in members if role(r)}
        up = {i: parent(r) for i, r in msgs.items()}
        roots = [i for i, p in up.items() if p == "root"]
        if len(roots) != 1 or "absent" in up.values():
            continue
        child = defaultdict(list)
        for i, p in up.items():
            child[p].append(i)
        chain, at = [], roots[0]
        while at is not None and len(chain) <= len(msgs):
            chain.append(at)
            at = child[at][0] if len(child[at]) == 1 else None
        if len(chain) != len(msgs) or any(len(c) > 1 for c in child.values()):
            continue
        good = True
        for k, i in enumerate(chain):
            if role(msgs[i]) == "user":
                after = msgs[chain[k + 1]] if k + 1 < len(chain) else None
                good = good and after is not None and role(after) == "assistant" and holds(after["content_json"])
        if good:
            out |= {(session, k + 1, uuid_form(msgs[i]["rec_uuid"])) for k, i in enumerate(chain)}
    return out
