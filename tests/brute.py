"""Plain single-process versions of the operators, written from the problem statements."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import defaultdict
from zoneinfo import ZoneInfo, available_timezones

ZONES = available_timezones()
EPOCH = dt.datetime(1970, 1, 1)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
NAMES = {"UTC": 0, "GMT": 0, "Z": 0, "z": 0, "JST": 540, "PDT": -420, "PST": -480, "EDT": -240, "EST": -300, "AEDT": 660,
         "AEST": 600, "CET": 60, "CEST": 120, "BST": 60}


def uuid_form(text):
    if text is None:
        return None
    bare = text.lower().removeprefix("urn:uuid:")
    if bare.startswith("{") and bare.endswith("}"):
        bare = bare[1:-1]
    hexes = bare.replace("-", "")
    if re.fullmatch("[0-9a-f]{32}", hexes):
        return "-".join((hexes[:8], hexes[8:12], hexes[12:16], hexes[16:20], hexes[20:]))
    return text


def zoned_us(local: dt.datetime, zone: str):
    z = ZoneInfo(zone)
    early = local.replace(tzinfo=z, fold=0)
    return (local - early.utcoffset() - EPOCH) // dt.timedelta(microseconds=1)


def instant(text, zone):
    if text is None:
        return None
    text = text.strip(" ")
    m = re.fullmatch(r"(-?)(\d{1,19})(?:\.(\d+))?", text)
    if m:
        n = int(m[2])
        frac = int(((m[3] or "") + "000000")[:6])
        if n < 10**11:
            us = n * 10**6 + frac
        elif n < 10**14:
            us = n * 1000 + frac // 1000
        elif n < 10**17:
            us = n
        else:
            us = n // 1000
        return -us if m[1] else us
    zpart = r" ?(?P<z>[A-Za-z]+(?:/\w+)*|[+-]\d\d(?::?\d\d)?)?(?:\[(?P<b>[^\]]+)\])?"
    shapes = (
        r"(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)[Tt ](?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)(?:[.,](?P<f>\d+))?" + zpart,
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)[Tt](?P<H>\d\d)(?P<M>\d\d)(?P<S>\d\d)" + zpart,
        r"(?P<d>\d\d)\.(?P<m>\d\d)\.(?P<y>\d{4}) (?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)" + zpart,
        r"(?P<d>\d\d)/(?P<mon>\w{3})/(?P<y>\d{4}):(?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)" + zpart,
        r"\w{3}, (?P<d>\d\d) (?P<mon>\w{3}) (?P<y>\d{4}) (?P<H>\d\d):(?P<M>\d\d):(?P<S>\d\d)" + zpart,
        r"(?P<mon>\w{3}) (?P<d>\d{1,2}), (?P<y>\d{4}) (?P<H>\d{1,2}):(?P<M>\d\d):(?P<S>\d\d) (?P<half>[AP])M",
    )
    for shape in shapes:
        m = re.fullmatch(shape, text)
        if not m:
            continue
        g = m.groupdict()
        if g.get("mon"):
            if g["mon"].lower() not in MONTHS:
                return None
            month = MONTHS.index(g["mon"].lower()) + 1
        else:
            month = int(g["m"])
        hour = int(g["H"])
        if g.get("half"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if g["half"] == "P" else 0)
        us = int(((g.get("f") or "") + "000000")[:6])
        try:
            local = dt.datetime(int(g["y"]), month, int(g["d"]), hour, int(g["M"]), int(g["S"]), us)
        except ValueError:
            return None
        z = g.get("z") or g.get("b") or ""
        if z in NAMES:
            return (local - EPOCH) // dt.timedelta(microseconds=1) - NAMES[z] * 60_000_000
        if z[:1] in ("+", "-"):
            digits = z[1:].replace(":", "") + "00"
            off = (int(digits[:2]) * 60 + int(digits[2:4])) * (-1 if z[0] == "-" else 1)
            return (local - EPOCH) // dt.timedelta(microseconds=1) - off * 60_000_000
        if z and (z not in ZONES or "/" not in z):
            return None
        z = z or zone
        return zoned_us(local, z) if z in ZONES else None
    return None


def copies(rows, key):
    """Row ids to drop; rows are dicts with row_id."""
    first, drop = {}, set()
    for r in sorted(rows, key=lambda r: r["row_id"]):
        k = key(r)
        if k is None or None in (k if isinstance(k, tuple) else ()):
            continue
        if k in first:
            drop.add(r["row_id"])
        else:
            first[k] = r["row_id"]
    return drop


def transcript_key(r):
    return uuid_form(r["session_id"]), uuid_form(r["rec_uuid"])


def content_blocks(text):
    """(path tuple, block) of a content JSON text."""
    out = []

    def go(value, base):
        if isinstance(value, str):
            try:
                inner = json.loads(value)
            except ValueError:
                inner = None
            if not (isinstance(inner, list) and all(x is None or isinstance(x, dict) for x in inner)):
                inner = [{"type": "text", "text": value}]
            value = inner
        if isinstance(value, dict):
            value = [value]
        if not isinstance(value, list):
            return
        for i, b in enumerate(value):
            if isinstance(b, dict):
                out.append(((*base, i), b))
                if "content" in b:
                    go(b["content"], (*base, i))

    if text is not None:
        try:
            go(json.loads(text), ())
        except ValueError:
            pass
    return out


def blocks(rows):
    drop = copies(rows, transcript_key)
    kept = [r for r in rows if r["row_id"] not in drop]
    uses, every = {}, []
    for r in sorted(kept, key=lambda r: r["row_id"]):
        for path, b in content_blocks(r["content_json"]):
            every.append((r, path, b))
    for r, path, b in sorted(every, key=lambda x: (x[0]["row_id"], x[1])):
        if b.get("type") == "tool_use" and b.get("id") is not None and r["session_id"] is not None:
            uses.setdefault((uuid_form(r["session_id"]), b["id"]), (r["row_id"], path))
    out = set()
    for r, path, b in every:
        link = uses.get((uuid_form(r["session_id"]), b.get("tool_use_id"))) if b.get("type") == "tool_result" else None
        dots = lambda p: ".".join(map(str, p))
        out.add((r["row_id"], dots(path), b.get("type") or "", link[0] if link else -1, dots(link[1]) if link else ""))
    return out


def stretches(events, gap):
    """(key, start, end, count) of (key, time) pairs."""
    by = defaultdict(list)
    for k, t in events:
        by[k].append(t)
    out = set()
    for k, ts in by.items():
        ts.sort()
        start, last, n = ts[0], ts[0], 0
        for t in ts:
            if t - last > gap:
                out.add((*k, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.add((*k, start, last, n))
    return out


def periods(rows):
    by = defaultdict(list)
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and t > s:
            by[e].append((s, t))
    out = set()
    for e, spans in by.items():
        merged = []
        for s, t in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out |= {(e, "period", *m) for m in merged}
        out |= {(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out
