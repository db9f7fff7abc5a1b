"""A small pure-Python model of the scrub semantics, for tests only.

It uses Python's ``re`` on the fixed rule texts, so it checks the Java
dialect translation and the array-expression plan independently.
"""

from __future__ import annotations

import re

from redactflow.operators.boost import ANCHOR_WORDS
from redactflow.operators.rules import DEFAULT_RULES, NAME_BLOCKLIST, NAME_TOKEN_SHAPE, active_rules


def is_name(v: str) -> bool:
    toks = v.split()
    return 2 <= len(toks) <= 4 and all(
        re.fullmatch(NAME_TOKEN_SHAPE, t) and t.lower() not in NAME_BLOCKLIST for t in toks)


def window_hits(content: str, rules) -> list[tuple]:
    hits = []
    for r in rules:
        flags = re.IGNORECASE if r.ignore_case else 0
        ms = [re.match(r.pattern, content, flags)] if r.anchored else list(re.finditer(r.pattern, content, flags))
        for m in ms:
            if m is None:
                continue
            s, e, t = (m.start(1), m.end(1), m.group(1)) if r.group else (m.start(), m.end(), m.group())
            if r.name_check and not is_name(t):
                continue
            hits.append((s, e, t, r.entity_type, r.confidence, r.rank))
    best = {}
    for h in hits:  # per (s, e): highest confidence, first emitted on ties
        k = (h[0], h[1])
        if k not in best or h[4] > best[k][4]:
            best[k] = h
    return list(best.values())


def entities(text: str, threshold: float = 0.93, size: int = 500, overlap: int = 100, boost: bool = True):
    rules = active_rules(threshold, DEFAULT_RULES)
    found = {}
    order = []
    for wid, st in enumerate(range(0, len(text), size - overlap)):
        for s, e, t, ty, c, _ in sorted(window_hits(text[st:st + size], rules), key=lambda h: h[0]):
            key = (s + st, e + st, ty, t)
            if key not in found:
                found[key] = [c, wid]
                order.append(key)
            elif c > found[key][0]:
                found[key][0] = c
    keys = sorted(order, key=lambda k: (k[0], k[1], found[k][1]))
    urls = [k for k in keys if k[2] == "URL"]
    keys = [k for k in keys if not (k[2] == "PROFILE_HANDLE" and any(u[0] <= k[0] and u[1] >= k[1] for u in urls))]
    out = []
    for k in keys:
        c = found[k][0]
        if boost:
            sl = text[max(0, k[0] - 100):k[1] + 100].lower()
            add = 0.0
            for words in ANCHOR_WORDS.values():
                if any(w in sl for w in words):
                    add += 0.05
            c = min(c + add, 1.0)
        out.append((k[0], k[1], k[3], k[2], c, found[k][1]))
    return out


def redact(text: str, ents, repl) -> str:
    for s, e, t, ty, c, w in sorted(ents, key=lambda x: x[0], reverse=True):
        text = text[:s] + repl(t, ty) + text[e:]
    return text
