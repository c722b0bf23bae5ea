"""Snippet text for one document (F11, X13): a small per-row helper.

Walk the content's tokens in order; a token ending more than ``MAX_CHARS``
characters after the current fragment's start opens a new fragment at that
token. A fragment scores the sum of the weights of the query terms it
contains (weight = 1 / (1 + document frequency in content)). The best
fragment (earliest on ties, scores compared at 9 decimals so the summation
order cannot matter) is returned with every matched token wrapped in
``<<`` and ``>>``; no matching token gives no snippet.
"""

from __future__ import annotations

import regex

# Fixed values of the snippet generator.
MAX_CHARS = 150
OPEN, CLOSE = "<<", ">>"
_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_MAX_TOKEN_BYTES = 40


def best_fragment(text: str | None, weights: dict[str, float]) -> str | None:
    if not text or not weights:
        return None
    best = None  # (score, start, stop, ranges)
    start, stop, score, ranges = 0, 0, 0.0, []
    for m in _TOKEN.finditer(text):
        tok = m.group()
        if len(tok.encode("utf-8")) >= _MAX_TOKEN_BYTES:
            continue
        if m.end() > start + MAX_CHARS:
            if score > 0 and (best is None or round(score, 9) > best[0]):
                best = (round(score, 9), start, stop, ranges)
            start, score, ranges = m.start(), 0.0, []
        stop = m.end()
        w = weights.get(tok.lower())
        if w is not None:
            score += w
            ranges.append((m.start(), m.end()))
    if score > 0 and (best is None or round(score, 9) > best[0]):
        best = (round(score, 9), start, stop, ranges)
    if best is None:
        return None
    _, start, stop, ranges = best
    out, prev = [], start
    for a, b in ranges:
        out.append(text[prev:a])
        out.append(OPEN + text[a:b] + CLOSE)
        prev = b
    out.append(text[prev:stop])
    return "".join(out)
