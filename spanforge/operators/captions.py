"""Caption text: pieces that fit a line, even splits, exact sums. Sequential within one text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most characters of a line, and of two neighbours that become one.
LINE, JOINED = 42, 50
#: Function words that should not end a line.
WEAK = frozenset("the a an of to in and or for with de la le et un une der die das und".split())


def wrapped(words: list[str], limit: int = LINE) -> list[str]:
    """Lines within a limit, as even as the number of lines allows; longer words are cut."""
    parts = [w[k : k + limit] for w in words for k in range(0, len(w), limit)]
    if not parts:
        return []
    least = -(-(sum(map(len, parts)) + len(parts) - 1) // limit)
    for goal in range(max(1, (sum(map(len, parts)) + len(parts) - 1) // least), limit + 1):
        lines = _filled(parts, goal, limit)
        if len(lines) <= least:
            return lines
    return _filled(parts, limit, limit)


def _filled(parts: list[str], goal: int, limit: int) -> list[str]:
    lines = [parts[0]]
    for word in parts[1:]:
        joined = f"{lines[-1]} {word}"
        if len(joined) <= max(goal, len(lines[-1])) and len(joined) <= limit:
            lines[-1] = joined
        else:
            lines.append(word)
    return lines


def packed(sentence: str, limit: int = LINE, joined: int = JOINED) -> list[str]:
    """Clauses of a sentence, long ones wrapped, short neighbours merged."""
    clauses = [c.strip() for c in re.split(r"(?<=[,;:])\s+", sentence) if c.strip()]
    pieces = [line for c in clauses for line in ([c] if len(c) <= limit else wrapped(c.split(), limit))]
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + 1 + len(piece) <= joined and not out[-1].endswith((".", "!", "?")):
            out[-1] = f"{out[-1]} {piece}"
        else:
            out.append(piece)
    return out


def rebalanced(pieces: list[str], limit: int = JOINED, passes: int = 3) -> list[str]:
    """Move function words at a line's end to the next line, as long as that one fits."""
    lines = [p.split() for p in pieces]
    for _ in range(passes):
        moved = False
        for a, b in zip(lines, lines[1:], strict=False):
            if len(a) > 1 and a[-1].lower() in WEAK and len(" ".join([a[-1], *b])) <= limit:
                b.insert(0, a.pop())
                moved = True
        if not moved:
            break
    return [" ".join(line) for line in lines]


def chunks(text: str) -> list[str]:
    """All pieces of a text, sentence by sentence."""
    sentences = [s.strip() for s in re.split(r"(?<=[.!?…])\s+", text) if s.strip()]
    return [p for s in sentences for p in rebalanced(packed(s))]


def exact_split(total: float, weights: list[float], low: float, high: float) -> list[float]:
    """Shares of a total in proportion to weights, each within bounds, with the exact sum.

    Whoever leaves the bounds is set to them and the rest is shared anew among the others;
    each round fixes one at least. Impossible bounds give even shares.
    """
    n = len(weights)
    if not n or not low * n <= total <= high * n:
        return [total / n] * n if n else []
    fixed: dict[int, float] = {}
    while True:
        open_ = [k for k in range(n) if k not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[k] for k in open_)
        share = {k: left * weights[k] / weight if weight else left / len(open_) for k in open_}
        short, long = sum(low - s for s in share.values() if s < low), sum(s - high for s in share.values() if s > high)
        out = {k: low for k, s in share.items() if s < low} if short >= long else {k: high for k, s in share.items() if s > high}
        if not out:
            result = [fixed.get(k, share.get(k, 0.0)) for k in range(n)]
            result[max(range(n), key=lambda k: result[k])] += total - sum(result)
            return result
        fixed |= out


def all_or_nothing(groups: list[list[tuple[float, float]]], gap: float) -> list[int]:
    """Groups admitted in order: a group enters only if each of its spans keeps the gap."""
    taken: list[tuple[float, float]] = []
    admitted = []
    for k, group in enumerate(groups):
        if all(a >= stop + gap or b <= start - gap for a, b in group for start, stop in taken):
            taken += group
            admitted.append(k)
    return admitted


def caption_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, idx, text``: caption pieces of every text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, piece) for k, t in zip(b[key], b[text], strict=True) for i, piece in enumerate(chunks(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "idx", "text"])

    return df.select(F.col(key), F.col(text)).mapInPandas(run, f"{key} {kind}, idx long, text string")
