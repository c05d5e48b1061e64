"""Sequential decisions: each looks back on what was decided before it.

A decision is a generator over one key's rows in order. Rows are sorted by key and order in
the JVM and stream through a task, so a decision holds only what it remembers itself: a few
rows or choices. A key with a third of all rows is a long stream and not a large group. Only
``match_anchors`` and ``resolve`` remember every id that they used for a key.
"""

from __future__ import annotations

import difflib
import hashlib
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Row = dict[str, object]
#: Result rows of one batch.
BATCH = 5_000


def streamed(df: DataFrame, key: str, order: list[str | Column], step: Callable[[Iterator[Row]], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``step`` to the stream of each key's rows in order."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], field.type) for k, field in enumerate(kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows = chain.from_iterable(b.to_pylist() for b in batches)
        for _, own in groupby(rows, key=lambda r: r[key]):
            for found in step(own):
                out.append(found)
                if len(out) == BATCH:
                    yield batch(out)
                    out = []
        yield batch(out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def draw(seed: str, options: Iterable[tuple[str, float]]) -> str:
    """Weighted draw from a digest of the seed; all weights 0 falls back to equal ones; '' if none."""
    listed = sorted(options)
    if not listed:
        return ""
    total = sum(w for _, w in listed)
    if total <= 0:
        listed, total = [(k, 1.0) for k, _ in listed], float(len(listed))
    u = int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16) / 2**32 * total
    upto = 0.0
    for name, weight in listed:
        upto += weight
        if u < upto:
            return name
    return listed[-1][0]


def run_allowed(values: list[str], candidate: str, limit: int) -> bool:
    """Would appending keep every run within the limit; only the tail matters."""
    return limit <= 0 or len(values) < limit or any(v != candidate for v in values[-limit:])


def repetition(rows: Iterator[Row], back: int = 8, near: float = 0.85, loose: float = 0.60) -> Iterator[tuple]:
    """``doc_id, idx, suggestion, similarity``: best of a line's predecessors by max(cosine, sequence ratio) of its tokens.

    Near-identical (both at least ``near``): the earlier line is cut. At least ``loose``: the
    later one is to review. The quick ratio bounds the ratio from above, so it saves most.
    """
    before: deque[tuple[object, list[str], Counter, float]] = deque(maxlen=back)
    for row in rows:
        own = row["tokens"].split(" ") if row["tokens"] else []
        bag = Counter(own)
        norm = sum(n * n for n in bag.values()) ** 0.5
        best = None
        for idx, other, counts, length in before if len(own) >= 3 else ():
            if len(other) < 3:
                continue
            cosine = sum(n * counts[w] for w, n in bag.items()) / (norm * length)
            # twice the shared tokens over all tokens bounds the ratio from above
            ratio = 2 * (bag & counts).total() / (len(own) + len(other))
            if ratio >= loose and (ratio > cosine or ratio >= near):
                ratio = difflib.SequenceMatcher(None, other, own, autojunk=False).ratio()
            high, low = max(cosine, ratio), min(cosine, ratio)
            if best is None or high > best[0]:
                best = (high, low, idx)
        if best and best[0] >= loose:
            cut = best[1] >= near
            yield row["doc_id"], best[2] if cut else row["idx"], "CUT" if cut else "REVIEW", round(best[0], 6)
        before.append((row["idx"], own, bag, norm))


def tangents(rows: Iterator[Row], below: float = 0.30, most: int = 10) -> Iterator[tuple]:
    """``doc_id, first_idx, last_idx, n_rows``: a marked line starts a run that goes on while the overlap with the subject is low."""
    run = None
    for row in rows:
        if run and run[3] <= most and row["overlap"] < below:
            run = (*run[:2], row["idx"], run[3] + 1)
            continue
        if run:
            yield run
        run = (row["doc_id"], row["idx"], row["idx"], 1) if row["marked"] else None
    if run:
        yield run


def gap_select(rows: Iterator[Row], gap: float, cap: int) -> Iterator[tuple]:
    """Accept what keeps a gap from everything accepted, up to a cap. Rows come by importance, then time."""
    taken: list[float] = []
    for row in rows:
        if len(taken) < cap and all(abs(row["start"] - t) >= gap for t in taken):
            taken.append(row["start"])
            yield tuple(row.values())


def match_anchors(rows: Iterator[Row]) -> Iterator[tuple]:
    """One-to-one pairs of boundaries and pauses. Rows come nearest first."""
    used_a, used_b = set(), set()
    for row in rows:
        if row["event_id"] not in used_a and row["anchor_id"] not in used_b:
            used_a.add(row["event_id"])
            used_b.add(row["anchor_id"])
            yield row["user_id"], row["event_id"], row["anchor_id"], row["distance"]


def align_words(rows: Iterator[Row]) -> Iterator[tuple]:
    """``conv_id, turn, matched, n_words``: longest-matching-block alignment of a text's words with the next row's."""
    before = None
    for row in rows:
        own = str(row["text"]).lower().split()
        if before:
            blocks = difflib.SequenceMatcher(None, before[2], own, autojunk=False).get_matching_blocks()
            yield before[0], before[1], sum(b.size for b in blocks), len(before[2])
        before = (row["conv_id"], row["turn"], own)


def direct(rows: Iterator[Row], weights: dict[str, float], seed: str, run_limit: int = 2, memory: int = 3) -> Iterator[tuple]:
    """``user_id, event_id, composition``: weights, gates, run limit and recent options."""
    chosen: list[str] = []
    for row in rows:
        blocked = {"wide"} if row["value"] < 20 else {"close"} if row["value"] > 250 else set()
        open_ = {k: w * (0.4 if k in chosen[-memory:] else 1.0) for k, w in weights.items() if k not in blocked}
        fit = {k: w for k, w in open_.items() if run_allowed(chosen, k, run_limit)} or open_
        pick = draw(f"{seed}|{row['user_id']}|{row['event_id']}", fit.items())
        chosen = [*chosen, pick][-max(memory, run_limit) :]
        yield row["user_id"], row["event_id"], pick


def treat(rows: Iterator[Row], weights: dict[str, float], seed: str, calm: str = "hold", window: int = 7, run_limit: int = 2) -> Iterator[tuple]:
    """``user_id, event_id, treatment``: decaying memory, a calm floor on a window and a cap on runs."""
    chosen: list[str] = []
    decay = (0.3, 0.55, 0.7)
    for row in rows:
        recent = chosen[-window + 1 :]
        if len(recent) == window - 1 and calm not in recent:
            pick = calm
        else:
            fit = {}
            for k, w in weights.items():
                for back, factor in enumerate(decay, 1):
                    if len(chosen) >= back and chosen[-back] == k:
                        w *= factor
                        break
                if run_allowed(chosen, k, run_limit):
                    fit[k] = w
            pick = draw(f"{seed}|{row['user_id']}|{row['event_id']}", fit.items()) or calm
        chosen = [*chosen, pick][-max(window, run_limit, len(decay)) :]
        yield row["user_id"], row["event_id"], pick


def resolve(rows: Iterator[Row], penalty: float = 0.2, family_penalty: float = 0.05) -> Iterator[tuple]:
    """``plan, req, cand, score``: best candidate for each request in order; earlier uses and recent families cost score."""
    uses: dict[int, int] = {}
    recent: deque[str] = deque(maxlen=2)
    for req, own in groupby(rows, key=lambda r: r["req"]):
        best = None
        for c in own:
            score = c["score"] - penalty * uses.get(c["cand"], 0) - family_penalty * recent.count(c["family"])
            if best is None or score > best[0]:
                best = (score, c["cand"], c["family"], c["plan"])
        uses[best[1]] = uses.get(best[1], 0) + 1
        recent.append(best[2])
        yield best[3], req, best[1], round(best[0], 6)
