"""Periodic runs of words by the divide and conquer of Main and Lorentz.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least
max(`min_words`, 2 q) words. A text's words are interned as numbers. A segment is cut at its midpoint; two
Z-functions, of the right half followed by the left and of both reversed, give for every shift q how far the
words around the midpoint agree with those q further, hence every repetition that meets the midpoint. Those that
reach the segment's ends are extended over the text, repetitions inside a run of a smaller period are dropped,
and both halves follow. A run found again from another midpoint is recognised by its interval.

Two words q apart are equal all along a run, so a repetition inside a segment needs a gram of min_words / 2 words
that occurs twice there; segments without one are closed at once, and the others shrink to the span of such
grams. That test compares 64-bit sums: equal grams have equal sums, so it can only keep a segment too many.

A text costs O(n log n) steps however periodic it is, and no text meets another, so there is no shuffle.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; a null id is a row like
any other; repeated rows get the same answer each; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import bodies_of

MIN_WORDS = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def z_function(s: list[int]) -> np.ndarray:
    """Of each place, how many items from there on agree with the start; the last item must occur once."""
    n, z, left, right, i = len(s), [0] * len(s), 0, 0, 1
    while i < n:
        if i >= right:
            try:
                i = s.index(s[0], i)  # places that differ at once are passed over
            except ValueError:
                break
            k = 0
        else:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                i += 1
                continue
            k = right - i
        while s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
        i += 1
    return np.asarray(z, dtype=np.int64)


def _agreed(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(periods, matches to the left of the midpoint, matches to the right, whether the shifted copy lies left).

    For a shift to the right the words from the midpoint on meet those q further; for one to the left, those q
    before it meet the midpoint.
    """
    nu, nv = len(u), len(v)
    ahead = z_function([*v.tolist(), -1, *u.tolist(), -2])
    back = z_function([*u[::-1].tolist(), -1, *v[::-1].tolist(), -2])
    qv, qu = np.arange(1, nv + 1), np.arange(1, nu + 1)
    v_in_v, u_in_u = ahead[qv], back[qu]
    u_in_v, v_in_u = back[nu + 1 + nv - qv], ahead[nv + 1 + nu - qu]
    # where a whole period agrees, the agreement goes on on the other side of the midpoint
    both = min(nu, nv)
    whole = u_in_v[:both] == qv[:both]
    other = v_in_u[:both] == qu[:both]
    u_in_v[:both] += np.where(whole, u_in_u[:both], 0)
    v_in_u[:both] += np.where(other, v_in_v[:both], 0)
    return (np.concatenate([qv, qu]), np.concatenate([u_in_v, u_in_u]), np.concatenate([v_in_v, v_in_u]), np.repeat([False, True], [nv, nu]))


def _extended(w: np.ndarray, start: int, end: int, q: int) -> tuple[int, int]:
    """The interval of period q that holds [start, end), as far as it goes in both directions."""
    step = 64
    while start:
        lo = max(0, start - step)
        differ = np.flatnonzero(w[lo:start] != w[lo + q : start + q])
        if len(differ):
            start = lo + int(differ[-1]) + 1
            break
        start, step = lo, step * 2
    step = 64
    while end < len(w):
        hi = min(len(w), end + step)
        differ = np.flatnonzero(w[end:hi] != w[end - q : hi - q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = hi, step * 2
    return start, end


def _repeats(w: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, the next and the last place with an equal gram (the length of w and -1 where there is none)."""
    n = len(w) - gram + 1
    sums, factor = np.zeros(n, dtype=np.uint64), 1
    for k in range(gram):
        sums += w[k : k + n].astype(np.uint64) * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    after, before = np.full(n, len(w), dtype=np.int64), np.full(n, -1, dtype=np.int64)
    order = np.argsort(sums, kind="stable")
    same = np.flatnonzero(sums[order[1:]] == sums[order[:-1]])
    after[order[same]], before[order[same + 1]] = order[same + 1], order[same]
    return after, before


class _Found:
    """The runs of a text so far, by period."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def holding(self, q: int, start: int, end: int) -> tuple[int, int] | None:
        at = self.runs.get(q, [])
        i = bisect.bisect_right(at, (start, 1 << 62)) - 1
        return at[i] if i >= 0 and at[i][1] >= end else None

    def add(self, q: int, run: tuple[int, int]) -> None:
        bisect.insort(self.runs.setdefault(q, []), run)


def runs_of(w: np.ndarray, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers w, by start and period."""
    gram = max(1, min_words // 2)
    if len(w) < max(2, min_words):
        return []
    after, before = _repeats(w, gram)
    found, todo = _Found(), [(0, len(w))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < max(2, min_words):
            continue
        last = hi - gram
        starts = np.flatnonzero(after[lo : last + 1] <= last)
        if not len(starts):
            continue
        ends = np.flatnonzero(before[lo : last + 1] >= lo)
        lo, hi = lo + int(starts[0]), lo + int(ends[-1]) + gram
        mid = (lo + hi) // 2
        q, left, right, shifted = _agreed(w[lo:mid], w[mid:hi])
        start = mid - left - np.where(shifted, q, 0)
        end = mid + right + np.where(shifted, 0, q)
        fit = np.flatnonzero(end - start >= np.maximum(2 * q, min_words))
        fit = fit[np.argsort(q[fit], kind="stable")]
        q, start, end = q[fit], start[fit], end[fit]
        while len(q):
            p, s, e = int(q[0]), int(start[0]), int(end[0])
            run = found.holding(p, s, e)
            if run is None:
                run = _extended(w, s, e, p) if s == lo or e == hi else (s, e)
                found.add(p, run)
            # what lies inside a run and has a period of at least its own is that run or a multiple of its period
            open_ = (start < run[0]) | (end > run[1])
            q, start, end = q[open_], start[open_], end[open_]
        todo += [(lo, mid), (mid, hi)]
    return sorted((s, e - s, q) for q, at in found.runs.items() for s, e in at)


def collapse(words: list[bytes], min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """The runs of a text's words, and the words that no run holds after its first period."""
    number = {x: i for i, x in enumerate(dict.fromkeys(words))}
    runs = runs_of(np.array([number[x] for x in words] if len(words) else [], dtype=np.int64), min_words) if len(number) < len(words) else []
    if not runs:
        return runs, words
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return runs, [words[i] for i in np.flatnonzero(kept)]


def _strings(values: list[bytes]) -> pa.StringArray:
    held = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(held), held.buffers()[1], held.buffers()[2])


def _answers(min_words: int):
    def answer(batches):
        for batch in batches:
            counts, offsets, rows, kept = [], [0], [], []
            for body in batch.column(1).cast(pa.binary()):
                words = body.as_py().split()
                runs, rest = collapse(words, min_words)
                counts.append(len(words))
                rows += runs
                offsets.append(len(rows))
                kept.append(b" ".join(rest))
            columns = np.array(rows, dtype=np.int64).reshape(-1, 3).T
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], fields=list(_RUN))
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, _strings(kept)], names=["id", "n_words", "runs", "collapsed"])

    return answer


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, n_words, runs (start, length, period; by start and period) and collapsed (the words that no run repeats,
    joined by one blank) of every document. Words are what ASCII white space separates."""
    return bodies_of(docs, id_col, text_col).mapInArrow(_answers(min_words), SCHEMA).withColumnRenamed("id", id_col)
