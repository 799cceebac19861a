"""Quality scores by a generalised additive model with pairwise interactions.

Surface features of the whole text are cut into quantile bins. Training cycles over the features many times;
each turn fits one shallow tree to the residuals on the feature's bin histogram and adds a small part of its
leaves to the feature's lookup table. The pairs whose joint bins still explain most residual then get tables
of their own, boosted the same way with one cut an axis. A score is the logistic of the intercept plus the
table entries of the document's bins, added for whole batches at once.

The model is fitted on at most `sample_rows` labelled rows, those with the smallest hash of their id; every
document is scored. Labels, ids and other columns never enter the features.

Defined cases: a null text counts as empty and is scored like any other; repeated rows score alike; ids with
several labels train once a label; without labelled rows every score is 0.5; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bodies_of, written
from factloom.llm.shingles import small_batches, utf8, word_fingerprints

SAMPLE_ROWS = 20_000
BINS = 32
FEATURES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "stop_marks", "loud_marks", "symbols", "blank",
    "line_ends", "non_ascii", "repeated_marks", "distinct_words", "top_word", "short_words", "long_words", "marked_words", "vowels",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[list(chars)] = 1
    return out


_UPPER = _class(bytes(range(ord("A"), ord("Z") + 1)))
_DIGIT = _class(b"0123456789")
_STOP = _class(b".,;:")
_LOUD = _class(b"!?")
_SYMBOL = _class(b"#$%&*@~^|<>{}[]\\/=+_`")
_BLANK = _class(b" \t\r\v\f")
_LINE = _class(b"\n")
_HIGH = _class(bytes(range(0xC0, 0x100)))
_VOWEL = _class(b"aeiouyAEIOUY")
_MARK = _STOP | _LOUD | _SYMBOL


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a string column without nulls."""
    data, offsets = utf8(column)
    n, sizes = len(column), np.diff(offsets).astype(float)
    least = np.maximum(sizes, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / least

    mark = _MARK[data]
    doubled = np.zeros(len(data), dtype=np.uint8)
    if len(data) > 1:
        doubled[1:] = mark[1:] & (data[1:] == data[:-1])
    of, words = word_fingerprints(data, offsets)
    bounds = np.searchsorted(of, np.arange(n + 1))
    counts = np.diff(bounds).astype(float)
    some = np.maximum(counts, 1)
    distinct, top = np.ones(n), np.zeros(n)
    order = np.lexsort((words, of))
    so, sw = of[order], words[order]
    first = np.ones(len(sw), dtype=bool)
    first[1:] = (sw[1:] != sw[:-1]) | (so[1:] != so[:-1])
    at = np.flatnonzero(first)
    if len(at):
        runs = np.diff(np.concatenate([at, [len(sw)]]))
        distinct = np.bincount(so[at], minlength=n) / some
        np.maximum.at(top, so[at], runs)
        top /= some
    space = _BLANK[data] | _LINE[data]
    begin = np.ones(len(data), dtype=bool)
    begin[1:] = space[:-1].astype(bool)
    begin[offsets[:-1][sizes > 0]] = True
    starts = np.flatnonzero(begin & ~space.astype(bool)) if len(data) else np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    stops = np.minimum(np.concatenate([starts[1:], [len(data)]])[: len(starts)], offsets[text + 1]) if len(starts) else starts
    length = stops - starts - 1
    marked = np.zeros(len(starts))
    if len(starts):
        sums = np.concatenate([[0], np.cumsum(_LOUD[data] | _SYMBOL[data], dtype=np.int64)])
        marked = sums[stops] > sums[starts]
    by = lambda flags: np.bincount(text, weights=flags.astype(float), minlength=n) / some
    return np.stack(
        [
            np.log1p(sizes), np.log1p(counts), sizes / some, share(_UPPER[data]), share(_DIGIT[data]), share(_STOP[data]), share(_LOUD[data]), share(_SYMBOL[data]), share(_BLANK[data]),
            share(_LINE[data]), share(_HIGH[data]), share(doubled), distinct, top, by(length <= 3), by(length > 12), by(marked), share(_VOWEL[data]),
        ],
        axis=1,
    )


class AdditiveModel:
    """Cuts, lookup tables and pair tables; `fit` trains them, `score` adds them up."""

    def __init__(self, cuts, tables, pairs, intercept: float):
        self.cuts, self.tables, self.pairs, self.intercept = cuts, tables, pairs, intercept

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_count: int = 8, pair_rounds: int = 60, rate: float = 0.1, leaf: int = 3) -> AdditiveModel:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for i in range(m)]
        model = cls(cuts, [np.zeros(len(c) + 1) for c in cuts], [], 0.0)
        if not n:
            return model
        b = model.bins(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model.intercept = float(np.log(mean / (1 - mean)))
        z = np.full(n, model.intercept)
        for _ in range(rounds):
            for i in range(m):
                p = 1 / (1 + np.exp(-z))
                size = len(cuts[i]) + 1
                g, h = np.bincount(b[:, i], y - p, size), np.bincount(b[:, i], p * (1 - p), size)
                step = rate * _tree(g, h, leaf)
                model.tables[i] += step
                z += step[b[:, i]]
        p = 1 / (1 + np.exp(-z))
        gains = []
        for i in range(m):
            for j in range(i + 1, m):
                g, h = _joint(b, i, j, y - p, cuts), _joint(b, i, j, p * (1 - p), cuts)
                gains.append((_quadrants(g, h)[0], i, j))
        for _, i, j in sorted(gains, reverse=True)[:pair_count]:
            table = np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1))
            for _ in range(pair_rounds):
                p = 1 / (1 + np.exp(-z))
                step = rate * _quadrants(_joint(b, i, j, y - p, cuts), _joint(b, i, j, p * (1 - p), cuts))[1]
                table += step
                z += step[b[:, i], b[:, j]]
            model.pairs.append((i, j, table))
        return model


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The step of a tree of at most `leaves` leaves on one feature's histogram of gradients and curvatures."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda lo, hi: (gs[hi] - gs[lo]) ** 2 / (hs[hi] - hs[lo] + 1.0)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gain = value(lo, at) + value(at, hi) - value(lo, hi)
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), (k, int(at[i]))), key=lambda t: t[0])
        if best[1] is None:
            break
        k, at = best[1]
        parts[k : k + 1] = [(parts[k][0], at), (at, parts[k][1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = (gs[hi] - gs[lo]) / (hs[hi] - hs[lo] + 1.0)
    return out


def _joint(b: np.ndarray, i: int, j: int, w: np.ndarray, cuts) -> np.ndarray:
    width = len(cuts[j]) + 1
    return np.bincount(b[:, i] * width + b[:, j], w, (len(cuts[i]) + 1) * width).reshape(-1, width)


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best one-cut-an-axis tree on a joint histogram: its gain and its step."""
    pad = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    gs, hs = pad(g), pad(h)
    at = np.ix_(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]))

    def four(s):
        low = s[at]
        return low, s[1:-1, -1:] - low, s[-1:, 1:-1] - low, s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + low

    if 1 in g.shape:
        return 0.0, np.zeros(g.shape)
    gq, hq = four(gs), four(hs)
    gain = sum(a * a / (np.maximum(c, 0) + 1.0) for a, c in zip(gq, hq, strict=True)) - gs[-1, -1] ** 2 / (hs[-1, -1] + 1.0)
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    ll, lh, hl, hh = (a[r, c] / (max(k[r, c], 0) + 1.0) for a, k in zip(gq, hq, strict=True))
    step = np.empty(g.shape)
    step[: r + 1, : c + 1], step[: r + 1, c + 1 :], step[r + 1 :, : c + 1], step[r + 1 :, c + 1 :] = ll, lh, hl, hh
    return float(gain[r, c]), step


def _featured(batches):
    for b in small_batches(batches, rows=2048):
        x = features(b.column(1)).astype(np.float32)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column(0), flat, *b.columns[2:]], ["id", "x", *b.schema.names[2:]])


def _scored(model: AdditiveModel):
    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x)), *b.columns[2:]], ["id", "score", *b.schema.names[2:]])

    return run


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", with_sha: bool = False) -> DataFrame:
    """id, held_out, score and predicted (1 where score >= threshold) of every document, and `with_sha` its text_sha256."""
    rows, more = bodies_of(docs, id_col, text_col), ["text_sha256"] if with_sha else []
    if with_sha:
        rows = rows.withColumn("text_sha256", F.sha2("body", 256))
    own = ", text_sha256 string" if with_sha else ""
    x = written(rows.mapInArrow(_featured, f"id long, x array<float>{own}"), "features")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null")
    seen = x.join(known.filter(~held_out(F.col("id"), folds, fold)), "id")
    sample = seen.orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows).toPandas()  # bounded by sample_rows
    xs = np.array(sample["x"].tolist(), dtype=float).reshape(len(sample), len(FEATURES))
    model = AdditiveModel.fit(xs, (sample["y"].to_numpy() > 0).astype(float))
    scored = x.mapInArrow(_scored(model), f"id long, score double{own}")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)
