"""Language identification with hyperdimensional profiles.

Each of 64 symbols (a blank, a-z, and classes of other letters) has a random vector of +1 and -1. A trigram's
vector binds its letters' vectors, each permuted once for every place it stands before the last, by
elementwise product; a text's vector bundles (sums) those of its trigrams, and a language's prototype those of
its training texts. The prediction is the prototype with the largest cosine to the text.

Training needs only trigram totals a language, so the corpus is reduced to at most languages * 64^3 counts
before anything reaches the driver.

Defined cases: a null text or one without a letter gives `und` and score 0; rows without a language train
nothing; ties go to the first language in order; without training rows every text is `und`; repeated rows
score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.quality import held_out
from factloom.llm.shingles import random_words, small_batches

DIMENSIONS = 1024
SYMBOLS = 64
TRIGRAMS = SYMBOLS**3


@functools.cache
def _symbols() -> np.ndarray:
    """The symbol of each code point below 0x10000: 0 for no letter, 1-26 for a-z, 27-63 for other letters."""
    out = np.zeros(0x10000, dtype=np.int32)
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            out[i] = i - 96 if 97 <= i <= 122 else 27 + i % 37
    return out


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The bound vectors of the first two places, by symbol pair, and those of the last place."""
    bits = np.unpackbits(random_words(SYMBOLS * DIMENSIONS // 64, 31).view(np.uint8)).reshape(SYMBOLS, DIMENSIONS)
    v = bits.astype(np.float32) * 2 - 1
    pairs = np.roll(v, 2, axis=1)[:, None, :] * np.roll(v, 1, axis=1)[None, :, :]
    return pairs.reshape(SYMBOLS * SYMBOLS, DIMENSIONS), v


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    pairs, last = _letters()
    return pairs[codes >> 6] * last[codes & 63]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, trigram code) of each trigram, blanks squeezed and one before and after each text, and
    whether each text has a letter."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sym = _symbols()[np.minimum(code, 0xFFFF)]
    if len(high := np.flatnonzero(code > 0xFFFF)):
        each, which = np.unique(code[high], return_inverse=True)
        sym[high] = np.where([chr(c).isalpha() for c in each], 27 + each % 37, 0)[which]
    lens = np.array([len(t) for t in low], dtype=np.int64)
    ends = np.cumsum(lens + 1)  # the place of the blank after each text
    edge = np.zeros(len(code), dtype=bool)
    edge[0] = True
    edge[ends] = True
    keep = (sym > 0) | np.concatenate([[True], sym[:-1] > 0]) | edge
    at = np.flatnonzero(keep)
    s, e = sym[at], edge[at]
    grams = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
    inside = ~e[1:-1] & ((s[:-2] > 0) | (s[1:-1] > 0))
    of = np.searchsorted(ends, at[1:-1], "left")
    letters = np.bincount(of[s[1:-1] > 0], minlength=len(texts)) > 0 if len(of) else np.zeros(len(texts), bool)
    return of[inside], grams[inside], letters


def _counted(batches):
    totals: dict[str, np.ndarray] = {}
    for b in small_batches(batches, rows=4096):
        langs = b.column(0).to_pylist()
        of, grams, _ = trigrams(b.column(1).to_pylist())
        names = sorted(set(langs))
        which = np.array([names.index(x) for x in langs], dtype=np.int64)
        joint = np.bincount(which[of] * TRIGRAMS + grams, minlength=len(names) * TRIGRAMS).reshape(len(names), TRIGRAMS)
        for name, row in zip(names, joint, strict=True):
            totals[name] = totals.get(name, 0) + row
    for name, row in totals.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "gram": pa.array(at, pa.int64()), "n": pa.array(row[at], pa.int64())})


class Prototypes:
    def __init__(self, names: list[str], vectors: np.ndarray):
        self.names, self.vectors = names, vectors

    @classmethod
    def of(cls, counts) -> Prototypes:
        names = sorted(counts["lang"].unique())
        vectors = np.zeros((len(names), DIMENSIONS))
        for i, name in enumerate(names):
            own = counts[counts["lang"] == name]
            grams, n = own["gram"].to_numpy(), own["n"].to_numpy(dtype=float)
            for j in range(0, len(grams), 4096):
                vectors[i] += n[j : j + 4096] @ trigram_vectors(grams[j : j + 4096])
            vectors[i] /= np.linalg.norm(vectors[i]) or 1.0
        return cls(names, vectors)

    def compare(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        of, grams, letters = trigrams(texts)
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.names or not len(of):
            return best, score
        kinds, which = np.unique(grams, return_inverse=True)
        bundle = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        for j in range(0, len(kinds), 8192):
            part = (which >= j) & (which < j + 8192)
            width = min(8192, len(kinds) - j)
            counts = np.bincount(of[part] * width + which[part] - j, minlength=len(texts) * width).reshape(len(texts), width)
            bundle += counts.astype(np.float32) @ trigram_vectors(kinds[j : j + 8192])
        size = np.linalg.norm(bundle.astype(float), axis=1)
        cos = (bundle.astype(float) @ self.vectors.T) / np.where(size > 0, size, 1)[:, None]
        at = cos.argmax(axis=1)
        for i in np.flatnonzero(letters):
            best[i] = self.names[at[i]]
        return best, np.where(letters, np.clip(cos.max(axis=1), 0, 1), 0.0)


def _predicted(model: Prototypes):
    def run(batches):
        for b in small_batches_nullable(batches):
            names, score = model.compare(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return run


def small_batches_nullable(batches, rows: int = 64):
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)


def language_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> Prototypes:
    """Prototypes learned from the documents outside the held-out fold."""
    seen = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col), folds, fold))
    counts = seen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("body")).mapInArrow(_counted, "lang string, gram long, n long")
    return Prototypes.of(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())  # at most languages * 64^3 rows


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1) -> DataFrame:
    """id, held_out, lang_pred and score of every document."""
    model = language_profiles(docs, id_col, text_col, lang_col, folds, fold)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    out = rows.mapInArrow(_predicted(model), "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "lang_pred", "score")
