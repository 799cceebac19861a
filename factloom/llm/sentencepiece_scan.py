"""SentencePiece encoding and decoding by a max-plus scan.

A text (blanks written as U+2581, one put before it) is cut into the pieces of a SentencePiece vocabulary so
that the sum of their scores is largest; characters outside the vocabulary become byte pieces. Scores are
whole numbers, so sums are exact and the scan is associative. Among equal sums the longest last piece wins.

Words repeat, so an ordinary text is the concatenation of its words' pieces, each distinct word solved once in
a batched lattice (no piece holds a blank after its first character or a line end; this is checked on loading).
A giant text is cut into chunks at any character. A chunk's boundary state is how far the piece that crosses
its end reaches into the next chunk. Then:
  1. each chunk yields its transfer matrix (best sum from each entry state to each exit state);
  2. matrices are combined by an associative max-plus scan, a tree of groups of FAN, into the sums with which each
     chunk is entered;
  3. each chunk maps its exit states to entry states; the maps, composed from the end, fix every boundary;
  4. each chunk is traced back by itself.
The result equals that of one pass over the text, piece by piece.

The vocabulary file is one of a byte-pair model whose scores are merge ranks. This operator takes them as the
scores of a lattice, as the scan needs, so ids differ from those of merging in rank order; decoding is exact
for either.

Defined cases: a null text counts as empty; an empty text has no ids; U+2581 in a text decodes as a blank;
repeated rows are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bodies_of, give_back, written
from factloom.llm.shingles import mix64, powers, random_words, small_batches

BLANK = "▁"
GIANT_CHARS = 1 << 16
CHUNK_CHARS = 4096
FAN = 64
MEMO_WORDS = 300_000
FLOOR = -(10**9)
NONE = np.int64(-(1 << 61))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


class Vocabulary:
    """Pieces by id with whole-number scores, and a hash table from substrings to ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.scores = np.zeros(n + 1, dtype=np.int64)
        self.scores[:n] = [round(model.get_score(i)) for i in range(n)]
        ordinary = [i for i in ordinary if self.scores[i] > FLOOR]  # those at the floor are runs of blanks, never in use
        if self.scores[ordinary].max() > 0:
            raise ValueError("piece scores must not be above 0")
        self.unknown = n  # stands for one character that is spelled in bytes
        self.scores[n] = self.scores[ordinary].min() - 10
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[self.bytes] = True
        self.longest = max(len(self.pieces[i]) for i in ordinary)
        inner = [self.pieces[i] for i in ordinary]
        self.by_word = not any("\n" in p or " " in p or BLANK in p.lstrip(BLANK) for p in inner)
        self.dtype = np.dtype("<u2") if n < 1 << 16 else np.dtype("<u4")
        self._table(ordinary)
        self.memo: dict[str, bytes] = {}

    def _table(self, ordinary: list[int]) -> None:
        codes = [np.frombuffer(self.pieces[i].encode("utf-32-le"), dtype=np.uint32) for i in ordinary]
        flat = np.concatenate(codes)
        ends = np.cumsum([len(c) for c in codes])
        sums = _sums(flat)
        keys = _hash(sums, ends - [len(c) for c in codes], ends)
        self.bits = 20
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        first = np.ones(len(order), dtype=bool)
        first[1:] = slot[order][1:] != slot[order][:-1]
        main, rest = order[first], order[~first]
        self.slot_key, self.slot_id = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)
        self.slot_key[slot[main]], self.slot_id[slot[main]] = keys[main], np.array(ordinary)[main]
        self.crowded = np.zeros(1 << self.bits, dtype=bool)
        self.crowded[slot[rest]] = True
        rest = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_id = keys[rest], np.array(ordinary, dtype=np.int32)[rest]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece id of each substring hash, or -1."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.slot_key[slot] == keys, self.slot_id[slot], np.int32(-1))
        crowded = np.flatnonzero(self.crowded[slot] & (out < 0))
        if len(crowded):
            at = np.minimum(np.searchsorted(self.rest_key, keys[crowded]), len(self.rest_key) - 1)
            out[crowded] = np.where(self.rest_key[at] == keys[crowded], self.rest_id[at], -1)
        return out

    def edges(self, texts: list[str]) -> np.ndarray:
        """[text, start, length - 1] -> piece id, -1 where there is none; texts padded to the longest."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.concatenate([[0], np.cumsum(lens)])
        of = np.repeat(np.arange(len(texts)), lens)
        at = np.arange(len(codes)) - begins[of]
        sums = _sums(codes)
        out = np.full((len(texts), int(lens.max(initial=0)), self.longest), -1, dtype=np.int32)
        for k in range(1, self.longest + 1):
            i = np.flatnonzero(at + k <= lens[of])
            if not len(i):
                break
            ids = self.find(_hash(sums, i, i + k))
            if k == 1:
                ids = np.where(ids < 0, np.int32(self.unknown), ids)
            out[of[i], at[i], k - 1] = ids
        return out

    # --- words ------------------------------------------------------------------

    def solve(self, texts: list[str]) -> list[bytes]:
        """The ids of each text by one pass, batched by length."""
        out = [b""] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * len(texts[order[j]]) <= 1 << 16:
                j += 1
            part = [texts[k] for k in order[i:j]]
            ids = self.edges(part)
            lens = np.array([len(t) for t in part])
            entry = np.full((len(part), self.longest), NONE)
            entry[:, 0] = 0
            _, back = forward(self, ids, lens, entry[:, :, None])
            for k, path in zip(order[i:j], trace_all(ids, back[:, :, 0], lens), strict=True):
                out[k] = self.spelled(path, texts[k])
            i = j
        return out

    def spelled(self, path: tuple[np.ndarray, np.ndarray], text: str) -> bytes:
        """The ids of a path as little-endian bytes, unknown characters spelled in bytes."""
        starts, pieces = path
        if not (pieces == self.unknown).any():
            return pieces.astype(self.dtype).tobytes()
        out = []
        for start, piece in zip(starts.tolist(), pieces.tolist(), strict=True):
            if piece == self.unknown:
                out.extend(self.bytes[b] for b in text[start].encode("utf-8", "surrogatepass"))
            else:
                out.append(piece)
        return np.array(out, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self.by_word:
            return self.solve([prepared(t) for t in texts])
        cut = [_WORD.findall(prepared(t)) for t in texts]
        seen = dict.fromkeys(itertools.chain.from_iterable(cut))  # in order, so that the memo fills with frequent words
        new = [w for w in seen if w not in self.memo]
        fresh = dict(zip(new, self.solve(new), strict=True))
        table = {w: self.memo[w] for w in seen if w in self.memo} | fresh
        self.memo.update(itertools.islice(fresh.items(), max(0, MEMO_WORDS - len(self.memo))))
        return [b"".join(map(table.__getitem__, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        out, at = [], 0
        spelled = np.flatnonzero(self.is_byte[ids])
        for run in np.split(spelled, np.flatnonzero(np.diff(spelled) > 1) + 1) if len(spelled) else []:
            lo, hi = int(run[0]), int(run[-1]) + 1
            out += map(self.pieces.__getitem__, ids[at:lo].tolist())
            out.append(bytes(self.byte_of[i] for i in ids[lo:hi].tolist()).decode("utf-8", "replace"))
            at = hi
        out += map(self.pieces.__getitem__, ids[at:].tolist())
        return "".join(out).replace(BLANK, " ")[1:]


_WORD = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")


def prepared(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + random_words(1, 41)) * powers(_BASE, len(codes)), out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64)
        return mix64(x * np.uint64(0x9E3779B97F4A7C15))


# --- the lattice ------------------------------------------------------------------


def forward(v: Vocabulary, ids: np.ndarray, lens: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best sums and last piece lengths at each place of each text, in lanes: [place, text, lane].

    entry[text, state, lane] is the sum with which a lane enters at place `state` (NONE: not at all). Pieces
    start before lens[text]; those of the halo may end up to longest - 1 places beyond it. Length 0 marks an
    entry. No score is above 0, so a sum with NONE in it never exceeds NONE.
    """
    count, width, most = ids.shape
    best = np.full((width + 1 + most, count, entry.shape[2]), NONE)
    best[:most] = entry.transpose(1, 0, 2)
    back = np.zeros(best.shape, dtype=np.int8)
    weight = np.where(ids >= 0, v.scores[ids], NONE)
    weight[np.arange(width)[None, :] >= lens[:, None]] = NONE
    weight = np.ascontiguousarray(weight.transpose(2, 1, 0))[..., None]
    used = (weight > NONE).any(axis=(2, 3))
    for end in range(1, width + 1):
        now, last = best[end], back[end]
        for k in range(min(most, end), 0, -1):
            if used[k - 1, end - k]:
                got = best[end - k] + weight[k - 1, end - k]
                better = got > now
                np.copyto(now, got, where=better)
                np.copyto(last, np.int8(k), where=better)
    return best, back


def trace_all(ids: np.ndarray, back: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The starts and pieces of the path into place ends[text] of each text, back to its entry; back: [place, text]."""
    at, row, starts, pieces = ends.copy(), np.arange(len(ends)), [], []
    steps = np.zeros(len(ends), dtype=np.int64)
    while True:
        k = back[at, row].astype(np.int64)
        if not k.any():
            break
        at = at - k
        starts.append(at)
        pieces.append(ids[row, np.minimum(at, ids.shape[1] - 1), np.maximum(k, 1) - 1])
        steps += k > 0
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return [(none, none)] * len(ends)
    s, p = np.stack(starts[::-1], axis=1), np.stack(pieces[::-1], axis=1)
    return [(s[i, s.shape[1] - n :], p[i, s.shape[1] - n :]) for i, n in enumerate(steps.tolist())]


def entry_of(back: np.ndarray, end: int) -> int:
    while k := int(back[end]):
        end -= k
    return end


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of stacks of matrices."""
    s = a[:, :, :, None] + b[:, None, :, :]
    s[(a[:, :, :, None] == NONE) | (b[:, None, :, :] == NONE)] = NONE
    return s.max(axis=2)


def total(m: np.ndarray) -> np.ndarray:
    """The product of a stack of matrices, by halving."""
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([product(m[: len(m) - len(odd) : 2], m[1::2]), odd])
    return m[0]


def entries_of(first: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The sums with which each of a stack of matrices is entered, given those of the first."""
    out = [first]
    for x in m[:-1]:
        out.append(product(out[-1][None, None, :], x[None])[0, 0])
    return np.stack(out)


# --- giant texts in Spark -----------------------------------------------------------


def _chunks(chunk: int, halo: int):
    """uid, at, chunk (with the halo behind it) and size of each chunk of prepared texts."""

    def run(batches):
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = prepared(text)
                for lo in range(0, len(text), 64 * chunk):
                    at = range(lo, min(len(text), lo + 64 * chunk), chunk)
                    yield pa.RecordBatch.from_pydict({
                        "uid": pa.array([uid] * len(at), pa.int64()),
                        "at": pa.array([i // chunk for i in at], pa.int32()),
                        "chunk": [text[i : i + chunk + halo] for i in at],
                        "size": pa.array([min(chunk, len(text) - i) for i in at], pa.int32()),
                    })

    return run


def _chunk_batches(batches, v: Vocabulary, rows: int = 32):
    for b in batches:
        for i in range(0, len(b), rows):
            part = b.slice(i, rows)
            texts = part.column("chunk").to_pylist()
            lens = np.array(part.column("size").to_pylist(), dtype=np.int64)
            yield part, texts, lens, v.edges(texts)


def _exits(best: np.ndarray, lens: np.ndarray, most: int) -> np.ndarray:
    """best[lens + state, text, lane] as [text, lane, state]."""
    at = np.minimum(lens[:, None] + np.arange(most), len(best) - 1)
    return best[at, np.arange(len(lens))[:, None]].transpose(0, 2, 1)


def _matrices(path: str):
    def run(batches):
        v = vocabulary_of(path)
        for part, _, lens, ids in _chunk_batches(batches, v):
            entry = np.full((len(lens), v.longest, v.longest), NONE)
            entry[:, np.arange(v.longest), np.arange(v.longest)] = 0
            best, _ = forward(v, ids, lens, entry)
            m = _exits(best, lens, v.longest)
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("at"), pa.array([x.astype("<i8").tobytes() for x in m], pa.binary())], ["uid", "at", "matrix"])

    return run


def _stack(column, width: int) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype="<i8").reshape(-1, width) for x in column])


def _product(width: int):
    def run(pdf):
        m = total(_stack(pdf.sort_values("at")["matrix"], width))
        return pdf.head(1)[["uid", "up"]].rename(columns={"up": "at"}).assign(matrix=[m.astype("<i8").tobytes()])

    return run


def _entered(width: int):
    def run(pdf):
        pdf = pdf.sort_values("at")
        first = np.frombuffer(pdf["first"].iloc[0], dtype="<i8")
        return pdf[["uid", "at"]].assign(entry=[x.astype("<i8").tobytes() for x in entries_of(first, _stack(pdf["matrix"], width))])

    return run


def scan(matrices: DataFrame, width: int, most: int) -> DataFrame:
    """(uid, at, entry): the sums with which each chunk is entered, from (uid, at, matrix) with at < most.

    Up the tree, each group of FAN neighbours becomes one product, until a text is one group; down again, each
    group's first entry gives those of its members. No task holds more than FAN matrices of a text.
    """
    up = (F.col("at") / FAN).cast("int").alias("up")
    levels = [matrices]
    while most > FAN:
        products = levels[-1].select("uid", "at", "matrix", up).groupBy("uid", "up").applyInPandas(_product(width), "uid long, at int, matrix binary")
        levels.append(written(products, "products"))
        most = -(-most // FAN)
    start = np.full(width, NONE)
    start[0] = 0
    firsts = levels[-1].select("uid", F.lit(0).alias("up"), F.lit(start.astype("<i8").tobytes()).alias("first")).distinct()
    for level in reversed(levels):
        grouped = level.select("uid", "at", "matrix", up).join(firsts, ["uid", "up"]).groupBy("uid", "up")
        entries = written(grouped.applyInPandas(_entered(width), "uid long, at int, entry binary"), "entries")
        firsts = entries.toDF("uid", "up", "first")
    return entries


def _solved(path: str, part, lens, ids):
    v = vocabulary_of(path)
    entry = np.stack([np.frombuffer(x, dtype="<i8") for x in part.column("entry").to_pylist()])
    return forward(v, ids, lens, entry[:, :, None])[1][:, :, 0]


def _maps(path: str):
    def run(batches):
        v = vocabulary_of(path)
        for part, _, lens, ids in _chunk_batches(batches, v):
            back = _solved(path, part, lens, ids)
            maps = [[entry_of(back[:, i], n + s) if n + s < len(back) else 0 for s in range(v.longest)] for i, n in enumerate(lens.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("at"), pa.array(maps, pa.list_(pa.int32()))], ["uid", "at", "back"])

    return run


def _bounds(pdf):
    pdf = pdf.sort_values("at")
    state, out = 0, []
    for back in pdf["back"].tolist()[::-1]:
        out.append(state)
        state = int(back[state])
    return pdf[["uid", "at"]].assign(exit=out[::-1])


def _traced(path: str):
    def run(batches):
        v = vocabulary_of(path)
        for part, texts, lens, ids in _chunk_batches(batches, v):
            back = _solved(path, part, lens, ids)
            ends = lens + np.array(part.column("exit").to_pylist())
            got = [v.spelled(p, t) for p, t in zip(trace_all(ids, back, ends), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("at"), pa.array(got, pa.binary())], ["uid", "at", "ids"])

    return run


def _stitched(batches):
    """The ids of each text (uid) from those of its chunks, which come in order."""
    held, last = [], None
    for b in batches:
        for uid, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if held and uid != last:
                yield pa.RecordBatch.from_pydict({"uid": pa.array([last], pa.int64()), "ids": pa.array([b"".join(held)], pa.binary())})
                held = []
            held.append(ids)
            last = uid
    if held:
        yield pa.RecordBatch.from_pydict({"uid": pa.array([last], pa.int64()), "ids": pa.array([b"".join(held)], pa.binary())})


def _encoded(path: str):
    def run(batches):
        v = vocabulary_of(path)
        for b in small_batches(batches, rows=1024):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.encode(b.column(1).to_pylist()), pa.binary())], ["id", "ids"])

    return run


def _giant_ids(rows: DataFrame, model: str, chunk_chars: int, lean: bool = False) -> DataFrame:
    """id, body and ids of giant texts (id, body) by the scan over their chunks."""
    step = lambda make: _lean(make(model)) if lean else make(model)
    width, keys = vocabulary_of(model).longest, ["uid", "at"]
    giant = written(rows.withColumn("uid", F.monotonically_increasing_id()), "giant")
    chunks = giant.select("uid", "body").mapInArrow(_chunks(chunk_chars, width - 1), "uid long, at int, chunk string, size int")
    chunks = written(chunks.repartition(*keys), "chunks")
    most = chunks.agg(F.max("at")).first()[0]
    if most is None:
        return giant.select("id", "body", F.lit(b"").alias("ids"))
    matrices = written(chunks.mapInArrow(step(_matrices), "uid long, at int, matrix binary"), "matrices")
    entered = chunks.join(scan(matrices, width, most + 1), keys)
    exits = entered.mapInArrow(step(_maps), "uid long, at int, back array<int>").groupBy("uid").applyInPandas(_bounds, "uid long, at int, exit int")
    parts = entered.join(written(exits, "exits"), keys).mapInArrow(step(_traced), "uid long, at int, ids binary")
    whole = parts.repartition("uid").sortWithinPartitions(*keys).mapInArrow(_stitched, "uid long, ids binary")
    return giant.join(whole, "uid").select("id", "body", "ids")


def _split(docs: DataFrame, id_col: str, text_col: str, giant_chars: int) -> tuple[DataFrame, DataFrame]:
    """The ordinary and the giant texts as (id, body)."""
    rows = bodies_of(docs, id_col, text_col)
    return rows.filter(F.length("body") <= giant_chars), rows.filter(F.length("body") > giant_chars)


def encode(docs: DataFrame, model: str, giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (binary, little-endian, 2 bytes an id up to 65,535 pieces, else 4) of every document."""
    small, giant = _split(docs, id_col, text_col, giant_chars)
    small = small.mapInArrow(_encoded(model), "id long, ids binary")
    return small.union(_giant_ids(giant, model, chunk_chars).select("id", "ids")).withColumnRenamed("id", id_col)


def _decoded(path: str):
    def run(batches):
        v = vocabulary_of(path)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                ids = [np.frombuffer(x, dtype=v.dtype) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([v.decode(x) for x in ids], pa.string())], [*part.schema.names[1:], "decoded"])

    return run


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """Every other column and `decoded`, the text of the ids."""
    rest = [f for f in encoded.schema.fields if f.name != ids_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["decoded string"])
    return encoded.select(ids_col, *[f.name for f in rest]).mapInArrow(_decoded(model), schema)


_REPORT = "id long, n_ids long, ids_crc32 long, round_trip boolean, ids binary"


def _report(v: Vocabulary, ids: pa.Array, texts: list[str], coded: list[bytes], keep_ids: bool) -> pa.RecordBatch:
    cut = [np.frombuffer(x, dtype=v.dtype) for x in coded]
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([len(x) for x in cut], pa.int64()),
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()),
            pa.array([v.decode(x) == t for x, t in zip(cut, texts, strict=True)], pa.bool_()),
            pa.array(coded, pa.binary()) if keep_ids else pa.nulls(len(ids), pa.binary()),
        ],
        ["id", "n_ids", "ids_crc32", "round_trip", "ids"],
    )


def _lean(run):
    """`run`, after which the worker holds no vocabulary and no solved words."""

    def once(batches):
        try:
            yield from run(batches)
        finally:
            vocabulary_of.cache_clear()
            give_back()

    return once


def _checked(path: str, keep_ids: bool, lean: bool = False):
    """The report on each (id, body), encoded here, or (id, body, ids)."""

    def run(batches):
        v = vocabulary_of(path)
        for b in small_batches(batches, rows=1024):
            texts = b.column(1).to_pylist()
            yield _report(v, b.column(0), texts, b.column(2).to_pylist() if b.num_columns > 2 else v.encode(texts), keep_ids)

    return _lean(run) if lean else run


def encode_and_check(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS, lean: bool = False) -> DataFrame:
    """id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip (whether the decoded ids are the
    text) and, if asked for, the ids. Ordinary texts are encoded and decoded by one worker, so ids don't travel twice.
    With `lean` a worker drops the vocabulary and its solved words when its task ends, at the price of loading and solving
    them again: for jobs in which other stages run in the same executors."""
    small, giant = _split(docs, id_col, text_col, giant_chars)
    check = _checked(model, keep_ids, lean)
    out = small.mapInArrow(check, _REPORT).union(_giant_ids(giant, model, chunk_chars, lean).mapInArrow(check, _REPORT))
    return out.withColumnRenamed("id", id_col).select(id_col, "n_ids", "ids_crc32", "round_trip", *(["ids"] if keep_ids else []))
