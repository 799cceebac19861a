"""Token ids as raw binary shards, with a minimal perfect hash index for keyed access.

Documents are dealt by range of their id (equal ids further by a hash of the text, so a repeated id splits),
sorted, encoded whole, and appended to one shard file a task: `<shard>.ids` holds the raw little-endian ids
and `<shard>.idx` the index. The index hashes and displaces the shard's document keys (id and its ordinal
among equal ids) onto exactly as many slots; each slot stores a 32-bit fingerprint, the payload offset and
the length, so a lookup is one hash, one compare and one ranged read. File names carry a random part and
only the names in the written manifest count, so a task that is run again leaves no half shard behind.

Defined cases: a null text is empty and holds only the end id; a null id sorts before every id and reads back
as null; repeated ids keep their rows, told apart by ordinal; an empty table writes no shard; other columns
are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bodies_of, fresh_dir, written
from factloom.llm.shingles import small_batches

MAGIC = b"IDSHARD1"
NULL_KEY = -(1 << 63)
KEYS_PER_BUCKET = 3
MEMO_CORES = 400_000


# --- encoding ---------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordMemoEncoder:
    return WordMemoEncoder(path)


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies spell each byte: itself if printable, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Letters that every tokenizer lower-cases and normalises alike, and marks that may follow them (no apostrophe: it binds letters).
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"


class WordMemoEncoder:
    """Encodes whole texts with the tokenizers library, each distinct piece between blanks once a batch.

    It applies to tokenizers whose pre-tokens never hold a blank and whose words end in a marked token: then the
    ids of a text are those of its pieces in turn. A plain piece is the library's model applied to its lower-cased
    letters, and the ids of the marks after them; any other piece goes through the whole tokenizer. The ids of letter cores
    are remembered, up to a fixed number, so that the library sees each frequent word once a worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        n = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.cores: dict[str, bytes] = {}
        ends_words = bool(spec["model"].get("end_of_word_suffix")) and (spec["pre_tokenizer"] or {}).get("type") == "Sequence"
        self.splits = ends_words and all(self._of_model([w]) == [self._ids(w.upper())] for w in ("word", "éàüñ", "qzxjkv"))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _of_batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_model(self, words: list[str]) -> list[bytes]:
        """The ids of lower-case words of letters by the library's model alone."""
        spell, solve, width, flat, ends = self.letters, self.tokenizer.model.tokenize, self.dtype.itemsize, [], [0]
        for w in words:
            flat += [t.id for t in solve(w if w.isascii() else w.encode().decode("latin-1").translate(spell))]
            ends.append(len(flat) * width)
        raw = np.array(flat, dtype=self.dtype).tobytes()
        return [raw[i:j] for i, j in itertools.pairwise(ends)]

    def _of_cores(self, cores: list[str]) -> list[bytes]:
        out = list(map(self.cores.get, cores))
        new = [i for i, x in enumerate(out) if x is None]
        fresh = self._of_model([cores[i] for i in new])
        for i, x in zip(new, fresh, strict=True):
            out[i] = x
        room = max(0, MEMO_CORES - len(self.cores))
        self.cores.update(zip([cores[i] for i in new[:room]], fresh, strict=False))
        return out

    def _segments(self, kinds: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids as segments (0 is empty), and the two segments that each distinct piece consists of."""
        plain = pc.match_substring_regex(kinds, f"^{_LETTERS}{_MARKS}$")
        words = pc.utf8_lower(kinds.filter(plain))
        core = pc.replace_substring_regex(words, f"{_MARKS}$", "").dictionary_encode()
        mark = pc.replace_substring_regex(words, f"^{_LETTERS}", "").dictionary_encode()
        cores = self._of_cores(core.dictionary.to_numpy(zero_copy_only=False).tolist())
        marks = self._of_batch(mark.dictionary.to_pylist())
        is_plain = plain.to_numpy(zero_copy_only=False)
        odd = ~is_plain & (pc.binary_length(kinds).to_numpy() > 0)
        others = self._of_batch(kinds.filter(pa.array(odd)).to_pylist())
        two = np.zeros((len(kinds), 2), dtype=np.int64)
        two[is_plain, 0] = core.indices.to_numpy() + 1
        two[is_plain, 1] = mark.indices.to_numpy() + 1 + len(cores)
        two[odd, 0] = np.arange(len(others)) + 1 + len(cores) + len(marks)
        return [b"", *cores, *marks, *others], two

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column without nulls, one after the other, and how many each text has."""
        if not self.splits:
            got = self._of_batch(column.to_pylist())
            return np.frombuffer(b"".join(got), dtype=self.dtype), np.array([len(x) // self.dtype.itemsize for x in got], dtype=np.int64)
        cut = pc.split_pattern(pc.replace_substring(column.cast(pa.large_string()), "\n", " "), " ")
        pieces = cut.flatten().dictionary_encode()
        parts, two = self._segments(pieces.dictionary)
        sizes = np.array([len(x) for x in parts], dtype=np.int64) // self.dtype.itemsize
        pool, first = np.frombuffer(b"".join(parts), dtype=self.dtype), np.cumsum(sizes) - sizes
        at = two[pieces.indices.to_numpy()].ravel()
        ends = np.cumsum(sizes[at])
        ids = pool[np.repeat(first[at] - ends + sizes[at], sizes[at]) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends[1::2]])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return ids, np.diff(bounds)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, lengths = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(lengths)[:-1]) if texts else []


# --- the index ----------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of each key under a seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _keys(ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return _mix(ids.view(np.uint64), 1) ^ _mix(ordinals.astype(np.uint64), 2)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys by hashing and displacing: bucket b holds either the
    displacement under which all its keys meet free slots, or, for a single key, minus its slot less one."""

    def __init__(self, n: int, moves: np.ndarray):
        self.n, self.moves = n, moves

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        m = max(1, -(-n // KEYS_PER_BUCKET))
        bucket = (_mix(keys, 3) % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        taken, moves = np.zeros(n, dtype=bool), np.zeros(m, dtype=np.int32)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            left = np.flatnonzero(sizes == size)
            d = 0
            while len(left):
                rows = keys[order[starts[left][:, None] + np.arange(size)]]
                slots = cls._slots(rows, d, n)
                ok = ~taken[slots].any(axis=1)
                s = np.sort(slots, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                claim = np.full(n, -1, dtype=np.int64) if ok.any() else None
                if claim is not None:
                    at = np.flatnonzero(ok)
                    claim[slots[at[::-1]].ravel()] = np.repeat(at[::-1], size)
                    won = at[(claim[slots[at]] == at[:, None]).all(axis=1)]
                    taken[slots[won].ravel()] = True
                    moves[left[won]] = d
                    left = np.delete(left, won)
                d += 1
        free = np.flatnonzero(~taken)
        moves[np.flatnonzero(sizes == 1)] = -1 - free
        return cls(n, moves)

    @staticmethod
    def _slots(keys: np.ndarray, d, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            step = np.asarray(d).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (_mix(keys ^ step, 4) % np.uint64(max(1, n))).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.moves[(_mix(keys, 3) % np.uint64(len(self.moves))).astype(np.int64)].astype(np.int64)
        return np.where(d < 0, -1 - d, self._slots(keys, np.maximum(d, 0), self.n))


class ShardIndex:
    """The index of one shard: `locate` answers (found, offset, length) in ids for (document id, ordinal) keys."""

    def __init__(self, ids, ordinals, phf, prints, offsets, lengths, dtype):
        self.ids, self.ordinals, self.phf, self.prints, self.offsets, self.lengths, self.dtype = ids, ordinals, phf, prints, offsets, lengths, dtype

    @classmethod
    def build(cls, ids: np.ndarray, lengths: np.ndarray, dtype: np.dtype) -> ShardIndex:
        first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
        at = np.arange(len(ids))
        ordinals = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)
        keys = _keys(ids, ordinals)
        phf = PerfectHash.build(keys)
        slots = phf.slots(keys)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        prints, offsets, sizes = np.zeros(len(ids), np.uint32), np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint32)
        prints[slots], offsets[slots], sizes[slots] = (_mix(keys, 5) >> np.uint64(32)).astype(np.uint32), starts, lengths
        return cls(ids, ordinals, phf, prints, offsets, sizes, dtype)

    def locate(self, ids: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.phf.n:
            z = np.zeros(len(ids), np.int64)
            return z.astype(bool), z, z
        keys = _keys(ids, ordinals)
        s = self.phf.slots(keys)
        found = self.prints[s] == (_mix(keys, 5) >> np.uint64(32)).astype(np.uint32)
        return found, self.offsets[s].astype(np.int64), self.lengths[s].astype(np.int64)

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QQI", len(self.ids), len(self.phf.moves), self.dtype.itemsize)
        parts = (self.phf.moves.astype("<i4"), self.prints, self.offsets, self.lengths, self.ids.astype("<i8"), self.ordinals)
        return head + b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> ShardIndex:
        if raw[:8] != MAGIC:
            raise ValueError("not an id shard index")
        n, m, width = struct.unpack_from("<QQI", raw, 8)
        at, out = 28, []
        for kind, k in (("<i4", m), ("<u4", n), ("<u8", n), ("<u4", n), ("<i8", n), ("<u4", n)):
            out.append(np.frombuffer(raw, dtype=kind, count=k, offset=at))
            at += out[-1].nbytes
        moves, prints, offsets, lengths, ids, ordinals = out
        return cls(ids, ordinals, PerfectHash(n, moves), prints, offsets, lengths, np.dtype(f"<u{width}"))


# --- files ----------------------------------------------------------------------


def _store(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


_MANIFEST = "shard string, first_id long, n_docs long, n_tokens long"


def _write_shard(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        enc, store, ids, lengths, out, name = encoder(tokenizer), None, [], [], None, uuid.uuid4().hex
        for b in small_batches(batches, rows=1 << 14, size=8 << 20):
            if out is None:
                store, path = _store(folder)
                out = store.open_output_stream(f"{path}/{name}.ids")
            ids.append(b.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
            got, counts = enc.encode_column(b.column(1))
            out.write(np.insert(got, np.cumsum(counts), end_id).tobytes())
            lengths.append(counts + 1)
        if out is None:
            return
        out.close()
        every, sizes = np.concatenate(ids), np.concatenate(lengths)
        with store.open_output_stream(f"{path}/{name}.idx") as f:
            f.write(ShardIndex.build(every, sizes, enc.dtype).to_bytes())
        yield pa.RecordBatch.from_pydict({"shard": [name], "first_id": [int(every[0])], "n_docs": [len(every)], "n_tokens": [int(sizes.sum())]})

    return run


def write_token_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """Writes the shards of `docs` in ascending id order; returns the written manifest (one row a shard, with
    `start`, the ids of all shards before it) and the folder."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "ids")
    rows = bodies_of(docs, id_col, text_col)
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("body")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("body"))
    made = written(dealt.mapInArrow(_write_shard(folder, tokenizer, end_id), _MANIFEST).withColumn("part", F.spark_partition_id()), "manifest")
    start, listed = 0, []
    for r in made.orderBy("part").collect():  # one row a shard
        listed.append((r["shard"], r["first_id"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(listed, f"{_MANIFEST}, start long"), folder


def _read_shards(folder: str):
    def run(batches):
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("start").to_pylist(), strict=True):
                store, path = _store(folder)
                with store.open_input_stream(f"{path}/{shard}.idx") as f:
                    index = ShardIndex.from_bytes(f.read())
                found, offsets, lengths = index.locate(index.ids, index.ordinals)
                if not found.all():
                    raise ValueError(f"{shard}: a stored fingerprint doesn't match")
                crcs, width = np.zeros(len(offsets), dtype=np.int64), index.dtype.itemsize
                with store.open_input_file(f"{path}/{shard}.ids") as f:
                    for i in np.argsort(offsets, kind="stable"):
                        raw = f.read_at(int(lengths[i]) * width, int(offsets[i]) * width)
                        crcs[i] = zlib.crc32(np.frombuffer(raw, dtype=index.dtype).astype("<u4").tobytes())
                for i in range(0, len(offsets), 8192):
                    part = slice(i, i + 8192)
                    ids = pa.array(index.ids[part], mask=index.ids[part] == NULL_KEY)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(offsets[part] + base), pa.array(lengths[part]), pa.array(crcs[part])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads every document back from the shards through their indexes: doc_id, start, n_tokens and ids_crc32."""
    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "start").mapInArrow(_read_shards(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, folder: str, doc_id: int, ordinal: int = 0) -> np.ndarray | None:
    """The ids of one document by key, or None: one index lookup and one ranged read in each shard that may hold it."""
    rows = sorted((r["first_id"], r["start"], r["shard"]) for r in manifest.collect())
    at = [i for i, r in enumerate(rows) if r[0] <= doc_id and (i + 1 == len(rows) or rows[i + 1][0] >= doc_id)]
    store, path = _store(folder)
    for i in at:
        with store.open_input_stream(f"{path}/{rows[i][2]}.idx") as f:
            index = ShardIndex.from_bytes(f.read())
        found, offset, length = index.locate(np.array([doc_id], dtype=np.int64), np.array([ordinal], dtype=np.uint32))
        if found[0]:
            with store.open_input_file(f"{path}/{rows[i][2]}.ids") as f:
                raw = f.read_at(int(length[0]) * index.dtype.itemsize, int(offset[0]) * index.dtype.itemsize)
            return np.frombuffer(raw, dtype=index.dtype)
    return None
