"""Removal of long repeated byte strings by suffix sorting (deep-shallow), over the whole corpus.

Every byte covered by a `length`-byte string that also starts elsewhere is removed. Equal strings must meet in
one task without shipping every suffix: a string's anchor is the smallest hash among its `gram`-byte grams, so
equal strings share it, and the starts that share the place of their anchor form short runs (segments). One pass counts the
anchors; segments whose anchor may occur more than once then meet the anchors' kinds in a shuffle, without their bytes,
and only those whose anchor does occur more than once are decided, by the kind of their anchor:
  - all segments of the anchor are one byte string: they are collapsed to one with its multiplicity, which
    decides them;
  - otherwise the segments are suffix-sorted: multikey quicksort over eight-byte symbols to a shallow depth,
    then a blind trie for each group that still agrees; neighbours that agree over the full length are repeats;
  - anchors in more than `crowd` places (a line or passage in a large part of the corpus) don't go to one task:
    their strings are counted with map-side sums under a 128-bit BLAKE2b digest of their bytes.
Bytes are compared, or their BLAKE2b digests; the rolling polynomial hash only chooses anchors, where a collision
makes strings meet that differ, and nothing else. Two different strings share a digest with a chance of 2^-128.
One Bloom filter of bounded size holds places of single anchors back from that shuffle; the shuffle decides, so false
positives cost time only, and what driver and workers hold does not grow with the corpus.

Defined cases: a null text counts as empty; texts shorter than `length` lose nothing; matches never cross
documents; rows that repeat id and text count as separate places; a null id is allowed; overlaps within one
document count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import KeyFilter, bodies_of, written
from factloom.llm.shingles import mix64, powers, random_words, utf8

LENGTH, GRAM, CROWD = 200, 100, 20_000
#: Bits at most of the filter of repeated anchors: 8 MB on the driver and in each worker, whatever the input.
MOST_BITS = 1 << 26
SHALLOW_WORDS = 4
BLOCK_BYTES = 2 << 20
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = random_words(256, 53)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Block:
    """A stretch of bytes: rolling hashes of its grams and digests of its substrings."""

    def __init__(self, data: np.ndarray):
        self.data = np.ascontiguousarray(data)

    def grams(self, gram: int) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[self.data] * powers(_BASE, len(self.data)), out=sums[1:])
            return mix64((sums[gram:] - sums[:-gram]) * powers(_INVERSE, len(sums) - gram))

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        raw, digest = memoryview(self.data), hashlib.blake2b
        return [digest(raw[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Blocks of segments: (block, base, text index, start in the data, run, anchor) for the strings of a batch."""
    room = np.diff(offsets) - length + 1
    for lo in range(0, max(1, len(data)), BLOCK_BYTES):
        hi = min(len(data), lo + BLOCK_BYTES + length - 1)
        if hi - lo < length:
            break
        block = Block(data[lo:hi])
        h = block.grams(gram)
        low, span, want = h, 1, length - gram + 1
        while span * 2 <= want:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if want > span:
            low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
        low = low[: min(len(low), BLOCK_BYTES)]
        at = np.arange(lo, lo + len(low))
        of = np.searchsorted(offsets, at, "right") - 1
        ok = np.flatnonzero(at - offsets[of] < room[of])
        if not len(ok):
            continue
        at, of, low = at[ok], of[ok], low[ok]
        cut = np.ones(len(at), dtype=bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (of[1:] != of[:-1])
        cut[1:] |= h[ok[:-1]] == low[:-1]  # the gram that was smallest is left behind, so the next place of its value takes over
        first = np.flatnonzero(cut)
        run = np.diff(np.concatenate([first, [len(at)]]))
        yield block, lo, of[first], at[first], run, low[first]


def _by_bytes(batches, rows: int = 256, size: int = BLOCK_BYTES):
    for b in batches:
        if len(b):
            lengths = np.diff(utf8(b.column(b.schema.get_field_index("body")))[1])
            i = 0
            while i < len(b):
                n = max(1, int(np.searchsorted(np.cumsum(lengths[i : i + rows]), size, "right")))
                yield b.slice(i, n)
                i += n


def _anchors(length: int, gram: int):
    def run(batches):
        for b in _by_bytes(batches):
            for block, lo, _, at, runs, anchor in segments(*utf8(b.column(0)), length, gram):
                for i in range(0, len(at), 65536):
                    s = at[i : i + 65536] - lo
                    whole = np.frombuffer(b"".join(block.digests(s, s + runs[i : i + 65536] + length - 1)), dtype="<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[i : i + 65536].view(np.int64)), pa.array(whole[:, 0]), pa.array(whole[:, 1])], ["anchor", "head", "tail"])

    return run


_PLACED = "anchor long, id long, h long, start int, run int"


def _placed(length: int, gram: int, repeated):
    """The segments whose anchor passes the filter, without their bytes."""

    def run(batches):
        for b in _by_bytes(batches):
            ids, h = b.column(0), b.column(1)
            data, offsets = utf8(b.column(2))
            for _, _, of, at, runs, anchor in segments(data, offsets, length, gram):
                kept = np.flatnonzero(repeated(anchor))
                for k in range(0, len(kept), 65536):
                    keep = kept[k : k + 65536]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor[keep].view(np.int64)), ids.take(pa.array(of[keep])), h.take(pa.array(of[keep])),
                            pa.array((at - offsets[of])[keep].astype(np.int32)), pa.array(runs[keep].astype(np.int32)),
                        ],
                        ["anchor", "id", "h", "start", "run"],
                    )

    return run


_ROUTED = "route int, anchor long, id long, h long, start int, run int, body binary, prints array<binary>"
_FIELDS = ("route", "anchor", "id", "h", "start", "run", "body", "prints")


def _routed(length: int, size: int = BLOCK_BYTES):
    """The segments that each text is asked for (id, h, body, asked), with their bytes or the digests of their strings."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()))
    full = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(_FIELDS))

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for id_, h, body, asked in zip(*b.columns, strict=True):
                raw = body.as_py().encode("utf-8")
                for x in asked.as_py():
                    s, n = x["start"], x["run"]
                    whole = raw[s : s + n + length - 1] if x["route"] == 2 else None
                    prints = [hashlib.blake2b(raw[p : p + length], digest_size=16).digest() for p in range(s, s + n)] if x["route"] == 3 else None
                    rows.append((x["route"], x["anchor"], id_.as_py(), h.as_py(), s, n, whole, prints))
                    held += n + length
                    if held >= size:
                        yield full(rows)
                        rows, held = [], 0
        if rows:
            yield full(rows)

    return run


# --- deep-shallow sorting ---------------------------------------------------------


class BlindTrie:
    """A trie of equally long byte strings that stores branching depths and bytes only; equal strings share a leaf."""

    def __init__(self, tail):
        self.tail, self.root = tail, None

    def insert(self, item: int) -> None:
        if self.root is None:
            self.root = [item]
            return
        s, node, path = self.tail(item), self.root, []
        while isinstance(node, tuple):
            path.append(node)
            branches = node[1]
            node = branches.get(s[node[0]]) or next(iter(branches.values()))
        t = self.tail(node[0])
        if s == t:
            node.append(item)
            return
        differ = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        depth = len(s) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [item]
            return
        fork = (depth, {t[depth]: node, s[depth]: [item]})
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]]] = fork

    def leaves(self):
        """Groups of equal strings in lexicographic order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node


def deep_shallow(blob: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """The groups (of two or more) of `starts` whose next `length` bytes are equal, in suffix order."""
    padded = np.concatenate([blob, np.zeros(8, dtype=np.uint8)])
    word = np.zeros(len(blob), dtype=np.uint64)
    for j in range(8):
        word |= padded[j : j + len(blob)].astype(np.uint64) << np.uint64(56 - 8 * j)
    order, group = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    shallow = min(SHALLOW_WORDS, length // 8)
    for d in range(shallow):
        symbol = word[starts[order] + 8 * d]
        by = np.lexsort((symbol, group))
        order, symbol, group = order[by], symbol[by], group[by]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(fresh) - 1
        alone = np.bincount(group)[group] == 1
        order, group = order[~alone], group[~alone]
        if not len(order):
            return []
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [len(order)]])
    sizes = np.diff(cuts)
    out = []
    two = cuts[:-1][sizes == 2]
    a, b = starts[order[two]], starts[order[two + 1]]
    same = np.ones(len(two), dtype=bool)
    for d in range(8 * shallow, length, 8):
        d = min(d, length - 8)
        same &= word[a + d] == word[b + d]
    out.extend(zip(order[two[same]].tolist(), order[two[same] + 1].tolist(), strict=True))
    raw, depth = blob.tobytes(), 8 * shallow
    at = starts.tolist()
    for lo, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        trie = BlindTrie(lambda i: raw[at[i] + depth : at[i] + length])
        for i in order[lo : lo + n].tolist():
            trie.insert(i)
        out.extend(leaf for leaf in trie.leaves() if len(leaf) > 1)
    return out


def _sorted(length: int, rows: int = 1 << 14):
    def solve(anchor, ids, h, start, run, body):
        kinds: dict[bytes, int] = {}
        kind = np.array([kinds.setdefault(x, len(kinds)) for x in body])
        texts = list(kinds)
        many = np.bincount(kind) > 1
        blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes
        runs = sizes - length + 1
        first = np.cumsum(runs) - runs
        starts = np.repeat(base - first, runs) + np.arange(int(runs.sum()))
        repeated = np.repeat(many, runs)
        for leaf in deep_shallow(blob, starts, length):
            repeated[list(leaf)] = True
        out = [[], [], [], []]
        edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
        for i, k in enumerate(kind.tolist()):
            lo, hi = int(first[k]), int(first[k] + runs[k])
            if not repeated[lo:hi].any():
                continue
            begins = np.flatnonzero(edge[lo + 1 : hi] == 1) + 1
            ends = np.flatnonzero(edge[lo + 1 : hi] == -1) + 1
            begins = np.concatenate([[0], begins]) if repeated[lo] else begins
            ends = np.concatenate([ends, [hi - lo]]) if repeated[hi - 1] else ends
            for s, e in zip(begins.tolist(), ends.tolist(), strict=True):
                out[0].append(ids[i])
                out[1].append(h[i])
                out[2].append(start[i] + s)
                out[3].append(start[i] + e - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["id", "h", "lo", "hi"])

    def run(batches):
        held, last = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= rows and row[0] != last:
                    yield solve(*zip(*held, strict=True))
                    held = []
                held.append(row)
                last = row[0]
        if held:
            yield solve(*zip(*held, strict=True))

    return run


def _kept(spans, text: str) -> tuple[int, int, str]:
    raw = text.encode("utf-8")
    removed, count, at, keep = 0, 0, 0, hashlib.sha256()
    for lo, hi in spans:
        keep.update(raw[at:lo])
        removed, count, at = removed + hi - lo, count + 1, hi
    keep.update(raw[at:])
    return removed, count, keep.hexdigest()


def merged_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of a list of (lo, hi); runs that touch are one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def _cut(batches):
    for b in batches:
        rows = []
        for text, los, his in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            spans = merged_spans(zip(los, his, strict=True))
            rows.append((*_kept(spans, text), [x for s in spans for x in s]))
        removed, count, sha, flat = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(flat, pa.list_(pa.int32()))], ["id", "n_removed", "n_spans", "kept_sha256", "spans"])


def _filter_bits(n: int) -> int:
    return min(MOST_BITS, 1 << max(16, (16 * max(1, n) - 1).bit_length()))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, lo, hi): the byte ranges of each document covered by repeated strings, before merging. h is the text's hash."""
    rows = bodies_of(docs, id_col, text_col).select("id", F.xxhash64("body").alias("h"), "body").filter(F.octet_length("body") >= length)
    seen = rows.select("body").mapInArrow(_anchors(length, gram), "anchor long, head long, tail long")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("head", "tail") for f in (F.min, F.max)]
    counted = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *ends).filter("n > 1")
    kinds = written(counted.select("anchor", F.when(F.expr("min_head = max_head and min_tail = max_tail"), 1).when(F.col("n") > crowd, 3).otherwise(2).alias("route")), "anchors")
    repeated = KeyFilter(kinds, "anchor", _filter_bits(kinds.count()), hashed=True).prober()
    placed = rows.mapInArrow(_placed(length, gram, repeated), _PLACED)
    met = written(placed.join(kinds.hint("merge"), "anchor"), "places")

    uniform = met.filter("route = 1").select("id", "h", F.col("start").alias("lo"), (F.col("start") + F.col("run") - 1 + length).alias("hi"))
    open_ = met.filter("route > 1")
    asked = open_.groupBy(F.col("id").alias("aid"), F.col("h").alias("ah")).agg(F.collect_set(F.struct("start", "run", "anchor", "route")).alias("asked"))
    texts = rows.filter(KeyFilter(open_.select("h").distinct(), "h").may_contain(F.col("h")))
    texts = texts.join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("aid")) & (F.col("h") == F.col("ah"))).select("id", "h", "body", "asked")
    routed = written(texts.mapInArrow(_routed(length), _ROUTED), "segments")
    mixed = routed.filter("route = 2").select("anchor", "id", "h", "start", "run", "body").repartition("anchor").sortWithinPartitions("anchor")
    mixed = mixed.mapInArrow(_sorted(length), "id long, h long, lo int, hi int")
    places = routed.filter("route = 3").select("anchor", "id", "h", "start", F.posexplode("prints").alias("at", "print"))
    often = places.groupBy("anchor", "print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "print")
    crowded = places.join(often, ["anchor", "print"]).select("id", "h", (F.col("start") + F.col("at")).alias("lo"), (F.col("start") + F.col("at") + length).alias("hi"))
    return uniform.union(mixed).union(crowded)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans (flat array of lo, hi) of each document."""
    spans = repeated_spans(docs, length, gram, crowd, id_col, text_col)
    spans = written(spans.groupBy(F.col("id").alias("sid"), "h").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "spans")
    rows = bodies_of(docs, id_col, text_col).select("id", F.xxhash64("body").alias("h"), "body")
    held = KeyFilter(spans, "h")
    marked = rows.withColumn("doubt", held.may_contain(F.col("h")))
    untouched = lambda df: df.select("id", F.octet_length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"), F.array().cast("array<int>").alias("spans"))
    joined = marked.filter("doubt").join(spans, (F.col("id").eqNullSafe(F.col("sid"))) & (rows["h"] == spans["h"]), "left").select("id", "body", "lo", "hi")
    cut = joined.select("id", "body", F.coalesce("lo", F.array()).alias("lo"), F.coalesce("hi", F.array()).alias("hi")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    cut = cut.mapInArrow(_cut_sized, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>")
    return untouched(marked.filter("not doubt")).unionByName(cut).withColumnRenamed("id", id_col)


def _cut_sized(batches):
    for b in batches:
        for part in _cut([b.select(["id", "body", "lo", "hi"])]):
            yield pa.RecordBatch.from_arrays([part.column(0), b.column(b.schema.get_field_index("n_bytes")), *part.columns[1:]], ["id", "n_bytes", *part.schema.names[1:]])
