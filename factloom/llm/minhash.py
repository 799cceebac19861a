"""MinHash near-deduplication with circulant signatures, banding and exact Jaccard verification.

Signatures take two permutations of a universe of 2^20 positions: the first scatters a shingle, the second,
shifted circularly by k, ranks it for coordinate k. The shifts of one position lie side by side in memory, so
a document's signature is one gather and one minimum.

Documents with one shingle set are one class, represented by its smallest id; only representatives are banded.
A bucket of any size is resolved without listing its pairs: first all its members meet its smallest id, and
those pairs are verified on full shingle sets; then, where a bucket still spans several components, its members
meet in pairs of blocks, each of which computes all its exact intersections as a matrix product over the
shingles that at least two of its documents share, and gives out only the links that join components. So no
link within a bucket is lost however large it is. Components come from star contraction.

Recall: a pair at the threshold shares no band with a chance below 1e-6 (see `bands_for`).

Defined cases: a null text counts as empty; a text without words has an empty set and links with nothing; one
with fewer words than a shingle has its whole sequence as one; rows of a null id link with nothing and are
kept; repeated ids share their links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import KeyFilter, bodies_of, components, written
from factloom.llm.shingles import mix64, random_words, shingle_sets, small_batches

UNIVERSE = 1 << 20
COORDINATES = 128
#: A block of a bucket has about so many sets, and so many shingles in all its sets, at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
COLUMNS, ROWS = 2048, 256


def bands_for(percent: int, coordinates: int = COORDINATES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold is missed with a chance below 1e-6."""
    t = percent / 100
    rows = max((r for r in range(1, 17) if (1 - t**r) ** (coordinates // r) < 1e-6), default=1)
    return coordinates // rows, rows


class Circulant:
    """The two permutations and the signatures they give."""

    def __init__(self, coordinates: int = COORDINATES, universe: int = UNIVERSE):
        self.mask, self.coordinates = np.uint64(universe - 1), coordinates
        self.scatter = np.argsort(random_words(universe, 5), kind="stable").astype(np.uint32)
        ranks = np.argsort(random_words(universe, 6), kind="stable").astype(np.uint32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: coordinates - 1]]), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = np.unique(self.scatter[(shingles & self.mask).astype(np.int64)])
        out = self.shifts[at[:4096]].min(axis=0)
        for i in range(4096, len(at), 4096):
            np.minimum(out, self.shifts[at[i : i + 4096]].min(axis=0), out=out)
        return out


_circulant: list[Circulant] = []


def circulant() -> Circulant:
    if not _circulant:
        _circulant.append(Circulant())
    return _circulant[0]


def _banded(k: int, bands: int, rows: int):
    salt = random_words(rows + 1, 23) | np.uint64(1)

    def run(batches):
        hasher = circulant()
        for b in small_batches(batches):
            sizes, keys, buckets = [], [], []
            for s in shingle_sets(b.column(1), k):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    buckets.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = hasher.signature(s)[: bands * rows].reshape(bands, rows).astype(np.uint64)
                with np.errstate(over="ignore"):
                    buckets.append(mix64((sig * salt[:rows]).sum(axis=1) + np.arange(bands, dtype=np.uint64) * salt[rows]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                ["id", "n", "set_key", "buckets"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for b in small_batches(batches):
            sets = list(shingle_sets(b.column(1), k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _groups(batches, key_columns: int):
    """The rows of each run of equal leading columns, as lists of column arrays, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(key_columns)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(b)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[lo])
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The exact sizes of all intersections of two lists of sets, by products over their shared members."""
    sizes = np.array([len(x) for x in (*left, *right)])
    members, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.bincount(column, minlength=len(members)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.int32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(sizes), min(COLUMNS, int(shared.sum()) - lo)), dtype=np.float32)
        block[row[i:j], column[i:j] - lo] = 1
        out += (block[: len(left)] @ block[len(left) :].T).astype(np.int32)  # at most COLUMNS each, so exact in single precision
    return out


def _linked(percent: int):
    """The links that join components within one pair of blocks of a bucket: a spanning forest of them."""

    def run(batches):
        for (_, bi, bj), t in _groups(batches, 3):
            own, ids, comp = t["own"].to_numpy(), t["id"].to_numpy(), t["comp"].to_numpy()
            left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
            if not len(left) or not len(right) or len(np.unique(comp)) < 2:
                continue
            column = t["shingles"].combine_chunks()
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
            sets = [flat[offsets[i] : offsets[i + 1]] for i in range(len(ids))]
            n = np.diff(offsets)
            rows = [sets[i] for i in left]
            common = intersections(rows, [sets[i] for i in right]) if bi != bj else intersections(rows, rows)
            head: dict[int, int] = {}

            def root(x: int, head=head) -> int:
                while (up := head.get(x, x)) != x:
                    head[x] = head.get(up, up)
                    x = up
                return x

            out = []
            for lo in range(0, len(left), ROWS):
                part, inter = left[lo : lo + ROWS], common[lo : lo + ROWS].astype(np.int64)
                union = n[part][:, None] + n[right][None, :] - inter
                a, b = np.nonzero((100 * inter >= percent * union) & (comp[part][:, None] != comp[right][None, :]))
                for i, j in zip(part[a].tolist(), right[b].tolist(), strict=True):
                    x, y = root(int(comp[i])), root(int(comp[j]))
                    if x != y:
                        head[max(x, y)] = min(x, y)
                        out.append((int(ids[i]), int(ids[j])))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept for each document: documents are linked where
    100 * intersection >= percent * union of their k-word shingle sets, and the smallest id of a component stays."""
    bands, rows = bands_for(percent)
    bodies = bodies_of(docs, id_col, text_col)
    signed = written(bodies.mapInArrow(_banded(k, bands, rows), "id long, n long, set_key binary, buckets array<long>"), "signed")

    named = signed.filter("set_key is not null and id is not null")
    reps = written(named.groupBy("set_key").agg(F.min("id").alias("rep")), "reps")
    own = named.join(reps.select("set_key", F.col("rep").alias("id")), ["set_key", "id"])
    members = own.select("id", "n", F.explode("buckets").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(members.join(stars, "bucket").select("bucket", "id", "n", "pivot").distinct(), "shared")

    involved = written(shared.select("id").distinct(), "involved")
    held = KeyFilter(involved, "id")
    sets = bodies.filter(held.may_contain(F.col("id"))).join(involved.hint("merge"), "id", "left_semi")  # the shuffle parts the filter's Python from that of the sets
    sets = written(sets.select("id", "body").mapInArrow(_sets(k), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")

    pairs = shared.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    starred = pairs.join(right, "b").join(left, "a").filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common))
    links = written(starred.select("a", "b"), "links")
    comps = written(components(involved, links), "comps")

    labelled = written(shared.select("bucket", "id", "n").join(comps.withColumnRenamed("component", "comp"), "id"), "labelled")
    digest = F.sha2(F.col("id").cast("string"), 256)  # members are told apart by two sums of 60 bits of it each
    who = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"who{i}") for i in range(2)]
    spanning = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("volume"), *who)
    open_ = spanning.filter("lo < hi").groupBy("size", "volume", "who0", "who1").agg(F.min("bucket").alias("bucket"))  # buckets of the same members are one
    open_ = open_.select("bucket", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("volume") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    rest = labelled.join(open_, "bucket").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = rest.join(sets, "id").select("bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "id", "comp", "shingles")
    dealt = dealt.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    more = written(dealt.mapInArrow(_linked(percent), "a long, b long"), "links")
    if not more.isEmpty():
        comps = written(components(involved, links.union(more)), "comps")

    roots = reps.join(comps, reps["rep"] == comps["id"], "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    return signed.join(roots, "set_key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
