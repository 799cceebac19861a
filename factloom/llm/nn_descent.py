"""Embedding near-deduplication on a neighbour graph refined by NN-descent.

Bit-identical vectors are one node with a multiplicity. The graph starts from sorted random-projection codes:
neighbours in sort order are compared in fixed blocks, so a cluster of any size stays balanced. Each round then
joins every node's neighbours and reverse neighbours among themselves, in bounded groups, and keeps the best
`k` of each node, until few lists change. A list that is full and wholly above the threshold is saturated:
the whole clusters (components of found links) of such vectors are compared exactly, within and across
clusters, in pairs of cells that emit counts and the links that join components; only pairs of cells that the
triangle inequality of angles proves too far apart are skipped.

Recall is audited against brute force on vectors outside the clusters compared exactly, as the mean over vectors of
the share of their partners found: vectors that projections of the audit's own show to have partners come first, then
random ones until 200 with partners were met, all or 65,536 were looked at. While it is below the target, lists, tables, sort window and rounds
are doubled, twice at most; if it still is, all vectors are compared exactly, in pairs of blocks. Every link is confirmed by a cosine in double precision.

A pair within rounding of the threshold is judged by one order of summation, whichever step meets it.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing and
are kept; vectors of different length don't link; a null id is returned with no links and a null component; rows
that repeat an id and vector count as copies of each other, and rows that repeat an id with another vector are
vectors of their own, each with its own links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import components, written
from factloom.llm.minhash import _groups
from factloom.llm.shingles import random_words

K, ROUNDS, TABLES = 10, 4, 4
SORT_BLOCK, GROUP, DENSE_BLOCK = 192, 96, 512
#: Vectors of a first draw, vectors with partners that an audit looks for, vectors it looks at, bytes of a draw, and its own tables.
AUDIT, SEEN, MOST_AUDITED, DRAW_BYTES, FRESH_TABLES = 2048, 200, 1 << 16, 16 << 20, 64
TARGET_RECALL = 0.95
EFFORTS, EXACT_BLOCK = (1, 2, 4), 4096


def _units(batches):
    """vec, class key and unit vector (little-endian float64) of each row; no key where the row can't link."""
    for b in batches:
        keys, units = [], []
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            v = np.array(x, dtype=np.float64) if i is not None and x and None not in x else np.zeros(1)
            fit = bool(np.isfinite(v).all() and v.any())
            keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if fit else None)
            with np.errstate(over="ignore", under="ignore"):
                norm = np.linalg.norm(v)
            if fit and not 1e-140 < norm < 1e140:  # squares leave the range of doubles
                v = v / np.abs(v).max()
                norm = np.linalg.norm(v)
            units.append((v / norm).tobytes() if fit else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec", "key", "unit"])


def _matrix(column, dtype="<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def _planes(table: int, width: int) -> np.ndarray:
    u = random_words(64 * width, 100 + table).astype(np.float64) / 2.0**64
    return (u - 0.5).reshape(64, width)


def _coded(tables: int, first: int = 0):
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)

    def run(batches):
        for b in batches:
            for width in sorted({len(x) for x in b.column(1).to_pylist()}):
                own = b.filter(pa.array([len(x) == width for x in b.column(1).to_pylist()]))
                x = _matrix(own.column(1))
                for t in range(first, first + tables):
                    signs = (x @ _planes(t, x.shape[1]).T > 0).astype(np.uint64)
                    code = (signs * weights).sum(axis=1, dtype=np.uint64)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, width, np.int32)), pa.array((code >> np.uint64(1)).astype(np.int64)), own.column(0), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())],
                        ["tab", "width", "code", "id", "vec"],
                    )

    return run


def _best(sims: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Rows (id, other, sim) of each row's k best others, above its floor if given."""
    sims[ids[:, None] == ids[None, :]] = -2.0  # a block may hold the ends of two tables, and so an id twice
    k = min(k, len(ids) - 1)
    if k < 1:
        return None
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(sims, top, axis=1)
    keep = s > -2.0 if floor is None else s > floor[:, None]
    return np.repeat(ids, k).reshape(-1, k)[keep], ids[top][keep], s[keep].astype(np.float32)


_PAIR = "id long, other long, sim float"


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2])], ["id", "other", "sim"])


def _neighbours_in_order(k: int, window: int):
    def run(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while len(held) >= 2 * window:
                yield from block(held.slice(0, window))
                held = held.slice(window // 2)
        if held is not None:
            for i in range(0, len(held), window // 2):
                yield from block(held.slice(i, window))
                if i + window >= len(held):
                    break

    def block(t):
        lens = np.array([len(x) for x in t["vec"].to_pylist()])
        for n in np.unique(lens):
            own = t.filter(pa.array(lens == n))
            x = _matrix(own["vec"], "<f4")
            if (rows := _best(x @ x.T, own["id"].to_numpy(), k)) is not None:
                yield _batch(rows)

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """(id, near): each node's k best distinct others as structs (sim, other).

    The rank limit also holds in each task before the shuffle, so a node that is near to very many
    brings at most k rows of a task with it.
    """
    once = pairs.groupBy("id", "other").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), F.desc("other")))
    best = once.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sim", "other")), asc=False).alias("near"))


def _joined(k: int):
    def run(batches):
        for _, t in _groups(batches, 2):
            lens = np.array([len(x) for x in t["vec"].to_pylist()])
            for n in np.unique(lens):
                own = t.filter(pa.array(lens == n))
                x = _matrix(own["vec"], "<f4")
                if (rows := _best(x @ x.T, own["id"].to_numpy(), k, own["floor"].to_numpy())) is not None and len(rows[0]):
                    yield _batch(rows)

    return run


def descend(vectors: DataFrame, k: int, rounds: int, tables: int = TABLES, window: int = SORT_BLOCK) -> DataFrame:
    """The neighbour graph (id, near) of unit vectors (id, unit)."""
    codes = vectors.select("id", "unit").mapInArrow(_coded(tables), "tab int, width int, code long, id long, vec binary")
    dealt = codes.repartitionByRange("tab", "width", "code", "id").sortWithinPartitions("tab", "width", "code", "id")
    graph = written(_top(dealt.mapInArrow(_neighbours_in_order(k, window), _PAIR), k), "graph")
    vecs = written(codes.filter("tab = 0").select("id", "vec"), "vecs")
    for _ in range(rounds):
        edges = graph.select(F.col("id").alias("hub"), F.explode("near.other").alias("id"))
        edges = edges.union(edges.select(F.col("id"), F.col("hub"))).distinct()
        full = graph.select("id", F.when(F.size("near") >= k, F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        many = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("parts"))
        rows = edges.join(many, "hub").join(vecs, "id").join(full, "id")
        rows = rows.select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", "vec", "floor")
        found = rows.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(_joined(k), _PAIR)
        old = graph.select("id", F.explode("near").alias("x")).select("id", F.col("x.other").alias("other"), F.col("x.sim").alias("sim"))
        new = written(_top(old.union(found), k), "graph")
        moved = graph.select("id", F.col("near.other").alias("a")).join(new.select("id", F.col("near.other").alias("b")), "id")
        changed, total = moved.agg(F.sum(F.size(F.array_except("b", "a"))), F.sum(F.size("b"))).first()
        graph = new
        if not total or changed < 0.002 * total:
            break
    return graph


def _judged(sims: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """sims >= threshold for the products sims of rows of x and y; those within rounding of it are summed in one order."""
    out = sims >= threshold
    i, j = np.nonzero(np.abs(sims - threshold) < 1e-11)
    for k in range(0, len(i), DENSE_BLOCK):
        a, b = i[k : k + DENSE_BLOCK], j[k : k + DENSE_BLOCK]
        out[a, b] = (x[a] * y[b]).sum(axis=1) >= threshold
    return out


def _exact(threshold: float):
    def run(batches):
        for b in batches:
            for k in range(0, len(b), DENSE_BLOCK):
                part = b.slice(k, DENSE_BLOCK)
                lens, other = pc.binary_length(part.column(2)).to_numpy(), pc.binary_length(part.column(3)).to_numpy()
                for width in np.unique(lens):
                    own = part.filter(pa.array((lens == width) & (other == width)))
                    near = (_matrix(own.column(2)) * _matrix(own.column(3))).sum(axis=1) >= threshold if len(own) else []
                    yield own.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return run


def _centred(batches):
    """cell, width, center (a unit vector) and radius (the largest angle to it) of each cell's vectors."""
    for (cell,), t in _groups(batches, 1):
        x = _matrix(t["unit"])
        c = x.mean(axis=0)
        c = c / n if (n := np.linalg.norm(c)) > 1e-6 else x[0]
        radius = float(np.arccos(np.clip((x @ c).min(), -1.0, 1.0)))
        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([c.tobytes()]), pa.array([radius])], ["cell", "width", "center", "radius"])


def _near_cells(threshold: float):
    """Pairs of cells, each with itself too, that may hold a link: by the triangle inequality of angles no other pair can."""
    reach = float(np.arccos(threshold)) + 1e-6

    def run(batches):
        for (_, bi, bj), t in _groups(batches, 3):
            own, cells, radius, x = t["own"].to_numpy(), t["cell"].to_numpy(), t["radius"].to_numpy(), _matrix(t["center"])
            left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
            if not len(left) or not len(right):
                continue
            angle = np.arccos(np.clip(x[left] @ x[right].T, -1.0, 1.0))
            i, j = np.nonzero(angle <= radius[left][:, None] + radius[right][None, :] + reach)
            i, j = cells[left[i]], cells[right[j]]
            keep = (i <= j) if bi == bj else np.ones(len(i), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)[keep]), pa.array(np.maximum(i, j)[keep])], ["ci", "cj"])

    return run


def _counted(threshold: float):
    """Within one pair of cells, exactly: each vector's partners, its links (partners with their copies), and as rows
    (id, other) a spanning forest of the links that join components."""

    def run(batches):
        for (ci, cj), t in _groups(batches, 2):
            own, ids, n, comp, units = t["own"].to_numpy(), t["id"].to_numpy(), t["copies"].to_numpy(), t["component"].to_numpy(), t["unit"].to_pylist()
            lens = np.array([len(u) for u in units])
            for width in np.unique(lens):
                left, right = np.flatnonzero((own == ci) & (lens == width)), np.flatnonzero((own == cj) & (lens == width))
                if not len(left) or not len(right):
                    continue
                y = np.frombuffer(b"".join(units[i] for i in right)).reshape(len(right), -1)
                back, backlinks, forest = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64), []
                for lo in range(0, len(left), DENSE_BLOCK):
                    part = left[lo : lo + DENSE_BLOCK]
                    x = np.frombuffer(b"".join(units[i] for i in part)).reshape(len(part), -1)
                    near = _judged(x @ y.T, x, y, threshold)
                    near &= ids[part][:, None] != ids[right][None, :]
                    yield _counts(ids[part], near.sum(axis=1), near @ n[right])
                    if ci != cj:
                        back += near.sum(axis=0)
                        backlinks += near.T @ n[part]
                    i, j = np.nonzero(near & (comp[part][:, None] != comp[right][None, :]))
                    _, first = np.unique(np.stack([comp[part[i]], comp[right[j]]]), axis=1, return_index=True)
                    forest += zip(part[i[first]].tolist(), right[j[first]].tolist(), strict=True)
                if ci != cj:
                    yield _counts(ids[right], back, backlinks)
                if joins := _forest(forest, comp):
                    a, b = (ids[list(x)] for x in zip(*joins, strict=True))
                    yield _counts(a, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), b)

    return run


def _counts(ids, partners, links, other=None) -> pa.RecordBatch:
    other = pa.nulls(len(ids), pa.int64()) if other is None else pa.array(other)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(partners, pa.int64()), pa.array(links, pa.int64()), other], ["id", "partners", "links", "other"])


def _forest(pairs, comp) -> list:
    """Those of `pairs` of places that join components not yet joined."""
    head: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := head.get(x, x)) != x:
            head[x] = head.get(up, up)
            x = up
        return x

    out = []
    for i, j in pairs:
        x, y = root(int(comp[i])), root(int(comp[j]))
        if x != y:
            head[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _within_cells(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows of `_counted` for members (cell, id, component, unit, copies) over pairs of cells (ci, cj)."""
    ends = pairs.select("ci", "cj", F.explode(F.array_distinct(F.array("ci", "cj"))).alias("cell"))
    rows = ends.join(members, "cell").select("ci", "cj", F.col("cell").alias("own"), "id", "component", "unit", "copies")
    dealt = rows.repartition("ci", "cj").sortWithinPartitions("ci", "cj")
    return dealt.mapInArrow(_counted(threshold), "id long, partners long, links long, other long")


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """All links among the members (id, component, unit, copies) of dense components, within and across them, as
    `_counted` gives them. Components are cut into cells of about a block; cells too far apart to link are skipped."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / DENSE_BLOCK).cast("long").alias("blocks"))
    cell = F.xxhash64("component", F.pmod(F.xxhash64("id"), F.col("blocks")), F.length("unit"))
    members = written(members.join(sizes, "component").select(cell.alias("cell"), "id", "component", "unit", "copies"), "cells")
    centers = written(members.select("cell", "unit").repartition("cell").sortWithinPartitions("cell").mapInArrow(_centred, "cell long, width int, center binary, radius double"), "centers")
    blocks = centers.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / DENSE_BLOCK).cast("long").alias("blocks"))
    spread = centers.join(blocks, "width").withColumn("own", F.pmod(F.xxhash64("cell"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(F.col("width").cast("long").alias("width"), F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "cell", "center", "radius")
    near = spread.repartition("width", "bi", "bj").sortWithinPartitions("width", "bi", "bj").mapInArrow(_near_cells(threshold), "ci long, cj long")
    return _within_cells(members, near, threshold)


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """All links among all members (id, component, unit, copies), every pair of blocks compared, as `_counted` gives them."""
    blocks = max(1, -(-members.count() // EXACT_BLOCK))
    pairs = members.sparkSession.range(blocks).select(F.col("id").alias("ci"), F.explode(F.sequence("id", F.lit(blocks - 1).cast("long"))).alias("cj"))
    return _within_cells(members.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(blocks))), pairs, threshold)


def _audit(queries, threshold: float):
    def run(batches):
        ids, units = queries.value
        hits = np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            raw = b.column(1).to_pylist()
            lens = np.array([len(x) for x in raw])
            for width in np.unique(lens):
                pick = np.flatnonzero(lens == width)
                at = [i for i, u in enumerate(units) if len(u) == width]
                if at:
                    q = np.frombuffer(b"".join(units[i] for i in at)).reshape(len(at), -1)
                    for lo in range(0, len(pick), DENSE_BLOCK):
                        x = np.frombuffer(b"".join(raw[i] for i in pick[lo : lo + DENSE_BLOCK])).reshape(-1, q.shape[1])
                        hits[at] += (q @ x.T >= threshold).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits)], ["id", "hits"])

    return run


def _likely(nodes: DataFrame, threshold: float) -> DataFrame:
    """Ids of vectors (id, unit) that have a partner by projections of their own, which no graph was built from."""
    codes = nodes.select("id", "unit").mapInArrow(_coded(TABLES, FRESH_TABLES), "tab int, width int, code long, id long, vec binary")
    dealt = codes.repartitionByRange("tab", "width", "code", "id").sortWithinPartitions("tab", "width", "code", "id")
    return dealt.mapInArrow(_neighbours_in_order(2, SORT_BLOCK), _PAIR).filter(F.col("sim") >= threshold - 1e-4).select("id").distinct()


def audit(nodes: DataFrame, linked: DataFrame, threshold: float, queries: int = AUDIT, seen: int = SEEN, report: dict | None = None) -> float:
    """The share of its partners that `linked` (id, n_links; copies not counted) holds for a vector, against brute
    force: the mean over vectors of `linked` that have partners, each counting alike.

    A first draw of `queries` takes vectors that fresh projections show to have a partner, so that rare partners are
    met; then random parts of all follow until `seen` vectors with partners were met, all were looked at, or
    MOST_AUDITED were. `report` receives recall, the vectors with partners it rests on, and those looked at.
    """
    spark = nodes.sparkSession
    asked = written(nodes.join(linked.select("id"), "id", "left_semi").select("id", "unit"), "asked")
    total = asked.count()
    width = asked.agg(F.coalesce(F.max(F.length("unit")), F.lit(8))).first()[0]
    draw = max(256, min(1 << 14, DRAW_BYTES // width))
    parts = max(1, -(-total // draw))
    likely = asked.join(_likely(nodes, threshold), "id", "left_semi").orderBy(F.xxhash64("id")).limit(min(queries, draw))
    draws = [likely, *[asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) for i in range(parts)]]
    met, looked, shares = 0, 0, 0.0
    for sample in draws:
        rows = sample.collect()  # bounded by the bytes of a draw
        if rows:
            held = spark.sparkContext.broadcast(([r["id"] for r in rows], [bytes(r["unit"]) for r in rows]))
            true = nodes.select("id", "unit").mapInArrow(_audit(held, threshold), "id long, hits long").groupBy("id").agg((F.sum("hits") - 1).alias("hits"))
            got = linked.join(F.broadcast(true), "id").filter("hits > 0").agg(F.count(F.lit(1)), F.sum(F.least("n_links", "hits") / F.col("hits"))).first()
            held.destroy()
            met, looked, shares = met + got[0], looked + len(rows), shares + (got[1] or 0.0)
        if met >= seen or looked >= MOST_AUDITED:
            break
    recall = shares / met if met else 1.0
    if report is not None:
        report |= {"recall": recall, "with_partners": met, "looked_at": looked}
    return recall


def near_vectors(vectors: DataFrame, threshold: float = 0.9, k: int = K, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """id, n_links, component_id and kept of every vector: vectors are linked where their cosine is >= threshold.
    `report` receives the figures of the last audit."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    units = written(rows.mapInArrow(_units, "vec long, key binary, unit binary"), "units")
    classes = units.filter("key is not null").groupBy("key").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.any_value("unit").alias("unit"))
    nodes = written(classes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # ids may repeat, classes don't
    for effort in EFFORTS:
        size = k * effort
        graph = descend(nodes.select("id", "unit"), size, rounds * effort, TABLES * effort, SORT_BLOCK * effort)
        near = graph.select("id", F.explode("near").alias("x")).filter(F.col("x.sim") >= threshold - 1e-4)
        pairs = near.select(F.least("id", "x.other").alias("a"), F.greatest("id", "x.other").alias("b")).distinct()
        left, right = nodes.select(F.col("id").alias("a"), F.col("unit").alias("ua")), nodes.select(F.col("id").alias("b"), F.col("unit").alias("ub"))
        links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub").mapInArrow(_exact(threshold), "a long, b long"), "links")
        comps = written(components(nodes, links), "comps")
        saturated = graph.filter((F.size("near") >= size) & (F.element_at("near", -1)["sim"] >= threshold - 1e-4)).select("id")
        dense = comps.join(saturated, "id", "left_semi").select("component").distinct()
        members = written(comps.join(dense, "component", "left_semi").join(nodes, "id"), "members")
        counted = written(dense_links(members.select("id", "component", "unit", "copies"), threshold), "counted")
        ends = links.union(links.select("b", "a")).toDF("id", "other").join(members.select("id"), "id", "left_anti")
        listed = ends.join(nodes.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.count(F.lit(1)).alias("partners"), F.sum("copies").alias("links"))
        listed = nodes.select("id").join(members.select("id"), "id", "left_anti").join(listed, "id", "left")
        listed = written(listed.select("id", F.coalesce("partners", F.lit(0)).alias("partners"), F.coalesce("links", F.lit(0)).alias("links")), "listed")
        if audit(nodes, listed.select("id", F.col("partners").alias("n_links")), threshold, report=report) >= TARGET_RECALL:
            break
    else:
        counted = written(exact_links(comps.join(nodes, "id").select("id", "component", "unit", "copies"), threshold), "counted")
        listed = listed.limit(0)
    joins = counted.filter("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    if not joins.isEmpty():
        comps = written(components(nodes, links.union(joins)), "comps")
    found = counted.select("id", "links").union(listed.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))
    linked = nodes.select("id", "copies").join(found, "id", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = nodes.select("id", "key", "vec").join(linked, "id").join(comps, "id")
    least = named.groupBy("component").agg(F.min("vec").alias("component_id"))
    out = units.select("vec", "key").join(named.join(least, "component").select("key", "n_links", "component_id"), "key", "left")
    return out.select(
        F.col("vec").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec").alias("component_id"),
        F.col("vec").eqNullSafe(F.coalesce("component_id", "vec")).alias("kept"),
    )
