"""Sharding by histogram sort: shards of nearly equal bytes, in DataFrame functions only.

Documents are ordered by a key: 60 bits of their text's SHA-256, then 60 bits of a hash of their id, so equal texts
are neighbours and sources mix. Between two shards lies a splitter. Splitters are found by probing: a round counts
the exact bytes below evenly spaced candidate keys over all partitions (one pre-aggregated groupBy), takes each
candidate that comes within `tolerance` of a shard's size to the wanted count, and spaces the next round's
candidates inside the gaps that still hold a wanted count. A gap that is one text is probed by the ids' hash, so a
text that fills a third of the table is cut like any other; other groups of equal texts stay whole. Then rows move
once, to their shard.

The driver sees counts only: at most `first_probes` in the first round, then `probes` a splitter. A row finds its shard by
a balanced tree of comparisons. Slots are counted in cells, even parts of a shard of about CELL_ROWS rows dealt by
a hash, so no task holds a shard: cells are counted before the move, and a row's slot is its cell's start plus
its place in the cell.

Sizes are as near to equal as whole documents allow: a splitter is off by at most half a document or the tolerance,
whichever is greater.

Defined cases: null texts have no bytes (size 8) and the checksum of the empty text; null ids share one hash; rows
that repeat id and text can't be told apart and stay in one shard, each with a slot of its own; an empty table gives
an empty result, fewer documents than shards leave shards empty; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import text_of, written

SHARDS = 24
#: The part of a shard's size by which a splitter may miss.
TOLERANCE = 0.005
FIRST_PROBES, PROBES = 4096, 256
CELL_ROWS = 1 << 16
#: Bytes that a document takes beside its text.
OVERHEAD = 8
KEY_BITS = 60
_TOP = 1 << KEY_BITS

Key = tuple[int, int]


@dataclass
class Gap:
    """Keys between two candidates, with the bytes before them and the wanted counts they hold. `text` is the
    first part of the key where the gap lies inside one text."""

    text: int | None
    lo: int
    hi: int
    before: int
    wanted: list[int]

    def keys(self) -> tuple[Key, Key]:
        return ((self.lo, 0), (self.hi, _TOP)) if self.text is None else ((self.text, self.lo), (self.text, self.hi))

    def width(self, probes: int) -> int:
        return -(-(self.hi - self.lo + 1) // probes)


def _place(bounds: list[Key], text: Column, own: Column) -> Column:
    """How many of the ascending keys are not above the row's: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        a, b = bounds[mid]
        reached = (text > a) | ((text == a) & (own >= b))
        return F.when(reached, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def _counts(sizes: DataFrame, gaps: list[Gap], probes: int) -> dict[int, list]:
    """Of each gap, the rows (bin, size, least and greatest keys) between its candidates, in order."""
    text, own = F.col("text_key"), F.col("own_key")
    at = _place([g.keys()[0] for g in gaps], text, own) - 1
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("gap") + 1)
    rows = sizes.select("size", "text_key", "own_key", at.alias("gap")).filter("gap >= 0")
    hi_text, hi_own = of([g.keys()[1][0] for g in gaps]), of([g.keys()[1][1] for g in gaps])
    inside = (text < hi_text) | ((text == hi_text) & (own <= hi_own))
    value = F.when(of([g.text is None for g in gaps]) == 1, text).otherwise(own)
    rows = rows.filter(inside).select("gap", "size", "text_key", "own_key", value.alias("value"), of([g.lo for g in gaps]).alias("lo"), of([g.width(probes) for g in gaps]).alias("width"))
    found = rows.groupBy("gap", F.expr("(value - lo) div width").alias("bin")).agg(
        F.sum("size").alias("size"), F.min("text_key").alias("text_lo"), F.max("text_key").alias("text_hi"), F.min("own_key").alias("own_lo"), F.max("own_key").alias("own_hi")
    )
    out: dict[int, list] = {}
    for r in found.orderBy("gap", "bin").collect():  # at most one row a candidate
        out.setdefault(r["gap"], []).append(r)
    return out


def _refine(gap: Gap, bins: list, slack: float, chosen: dict[int, Key]) -> list[Gap]:
    """Chooses splitters where candidates come near enough, and gives the gaps that are left."""
    left, before, wanted = [], gap.before, list(gap.wanted)
    for r in bins:
        after, open_ = before + r["size"], []
        while wanted and wanted[0] <= after:
            w = wanted.pop(0)
            single = r["text_lo"] == r["text_hi"]
            last = single and r["own_lo"] == r["own_hi"]
            if last or min(w - before, after - w) <= slack:
                low = (r["text_lo"], 0) if gap.text is None else (gap.text, r["own_lo"])
                high = (r["text_hi"] + 1, 0) if gap.text is None else (gap.text, r["own_hi"] + 1)
                chosen[w] = low if w - before < after - w else high
            else:
                open_.append(w)
        if open_:
            single = r["text_lo"] == r["text_hi"]
            left.append(Gap(r["text_lo"], r["own_lo"], r["own_hi"], before, open_) if single else Gap(None, r["text_lo"], r["text_hi"], before, open_))
        before = after
    return left


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE, first_probes: int = FIRST_PROBES, probes: int = PROBES) -> list[Key]:
    """The shards - 1 keys between shards, ascending: a row belongs after those not above its own key."""
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = [total * i // shards for i in range(1, shards)]
    chosen: dict[int, Key] = {}
    gaps, now = ([Gap(None, 0, _TOP - 1, 0, sorted(set(wanted)))] if total and wanted else []), first_probes
    while gaps:
        counts = _counts(sizes, gaps, now)
        gaps = [g for i, gap in enumerate(gaps) for g in _refine(gap, counts.get(i, []), tolerance * total / shards, chosen)]
        now = probes
    return [chosen.get(w, (_TOP, 0)) for w in wanted]


def _keys(id_col: str, text_col: str) -> list[Column]:
    text = F.conv(F.substring(F.sha2(text_of(text_col), 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    own = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(id_col)), 64 - KEY_BITS)
    return [text.alias("text_key"), own.alias("own_key")]


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = text_of(text_col)
    size = (F.octet_length(body) + OVERHEAD).cast("long")
    return written(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *_keys(id_col, text_col)), "sizes")


def _placed(rows: DataFrame, sizes: DataFrame, shards: int, tolerance: float, cell_rows: int) -> DataFrame:
    """The rows (with their keys) and their `shard` and `cell`."""
    bounds = splitters(sizes, shards, tolerance)
    cells = 1 + sizes.count() // (shards * cell_rows)
    cell = F.pmod(F.xxhash64(F.lit(2), "text_key", "own_key"), F.lit(cells))
    return rows.withColumns({"shard": _place(bounds, F.col("text_key"), F.col("own_key")), "cell": cell})


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS) -> DataFrame:
    """id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null: shards are cut by size) of every document."""
    sizes = _sizes(docs, id_col, text_col)
    placed = _placed(sizes, sizes, shards, tolerance, cell_rows)
    starts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "cell", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("text_key", "own_key", "id", "text_crc32"))
    moved = placed.withColumn("place", place).join(starts, ["shard", "cell"])
    return moved.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard_no", cell_rows: int = CELL_ROWS) -> None:
    """The documents with all their columns as Parquet under `path`, a folder `shard_col`=k a shard, in key order
    within a file. The whole rows are exchanged once, a cell at a time."""
    if shard_col in docs.columns:
        raise ValueError(f"documents have a column {shard_col} of their own; name another for the shard")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(id_col, text_col))
    rows = _placed(rows, _sizes(docs, id_col, text_col), shards, tolerance, cell_rows)
    rows = rows.repartition("shard", "cell").sortWithinPartitions("shard", "text_key", "own_key")
    rows.select("row.*", F.col("shard").alias(shard_col)).write.partitionBy(shard_col).parquet(path)
