"""Exact deduplication with a log-structured merge index.

Map tasks fill bounded memtables of (digest, id, count) and flush them as sorted runs, so a text that
fills a third of the corpus leaves a map task once per memtable. Runs meet by digest in merge tasks; each
holds one index shard whose runs carry Bloom filters. Compaction merges runs, keeping the smallest (or
largest) identifier of a digest; a digest that no other run's filter may hold skips the merge. What comes
out is the table of digests seen more than once. Documents probe it by an equi-join on the digest, and every
hit is verified byte by byte against the text of the document that stays; hits that differ are grouped
again by their whole texts.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null id sorts below every
id and is kept only where its group has no other; rows that repeat id and text are copies of each other and
share one decision; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import KeyFilter, text_of, written

MEMTABLE_ROWS = 1 << 17
FANOUT = 8
_ENTRY = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _merged(tables: list[pa.Table], keep: str) -> pa.Table:
    """One sorted run of several: the smallest or largest id and the summed count of each digest."""
    rows = pa.concat_tables(tables).group_by("digest").aggregate([("keep_id", keep), ("n", "sum")])
    return rows.select(["digest", f"keep_id_{keep}", "n_sum"]).rename_columns(_ENTRY.names).cast(_ENTRY).sort_by("digest")


def _hashes(digests: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest, zero-padded, as unsigned integers."""
    cut = b"".join(d[:8].ljust(8, b"\0") for d in digests.to_pylist())
    return np.frombuffer(cut, dtype="<u8")


class Run:
    """An immutable sorted run and its Bloom filter (about 16 bits a key, two probes)."""

    def __init__(self, table: pa.Table):
        self.table, self.hashes = table, _hashes(table["digest"])
        self.mask = np.uint64((1 << max(10, int(16 * max(1, len(self.hashes))).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, dtype=bool)
        for p in self._probes(self.hashes):
            self.bits[p] = True

    def _probes(self, h: np.ndarray):
        yield h & self.mask
        yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(23)) & self.mask

    def may_contain(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for p in self._probes(h):
            out &= self.bits[p]
        return out


class LsmIndex:
    """A log-structured merge index of digests: one memtable and levels of at most `fanout` sorted runs."""

    def __init__(self, keep: str = "min", memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.keep, self.memtable_rows, self.fanout = keep, memtable_rows, fanout
        self.memtable: list[pa.Table] = []
        self.held = 0
        self.levels: list[list[Run]] = []

    def put(self, entries: pa.Table) -> None:
        self.memtable.append(entries)
        self.held += len(entries)
        if self.held >= self.memtable_rows:
            self.flush()

    def flush(self) -> None:
        if self.held:
            run, self.memtable, self.held = Run(_merged(self.memtable, self.keep)), [], 0
            self._add(0, run)

    def _add(self, level: int, run: Run) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._add(level + 1, Run(_merged([r.table for r in runs], self.keep)))

    def repeated(self) -> pa.Table:
        """Every digest counted more than once, with its id and count, in digest order."""
        self.flush()
        runs = [r for level in self.levels for r in level]
        parts = []
        for r in runs:
            shared = r.table["n"].to_numpy() > 1
            for other in runs:
                if other is not r:
                    shared |= other.may_contain(r.hashes)
            parts.append(r.table.filter(pa.array(shared)))
        if not parts:
            return _ENTRY.empty_table()
        out = _merged(parts, self.keep)
        return out.filter(pa.array(out["n"].to_numpy() > 1))


def _flushed(keep: str, memtable_rows: int):
    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]).append_column("n", pa.array(np.ones(len(b), dtype=np.int64))).rename_columns(_ENTRY.names).cast(_ENTRY))
            size += len(b)
            if size >= memtable_rows:
                yield from _merged(held, keep).to_batches()
                held, size = [], 0
        if held:
            yield from _merged(held, keep).to_batches()

    return run


def _compacted(keep: str, memtable_rows: int, fanout: int):
    def run(batches):
        index = LsmIndex(keep, memtable_rows, fanout)
        for b in batches:
            index.put(pa.Table.from_batches([b]).cast(_ENTRY))
        yield from index.repeated().to_batches()

    return run


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest_bytes: int = 32,
    memtable_rows: int = MEMTABLE_ROWS,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256.

    `keep` is 'min' or 'max': which identifier of a group of equal texts stays. `digest_bytes` shortens the
    index's digest; verification keeps the result exact at any length.
    """
    sha = F.sha2(text_of(text_col), 256)
    digest = F.substring(F.unhex(sha), 1, digest_bytes)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), sha.alias("sha"), digest.alias("digest"))
    schema = "digest binary, keep_id long, n long"
    runs = ids.select("digest", F.col("id").alias("keep_id")).mapInArrow(_flushed(keep, memtable_rows), schema)
    repeated = written(runs.repartition("digest").mapInArrow(_compacted(keep, memtable_rows, fanout), schema), "lsm")

    found = ids.join(repeated, "digest", "left")
    named = found.select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), "sha", "digest")

    held = KeyFilter(repeated, "digest")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("body"), digest.alias("digest")).filter(held.may_contain(F.col("digest")))
    kept_text = texts.join(repeated.select("digest", F.col("keep_id").alias("id")), ["digest", "id"]).groupBy("digest").agg(F.min("body").alias("kept_body"))
    differing = written(texts.join(kept_text, "digest").filter("body <> kept_body").select("digest").distinct(), "differing")
    if not differing.isEmpty():
        whole = texts.join(differing, "digest", "left_semi")
        groups = whole.groupBy("digest", "body").agg(getattr(F, keep)("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        again = whole.join(groups, ["digest", "body"]).select("id", "keep_id", "n", F.sha2("body", 256).alias("sha"), "digest")
        named = named.join(differing, "digest", "left_anti").select("id", "keep_id", "n", "sha", "digest").union(again)
    return named.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
