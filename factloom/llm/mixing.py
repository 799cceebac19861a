"""Mixing documents to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are first summed into cells (source, language, topic) with their tokens. Raking then scales the
cells' weights to each target marginal of the token budget in turn, and trims a cell to the tokens it has after
each round, until all agree; the cell table is as large as the distinct triples, never as the documents. A
document's probability is its cell's raked weight over its actual tokens, so at most 1, and it is drawn by
comparing that with a uniform number read off a hash of its id, so a rerun after a lost executor draws the same
documents. No document is drawn twice; a marginal is met as far as its cells have the tokens.

A target gives the wanted share of each value of a marginal. Values that a target leaves out keep their own
share of what it leaves; without a target, shares are the corpus's own, raised to `flatten` and renormed (1
keeps them, 0 makes all values equal).

Defined cases: null source or language is a value of its own ('', shown as null in the result); null and
empty texts count one token; a null id draws the number of the text 'null'; repeated rows are drawn alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import free_name, written

MARGINALS = ("source", "lang", "topic")
ROUNDS = 24
ROUNDS_A_PASS = 8
#: The share of all tokens that the mix keeps.
BUDGET = 0.75
#: Cells up to here are raked in one task, without shuffles; beyond, each marginal is dealt by its value.
ONE_TASK_CELLS = 100_000


def token_count(text: Column) -> Column:
    """Runs of characters other than white space, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: 'contact' holds an address, number or secret; 'listing' has many short lines;
    'note' is short; the rest is 'prose'."""
    t = F.coalesce(text, F.lit(""))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(t.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.|\+[0-9]{1,3} \(|(password|token|key) ?[=:]"), "contact")
        .when((lines >= 4) & (F.length(t) < 120 * lines), "listing")
        .when(F.length(t) < 400, "note")
        .otherwise("prose")
    )


def _shares(cells: DataFrame, name: str, target: Mapping[str, float] | None, flatten: float) -> Column:
    """The wanted share of the row's value of marginal `name`, as a column over the cell table."""
    own = F.sum("tokens").over(Window.partitionBy(name))
    if target:
        chain = F
        for value, share in target.items():
            chain = chain.when(F.col(name) == value, F.lit(float(share)))
        left = max(0.0, 1.0 - sum(target.values()))
        free = F.sum(F.when(F.col(name).isin(*target), F.lit(0)).otherwise(F.col("tokens"))).over(Window.partitionBy(F.lit(0)))
        return chain.otherwise(F.lit(left) * own / free)
    return F.pow(own.cast("double"), F.lit(flatten))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, flatten: float = 0.7, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """The cells with `weight`: their tokens in the mix, so that every marginal has its wanted shares of the budget."""
    targets, every = targets or {}, Window.partitionBy(F.lit(0))
    one_task = cells.count() <= ONE_TASK_CELLS
    at = cells.repartition(1) if one_task else cells
    for name in MARGINALS:
        at = at.withColumn(f"want_{name}", _shares(at, name, targets.get(name), flatten))
    for name in MARGINALS:
        # the shares of a marginal sum to 1 over its values: each value's share counts once
        first = F.row_number().over(Window.partitionBy(name).orderBy(*MARGINALS)) == 1
        at = at.withColumn("once", F.when(first, F.col(f"want_{name}")))
        at = at.withColumn(f"want_{name}", F.col(f"want_{name}") / F.sum("once").over(every) * F.lit(budget) * F.sum("tokens").over(every)).drop("once")
    at = written(at.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for start in range(0, rounds, ROUNDS_A_PASS):
        at = at.coalesce(1) if one_task else at
        for _ in range(start, min(rounds, start + ROUNDS_A_PASS)):
            for name in MARGINALS:
                now = F.sum("weight").over(Window.partitionBy(name))
                at = at.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"want_{name}") / now).otherwise(F.lit(0.0)))
            at = at.withColumn("weight", F.least("weight", F.col("tokens").cast("double")))
        at = written(at, "raked")
    return at


def _keys(source_col: str, lang_col: str, text_col: str) -> dict[str, Column]:
    """The cell of a document, null as ''."""
    return {"source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "topic": topic_of(F.col(text_col))}


def _number(id_col: str, seed: str) -> Column:
    """The uniform number that a document draws."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _chances(rows: DataFrame, targets, flatten: float, rounds: int, budget: float) -> DataFrame:
    """(source, lang, topic, probability) of the cells of rows (source, lang, topic, n_tokens)."""
    cells = written(rows.groupBy(*MARGINALS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    raked = rake(cells, targets, flatten, rounds, budget)
    return raked.select(*MARGINALS, (F.col("weight") / F.col("tokens")).alias("probability"))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, flatten: float = 0.7, rounds: int = ROUNDS, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: str = "mix") -> DataFrame:
    """id, source, lang, topic, n_tokens, probability and selected of every document."""
    rows = docs.select(F.col(id_col), *[c.alias(k) for k, c in _keys(source_col, lang_col, text_col).items()], token_count(F.col(text_col)).alias("n_tokens"))
    rows = written(rows, "rows")
    joined = rows.join(_chances(rows, targets, flatten, rounds, budget), list(MARGINALS), "left")
    return joined.select(
        id_col,
        F.when(F.col("source") != "", F.col("source")).alias("source"),
        F.when(F.col("lang") != "", F.col("lang")).alias("lang"),
        "topic",
        "n_tokens",
        "probability",
        (_number(id_col, seed) < F.col("probability")).alias("selected"),
    )


def draw(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, flatten: float = 0.7, rounds: int = ROUNDS, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: str = "mix") -> DataFrame:
    """The selected documents with all their columns: those that `mix` marks. Each row is judged by itself against
    its cell's chance, so documents only meet the small cell table, which Spark broadcasts if its size allows."""
    own = _keys(source_col, lang_col, text_col)
    rows = docs.select(*[c.alias(k) for k, c in own.items()], token_count(F.col(text_col)).alias("n_tokens"))
    names = {n: free_name(docs, f"own_{n}") for n in (*MARGINALS, "chance", "number")}
    chance = _chances(rows, targets, flatten, rounds, budget).toDF(*[names[m] for m in MARGINALS], names["chance"])
    keyed = docs.withColumns({names[k]: c for k, c in own.items()}).withColumn(names["number"], _number(id_col, seed))
    drawn = keyed.join(chance, [names[m] for m in MARGINALS]).filter(F.col(names["number"]) < F.col(names["chance"]))
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns])
