import re

import numpy as np
import pytest

from factloom.operators import vectors as V


def plain_top(rows, asked, top, same_document=False):
    out = {}
    fit = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    for qi, qd, qv in asked:
        if fit(qv):
            near = [(-round(float(unit(qv) @ unit(v)), 9), k) for k, d, v in rows if fit(v) and (not same_document or d == qd)]
            out[qi] = [(k, -s) for s, k in sorted(near)[:top]]
    return {q: x for q, x in out.items() if x}


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
        assert len(out[r["query_id"]]) == r["place"]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    made = [(i, i % 5 if i % 3 else 0, [float(x) for x in centres[i % 12] + 0.3 * rng.normal(size=16)]) for i in range(700)]
    made += [(1000 + i, 1, made[5][2]) for i in range(9)]  # ties
    return made + [(2000, 0, None), (2001, 0, []), (2002, 0, [0.0] * 16), (2003, 0, [float("nan")] + [1.0] * 15), (2004, 2, [1e200] * 16), (2005, 2, [1e-200] * 16), (2006, 2, [None] + [1.0] * 15)]


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, document_id long, embedding array<double>").selectExpr("*", "1 AS k", "2 AS v", "3 AS doc", "4 AS similarity")


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "i")
    V.write_cells(frame(spark, rows, "id"), path, "id", cells=12)
    return V.Cells(spark, path)


@pytest.mark.parametrize("by_document", [False, True])
def test_top_many_matches_brute_force(spark, rows, by_document):
    asked = rows[::20] + rows[-7:]
    got = V.top_many(frame(spark, rows, "id"), frame(spark, asked, "query_id"), "id", "query_id", top=4, document="document_id" if by_document else None, block=50, query_block=10)
    assert answers(got) == plain_top(rows, asked, 4, by_document)


def test_exact_cells_match_brute_force(spark, rows, index):
    asked = rows[::20] + rows[-7:]
    got = index.top(frame(spark, asked, "query_id"), "query_id", probes=1, top=4, exact=True, block=50, query_block=10)
    assert answers(got) == plain_top(rows, asked, 4)


def test_a_step_of_exact_cells_plans_nothing_that_was_done_before(spark, rows, index):
    got = index.top(frame(spark, rows[::20], "query_id"), "query_id", probes=1, exact=True)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("CoGroup") == 1


def test_probed_cells_reach_the_recall_and_are_all_that_is_read(spark, rows, index):
    asked = frame(spark, rows[::20], "query_id")
    probes, got = V.tuned_probes(index, asked, "query_id")
    assert got >= V.RECALL and probes < len(index)
    exact = V.top_many(frame(spark, rows, "id"), asked, "id", "query_id")
    assert V.recall(index.top(asked, "query_id", probes=probes), exact, "query_id", "id") >= V.RECALL
    one = index.top(asked.limit(1), "query_id", probes=1)
    plan = one._jdf.queryExecution().toString()
    assert len(set(re.findall(r"PartitionFilters: \[.*?cell#\d+ (?:IN|=) .*?\]", plan))) >= 1


def test_every_fit_vector_is_indexed(rows, index):
    assert sorted(r["k"] for r in index.vectors.select("k").collect()) == sorted(k for k, _, _ in rows if k < 2000 or k in (2004, 2005))


def test_empty_tables(spark, rows, tmp_path):
    none, asked = frame(spark, [], "id"), frame(spark, rows[:3], "query_id")
    assert V.top_many(none, asked, "id", "query_id").count() == 0
    assert V.top_many(frame(spark, rows, "id"), asked.limit(0), "id", "query_id").count() == 0
    V.write_cells(none, str(tmp_path / "i"), "id")
    assert V.Cells(spark, str(tmp_path / "i")).top(asked, "query_id", exact=True).count() == 0
