import numpy as np
import pytest

from lodestar.config import Config
from lodestar.operators import graphs, vectors


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(30, 16))
    x = centres[rnd.integers(0, 30, 600)] + 0.4 * rnd.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    q = df.filter("id % 20 = 0").selectExpr("id query_id", "v q")
    return x, df, q


def best(x, i, k):
    s = x @ x[i]
    return [int(j) for j in np.lexsort((np.arange(len(x)), -np.round(s, 9)))[:k]]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def test_scans_are_exact_in_any_block_size(data):
    x, df, q = data
    want = {i: best(x, i, 7) for i in range(0, 600, 20)}
    assert found(vectors.search_full(df, q, 7, "id")) == want
    assert found(vectors.search_full(df, q, 7, "id", max_queries=4)) == want
    assert found(vectors.search_full(df, q.limit(0), 7, "id")) == {} and found(vectors.search_full(df.limit(3), q.limit(1), 7, "id")).popitem()[1].__len__() == 3


def test_graphs_find_nearly_all(data):
    x, df, q = data
    g = graphs.build(df, "id", degree=8, width=40, shard=200)
    assert g.select("part").distinct().count() == 3
    got = found(graphs.search(g, q, 10, "id", 40, block=7))
    hits = sum(len(set(got[i]) & set(best(x, i, 10))) for i in range(0, 600, 20))
    assert hits >= 0.9 * 300
    assert graphs.search(graphs.build(df.limit(0), "id"), q, 3, "id").count() == 0


def test_lists_score_codes_and_fall_back_on_empty_ones(data):
    x, df, q = data
    cfg = Config(ivf_lists=8, ivf_probe=2)
    layout = vectors.build(df, "id", cfg=cfg)
    got = found(vectors.search(layout, q, 5, cfg))
    assert all(got[i][0] == i for i in got) and len(got) == 30
    centres = np.vstack([layout["centroids"], -10 * x[0], 10 * x[0]])
    empty = vectors.search_ivf(layout["i8"], centres, q.filter("query_id = 0"), 5, "id", 1, quantized=True)
    assert found(empty)[0] == found(vectors.search_i8(layout["i8"], q.filter("query_id = 0"), 5, "id"))[0]


def test_product_codes_in_lists(data):
    x, df, q = data
    cfg = Config(ivf_lists=8, ivf_probe=8, pq_parts=8, pq_codes=64)
    got = found(vectors.search(vectors.build(df, "id", cfg=cfg, pq=True), q, 10, cfg))
    assert sum(len(set(got[i]) & set(best(x, i, 10))) for i in got) >= 0.6 * 300
