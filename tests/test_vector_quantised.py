import numpy as np

from graphloom.operators import vector


def test_quantised_search_finds_what_codes_rank_low(spark):
    rng = np.random.default_rng(3)
    query = rng.normal(size=16)
    near = query + rng.normal(size=(3000, 16)) * 0.05  # nearer to each other than the codes can tell
    rows = [(i, i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(near)]
    docs = spark.createDataFrame([*rows, (3000, 3000, [0.0] * 16)], "seq bigint, vec_id bigint, embedding array<float>")
    index = vector.build_index(docs).cache()
    want = [(r.vec_id, r.score) for r in vector.top_k(docs, query.tolist(), 5, -1e9, "vec_id").collect()]
    first = [r.vec_id for r in vector.approximate_top_k(index, query.tolist(), 5, -1e9, 1, "vec_id").collect()]
    assert first != [i for i, _ in want]
    assert [(r.vec_id, r.score) for r in vector.quantised_top_k(index, query.tolist(), 5, -1e9, 1, "vec_id").collect()] == want
    assert vector.quantised_top_k(index.where("vec_id < 3"), query.tolist(), 5, -1e9, 1, "vec_id").count() == 3
