import random

from graphloom.llm import near_copies


def brute_components(rows, shingle=5, similar=0.8):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or len(x & y) >= similar * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def planted(rng, copies):
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(150, 300))]
        for edits in copies:
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    return rows


def test_near_copies_against_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    texts = planted(rng, [0, 1, 2, 3, 4, 6, 9]) + [None, "", "  ", "one two", "One  two", "one three"]
    rows = list(enumerate(texts))
    want = brute_components(rows)
    assert len(set(want.values())) < len(rows) - 20
    for posting, ends in ((32, 0), (1, 200_000)):  # pairs, and the prefix filter for every bucket; sets by a shuffle and a broadcast
        monkeypatch.setattr(near_copies, "BROADCAST_ENDS", ends)
        got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), posting=posting).collect()
        assert {r.doc_id: r.component_id for r in got} == want
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_group_of_copies_on_both_sides_of_the_threshold(spark):
    rng = random.Random(12)
    rows = list(enumerate(planted(rng, [0, 1, 1, 2, 3, 4, 4, 5, 5, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10])))
    rows += [(1000 + i, " ".join(t.split()[: rng.randint(8, 40)])) for i, t in rows]  # and short ones
    want = brute_components(rows)
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert 30 < len(set(want.values())) < len(rows) - 30 and {r.doc_id: r.component_id for r in got} == want


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rows = list(enumerate(planted(random.Random(4), [0, 2, 3])))
    want = {i for i, least in brute_components(rows).items() if i == least}
    assert len(want) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_similar_texts_that_no_sketch_brings_together(spark):
    import corpus_pipeline

    rng = random.Random(1379)  # MinHash bands of these two sets, 8 of 10 shingles in common, are all different
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(14)]
    docs = spark.createDataFrame([(1, " ".join(words[:12])), (2, " ".join(words)), (3, " ".join(words[:11]))], "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]  # 7 of 8


def test_simhash_groups_are_linked_where_repeats_are_in_common(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    refrain = [word() for _ in range(9)]
    tails = [[word() for _ in range(30)] for _ in range(2)]
    rows = [(1, " ".join(refrain * 60 + tails[0])), (2, " ".join(refrain * 60 + tails[1])), (3, " ".join(refrain + tails[1]))]
    rows += [(k, t) for k, t in enumerate(["", None, " ", "\t", "", "a b"], 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(set(brute_components(rows[:2]).values())) == 2  # sets alone differ too much
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4, 9: 9}  # 3 has the set of 2
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 4, 9]

    # groups are only proposals: texts with little in common are left apart, even in one group
    apart = spark.createDataFrame([(k, " ".join(word() for _ in range(9))) for k in range(3)], "doc_id bigint, text string")
    monkeypatch.setattr(near_copies, "near_duplicates", lambda rows, **_: rows.selectExpr("doc_id", "min(doc_id) over () as component_id"))
    assert all(r.doc_id == r.component_id for r in near_copies.near_copies(apart).collect())
