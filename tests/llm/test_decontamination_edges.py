import random
import time
import unicodedata

import numpy as np

from graphloom.llm import decontamination


def test_edited_copies_at_the_ends_of_documents(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(18, 45)))) for i in range(30)]
    rows, want = [], {}
    for i, t in items:
        w = t.split()
        changes = {"last changed": [*w[:-1], "changed"], "last missing": w[:-1], "two missing": [*w[:5], *w[6:10], *w[11:]], "first changed": ["changed", *w[1:]]}
        for k, copy in enumerate(changes.values()):
            for place, parts in enumerate(([copy], [copy, ["outro"] * 9], [["intro"] * 9, copy])):
                doc = 100 * i + 10 * k + place
                rows += [(doc, " ".join(sum(parts, []))), (100_000 + doc, "a clean text that is nobody's copy " * 4)]
                want[doc] = (i, 9 if place == 2 else 0, len(copy))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = decontamination.find_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: r.item_id for r in got} == {d: i for d, (i, _, _) in want.items()}
    for r in got:
        _, start, size = want[r.doc_id]
        assert abs(r.start_word - start) <= 2 and abs(r.n_words - size) <= 2 and r.start_word >= 0


def test_copies_in_capitals_and_other_normal_forms(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeéñóíßüœçж", k=7)) for _ in range(300)]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(10)]
    forms = [str.upper, str.title, lambda t: unicodedata.normalize("NFD", t), lambda t: unicodedata.normalize("NFD", t.upper())]
    rows = [(10 * i + k, "Intro text " + form(t) + " outro.") for i, t in items for k, form in enumerate(forms)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.find_contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(10 * i + k, i, 0) for i, _ in items for k in range(len(forms))}


def test_recall_of_edited_copies(spark):
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    words = [w for _, t in items for w in t.split()]
    rows, want = [], set()
    for i, t in items:
        for k, share in enumerate((0.05, 0.1, 0.15)):
            w = t.split()
            for _ in range(int(share * len(w))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[f"edit{rng.random()}"], [], [w[at], "more"]])
            rows.append((10 * i + k, " ".join(rng.choices(words, k=rng.randint(0, 60))) + " " + " ".join(w) + " tail of the text"))
            want.add((10 * i + k, i))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, bench).collect()}
    assert len(got & want) >= 0.9 * len(want)  # the aim of the sampled places


def _found(index, texts):
    """What a batch of documents of words gives, best match of each pair."""
    parts = [np.array([index.vocab.get(w, 0) for w in t], np.int64) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    best = {}
    for item, d, start, end, edits in index.search(np.concatenate(parts), np.cumsum(lengths) - lengths, lengths):
        best[d, item] = min(best.get((d, item), (edits, start, end)), (edits, start, end))
    return best


def test_a_batch_finds_what_its_documents_find_alone():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    items = [(i, rng.choices(words, k=rng.randint(12, 60))) for i in range(150)]
    longest = max(items, key=lambda x: len(x[1]))[1]
    texts = [longest, [], ["only"]]
    for _, item in items:
        copy = list(item)
        for _ in range(int(0.2 * len(copy))):
            copy[rng.randrange(len(copy))] = "edit"
        texts.append(rng.choices(words, k=rng.randint(0, 9)) + copy + rng.choices(words, k=rng.randint(0, 9)))
    index = decontamination.Index(items)
    alone = {(d, item): row for d, t in enumerate(texts) for (_, item), row in (_found(index, [t]) if t else {}).items()}
    assert _found(index, texts) == alone and len(alone) > 0.8 * len(items)


def test_one_long_item_costs_others_little():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    items = [(i, rng.choices(words, k=20)) for i in range(100)]
    texts = [rng.choices(words, k=60) + rng.choice(items)[1] for _ in range(400)]
    few, many = decontamination.Index(items), decontamination.Index([*items, (999, rng.choices(words, k=15_000))])
    took = []
    for index in (few, many):
        began = time.process_time()
        found = _found(index, texts)
        took.append(time.process_time() - began)
        assert len(found) >= 400
    assert took[1] < 2 * took[0] + 0.5
