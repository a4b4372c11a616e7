import re
import unicodedata

import numpy as np

import corpus_pipeline
from graphloom.llm.decontamination import edit_distance


def words(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", t)


def test_decontamination_stage_against_every_item_and_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    planted = [(10**9 + i, t.upper() if i % 2 else " ".join(t.split()[:-1])) for i, t in items]
    extra = spark.createDataFrame(planted, "doc_id bigint, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True).coalesce(1)
    ids = {}
    number = lambda t: np.array([ids.setdefault(w, len(ids)) for w in words(t)], np.int64)
    sought = [number(t) for _, t in items]
    share = {}
    for r in docs.collect():
        text = number(r.text)
        share[r.doc_id] = min(edit_distance(s, text)[0] / len(s) for s in sought)
    kept = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf).collect()}
    assert {d for d, s in share.items() if s > 0.2} <= kept
    assert not kept & {d for d, s in share.items() if s <= 0.1} and not kept & {d for d, _ in planted}
