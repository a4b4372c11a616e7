import random

import pyarrow as pa

import corpus_pipeline
from graphloom.llm.packing import pack_documents
from graphloom.llm.queries import WORD_TOKENIZER, tokenizer_file


def test_the_stage_leaves_no_memory_in_the_workers(spark):
    def held(batches):
        from graphloom.llm import packing

        ids = [x for x in packing._ids.values() if getattr(x, "most", None) != packing.MEMO]  # op4's keep what they know
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(ids)], "kept": [sum(len(x.memo) + len(x.plain) for x in ids)]})

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghIJ", k=rng.randint(3, 9))) + rng.choice(["", ",", "..."])
    texts = [" ".join(word() for _ in range(200)) for _ in range(600)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    rows = lambda df: sorted(df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())

    got = rows(corpus_pipeline.packing(spark, docs, ""))
    found = spark.range(0, 8, 1, 8).mapInArrow(held, "n long, kept long").collect()
    assert max(r.n for r in found) and not any(r.kept for r in found)
    want = rows(pack_documents(docs, tokenizer_file(WORD_TOKENIZER)))
    assert got == want == rows(pack_documents(docs, tokenizer_file(WORD_TOKENIZER), memo=100))  # overrun by every text
