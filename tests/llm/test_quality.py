import math
import random
from collections import Counter, defaultdict

from graphloom.llm import quality


def estimates(trusted, n):
    """An independent, recursive estimator over dictionaries: probability of a gram's last symbol."""
    counts = [None] * (n + 1)
    counts[n] = Counter(("\n" * (n - 1) + t)[i : i + n] for t in trusted for i in range(len(t)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    contexts = [None] + [defaultdict(list) for _ in range(n)]
    discounts = [None]
    for k in range(1, n + 1):
        of = Counter(counts[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        discounts.append([0] + [min(max(j - (j + 1) * y * of[j + 1] / of[j], 0.05), j - 0.05) if of[j] else 0.5 for j in (1, 2, 3)])
        for g, c in counts[k].items():
            contexts[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        rest = p(g[1:])
        seen = contexts[k].get(g[:-1])
        if not seen:
            return rest
        cut = lambda c: discounts[k][min(c, 3)]
        c = counts[k].get(g, 0)
        return (c - (cut(c) if c else 0) + sum(map(cut, seen)) * rest) / sum(seen)

    return p


def perplexity(p, text, n):
    padded = "\n" * (n - 1) + text
    return math.exp(-sum(math.log(p(padded[i : i + n])) for i in range(len(text))) / len(text)) if text else 1.0


def fixture():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgé日本жд𝄞", k=rng.randint(1, 5))) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 60))), "en" if i % 3 else "fr") for i in range(60)]
    rows += [(60, None, "en"), (61, "", None), (62, "ZZZ qqq", None), (None, "no id", "de"), (62, rows[3][1], "xx"), (None, "no id", "de")]
    return rows


def test_perplexity_against_an_independent_estimator(spark, monkeypatch):
    rows = fixture()
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id bigint, text string, lang string, perplexity string, c double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(1, 0, 0), (None, 1, 0), (60, 1, 0)], "doc_id bigint, quality int, toxic int")
    apart = {r.id for r in spark.range(60).where(f"pmod(xxhash64(id), {quality.APART}) = 0").collect()}
    trusted = [t for i, t, _ in rows if i is not None and i < 60 and i % 2 == 0 and i not in apart]
    assert 0 < len(trusted) < 30
    monkeypatch.setattr(quality, "SLICE", 50)  # texts and slices don't end together
    for block in (8 << 20, 1):
        monkeypatch.setattr(quality, "BLOCK", block)
        got = quality.classify_quality(docs, labels).collect()
        p = estimates(trusted, quality.ORDER)
        want = sorted((-1 if i is None else i, len(t or ""), perplexity(p, t or "", quality.ORDER)) for i, t, _ in rows)
        for g, w in zip(sorted((-1 if r.doc_id is None else r.doc_id, r.n_symbols, r.perplexity) for r in got), want, strict=True):
            assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-5)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 60}
    assert all(r.kept == (r.low <= r.perplexity <= r.high) for r in got) and sum(by[i].kept for i in range(0, 60, 2)) > 20
    high = {r.high for r in got if r.lang == 'en'}
    assert len(high) == 1 and high <= {by[i].perplexity for i in apart if i % 2 == 0}


def test_probabilities_sum_to_one(spark):
    text = "the cat sat on the mat and the hat"
    symbols = sorted(set(text)) + ["?"]  # one symbol that trusted text lacks
    context = "\n" * (quality.ORDER - 1)
    grams = Counter((context + text)[i : i + quality.ORDER] for i in range(len(text)))
    for ctx in (context, (context + text)[2:6], "zzzz", "at s"[-(quality.ORDER - 1) :]):
        asked = {**{ctx + s: 0 for s in symbols}, **grams}
        p = quality.kneser_ney(spark.createDataFrame(list(asked.items()), "gram string, c bigint"))
        assert abs(sum(r.p for r in p.where(p.gram.startswith(ctx)).collect() if r.gram[-1] in symbols) - 1) < 1e-9


def test_without_labels_all_stay(spark):
    docs = spark.createDataFrame(fixture(), "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = quality.classify_quality(docs, none).collect()
    assert len(got) == len(fixture()) and all(r.kept for r in got)
    assert quality.classify_quality(docs.where("false"), none).count() == 0
