"""Toxicity scores from a weighted finite-state pattern grammar."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import cut, packed

# The grammar's terminals in English, German, French and Spanish.
INSULT = """idiot moron scum trash clown pathetic loser worthless stupid disgusting imbecile dumb vermin filth coward
    dummkopf abschaum trottel versager erbärmlich wertlos ekelhaft crétin ordure minable débile abruti lâche
    imbécil estúpido basura escoria patético inútil asqueroso""".split()
THREAT = "kill hurt destroy beat burn töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGET = "you your yours u he she they them him her du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes vosotros".split()
NEGATION = "not no never isn't aren't wasn't nicht kein keine nie pas jamais nunca jamás tampoco".split()
COPULA = "is are was were am be you're he's she's they're it's ist sind war bist seid est sont es suis êtes es son eres eras".split()
REPORT = "said says wrote claims quoted reported sagte schrieb behauptet a-dit écrit déclare dijo escribió afirma".split()

#: Labelled training rows that a fit reads at most, taken in order of a hash of the id.
TRAIN_ROWS = 8_000
#: Learned terminals are stems of these lengths, of words in this many toxic training texts at least,
#: and in at most this share of that number of clean ones.
STEM, LEARN_LEAST, LEARN_CLEAN = range(3, 9), 6, 0.25
#: Stems compared in the greedy choice, and chosen.
CANDIDATES, LEARN_MOST = 2_000, 64

# Classes of a clause, the heaviest first, with their prior weights: a threat to someone, an insult at someone, an insult said of
# something, a learned word at someone, several learned words, an insult or a learned word that no one is the target of, a negated or reported match,
# and a threat to no one.  The fit starts from these and is drawn to them: without labels an insult alone condemns no text.
CLASSES = {"K": 7.0, "J": 7.0, "P": 5.0, "M": 4.5, "W": 3.0, "I": 1.5, "L": 1.0, "i": 0.3, "r": 0.3, "H": 0.3}
BIAS = -3.5

_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:,\n|]")


class Transducer:
    """A sequential transducer: ``step(state, symbol) -> (state, symbol)``."""

    def __init__(self, step, start=0):
        self.step, self.start = step, start

    def compose(self, other: Transducer) -> Transducer:
        """This transducer's output read by ``other``."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer(step, (self.start, other.start))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for x in symbols:
            state, y = self.step(state, x)
            out.append(y)
        return out


def _threat(state: int, x: str):
    """A threat within three words before its target makes the target ``K``."""
    if x == "H":
        return 3, x
    return (0, "K") if x == "T" and state else (max(0, state - 1), x)


def _negation(state: int, x: str):
    """What matches within three words after a negation is a negated match, ``i``."""
    if x == "N":
        return 3, x
    return max(0, state - 1), "i" if x in "KIL" and state else x


def _reported(state: int, x: str):
    """What matches after a verb of saying is a reported match, ``r``."""
    return (1, x) if x == "R" else (state, "r" if state and x in "KILi" else x)


def _target(state: int, x: str):
    """An insult within four words of whom it addresses makes ``J``, a learned word ``M``, at the later of the two.

    The state counts words since a target (above 0), an insult (below 0) or a learned word (below -10).
    """
    if x == "T":
        return (0, "J") if -10 < state < 0 else (0, "M") if state < 0 else (4, x)
    if x in "IL":
        return (0, "J" if x == "I" else "M") if state > 0 else (-4 if x == "I" else -14, x)
    return (state - 1 if state > 0 else state + 1 if state not in (0, -11) else 0), x


def _predicate(state: int, x: str):
    """An insult within three words after a copula is said of something, ``P``."""
    if x == "B":
        return 3, x
    return max(0, state - 1), "P" if x == "I" and state else x


def _repeated(state: int, x: str):
    """A learned word after another one in the clause is ``W``."""
    return (1, "W" if state else x) if x == "L" else (state, x)


GRAMMAR = Transducer(_threat)
for _next in (_negation, _reported, _target, _predicate, _repeated):
    GRAMMAR = GRAMMAR.compose(Transducer(_next))


def clause_class(symbols: list[str]) -> str | None:
    """The heaviest class among what the composed transducers put out for a clause."""
    out = set(GRAMMAR.run(symbols))
    return next((c for c in CLASSES if c in out), None)


class Matcher:
    """Counts the clauses of each class in texts; ``stems`` are learned insults, ``L``, by how words begin."""

    def __init__(self, stems: Iterable[str] = ()):
        groups = (("T", TARGET), ("R", REPORT), ("N", NEGATION), ("H", THREAT), ("I", INSULT), ("B", COPULA))
        self.kind = {w: k for k, words in groups for w in words}
        heads = [re.escape(w) for w in sorted({*INSULT, *THREAT})]
        begins = "|".join(map(re.escape, sorted(stems)))
        self.stem = re.compile(begins) if begins else None
        self.head = re.compile("|".join([*heads, rf"\b(?:{begins})"] if begins else heads))

    def symbol(self, word: str) -> str:
        return self.kind.get(word) or ("L" if self.stem and self.stem.match(word) else "o")

    def counts(self, text: str) -> list[int]:
        """Clauses of each class; those without an insult or threat can't match and are skipped."""
        found = dict.fromkeys(CLASSES, 0)
        low, done = text.lower(), 0
        for m in self.head.finditer(low):
            if m.start() < done:
                continue
            begin = max((low.rfind(c, done, m.start()) + 1 for c in ".!?;:,\n|"), default=0)
            begin = max(begin, done)
            end = _CLAUSE_END.search(low, m.end())
            done = end.start() if end else len(low)
            symbols = [self.symbol(w) for w in _WORD.findall(low, begin, done)]
            if not {"I", "H", "L"}.isdisjoint(symbols):
                if kind := clause_class(symbols):
                    found[kind] += 1
        return list(found.values())


def _squash(counts: np.ndarray) -> np.ndarray:
    return np.minimum(counts, 3).astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_weights(counts: np.ndarray, labels: np.ndarray, rounds: int = 50, pull: float = 0.05) -> np.ndarray:
    """Logistic weights, the bias last, drawn to the priors, by Newton's steps; without both labels, the priors."""
    prior = np.array([*CLASSES.values(), BIAS])
    if len(labels) == 0 or labels.min() == labels.max():
        return prior
    x = np.hstack([_squash(counts), np.ones((len(labels), 1))])
    w, n = prior.copy(), len(labels)
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - labels) / n + pull / n * (w - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x / n + (pull / n + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _stems(text: str) -> set[str]:
    """Beginnings, of each length of :data:`STEM`, that two words of a text or more have."""
    words = _WORD.findall(text.lower())
    return {stem for k in STEM for stem, n in Counter(w[:k] for w in words if k <= len(w)).items() if n > 1}


def _learned_stems(sample: DataFrame) -> list[str]:
    """Stems of words of toxic training texts that the grammar has no match in, and of hardly any clean one.

    Stems are taken greedily, each for the texts that those before it leave, so
    that stems which copies of one text share are not all taken.
    """
    matcher = Matcher()

    def counted(rows: DataFrame, known: frozenset | None) -> DataFrame:
        """``stem, n``: texts without a match that have each stem, of ``known`` ones only if there are."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for text in batch.column(0):
                    text = text.as_py()
                    if known is not None or not any(matcher.counts(text)):
                        seen.update(_stems(text) if known is None else _stems(text) & known)
            keys = list(seen)
            for lo in range(0, len(keys), 50_000):
                some = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[k] for k in some], pa.int64())], ["stem", "n"])

        return rows.select("text").mapInArrow(count, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    # bounded by the sample
    often = {r.stem: r.n for r in counted(sample.where("toxic = 1"), None).where(F.col("n") >= LEARN_LEAST).collect()}
    clean = {r.stem: r.n for r in counted(sample.where("toxic = 0"), frozenset(often)).collect()} if often else {}
    good = {k: clean.get(k, 0) for k, n in often.items() if clean.get(k, 0) <= LEARN_CLEAN * n}
    good = {k: good[k] for k in sorted(good, key=lambda k: (-often[k], k))[:CANDIDATES]}
    if not good:
        return []

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = good.keys()
        for batch in batches:
            held = [sorted(_stems(text) & known) if not any(matcher.counts(text)) else [] for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in held if x], pa.list_(pa.string()))], ["held"])

    texts: dict[str, set[int]] = {}
    for i, row in enumerate(sample.where("toxic = 1").select("text").mapInArrow(hold, "held array<string>").collect()):
        for stem in row.held:
            texts.setdefault(stem, set()).add(i)
    taken: list[str] = []
    while texts and len(taken) < LEARN_MOST:
        stem = max(texts, key=lambda x: (len(texts[x]) - good[x], len(texts[x]), len(x), x))
        hit = texts.pop(stem)
        if len(hit) < LEARN_LEAST:
            break
        taken.append(stem)
        texts = {x: t - hit for x, t in texts.items()}
    return taken


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> tuple[list[str], list[float]]:
    """Learned terminals and weights, from at most ``train_rows`` labelled rows that aren't held out."""
    train = labels.where("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    train = train.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(train), "doc_id").select("text", "toxic")
    sample = cut(sample)  # bounded by train_rows, and read several times
    learned = _learned_stems(sample)
    rows = _counted(sample, Matcher(learned), F.col("toxic")).collect()
    counts = np.array([r.counts for r in rows]).reshape(-1, len(CLASSES))
    return learned, fit_weights(counts, np.array([r.row for r in rows], float)).tolist()


def _counted(docs: DataFrame, matcher: Matcher, more: Column) -> DataFrame:
    """``row, counts``: column ``more`` and the numbers of clauses of each class of every text.

    A struct that has the text itself is all that is sent to the workers.
    """
    slim = docs.select(more.alias("row"))
    kind = slim.schema["row"].dataType
    inside = [f.name for f in kind.fields].index("text") if isinstance(kind, StructType) and "text" in kind.fieldNames() else None
    if inside is None:
        slim = docs.select(more.alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1) if inside is None else batch.column(0).field(inside)
            counts = [matcher.counts(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64()))], ["row", "counts"])

    return slim.mapInArrow(run, StructType([slim.schema["row"], StructField("counts", ArrayType(LongType()))]))


def _score(weights: list[float]) -> Column:
    clipped = F.transform("counts", lambda c: F.least(c, F.lit(3)).cast("double"))
    parts = F.zip_with(clipped, F.array(*map(F.lit, weights[:-1])), lambda c, x: c * x)
    return 1 / (1 + F.exp(-F.aggregate(parts, F.lit(weights[-1]), lambda a, b: a + b)))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns; a map without shuffle.

    Null and empty texts stay, as they match nothing; repeated rows stay or go
    together; ids may be null or equal; an empty table gives an empty result.
    """
    stems, weights = fit_toxicity(docs, labels, train_rows=train_rows)
    return _counted(docs, Matcher(stems), packed(docs)).where(_score(weights) < threshold).select("row.*")


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Each clause with an insult or a threat runs through the composed threat,
    negation, reported-speech, target, predicate and repetition transducers; the heaviest class
    they put out is the clause's, and a text's numbers of clauses are weighted.  Weights, and terminals for toxic texts without a known word, come
    from at most ``train_rows`` labelled rows whose id's checksum isn't held out.
    Labels, languages, sources and ids are no input of a score.  A map without shuffle.

    Null and empty texts score the bias alone.  Null labels aren't used; without
    labels of both kinds the prior weights hold.  Repeated rows give a row each; a
    null id is not held out.  Empty table: empty result; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stems, weights = fit_toxicity(slim, labels, train_rows=train_rows)
    return (
        _counted(slim, Matcher(stems), F.col("doc_id"))
        .withColumnRenamed("row", "doc_id")
        .select(
            "doc_id",
            F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
            _score(weights).alias("score"),
        )
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
