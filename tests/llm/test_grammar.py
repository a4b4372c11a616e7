import itertools

from graphloom.llm.toxicity import CLASSES, clause_class


def brute(x):
    """The class of a clause by rules on pairs of places, without states."""
    x = list(x)
    near = lambda a, b, n: [(i, j) for i, s in enumerate(x) for j, t in enumerate(x) if s in a and t in b and 0 < j - i <= n]
    used = set()
    for j in [j for j, s in enumerate(x) if s == "T"]:  # a threat is spent on the first target after it
        before = [i for i in range(max(0, j - 3), j) if x[i] == "H"]
        if before and not used.intersection(range(before[-1], j)):
            used.add(j)
    x = ["K" if j in used else s for j, s in enumerate(x)]
    negated = {j for _, j in near("N", "KIL", 3)}
    x = ["i" if j in negated else s for j, s in enumerate(x)]
    said = x.index("R") if "R" in x else len(x)
    x = ["r" if j > said and s in "KILi" else s for j, s in enumerate(x)]
    # Of targets and insults or learned words in a row within four words, each is paired once, from the left.
    marks, paired, last = [(i, s) for i, s in enumerate(x) if s in "TIL"], {}, None
    for i, s in marks:
        other = last is not None and i - last[0] <= 4 and (s == "T") != (last[1] == "T")
        if other:
            paired[i] = "J" if "I" in (s, last[1]) else "M"
        last = None if other else (i, s)
    x = [paired.get(j, s) for j, s in enumerate(x)]
    said_of = {j for _, j in near("B", "I", 3)}
    x = ["P" if j in said_of else s for j, s in enumerate(x)]
    many = [j for j, s in enumerate(x) if s == "L"][1:]
    x = ["W" if j in many else s for j, s in enumerate(x)]
    return next((c for c in CLASSES if c in x), None)


def test_every_short_clause():
    for n in range(6):
        for x in itertools.product("TNRHILBo", repeat=n):
            assert clause_class(list(x)) == brute(x), x
