"""Layouts, the hash grid, hit tests, picking and force steps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import settled

GOLDEN_ANGLE = math.radians(137.507764)
GRID, LEAST_CELL = 128, 100.0


def spiral(idx: Column) -> tuple[Column, Column]:
    angle, radius = idx * F.lit(GOLDEN_ANGLE), F.lit(35.0) * F.sqrt(idx + 1)
    return radius * F.cos(angle), radius * F.sin(angle)


def grid_layout(df: DataFrame, n: int) -> DataFrame:
    cols = max(2, math.ceil(math.sqrt(n)))
    return df.withColumn("x", F.pmod("idx", F.lit(cols)) * 650.0).withColumn("y", F.floor(F.col("idx") / cols) * 400.0)


def bounding_box(df: DataFrame) -> DataFrame:
    return df.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def centre_of_mass(df: DataFrame, *keys: str) -> DataFrame:
    """Weighted mean place of each cell."""
    return df.groupBy(*keys).agg(
        (F.sum(F.col("x") * F.col("mass")) / F.sum("mass")).alias("cx"), (F.sum(F.col("y") * F.col("mass")) / F.sum("mass")).alias("cy"), F.sum("mass").alias("m")
    )


def cell(value: Column, scale: float = 1.0, clamp: bool = True) -> Column:
    size = max(LEAST_CELL, 120.0 * scale)
    at = F.floor(value / size) + GRID // 2
    return F.least(F.greatest(at, F.lit(0)), F.lit(GRID - 1)) if clamp else at


def _around() -> Column:
    """The nine cells at and around one, as offsets ``a, b``."""
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))


def neighbour_pairs(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """``i, j`` (``i < j``) of nodes in the same or adjoining cells: nine keys a node and an equi-join.

    Cells at the grid's border hold all that lies beyond it, so a view far larger than the grid has
    about as many pairs as its nodes squared; :func:`neighbour_counts` and :func:`collisions` make none of them.
    """
    at = df.select("idx", "x", "y", cell(F.col("x"), scale).alias("cx"), cell(F.col("y"), scale).alias("cy"))
    near = at.select(F.col("idx").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), "cx", "cy", _around().alias("o"))
    near = near.select("i", "xi", "yi", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"))
    return near.join(at.select(F.col("idx").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), "cx", "cy"), ["cx", "cy"]).where("i < j")


#: Indices of a cell that are ranked in one group.
RANKED = 1 << 15


def neighbour_counts(df: DataFrame, scale: float = 1.0, ranked: int = RANKED) -> DataFrame:
    """``i, n``: how many pairs of :func:`neighbour_pairs` begin with ``i``, of nodes with any, without making the pairs.

    A node is posted to its nine cells; its later neighbours are those of higher index posted to its own
    cell, which are ranked in blocks of ``ranked`` indices, so that no group grows with a crowded cell.
    """
    at = df.select("idx", cell(F.col("x"), scale).alias("cx"), cell(F.col("y"), scale).alias("cy"), _around().alias("o"))
    own = (F.col("o.a") == 0) & (F.col("o.b") == 0)
    posts = at.select("idx", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"), own.alias("own"), F.floor(F.col("idx") / ranked).alias("block"))
    posts = posts.where(F.col("cx").between(0, GRID - 1) & F.col("cy").between(0, GRID - 1))
    blocks = posts.groupBy("cx", "cy", "block").agg(F.count(F.lit(1)).alias("later"))
    above = Window.partitionBy("cx", "cy").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("later", F.coalesce(F.sum("later").over(above), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("cx", "cy", "block").orderBy(F.desc("idx"))) - 1
    found = posts.withColumn("rank", rank).where("own").join(blocks, ["cx", "cy", "block"])
    return found.select(F.col("idx").alias("i"), (F.col("rank") + F.col("later")).alias("n")).where("n > 0")


def in_circle(x: float, y: float, radius: Column | None = None) -> Column:
    r = F.col("radius") if radius is None else radius
    return (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= r * r


def in_box(x: float, y: float, half: Column | None = None) -> Column:
    h = F.col("radius") if half is None else half
    return (F.abs(F.col("x") - x) <= h) & (F.abs(F.col("y") - y) <= h)


def near_segment(ax: float, ay: float, bx: float, by: float, r: float) -> Column:
    """Whether a node's place is within ``r`` of a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.lit(0.0) if length == 0 else F.least(F.greatest(((F.col("x") - ax) * dx + (F.col("y") - ay) * dy) / length, F.lit(0.0)), F.lit(1.0))
    ex, ey = F.col("x") - (ax + t * dx), F.col("y") - (ay + t * dy)
    return ex * ex + ey * ey <= r * r


def pick(df: DataFrame, x: float, y: float) -> DataFrame:
    """The topmost node hit: by level, then nearness, then the highest index."""
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return df.where(in_circle(x, y)).orderBy(F.desc("z"), d, F.desc("idx")).limit(1)


def pick_ray(df: DataFrame, origin: tuple, direction: tuple) -> DataFrame:
    """The first sphere a ray meets; radii are enlarged by a quarter and at least 4."""
    o = [F.col(c) - v for c, v in zip(("x", "y", "z"), origin, strict=True)]
    along = sum(a * b for a, b in zip(o, direction, strict=True))
    radius = F.greatest(F.col("radius") * 1.25, F.lit(4.0))
    off = sum(a * a for a in o) - along * along
    t = along - F.sqrt(F.greatest(radius * radius - off, F.lit(0.0)))
    return df.where((off <= radius * radius) & (t > 0)).withColumn("t", t).orderBy("t", "idx").limit(1)


def _flag(df: DataFrame, name: str) -> Column:
    """A boolean column, false where the view has none of that name."""
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _seen(df: DataFrame) -> DataFrame:
    return df.where(~_flag(df, "hidden"))


def softened(d2, mass, other):
    """Squared distance, not under what keeps two masses from overlapping; columns or arrays."""
    return (F.greatest if isinstance(d2, Column) else np.maximum)(d2, 64 + 4 * (mass + other))


#: Nodes of a cell, and nodes around them, that meet in one task; a cell with more is dealt to several.
OWN, OTHERS = 2048, 32768


def repulsion(df: DataFrame, k: float = 1.0, cutoff: float = 2500.0, own: int = OWN, others: int = OTHERS) -> DataFrame:
    """``idx, fx, fy``: exact pairwise repulsion of visible nodes with another inside the cutoff, which the tree only approximates.

    Places are dealt to cells of the cutoff's size and meet those of the nine cells around, as matrices of
    at most about ``own`` by ``others``; every pair is computed, none becomes a row.
    """
    at = _seen(df).select("idx", "x", "y", "mass", F.floor(F.col("x") / cutoff).alias("cx"), F.floor(F.col("y") / cutoff).alias("cy")).where("cx is not null and cy is not null")
    near = lambda d: d.select("*", _around().alias("o")).withColumns({"cx": F.col("cx") + F.col("o.a"), "cy": F.col("cy") + F.col("o.b")}).drop("o")
    cells = at.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    around = near(cells).groupBy("cx", "cy").agg(F.sum("n").alias("m"))
    parts = cells.join(around, ["cx", "cy"]).select("cx", "cy", F.ceil(F.col("n") / own).alias("a"), F.ceil(F.col("m") / others).alias("b"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("idx"), F.col(c))
    left = at.join(parts, ["cx", "cy"]).withColumn("a", deal("a")).withColumn("b", every("b"))
    right = near(at).join(parts, ["cx", "cy"]).withColumn("b", deal("b")).withColumn("a", every("a"))

    def run(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        x, y, m = (mine[c].to_numpy(float) for c in ("x", "y", "mass"))
        ox, oy, om = (other[c].to_numpy(float) for c in ("x", "y", "mass"))
        fx, fy, n = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for lo in range(0, len(x), 16):
            some = slice(lo, lo + 16)
            dx, dy = x[some, None] - ox, y[some, None] - oy
            d2 = dx * dx + dy * dy
            inside = d2 <= cutoff * cutoff
            soft = softened(d2, m[some, None], om)
            force = np.where(inside, k * 350.0 * om / (soft * np.sqrt(soft)), 0.0)
            fx[some], fy[some], n[some] = (dx * force).sum(axis=1), (dy * force).sum(axis=1), inside.sum(axis=1)
        return pd.DataFrame({"idx": mine["idx"], "fx": fx, "fy": fy, "n": n})

    keys = ["cx", "cy", "a", "b"]
    renamed = lambda d: d.select(*[F.col(c).alias(c) for c in ("x", "y", "mass", "idx", *keys)]).groupBy(*keys)  # noqa: E731  columns of their own
    found = renamed(left).cogroup(renamed(right)).applyInPandas(run, "idx long, fx double, fy double, n long")
    total = found.groupBy("idx").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"), F.sum("n").alias("n"))
    return total.where("n > 1").drop("n")  # itself is one


def pyramid(df: DataFrame, levels: int, x0: float, y0: float, size: float) -> DataFrame:
    """``level, gx, gy, w, px, py, n``: mass, its centre and number of visible nodes of every filled square of every level.

    Every level is an aggregate of the one below, so nodes are shuffled once.
    """
    n = 1 << levels
    at = lambda c, o: F.least(F.floor((F.col(c) - o) / size * n), F.lit(n - 1)).cast("long")
    level = _seen(df).groupBy(at("x", x0).alias("gx"), at("y", y0).alias("gy"))
    level = level.agg(F.sum("mass").alias("w"), F.sum(F.col("x") * F.col("mass")).alias("sx"), F.sum(F.col("y") * F.col("mass")).alias("sy"), F.count(F.lit(1)).alias("n"))
    out = None
    for k in range(levels, -1, -1):
        level = settled(level.select(F.lit(k).alias("level"), "gx", "gy", "w", "sx", "sy", "n"))
        out = level if out is None else out.unionByName(level)
        level = level.groupBy(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy")).agg(*[F.sum(c).alias(c) for c in ("w", "sx", "sy", "n")])
    return out.select("level", "gx", "gy", "w", (F.col("sx") / F.col("w")).alias("px"), (F.col("sy") / F.col("w")).alias("py"), "n")


def tree_repulsion(df: DataFrame, k: float = 1.0, theta: float = 0.85, cutoff: float = 2500.0, levels: int | None = None) -> DataFrame:
    """``idx, fx, fy``: Barnes-Hut repulsion of a view of any size, as one join of nodes with squares for each level.

    A square that is small against its distance acts as its centre of mass; the
    others are opened.  On the lowest level nodes meet the nodes of their squares exactly.
    """
    bounds = _seen(df).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not bounds[4]:
        return df.select("idx", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy")).limit(0)
    size = max(bounds[1] - bounds[0], bounds[3] - bounds[2]) + 80
    x0, y0 = (bounds[0] + bounds[1] - size) / 2, (bounds[2] + bounds[3] - size) / 2
    levels = levels or max(1, math.ceil(math.log(bounds[4] + 1, 4)))
    squares = settled(pyramid(df, levels, x0, y0, size))
    nodes = _seen(df).select("idx", "x", "y", "mass")
    todo = nodes.select("idx", "x", "y", "mass", F.lit(0).cast("long").alias("gx"), F.lit(0).cast("long").alias("gy"))
    forces = []
    for level in range(1, levels + 1):
        step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o")
        todo = todo.select("idx", "x", "y", "mass", "gx", "gy", step)
        todo = todo.select("idx", "x", "y", "mass", (F.col("gx") * 2 + F.col("o.a")).alias("gx"), (F.col("gy") * 2 + F.col("o.b")).alias("gy"))
        met = todo.join(squares.where(F.col("level") == level).drop("level"), ["gx", "gy"])
        dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
        d2 = dx * dx + dy * dy
        soft = softened(d2, F.col("mass"), F.col("w"))
        width = size / (1 << level)
        own = (F.floor((F.col("x") - x0) / width) == F.col("gx")) & (F.floor((F.col("y") - y0) / width) == F.col("gy"))
        far = ~own & (width * width / soft < theta * theta)
        force = k * 350.0 * F.col("w") / soft / F.sqrt(soft)
        near = (d2 <= cutoff * cutoff)
        met = settled(met.withColumn("_far", far).withColumn("_fx", F.when(near, dx * force).otherwise(0.0)).withColumn("_fy", F.when(near, dy * force).otherwise(0.0)))
        forces.append(met.where("_far").select("idx", F.col("_fx").alias("fx"), F.col("_fy").alias("fy")))
        todo = met.where("not _far").select("idx", "x", "y", "mass", "gx", "gy")
    n = 1 << levels
    at = lambda c, o: F.least(F.floor((F.col(c) - o) / size * n), F.lit(n - 1)).cast("long")
    other = nodes.select(F.col("idx").alias("oi"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("mass").alias("om"), at("x", x0).alias("gx"), at("y", y0).alias("gy"))
    pairs = todo.join(other, ["gx", "gy"]).where("idx <> oi")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    d2 = dx * dx + dy * dy
    soft = softened(d2, F.col("mass"), F.col("om"))
    force = F.when(d2 <= cutoff * cutoff, k * 350.0 * F.col("om") / soft / F.sqrt(soft)).otherwise(0.0)
    forces.append(pairs.select("idx", (dx * force).alias("fx"), (dy * force).alias("fy")))
    out = forces[0]
    for f in forces[1:]:
        out = out.unionByName(f)
    return out.groupBy("idx").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def springs(df: DataFrame, edges: DataFrame, strength: float = 0.24, scale: float = 1.0, dragged: float = 0.65) -> DataFrame:
    """``idx, fx, fy`` of edges ``i, j``; all from the same places, unlike a sequential update.

    Half the pull goes to each end.  A pinned end stays, and the other gets one and a half
    times a stronger pull; edges with a hidden end, and of no length, pull nothing.
    """
    end = lambda i: df.select(
        F.col("idx").alias(i), *[F.col(c).alias(c + i) for c in ("x", "y", "radius", "degree")], _flag(df, "pinned").alias("p" + i), _flag(df, "hidden").alias("h" + i)
    )
    e = edges.join(end("i"), "i").join(end("j"), "j").where("not hi and not hj")
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    d = F.sqrt(dx * dx + dy * dy)
    target = 160 + 0.85 * scale * (F.col("radiusi") + F.col("radiusj"))
    damped = strength / F.sqrt(F.greatest(F.lit(1.0), 0.15 * F.greatest("degreei", "degreej")))
    pull = F.when(F.col("pi") | F.col("pj"), dragged).otherwise(damped) * (d - target) / d
    e = e.where(d >= 0.001).select("i", "j", "pi", "pj", (dx * pull).alias("px"), (dy * pull).alias("py"))
    share = lambda own, other: F.when(F.col(own), 0.0).when(F.col(other), 1.5).otherwise(0.5)
    both = e.select(F.col("i").alias("idx"), (F.col("px") * share("pi", "pj")).alias("px"), (F.col("py") * share("pi", "pj")).alias("py"))
    both = both.unionByName(e.select(F.col("j").alias("idx"), (-F.col("px") * share("pj", "pi")).alias("px"), (-F.col("py") * share("pj", "pi")).alias("py")))
    return both.groupBy("idx").agg(F.sum("px").alias("fx"), F.sum("py").alias("fy"))


def _close_pairs(df: DataFrame, scale: float) -> DataFrame:
    """Pairs ``i < j`` of :func:`neighbour_pairs` that may overlap, with both ends' ``x, y, r, p``.

    Of the nodes gathered in a border cell only those near each other are paired: a node is posted to a
    cell as wide as it can reach, of twice the width on each level, and met by those that reach no further.
    """
    size = max(LEAST_CELL, 120.0 * scale)
    r = F.col("radius") * scale
    level = F.greatest(F.ceil(F.log2(F.greatest((2 * r + 6.0 * scale) / size, F.lit(1.0)))).cast("int"), F.lit(0))
    at = df.select("idx", "x", "y", r.alias("r"), _flag(df, "pinned").alias("p"), cell(F.col("x"), scale).alias("cx"), cell(F.col("y"), scale).alias("cy"), level.alias("level"))
    levels = [x.level for x in at.where("level is not null").select("level").distinct().orderBy("level").collect()]  # one for each doubling of the radius
    put = lambda c, k: F.floor(F.col(c) / (size * F.pow(F.lit(2.0), k)))
    own = at.select("*", put("x", F.col("level")).alias("gx"), put("y", F.col("level")).alias("gy"))
    met = at.select("*", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("at")).where("at >= level").select("*", _around().alias("o"))
    met = met.select(*[F.col(c).alias("o_" + c) for c in at.columns], F.col("at").alias("level"), (put("x", F.col("at")) + F.col("o.a")).alias("gx"), (put("y", F.col("at")) + F.col("o.b")).alias("gy"))
    pairs = own.join(met, ["level", "gx", "gy"]).where("(o_level < level or idx < o_idx) and abs(cx - o_cx) <= 1 and abs(cy - o_cy) <= 1")
    first = F.col("idx") < F.col("o_idx")
    ends = lambda c, i, j: (F.when(first, F.col(c)).otherwise(F.col("o_" + c)).alias(i), F.when(first, F.col("o_" + c)).otherwise(F.col(c)).alias(j))
    dx, dy = F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")
    pairs = pairs.where((F.sqrt(dx * dx + dy * dy) < F.col("r") + F.col("o_r") + 6.0 * scale))
    return pairs.select(*ends("idx", "i", "j"), *[e for c in "xyrp" for e in ends(c, c + "i", c + "j")])


def collisions(df: DataFrame, scale: float = 1.0, hard: float = 0.60, soft: float = 0.35) -> DataFrame:
    """``idx, fx, fy``: overlapping pairs of adjoining cells push each other apart, harder where the overlap is large."""
    pairs = _close_pairs(_seen(df), scale)
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    d = F.sqrt(dx * dx + dy * dy)
    over = F.col("ri") + F.col("rj") + 6.0 * scale - d
    push = F.when(over > F.col("ri") * 0.5, hard).otherwise(soft) * over / d / 2
    p = pairs.where((over > 0) & (d * d > 0.0001)).select("i", "j", "pi", "pj", (dx * push).alias("px"), (dy * push).alias("py"))
    free = lambda own, c: F.when(F.col(own), 0.0).otherwise(F.col(c))
    both = p.select(F.col("i").alias("idx"), free("pi", "px").alias("px"), free("pi", "py").alias("py"))
    both = both.unionByName(p.select(F.col("j").alias("idx"), (-free("pj", "px")).alias("px"), (-free("pj", "py")).alias("py")))
    return both.groupBy("idx").agg(F.sum("px").alias("fx"), F.sum("py").alias("fy"))


# Fixed values of the force steps.
REPULSION, REPULSION_POWER, STEP, CENTRE, CENTRE_STEP = 10.0, 12.0, 0.016, 0.35, 0.002
DAMPING, TOP_SPEED, COOLING, ASLEEP = 0.68, 15.0, 0.016, 0.001


def cooled(alpha: float) -> float:
    """The next step's energy."""
    return alpha - alpha * COOLING


def reheated(alpha: float, energy: float = 1.0) -> float:
    return max(alpha, energy)


def physics(df: DataFrame, edges: DataFrame, steps: int = 1, alpha: float = 1.0, scale: float = 1.0, exact: bool = True) -> DataFrame:
    """``df`` after ``steps`` of repulsion (exact, or by the tree), springs, collisions and centre pull.

    A node is hidden or pinned where columns of those names say so: hidden ones do
    nothing, and neither moves.  Below the least energy all stand still.
    """
    state = df
    for _ in range(steps):
        alpha = cooled(alpha)
        if alpha < ASLEEP:
            return state.withColumn("vx", F.lit(0.0)).withColumn("vy", F.lit(0.0)).select(*df.columns)
        far = (repulsion if exact else tree_repulsion)(state, REPULSION * REPULSION_POWER, cutoff=2500.0 * max(1.0, 0.75 * scale))
        scaled = lambda forces, by: forces.select("idx", (F.col("fx") * by).alias("fx"), (F.col("fy") * by).alias("fy"))
        forces = scaled(far, alpha * STEP).unionByName(scaled(springs(state, edges, scale=scale), alpha)).unionByName(scaled(collisions(state, scale), alpha))
        total = forces.groupBy("idx").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        zero = F.lit(0.0)
        moved = state.join(total, "idx", "left")
        pull = lambda v, f, x: (F.col(v) + F.coalesce(f, zero) - F.col(x) * (CENTRE * CENTRE_STEP * alpha)) * DAMPING
        moved = moved.withColumn("nvx", pull("vx", "fx", "x")).withColumn("nvy", pull("vy", "fy", "y"))
        speed = F.sqrt(F.col("nvx") ** 2 + F.col("nvy") ** 2)
        still = _flag(df, "pinned") | _flag(df, "hidden")
        slow = F.when(still, 0.0).when(speed > TOP_SPEED, TOP_SPEED / speed).otherwise(1.0)
        moved = moved.withColumn("vx", F.col("nvx") * slow).withColumn("vy", F.col("nvy") * slow)
        state = settled(moved.withColumn("x", F.col("x") + F.col("vx")).withColumn("y", F.col("y") + F.col("vy")).select(*df.columns))
    return state


def elevated(df: DataFrame, three_d: bool = True) -> DataFrame:
    """``elevation``: 45 for each level in three dimensions, else 0."""
    return df.withColumn("elevation", F.col("z") * 45.0 if three_d else F.lit(0.0))


def barnes_hut(points: pd.DataFrame, theta: float = 0.85, k: float = 1.0, cutoff: float = 2500.0) -> np.ndarray:
    """Approximate repulsion of one view's nodes (``x, y, mass``) over a pyramid of square cells."""
    x, y, m = (points[c].to_numpy(float) for c in ("x", "y", "mass"))
    force = np.zeros((len(x), 2))
    if not len(x):
        return force
    size = max(np.ptp(x), np.ptp(y)) + 80
    x0, y0 = (x.min() + x.max() - size) / 2, (y.min() + y.max() - size) / 2
    top = max(1, min(10, math.ceil(math.log(len(x) + 1, 4)) + 1))
    open_ = [(np.arange(len(x)), np.zeros(len(x), int), np.zeros(len(x), int))]
    todo, gx, gy = open_[0]
    for level in range(1, top + 1):
        n = 1 << level
        cx, cy = np.minimum(((x - x0) / size * n).astype(int), n - 1), np.minimum(((y - y0) / size * n).astype(int), n - 1)
        mass = np.zeros((n, n))
        np.add.at(mass, (cx, cy), m)
        mx, my = np.zeros((n, n)), np.zeros((n, n))
        np.add.at(mx, (cx, cy), m * x)
        np.add.at(my, (cx, cy), m * y)
        todo = np.repeat(todo, 4)
        gx, gy = np.repeat(gx * 2, 4) + np.tile([0, 0, 1, 1], len(gx)), np.repeat(gy * 2, 4) + np.tile([0, 1, 0, 1], len(gy))
        own = (cx[todo] == gx) & (cy[todo] == gy)
        w = mass[gx, gy]
        full = w > 0
        todo, gx, gy, own, w = todo[full], gx[full], gy[full], own[full], w[full]
        px, py = mx[gx, gy] / w, my[gx, gy] / w
        dx, dy = x[todo] - px, y[todo] - py
        d2 = dx * dx + dy * dy
        far = ~own & ((size / n) ** 2 < theta * theta * softened(d2, m[todo], w))
        last = level == top
        w = np.where(own, w - m[todo], w) if last else w
        use = (far | last) & (d2 <= cutoff * cutoff) & (w > 0)
        soft = softened(d2, m[todo], w)
        f = k * 350.0 * w / soft / np.sqrt(soft)
        np.add.at(force, todo[use], np.column_stack([dx * f, dy * f])[use])
        if not last:
            todo, gx, gy = todo[~far], gx[~far], gy[~far]
    return force
