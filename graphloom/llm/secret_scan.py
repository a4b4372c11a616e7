"""Secret scanning with corpus-wide ownership frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_heat

# The kinds in the order listed, and the patterns of the three base kinds and of the method's own candidates.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9_-]{24,}"
OPAQUE_RANK = 3

#: A candidate of the method counts as owner-specific while no more owners than this have it.
MAX_OWNERS = 1
#: Values whose owners may be broadcast; beyond it the rarer ones are joined by a shuffle.
BROADCAST_VALUES = 100_000

_MATCH = "struct<rank:int,i:int,gap:bigint,len:bigint,ok:boolean,value:string>"
_SPAN = "struct<start:bigint,rank:int,end:bigint>"


def _matches(text: Column, pattern: str, rank: int, value, ok) -> Column:
    """Leftmost non-overlapping matches of ``pattern``: each one's length and the length of the gap before it.

    ``split`` gives the gaps between the very matches ``regexp_extract_all``
    gives, so the running sum of both lengths is the position.  ``value`` and ``ok``
    are of the whole match; only a digest of the value goes on.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole")
    )
    found = F.transform(
        F.filter(pairs, lambda m: m["whole"].isNotNull()),
        lambda m, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("i"), F.length(m["gap"]).cast("long").alias("gap"), F.length(m["whole"]).cast("long").alias("len"),
            ok(m["whole"]).alias("ok"), F.sha2(value(m["whole"]), 256).alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _positions(found: DataFrame) -> DataFrame:
    """``_row, _owner, _repo, rank, start, end, value`` of the matches that count.

    Positions are running sums in a window of a row's matches of a kind, so a text
    with very many matches costs no more than sorting them.  Opaque strings that
    overlap a base span go: either one that begins before them reaches into them,
    or the next one begins inside them.
    """
    rows = found.select("_row", "_owner", "_repo", F.explode("found").alias("m")).select("_row", "_owner", "_repo", "m.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("_row", "rank").orderBy("i"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok")
    base = F.col("rank") != OPAQUE_RANK
    reach = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("_row").orderBy("start"))
    following = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("_row").orderBy(F.desc("start")))
    rows = rows.withColumn("reach", reach).withColumn("following", following)
    clear = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("following") >= F.col("end"), F.lit(True))
    return rows.where(base | clear).select("_row", "_owner", "_repo", "rank", "start", "end", "value")


def owners_of(spans: DataFrame) -> DataFrame:
    """``value, owners, repos, uses``: distinct owners and repositories of each value, and its uses.

    Distinct pairs are combined in the map tasks first: a value that a third of
    all documents share shrinks to its repositories before it meets in one place.
    """
    pairs = spans.groupBy("value", "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = pairs.groupBy("value", "_owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("uses"))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per input row: base spans, and which credentials only one owner has.

    Base kinds: ``assign`` (a name, a sign and a value of 12 characters or more),
    ``access`` and ``hex``.  The method adds ``opaque`` spans: long mixed strings
    that no base span overlaps and whose hash no more than ``max_owners`` distinct
    owners have in the whole corpus; widely copied examples are left out.

    Columns: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and
    ``n_opaque, n_live, n_copied`` (spans whose value has at most ``max_owners``
    owners, or more; every candidate counts) and ``max_repos``.

    Null texts count as empty: no spans and the digest of the empty string.  A null
    owner or repository is one of its own.  Repeated rows, and rows that share or
    lack an id, give a row each.  Time is in proportion to text and matches (their
    sort aside).  An empty table gives an empty result; other columns are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    itself = lambda whole: whole
    always = lambda whole: F.lit(True)
    assigned = lambda whole: F.regexp_extract(whole, ASSIGN, 1)
    mixed = lambda whole: whole.rlike("[0-9]") & whole.rlike("[a-z]") & whole.rlike("[A-Z]")
    found = cut(  # from here on, digests and lengths only
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col).alias("doc_id"),
            F.coalesce(owner.cast("string"), F.lit("\x00")).alias("_owner"),
            F.coalesce(repository.cast("string"), F.lit("\x00")).alias("_repo"),
            F.concat(
                _matches(text, ASSIGN, 0, assigned, lambda whole: F.length(assigned(whole)) >= 12),
                _matches(text, ACCESS, 1, itself, always),
                _matches(text, HEX, 2, itself, always),
                _matches(text, OPAQUE, OPAQUE_RANK, itself, mixed),
            ).alias("found"),
        )
    )
    spans = cut(_positions(found.where(F.size("found") > 0)))
    judged = join_by_heat(spans.drop("_owner", "_repo"), cut(owners_of(spans)), ["value"], "uses", BROADCAST_VALUES)
    span = F.struct("start", "rank", "end")
    live = F.col("owners") <= max_owners
    count = lambda rank: F.sum((F.col("rank") == rank).cast("long"))
    numbers = {
        "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
        "n_opaque": F.sum(((F.col("rank") == OPAQUE_RANK) & live).cast("long")),
        "n_live": F.sum(live.cast("long")), "n_copied": F.sum((~live).cast("long")), "max_repos": F.max("repos"),
    }
    of_row = judged.groupBy("_row").agg(
        F.collect_list(F.when(F.col("rank") != OPAQUE_RANK, span)).alias("_base"),
        F.collect_list(F.when((F.col("rank") == OPAQUE_RANK) & live, span)).alias("_added"),
        *[n.alias(name) for name, n in numbers.items()],
    )
    none = F.array().cast(f"array<{_SPAN}>")
    base, added = F.coalesce("_base", none), F.coalesce("_added", none)
    number = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return found.select("_row", "doc_id").join(of_row, "_row", "left").select(
        "doc_id", number("n_assign"), number("n_access"), number("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, added)).alias("spans"),
        number("n_opaque"), number("n_live"), number("n_copied"), number("max_repos"),
    )
