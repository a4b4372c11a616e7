"""C# source as a table of tokens, and the declarations and edges of the second reading from windows over it.

A token is a row with its place and line; strings and comments are tokens, so nothing
in them is read, except the code between the braces of an interpolated string.  Type
declarations raise a running depth that the ends of their bodies lower, and the type
around a token is the last one declared at its depth.

A file's tokens stay in one row, as an array: neighbours, heads of declarations and what
an edge is made of are told there.  Rows of their own, which are sorted for the windows,
are only braces, declarations and tokens that make edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ID = r"@?[\p{L}_][\p{L}\p{N}_]*+"
_CHAIN = rf"{_ID}(?:\s*\.\s*{_ID})*+"
_STRING = r'"(?:[^"\\\n]++|\\.)*+"'
_HOLE = rf'\{{(?:[^{{}}"]++|{_STRING})*+\}}'
_GENERIC = r"<[\w\s.,?<>\[\]]*>"
#: Group 1: what makes a chain of names a call.
TOKEN = "|".join((
    r"(?s)//[^\n]*+", r"/\*.*?\*/", r'""".*?"""',
    rf'\$"(?:[^"\\{{}}\n]++|\\.|\{{\{{|\}}\}}|{_HOLE})*+"', rf'(?:\$@|@\$)"(?:[^"{{}}]++|""|\{{\{{|\}}\}}|{_HOLE})*+"', r'@"(?:[^"]++|"")*+"', _STRING, r"'(?:[^'\\\n]|\\.[^'\n]*+)'",
    rf"new\s+{_CHAIN}(?:\s*{_GENERIC})?(?=\s*[({{])", rf"{_CHAIN}(?=(\s*(?:{_GENERIC}\s*)?\()?)",
    r"\d\w*+(?:\.\d\w*+)?+", r"\+=|-=|=>|\?\.|==|!=|<=|>=|&&|\|\||\?\?|::|\+\+|--", r"\s++", ".",
))
CALLED = 1
MADE = r"(?s)^new\s+([^\s.].*)$"  # the type of an object creation, of its token
_BLANK = r"^(\s|//|/\*)"

# Words of the language that may stand before a call; another name there makes it a member's declaration.
BEFORE_CALLS = "return throw await else do in is as case when yield and or not out ref where select from let by equals on into orderby ascending descending".split()

EDGE = "path string, src string, dst string, kind string, details string, line_number int"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _beside(items: Column, by: int, missing: Column) -> Column:
    """An array's items moved on by one (1: each place has the item before it) or back (-1), ``missing`` at the open end; not for empty arrays."""
    kept = F.slice(items, F.lit(1 if by > 0 else 2), F.size(items) - 1)
    return F.concat(F.array(missing), kept) if by > 0 else F.concat(kept, F.array(missing))


def _numbers(items: Column) -> Column:
    """Places of an array's items, from 0; not for empty arrays."""
    return F.sequence(F.lit(0), F.size(items) - 1)


def _cut(text: Column) -> Column:
    """Tokens of a text as an array of ``tok, called``."""
    part = lambda k: F.regexp_extract_all(text, F.lit(TOKEN), F.lit(k))
    return F.arrays_zip(part(0).alias("tok"), part(CALLED).alias("called"))


def _read(raw: Column) -> Column:
    """Tokens of :func:`_cut` as ``i, j, tok, called``, without blanks and comments.

    Code in an interpolated string has the string's place ``i`` and its own ``j``.
    """
    blank = lambda t: t["tok"].rlike(_BLANK)
    placed = lambda i, j, t: F.struct(i.alias("i"), j.alias("j"), t["tok"].alias("tok"), t["called"].alias("called"))
    numbered = F.when(F.size(raw) > 0, F.arrays_zip(raw["tok"].alias("tok"), raw["called"].alias("called"), _numbers(raw).alias("i")))
    own = F.transform(F.filter(numbered, lambda t: ~blank(t)), lambda t: placed(t["i"], F.lit(0), t))
    inner = lambda t: F.concat_ws(" , ", F.regexp_extract_all(F.regexp_replace(t["tok"], r"\{\{|\}\}", " "), F.lit(r"\{([^{}]*)\}"), F.lit(1)))
    holes = lambda t: F.filter(F.transform(_cut(inner(t)), lambda u, j: placed(t["i"], j, u)), lambda u: ~blank(u))
    interpolated = lambda t: t["tok"].rlike(r"^(\$|@\$)")
    opened = lambda ts: F.flatten(F.transform(ts, lambda t: F.when(interpolated(t), holes(t)).otherwise(F.array(t))))
    return F.coalesce(_let(own, lambda ts: F.when(F.exists(ts, interpolated), opened(ts)).otherwise(ts)), F.array())


def _bases(head: Column, declares: Column) -> Column:
    """Edges to the types that a declaration's ``head`` names after its colon: the first is its base unless it looks like an interface."""
    text = F.array_join(head, " ")
    for _ in range(6):  # what brackets enclose, from within
        text = F.regexp_replace(F.regexp_replace(text, r"<[^<>()]*>", ""), r"\([^<>()]*\)", "")
    text = F.regexp_replace(F.regexp_extract(text, r"^[^:]*:(.*)$", 1), r"\bwhere\b.*$", "")
    names = F.filter(F.transform(F.split(text, ","), lambda b: F.regexp_replace(b, r"\s+", "")), lambda b: b != "")
    implements = lambda dst, k: (declares == "interface") | (k > 0) | dst.rlike("^I[A-Z]")
    return F.transform(names, lambda dst, k: F.when(implements(dst, k), _edge(k, dst, "Implements", F.lit("Interface"))).otherwise(_edge(k, dst, "Inherits", F.lit("Base Class"))))


def _edge(k: Column, dst: Column, kind: str, details: Column) -> Column:
    return F.struct(k.alias("k"), dst.alias("dst"), F.lit(kind).alias("kind"), details.alias("details"))


_NONE = "array<struct<k:int,dst:string,kind:string,details:string>>"


def _edges(t: Column) -> Column:
    """Edges that a token makes, whichever type is around it: a creation, or a call, a subscription and singletons of a chain of names."""
    none = F.array().cast(_NONE)
    plain = lambda c: F.regexp_replace(c, r"\s*\.\s*", ".")
    made = lambda m: F.array(_edge(F.lit(0), m, "Instantiates", F.concat(F.lit("new "), m, F.lit("()"))))
    declared = t["prev"].rlike(rf"^{_CHAIN}$") & ~t["prev"].isin(BEFORE_CALLS)

    def of_chain(names: Column) -> Column:
        upto, member = F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), "."), F.element_at(names, -1)
        call = F.when((t["called"] != "") & ~declared, F.array(_edge(F.lit(1), upto, "MethodCall", F.concat(F.lit("Method '"), member, F.lit("()'"))))).otherwise(none)
        event = F.when(t["next"].isin("+=", "-="), F.array(_edge(F.lit(2), upto, "EventSubscription", F.concat(F.lit("Event '"), member, F.lit("' "), t["next"])))).otherwise(none)
        one = F.transform(names, lambda x, at: F.when((at > 0) & x.isin("Instance", "Current"), _edge(F.lit(3), F.array_join(F.slice(names, F.lit(1), at), "."), "SingletonAccess", F.concat(F.lit("."), x))))
        return F.concat(call, event, F.filter(one, lambda e: e.isNotNull()))

    chain = t["tok"].contains(".") & t["tok"].rlike(rf"^{_ID}\s*\.") & ~t["prev"].isin(".", "?.")
    whole = F.when(chain, _let(F.split(plain(t["tok"]), r"\."), of_chain)).otherwise(none)
    creates = t["tok"].startswith("new") & t["tok"].rlike(MADE)
    return F.when(creates, _let(plain(F.trim(F.regexp_extract(t["tok"], MADE, 1))), made)).otherwise(whole)


def _rows(read: Column) -> Column:
    """What is sorted of a file's tokens: ``i, j, turn, opens, ends, name, declares, own, edges``.

    ``turn`` is 1 and -1 at braces.  A brace ``opens`` the type that was declared since the last
    mark (a declaration, a brace or a semicolon), a semicolon ``ends`` it; others are left out.
    ``own`` are the edges of a declaration's bases, ``edges`` those from the type around a token.
    """
    toks = read["tok"]
    near = F.when(F.size(read) > 0, F.arrays_zip(read.alias("t"), _beside(toks, 1, F.lit(None)).alias("prev"), _beside(toks, -1, F.lit(None)).alias("next"), _numbers(read).alias("at")))
    may = lambda tok: tok.contains(".") | tok.startswith("new") | tok.isin("{", "}", ";", "class", "struct", "interface")
    told = F.transform(F.filter(near, lambda z: may(z["t"]["tok"])), lambda z: F.struct(
        z["at"].alias("at"), *[z["t"][x].alias(x) for x in ("i", "j", "tok", "called")], F.coalesce(z["prev"], F.lit("")).alias("prev"), F.coalesce(z["next"], F.lit("")).alias("next")))

    def marked(t: Column) -> Column:
        declares = t["tok"].isin("class", "struct", "interface") & t["next"].rlike(rf"^{_ID}$") & (t["next"] != "where") & ~t["prev"].isin("record", ":", ",")
        mark = F.when(declares, F.lit("d")).when(t["tok"].isin("{", "}", ";"), t["tok"])
        return F.struct(*[t[x].alias(x) for x in ("at", "i", "j", "tok", "next")], mark.alias("mark"), _edges(t).alias("edges"))

    row = lambda t, turn, opens, ends, name, declares, own, edges: F.struct(
        t["i"].alias("i"), t["j"].alias("j"), turn.alias("turn"), opens.alias("opens"), ends.alias("ends"), name.alias("name"), declares.alias("declares"), own.alias("own"), edges.alias("edges"))
    none, no, text = F.array().cast(_NONE), F.lit(False), F.lit(None).cast("string")

    def of_marks(marks: Column) -> Column:
        around = F.arrays_zip(marks.alias("t"), _beside(marks, 1, F.lit(None))["mark"].alias("last"), _beside(marks, -1, F.lit(None))["at"].alias("stop"))
        needed = F.filter(around, lambda z: (z["t"]["mark"] != ";") | (z["last"] == "d"))

        def one(z: Column) -> Column:
            t, after = z["t"], F.coalesce(z["last"] == "d", no)
            head = F.slice(read["tok"], t["at"] + 2, F.coalesce(z["stop"], F.size(read)) - t["at"] - 1)
            return F.when(t["mark"] == "d", row(t, F.lit(0), no, no, t["next"], t["tok"], _bases(head, t["tok"]), none)).otherwise(
                row(t, F.when(t["mark"] == "{", 1).when(t["mark"] == "}", -1).otherwise(0), after & (t["mark"] == "{"), after & (t["mark"] == ";"), text, text, none, none))

        return F.when(F.size(marks) > 0, F.transform(needed, one))

    def both(ts: Column) -> Column:
        marks = _let(F.filter(ts, lambda t: t["mark"].isNotNull()), of_marks)
        makers = F.transform(F.filter(ts, lambda t: F.size(t["edges"]) > 0), lambda t: row(t, F.lit(0), no, no, text, text, none, t["edges"]))
        return F.concat(F.coalesce(marks, F.slice(makers, 1, 0)), makers)

    return F.coalesce(_let(F.transform(told, marked), both), F.array())


def _lined(rows: Column, breaks: Column) -> Column:
    """``rows`` in their order, each with the line breaks (``breaks`` of each token) since the row before."""
    at = F.arrays_zip(rows.alias("r"), _beside(rows, 1, F.lit(None))["i"].alias("before"))
    since = lambda z: F.aggregate(F.slice(breaks, F.coalesce(z["before"], F.lit(0)) + 1, z["r"]["i"] - F.coalesce(z["before"], F.lit(0))), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(rows) > 0, F.transform(at, lambda z: F.struct(z["r"].alias("r"), since(z).alias("breaks"))))


def owned_rows(sources: DataFrame) -> DataFrame:
    """``path, f, i, j, line, name, declares, own, edges, owner``: the rows of ``(path, text)`` files with the name of the type around each.

    Files of one path are read as they are sorted by their text; null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    files = sources.select(F.xxhash64("path", text).alias("f"), "path", text.alias("text"))
    files = files.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "f", "path")  # whole files are dealt, so that tokens aren't
    breaks = lambda raw: F.transform(raw["tok"], lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))))
    sort = lambda rows: F.array_sort(rows, lambda a, b: F.when(a["i"] != b["i"], a["i"] - b["i"]).otherwise(a["j"] - b["j"]))
    rows = _let(_cut(F.col("text")), lambda raw: _let(sort(_let(_read(raw), _rows)), lambda rs: _let(breaks(raw), lambda n: _lined(rs, n))))
    t = files.select("f", "path", F.explode(rows).alias("x")).select("f", "path", "x.r.*", "x.breaks")

    file = Window.partitionBy("f", "path").orderBy("i", "j")
    upto, above = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    depth = F.sum("turn").over(upto)
    t = t.withColumn("line", (F.sum("breaks").over(upto) + 1).cast("int")).withColumn("level", F.when(F.col("turn") == 1, depth).when(F.col("turn") == -1, depth + 1))
    pair = Window.partitionBy("f", "path", "level").orderBy("i", "j")  # braces of a level open and close in turn
    closes = ((F.col("turn") == -1) & F.coalesce(F.lag("opens").over(pair), F.lit(False))) | F.col("ends")
    t = t.withColumn("closes", closes.cast("int"))
    t = t.withColumn("types", F.sum(F.col("name").isNotNull().cast("int")).over(upto) - F.coalesce(F.sum("closes").over(above), F.lit(0)))
    within = Window.partitionBy("f", "path", "types").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.when(F.col("types") > 0, F.last("name", ignorenulls=True).over(within))
    return t.withColumn("owner", owner).select("path", "f", "i", "j", "line", "name", "declares", "own", "edges", "owner")


def declared_types(sources: DataFrame) -> DataFrame:
    """``path, category, name`` of each declared class, struct and interface; records aren't among them."""
    found = owned_rows(sources).where("name is not null")
    return found.select("path", F.initcap("declares").alias("category"), "name").distinct()


def ordered_edges(sources: DataFrame) -> DataFrame:
    """:func:`csharp_edges` with ``n``, each edge's place in its file.

    Each construct belongs to the innermost type around it, and receivers are taken as
    written, without blanks around their dots; receivers that aren't names are left out.
    """
    t = owned_rows(sources).withColumn("declared", F.col("name").isNotNull())
    made = t.where(F.col("owner").isNotNull() | F.col("declared"))
    made = made.select("path", "f", "i", "j", "line", "declared", F.coalesce("name", "owner").alias("src"), F.explode(F.when(F.col("declared"), F.col("own")).otherwise(F.col("edges"))).alias("e"))
    made = made.where(F.col("declared") | (F.upper("src") != F.upper("e.dst")))
    edges = made.select("path", "f", "i", "j", "e.k", "src", "e.dst", "e.kind", "e.details", F.col("line").alias("line_number"))
    n = F.row_number().over(Window.partitionBy("path").orderBy("f", "i", "j", "k", "dst"))
    return edges.withColumn("n", n.cast("bigint")).select(*[c.split()[0] for c in EDGE.split(", ")], "n")


def csharp_edges(sources: DataFrame) -> DataFrame:
    """Edges of ``(path, text)`` files: creations, calls, singletons, subscriptions, bases and interfaces."""
    return ordered_edges(sources).drop("n")
