"""A syntactic reading of C# source text, and the edges that the reading gives with what is known of types.

There is no compiler to bind names, so a file's own declarations (fields, properties,
parameters, locals) tell what type a name has, and joins with the declared classes
and the API registry tell whose that type is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.runtime import stored

from .model import strict_edges

_BLANKED = re.compile(r'//[^\n]*|/\*.*?\*/|\$?@\$?"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'', re.S)
_DECLARES = re.compile(r"\b(class|struct|interface)\s+([A-Za-z_]\w*)\s*(?:<([^>{(]*)>)?\s*(?::\s*([^{;]*?))?\s*(?:\bwhere\b[^{;]*)?\{")
_NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)\s*([;{])")
_USING = re.compile(r"^\s*using\s+([\w.]+)\s*;", re.M)
_MODIFIERS = re.compile(
    r"^(?:(?:public|private|protected|internal|static|readonly|const|override|virtual|abstract|sealed|async|new|partial|extern|unsafe|volatile|required|event|ref)\b\s*)+"
)
_TYPE = r"[A-Za-z_][\w.]*(?:\s*<[\w.,<>\[\]?\s]*>)?(?:\s*\[[\s,]*\])*\??"
_METHOD = re.compile(rf"^(?:({_TYPE})\s+)?([A-Za-z_]\w*)\s*(?:<([^()]*)>)?\s*\((.*)\)", re.S)
_PROPERTY = re.compile(rf"^({_TYPE})\s+([\w.]+)$")
_FIELD = re.compile(rf"^({_TYPE})\s+([A-Za-z_]\w*(?:\s*=.*)?(?:\s*,\s*[A-Za-z_]\w*(?:\s*=.*)?)*)$", re.S)
_LOCAL = re.compile(rf"\b({_TYPE})\s+([A-Za-z_]\w*)\s*(?==[^=>]|;|\bin\b)")
_VAR = re.compile(rf"\bvar\s+([A-Za-z_]\w*)\s*=\s*new\s+({_TYPE})\s*[({{\[]")
_NEW = re.compile(r"\bnew\s+([A-Za-z_][\w.]*)\s*(<[\w.,<>\[\]?\s]*>)?\s*[({\[]")
_IMPLICIT = re.compile(rf"({_TYPE})\s+[A-Za-z_]\w*\s*=\s*new\s*\(")
#: What may hold a match of :data:`_IMPLICIT`: letters that a type can have up to its end; matches begin nowhere else.
_IMPLICIT_END = re.compile(r"(?<![\w.,<>\[\]?\s])[\w.,<>\[\]?\s]++=\s*new\s*\(")
_CALL = re.compile(r"(?<=[\w)>\]\s])\.\s*([A-Za-z_]\w*)\s*(?:<[^>;(){}]*>)?\s*\(")
_ACCESS = re.compile(r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\b(?!\s*[(.<\w])")
_SINGLE = re.compile(r"([A-Za-z_][\w.]*)\s*\.\s*(Instance|Current)\b")
_EVENT = re.compile(r"([A-Za-z_][\w.]*)\s*\.\s*([A-Za-z_]\w*)\s*([+-]=)")
_NEWLINES, _CURLY, _ROUND, _MEMBER_END = re.compile("\n"), re.compile("[{}]"), re.compile("[()]"), re.compile(r"[;{}]|=>")
_ATTRIBUTE, _ASSIGNED, _NESTED = re.compile(r"\s*\[[^\]]*\]"), re.compile(r"\s*=[^;]*;"), re.compile(r"(?:\w+\s+)*(?:class|struct|interface|enum|delegate|record)\b")
_MARKS, _PARAMETER = re.compile(r"^(?:\[[^\]]*\]\s*|(?:this|params|ref|out|in)\s+)*"), re.compile(rf"^({_TYPE})\s+([A-Za-z_]\w*)$")
_LETTER, _AFTER_DOT, _ROOT, _BEFORE_PAREN, _BEFORE_DOT = re.compile("[A-Za-z_]"), re.compile(r"\.\s*(\w+)"), re.compile(r"\s*([A-Za-z_]\w*)"), re.compile(r"[\w.]*\s*$"), re.compile(r"[A-Za-z_][\w.]*$")
_BLANKS, _UPTO_TYPE, _IN_USING = re.compile(r"\s+"), re.compile(r"[<\[?].*"), re.compile(r"\b(?:using|namespace)\s+[\w.]*$")
_WORDS = "return throw new await else in is as case yield using namespace typeof nameof var out ref goto".split()


def _split(text: str) -> list[str]:
    """Parts between commas that no bracket encloses."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "<([{") - (ch in ">)]}")
        if ch == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


class Source:
    """One file: its types with where they begin and end, and the innermost type at each place; read in one pass each."""

    def __init__(self, text: str):
        self.code = code = _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if "\n" in m[0] else " " * len(m[0]), text)
        self._lines = [m.start() for m in _NEWLINES.finditer(code)]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in _CURLY.finditer(code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
        for at in stack:
            self.close[at] = len(code)
        self.usings = _USING.findall(code)
        self.spaces = [(m.start(), self.close.get(m.end() - 1, len(code)) if m[2] == "{" else len(code), m[1]) for m in _NAMESPACE.finditer(code)]
        #: (declaration, body begin, body end, kind, name, generic parameters, bases)
        self.types = [
            (m.start(), m.end(), self.close[m.end() - 1], m[1], m[2], _split(m[3] or ""), [re.sub(r"\s+", "", b) for b in _split(m[4] or "")])
            for m in _DECLARES.finditer(code)
        ]
        edges = sorted([(t[1], 1, k) for k, t in enumerate(self.types)] + [(t[2], 0, k) for k, t in enumerate(self.types)])
        self._at, self._owner, open_ = [0], [-1], []
        for at, begins, k in edges:
            if begins:
                open_.append(k)
            elif open_:
                open_.pop()
            self._at.append(at)
            self._owner.append(open_[-1] if open_ else -1)

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at - 1) + 1 if at else 1

    def owner(self, at: int) -> int:
        """The number of the innermost type around a place, -1 for none."""
        return self._owner[bisect_right(self._at, at) - 1]

    def calls(self) -> Iterator[tuple[int, str, str]]:
        """``(place, receiver, method)`` of each call of something's method; a receiver may be a chain of calls."""
        begins: dict[int, int] = {}  # where the chain begins that a call's dot continues
        opens: dict[int, int] = {}
        stack: list[int] = []
        for m in _ROUND.finditer(self.code):
            if m[0] == "(":
                stack.append(m.start())
            elif stack:
                opens[m.start()] = stack.pop()
        dot_of = {m.end() - 1: m.start() for m in _CALL.finditer(self.code)}
        for paren, dot in dot_of.items():
            at = dot
            while at > 0 and self.code[at - 1].isspace():
                at -= 1
            if at and self.code[at - 1] == ")" and at - 1 in opens:
                inner = opens[at - 1]
                if inner in dot_of:
                    begin = begins.get(dot_of[inner], dot_of[inner])
                else:
                    head = _BEFORE_PAREN.search(self.code[max(0, inner - 200) : inner])
                    begin = inner - len(head[0])
            else:
                head = _BEFORE_DOT.search(self.code[max(0, at - 200) : at])
                begin = at - len(head[0]) if head else at
            begins[dot] = begin
            if _LETTER.match(self.code[begin : begin + 1]):
                yield begin, self.code[begin:at], _AFTER_DOT.match(self.code[dot:paren])[1]

    def space(self, at: int) -> str:
        return next((name for lo, hi, name in reversed(self.spaces) if lo <= at < hi), "")

    def members(self, k: int) -> Iterator[tuple[int, str, str]]:
        """``(place, header, how it ends)`` of each member of a type, without what its braces hold."""
        begin, end = self.types[k][1:3]
        at, code, start = begin, self.code, begin
        for m in _MEMBER_END.finditer(code[begin:end]):
            here = begin + m.start()
            if here < at:
                continue  # inside braces, or a member's body
            head = code[start:here]
            while (a := _ATTRIBUTE.match(head)) is not None:
                start, head = start + a.end(), head[a.end() :]
            first = start + len(head) - len(head.lstrip())
            if m[0] == "=>":
                yield first, head.strip(), "=>"
                stop = code.find(";", here)
                at = start = stop + 1 if stop >= 0 else end
            elif m[0] == "{":
                if "=" in head and "(" not in head.split("=")[0]:  # an initialiser: the member goes on
                    at = self.close[here] + 1
                    continue
                yield first, head.strip(), "{"
                at = start = self.close[here] + 1
                more = _ASSIGNED.match(code, at, end)
                at = start = more.end() if more else at
            elif m[0] == ";":
                yield first, head.strip(), ";"
                at = start = here + 1


def _declared(src: Source, k: int) -> Iterator[tuple[int, str, str, str, list[str]]]:
    """``(place, what, type, name, generics)`` of a type's fields, properties and parameters."""
    for at, head, ends in src.members(k):
        if _NESTED.match(head):
            continue
        bare = _MODIFIERS.sub("", head)
        plain = bare.split("=")[0]
        if "(" in plain:
            m = _METHOD.match(bare)
            if m:
                for p in _split(m[4]):
                    p = _MARKS.sub("", p.split("=")[0].strip())
                    q = _PARAMETER.match(p)
                    if q:
                        yield at, "parameter", q[1], q[2], _split(m[3] or "")
        elif ends in ("{", "=>"):
            m = _PROPERTY.match(bare)
            if m:
                yield at, "property", m[1], m[2].rsplit(".", 1)[-1], []
        else:
            m = _FIELD.match(bare)
            if m and m[1] not in _WORDS:
                for name in _split(m[2]):
                    yield at, "field", m[1], name.split("=")[0].strip(), []


@lru_cache(4096)
def display(text: str) -> str:
    """A type as an edge's details show it: short names, arguments after a comma and a blank."""
    text = _BLANKS.sub("", text).rstrip("?")
    if text.endswith("]"):
        return display(text[: text.rindex("[")]) + "[]"
    head, _, rest = text.partition("<")
    head = head.rsplit(".", 1)[-1]
    return f"{head}<{', '.join(map(display, _split(rest[: rest.rindex('>')])))}>" if ">" in rest else head


@lru_cache(4096)
def leaves(text: str) -> tuple[str, ...]:
    """Names a dependency on a type leads to: arrays to their element, generic types to their arguments only."""
    text = _BLANKS.sub("", text).rstrip("?")
    if text.endswith("]"):
        return leaves(text[: text.rindex("[")])
    head, _, rest = text.partition("<")
    return tuple(x for a in _split(rest[: rest.rindex(">")]) for x in leaves(a)) if ">" in rest else (head,) if head else ()


def _root(chain: str) -> str:
    """The receiver at the far left of a chain of calls."""
    return _ROOT.match(chain)[1]


USES = "path string, stem string, src string, ns string, usings array<string>, generics array<string>, kind string, details string, form string, target string, line_number int, n int"


def _uses(path: str, text: str) -> Iterator[tuple]:
    """What each type of a file refers to, as :data:`USES`; ``form``: type (bound by a declaration), receiver or member."""
    src = Source(text)
    stem = re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", path)[-1])
    declared = [list(_declared(src, k)) for k in range(len(src.types))]
    scopes: list[dict[str, str]] = [{name: t for _, _, t, name, _ in d} for d in declared]
    fields: list[dict[str, str]] = [{name: what for _, what, _, name, _ in d if what != "parameter"} for d in declared]
    generics = [sorted({*t[5], *(g for *_, gs in d for g in gs)}) for t, d in zip(src.types, declared, strict=True)]
    code, spaces = src.code, [src.space(t[0]) for t in src.types]
    for pattern, flip in ((_LOCAL, False), (_VAR, True)):
        for m in pattern.finditer(code):
            k = src.owner(m.start())
            t, name = (m[2], m[1]) if flip else (m[1], m[2])
            if k >= 0 and t not in _WORDS and (flip or t != "var"):
                scopes[k].setdefault(name, t)
    out: list[tuple] = []

    def put(at: int, k: int, kind: str, details: str, form: str, target: str) -> None:
        out.append((path, stem, src.types[k][4], spaces[k], src.usings, generics[k], kind, details, form, target, src.line(at), len(out)))

    for k, t in enumerate(src.types):
        if t[3] == "interface":
            continue
        if t[3] == "class" and t[6] and not re.match(r"I[A-Z]", t[6][0].rsplit(".", 1)[-1]):
            put(t[0], k, "Inherits", "Base Class", "base", re.sub("<.*", "", t[6][0]))
        for at, what, type_, name, _ in declared[k]:
            shown = {"field": f"Field '{name}' (holds '{display(type_)}')", "property": f"Has property '{name}' (type: {display(type_)})", "parameter": f"Parameter '{name}'"}
            for leaf in leaves(type_):
                put(at, k, "References", shown[what], "type", leaf)
    outer = lambda at: k if (k := src.owner(at)) >= 0 and src.types[k][3] != "interface" else None
    for m in _NEW.finditer(code):
        if (k := outer(m.start())) is not None:
            for leaf in leaves(m[1] + (m[2] or "")):
                put(m.start(), k, "Instantiates", f"new {m[1].rsplit('.', 1)[-1]}()", "type", leaf)
    for end in _IMPLICIT_END.finditer(code):
        m = _IMPLICIT.search(code, end.start(), end.end())
        if m and (k := outer(m.start())) is not None and m[1] not in _WORDS:
            for leaf in leaves(m[1]):
                put(m.start(), k, "Instantiates", f"new {display(m[1]).split('<')[0]}()", "type", leaf)
    for at, receiver, method in src.calls():
        root = _root(receiver)
        if (k := outer(at)) is None or root in (*_WORDS, "this", "base"):
            continue
        typed = scopes[k].get(root)
        form = "type" if typed and receiver == root else "receiver"
        put(at, k, "Calls", f"Method '{method}()'", form, _UPTO_TYPE.sub("", typed) if typed else root)
    for m in _ACCESS.finditer(code):
        if (k := outer(m.start())) is None or m[1] in (*_WORDS, "this", "base") or _IN_USING.search(code[max(0, m.start() - 60) : m.start()]):
            continue
        typed = scopes[k].get(m[1])
        put(m.start(), k, "References", m[2], "member", _UPTO_TYPE.sub("", typed) if typed else m[1])
    for t, d, space in zip(src.types, fields, spaces, strict=True):
        for name, what in d.items():
            out.append((path, stem, t[4], space, [], [], what, name, "declares", t[3], src.line(t[0]), len(out)))
        out.append((path, stem, t[4], space, [], [], t[3], "", "declares", t[3], src.line(t[0]), len(out)))
    yield from out


def source_uses(sources: DataFrame) -> DataFrame:
    """The uses and declarations of ``(path, text)`` files; each file is read by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in USES.split(", "))])
        for batch in batches:
            rows: list[tuple] = []
            for p, t in zip(batch["path"].to_pylist(), batch["text"].to_pylist(), strict=True):
                rows.extend(_uses(p or "", t or ""))
                if len(rows) >= 20_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return sources.select("path", "text").mapInArrow(run, USES)


def declared_classes(uses: DataFrame) -> DataFrame:
    """``name, ns, path, category`` of each declared class and struct, the first of a name, with ``has_instance``."""
    own = uses.where("form = 'declares' and target in ('class', 'struct')")
    key = F.upper("src").alias("_k")
    first = F.min_by(F.struct(F.col("src").alias("name"), "ns", "path", F.initcap("target").alias("category")), F.struct("path", "n")).alias("t")
    return own.groupBy(key).agg(first, F.max(F.col("details") == "Instance").alias("has_instance")).select("t.*", "has_instance")


def engine_types(types: DataFrame, aliases: DataFrame) -> DataFrame:
    """``key, engine_name``: names and full names of API types, and global aliases with the type they stand for; the first stays."""
    rows = types.select(F.upper("name").alias("key"), F.col("full_name").alias("engine_name"), F.lit(0).alias("o"), "seq")
    rows = rows.unionByName(types.select(F.upper("full_name").alias("key"), F.col("full_name").alias("engine_name"), F.lit(0).alias("o"), "seq"))
    rows = rows.unionByName(aliases.select(F.upper("alias").alias("key"), F.col("target").alias("engine_name"), F.lit(1).alias("o"), F.lit(0).cast("bigint").alias("seq")))
    return rows.groupBy("key").agg(F.min_by("engine_name", F.struct("o", "seq")).alias("engine_name"))


def dependency_edges(uses: DataFrame, engine: DataFrame, include_engine_links: bool = True) -> DataFrame:
    """Edges between declared classes, and from them to engine types, of what :func:`source_uses` reads.

    Type parameters and primitives go.  A use of a declared class is an edge to it,
    marked ``(Fuzzy)`` where the class's namespace isn't visible in the file; a call
    of a class with a static ``Instance`` is one of a singleton.  Any other type that
    the API registry (``key, engine_name``) knows is an ``Engine_`` edge, unless those
    are left out; calls and members of receivers without a declared type keep theirs
    even then, and go out from the file's main class too.  Others are dropped.
    """
    short = F.substring_index("target", ".", -1)
    rows = uses.where("form <> 'declares'").withColumn("_t", short)
    generic = F.array_contains("generics", F.col("_t")) | (F.col("_t") == "T") | F.col("_t").startswith("GP_") | (F.col("_t") == "var")
    rows = rows.where(~generic & ~names.is_primitive(F.col("_t")) & ~names.is_primitive(_system_name(F.col("_t")))).withColumn("_k", F.upper("_t"))
    # What is looked up is stored, without what no row asks for: few types that all files use are joined by a broadcast, whose rows aren't dealt by type.
    all_classes = stored(declared_classes(uses).select(F.upper("name").alias("_c"), F.col("name").alias("known"), F.col("ns").alias("known_ns"), "has_instance"))
    classes = stored(all_classes.join(rows.select(F.col("_k").alias("_c")).distinct(), "_c", "left_semi"))
    asked = stored(rows.where("form = 'member'").select(F.col("_k").alias("_m"), F.col("details").alias("_member")).distinct())
    members = uses.where("form = 'declares' and details <> ''").select(F.upper("src").alias("_m"), F.col("details").alias("_member"), "kind").join(asked, ["_m", "_member"], "left_semi")
    members = stored(members.groupBy("_m", "_member").agg(F.min("kind").alias("member_kind")))
    rows = rows.join(classes, F.col("_k") == F.col("_c"), "left").join(engine, F.upper("target") == F.col("key"), "left")
    rows = rows.join(members, (F.col("_c") == F.col("_m")) & (F.col("details") == F.col("_member")) & (F.col("form") == "member"), "left")
    stems = all_classes.select(F.col("_c").alias("_stem"), F.col("known").alias("main"))

    is_member = F.col("form") == "member"
    what = F.when(F.col("member_kind") == "field", "Field").otherwise("Property")
    details = F.when(is_member, F.concat(what, F.lit(" '"), "details", F.lit("'"))).otherwise(F.col("details"))
    seen = (F.col("known_ns") == "") | (F.col("known_ns") == F.col("ns")) | F.col("ns").startswith(F.concat("known_ns", F.lit("."))) | F.array_contains("usings", F.col("known_ns"))
    fuzzy = F.when(seen | (F.col("form") == "base"), "").otherwise(" (Fuzzy)")
    kind = F.when((F.col("kind") == "Calls") & F.col("has_instance"), "CallsSingleton").otherwise(F.col("kind"))
    user = rows.where(F.col("known").isNotNull() & (~is_member | ((F.col("details") != "Instance") & F.col("member_kind").isNotNull())))
    user = user.select("path", "n", "src", F.col("known").alias("dst"), kind.alias("kind"), F.concat(details, fuzzy).alias("details"), "line_number")

    full = F.when(F.col("engine_name").startswith("Sandbox"), F.col("engine_name")).otherwise(F.concat(F.lit("Sandbox."), "engine_name"))
    target = names.unique_id(F.when(F.contains("engine_name", F.lit(".")), F.col("engine_name")).otherwise(full))
    loose = F.col("form").isin("receiver", "member")
    others = rows.where(F.col("known").isNull() & F.col("engine_name").isNotNull() & (F.col("form") != "base") & (loose | F.lit(include_engine_links)))
    others = others.select("path", "n", "src", "stem", loose.alias("loose"), target.alias("dst"), F.concat(F.lit("Engine_"), "kind").alias("kind"), details.alias("details"), "line_number")
    own = others.select("path", "n", "src", "dst", "kind", "details", "line_number")
    of_file = others.where("loose").join(stems, F.upper("stem") == F.col("_stem")).where(F.upper("main") != F.upper("src"))
    of_file = of_file.select("path", "n", F.col("main").alias("src"), "dst", "kind", "details", "line_number")
    bases = rows.where((F.col("form") == "base") & F.col("known").isNull()).select("path", "n", "src", F.col("_t").alias("dst"), "kind", "details", "line_number")
    edges = user.unionByName(own).unionByName(of_file).unionByName(bases)
    order = F.xxhash64("path").bitwiseAND(F.lit((1 << 42) - 1)) * F.lit(1 << 20) + F.col("n")
    return strict_edges(edges.withColumn("seq", order).drop("path", "n"))


def _system_name(column):
    """The system name that a keyword of the language stands for."""
    pairs = {v: k.rsplit(".", 1)[-1] for k, v in names.ALIASES.items()}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[column], column)
