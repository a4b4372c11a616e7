"""Names, identifiers, type signatures and summaries as expressions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of system primitives, names of types that are never a user's, and keywords that an identifier must escape.
PRIMITIVES = "String Int32 Int64 Single Double Boolean Object Char Byte Void Action Func Task Guid Array Type Decimal IntPtr ValueCollection KeyCollection Enumerator".split()
BLACKLIST = """Void Int32 Int64 Single Double Boolean String Char Object Decimal Byte SByte Int16 UInt16 UInt32 UInt64 IntPtr UIntPtr
    List Dictionary HashSet Action Func Task Type Guid DateTime TimeSpan""".split()
KEYWORDS = "abstract as base bool break byte case catch char class const continue default delegate do double else enum event false float for foreach if in int interface is lock long namespace new null object operator out override params private protected public readonly ref return sealed short static string struct switch this throw true try typeof uint ulong using virtual void while".split()


def unique_id(name: Column) -> Column:
    """A file-safe id of a full type name."""
    x = F.regexp_replace(F.replace(name, F.lit("+"), F.lit(".")), "`[1-5]", "")
    x = F.when(x.startswith("Sandbox"), F.replace(x, F.lit("_"), F.lit("."))).otherwise(x)
    x = F.replace(F.translate(x, '<>,:|*?"/\\`', "__________"), F.lit(" "), F.lit(""))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("void")).otherwise(x)


def short_name(full: Column) -> Column:
    return F.substring_index(F.substring_index(full, ".", -1), "`", 1)


def namespace(full: Column, default: str = "Sandbox") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(full, r"^(.*)\.[^.]*$", 1), F.lit("")), F.lit(default))


def doc_id(kind: str, type_name: Column, name: Column, params: Column | None = None) -> Column:
    head = F.concat(F.lit(f"{kind}:"), type_name, F.lit("."), name)
    if params is None:
        return head
    return F.concat(head, F.lit("("), F.array_join(F.transform(params, lambda p: F.coalesce(p, F.lit("object"))), ","), F.lit(")"))


def clean_summary(preview: Column) -> Column:
    """What follows ``Summary:``, on one line, without dots at its ends; null where there is no description."""
    text = F.when(F.contains(preview, F.lit("Summary:")), F.regexp_replace(preview, r"(?s)^.*?Summary:", ""))
    text = F.btrim(F.regexp_replace(text, r"[ \t\r\n]+", " "), F.lit(". "))
    return F.when((text == "") | text.startswith("No description"), F.lit(None)).otherwise(text)


def table_summary(summary: Column) -> Column:
    text = F.trim(F.replace(F.replace(F.replace(summary, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("&#124;")))
    return F.coalesce(text, F.lit("-"))


def signature_of(preview: Column) -> Column:
    """What the outermost parentheses before ``Summary:`` hold."""
    return F.regexp_extract(F.substring_index(preview, "Summary:", 1), r"(?s)\((.*)\)", 1)


def chunk_text(kind: str, name: Column, summary: Column) -> Column:
    described = F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.lit("No description."))
    return F.concat(F.lit(f"{kind}: "), name, F.lit(". Summary: "), described)


def clean_namespace(ns: Column) -> Column:
    plain = F.translate(ns, "<>", "")
    return F.when(F.coalesce(ns, F.lit("")).isin("", "<global namespace>"), F.lit("global")).otherwise(plain)


def sanitised(name: Column) -> Column:
    x = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    x = F.when(x.rlike("^[0-9]"), F.concat(F.lit("_"), x)).otherwise(x)
    return F.when(x.isin(KEYWORDS), F.concat(F.lit("@"), x)).otherwise(x)


def sanitised_namespace(ns: Column) -> Column:
    """Each part of a namespace sanitised; an empty one stays empty."""
    return F.array_join(F.transform(F.split(F.coalesce(ns, F.lit("")), r"\.", -1), sanitised), ".")


def sanitised_member(name: Column) -> Column:
    """A member's own name, without the interface that it implements explicitly, sanitised."""
    return sanitised(F.substring_index(name, ".", -1))


def is_generic_param(name: Column) -> Column:
    """Whether a name looks like a generic parameter: one capital, or from ``T``, or up to ``Type``; known types are for the caller to leave out."""
    return name.rlike("^[A-Z]$") | name.startswith("T") | name.endswith("Type")


def is_primitive(name: Column) -> Column:
    return F.lower(name).isin([x.lower() for x in PRIMITIVES])


def is_blacklisted(name: Column, ns: Column, is_value: Column, is_engine: Column) -> Column:
    """Whether a type (an array by its element) isn't the user's, by ordered rules: no name, a listed name, a system namespace,
    a value type of the engine's namespaces, a type of the engine's registry."""
    space = F.coalesce(ns, F.lit(""))
    own = ~(space.startswith("Sandbox") | space.startswith("Editor"))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", True).when(F.lower(name).isin([x.lower() for x in BLACKLIST]), True)
        .when(space.startswith("System") | space.startswith("Microsoft"), True).when(is_value, ~own)
        .otherwise(is_engine | space.startswith("Sandbox"))
    )


def type_fqn(full: Column) -> Column:
    """A generic type's namespace and name without the tick and what follows; others as they are."""
    return F.when(F.contains(full, F.lit("`")), F.substring_index(full, "`", 1)).otherwise(full)


def origin_of(assembly: Column, runtime: tuple[str, ...] = ("Sandbox.",)) -> Column:
    """Of an assembly's name, by its beginning; ``runtime`` are the engine's own beginnings."""
    begins = lambda *heads: reduce(lambda a, b: a | b, [assembly.startswith(h) for h in heads])
    return (
        F.when(begins(*runtime), "EngineRuntime").when(begins("Editor."), "EngineEditor")
        .when(begins("System.", "Microsoft.") | (F.lower(assembly) == "mscorlib"), "SystemPrimitive").otherwise("UserProject")
    )


def category_of(is_interface: Column, is_enum: Column, is_value: Column, ancestors: Column) -> Column:
    """Of a type, by its flags and then the names of its ancestors."""
    below = lambda name: F.array_contains(ancestors, name)
    return (
        F.when(is_interface, "Interface").when(is_enum, "Enum").when(is_value, "Struct").when(below("PanelComponent"), "UiPanelComponent")
        .when(below("Component"), "SceneComponent").when(below("Panel"), "UiPanel").when(below("GameResource"), "GameResource").otherwise("Class")
    )


def member_type_is(column: Column, wanted: str) -> Column:
    w = wanted.lower()
    if w in ("class", "type"):
        return F.lower(column).isin("class", "struct", "interface", "enum", "type")
    if w in ("property", "prop"):
        return F.lower(column).isin("property", "prop", "field")
    return F.lit(True) if w == "all" else F.lower(column) == w


def pack_flags(shape: Column, *bits: Column) -> Column:
    """Shape in the low nibble, states in bits 4 to 7."""
    out = shape.bitwiseAND(F.lit(15))
    for i, bit in enumerate(bits):
        out = out.bitwiseOR(F.when(bit, F.lit(1 << (4 + i))).otherwise(F.lit(0)))
    return out


def parse_type(text: str | None) -> list[tuple[int, str, str, bool, bool]]:
    """``(depth, full_name, clean_name, is_byref, is_pointer)`` of a type string and of its generic arguments, depth first."""
    out: list[tuple[int, str, str, bool, bool]] = []

    def visit(x: str, depth: int) -> None:
        x = re.sub(r"`\d+", "", x.strip(), count=1)
        x = re.sub(r"\[[^\]]*\]|\([^)]*\)", "", x).replace("[", "").replace("]", "")
        byref = bool(re.search(r"[@&]|modreq|modopt", x))
        x = re.sub(r"[@&]|modreq|modopt", "", x).strip()
        pointer = x.endswith("*")
        x = x.rstrip("*").strip() or "System.Void"
        head, _, rest = x.partition("<")
        name = re.sub(r"`\d+", "", head.rsplit(".", 1)[-1])
        out.append((depth, head, "void" if head == "System.Void" else name, byref, pointer))
        if rest:
            level, arg = 0, ""
            for ch in rest[: rest.rindex(">")] if ">" in rest else rest:
                level += (ch == "<") - (ch == ">")
                if ch == "," and not level:
                    visit(arg, depth + 1)
                    arg = ""
                else:
                    arg += ch
            if arg.strip():
                visit(arg, depth + 1)

    visit(text or "", 0)
    return out


def preview_namespace(preview: Column) -> Column:
    """What follows ``Namespace:``, up to the first dot."""
    return F.trim(F.regexp_extract(preview, r"Namespace:([^.]*)", 1))


def preview_file(preview: Column) -> Column:
    """What follows ``Source file:``, without the closing dot."""
    return F.regexp_replace(F.trim(F.regexp_extract(preview, r"(?s)Source file:(.*)$", 1)), r"\.$", "")


def score_text(score: Column) -> Column:
    return F.format_string("%.1f%%", score * 100)


def score_colour(score: Column) -> Column:
    return F.when(score > 0.85, "green").otherwise("yellow")


# Names that stand for system types.
ALIASES = {
    "System.Void": "void", "System.Int32": "int", "System.Int64": "long", "System.Single": "float", "System.Double": "double",
    "System.Boolean": "bool", "System.String": "string", "System.Char": "char", "System.Object": "object",
    "System.Byte": "byte", "System.SByte": "sbyte", "System.Int16": "short", "System.UInt16": "ushort", "System.UInt32": "uint",
    "System.UInt64": "ulong", "System.Decimal": "decimal",
}


def _rendered(text: str | None, name_of) -> str:
    """A type string with ``name_of`` each name in it; spans are arrays."""
    rows = parse_type(text)

    def at(i: int) -> tuple[str, int]:
        depth, full = rows[i][:2]
        args, i = [], i + 1
        while i < len(rows) and rows[i][0] > depth:
            arg, i = at(i)
            args.append(arg)
        if full.rsplit(".", 1)[-1] in ("Span", "ReadOnlySpan"):
            return f"{args[0] if args else 'byte'}[]", i
        return name_of(full) + (f"<{', '.join(args)}>" if args else ""), i

    return at(0)[0] + ("[]" if (text or "").rstrip().endswith("[]") else "")


def _by_name(name_of):
    def rendered(types: pd.Series) -> pd.Series:
        return types.map(lambda t: _rendered(t, name_of))

    return F.pandas_udf(rendered, "string")


def display_type(column: Column | str) -> Column:
    """A type string with short names, as it is written in code; the recursion has no expression."""
    short = lambda full: ALIASES.get(full, full.rsplit(".", 1)[-1])
    return _by_name(short)(column)


def type_link(column: Column | str) -> Column:
    """A type string with a wiki link for each name that isn't a system type."""
    link = lambda full: ALIASES.get(full) or (full if full.startswith("System.") else f"[[{full}]]")
    return _by_name(link)(column)


SIGNATURE = "array<struct<depth:int,full_name:string,clean_name:string,is_byref:boolean,is_pointer:boolean>>"


def _signatures(types: pd.Series) -> pd.Series:  # Arrow batches
    fields = ("depth", "full_name", "clean_name", "is_byref", "is_pointer")
    return types.map(lambda t: [dict(zip(fields, x, strict=True)) for x in parse_type(t)])


def type_signature(column: Column | str) -> Column:
    """Flattened signature of a type string; the recursion has no expression."""
    return F.pandas_udf(_signatures, SIGNATURE)(column)


def unwrapped(signature: Column) -> Column:
    """Names a reference leads to: a type itself, of a generic one its innermost arguments without any container."""
    leaves = lambda sig: F.filter(sig, lambda s, i: F.coalesce(F.get(sig, i + 1)["depth"], F.lit(0)) <= s["depth"])
    return F.flatten(F.transform(F.array(signature), lambda sig: F.transform(leaves(sig), lambda s: s["full_name"])))
