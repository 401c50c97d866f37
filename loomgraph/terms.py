"""RDF terms: as Python values, as columns, and the way between them.

A term column is a struct ``<k, v, dt, lang, dir>``; an unbound variable or an error is a NULL struct.  A triple term keeps its
three parts in ``v``, each written ``<k>:<length>:<v>`` and so on, lengths in characters, so that parts of any depth can
be cut out with ``substring`` and equal terms have equal text.

While a query is planned, a variable is not yet a struct but one of the *shapes* below, which say what is known: a node
made of a template and key columns, a literal in a column of its natural Spark type, a triple of shapes, a constant.
Comparisons are done on the natural columns, and the struct is built only where shapes differ or at the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK, IRI, LITERAL, TRIPLE = 1, 2, 3, 4
ANY = frozenset((BLANK, IRI, LITERAL, TRIPLE))
SUBJECTS, PREDICATES = frozenset((BLANK, IRI)), frozenset((IRI,))
TERM = "struct<k:tinyint,v:string,dt:string,lang:string,dir:string>"

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
STRING, BOOLEAN, INTEGER, DECIMAL = XSD + "string", XSD + "boolean", XSD + "integer", XSD + "decimal"
FLOAT, DOUBLE, DATETIME, DATE = XSD + "float", XSD + "double", XSD + "dateTime", XSD + "date"
LANG_STRING, DIR_STRING = RDF + "langString", RDF + "dirLangString"
#: The integer types of XML Schema.
INTEGERS = tuple(
    XSD + n
    for n in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
)
NUMERIC = (*INTEGERS, DECIMAL, FLOAT, DOUBLE)
#: Natural Spark types of literals that a column may hold as they are.
NATURAL = {STRING: "string", BOOLEAN: "boolean", INTEGER: "bigint", DOUBLE: "double", DECIMAL: "decimal(38,18)", DATETIME: "timestamp"}


@dataclass(frozen=True)
class Term:
    k: int
    v: str
    dt: str | None = None
    lang: str | None = None
    dir: str | None = None
    parts: tuple[Term, Term, Term] | None = None

    def __str__(self) -> str:
        if self.k == IRI:
            return f"<{self.v}>"
        if self.k == BLANK:
            return f"_:{self.v}"
        if self.k == TRIPLE:
            return "<<( " + " ".join(map(str, self.parts)) + " )>>"
        text = '"' + self.v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
        if self.lang:
            return f"{text}@{self.lang}" + (f"--{self.dir}" if self.dir else "")
        return text if self.dt == STRING else f"{text}^^<{self.dt}>"


def iri(v: str) -> Term:
    return Term(IRI, v)


def blank(v: str) -> Term:
    return Term(BLANK, v)


def literal(v: str, dt: str = STRING, lang: str | None = None, direction: str | None = None) -> Term:
    if lang:
        return Term(LITERAL, v, DIR_STRING if direction else LANG_STRING, lang.lower(), direction)
    return Term(LITERAL, v, dt)


def triple(s: Term, p: Term, o: Term) -> Term:
    return Term(TRIPLE, "".join(map(encoded, (s, p, o))), parts=(s, p, o))


def encoded(t: Term) -> str:
    """One part of a triple term's text; a missing field is written without a length."""
    return f"{t.k}" + "".join(":" if x is None else f"{len(x)}:{x}" for x in (t.v, t.dt, t.lang, t.dir))


def decoded(text: str) -> Term:
    """The triple term whose text this is."""
    parts, at = [], 0
    for _ in range(3):
        k, fields = int(text[at]), []
        at += 1
        for _ in range(4):
            end = text.index(":", at)
            if end == at:
                fields.append(None)
                at += 1
                continue
            n = int(text[at:end])
            fields.append(text[end + 1 : end + 1 + n])
            at = end + 1 + n
        parts.append(decoded(fields[0]) if k == TRIPLE else Term(k, *fields))
    return triple(*parts)


def from_row(row) -> Term | None:
    """A Python term of a collected struct."""
    if row is None:
        return None
    return decoded(row["v"]) if row["k"] == TRIPLE else Term(row["k"], row["v"], row["dt"], row["lang"], row["dir"])


# --- shapes ------------------------------------------------------------------------------------------------------

Ref = "str | Column"  # a column by name, or an expression not yet stored


def col(ref) -> Column:
    return F.col(f"`{ref}`") if isinstance(ref, str) else ref


@dataclass(frozen=True)
class Const:
    term: Term


@dataclass(frozen=True)
class Key:
    """A column within a template."""

    ref: object
    kind: str  # its Spark type


@dataclass(frozen=True)
class Node:
    """An IRI or blank node: texts and keys by turns."""

    k: int
    parts: tuple[object, ...]


@dataclass(frozen=True)
class Lit:
    """A literal of datatype `dt` (one of NATURAL) in a column of its natural type."""

    ref: object
    dt: str


@dataclass(frozen=True)
class Tri:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Dyn:
    """Any term of the given kinds, as a struct."""

    ref: object
    kinds: frozenset[int] = ANY


def shape_of(term: Term):
    return Tri(*map(shape_of, term.parts)) if term.k == TRIPLE else Const(term)


def kinds(x) -> frozenset[int]:
    if isinstance(x, Const):
        return frozenset((x.term.k,))
    if isinstance(x, Node):
        return frozenset((x.k,))
    return frozenset((LITERAL,)) if isinstance(x, Lit) else frozenset((TRIPLE,)) if isinstance(x, Tri) else x.kinds


def refs(x) -> list:
    """The columns that a shape uses."""
    if isinstance(x, Node):
        return [p.ref for p in x.parts if isinstance(p, Key)]
    if isinstance(x, Tri):
        return refs(x.s) + refs(x.p) + refs(x.o)
    return [x.ref] if isinstance(x, Lit | Dyn) else []


def with_refs(x, change):
    """The same shape over other columns."""
    if isinstance(x, Node):
        return Node(x.k, tuple(Key(change(p.ref), p.kind) if isinstance(p, Key) else p for p in x.parts))
    if isinstance(x, Tri):
        return Tri(*(with_refs(p, change) for p in (x.s, x.p, x.o)))
    if isinstance(x, Lit):
        return Lit(change(x.ref), x.dt)
    return Dyn(change(x.ref), x.kinds) if isinstance(x, Dyn) else x


def form(x):
    """What two shapes must share for their columns to be lined up one by one."""
    if isinstance(x, Node):
        return ("node", x.k, tuple(p.kind if isinstance(p, Key) else f"={p}" for p in x.parts))
    if isinstance(x, Tri):
        return ("triple", form(x.s), form(x.p), form(x.o))
    return ("literal", x.dt) if isinstance(x, Lit) else ("const", x.term) if isinstance(x, Const) else ("any",)


def make_struct(k, v, dt=None, lang=None, direction=None) -> Column:
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    return F.struct((k if isinstance(k, Column) else F.lit(k)).cast("tinyint").alias("k"), text(v).alias("v"), text(dt).alias("dt"), text(lang).alias("lang"), text(direction).alias("dir"))


def lexical_of(value: Column, dt: str) -> Column:
    """Text of a natural value."""
    if dt == DATETIME:
        return F.replace(value.cast("string"), F.lit(" "), F.lit("T"))
    if dt == DECIMAL:
        return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return value.cast("string")


def lexical(x) -> Column:
    """v: NULL where unbound."""
    if isinstance(x, Const):
        return F.lit(x.term.v)
    if isinstance(x, Node):
        return F.concat(*(col(p.ref).cast("string") if isinstance(p, Key) else F.lit(p) for p in x.parts))
    if isinstance(x, Lit):
        return lexical_of(col(x.ref), x.dt)
    return F.concat(*(encoding(p) for p in (x.s, x.p, x.o))) if isinstance(x, Tri) else col(x.ref)["v"]


def _sized(c: Column) -> Column:
    return F.concat(F.length(c).cast("string"), F.lit(":"), c)


def encoding(x) -> Column:
    """One part of a triple term's text (see `encoded`)."""
    if isinstance(x, Const):
        return F.lit(encoded(x.term))
    v = lexical(x)
    if isinstance(x, Dyn):
        rest = [F.coalesce(_sized(col(x.ref)[f]), F.lit(":")) for f in ("dt", "lang", "dir")]
        return F.concat(col(x.ref)["k"].cast("string"), _sized(v), *rest)
    if isinstance(x, Lit):
        return F.concat(F.lit(str(LITERAL)), _sized(v), F.lit(f"{len(x.dt)}:{x.dt}::"))
    return F.concat(F.lit(str(x.k if isinstance(x, Node) else TRIPLE)), _sized(v), F.lit(":::"))


def bound(x) -> Column:
    """True where the term is there."""
    return reduce(Column.__and__, (col(r).isNotNull() for r in refs(x)), F.lit(True))


def struct(x) -> Column:
    if isinstance(x, Dyn):
        return col(x.ref)
    if isinstance(x, Const):
        t = x.term
        return make_struct(t.k, t.v, t.dt, t.lang, t.dir)
    k = x.k if isinstance(x, Node) else LITERAL if isinstance(x, Lit) else TRIPLE
    made = make_struct(k, lexical(x), x.dt if isinstance(x, Lit) else None)
    return F.when(bound(x), made) if refs(x) else made


def part(text: Column, which: int) -> Column:
    """A part (0, 1, 2) of a triple term's text, as a term struct.  A fold reads field after field: the kind, one
    character, then four fields with their lengths; what came before is only carried as a place in the text."""
    names = ("k", "v", "dt", "lang", "dir")

    def step(acc: Column, number: Column) -> Column:
        at, which_field = acc["at"], number % 5
        digits = F.regexp_extract(F.substr(text, at, F.lit(12)), r"^(\d*):", 1)
        size = F.coalesce(digits.try_cast("int"), F.lit(0))
        read = F.when(which_field == 0, F.substr(text, at, F.lit(1))).when(digits != "", F.substr(text, at + F.length(digits) + 1, size))
        after = F.when(which_field == 0, at + 1).otherwise(at + F.length(digits) + 1 + size)
        return F.struct(after.alias("at"), *(F.when(which_field == i, read).otherwise(acc[n]).alias(n) for i, n in enumerate(names)))

    none = F.lit(None).cast("string")
    start = F.struct(F.lit(1).alias("at"), *(none.alias(n) for n in names))
    fields = F.array(*map(F.lit, range(5 * (which + 1))))
    return F.aggregate(fields, start, step, lambda acc: F.when(text.isNotNull(), make_struct(acc["k"].try_cast("tinyint"), acc["v"], acc["dt"], acc["lang"], acc["dir"])))


def piece(x, which: int):
    """SUBJECT, PREDICATE or OBJECT of a shape; None where it can't be a triple term."""
    if isinstance(x, Tri):
        return (x.s, x.p, x.o)[which]
    if isinstance(x, Dyn) and TRIPLE in x.kinds:
        return Dyn(part(F.when(col(x.ref)["k"] == TRIPLE, col(x.ref)["v"]), which), ANY)
    return None


# --- identity ------------------------------------------------------------------------------------------------------


def _pattern(x: Node) -> tuple[re.Pattern, bool]:
    """A pattern for the template's texts; whether keys can be read off without doubt."""
    keys = [p for p in x.parts if isinstance(p, Key)]
    whole = {"bigint", "int", "smallint", "tinyint"}
    sure = len(keys) == 1 or all(p.kind in whole for p in keys) and all(not (isinstance(a, Key) and isinstance(b, Key)) for a, b in zip(x.parts, x.parts[1:]))
    sure = sure and all(not (isinstance(a, Key) and a.kind in whole and isinstance(b, str) and b[:1].isdigit()) for a, b in zip(x.parts, x.parts[1:]))
    return re.compile("".join("(-?[0-9]+)" if isinstance(p, Key) and p.kind in whole else "(.*)" if isinstance(p, Key) else re.escape(p) for p in x.parts), re.DOTALL), sure


def parse_natural(text: str, dt: str):
    """The value whose lexical form `text` is, or None if there is no such value."""
    if dt == STRING:
        return text
    if dt == BOOLEAN:
        return {"true": True, "false": False}.get(text)
    if dt == INTEGER:
        return int(text) if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", text) else None
    return None


def same(a, b):
    """sameTerm of two bound shapes: True or False if that is known now, else a column; NULL where one is unbound."""
    if not kinds(a) & kinds(b):
        return False
    if isinstance(a, Const) and isinstance(b, Const):
        return a.term == b.term
    if isinstance(a, Const) or isinstance(b, Tri) and not isinstance(a, Tri):
        a, b = b, a
    if isinstance(a, Tri):
        found = [same(x, piece(b, i)) for i, x in enumerate((a.s, a.p, a.o))]
        if isinstance(b, Dyn):
            return struct(a) == col(b.ref)
        return all_of(found)
    if isinstance(a, Node) and isinstance(b, Const):
        pattern, sure = _pattern(a)
        m = pattern.fullmatch(b.term.v)
        if not m:
            return False
        if not sure:
            return lexical(a) == b.term.v
        tests = []
        for key, text in zip((p for p in a.parts if isinstance(p, Key)), m.groups(), strict=True):
            if key.kind != "string" and (not re.fullmatch(r"0|-?[1-9][0-9]{0,17}", text) if key.kind in ("bigint", "int", "smallint", "tinyint") else True):
                return lexical(a) == b.term.v if key.kind not in ("bigint", "int", "smallint", "tinyint") else False
            tests.append(col(key.ref) == (text if key.kind == "string" else F.lit(int(text))))
        return all_of(tests)
    if isinstance(a, Node) and isinstance(b, Node):
        if form(a) == form(b) and _pattern(a)[1]:
            return all_of([col(p.ref) == col(q.ref) for p, q in zip(a.parts, b.parts, strict=True) if isinstance(p, Key)])
        x, y = (p.parts[0] if isinstance(p.parts[0], str) else "" for p in (a, b))
        if not (x.startswith(y) or y.startswith(x)):
            return False
        return lexical(a) == lexical(b)
    if isinstance(a, Lit) and isinstance(b, Lit):
        return col(a.ref) == col(b.ref) if a.dt == b.dt else False
    if isinstance(a, Lit) and isinstance(b, Const):
        if b.term.dt != a.dt:
            return False
        value = parse_natural(b.term.v, a.dt)
        return col(a.ref) == F.lit(value) if value is not None else False if a.dt in (BOOLEAN, INTEGER) else lexical(a) == b.term.v
    if isinstance(a, Dyn) and isinstance(b, Const):
        x, t = col(a.ref), b.term
        tests = [x["k"] == t.k, x["v"] == t.v]
        if t.k == LITERAL:
            tests += [x["dt"] == t.dt] + [x[f] == getattr(t, f) if getattr(t, f) else x[f].isNull() for f in ("lang", "dir") if t.dt in (LANG_STRING, DIR_STRING)]
        return all_of(tests)
    return struct(a) == struct(b)


def all_of(tests: list):
    """Conjunction of columns and known truth values."""
    if any(t is False for t in tests):
        return False
    tests = [t for t in tests if t is not True]
    return reduce(Column.__and__, tests) if tests else True


def of_kind(x, wanted: frozenset[int]):
    """Whether the term is of one of the kinds: known, or a column; unbound is neither."""
    if kinds(x) <= wanted:
        return True
    if not kinds(x) & wanted:
        return False
    return col(x.ref)["k"].isin(*sorted(wanted & kinds(x)))
