"""SPARQL's operators and functions over term shapes.

`value` gives the shape of an expression's result over columns (None: always an error), `condition` its effective boolean
value as a column or a known truth value.  An error is NULL throughout, so SQL's three-valued logic is SPARQL's.  Nothing
here is a Python UDF, and nothing raises at run time: casts and arithmetic are the `try_` forms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.plans import algebra as A
from loomgraph.terms import BOOLEAN, DATETIME, DECIMAL, DOUBLE, FLOAT, INTEGER, LITERAL, STRING, Const, Dyn, Lit, Node, Term, Tri, bound, col, kinds, lexical, make_struct, struct

MINT = "internal://blank"
#: What expressions may not be moved or repeated, and so may not be in views.
UNSTABLE = frozenset(("BNODE", "RAND", "UUID", "STRUUID"))


@dataclass
class Context:
    """What expressions are evaluated in."""

    vars: dict[str, object] = field(default_factory=dict)
    mint: str | None = None  # "literal" or "iri"
    mint_name: str = "urn:loomgraph:node"  # the datatype, or the prefix of the IRIs
    generalized: bool = False
    base: str = ""
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)  # IRI -> over term structs
    argument_depth: int | None = None
    ranges: dict[str, frozenset[int]] = field(default_factory=dict)  # IRI -> kinds that the function may give


#: The variable that tells solutions apart, for BNODE with an argument.
SOLUTION = ".solution"


def truth(c) -> Lit | Const:
    return Lit(c, BOOLEAN) if isinstance(c, Column) else Const(T.literal("true" if c else "false", BOOLEAN))


def text(c: Column) -> Lit:
    return Lit(c, STRING)


def natural(x):
    """A constant literal as a column of its natural type where it has one; other shapes as they are."""
    if isinstance(x, Const) and x.term.k == LITERAL:
        v, dt = x.term.v, x.term.dt
        found = T.parse_natural(v, dt)
        if found is not None:
            return Lit(F.lit(found), dt)
        try:
            if dt in (DOUBLE, FLOAT):
                return Lit(F.lit(float(v)), DOUBLE)
            if dt == DECIMAL:
                return Lit(F.lit(v).cast("decimal(38,18)"), DECIMAL)
            if dt in T.INTEGERS:
                return Lit(F.lit(int(v)).cast("bigint"), INTEGER)
        except ValueError:
            return x
        if dt == DATETIME:
            return Lit(F.lit(v.removesuffix("Z")).cast("timestamp_ntz"), DATETIME)
    return x


def may_be_literal(x) -> bool:
    return LITERAL in kinds(x)


# --- numbers -----------------------------------------------------------------------------------------------------

RANKS = {INTEGER: 1, DECIMAL: 2, FLOAT: 3, DOUBLE: 4}


@dataclass(frozen=True)
class Number:
    value: Column
    dt: str | None  # None: known only at run time, then `value` is a double and `rank` its type's rank
    rank: Column | None = None


def number(x) -> Number | None:
    x = natural(x)
    if isinstance(x, Lit):
        return Number(col(x.ref), x.dt) if x.dt in RANKS else None
    if isinstance(x, Dyn) and may_be_literal(x):
        s = col(x.ref)
        rank = F.when(s["dt"].isin(*T.INTEGERS), 1).when(s["dt"] == DECIMAL, 2).when(s["dt"] == FLOAT, 3).when(s["dt"] == DOUBLE, 4)
        spelled = F.when(s["v"] == "INF", "Infinity").when(s["v"] == "-INF", "-Infinity").otherwise(s["v"])
        return Number(F.when(rank.isNotNull(), spelled.try_cast("double")), None, rank)
    return None


def as_double(n: Number) -> Column:
    return n.value.cast("double")


def ranked(n: Number) -> Column:
    return n.rank if n.dt is None else F.lit(RANKS[n.dt])


def of_rank(value: Column, rank: Column) -> Dyn:
    """A number whose type follows from a rank at run time."""
    exact = value.try_cast("decimal(38,18)")
    v = F.when(rank == 1, value.try_cast("bigint").cast("string")).when(rank == 2, T.lexical_of(exact, DECIMAL)).otherwise(value.cast("string"))
    dt = F.element_at(F.array(*map(F.lit, (INTEGER, DECIMAL, FLOAT, DOUBLE))), rank)
    return Dyn(F.when(value.isNotNull() & rank.isNotNull() & v.isNotNull(), make_struct(LITERAL, v, dt)), frozenset((LITERAL,)))


def arithmetic(sign: str, a, b):
    x, y = number(a), number(b)
    if x is None or y is None:
        return None
    op = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[sign]
    if x.dt and y.dt:
        dt = max(x.dt, y.dt, key=RANKS.get)
        if sign == "/" and dt == INTEGER:
            dt = DECIMAL
        if dt == DECIMAL:
            small = "decimal(38,18)" if sign in "+-" else "decimal(28,9)"
            return Lit(op(x.value.cast(small), y.value.cast(small)).try_cast("decimal(38,18)"), DECIMAL)
        if dt == INTEGER:
            return Lit(op(x.value, y.value), INTEGER)
        found = as_double(x) / F.when(as_double(y) != 0, as_double(y)) if sign == "/" else op(as_double(x), as_double(y))
        return Lit(F.when(as_double(y) != 0, found).otherwise(as_double(x) * float("inf")) if sign == "/" else found, DOUBLE)
    rank = F.greatest(ranked(x), ranked(y), F.lit(2 if sign == "/" else 1))
    rank = F.when(ranked(x).isNotNull() & ranked(y).isNotNull(), rank)
    return of_rank(op(as_double(x), as_double(y)), rank)


def rounded(name: str, x):
    n = number(x)
    if n is None:
        return None
    if name == "u+":
        return Lit(n.value, n.dt) if n.dt else of_rank(n.value, n.rank)
    do = {
        "ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + F.lit(0.5)), "u-": lambda c: -c,
    }[name]
    if n.dt is None:
        return of_rank(do(n.value).cast("double"), n.rank)
    if n.dt == INTEGER:
        return Lit(do(n.value).cast("bigint") if name in ("ABS", "u-") else n.value, INTEGER)
    if n.dt == DECIMAL and name == "ROUND":
        return Lit(F.floor(n.value + F.lit(0.5).cast("decimal(2,1)")).cast("decimal(38,18)"), DECIMAL)
    return Lit(do(n.value).cast(T.NATURAL[n.dt]), n.dt)


# --- comparison --------------------------------------------------------------------------------------------------


def _typed(x) -> list[tuple[str, Column, Column | None]]:
    """(class, value, test that the term is of that class or None if it is) for the comparable classes of literals."""
    x = natural(x)
    if isinstance(x, Lit):
        if x.dt in RANKS:
            return [("number", col(x.ref), None)]
        return [({STRING: "string", BOOLEAN: "boolean", DATETIME: "time"}[x.dt], col(x.ref), None)]
    if isinstance(x, Dyn) and may_be_literal(x):
        s = col(x.ref)
        dt = s["dt"]
        n = number(x)
        return [
            ("number", n.value, n.rank.isNotNull()), ("string", s["v"], dt == STRING), ("boolean", s["v"].try_cast("boolean"), dt == BOOLEAN),
            ("time", F.regexp_replace(s["v"], "Z$", "").try_cast("timestamp_ntz"), dt.isin(DATETIME, T.DATE)),
        ]
    return []


def _comparable(a: Column, b: Column, what: str) -> tuple[Column, Column]:
    return (a.cast("timestamp_ntz"), b.cast("timestamp_ntz")) if what == "time" else (a, b)


def compare(sign: str, a, b) -> Column | None:
    do = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "=": Column.__eq__}[sign]
    out: Column | None = None
    for what, x, is_x in _typed(a):
        for other, y, is_y in _typed(b):
            if what == other:
                tests = [t for t in (is_x, is_y) if t is not None]
                found = do(*_comparable(x, y, what))
                if not tests:
                    return found
                both = reduce(Column.__and__, tests)
                out = F.when(both, found) if out is None else out.when(both, found)
    return out


def equal(a, b):
    """`=`: a truth value, a column, or None for an error."""
    if not may_be_literal(a) or not may_be_literal(b):
        return _kept_error(T.same(a, b), a, b)
    x, y = natural(a), natural(b)
    if isinstance(x, Lit) and isinstance(y, Lit):
        return compare("=", x, y)
    by_value = compare("=", a, b)
    if isinstance(a, Const) and isinstance(b, Const):
        return True if a.term == b.term else by_value
    s, t = struct(a), struct(b)
    out = F.when((s["k"] != LITERAL) | (t["k"] != LITERAL), s == t)
    if by_value is not None:
        out = out.when(by_value.isNotNull(), by_value)
    # literals that are one term are equal; others of types without values here can't be told apart
    language = F.coalesce(s["lang"], F.lit("")) != ""
    return out.when(s == t, True).when(language & (F.coalesce(t["lang"], F.lit("")) != ""), False)


def _kept_error(found, *xs):
    """A truth value known by kinds still needs its operands to be bound."""
    if isinstance(found, Column):
        return found
    tests = [bound(x) for x in xs if T.refs(x)]
    return F.when(reduce(Column.__and__, tests), F.lit(found)) if tests else found


def boolean(x):
    """Effective boolean value: a truth value, a column, or None for an error."""
    x = natural(x)
    if isinstance(x, Lit):
        c = col(x.ref)
        if x.dt == BOOLEAN:
            return c
        if x.dt == STRING:
            return F.length(c) > 0
        return (c != 0) & ~F.isnan(c.cast("double")) if x.dt in RANKS else None
    if isinstance(x, Dyn) and may_be_literal(x):
        s, n = col(x.ref), number(x)
        return F.when(s["dt"] == BOOLEAN, F.coalesce(s["v"].try_cast("boolean"), F.lit(False))).when(n.rank.isNotNull(), F.coalesce((n.value != 0) & ~F.isnan(n.value), F.lit(False))).when(s["dt"] == STRING, F.length(s["v"]) > 0)
    return None


# --- strings -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Text:
    v: Column
    lang: Column | None = None
    dir: Column | None = None

    def like(self, v: Column):
        """A literal with other text and the same tags."""
        if self.lang is None:
            return text(v)
        dt = F.when(self.dir.isNotNull(), T.DIR_STRING).when(self.lang.isNotNull(), T.LANG_STRING).otherwise(STRING)
        return Dyn(F.when(v.isNotNull(), make_struct(LITERAL, v, dt, self.lang, self.dir)), frozenset((LITERAL,)))


def string(x) -> Text | None:
    """A string literal, with or without language."""
    x = natural(x)
    if isinstance(x, Lit):
        return Text(col(x.ref)) if x.dt == STRING else None
    if may_be_literal(x):
        s = struct(x)
        fits = s["dt"].isin(STRING, T.LANG_STRING, T.DIR_STRING)
        return Text(F.when(fits, s["v"]), s["lang"], s["dir"])
    return None


def agreeing(a: Text, b: Text) -> Column:
    """The second argument has no language or the first one's."""
    if b.lang is None:
        return F.lit(True)
    return b.lang.isNull() | (b.lang == (a.lang if a.lang is not None else F.lit(None).cast("string")))


def pattern_of(pattern: Text, flags) -> Column:
    if flags is None:
        return pattern.v
    f = string(flags).v
    kept = F.regexp_replace(f, "[^ismx]", "")
    quoted = F.when(F.contains(f, F.lit("q")), F.concat(F.lit("\\Q"), pattern.v, F.lit("\\E"))).otherwise(pattern.v)
    return F.when(kept == "", quoted).otherwise(F.concat(F.lit("(?"), kept, F.lit(")"), quoted))


def _time_part(name: str, x):
    v = lexical(x)
    field_of = {"YEAR": r"^(-?\d{4,})-", "MONTH": r"^-?\d{4,}-(\d\d)", "DAY": r"^-?\d{4,}-\d\d-(\d\d)", "HOURS": r"T(\d\d):", "MINUTES": r"T\d\d:(\d\d)", "SECONDS": r"T\d\d:\d\d:(\d\d(?:\.\d+)?)"}
    is_time = F.when(_has_type(x, DATETIME, T.DATE), v)
    found = F.regexp_extract(is_time, field_of[name], 1)
    if name == "SECONDS":
        return Lit(F.when(found != "", found).try_cast("decimal(38,18)"), DECIMAL)
    return Lit(F.when(found != "", found).try_cast("bigint"), INTEGER)


def _has_type(x, *dts: str) -> Column:
    if isinstance(x, Lit):
        return F.lit(x.dt in dts)
    return struct(x)["dt"].isin(*dts)


# --- node construction -------------------------------------------------------------------------------------------


def mint_encoding(x, depth: int | None = None) -> Column:
    """The text that an argument contributes to a constructed node's identity."""
    unbound = F.lit(",unbound")
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    if x is None:
        return unbound
    if isinstance(x, Tri):
        inner = [mint_encoding(p, None if depth is None else depth - 1) for p in (x.s, x.p, x.o)]
        made = F.concat(F.lit(",triple"), *inner) if depth is None or depth > 0 else F.lit(None).cast("string")
        return F.when(bound(x), made).otherwise(unbound) if T.refs(x) else made
    if isinstance(x, Const | Node | Lit) and T.LITERAL not in kinds(x):
        tag = ",iri," if kinds(x) == {T.IRI} else ",bnode,"
        return F.coalesce(F.concat(F.lit(tag), sized(lexical(x))), unbound)
    s = struct(x)
    none = F.lit("")
    lit = F.concat(F.lit(",literal,"), *(F.concat(sized(F.coalesce(s[f], none)), F.lit("" if f == "dir" else ",")) for f in ("v", "dt", "lang", "dir")))
    out = F.when(s["k"] == T.IRI, F.concat(F.lit(",iri,"), sized(s["v"]))).when(s["k"] == LITERAL, lit).when(s["k"] == T.BLANK, F.concat(F.lit(",bnode,"), sized(s["v"])))
    if T.TRIPLE in kinds(x):
        out = out.when(s["k"] == T.TRIPLE, F.concat(F.lit(",triple"), _inner_encoding(s["v"], depth)))
    return F.when(s.isNull(), unbound).otherwise(out)


def _inner_encoding(text: Column, depth: int | None) -> Column:
    """Of a stored triple term's text: what its three parts contribute, however deep they nest; NULL beyond `depth`.

    One walk over the text, a field at a step.  A part is its kind and four fields with their lengths; the first field of
    a triple term is the text of its parts, so the walk just goes on within it, and the three empty fields after it are
    met where a kind should stand."""
    if depth == 0:
        return F.lit(None).cast("string")
    tags = F.create_map(*(F.lit(x) for k, tag in ((T.IRI, ",iri"), (T.BLANK, ",bnode"), (LITERAL, ",literal"), (T.TRIPLE, ",triple")) for x in (str(k), tag)))

    def step(acc: Column, _: Column) -> Column:
        at, field = acc["at"], acc["field"]
        mark, over, kind = F.substr(text, at, F.lit(1)), at > F.length(text), field == 0
        closing, opening = kind & (mark == ":"), kind & (mark == str(T.TRIPLE))
        digits = F.regexp_extract(F.substr(text, at + F.when(kind, 1).otherwise(0), F.lit(12)), r"^(\d*):", 1)
        size = F.coalesce(digits.try_cast("int"), F.lit(0))
        value = F.substr(text, at + F.length(digits) + 1, size)
        shown = F.concat(acc["out"], F.lit(","), F.length(value).cast("string"), F.lit(":"), value)
        return F.struct(
            F.when(over, at).when(closing | kind & ~opening, at + 1).when(opening, at + F.length(digits) + 2).otherwise(at + F.length(digits) + 1 + size).alias("at"),
            F.when(kind, F.when(closing | opening, 0).otherwise(1)).otherwise((field + 1) % 5).alias("field"),
            F.when(kind, mark).otherwise(acc["kind"]).alias("kind"),
            F.when(over | closing, acc["out"]).when(kind, F.concat(acc["out"], F.element_at(tags, mark))).when((field == 1) | (acc["kind"] == str(LITERAL)), shown).otherwise(acc["out"]).alias("out"),
            (acc["ends"] + F.when(closing, 1).when(opening, -3).otherwise(0)).alias("ends"),
            F.greatest(acc["deepest"], F.when(opening, 1 - F.floor((acc["ends"] - 3) / 3)).otherwise(0).cast("int")).alias("deepest"),
        )

    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("field"), F.lit("").alias("kind"), F.lit("").alias("out"), F.lit(0).alias("ends"), F.lit(1).alias("deepest"))
    done = lambda acc: acc["out"] if depth is None else F.when(acc["deepest"] <= depth, acc["out"])
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), start, step, done)


def minted(args: list, ctx: Context):
    if not args:
        return Node(T.BLANK, ("n", T.Key(F.uuid(), "string")))
    whole = F.concat(*(mint_encoding(x, ctx.argument_depth) for x in args))
    if ctx.mint == "iri":
        return Node(T.IRI, (ctx.mint_name, T.Key(F.sha1(whole.cast("binary")), "string")))
    if ctx.mint == "literal":
        return Dyn(F.when(whole.isNotNull(), make_struct(LITERAL, whole, ctx.mint_name)), frozenset((LITERAL,)))
    return Node(T.BLANK, ("n", T.Key(F.sha1(whole.cast("binary")), "string")))


# --- casts -------------------------------------------------------------------------------------------------------


def cast(dt: str, x):
    if not may_be_literal(x) and not (dt == STRING and kinds(x) == {T.IRI}):
        return None
    if dt == STRING:
        return text(F.when(_is(x, frozenset((T.IRI, LITERAL))), lexical(x)))
    n, v = number(x), F.trim(lexical(x))
    v = F.when(_is(x, frozenset((LITERAL,))), v)
    is_bool = _has_type(x, BOOLEAN)
    if dt in T.INTEGERS:
        plain = F.when(v.rlike(r"^[+-]?[0-9]+$"), v).try_cast("bigint")
        found = F.coalesce(F.when(is_bool, (v == "true").cast("bigint")), F.when(n.value.isNotNull(), as_double(n).try_cast("bigint")) if n and n.dt != INTEGER else n.value if n else plain, plain)
        return Lit(found, INTEGER) if dt == INTEGER else Dyn(F.when(found.isNotNull(), make_struct(LITERAL, found, dt)), frozenset((LITERAL,)))
    if dt == DECIMAL:
        return Lit(F.coalesce(F.when(is_bool, (v == "true").cast("decimal(38,18)")), F.when(v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), v).try_cast("decimal(38,18)"), as_double(n).try_cast("decimal(38,18)") if n else F.lit(None).cast("decimal(38,18)")), DECIMAL)
    if dt in (DOUBLE, FLOAT):
        spelled = F.when(v == "INF", "Infinity").when(v == "-INF", "-Infinity").otherwise(v)
        found = F.coalesce(F.when(is_bool, (v == "true").cast("double")), as_double(n) if n and n.dt else F.when(spelled.rlike(r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?Infinity|NaN)$"), spelled).try_cast("double"))
        return Lit(found, DOUBLE) if dt == DOUBLE else Dyn(F.when(found.isNotNull(), make_struct(LITERAL, found.cast("float"), dt)), frozenset((LITERAL,)))
    if dt == BOOLEAN:
        spelled = F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)
        return Lit(F.coalesce(spelled, (as_double(n) != 0) & ~F.isnan(as_double(n))) if n else spelled, BOOLEAN)
    if dt == DATETIME:
        if isinstance(x, Lit) and x.dt == DATETIME:
            return x
        return Dyn(F.when(v.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"), make_struct(LITERAL, v, dt)), frozenset((LITERAL,)))
    if dt == T.DATE:
        return Dyn(F.when(F.substring(v, 1, 10).try_cast("date").isNotNull(), make_struct(LITERAL, F.substring(v, 1, 10), dt)), frozenset((LITERAL,)))
    return Dyn(F.when(v.isNotNull(), make_struct(LITERAL, v, dt)), frozenset((LITERAL,)))


def _is(x, wanted) -> Column:
    found = T.of_kind(x, wanted)
    return found if isinstance(found, Column) else F.lit(found) & bound(x)


# --- evaluation --------------------------------------------------------------------------------------------------


def condition(e, ctx: Context):
    """Truth value, column or None (error) of a condition."""
    if isinstance(e, A.Call) and e.name in ("&&", "||", "!"):
        parts = [condition(x, ctx) for x in e.args]
        if e.name == "!":
            return parts[0] if parts[0] is None else not parts[0] if isinstance(parts[0], bool) else ~parts[0]
        decisive = e.name == "||"
        if decisive in [p for p in parts if isinstance(p, bool)]:
            return decisive
        left = [F.lit(None).cast("boolean") if p is None else p for p in parts if not isinstance(p, bool)]
        return reduce(Column.__or__ if decisive else Column.__and__, left) if left else not decisive
    x = value(e, ctx)
    if x is None:
        return None
    if isinstance(x, Const) and x.term.dt == BOOLEAN:
        return x.term.v in ("true", "1")
    return boolean(x)


def value(e, ctx: Context):
    """The shape of an expression's value; None if it is an error for every solution."""
    if isinstance(e, Term):
        return T.shape_of(e)
    if isinstance(e, A.Var):
        return ctx.vars.get(e.name)
    if not isinstance(e, A.Call):
        raise TypeError(f"not an expression: {e}")
    name = e.name
    if name in ("&&", "||", "!"):
        found = condition(e, ctx)
        return None if found is None else truth(found)
    if name == "BOUND":
        x = ctx.vars.get(e.args[0].name)
        return truth(x is not None and (bound(x) if T.refs(x) else True))
    args = [value(a, ctx) for a in e.args]
    if name == "COALESCE":
        return coalesced([x for x in args if x is not None])
    if name == "IF":
        return chosen(condition(e.args[0], ctx), args[1], args[2])
    if name in ("IN", "NOT IN"):
        tests = [None if args[0] is None or y is None else equal(args[0], y) for y in args[1:]]
        if True in [t for t in tests if isinstance(t, bool)]:
            found = True
        else:
            left = [F.lit(None).cast("boolean") if t is None else t for t in tests if t is not False]
            found = reduce(Column.__or__, left) if left else False
        return truth(found if name == "IN" else not found if isinstance(found, bool) else ~found)
    if name == MINT:
        return minted(args, ctx)
    if name in ctx.functions:
        given = [struct(x) if x is not None else F.lit(None).cast(T.TERM) for x in args]
        return Dyn(ctx.functions[name](*given), ctx.ranges.get(name, T.ANY))
    if any(x is None for x in args):
        return None
    if name.startswith(T.XSD) and len(args) == 1:
        return cast(name, args[0])
    handler = FUNCTIONS.get(name)
    return handler(name, args, ctx) if handler else None


def coalesced(xs: list):
    xs = [x for i, x in enumerate(xs) if all(T.refs(y) for y in xs[:i])]  # nothing after what is always bound
    if len(xs) < 2:
        return xs[0] if xs else None
    if len({T.form(x) for x in map(natural, xs)}) == 1 and isinstance(natural(xs[0]), Lit):
        return Lit(F.coalesce(*(col(natural(x).ref) for x in xs)), natural(xs[0]).dt)
    return Dyn(F.coalesce(*map(struct, xs)), frozenset().union(*map(kinds, xs)))


def chosen(test, a, b):
    if isinstance(test, bool):
        return a if test else b
    if test is None or a is None and b is None:
        return None
    x, y = natural(a) if a is not None else None, natural(b) if b is not None else None
    if isinstance(x, Lit) and isinstance(y, Lit) and x.dt == y.dt:
        return Lit(F.when(test, col(x.ref)).when(~test, col(y.ref)), x.dt)
    none = F.lit(None).cast(T.TERM)
    found = F.when(test, struct(a) if a is not None else none).when(~test, struct(b) if b is not None else none)
    return Dyn(found, frozenset().union(*(kinds(v) for v in (a, b) if v is not None)))


def _text_function(name: str, args: list, ctx: Context):
    parts = [string(x) for x in args]
    if any(p is None for p in parts[:2]):
        return None
    a = parts[0]
    b = parts[1] if len(parts) > 1 else None
    if name == "STRLEN":
        return Lit(F.length(a.v).cast("bigint"), INTEGER)
    if name in ("UCASE", "LCASE"):
        return a.like((F.upper if name == "UCASE" else F.lower)(a.v))
    if name in ("MD5", "SHA1"):
        return text((F.md5 if name == "MD5" else F.sha1)(a.v.cast("binary")))
    if name[:3] == "SHA":
        return text(F.sha2(a.v.cast("binary"), int(name[3:])))
    if name == "ENCODE_FOR_URI":
        encoded = F.url_encode(a.v)
        for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
            encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
        return text(encoded)
    ok = agreeing(a, b)
    if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
        do = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name]
        return truth(do(a.v, b.v) if b.lang is None else F.when(ok, do(a.v, b.v)))
    at = F.instr(a.v, b.v)
    if name == "STRBEFORE":
        return a.like(F.when(ok & (at > 0), F.substr(a.v, F.lit(1), at - 1)).when(ok & at.isNotNull(), F.lit("")))
    return a.like(F.when(ok & (at > 0), F.substr(a.v, at + F.length(b.v))).when(ok & at.isNotNull(), F.lit("")))


def _substr(name: str, args: list, ctx: Context):
    a, start = string(args[0]), number(args[1])
    if a is None or start is None:
        return None
    begin = F.floor(as_double(start) + 0.5).cast("int")
    if len(args) == 2:
        return a.like(F.substr(a.v, F.greatest(begin, F.lit(1))))
    size = number(args[2])
    if size is None:
        return None
    end = begin + F.floor(as_double(size) + 0.5).cast("int")
    first = F.greatest(begin, F.lit(1))
    return a.like(F.substr(a.v, first, F.greatest(end - first, F.lit(0))))


def _regex(name: str, args: list, ctx: Context):
    parts = [string(x) for x in args]
    if any(p is None for p in parts):
        return None
    if name == "REGEX":
        return truth(F.rlike(parts[0].v, pattern_of(parts[1], args[2] if len(args) > 2 else None)))
    return parts[0].like(F.regexp_replace(parts[0].v, pattern_of(parts[1], args[3] if len(args) > 3 else None), parts[2].v))


def _concat(name: str, args: list, ctx: Context):
    parts = [string(x) for x in args]
    if any(p is None for p in parts):
        return None
    whole = F.concat(*(p.v for p in parts)) if parts else F.lit("")
    if not parts or any(p.lang is None for p in parts):
        return text(whole)
    same = reduce(Column.__and__, (p.lang.eqNullSafe(parts[0].lang) for p in parts))
    return Text(whole, F.when(same, parts[0].lang), F.when(same, parts[0].dir)).like(whole)


def _tagged(name: str, args: list, ctx: Context):
    x = args[0]
    if not may_be_literal(x):
        return None if name in ("LANG", "LANGDIR") else truth(F.lit(False) & bound(x)) if T.refs(x) else truth(False)
    s = struct(x)
    is_literal = s["k"] == LITERAL
    if name in ("LANG", "LANGDIR"):
        return text(F.when(is_literal, F.coalesce(s["lang" if name == "LANG" else "dir"], F.lit(""))))
    return truth(is_literal & s["lang" if name == "HASLANG" else "dir"].isNotNull())


def _lang_matches(name: str, args: list, ctx: Context):
    tag, wanted = (string(x) for x in args)
    if tag is None or wanted is None:
        return None
    t, w = F.lower(tag.v), F.lower(wanted.v)
    return truth(F.when(w == "*", t != "").otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-")))))


def _datatype(name: str, args: list, ctx: Context):
    x = args[0]
    if isinstance(x, Lit):
        return Node(T.IRI, (T.Key(F.when(bound(x), x.dt), "string"),))
    if not may_be_literal(x):
        return None
    return Node(T.IRI, (T.Key(F.when(_is(x, frozenset((LITERAL,))), struct(x)["dt"]), "string"),))


def _typed_literal(name: str, args: list, ctx: Context):
    plain = string(args[0])
    if plain is None:
        return None
    v = plain.v if plain.lang is None else F.when(plain.lang.isNull(), plain.v)
    if name == "STRDT":
        if isinstance(args[1], Const) and args[1].term.v == STRING:
            return text(v)
        dt = F.when(_is(args[1], frozenset((T.IRI,))), lexical(args[1]))
        return Dyn(F.when(v.isNotNull() & dt.isNotNull(), make_struct(LITERAL, v, dt)), frozenset((LITERAL,)))
    tag = F.lower(string(args[1]).v)
    if name == "STRLANG":
        return Dyn(F.when(v.isNotNull() & (tag != ""), make_struct(LITERAL, v, T.LANG_STRING, tag)), frozenset((LITERAL,)))
    way = string(args[2]).v
    return Dyn(F.when(v.isNotNull() & (tag != "") & way.isin("ltr", "rtl"), make_struct(LITERAL, v, T.DIR_STRING, tag, way)), frozenset((LITERAL,)))


def _iri(name: str, args: list, ctx: Context):
    x = args[0]
    if kinds(x) == {T.IRI}:
        return x
    plain = string(x)
    v = plain.v if plain else F.lit(None).cast("string")
    if T.IRI in kinds(x):
        v = F.coalesce(F.when(_is(x, frozenset((T.IRI,))), lexical(x)), v)
    elif plain is None:
        return None
    if ctx.base:
        v = F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), v).otherwise(F.concat(F.lit(ctx.base), v))
    return Node(T.IRI, (T.Key(v, "string"),))


def _triple(name: str, args: list, ctx: Context):
    tests = []
    if not ctx.generalized:
        tests = [T.of_kind(args[0], T.SUBJECTS), T.of_kind(args[1], T.PREDICATES)]
        if False in [t for t in tests if isinstance(t, bool)]:
            return None
    made = Tri(*args)
    tests = [t for t in tests if isinstance(t, Column)]
    if tests:
        return Dyn(F.when(reduce(Column.__and__, tests), struct(made)), frozenset((T.TRIPLE,)))
    return made


def _piece(name: str, args: list, ctx: Context):
    return T.piece(args[0], ("SUBJECT", "PREDICATE", "OBJECT").index(name))


def _kind_test(name: str, args: list, ctx: Context):
    wanted = {"ISIRI": T.IRI, "ISURI": T.IRI, "ISBLANK": T.BLANK, "ISLITERAL": LITERAL, "ISTRIPLE": T.TRIPLE}[name]
    x = args[0]
    if name == "ISBLANK" and ctx.mint == "literal" and may_be_literal(x):
        return truth((struct(x)["dt"].eqNullSafe(F.lit(ctx.mint_name)) | (struct(x)["k"] == T.BLANK)) & bound(x))
    if name == "ISBLANK" and ctx.mint == "iri" and T.IRI in kinds(x):
        return truth((F.startswith(lexical(x), F.lit(ctx.mint_name)) & _is(x, frozenset((T.IRI,)))) | _is(x, frozenset((T.BLANK,))))
    return truth(_kept_error(T.of_kind(x, frozenset((wanted,))), x))


def _is_numeric(name: str, args: list, ctx: Context):
    n = number(args[0])
    if n is None:
        return truth(_kept_error(False, args[0]))
    return truth(_kept_error(True, args[0]) if n.dt else F.when(bound(args[0]), n.value.isNotNull()))


def _str(name: str, args: list, ctx: Context):
    x = args[0]
    fits = T.of_kind(x, frozenset((T.IRI, LITERAL)))
    return None if fits is False else text(lexical(x) if fits is True else F.when(fits, lexical(x)))


def _zone(name: str, args: list, ctx: Context):
    v = F.when(_has_type(args[0], DATETIME), lexical(args[0]))
    zone = F.regexp_extract(v, r"T.*?(Z|[+-]\d\d:\d\d)$", 1)
    if name == "TZ":
        return text(zone)
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    span = F.concat(F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    span = F.when(zone == "Z", "PT0S").when((hours == 0) & (minutes == 0), "PT0S").otherwise(span)
    return Dyn(F.when(zone != "", make_struct(LITERAL, span, T.XSD + "dayTimeDuration")), frozenset((LITERAL,)))


def _fresh(name: str, args: list, ctx: Context):
    if name == "RAND":
        return Lit(F.rand(), DOUBLE)
    if name == "NOW":
        return Lit(F.current_timestamp().cast("timestamp_ntz"), DATETIME)
    if name == "STRUUID":
        return text(F.uuid())
    if name == "UUID":
        return Node(T.IRI, ("urn:uuid:", T.Key(F.uuid(), "string")))
    if args:  # the same node for equal arguments within a solution
        own = col(ctx.vars[SOLUTION].ref) if SOLUTION in ctx.vars else F.uuid()
        return Node(T.BLANK, ("l", T.Key(F.concat(own, F.sha1(lexical(args[0]).cast("binary"))), "string")))
    return Node(T.BLANK, ("u", T.Key(F.uuid(), "string")))


def _pair(name: str, args: list, ctx: Context):
    if name == "SAMETERM":
        return truth(_kept_error(T.same(*args), *args))
    if name in ("=", "!="):
        found = equal(*args)
        if found is None:
            return None
        return truth(found if name == "=" else not found if isinstance(found, bool) else ~found)
    found = compare(name, *args)
    return None if found is None else truth(found)


FUNCTIONS: dict[str, Callable] = {
    **dict.fromkeys(("=", "!=", "<", "<=", ">", ">=", "SAMETERM"), _pair),
    **dict.fromkeys("+-*/", lambda name, args, ctx: arithmetic(name, *args)),
    **dict.fromkeys(("u-", "u+", "ABS", "CEIL", "FLOOR", "ROUND"), lambda name, args, ctx: rounded(name, args[0])),
    **dict.fromkeys(("STRLEN", "UCASE", "LCASE", "MD5", "SHA1", "SHA256", "SHA384", "SHA512", "ENCODE_FOR_URI", "CONTAINS", "STRSTARTS", "STRENDS", "STRBEFORE", "STRAFTER"), _text_function),
    **dict.fromkeys(("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"), lambda name, args, ctx: _time_part(name, args[0])),
    **dict.fromkeys(("LANG", "LANGDIR", "HASLANG", "HASLANGDIR"), _tagged),
    **dict.fromkeys(("ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISTRIPLE"), _kind_test),
    **dict.fromkeys(("SUBJECT", "PREDICATE", "OBJECT"), _piece),
    **dict.fromkeys(("STRDT", "STRLANG", "STRLANGDIR"), _typed_literal),
    **dict.fromkeys(("RAND", "NOW", "UUID", "STRUUID", "BNODE"), _fresh),
    **dict.fromkeys(("TZ", "TIMEZONE"), _zone),
    **dict.fromkeys(("IRI", "URI"), _iri),
    **dict.fromkeys(("REGEX", "REPLACE"), _regex),
    "SUBSTR": _substr, "CONCAT": _concat, "LANGMATCHES": _lang_matches, "DATATYPE": _datatype, "TRIPLE": _triple, "ISNUMERIC": _is_numeric, "STR": _str,
}

