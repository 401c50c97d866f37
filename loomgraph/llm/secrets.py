"""Secret scans by a trigram inverted index, in DataFrame operations only.

From each rule's pattern a Boolean trigram query is derived: in any text that the pattern matches, some alternative
of the query has all its trigrams.  The index holds postings (trigram -> texts) of the trigrams that the queries name;
intersecting postings within an alternative, and uniting alternatives, gives the candidates of a rule, and only those
are verified with the pattern.  A pattern without mandatory trigrams is run on every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SecretRule:
    """`pattern` is in Java's syntax.  A match counts if `group` has at least `least` characters; when every match that
    is too short may be skipped without moving later matches, `quick` is a pattern of the long ones alone."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    quick: str | None = None

    @property
    def scanned(self) -> str:
        return self.quick or self.pattern


#: The order is that in which kinds are listed for equal starts.  The runs of `access` and `hex` are maximal, so a
#: short run holds no match of its own and asking for the length in the pattern drops the same matches.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    SecretRule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
)
#: Rules that the method adds.
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# --- trigram queries -------------------------------------------------------------------------------------------


def _literal_runs(pattern: str) -> list[list[str]]:
    """Alternatives of a pattern, each the literal runs that a match must hold, in lower case.  Understands literals,
    escapes, classes, groups, alternation, and `? * + {m,n}`; a part that it can't spell out only ends a run."""
    pos = 0
    most = 64  # alternatives of one sequence; beyond it, the part is treated as unknown

    def alternation() -> list[list[str | None]]:
        nonlocal pos
        out = sequence()
        while pos < len(pattern) and pattern[pos] == "|":
            pos += 1
            out += sequence()
        return out

    def sequence() -> list[list[str | None]]:
        out: list[list[str | None]] = [[]]
        while pos < len(pattern) and pattern[pos] not in "|)":
            item = repeated(atom())
            out = [a + b for a in out for b in item] if len(out) * len(item) <= most else [[*a, None] for a in out]
        return out

    def atom() -> list[list[str | None]]:
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c == "(":
            if m := re.compile(r"\?(?:[a-z]*:|[=!]|<[=!])").match(pattern, pos):
                pos = m.end()
            around = bool(m) and m[0][-1] in "=!"
            inner = alternation()
            pos += 1
            return [[None]] if around else inner
        if c == "[":
            start = pos
            pos += pattern[pos] == "^"
            pos += 1  # a first "]" is a member
            while pattern[pos] != "]":
                pos += 2 if pattern[pos] == "\\" else 1
            members = pattern[start:pos]
            pos += 1
            return [[x.lower()] for x in members] if len(members) <= 6 and members.isalnum() else [[None]]
        if c == "\\":
            e = pattern[pos]
            pos += 1
            if e == "x":
                pos += 2
                return [[chr(int(pattern[pos - 2 : pos], 16)).lower()]]
            return [[e.lower()]] if not e.isalnum() else [[None]]
        return [[None]] if c in ".^$" else [[c.lower()]]

    def repeated(item: list[list[str | None]]) -> list[list[str | None]]:
        nonlocal pos
        m = re.compile(r"[?*+]|\{(\d+)(,\d*)?\}").match(pattern, pos)
        if not m:
            return item
        pos = m.end()
        if pattern[pos : pos + 1] in ("?", "+"):
            pos += 1
        if m[0] == "?":
            return [*item, []]
        if m[0] == "*" or m[1] == "0":
            return [[None]]
        return [[*a, None] for a in item]  # once, then who knows

    def runs(items: list[str | None]) -> list[str]:
        return [x for x in "".join(c if c is not None else "\0" for c in items).split("\0") if x]

    return [runs(a) for a in alternation()]


def _spread(trigrams: list[str], most: int) -> frozenset[str]:
    """At most `most` of the trigrams, evenly spaced: a few that don't overlap narrow as well as all of them."""
    own = list(dict.fromkeys(trigrams))
    step = max(1, (len(own) - 1) / max(1, most - 1))
    return frozenset(own[min(len(own) - 1, round(i * step))] for i in range(min(most, len(own))))


def trigram_query(pattern: str, most: int = 3) -> list[frozenset[str]] | None:
    """Alternatives (OR) of trigrams (AND) of which every match has one whole, over the lower-cased text; None if some
    alternative has no mandatory trigram, so that the index can't narrow the pattern.  At most `most` of a run."""
    out = {frozenset(t for run in runs if len(run) > 2 for t in _spread([run[i : i + 3] for i in range(len(run) - 2)], most)) for runs in _literal_runs(pattern)}
    if frozenset() in out:
        return None
    return sorted((a for a in out if not any(b < a for b in out)), key=sorted)


# --- the index ---------------------------------------------------------------------------------------------------


def text_key(doc_id: Column, text: Column) -> Column:
    """The key of postings.  Two rows that share it only share candidates, which are verified text by text."""
    return F.xxhash64(doc_id, text)


def postings(df: DataFrame, trigrams: list[str], *, id_col: str, text_col: str) -> DataFrame:
    """(trigram, key) of the given trigrams in the lower-cased texts, without repeats for a row."""
    low = F.lower(F.col(f"`{text_col}`"))
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams)))
    return df.select(text_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"), F.explode(found).alias("trigram"))


def candidates(df: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(key, kinds) of rows that may hold a match of the rules that have a trigram query; None without such a rule.

    A row's postings meet under its key: at most one for each trigram and row with that key, pre-aggregated.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if not queries:
        return None
    names = sorted({t for q in queries.values() for a in q for t in a})
    bit = {t: i for i, t in enumerate(names)}
    width = 60
    lists = postings(df, names, id_col=id_col, text_col=text_col)
    words = []
    for k in range(0, len(names), width):
        masks = F.create_map(*(x for t in names[k : k + width] for x in (F.lit(t), F.lit(1 << (bit[t] - k)).cast("long"))))
        words.append(F.bit_or(F.coalesce(F.try_element_at(masks, F.col("trigram")), F.lit(0).cast("long"))).alias(f"w{k}"))
    met = lists.groupBy("key").agg(*words)

    def holds(alternative: frozenset[str]) -> Column:
        out = F.lit(True)
        for k in range(0, len(names), width):
            mask = sum(1 << (bit[t] - k) for t in alternative if k <= bit[t] < k + width)
            out = out & (F.col(f"w{k}").bitwiseAND(F.lit(mask)) == F.lit(mask)) if mask else out
        return out

    kinds = F.array_compact(F.array(*(F.when(reduce(Column.__or__, map(holds, q)), F.lit(kind)) for kind, q in queries.items())))
    return met.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


# --- verification ------------------------------------------------------------------------------------------------

#: Elements of an array that one fold collects.
BLOCK = 256
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def pieces_of(values: Column, block: int = BLOCK) -> Column:
    """An array cut into arrays of `block` elements.  `values` is named for each of them, so it should be computed already."""
    last = F.greatest(F.ceil(F.size(values) / block).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * block + 1, F.lit(block)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints, `op` over 0 and all that come before it.  A fold that collects copies what it has at
    each step, so it only runs over blocks, and over one value for each block."""
    none = F.array().cast("array<int>")

    def fold(own: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), none.alias("out"))
        return F.aggregate(own, first, lambda acc, x: F.struct(op(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    total = lambda own: F.aggregate(own, F.lit(0), lambda acc, x: op(acc, x).cast("int"))
    joined = lambda ps: F.flatten(F.zip_with(ps, fold(F.transform(ps, total), F.lit(0)), fold))
    return once(values, lambda v: once(pieces_of(v), joined))


def rule_spans(text: Column, rule: SecretRule, rank: int) -> Column:
    """Spans of the rule's leftmost non-overlapping matches that are long enough; code points, end exclusive.

    Splitting at the matches gives the gaps between them, so running sums of the lengths of gaps and matches are the
    places; neither call rescans a text once for each match.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.scanned), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.scanned), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.scanned, -1)
    parts = F.zip_with(F.arrays_zip(whole.alias("m"), judged.alias("j")), F.slice(gaps, 1, F.size(whole)), lambda x, g: F.struct(F.length(g).alias("g"), F.length(x["m"]).alias("m"), F.length(x["j"]).alias("j")))

    def place(x: Column, at: Column) -> Column:
        begin = at + x["g"]
        return F.when(x["j"] >= rule.least, F.struct(begin.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + x["m"]).cast("int").alias("end")))

    return once(parts, lambda ps: F.array_compact(F.zip_with(ps, before(F.transform(ps, lambda x: x["g"] + x["m"]), lambda a, b: a + b), place)))


def find(df: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", output: str = "spans") -> DataFrame:
    """`df` with a column `output`: array of (start, rank, kind, end) by start, then by the rule's place in `rules`.

    A null text counts as empty and has none; so has an empty text.  Repeated rows are scanned each by itself, also when
    their ids are null.  A column that already has the output's name is replaced; others are kept whatever their names.
    An empty table gives an empty result.  Scans read whole texts.
    """
    names = [c for c in df.columns if c != output]
    kept = df.select(*(F.col(f"`{c}`") for c in names))
    text = F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))
    found = candidates(kept, rules, id_col=id_col, text_col=text_col)
    packed = kept.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"))
    if found is None:
        joined = packed.withColumn("kinds", F.lit(None).cast("array<string>"))
    else:
        keyed = packed.withColumn("key", text_key(F.col(f"d.`{id_col}`"), F.col(f"d.`{text_col}`")))
        joined = keyed.join(found, "key", "left").drop("key")
    spans = []
    for rank, rule in enumerate(rules):
        # the pattern's first hit decides if the text is split at all; no other scan of texts without one
        may = F.array_contains(F.col("kinds"), rule.kind) if trigram_query(rule.pattern) else F.lit(True)
        spans.append(F.when(may & F.rlike(text, F.lit(rule.scanned)), rule_spans(text, rule, rank)).otherwise(F.array().cast(_SPAN)))
    whole = F.array_sort(F.concat(*spans))
    return joined.select(*(F.col(f"d.`{c}`").alias(c) for c in names), whole.alias(output))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_sha256 (of the base rules' spans spelled out) and spans (of all rules)."""
    found = find(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), rules)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def redact(df: DataFrame, rules: tuple[SecretRule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`df` with every span of its texts replaced by `mask`; spans that overlap give one mask.  Columns keep names and
    order; a text without a span, null included, is unchanged."""
    marked = "\x01spans"
    found = find(df, rules, id_col=id_col, text_col=text_col, output=marked)
    text = F.col(f"`{text_col}`")

    def cleaned(block: Column) -> Column:
        """What stands for the text from where a block of spans begins to where it ends."""
        begin, end = block[0]["at"], F.array_max(F.transform(block, lambda x: F.greatest(x["at"], x["end"])))

        def piece(own: Column, x: Column) -> Column:
            gap = F.substring(own, x["at"] - begin + 1, F.greatest(x["start"] - x["at"], F.lit(0)))
            return F.concat(gap, F.when(x["start"] >= x["at"], F.lit(mask)).otherwise(F.lit("")))

        return once(F.substring(text, begin + 1, end - begin), lambda own: F.array_join(F.transform(block, lambda x: piece(own, x)), ""))

    def masked(spans: Column) -> Column:
        reached = before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        placed = F.zip_with(spans, reached, lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("at")))
        rest = F.substring(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(once(placed, lambda p: F.array_join(F.transform(pieces_of(p), cleaned), "")), rest)

    spans = F.col(f"`{marked}`")
    clean = F.when(F.size(spans) > 0, once(spans, masked)).otherwise(text)
    return found.withColumn(text_col, clean).select(*(F.col(f"`{c}`") for c in df.columns))
