"""Line-first cleaning: rules on each line, then a verdict on what is left of the document."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomgraph.llm.common import U64, Words, mix64, slices, texts, window_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; all are shares of a line or counts in it."""

    #: Punctuation: share of the line's words that end with a symbol or with two equal marks.
    marked_share: float = 0.3
    #: Navigation: share of the words that are lone bars, arrows or bullets.
    divider_share: float = 0.2
    #: Punctuation: share of characters that are symbols.
    symbol_share: float = 0.1
    #: Boilerplate: share of words equal to the word before them, for lines of 8 words or more.
    stutter_share: float = 0.3
    #: A document goes when its failing lines hold more than this share of its word characters.
    lost_share: float = 0.4


#: Phrases of pages' furniture.
BOILERPLATE = re.compile(
    rb"(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|sign up|log ?in|subscribe to|"
    rb"enable javascript|click here|read more|share (?:this|on)|skip to (?:main )?content|powered by|back to top)",
    re.IGNORECASE,
)
DIVIDERS = frozenset([b"|", b"||", b">", b">>", b"<", b"-", b"/", b"*", b"\xc2\xbb", b"\xc2\xab", b"\xe2\x80\xa2", b"\xe2\x86\x92"])
MARKED = re.compile(rb"(?:[#*$%&|<>]|!!|\?\?)[.,;:]?(?=[\x20\x09-\x0d]|\Z)")


def line_fails(line: bytes, rules: LineRules) -> str | None:
    """The name of the rule that the line breaks, or None.  A line without words breaks none."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    dividers = sum(w in DIVIDERS for w in words)
    if dividers > rules.divider_share * n and (dividers >= 2 or n <= 4):
        return "navigation"
    if len(line) - len(line.translate(None, SYMBOLS)) > rules.symbol_share * sum(map(len, words)):
        return "punctuation"
    if len(MARKED.findall(line)) > rules.marked_share * n:
        return "punctuation"
    if n <= 12 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= WINDOW and sum(map(bytes.__eq__, words, words[1:])) > rules.stutter_share * n:
        return "boilerplate"
    return None


def clean_lines(text: bytes, rules: LineRules) -> tuple[bytes, int, int]:
    """The text without its failing lines, how many failed, and the characters of words in them."""
    kept, failed, lost = [], 0, 0
    for line in text.split(b"\n"):
        if line_fails(line, rules):
            failed += 1
            lost += len(b"".join(line.split()).decode("utf-8", "replace"))
        else:
            kept.append(line)
    return (b"\n".join(kept) if failed else text), failed, lost


def repeated_words(groups: list[list[int]], hashes: np.ndarray) -> np.ndarray:
    """For each group, how many of its words lie in a window of 8 words that the group holds twice or more."""
    sizes = np.array([len(g) for g in groups], dtype=np.int64)
    out = np.zeros(len(groups), dtype=np.int64)
    flat = np.fromiter((i for g in groups for i in g), dtype=np.int64, count=int(sizes.sum()))
    if len(flat) < WINDOW:
        return out
    owner = np.repeat(np.arange(len(groups)), sizes)
    found = window_hashes(hashes[flat], WINDOW)
    starts = np.flatnonzero(owner[: len(found)] == owner[WINDOW - 1 :])
    keys = found[starts] ^ mix64(owner[starts].astype(U64) + U64(1))
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(groups)).astype(np.int64)


def assess(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """Statistics and verdict of each whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines and
    lost_chars, and with `with_text` also `text`: the text without its failing lines (unchanged if none fails).

    A null text has no words, so it fails the base rules, as an empty one does; its cleaned text is null.  Lines without
    words are never removed.  Equal rows are judged alike, each by itself.  An empty table gives an empty result.
    One pass over the rows, without a shuffle; memory follows 8 MB of text or the longest text.
    """
    id_type = df.select(f"`{id_col}`").schema[0].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars"]
    schema = f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean" + ", text string" * with_text

    def run(batches):
        for batch in slices(batches, "text"):
            column = batch.column(1)
            raw = column.cast(pa.binary()).to_pylist()
            chars = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            words, groups = Words(), []
            n = len(raw)
            figures = {k: np.zeros(n, dtype=np.int64) for k in names}
            cleaned: list[bytes | None] = []
            for k, text in enumerate(x or b"" for x in raw):
                own = text.split()
                groups.append(words.of(own))
                size = len(b"".join(own))
                figures["n_words"][k] = len(own)
                figures["word_chars"][k] = chars[k] - (len(text) - size)
                figures["n_symbols"][k] = len(text) - len(text.translate(None, SYMBOLS))
                lines = [x for x in text.split(b"\n") if x.strip()]
                figures["n_dup_lines"][k] = len(lines) - len(set(lines))
                left, figures["n_failed_lines"][k], figures["lost_chars"][k] = clean_lines(text, rules)
                cleaned.append(None if raw[k] is None else left)
            figures["n_repeat_words"] = repeated_words(groups, words.hashes())
            failed = (figures["n_words"] < 20) | (100 * figures["n_repeat_words"] > 30 * figures["n_words"])
            kept = ~failed & (figures["lost_chars"] <= rules.lost_share * figures["word_chars"])
            columns = [batch.column(0), *(pa.array(figures[k], type=pa.int64()) for k in names), pa.array(failed), pa.array(kept)]
            if with_text:
                columns.append(pa.array(cleaned, type=pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept"] + ["text"] * with_text)

    return texts(df, id_col, text_col).mapInArrow(run, schema)


def clean(df: DataFrame, *, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, with all their columns, their texts without failing lines.

    A row goes if its whole text fails the base rules or loses too much (see `assess`); null texts go.  Columns keep
    names, order and types.  Null or equal values in other columns don't matter.
    """
    fields = df.schema
    at = fields.fieldNames().index(text_col)

    def run(batches):
        for batch in slices(batches, text_col):
            raw = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            chars = pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()
            words, groups, cleaned, fits = Words(), [], [], []
            for text, size in zip(raw, chars, strict=True):
                own = text.split()
                groups.append(words.of(own))
                left, _, lost = clean_lines(text, rules)
                cleaned.append(left)
                fits.append(len(own) >= 20 and lost <= rules.lost_share * (size - len(text) + len(b"".join(own))))
            repeats = repeated_words(groups, words.hashes())
            keep = [ok and 100 * int(r) <= 30 * len(g) for ok, r, g in zip(fits, repeats, groups, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(cleaned, type=pa.binary()).cast(batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, type=pa.bool_()))

    return df.mapInArrow(run, fields)
