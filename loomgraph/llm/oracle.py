"""DuckDB SQL that the queries of operators must agree with, where SQL can express their rows."""

from __future__ import annotations

from loomgraph.llm.quality_rules import DIVIDERS, LineRules
from loomgraph.llm.secrets import BASE_RULES, RULES, SecretRule

_GAP = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str, gap: str = _GAP) -> str:
    return f"list_filter(string_split_regex({text}, '{gap}'), lambda x: x <> '')"


def remainder(doc_id: str, n: int) -> str:
    """crc32 of the id as text, modulo n: byte after byte, a bit at a time (-1 stands for a shift)."""
    steps = f"flatten(list_transform(string_split(coalesce({doc_id}::VARCHAR, ''), ''), lambda x: [ascii(x)::BIGINT] || repeat([-1::BIGINT], 8)))"
    shift = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"(xor(list_reduce([4294967295::BIGINT] || {steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE {shift} END), 4294967295::BIGINT) % {n})"


def quality_rules_sql(rules: LineRules = LineRules()) -> str:
    """Line rules as in the operator; a line's words that end with a mark are those that end in a symbol or a double mark."""
    dividers = ", ".join(quoted(d.decode()) for d in sorted(DIVIDERS))
    phrases = "(?i)(cookie policy|privacy policy|terms of (use|service)|all rights reserved|sign up|log ?in|subscribe to|enable javascript|click here|read more|share (this|on)|skip to (main )?content|powered by|back to top)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {words("coalesce(text, '')")} AS w FROM documents),
 ls AS (SELECT r, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
 lw AS (SELECT r, line, {words("line")} AS w FROM ls),
 lx AS (SELECT r, line, w, len(w) AS n, len(list_filter(w, lambda x: x IN ({dividers}))) AS dividers, strlen(array_to_string(w, '')) AS size FROM lw),
 judged AS (SELECT r, line, length(array_to_string(w, '')) AS chars,
    (dividers > {rules.divider_share}::DOUBLE * n AND (dividers >= 2 OR n <= 4))
    OR strlen(line) - strlen(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > {rules.symbol_share}::DOUBLE * size
    OR len(list_filter(w, lambda x: regexp_matches(x, '([#*$%&|<>]|!!|\?\?)[.,;:]?$'))) > {rules.marked_share}::DOUBLE * n
    OR (n <= 12 AND regexp_matches(line, {quoted(phrases)}))
    OR (n >= 8 AND len(list_filter(range(1, n), lambda i: w[i] = w[i + 1])) > {rules.stutter_share}::DOUBLE * n) AS fails FROM lx),
 lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM judged GROUP BY r),
 win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
 named AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS window8 FROM win),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, window8) AS k FROM named) WHERE k > 1),
 again AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, range(8) AS t(o) GROUP BY r),
 base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost, 0)::BIGINT AS lost_chars
    FROM d LEFT JOIN lines USING (r) LEFT JOIN again USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= {rules.lost_share}::DOUBLE * word_chars AS kept FROM base"""


def _spans(rule: SecretRule, rank: int) -> str:
    """Places of a rule's matches: running sums over the text's pieces between matches and the matches."""
    p = quoted(rule.pattern)
    return f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, e - length(m) AS s, e FROM (
 SELECT r, m, j, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
  SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(js) AS j, unnest(gs[1:len(ms)]) AS g FROM (
   SELECT r, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {rule.group}) AS js, string_split_regex(t, {p}) AS gs FROM d WHERE regexp_matches(t, {p})))) WHERE length(j) >= {rule.least}"""


def secret_scan_sql(rules: tuple[SecretRule, ...] = RULES) -> str:
    spell = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in BASE_RULES)
    every = "\n UNION ALL ".join(_spans(x, i) for i, x in enumerate(rules))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 found AS ({every})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256({spell(f"rank < {len(BASE_RULES)}")}) AS base_sha256, {spell("rank IS NOT NULL")} AS spans FROM d LEFT JOIN found USING (r) GROUP BY r"""


def language_model_base_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {remainder("doc_id", 10)} = 0 AS held_out, {words(_LOWERED)} || [''] AS w FROM documents),
 t AS (SELECT r, held_out, unnest(w) AS token FROM d),
 c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
 totals AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
 scored AS (SELECT r, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score FROM t LEFT JOIN c USING (token), totals GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, n::BIGINT AS train_tokens, round(base_score, 5) AS base_score FROM d JOIN scored USING (r), totals"""


def near_dedup_sql(percent: int = 85) -> str:
    """All links among texts' shingle sets, and the smallest id that links reach."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {words(_LOWERED)} AS w FROM documents),
 sets AS (SELECT r, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
 sizes AS (SELECT r, len(s) AS n FROM sets),
 each AS (SELECT r, hash(x) AS x FROM (SELECT r, unnest(s) AS x FROM sets)),
 pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM each a JOIN each b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN sizes p ON a = p.r JOIN sizes q ON b = q.r WHERE 100 * common >= {percent} * (p.n + q.n - common)),
 reach(r, o) AS (SELECT r, r FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.o = links.a),
 lowest AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON reach.o = d.r GROUP BY reach.r)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN sizes USING (r) JOIN lowest USING (r)"""


def license_base_sql() -> str:
    """A phrase stands where the words from there on are its own; GAPS part words."""
    gaps = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
    at = " UNION ALL ".join(f"SELECT r, i - 1 AS place, '{label}' AS label FROM p WHERE w[i:i + {len(text.split()) - 1}] = {text.split()!r}" for text, label in phrases)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words(_LOWERED, gaps)} AS w FROM documents),
 p AS (SELECT r, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('gnu', 'apache', 'cc', 'mit'))) AS i FROM d),
 found AS ({at})
SELECT any_value(doc_id) AS doc_id, any_value(len(w)) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM d LEFT JOIN found USING (r) GROUP BY r"""


def nearest_sql(k: int = 5, each: int = 50) -> str:
    """Every candidate by its exact cosine."""
    dot = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
 u AS (SELECT vec_id, e, sqrt({dot("e", "e")}) AS size FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 s AS (SELECT q.vec_id AS query_id, u.vec_id, {dot("q.e", "u.e")} / (u.size * q.size) AS score FROM u q JOIN u ON q.vec_id <> u.vec_id AND len(q.e) = len(u.e) WHERE q.vec_id % {each} = 0),
 ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, round(score, 9) AS score FROM ranked WHERE rank <= {k}"""
