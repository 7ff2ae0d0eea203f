"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.llm.bpe_automaton import bpe_round_trip
from tidewindow.llm.common import table, tokenizer_json
from tidewindow.llm.exact_dedup import exact_dedup
from tidewindow.llm.fill_middle import fill_in_middle, restored
from tidewindow.llm.filter_audit import filter_audit
from tidewindow.llm.line_dedup import dedup_lines
from tidewindow.llm.mixing import mix_sources
from tidewindow.llm.near_dup import near_duplicates
from tidewindow.llm.pii import pii_digest
from tidewindow.llm.quality_gam import fit_gam, score_quality
from tidewindow.llm.quality_rules import quality_rules
from tidewindow.llm.token_counts import token_counts
from tidewindow.llm.token_output import read_token_files, write_token_files
from tidewindow.llm.toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every row; a null text has none, repeated and null ids each give their row."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"))


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every row; rows of one id are one node, a null id has no component, without words a row is alone."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and digests of every row; a null text counts as empty, repeated and null ids each give their row."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_json("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every row; null texts are equal to empty ones, a null id stays only where no other row has the text."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row; null and empty texts have that of a text on which no voter fires, repeated and null ids each give their row."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit_toxicity(docs, labels, "toxic"), cut=0.5)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row; ``over`` lists the measures beyond a threshold, comma-joined."""
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("over", F.array_join("over", ","))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every row; a null text has none, repeated and null ids each give their row."""
    return pii_digest(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files hold of every row, a null id first and rows of one id by a hash of the text; a null text has the end id alone."""
    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer_json("byte_bpe_50k.json"), end_id=2)
    return read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and decision of every row; null sources, languages and topics count as the empty one, repeated ids share a decision, a null id is drawn by its text."""
    return mix_sources(table(spark, sf_dir, "documents"), budget=0.8, tokenizer=tokenizer_json("byte_bpe_50k.json"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every row; null and empty texts have that of a text without words, repeated and null ids each give their row."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs, fit_gam(docs, labels, "quality"), cut=0.3)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every row; a null text is empty and stays plain, a null id is drawn as an empty one."""
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every source, order and step; null texts and sources are empty ones, a row without labels is neither good nor toxic."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every row and the digest of what stays; a null text is one empty line, a row without an id loses every repeated line that a row with an id holds."""
    thinned = dedup_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5, keep="last")
    return thinned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_near_dup": op2_minhash_near_dup,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_token_output": op8_token_output,
    "op9_mixing": op9_mixing,
    "op10_quality_gam": op10_quality_gam,
    "op11_fill_middle": op11_fill_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}
_WORD, _UPPER, _LOWER = r"[^\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MEASURES = "symbol_share, dup_line_share, upper_share, bang_share, mean_word"


def _fence(side: str) -> str:
    """Of a sorted list v of n values the fence above or below, from the quantiles g at every 200th."""
    inner, edge, beyond = ("v[ceil(n * 0.25)::INT]", "v[ceil(n * 0.75)::INT]", ">") if side == "most" else ("v[ceil(n * 0.75)::INT]", "v[ceil(n * 0.25)::INT]", "<")
    past = f"list_filter(g, lambda x: x {beyond} {edge})"
    ranked = f"WHEN measure = 'dup_line_share' THEN coalesce({past}[floor((len({past}) - 1) * 0.9)::INT + 1], {edge}) "
    return f"CASE WHEN {edge} <> {inner} THEN {edge} + 6 * ({edge} - {inner}) {ranked}ELSE ({edge} + coalesce({past}[(len({past}) - 1) // 2 + 1], {edge})) / 2 END AS {side}"


def _fences(name: str, keys: str) -> str:
    return f"""{name}_v AS (SELECT {keys} measure, list_sort(list(value)) AS v, count(*) AS n FROM long GROUP BY ALL),
{name}_g AS (SELECT *, list_transform(range(201), lambda k: v[greatest(1, ceil(k * n / 200.0 - 1e-9)::INT)]) AS g FROM {name}_v),
{name} AS (SELECT {keys} measure, n, {_fence("most")}, {_fence("least")} FROM {name}_g)"""


def _drawn(side: str, wider: str) -> str:
    return f"(x.n * x.{side} + 200 * {wider}.{side}) / (x.n + 200) AS {side}"


ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY h) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept,
       h AS text_sha256
FROM hashed
""",
    "op2_minhash_near_dup": rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
sets AS (
    SELECT DISTINCT doc_id, sh
    FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS sh FROM worded WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
found AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, low) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN found ON a = d.doc_id
""",
    "op6_quality_rules": rf"""
WITH base AS (
    SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS times FROM (SELECT r, unnest(range(1, len(w) - 6)) AS i, w[i:i+7] AS x FROM base WHERE len(w) >= 8)),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM windows WHERE times > 1) GROUP BY r),
counted AS (
    SELECT base.r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
           len(regexp_extract_all(t, '[A-Z]')) AS capitals, len(regexp_extract_all(t, '!')) AS bangs, coalesce(covered.n, 0) AS n_repeat_words
    FROM base LEFT JOIN covered ON covered.r = base.r
),
measured AS (
    SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_symbols / greatest(word_chars, 1) AS symbol_share, (len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1) AS dup_line_share,
           capitals / greatest(word_chars, 1) AS upper_share, bangs / greatest(word_chars, 1) AS bang_share, word_chars / greatest(n_words, 1) AS mean_word,
           n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
    FROM counted
),
long AS (SELECT lang, source, measure, value FROM (UNPIVOT (SELECT lang, source, n_words, {_MEASURES} FROM measured) ON {_MEASURES} INTO NAME measure VALUE value) WHERE n_words > 0),
{_fences("fine", "lang, source,")}, {_fences("by_lang", "lang,")}, {_fences("whole", "")},
wide AS (SELECT x.lang, x.measure, {_drawn("most", "a")}, {_drawn("least", "a")} FROM by_lang x JOIN whole a USING (measure)),
drawn AS (
    SELECT x.lang, x.source, x.measure, {_drawn("most", "l")}, {_drawn("least", "l")}
    FROM fine x JOIN wide l ON l.measure = x.measure AND l.lang IS NOT DISTINCT FROM x.lang
),
marked AS (
    SELECT v.r, string_agg(CASE WHEN value > most THEN v.measure ELSE 'low_' || v.measure END, ',' ORDER BY place) AS over_
    FROM (UNPIVOT (SELECT r, lang, source, {_MEASURES} FROM measured) ON {_MEASURES} INTO NAME measure VALUE value) v
    JOIN drawn d ON d.measure = v.measure AND d.lang IS NOT DISTINCT FROM v.lang AND d.source IS NOT DISTINCT FROM v.source
    JOIN (SELECT unnest(string_split('{_MEASURES}', ', ')) AS measure, generate_subscripts(string_split('{_MEASURES}', ', '), 1) AS place) o ON o.measure = v.measure
    WHERE value > most OR (v.measure = 'mean_word' AND value < least) GROUP BY v.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND over_ IS NULL AS kept, coalesce(over_, '') AS "over"
FROM measured LEFT JOIN marked ON marked.r = measured.r
""",
    "op11_fill_middle": r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
           list_transform(range(4), lambda k: ('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[8 * k + 1:8 * k + 8])::BIGINT) AS h
    FROM documents
),
formed AS (
    SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
           CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
),
parts AS (SELECT *, list_aggregate(u[1:a], 'string_agg', '') AS p, list_aggregate(u[a + 1:b], 'string_agg', '') AS m, list_aggregate(u[b + 1:], 'string_agg', '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(coalesce(p, '')) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(coalesce(m, '')) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
    "op12_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
rated AS (SELECT doc_id AS l, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           list_filter([CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
                        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                        CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END], lambda x: x IS NOT NULL) AS f
    FROM d LEFT JOIN rated ON l = doc_id
),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
    SELECT a.c || b.c || c.c || d.c || e.c AS o
    FROM letters a JOIN letters b ON b.c <> a.c JOIN letters c ON c.c NOT IN (a.c, b.c) JOIN letters d ON d.c NOT IN (a.c, b.c, c.c) JOIN letters e ON e.c NOT IN (a.c, b.c, c.c, d.c)
),
steps AS (SELECT o, unnest(range(1, 6))::INT AS step FROM orders),
placed AS (SELECT o, step, o[step] AS c, string_split(o[1:step - 1], '') AS before FROM steps),
found AS (
    SELECT part, o, step, c,
           sum(CASE WHEN NOT list_contains(f, c) AND NOT list_has_any(f, before) THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN list_contains(f, c) AND NOT list_has_any(f, before) THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN list_contains(f, c) AND list_has_any(f, before) THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN f = [c] THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN list_contains(f, c) AND NOT list_has_any(f, before) THEN g ELSE 0 END) AS good_lost,
           sum(CASE WHEN list_contains(f, c) AND NOT list_has_any(f, before) THEN x ELSE 0 END) AS toxic_lost
    FROM cells CROSS JOIN placed GROUP BY ALL
)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM found
""",
    "op13_line_dedup": rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS k FROM numbered),
often AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT x.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id <> keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep IS NULL OR keep = doc_id), '')) AS kept_sha256
FROM keyed x LEFT JOIN often USING (k) GROUP BY x.doc_id
""",
}
