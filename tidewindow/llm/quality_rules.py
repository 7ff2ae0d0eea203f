"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text is measured once. For each measure, language and source a KLL quantile sketch is
built with map-side partial sketches; merged, they give the sketches of languages and of all
rows. A threshold is the fence of the measure's own distribution: FENCE interquartile
ranges beyond the quartile. Where the quartiles are equal there is no range: then the fence
lies midway between them and the median of the values beyond them (of the STEPS + 1
quantiles that a sketch is asked for), so that it follows what outliers the group has; for
measures in RANKED at that rank of the values beyond, as there any value is ordinary (one
repeated line in a short text is a large share) and only the largest are not. Without values
beyond, nothing is beyond the fence. A group's fence is drawn towards
its language's, and that towards the fence of all rows, each counting as SHARED rows, so
that a small group's threshold is mostly its language's, with no switch on size. The
thresholds are joined back and rows beyond any of them fail.

Sketches with SKETCH as their size are exact for groups of about as many rows; beyond that
their ranks are off by about 0.2 %, and as they thin out at random, a row within that
distance of a threshold can get another verdict in another run.

Defined results: a null or empty text has no words and fails the base rule; null languages
and sources are groups of their own; ties lie on the inner side of a threshold; repeated
rows each give their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import text_or_empty, written

#: What separates words, and the characters that count as symbols.
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\f\r"
WINDOW = 8
#: Interquartile ranges beyond the quartiles at which a fence stands.
FENCE = 6.0
#: Measures that have an upper fence, and those that have a lower one too.
UPPER, LOWER = ("symbol_share", "dup_line_share", "upper_share", "bang_share", "mean_word"), ("mean_word",)
#: Ranks among the values beyond equal quartiles at which these measures' fences stand.
RANKED = {"dup_line_share": 0.9}
#: Rows that the fence of the wider group counts as.
SHARED = 200
#: Size of a sketch, and steps between the ranks it is asked for.
SKETCH, STEPS = 2000, 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in 8-word windows found twice or more in the text, the first included.

    Window hashes are compared within the row: where all differ the answer is 0; else
    their sorted order shows which recur, and the recurring starts cover up to 8 words each.
    """

    def covered(starts: Column) -> Column:
        ahead = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.lit(2_000_000_000)))
        return F.aggregate(F.zip_with(starts, ahead, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)

    def recurring(ordered: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        at = lambda i: F.get(ordered, i)
        marked = F.transform(ordered, lambda x, i: F.when(same(x, at(i - 1)) | same(x, at(i + 1)), x["i"]))
        return F.array_sort(F.filter(marked, lambda x: x.isNotNull()))

    def among(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = let(ordered, lambda o: let(recurring(o), covered))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(some)

    def over(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return let(windows, among)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), over)).cast("long")


def count_of(marks: Column, characters: str) -> Column:
    """How many of these ASCII characters a short text of marks has."""
    return (F.octet_length(marks) - F.octet_length(F.regexp_replace(marks, f"[{characters}]+", ""))).cast("long")


def measured(docs: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """The counts of every row and the measures that thresholds are set for."""
    base = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), text_or_empty(text).alias("t"))
    # the characters that are counted, picked out in one pass
    base = base.withColumns({"w": words_of(F.col("t")), "marks": F.regexp_replace("t", f"[^A-Z!{SYMBOLS}]+", "")})
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(BLANK_CHARS)) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    counted = base.select(
        "id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count_of(F.col("marks"), SYMBOLS).alias("n_symbols"),
        line_counts.alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        count_of(F.col("marks"), "!").alias("bangs"),
        count_of(F.col("marks"), "A-Z").alias("capitals"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        "id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words",
        per("n_symbols", "word_chars").alias("symbol_share"),
        (F.col("lines.dup") / F.greatest("lines.n", F.lit(1))).alias("dup_line_share"),
        per("capitals", "word_chars").alias("upper_share"),
        per("bangs", "word_chars").alias("bang_share"),
        per("word_chars", "n_words").alias("mean_word"),
    )


def fence(quantiles: Column, *, upper: bool = True, rank: float | None = None) -> Column:
    """The value beyond which rows are outliers, from STEPS + 1 quantiles; ``rank``: that of an upper fence where the quartiles are equal."""
    low, high = F.get(quantiles, F.lit(STEPS // 4)), F.get(quantiles, F.lit(3 * STEPS // 4))
    inner, edge = (low, high) if upper else (high, low)
    beyond = F.filter(quantiles, lambda v: v > edge if upper else v < edge)
    there = F.coalesce(F.get(beyond, F.floor((F.size(beyond) - 1) * (rank or 0.5)).cast("int")), edge)
    return F.when(edge != inner, edge + FENCE * (edge - inner)).otherwise(there if rank else (edge + there) / 2)


def thresholds(rows: DataFrame) -> DataFrame:
    """``lang_, source_`` and a threshold per measure and side, from mergeable quantile sketches."""
    fine = rows.filter("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH)).alias(m) for m in UPPER))
    fine = written(fine, "sketches")
    merged = [F.sum("rows").alias("rows"), *(F.kll_merge_agg_double(m, F.lit(SKETCH)).alias(m) for m in UPPER)]
    by_lang, whole = fine.groupBy("lang").agg(*merged), fine.agg(*merged)
    sides = [(f"{m}_most", m, True) for m in UPPER] + [(f"{m}_least", m, False) for m in LOWER]

    def fences(sketches: DataFrame, tag: str, *keys: Column) -> DataFrame:
        ranks = F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1)))
        asked = sketches.select(*keys, F.col("rows").cast("double").alias(f"rows_{tag}"), *(F.kll_sketch_get_quantile_double(m, ranks).alias(m) for m in UPPER))
        return asked.select(*(F.col(c) for c in asked.columns if c not in UPPER), *(fence(F.col(m), upper=up, rank=RANKED.get(m)).alias(f"{name}_{tag}") for name, m, up in sides))

    drawn = lambda name, tag, wider: (F.col(f"rows_{tag}") * F.col(f"{name}_{tag}") + SHARED * wider) / (F.col(f"rows_{tag}") + SHARED)
    of_lang = fences(by_lang, "l", F.col("lang").alias("of")).join(F.broadcast(fences(whole, "a")))  # one row
    of_lang = of_lang.select("of", *(drawn(name, "l", F.col(f"{name}_a")).alias(f"{name}_w") for name, _, _ in sides))
    of_group = fences(fine, "s", F.col("lang").alias("lang_"), F.col("source").alias("source_"))
    out = of_group.join(of_lang, F.col("lang_").eqNullSafe(F.col("of")))
    return out.select("lang_", "source_", *(drawn(name, "s", F.col(f"{name}_w")).alias(name) for name, _, _ in sides))


def quality_rules(docs: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """``key``, the counts, ``base_failed``, ``kept``, and ``over``: the measures beyond their thresholds."""
    rows = written(measured(docs, text=text, key=key, lang=lang, source=source), "measures")
    most = thresholds(rows)
    joined = rows.join(most, rows["lang"].eqNullSafe(most["lang_"]) & rows["source"].eqNullSafe(most["source_"]), "left")
    beyond = [F.when(F.col(m) > F.col(f"{m}_most"), F.lit(m)) for m in UPPER] + [F.when(F.col(m) < F.col(f"{m}_least"), F.lit(f"low_{m}")) for m in LOWER]
    over = F.filter(F.array(*beyond), lambda x: x.isNotNull())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.select(
        F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.size(over) == 0)).alias("kept"), over.alias("over"),
    )
