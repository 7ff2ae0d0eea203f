"""Fill-in-middle transformation with DuckDB inside mapInArrow.

A worker has one DuckDB connection. Each Arrow batch is registered as a view, a statement
of SQL cuts, draws and joins all its texts, and its result goes back as Arrow.

A text is cut into tokens, each a word with the white space before it, or the white space
at the end. Two cuts between tokens, and the form, come from a hash of the seed and the
key, so a row has the same result wherever it is processed. The middle moves to the end:
``psm`` has prefix, suffix, middle, ``spm`` suffix, prefix, middle, each behind its marker.
A text that is empty or holds a marker stays as it is (``plain``), so that every output can
be taken apart again.

Defined results: a null text counts as empty; a null key is drawn as an empty one; repeated
rows each give their row, those of one key cut at the same draws; an empty table gives no
rows; other columns are ignored. A text is held whole by its worker, some ten times over.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import released, small_batches, text_or_empty

#: What a token is, and the markers of prefix, suffix and middle.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows in a statement of SQL, so that the tokens of few texts are held at once.
STEP = 128
_SCHEMA = "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def cutting_sql(seed: int, rate: int, spm_rate: int) -> str:
    """The statement for a view ``batch`` of (id, t)."""
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    part = lambda low, high: f"array_to_string(list_slice(tokens, {low}, {high}), '')"
    return f"""
WITH cut AS (SELECT id, t, regexp_extract_all(t, '{TOKEN}') AS tokens, sha256('{seed}:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM batch),
drawn AS (
    SELECT *, len(tokens) AS n, {draw(0)} % (len(tokens) + 1) AS x, {draw(1)} % (len(tokens) + 1) AS y,
           CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {draw(2)} % 100 >= {rate} THEN 'plain'
                WHEN {draw(3)} % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form
    FROM cut
),
parts AS (
    SELECT id, n, form, t, CASE WHEN form <> 'plain' THEN {part("1", "least(x, y)")} END AS prefix,
           CASE WHEN form <> 'plain' THEN {part("least(x, y) + 1", "greatest(x, y)")} END AS middle,
           CASE WHEN form <> 'plain' THEN {part("greatest(x, y) + 1", "n")} END AS suffix
    FROM drawn
)
SELECT id, CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
       CASE form WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                 WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE t END AS output
FROM parts"""


def fill_in_middle(docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output`` of every row.

    ``n``: tokens. ``rate``: how many of 100 texts are transformed; ``spm_rate``: how many of
    100 of those have the suffix first.
    """
    small_batches(docs.sparkSession)
    sql = cutting_sql(seed, rate, spm_rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(":memory:", config={"threads": 1}) as db:
            for b in batches:
                for at in range(0, b.num_rows, STEP):
                    db.register("batch", pa.Table.from_batches([b.slice(at, STEP)]))
                    yield from db.sql(sql).to_arrow_table().to_batches()
                    db.unregister("batch")

    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(lambda batches: released(run(batches)), _SCHEMA).withColumnRenamed("id", key)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text from which an output was made. No part holds a marker, so the first of each is the one that was set."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    of = lambda text, marker: F.substring_index(text, marker, 1)  # noqa: E731  before the marker
    behind = lambda text, marker: F.substring_index(text, marker, -1)
    middle = behind(output, MIDDLE)
    prefix, suffix = of(behind(output, PREFIX), SUFFIX), of(behind(output, SUFFIX), MIDDLE)
    prefix_2, suffix_2 = of(behind(output, PREFIX), MIDDLE), of(behind(output, SUFFIX), PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle, suffix_2)).otherwise(output)
