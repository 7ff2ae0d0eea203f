"""Rows of files by their positions, and files read without some of them.

A row of a table that is read from files has a key in its file's number and its position
there, so that rows need no copy to be told apart. Keys that are to go are written as a list
for each file; a task that scans a file reads that file's list and leaves its rows out, so
whole rows are neither copied nor shuffled. Lists lie in the shared folder: a task that is
run again reads them again.

A table that isn't read straight from files is written once to have positions. The list of
files, a name and a number each, goes to all tasks; a driver holds it to plan any scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.llm.common import released, shared_dir, small_batches, written

#: Bits of a key that hold a row's position in its file.
BITS = 40
_PATH, _FILE, _AT = "__path", "__file", "__at"


class Placed:
    """A table whose rows have positions. ``rows`` has its columns and ``key``."""

    def __init__(self, docs: DataFrame, key: str):
        where = (F.col("_metadata.file_path").alias(_PATH), F.col("_metadata.row_index").alias(_AT))
        try:
            placed = docs.select("*", *where)
        except AnalysisException:
            placed = written(docs, "rows").select("*", *where)
        files = placed.select(_PATH).distinct().select(_PATH, F.row_number().over(Window.orderBy(_PATH)).alias(_FILE))  # a row a file
        self.columns, self.schema, self.key = docs.columns, docs.schema, key
        self.placed = placed.join(F.broadcast(written(files, "files")), _PATH)
        self.rows = self.placed.select(*docs.columns, (F.shiftleft(F.col(_FILE).cast("bigint"), BITS) + F.col(_AT)).alias(key))

    def without(self, gone: DataFrame) -> DataFrame:
        """The table without the rows whose keys are in ``gone``."""
        spark = gone.sparkSession
        small_batches(spark)
        folder = f"{shared_dir(spark)}/gone-{uuid.uuid4().hex}"
        lists = gone.select(F.shiftright(self.key, BITS).alias("file"), F.col(self.key).bitwiseAND(F.lit((1 << BITS) - 1)).alias("at"))
        lists.repartition("file").write.partitionBy("file").parquet(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source, root = fs.FileSystem.from_uri(folder)
            held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
            for b in batches:
                files, at = (b.column(k).to_numpy() for k in (0, 1))
                stay = np.ones(len(files), bool)
                for f in np.unique(files).tolist():
                    if f != held[0]:
                        listed = source.get_file_info(fs.FileSelector(f"{root}/file={f}", allow_not_found=True))
                        parts = [pq.ParquetFile(source.open_input_file(i.path)).read(columns=["at"])["at"].to_numpy() for i in listed if i.path.endswith(".parquet")]
                        held = f, np.sort(np.concatenate([*parts, np.zeros(0, np.int64)]))
                    mine = files == f
                    near = np.searchsorted(held[1], at[mine])
                    stay[mine] = near == np.searchsorted(held[1], at[mine], "right")
                kept = b.filter(pa.array(stay))
                yield pa.RecordBatch.from_arrays(kept.columns[2:], kept.schema.names[2:])

        return self.placed.select(_FILE, _AT, *self.columns).mapInArrow(lambda b: released(run(b)), self.schema)
