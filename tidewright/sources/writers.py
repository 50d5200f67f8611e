"""Writers: a full table with a geometry-free copy, and one part for each basin."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json", "orc")


def written(df: DataFrame, path: str, geometry: str | None = None, fmt: str | None = None) -> str:
    """df at path, by its suffix or fmt; with a geometry column, a CSV copy without it beside. Returns the path."""
    fmt = fmt or path.rpartition(".")[2]
    if fmt not in FORMATS:
        raise ValueError(f"{fmt!r} is none of {FORMATS}")
    df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)
    if geometry and geometry in df.columns:
        df.drop(geometry).write.mode("overwrite").csv(f"{path}.attributes.csv", header=True)
    return path


def by_basin(df: DataFrame, path: str, basin: str) -> None:
    """One folder for each basin; rows of a basin are brought together first, large basins over several files."""
    df.repartition(basin).write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy(basin).parquet(path)


def exported(df: DataFrame, names: Mapping[str, str], drop: Sequence[str] = ("rings",)) -> DataFrame:
    """Chosen columns under new names, without geometry."""
    return df.select(*(F.col(a).alias(b) for a, b in names.items() if a not in drop))


def named_files(df: DataFrame, path: str, name: Column | str, line: Column | str, order: str, head: Column | str | None = None) -> DataFrame:
    """One text file for each name, of its lines in order behind an optional head (equal within a name).

    name, line and head may be expressions over df's columns: only those columns are shuffled and sorted, lines and the one
    head of a file are made behind the sort. Tasks write under a folder that driver and executors share, a file under a name
    of its own until it is whole, so a repeated task does no harm; no file is held in memory. Returns (name, lines), where a
    row counts as a line.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    by = Window.partitionBy("__name").orderBy(F.asc_nulls_last(order))
    rows = df.withColumn("__name", col(name)).withColumn("__k", F.row_number().over(by))
    first = F.lit(None).cast("string") if head is None else F.when(F.col("__k") == 1, col(head))
    rows = rows.select(F.col("__name").alias("name"), F.col("__k").alias("k"), first.alias("head"), col(line).alias("line"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        to = own = file = None
        lines = 0

        def closed() -> pa.RecordBatch:
            file.close()
            system.move(own, f"{root}/{to}")
            return pa.RecordBatch.from_arrays([pa.array([to], pa.string()), pa.array([lines], pa.int64())], ["name", "lines"])

        for batch in batches:
            names, heads, texts = (batch.column(c) for c in ("name", "head", "line"))
            # Rows of a name lie together, numbered from 1; the batch may begin within one.
            starts = np.flatnonzero(batch.column("k").to_numpy(zero_copy_only=False) == 1).tolist()
            fresh, cuts = set(starts), sorted({0, *starts, batch.num_rows})
            for begin, end in itertools.pairwise(cuts):
                part = texts.slice(begin, end - begin).to_pylist()
                if begin in fresh:
                    if file is not None:
                        yield closed()
                    to, own, lines = names[begin].as_py(), f"{root}/.{uuid.uuid4().hex}", 0
                    file = system.open_output_stream(own)
                    part = [h for h in [heads[begin].as_py()] if h is not None] + part
                lines += end - begin
                file.write(("\n".join(part) + "\n").encode())
        if file is not None:
            yield closed()

    return rows.mapInArrow(run, "name string, lines long")
