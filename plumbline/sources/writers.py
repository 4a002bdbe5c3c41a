"""Writers in the layouts that other tools read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object in a line, UTF-8; null fields are written."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def by_sample(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder for each sample_id, so that a sample is read without the others."""
    df.write.mode(mode).option("ignoreNullFields", "false").partitionBy("sample_id").json(path)


def as_json(df: DataFrame, into: str = "json") -> DataFrame:
    """One column of compact JSON."""
    return df.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"}).alias(into))


def named_files(df: DataFrame, folder: str, name: str = "name", value: str = "value") -> int:
    """Writes each row's value as a file of the row's name into a folder, and returns how many: one file for each sample, say.

    Tasks write their own rows' files, UTF-8, each under another name first and then moved, so that no reader sees half a file and a task that
    runs again writes the same. The folder may be wherever pyarrow's file systems reach; names must be unique and hold no
    slash, a null value is an empty file."""

    def run(batches):
        from uuid import uuid4

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not n or "/" in n:
                    raise ValueError(f"no name for a file: {n}")
                with store.open_output_stream(half := f"{root}/.{uuid4().hex}") as out:
                    out.write((v or "").encode("utf-8"))
                store.move(half, f"{root}/{n}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = df.select(F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
