"""Files out: tables of (name, content) written by tasks to a folder that all of them can reach."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import modes, text
from .cards import icon_sys

POLICIES = ("error", "skip", "replace")


def write_files(files: DataFrame, folder: str, on_conflict: str = "error", report: str | None = None) -> DataFrame:
    """Write rows (name, content) as files of ``folder``, a path or a URI; returns (name, bytes, state), a table written at
    ``report`` (a new path in spark.checkpoint.dir, or without that a hidden one in the folder).

    What exists already is an error, left alone, or replaced, by ``on_conflict``.  Each file is written beside its place
    and moved there, so a lost task leaves no half a file and its second attempt writes the same.
    """
    if on_conflict not in POLICIES:
        raise ValueError(f"on_conflict must be one of {POLICIES}")
    uri = folder if "://" in folder else f"file://{folder}"

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for b in batches:
            states = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path = f"{root}/{name}"
                there = store.get_file_info(path).type != fs.FileType.NotFound
                if there and on_conflict != "replace":
                    states.append("exists" if on_conflict == "error" else "skipped")
                    continue
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{path}.part") as f:
                    f.write(content.as_buffer())
                store.move(f"{path}.part", path)
                states.append("replaced" if there else "written")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.as_buffer()) for x in b.column(1)], pa.int64()), pa.array(states, pa.string())], names=["name", "bytes", "state"])

    done = files.where("content IS NOT NULL").select("name", "content").mapInArrow(write, "name string, bytes long, state string")
    # writing happens once, now, and tasks write down what they did
    if report is None:
        report = f"{done.sparkSession.sparkContext.getConf().get('spark.checkpoint.dir', '') or uri}/.written-{uuid.uuid4().hex}"
    done.write.parquet(report)
    return done.sparkSession.read.schema(done.schema).parquet(report)


def save_files(exported: DataFrame, kind: str, entries: DataFrame | None = None) -> DataFrame:
    """(name, content) of exported saves; with ``entries`` under long names, which take the title from icon.sys."""
    ext = f".{kind}"
    if entries is None:
        return exported.select(F.concat("name", F.lit(ext)).alias("name"), "content")
    i = entries.where("name = 'icon.sys'").select("card_id", F.expr("substring(parent, 2)").alias("name"), icon_sys(F.col("data")).alias("i"))
    title = F.concat(F.coalesce("i.title1", F.lit("")), F.coalesce("i.title2", F.lit("")))
    return exported.join(i, ["card_id", "name"], "left").select(F.concat(text.long_name(F.col("name"), title), F.lit(ext)).alias("name"), "content")


def folder_files(entries: DataFrame) -> DataFrame:
    """(name, content) of every file as save/file paths."""
    return entries.where(modes.is_file(F.col("mode"))).select(F.expr("substring(path, 2)").alias("name"), F.coalesce("data", F.lit(b"")).alias("content"))


def listing_text(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(column).write.mode("overwrite").text(path)
