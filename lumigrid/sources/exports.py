"""Copies of files into a folder for each cluster, by tasks that commit: a cluster's folder is there with all of its copies
or it isn't there.

Each file is copied under a name that no other attempt uses, and what the successful attempts have copied is a written
table. Then copies are renamed into their cluster's staged folder, and each staged folder is renamed to its place, once.
All three steps may run again in part: what is done already is seen and left alone. Names are never overwritten, so an
export goes to a target without these clusters.

Needs a file system whose rename moves folders as one, as local ones and HDFS do.

Defined results: a file that is missing or can't be read has an error and its cluster goes on without it, as long as one
file of the cluster could be copied; null sources have an error; rows that repeat a place are copied once, from the least
source; an empty list makes no folder.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.sources import shared

COPIED = "cluster_id string, src string, name string, staged string, bytes long, sha256 string, error string"
PLACED = "cluster_id string, name string, placed boolean"
STEP = 1 << 20


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def copied(files: DataFrame, source: str, staging: str) -> DataFrame:
    """COPIED: each file (cluster_id, src, name), src below the folder source, copied to staging under a name of its own, with
    the hash of what has been read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (from_, root), (to, place) = _store(source), _store(staging)
        to.create_dir(place, recursive=True)
        for b in batches:
            out = []
            for cluster, src, name in b[["cluster_id", "src", "name"]].itertuples(index=False):
                mine, error, size, digest = f"{place}/{uuid.uuid4().hex}", None, None, None
                try:
                    if not src:
                        raise ValueError("no such file is known")
                    if posixpath.normpath(src).split("/")[0] == ".." or posixpath.isabs(src):
                        raise ValueError("a source that leaves the folder")
                    read, again, size = hashlib.sha256(), hashlib.sha256(), 0
                    with from_.open_input_stream(f"{root}/{src}") as f, to.open_output_stream(mine) as g:
                        while part := f.read(STEP):
                            read.update(part)
                            g.write(part)
                            size += len(part)
                    with to.open_input_stream(mine) as g:
                        while part := g.read(STEP):
                            again.update(part)
                    if read.digest() != again.digest():
                        raise OSError("the copy differs from its source")
                    digest = again.hexdigest()
                except (OSError, ValueError) as e:
                    error, size = str(e), None
                out.append((cluster, src, name, None if error else mine, size, digest, error))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in COPIED.split(", ")])

    return files.select("cluster_id", "src", "name").mapInPandas(run, COPIED)


def placed(copies: DataFrame, ready: str) -> DataFrame:
    """PLACED: copies renamed to their names in their cluster's folder below ready."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(ready)
        for b in batches:
            for cluster in b["cluster_id"].unique():
                store.create_dir(f"{root}/{cluster}", recursive=True)
            for cluster, name, staged in b[["cluster_id", "name", "staged"]].itertuples(index=False):
                if _there(store, staged):  # else an earlier attempt has done it
                    store.move(staged, f"{root}/{cluster}/{name}")
                elif not _there(store, f"{root}/{cluster}/{name}"):
                    raise OSError(f"the copy of {cluster}/{name} is gone")
            yield pd.DataFrame({"cluster_id": b["cluster_id"], "name": b["name"], "placed": True})

    return copies.select("cluster_id", "name", "staged").mapInPandas(run, PLACED)


def committed(clusters: DataFrame, ready: str, target: str) -> DataFrame:
    """(cluster_id, error) of clusters (cluster_id) whose folders have been renamed to target."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (store, root), (_, place) = _store(ready), _store(target)
        store.create_dir(place, recursive=True)
        for b in batches:
            out = []
            for cluster in b["cluster_id"]:
                if not _there(store, f"{root}/{cluster}"):  # an earlier attempt has done it
                    out.append((cluster, None))
                elif _there(store, f"{place}/{cluster}"):
                    out.append((cluster, "the target has this cluster already"))
                else:
                    store.move(f"{root}/{cluster}", f"{place}/{cluster}")
                    out.append((cluster, None))
            yield pd.DataFrame(out, columns=["cluster_id", "error"])

    return clusters.select("cluster_id").mapInPandas(run, "cluster_id string, error string")


def exported(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """(cluster_id, src, dst, bytes, sha256, error) of a manifest's copies (cluster_id, src, dst with the file's name at its end),
    after all that could be copied are in their place below target."""
    run = uuid.uuid4().hex
    base = f"{target.rstrip('/')}/_staged/{run}"
    each = manifest.select("cluster_id", "src", F.element_at(F.split("dst", "/"), -1).alias("name"))
    safe = F.col("cluster_id").rlike(r"^[^/]+$") & ~F.col("cluster_id").isin(".", "..", "_staged") & ~F.col("name").isin("", ".", "..")
    each = each.groupBy("cluster_id", "name").agg(F.min("src").alias("src"))
    unsafe = each.where(~F.coalesce(safe, F.lit(False)))
    good = shared.written(copied(each.where(safe).repartition("cluster_id", "name"), source, f"{base}/files"), "copies")
    shared.written(placed(good.where("error is null"), f"{base}/ready"), "placed")
    ends = shared.written(committed(good.where("error is null").select("cluster_id").distinct(), f"{base}/ready", target), "committed")
    done = good.join(ends.withColumnRenamed("error", "late"), "cluster_id", "left").withColumn("error", F.coalesce("error", "late"))
    out = done.unionByName(unsafe.withColumn("error", F.lit("a name that leaves the folder")), allowMissingColumns=True)
    dst = F.when(F.col("error").isNull(), F.concat_ws("/", F.lit(target.rstrip("/")), "cluster_id", "name"))
    return out.select("cluster_id", "src", dst.alias("dst"), "bytes", "sha256", "error")
