"""Image files: binary sources, decoding, standardising, and feature extraction in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.functions import extractors as X
from lumigrid.functions import names
from lumigrid.sources import asking

#: Images handled together: a decoded image is large, so batches are short.
BATCH = 32
#: Fixed value: height and width of a stored upload.
STANDARD = (2160, 3840)


def files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, relative, file_name, length, content) of image files; suffixes in any case; recursive: sub-folders too."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"  # as path begins
    relative = F.when(F.startswith("path", F.lit(root)), F.substring("path", F.lit(len(root) + 1), F.length("path"))).otherwise(names.basename(F.col("path")))
    return df.where(names.is_image(F.col("path"), names.IMPORTED)).select("path", relative.alias("relative"), names.basename(F.col("path")).alias("file_name"), "length", "content")


def decoded(spark: SparkSession, folder: str, drop_invalid: bool = True) -> DataFrame:
    """(origin, height, width, data): blue, green, red bytes by the JVM's decoders (png, jpeg, bmp, gif; no webp).
    Files that don't decode are dropped, or have a height of -1."""
    df = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(folder)
    return df.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def array_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Height x width x 3 bytes in blue, green, red order."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def extracted(images: DataFrame, features: tuple[str, ...] = tuple(X.EXTRACTORS), scale: int = 6) -> DataFrame:
    """(origin, <feature> ..., error) and any other columns of images: features of decoded images, each image reduced to
    1 / scale of its sides first.

    Only the named extractors run. A failing image has its error and null features; the others go on."""
    fields = [T.StructField("origin", T.StringType())] + [T.StructField(f, T.ArrayType(T.FloatType())) for f in features] + [T.StructField("error", T.StringType())]
    others = [f for f in images.schema.fields if f.name not in ("origin", "height", "width", "channels", "data", "mode")]
    fields += others

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                row = {"origin": r.origin, "error": None} | dict.fromkeys(features) | {f.name: getattr(r, f.name) for f in others}
                try:
                    img = array_of(r.height, r.width, r.channels, r.data)
                    small = X.resized(img, max(1, img.shape[0] // scale), max(1, img.shape[1] // scale))
                    row |= {f: [float(x) for x in np.atleast_1d(X.EXTRACTORS[f](small))] for f in features}
                except Exception as e:  # one bad image must not end the job
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=[f.name for f in fields])

    return images.mapInPandas(run, T.StructType(fields))


def standardized(images: DataFrame, height: int = 2160, width: int = 3840) -> DataFrame:
    """(origin, height, width, channels, data): cropped to the middle at the target's ratio (within 0.01) and resized."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                out = X.standardized(array_of(r.height, r.width, r.channels, r.data), height, width)
                yield pd.DataFrame({"origin": [r.origin], "height": [out.shape[0]], "width": [out.shape[1]], "channels": [3], "data": [out.tobytes()]})

    return images.mapInPandas(run, "origin string, height int, width int, channels int, data binary")


def analysed(images: DataFrame, provider: Callable[[list[str]], list[dict]], batch: int = BATCH, concurrency: int = asking.CONCURRENCY, timeout: float = asking.TIMEOUT, attempts: int = 2) -> DataFrame:
    """(file_name, category, description, entities, error) from a provider that takes file names: requests of `batch` names,
    many at a time, each within `timeout` seconds. The names of a request that fails are asked one by one; what fails alone
    has the sentinels of an unknown analysis, with the error."""
    columns = ["file_name", "category", "description", "entities", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ask(names_: list[str]) -> list[dict]:
            said = list(provider(names_))
            if len(said) != len(names_):
                raise ValueError(f"{len(said)} answers to {len(names_)} files")
            return said

        for b in batches:
            requests = [list(b["file_name"].iloc[at : at + batch]) for at in range(0, len(b), batch)]
            first = asking.answers(ask, requests, concurrency, timeout, 1 if batch > 1 else attempts)
            got = {i: said for i, (said, error) in enumerate(first) if error is None}
            again = [(i, n) for i, (_, error) in enumerate(first) if error is not None for n in requests[i]]
            alone = iter(asking.answers(ask, [[n] for _, n in again], concurrency, timeout, attempts) if batch > 1 else [first[i] for i, _ in again])
            rows = []
            for i, names_ in enumerate(requests):
                for k, name in enumerate(names_):
                    said, error = (got[i][k : k + 1], None) if i in got else next(alone)
                    rows.append({"file_name": name, "error": None} | said[0] if error is None else {"file_name": name, "category": "Error", "description": "Error", "entities": [], "error": str(error)})
            yield pd.DataFrame(rows, columns=columns)

    return images.select("file_name").mapInPandas(run, "file_name string, category string, description string, entities array<string>, error string")


def offline_provider(files_: list[str]) -> list[dict]:
    return [{"category": "Unknown", "description": None, "entities": []} for _ in files_]
