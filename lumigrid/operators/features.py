"""A store of features: blocks of rows, packed once, a folder for each feature, that all trials and searches of weights read.

Building reads the source once. Each task packs a block of rows, feature by feature, and a feature that fails in any block
(a missing column, vectors of unlike lengths, a wrong type) is reported and left out; the others are kept. A build is a
commit of a new version; readers keep the version they opened, a feature can be added later, and its blocks have to be of
the same rows. Only the folders of the features asked for are read.

Defined results: an empty table has no blocks; null values are packed as the products of blocks define them; rows with a
null id are left out, since a row is known by its id; of repeated ids each row counts; clashing or extra columns are
never read.
"""

from __future__ import annotations

import json
import logging
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumigrid.functions import names as N
from lumigrid.operators import products
from lumigrid.sources import shared
from lumigrid.sources.snapshots import ConflictError, Manifest, Snapshots

log = logging.getLogger(__name__)

ROWS = "__rows"
BLOCK = "block int, feature string, rows long, ids long, width int, payload binary, error string"
NUMBERS = (T.NumericType, T.BooleanType)


def label_columns() -> dict[str, Column]:
    """What every block holds besides features: the label's hash and whether there is one."""
    return {"label": F.coalesce(F.xxhash64("label"), F.lit(0)), "known": F.col("label").isNotNull()}


def fits(kind: T.DataType, metric: str) -> bool:
    """Whether a column of this type can have the metric."""
    if metric in ("scalar", "sharpness"):
        return isinstance(kind, NUMBERS)
    if metric == "category":
        return isinstance(kind, T.StringType)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else None
    return isinstance(inner, T.StringType) if metric == "entity" else isinstance(inner, NUMBERS)


def planned(stored: DataFrame, features: dict[str, tuple[str, str]]) -> tuple[dict[str, Column], dict[str, str]]:
    """Columns of the features that stored has with a fitting type, by packed name, and the errors of the others."""
    good, errors = {}, {}
    for name, (column, metric) in features.items():
        if not name.isidentifier() or name == ROWS:
            raise ValueError(f"{name!r} can't name a folder")
        try:
            kind = stored.select(F.col(column)).schema[0].dataType
        except AnalysisException as e:
            errors[name] = str(e).split("\n")[0]
            continue
        if fits(kind, metric):
            good |= products.columns_of({name: (column, metric)})
        else:
            errors[name] = f"{metric} of {column}, a {kind.simpleString()}"
    return good, errors


def packed(stored: DataFrame, columns: dict[str, Column], n: int) -> DataFrame:
    """BLOCK: each block's rows (sorted by id) feature by feature, and as ROWS their ids and labels."""
    labels = label_columns()
    rows = stored.where("id is not null").select(F.col("id").cast("long").alias("id"), *[c.alias(x) for x, c in (columns | labels).items()])

    names, own_names = list(columns), list(labels)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        block, ids = int(pdf["block"].iloc[0]), pdf["id"].to_numpy()
        crc = zlib.crc32(ids.astype("<i8").tobytes())
        own = {"id": ids} | {k: v for x in own_names for k, v in products.arrays_of(x, pdf[x]).items()}
        out = [(block, ROWS, len(ids), crc, 0, products.saved(own), None)]
        for name in names:
            try:
                arrays = products.arrays_of(name, pdf[name])
                width = arrays[name].shape[1] if arrays[name].ndim > 1 else 0
                out.append((block, name.lstrip("*"), len(ids), crc, width, products.saved(arrays), None))
            except (ValueError, TypeError) as e:
                out.append((block, name.lstrip("*"), len(ids), crc, 0, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=[x.split()[0] for x in BLOCK.split(", ")])

    return products.dealt(rows, n).groupBy("block").applyInPandas(pack, BLOCK)


def pieces(arrays: products.Arrays, parts: int) -> list[products.Arrays]:
    """A block cut into so many blocks of consecutive rows."""
    ends = np.linspace(0, len(arrays["id"]), parts + 1).astype(int)
    out = []
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        cut = {}
        for name, x in arrays.items():
            if name.startswith("*") and not name.endswith("?size"):
                at = np.concatenate([[0], np.cumsum(arrays[f"{name}?size"])])
                cut[name] = x[at[a] : at[z]]
            else:
                cut[name] = x[a:z]
        out.append(cut)
    return out


class FeatureStore:
    """The features of one version of the store at `path`, the newest when it was opened."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.table = spark, Snapshots(spark, path)
        known = self.table.versions()
        self.version = version if version is not None else known[-1] if known else None
        self.said = json.loads(self.table.manifest(self.version).note) if self.version is not None else {"folders": {}, "errors": {}, "n": 0, "size": products.SIZE}

    @classmethod
    def temporary(cls, stored: DataFrame, features: dict[str, tuple[str, str]], size: int = products.SIZE) -> FeatureStore:
        """A store of its own in the folder that driver and executors share."""
        spark = stored.sparkSession
        return cls(spark, f"{shared.folder(spark)}/lumigrid/features-{uuid.uuid4().hex}").build(stored, features, size)

    def features(self) -> list[str]:
        return [n for n in self.said["folders"] if n != ROWS]

    def errors(self) -> dict[str, str]:
        """What has been left out, and why."""
        return dict(self.said["errors"])

    def build(self, stored: DataFrame, features: dict[str, tuple[str, str]], size: int = products.SIZE, listing: DataFrame | None = None) -> FeatureStore:
        """Commits a version with these features of stored (id, label, the features' columns) alone, of the rows whose file's
        base name is in listing (file_name), if there is one; gives the store at that version."""
        if listing is not None:
            wanted = listing.select(N.basename(F.col("file_name")).alias("__name")).distinct()
            stored = stored.join(wanted, N.basename(F.col("file_name")) == F.col("__name"), "left_semi")
        n = products.count_of(stored.where("id is not null").count(), size)
        folders, errors = self._packed(stored, features, n)
        return self._commit({"folders": folders, "errors": errors, "n": n, "size": size}, "build")

    def add(self, stored: DataFrame, features: dict[str, tuple[str, str]]) -> FeatureStore:
        """Commits a version with these features besides (or instead of) those that are there; their rows must be the same."""
        if self.version is None:
            raise ValueError("build the store first")
        folders, errors = self._packed(stored, features, self.said["n"])
        rows = lambda folder: self.spark.read.schema(BLOCK).parquet(f"{self.table.path}/{folder}").select("block", "ids")
        old, new = rows(self.said["folders"][ROWS]), rows(folders.pop(ROWS))
        if old.exceptAll(new).unionAll(new.exceptAll(old)).head(1):  # a row for each block
            raise ValueError("the rows have changed since the store was built: build it anew")
        left = {k: v for k, v in self.said["errors"].items() if k not in features}
        kept = {k: v for k, v in self.said["folders"].items() if k not in features}
        return self._commit(self.said | {"folders": kept | folders, "errors": left | errors}, "add")

    def _packed(self, stored: DataFrame, features: dict[str, tuple[str, str]], n: int) -> tuple[dict[str, str], dict[str, str]]:
        columns, errors = planned(stored, features)
        at = f"rows/{uuid.uuid4().hex}"
        packed(stored, columns, n).withColumn("__feature", F.col("feature")).write.partitionBy("__feature").parquet(f"{self.table.path}/{at}")
        folders = {}
        written = self.spark.read.schema(BLOCK).parquet(f"{self.table.path}/{at}")
        found = written.groupBy("feature").agg(F.min("error").alias("error"), F.collect_set(F.when(F.col("width") > 0, F.col("width"))).alias("widths"))
        got = {r["feature"]: r for r in found.collect()}  # a row for each feature
        for name in [ROWS, *(c.lstrip("*") for c in columns)]:
            r = got.get(name)
            error = None if r is None else r["error"] or (f"vectors of {len(r['widths'])} lengths" if len(r["widths"]) > 1 else None)
            if error:
                errors[name] = error
            else:
                folders[name] = f"{at}/__feature={name}" if r is not None else ""
        for name, error in errors.items():
            log.warning("feature %s is left out: %s", name, error)
        return folders, errors

    def _commit(self, said: dict, what: str) -> FeatureStore:
        version = 0 if self.version is None else self.version + 1
        new = Manifest(version, "", sorted({f.rsplit("/", 1)[0] for f in said["folders"].values() if f}), {}, json.dumps(said | {"what": what}))
        if not self.table._put(f"versions/{version:012d}.json", json.dumps(new.__dict__)):
            raise ConflictError(f"version {version} is taken")
        return FeatureStore(self.spark, self.table.path, version)

    def blocks(self, features: list[str], size: int | None = None) -> tuple[DataFrame, int]:
        """(block, payload) with ids, labels and these features, as products.met takes them, and the number of blocks; blocks
        are cut where they are to be smaller than they were built."""
        missing = [f for f in features if f not in self.said["folders"]]
        if missing:
            raise KeyError(f"not in the store: {missing}")
        n, parts = self.said["n"], max(1, -(-self.said["size"] // (size or self.said["size"])))
        folders = [f for f in (self.said["folders"][x] for x in [ROWS, *dict.fromkeys(features)]) if f]
        if not folders:
            return self.spark.createDataFrame([], "block int, payload binary"), n * parts
        # each folder on its own: they are of several builds, and no other folder is listed
        each = [self.spark.read.schema(BLOCK).parquet(f"{self.table.path}/{f}").select("block", "ids", "payload") for f in folders]
        whole = each[0]
        for one in each[1:]:
            whole = whole.unionAll(one)

        def merged(pdf: pd.DataFrame) -> pd.DataFrame:
            block = int(pdf["block"].iloc[0])
            if len(pdf) != len(folders) or pdf["ids"].nunique() > 1:
                raise ValueError(f"block {block} isn't of the same rows in all features")
            arrays: products.Arrays = {}
            for payload in pdf["payload"]:
                arrays |= products.loaded(payload)
            cut = [(block * parts + i, x) for i, x in enumerate(pieces(arrays, parts)) if len(x["id"])]
            return pd.DataFrame({"block": [i for i, _ in cut], "payload": [products.saved(x) for _, x in cut]})

        return whole.groupBy("block").applyInPandas(merged, "block int, payload binary"), n * parts

    def numbers(self, size: int | None = None) -> DataFrame:
        """(block) of blocks(): those that may hold rows."""
        parts, folder = max(1, -(-self.said["size"] // (size or self.said["size"]))), self.said["folders"].get(ROWS)
        if not folder:
            return self.spark.createDataFrame([], "block int")
        kept = self.spark.read.schema(BLOCK).parquet(f"{self.table.path}/{folder}")
        return kept.select(F.explode(F.sequence(F.col("block") * parts, F.col("block") * parts + parts - 1)).alias("block"))

    def count(self) -> int:
        """How many rows the blocks hold."""
        folder = self.said["folders"].get(ROWS)
        if not folder:
            return 0
        return self.spark.read.schema(BLOCK).parquet(f"{self.table.path}/{folder}").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
