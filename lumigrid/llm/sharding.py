"""Sharding by a hierarchical weighted hash tree, from DataFrame functions only.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight with u a hash of the key and the
child's name, and the least draw wins, so a child gets keys in proportion to its weight. A changed weight moves keys
only between that child and its siblings: movement stays in the subtrees whose weights change. grow() opens a region
of its own for a new shard, so the keys that move all move into that shard.

Defined results: a null text has 0 bytes; a null id is a key like any other; repeated rows share a shard and have slots
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import common

SHARDS, RACK, REGION = 40, 4, 20
OVERHEAD = 16


@dataclass(frozen=True)
class Tree:
    """Weights by shard; paths (region, rack) by shard. A node's weight is the sum of its shards' weights."""

    weights: dict[int, float] = field(default_factory=dict)
    paths: dict[int, tuple[int, int]] = field(default_factory=dict)

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own."""
        new, path = max(self.weights) + 1, (max(p[0] for p in self.paths.values()) + 1, max(p[1] for p in self.paths.values()) + 1)
        return Tree(self.weights | {new: weight}, self.paths | {new: path})

    def reweigh(self, shard: int, weight: float) -> Tree:
        return Tree(self.weights | {shard: weight}, self.paths)

    def children(self, level: int) -> dict[int, dict[int, float]]:
        """Children and their weights by parent: regions (of the root, 0), racks of a region, shards of a rack."""
        out: dict[int, dict[int, float]] = {}
        for shard, w in self.weights.items():
            region, rack = self.paths[shard]
            parent, child = ((0, region), (region, rack), (rack, shard))[level]
            kids = out.setdefault(parent, {})
            kids[child] = kids.get(child, 0.0) + w
        return out


def tree(shards: int = SHARDS, rack: int = RACK, region: int = REGION) -> Tree:
    """Equal shards, `rack` of them in a rack and `region` in a region."""
    return Tree({s: 1.0 for s in range(shards)}, {s: (s // region, s // rack) for s in range(shards)})


def place(key: Column, t: Tree, seed: int = 17) -> Column:
    """The shard of a key: three weighted draws, one at each level."""
    at: Column = F.lit(0)
    for level in range(3):
        options = F.create_map(*[x for parent, kids in sorted(t.children(level).items()) for x in (F.lit(parent), F.array(*[F.struct(F.lit(c).alias("child"), F.lit(w).alias("weight")) for c, w in sorted(kids.items()) if w > 0]))])
        at = F.array_min(F.transform(F.element_at(options, at), _drawer(key, seed + level)))["child"]
    return at.cast("int")


def _drawer(key: Column, seed: int):
    def draw(x: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, x["child"]), 11).cast("double") + 0.5) / float(2**53)
        return F.struct((-F.log(u) / x["weight"]).alias("draw"), x["child"].alias("child"))

    return draw


def shard(docs: DataFrame, t: Tree | None = None, seed: int = 17) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = t or tree()
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.col("doc_id").cast("long")
    sized = docs.select(key.alias("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    put = sized.withColumn("shard", place(F.col("doc_id"), t, seed)).withColumn("grown_shard", place(F.col("doc_id"), t.grow(), seed))
    ranked = common.gapless_rank(put, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
