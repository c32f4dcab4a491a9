"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws -ln(u) / weight, where a hash of the row's
key and the child's name gives u, and the smallest draw wins.  A draw depends only on the child itself, so a changed
weight moves rows only into or out of the subtree whose weight changed; the draws elsewhere stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, unit_hash

#: Rows of one shard are numbered within so many parts, then the parts are laid end to end.
PARTS = 256
#: Shards of the first plan.
PLANNED = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, planned: int = PLANNED) -> list[Leaf]:
    """Regions of two racks of two shards for the planned shards; each shard beyond them opens a region of its own.

    As a new region's weight is only that of its one shard, a grown tree moves rows only into the new shard.  A tree
    of fewer shards than planned would not grow so: a shard that joins a planned rack adds weight above it, and rows
    drawn to that rack may end beside it.  Such counts are an error; plan with as many shards as there are at first.
    """
    if not 0 < planned <= shards:
        raise ValueError(f"{shards} shards are fewer than the {planned} planned ones")
    return [Leaf(s // 4 if s < planned else -(-planned // 4) + s - planned, s // 2 % 2 if s < planned else 0, s) for s in range(shards)]


def _winner(key: Column, level: str, children: dict[int, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct((-F.log(unit_hash(key, F.lit(f"{level}/{name}"))) / weight).alias("draw"), F.lit(name).alias("name")) for name, weight in sorted(children.items())]
    return F.array_min(F.array(*draws))["name"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that the key's descent ends in."""
    if not leaves:
        raise ValueError("a tree needs at least one shard")

    def total(some: list[Leaf], level: str) -> dict[int, float]:
        out: dict[int, float] = {}
        for leaf in some:
            out[getattr(leaf, level)] = out.get(getattr(leaf, level), 0.0) + leaf.weight
        return out

    def choose(winner: Column, branches: dict[int, Column]) -> Column:
        (first, column), *rest = sorted(branches.items())
        if not rest:
            return column
        case = F.when(winner == first, column)
        for name, column in rest:
            case = case.when(winner == name, column)
        return case

    regions = {}
    for region in {leaf.region for leaf in leaves}:
        of_region = [leaf for leaf in leaves if leaf.region == region]
        racks = {}
        for rack in {leaf.rack for leaf in of_region}:
            of_rack = [leaf for leaf in of_region if leaf.rack == rack]
            racks[rack] = _winner(key, f"{region}/{rack}", total(of_rack, "shard"))
        regions[region] = choose(_winner(key, f"{region}", total(of_region, "rack")), racks)
    return choose(_winner(key, "", total(leaves, "region")), regions)


def assign_shards(docs: DataFrame, shards: int = PLANNED, planned: int = PLANNED) -> DataFrame:
    """Adds shard, grown_shard, size, text_crc32 and a gapless slot within the shard to (doc_id, text).

    doc_id, the number of shards and that of the first plan, which never changes, alone decide the shard; a null doc_id is a key like any other.  Slots count up
    from 0 in each shard by (part, doc_id, text_crc32, size), so reruns agree; rows equal in all three are
    interchangeable.  A null text counts as empty; an empty table gives an empty result.  Other columns are dropped.
    """
    key = F.col("doc_id").cast("string")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc32_of(F.col("text")).alias("text_crc32"),
        shard_of(key, layout(shards, planned)).cast("int").alias("shard"),
        shard_of(key, layout(shards + 1, planned)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.col("text"), F.lit("part")), F.lit(PARTS)).cast("int").alias("part"),
    )
    # At most (shards x PARTS) rows: small whatever the input.
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("within", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    return numbered.join(F.broadcast(before), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard")
