"""Sharding by a hierarchical weighted hash tree (JVM expressions only).

A topology is a tree region > rack > shard with a weight on every shard; a node's
weight is the sum of its shards'. A key descends the tree: at each level every
child draws ``-ln(u) / weight`` with ``u`` a hash of (key, child), and the smallest
draw wins. A child is then taken in proportion to its weight, and a draw depends on
nothing but the key, the child and the child's weight. So when weights change, a key
moves only if it enters a node whose weight grew or leaves one whose weight fell;
inside untouched nodes every key keeps its place.

A new shard opens a region of its own, so growing by one takes rows only into the
new shard, at any shard count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomline.llm.common import durable


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def even_topology(shards: int = 8, racks_per_region: int = 2, shards_per_rack: int = 2) -> tuple[Shard, ...]:
    """Shards 0..n-1 of weight 1, filled rack by rack and region by region."""
    per_region = racks_per_region * shards_per_rack
    return tuple(Shard(i, f"region{i // per_region}", f"rack{i // shards_per_rack}") for i in range(shards))


def with_new_shard(topology: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """The topology with one more shard, in a new region: no older node's weight changes."""
    new = max(s.shard for s in topology) + 1
    return (*topology, Shard(new, f"region-of-{new}", f"rack-of-{new}", weight))


def _draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of rate ``weight``: 53 hash bits make u in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The result of the child with the smallest draw; equal draws go to the first name."""
    children = sorted((c for c in children if c[1] > 0), key=lambda c: c[0])
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(i).alias("i")) for i, (n, w, _) in enumerate(children)])
    best = F.array_min(draws)["i"]
    out = F.when(best == 0, children[0][2])
    for i, (_, _, result) in enumerate(children[1:], 1):
        out = out.when(best == i, result)
    return out


def place(key: Column, topology: tuple[Shard, ...]) -> Column:
    """The shard of ``key`` (any type that hashes; null is a key of its own)."""
    def level(shards, names):
        if not names:
            return F.lit(shards[0].shard)
        groups: dict[str, list[Shard]] = {}
        for s in shards:
            groups.setdefault(names[0](s), []).append(s)
        return _choose(key, [(n, sum(s.weight for s in g), level(g, names[1:])) for n, g in groups.items()])

    return level(list(topology), [lambda s: s.region, lambda s: f"{s.region}/{s.rack}", lambda s: f"{s.region}/{s.rack}/{s.shard}"])


def number_slots(df: DataFrame, order: list[str], buckets: int = 4096, broadcast_rows: int = 1 << 20) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... within each ``shard``, without gaps.

    A shard may hold any share of the rows, so it is numbered in ``buckets`` hash
    buckets: counts per (shard, bucket) give each bucket's first slot, a window ranks
    the rows inside a bucket. ``order`` must tell all rows apart. The first slots are
    broadcast where there can be no more than ``broadcast_rows`` of them.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "shard", "_bucket",
        (F.sum("_n").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_first"),
    )
    few = counts.limit(broadcast_rows + 1).count() <= broadcast_rows
    rank = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy(*order)) - 1
    return (
        df.withColumn("_rank", rank)
        .join(F.broadcast(offsets) if few else offsets, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_first") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_first")
    )


def shard_documents(docs: DataFrame, topology: tuple[Shard, ...] = even_topology()) -> DataFrame:
    """Places every document by its ``doc_id``.

    Law ``key``: the id and the topology decide, nothing else. Returns doc_id, size
    (UTF-8 bytes + 1), text_crc32, shard, slot, grown_shard (with one more shard).
    Repeated ids share a shard and get slots of their own, in order of text; repeated
    rows are told apart by a row number, so they spread over the slot buckets too. A
    null id is one key, a null text has no bytes (crc32 0). Only narrow columns are
    written and shuffled. Columns of other names are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = narrow.withColumn("shard", place(F.col("doc_id"), topology)).withColumn(
        "grown_shard", place(F.col("doc_id"), with_new_shard(topology))
    )
    return number_slots(durable(placed, "placed"), ["doc_id", "text_crc32", "row"]).drop("row")
