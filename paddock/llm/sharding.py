"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A document descends it: on every level each child draws
-ln(u) / weight, where u in (0, 1) is a hash of document and child, and the smallest draw wins. A child
is chosen with a probability in proportion to its weight, and a changed weight moves documents only to
or from the subtree whose weight has changed. Everything is a column expression over a tree of a few
nodes, so assigning needs no shuffle.

Rows: a null id counts as the empty string, a null text has no bytes (size 1, checksum 0). Repeated rows
get the same shard and each a slot of their own. An empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows that one task numbers at once, in the mean
PIECE = 50_000


@dataclass(frozen=True)
class Node:
    """A shard if it has no children; the weight of an inner node is the sum of its children's."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, racks: int = 2, per_rack: int = 2, base: int = 8, weights: dict[int, float] | None = None) -> Node:
    """The first `base` shards fill racks and regions in order; each later one opens a region of its own,
    so that a growing count takes documents only into the new shard."""

    def leaf(s: int) -> Node:
        return Node(f"shard{s}", own_weight=(weights or {}).get(s, 1.0), shard=s)

    regions = []
    first = list(range(min(shards, base)))
    size = racks * per_rack
    for r in range(0, len(first), size):
        own = first[r : r + size]
        inside = tuple(Node(f"rack{own[k] // per_rack}", tuple(map(leaf, own[k : k + per_rack]))) for k in range(0, len(own), per_rack))
        regions.append(Node(f"region{r // size}", inside))
    regions += [Node(f"region+{s}", (Node(f"rack+{s}", (leaf(s),)),)) for s in range(base, shards)]
    return Node("root", tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight, u from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node.name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(node.weight)


def shard_of(key: Column, node: Node) -> Column:
    """The shard that the descent from `node` reaches."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])
    best = F.array_min(draws)["i"]
    out = shard_of(key, live[-1])
    for i, child in reversed(list(enumerate(live[:-1]))):
        out = F.when(best == i, shard_of(key, child)).otherwise(out)
    return out


def assign(docs: DataFrame, root: Node, id_col: str = "doc_id", into: str = "shard") -> DataFrame:
    return docs.withColumn(into, shard_of(F.coalesce(F.col(id_col).cast("string"), F.lit("")), root).cast("int"))


def numbered(rows: DataFrame, rows_expected: int, id_col: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds `slot`, gapless from 0 in every shard, in the order of a digest of the id. Pieces of the digest's
    range are numbered apart and shifted by the sizes of the pieces before."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|slot")))
    pieces = max(16, rows_expected // PIECE)
    keyed = rows.withColumn("_digest", digest)
    keyed = keyed.withColumn("_piece", F.floor(F.conv(F.substring("_digest", 1, 12), 16, 10).cast("double") / F.lit(float(2**48)) * pieces).cast("int"))
    sizes = keyed.groupBy("shard", "_piece").count()
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_piece").orderBy("_digest", id_col, *ties)
    out = keyed.withColumn("_rank", F.row_number().over(inside)).join(sizes, ["shard", "_piece"])
    return out.withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_digest", "_piece", "_before", "_rank")


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document under the law `key`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    out = assign(assign(narrow, tree(shards)), tree(shards + 1), into="grown_shard")
    out = numbered(out, narrow.select("doc_id").count(), ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
