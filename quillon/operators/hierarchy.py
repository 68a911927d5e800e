"""Collection trees, membership and its edits.

Trees are adjacency tables (collection_key, name, parent); items hold an array of collections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shelf import Shelf

c = F.col


class MissingRoot(ValueError):
    """The collection that a tree is to hang on isn't in the library."""


FEW = 50_000  # nodes of a tree that is followed as it is
STOP = 16  # of a larger one, a node in so many is a stop


def subtree(tree: DataFrame, root: str, few: int = FEW) -> DataFrame:
    """(collection_key, name, parent, depth) of a root and all below it; a root that isn't there is an error, a cycle away from it is left out.

    Every node points to its parent, then to what that points to: after k steps 2^k levels up, so a tree takes as many steps as the
    logarithm of its depth. The root points to itself. Each step is a join of the nodes with themselves, and is written. In a tree of more
    than `few` nodes each goes up to the next stop only (a node in STOP, by its hash, or the root), which takes most of them four or five
    steps whatever the depth; then the stops alone are followed to the root.
    """
    shelf = Shelf(tree.sparkSession, "subtree")
    nodes = shelf.put(tree.select("collection_key", "name", "parent"), "nodes")
    if nodes.where(c("collection_key") == root).isEmpty():
        raise MissingRoot(f"collection {root} is not in this library any more")
    is_root, n = c("collection_key") == root, nodes.count()
    ways = nodes.where(is_root | c("parent").isNotNull()).select("collection_key", F.when(is_root, root).otherwise(c("parent")).alias("up"), F.when(is_root, 0).otherwise(1).cast("long").alias("depth"))
    ways = shelf.put(ways, "ways")
    if n > few:
        ways = _followed(shelf, ways, lambda x: (c(x) == root) | (F.pmod(F.xxhash64(x), F.lit(STOP)) == 0), n, "near")
        stops = ways.where((c("collection_key") == root) | (F.pmod(F.xxhash64("collection_key"), F.lit(STOP)) == 0))
        far = _followed(shelf, shelf.put(stops, "stops"), lambda x: c(x) == root, n, "far").select(c("collection_key").alias("up"), c("depth").alias("more"))
        reached = ways.join(far, "up").select("collection_key", (c("depth") + c("more")).alias("depth"))
    else:
        reached = _followed(shelf, ways, lambda x: c(x) == root, n, "way").select("collection_key", "depth")
    return nodes.join(reached, "collection_key").select("collection_key", "name", "parent", c("depth").cast("int").alias("depth"))


def _followed(shelf: Shelf, ways: DataFrame, stop: Callable[[str], Column], n: int, name: str) -> DataFrame:
    """Ways (collection_key, up, depth) of at most n nodes followed by doubling until they point to a stop; what never comes to one is left out.

    Ways that have come to a stop aren't written again but every fourth step, so that few tables are read.
    """
    done, going = ways.where(stop("up")), ways.where(~stop("up"))
    for turn in range(n.bit_length() + 1):
        if going.isEmpty():
            break
        there = done.union(going).where(~stop("collection_key")).select(c("collection_key").alias("up"), c("up").alias("far"), c("depth").alias("more"))
        # A node whose parent is missing points nowhere and goes; one in a cycle never comes to a stop.
        ahead = shelf.put(going.join(there, "up").select("collection_key", c("far").alias("up"), (c("depth") + c("more")).alias("depth")), f"{name}{turn}")
        done, going = done.union(ahead.where(stop("up"))), ahead.where(~stop("up"))
        if turn % 4 == 3:
            done = shelf.put(done, f"{name}{turn}done")  # one table again
    return done


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their `place` in an order over the whole table, from 0: sorted by ranges, numbered inside each range, and shifted by the rows of the ranges before it."""
    shelf = Shelf(rows.sparkSession, "numbered")
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # The row's number inside its task; written, so that number and range are those of one run.
    marked = shelf.put(spread.withColumn("in_part", F.monotonically_increasing_id() - F.shiftleft(c("part").cast("long"), 33)), "marked")
    sizes = marked.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    shift = sizes.select("part", before.alias("before"))
    return marked.join(F.broadcast(shift), "part").withColumn("place", c("in_part") + c("before")).drop("part", "in_part", "before")


def order_of(tree: DataFrame) -> DataFrame:
    """A subtree with each node's place: breadth first, under parents in their order, siblings by name.

    Nodes of one depth stand in the order of the names on their paths from the root. Paths are ranked by doubling: from the rank of a
    node's last 2^k names and that of its 2^k-th ancestor comes the rank of its last 2^(k+1), so no path is ever spelled out.
    """
    shelf = Shelf(tree.sparkSession, "order")
    deepest = tree.agg(F.max("depth")).first()[0]
    ranked = numbered(tree.select("collection_key", "name", "parent", "depth"), "name", "collection_key")
    ways = shelf.put(ranked.select("collection_key", F.when(c("depth") > 0, c("parent")).alias("up"), c("place").alias("line")), "ways0")
    for turn in range((deepest or 0).bit_length()):
        there = ways.select(c("collection_key").alias("up"), c("up").alias("far"), c("line").alias("above"))
        pairs = ways.join(there, "up", "left").select("collection_key", c("far").alias("up"), F.coalesce("above", F.lit(-1)).alias("above"), "line")
        ways = shelf.put(numbered(pairs, "above", "line").select("collection_key", "up", c("place").alias("line")), f"ways{turn + 1}")
    return numbered(tree.join(ways.select("collection_key", "line"), "collection_key"), "depth", "line").drop("line")


def counts(items: DataFrame, tree: DataFrame) -> DataFrame:
    """Items per collection and library, with the collection's name and parent; items in several count in each."""
    held = items.select("library", F.explode("collections").alias("collection_key")).groupBy("library", "collection_key").agg(F.count("*").alias("items"))
    return held.join(tree, "collection_key", "left").select("library", "collection_key", "name", "parent", "items")


def tree_items(items: DataFrame, below: DataFrame) -> DataFrame:
    """Items of a subtree once each, with the least depth at which they stand."""
    rows = items.select("library", "item_key", F.explode("collections").alias("collection_key"))
    return rows.join(below.select("collection_key", "depth"), "collection_key").groupBy("library", "item_key").agg(F.min("depth").alias("depth"))


def in_binding(items: DataFrame, below: DataFrame) -> DataFrame:
    """Items with `inside`: whether any of their collections is in the subtree."""
    keys = tree_items(items, below).select("library", "item_key", F.lit(True).alias("hit"))
    return items.join(keys, ["library", "item_key"], "left").withColumn("inside", F.coalesce("hit", F.lit(False))).drop("hit")


def names_of(items: DataFrame, below: DataFrame) -> DataFrame:
    """Each item's collections inside the subtree, by name, in the order of its list."""
    rows = items.select("item_key", F.posexplode("collections").alias("at", "collection_key")).join(below.select("collection_key", "name"), "collection_key")
    return rows.groupBy("item_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))


def targets(requests: DataFrame, below: DataFrame) -> DataFrame:
    """Requests (request, wanted) to (collection_key, error): by key first, else by trimmed lower name; none or several are refused."""
    by_key = below.select(c("collection_key").alias("wanted"), c("collection_key").alias("key_hit"))
    by_name = below.groupBy(F.lower(F.trim("name")).alias("low")).agg(F.count("*").alias("n"), F.min("collection_key").alias("name_hit"))
    rows = requests.withColumn("wanted", F.trim("wanted")).withColumn("low", F.lower("wanted")).join(by_key, "wanted", "left").join(by_name, "low", "left")
    found = F.when(c("key_hit").isNotNull(), c("key_hit")).when(c("n") == 1, c("name_hit"))
    error = F.when(found.isNotNull(), F.lit(None)).when(c("n") > 1, "several of that name").otherwise("none of that name")
    return rows.select("request", found.alias("collection_key"), error.alias("error"))


def edited(collections: Column, target: Column, root: Column, move: Column) -> Column:
    """Membership after filing into `target`, and, when moving, leaving `root`."""
    added = F.when(F.array_contains(collections, target), collections).otherwise(F.array_append(collections, target))
    return F.when(move & (target != root), F.filter(added, lambda x: x != root)).otherwise(added)


def file_items(requests: DataFrame, items: DataFrame, below: DataFrame, root: str) -> DataFrame:
    """Requests (item_key, target, move, version) to (item_key, outcome, collections).

    refused: unknown item, or in no collection of the subtree; unchanged: nothing to do; failed: the item has moved on since
    `version`; filed otherwise. A move into the root itself is refused.
    """
    held = in_binding(items, below).select("item_key", "collections", c("version").alias("current"), "inside")
    rows = requests.join(held, "item_key", "left")
    after = edited(c("collections"), c("target"), F.lit(root), c("move"))
    outcome = (
        F.when(c("move") & (c("target") == root), "refused").when(c("inside").isNull() | ~c("inside"), "refused")
        .when(after == c("collections"), "unchanged").when(c("version") != c("current"), "failed").otherwise("filed")
    )
    out = rows.withColumn("outcome", outcome)
    return out.select("item_key", "outcome", F.when(c("outcome") == "filed", after).otherwise(c("collections")).alias("collections"))


def filing(present: DataFrame, below: DataFrame, deposit: str, target: Column, file_present: Column, key: str = "item_key") -> DataFrame:
    """What happens to an item that is already there when a plan targets a collection: `filing` is other-leg, already, file or left.

    `held_in` names the item's collections inside the target's tree, in the order of its list; those elsewhere don't count. `key` names a row.
    """
    rows = present.withColumn("target", target).withColumn("wanted", file_present)
    inside = rows.select(key, F.posexplode("collections").alias("at", "collection_key")).join(below.select("collection_key", "name"), "collection_key")
    inside = inside.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "name", "collection_key"))).alias("held"))
    rows = rows.join(inside, key, "left")
    names, keys = (F.coalesce(F.transform("held", lambda x: x[i]), F.array().cast("array<string>")) for i in ("name", "collection_key"))
    own = c("library") == deposit
    told = F.when(~own, "other-leg").when(F.array_contains(keys, c("target")), "already").when(c("wanted"), "file").otherwise("left")
    return rows.withColumn("filing", told).withColumn("held_in", F.when(own, names)).drop("target", "wanted", "held")
