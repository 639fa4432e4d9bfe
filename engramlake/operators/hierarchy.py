"""Parent-child links to full hierarchies, by bottom-up leaf peeling.

Leaves send their lists of descendants and the size of their subtree to their parent and are peeled
off; what never becomes a leaf lies on a circle. In reverse order of peeling each node then takes root,
depth and path from its parent.

Nodes are first dealt to tasks by the top of their tree (pointer doubling, so a chain of n links takes
log n jobs), and every task peels its trees one after the other. A tree of more than ``residual_rows``
nodes would be too much for a task: such trees, and what lies on circles or leads into them, are peeled
in rounds over all tasks, one level a round, until no more than ``residual_rows`` nodes are left. Both
ways peel alike and give the same rows.

Defined results:
* ids are compared without regard to letter case and come out as stored;
* a null, empty or unknown parent makes the node a root (depth 0, path [id]);
* a node on a circle or leading into one has depth -1, no path, and as root the
  smallest id on that circle; a node that names itself is a circle of one;
* the successors of a node on a circle are the rest of the circle and what leads into
  it, those of a node below a circle the tree below it; no node is its own successor;
* rows with a null or empty id are no nodes; of rows that repeat an id the smallest
  (id, parent) counts, null parents first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from engramlake.runtime import cut, tasks_for

#: Nodes that one task peels at once (some 50 MB); a constant, whatever the input's size.
RESIDUAL_ROWS = 200_000
#: Path entries, or descendants, in one batch that a task puts out.
BATCH = 200_000

#: Within peeling a path below a circle starts at the node of the circle; turn is how many links that node is below the circle's smallest id.
PLACED = "key string, id string, parent string, size bigint, root string, depth bigint, path array<string>, on_circle boolean, turn bigint"


def nodes_of(records: DataFrame, id_col: str = "id", parent_col: str = "supersedes") -> DataFrame:
    """One row per id: key, id, parent (keys are lower-cased ids)."""
    return (
        records.select(F.col(id_col).cast("string").alias("id"), F.lower(F.col(parent_col).cast("string")).alias("parent"))
        .where("id is not null and id <> ''")
        .groupBy(F.lower("id").alias("key"))
        .agg(F.min(F.struct("id", "parent")).alias("row"))
        .select("key", "row.id", F.expr("nullif(row.parent, '')").alias("parent"))
    )


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes that have a parent or a child; the parent of a root is null."""
    links = nodes.alias("c").where("parent is not null").join(nodes.alias("p"), F.expr("c.parent = p.key")).select(
        F.col("c.key").alias("key"), F.col("c.id").alias("id"), F.col("p.key").alias("parent"), F.col("p.id").alias("parent_id")
    )
    both = F.explode(
        F.array(
            F.struct("key", "id", "parent"),
            F.struct(F.col("parent").alias("key"), F.col("parent_id").alias("id"), F.lit(None).cast("string").alias("parent")),
        )
    )
    return (
        links.select(both.alias("n"))
        .groupBy(F.col("n.key").alias("key"))
        .agg(F.max("n.id").alias("id"), F.max("n.parent").alias("parent"))
        .withColumn("size", F.lit(1).cast("bigint"))
    )


def _round(alive: DataFrame, leaves: DataFrame | None) -> DataFrame:
    """alive with the sizes that leaves send added, and whether each row is a leaf now."""
    none = F.lit(None).cast("string")
    sent = alive.where("parent is not null").select(
        F.col("parent").alias("key"), none.alias("id"), none.alias("parent"), F.lit(0).cast("bigint").alias("size"), F.lit(1).alias("kid")
    )
    rows = alive.select("key", "id", "parent", "size", F.lit(0).alias("kid")).unionByName(sent)
    if leaves is not None:
        rows = rows.unionByName(
            leaves.where("parent is not null").select(F.col("parent").alias("key"), none.alias("id"), none.alias("parent"), "size", F.lit(0).alias("kid"))
        )
    return (
        rows.groupBy("key")
        .agg(F.max("id").alias("id"), F.max("parent").alias("parent"), F.sum("size").alias("size"), (F.max("kid") == 0).alias("leaf"))
        .where("id is not null")
    )


class Peeled:
    """A forest within one task: order of peeling, sizes, and places in reverse order."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.key, self.ids, self.size = list(rows["key"]), dict(zip(rows["key"], rows["id"])), dict(zip(rows["key"], map(int, rows["size"])))
        self.parent = parent = {k: p for k, p in zip(rows["key"], rows["parent"]) if isinstance(p, str)}
        kids = dict.fromkeys(self.key, 0)
        for p in parent.values():
            kids[p] += 1
        self.order = [k for k in self.key if not kids[k]]
        for k in self.order:  # grows while it is read
            if (p := parent.get(k)) is not None:
                self.size[p] += self.size[k]
                kids[p] -= 1
                if not kids[p]:
                    self.order.append(p)
        done = set(self.order)
        self.rings: list[list[str]] = []
        self.place: dict[str, tuple] = {}  # root, depth, on a circle, links from the circle's node up to the root
        self.level: dict[str, int] = {}  # links up to the root, or to the circle
        for k in self.key:
            if k not in done and k not in self.place:
                ring = [k]
                while (n := parent[ring[-1]]) != k:
                    ring.append(n)
                at = min(range(len(ring)), key=lambda n: self.ids[ring[n]])
                self.place |= {x: (self.ids[ring[at]], -1, True, (at - n) % len(ring)) for n, x in enumerate(ring)}
                self.level |= dict.fromkeys(ring, 0)
                self.rings.append(ring)
        for k in reversed(self.order):
            if (p := parent.get(k)) is None:
                self.place[k], self.level[k] = (self.ids[k], 0, False, None), 0
            else:
                root, depth, _, turn = self.place[p]
                self.place[k], self.level[k] = (root, depth + 1 if depth >= 0 else -1, False, turn), self.level[p] + 1

    def path(self, k: str) -> list[str]:
        """From the root, or from the circle's node, down to k."""
        out = [k]
        for _ in range(self.level[k]):
            out.append(self.parent[out[-1]])
        return [self.ids[x] for x in reversed(out)]

    def placed(self, paths: bool) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for n, k in enumerate(self.key):
            root, depth, ring, turn = self.place[k]
            rows.append((k, self.ids[k], self.parent.get(k), self.size[k], root, depth, self.path(k) if paths else None, ring, turn))
            held += self.level[k] + 1 if paths else 1
            if held >= BATCH or n == len(self.key) - 1:
                yield pd.DataFrame(rows, columns=["key", "id", "parent", "size", "root", "depth", "path", "on_circle", "turn"]).astype({"turn": "Int64"})
                rows, held = [], 0

    def lists(self) -> Iterator[pd.DataFrame]:
        """id, descendant, distance: lists go from leaf to parent, so each node is in one waiting list at a time."""
        below: dict[str, list[str]] = {}
        rows: list[tuple] = []
        for k in self.order:
            mine = below.pop(k, [])
            rows += [(self.ids[k], self.ids[d], self.level[d] - self.level[k]) for d in mine]
            if (p := self.parent.get(k)) is not None:
                mine.append(k)
                if len(mine) > len(kept := below.get(p, [])):  # the shorter list is copied
                    mine, kept = kept, mine
                kept += mine
                below[p] = kept
            if len(rows) >= BATCH:
                yield pd.DataFrame(rows, columns=["id", "descendant", "distance"])
                rows = []
        for ring in self.rings:
            for n, k in enumerate(ring):  # ring[n + 1] is the parent of ring[n]
                for up in range(len(ring)):
                    of = self.ids[ring[(n + up) % len(ring)]]
                    rows += [(of, self.ids[d], self.level[d] + up) for d in below.get(k, [])]
                    rows += [(of, self.ids[k], up)] if up else []
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=["id", "descendant", "distance"])
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["id", "descendant", "distance"])


def _forests(batches: Iterator[pd.DataFrame], top: str | None) -> Iterator[Peeled]:
    """Whole trees at a time from rows sorted by top; all rows at once without."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        if top is not None and held and b[top].iloc[-1] != held[-1][top].iloc[-1]:
            last = b[top].iloc[-1]
            held.append(b[b[top] != last])
            yield Peeled(pd.concat(held, ignore_index=True))
            held, b = [], b[b[top] == last]
        held.append(b)
    if held:
        yield Peeled(pd.concat(held, ignore_index=True))


def _peel_in_task(rows: DataFrame, top: str | None, paths: bool) -> DataFrame:
    return rows.mapInPandas(lambda batches: (out for f in _forests(batches, top) for out in f.placed(paths)), PLACED)


def _lists_in_task(rows: DataFrame, top: str | None) -> DataFrame:
    return rows.mapInPandas(lambda batches: (out for f in _forests(batches, top) for out in f.lists()), "id string, descendant string, distance bigint")


def by_tree(linked: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows with top, whole trees sorted within tasks; rows of larger trees and of circles), either None if there are none.

    Pointer doubling: each job doubles how far up a row looks; rows that reach a root are done. A job in which
    none gets there leaves only rows on circles or below them.
    """
    at = cut(linked.select("key", F.coalesce("parent", "key").alias("to"), F.col("parent").isNull().alias("end")))
    done, left = [at.where("end")], at.where("not end").count()
    while left:
        ahead = cut(
            at.where("not end").alias("a").join(at.alias("b"), F.expr("a.to = b.key")).select(F.col("a.key").alias("key"), F.col("b.to").alias("to"), F.col("b.end").alias("end"))
        )
        done.append(ahead.where("end"))
        still = ahead.where("not end").count()
        if still == left:
            break
        left, at = still, ahead.unionByName(at.where("end"))
    tops = done[0]
    for d in done[1:]:
        tops = tops.unionByName(d)
    rows = linked.join(tops.select("key", F.col("to").alias("top")), "key", "left")
    count = tops.groupBy("to").count().withColumnRenamed("to", "top")
    large = cut(count.where(F.col("count") > most).select("top"))
    some_large = not large.isEmpty()
    small = rows.where("top is not null")
    rest = rows.where("top is null").drop("top") if left else None
    if some_large:
        rest = small.join(large, "top", "left_semi").drop("top") if rest is None else small.join(large, "top", "left_semi").drop("top").unionByName(rest)
        small = small.join(large, "top", "left_anti")
    dealt = small.select("key", "id", "parent", "size", "top").repartition(tasks_for(linked), "top").sortWithinPartitions("top")
    return dealt, rest


def _circles(rows: DataFrame, paths: bool = True) -> DataFrame:
    """Smallest id on each circle and the links up to it, by pointer doubling, when too many circles are left for one task."""
    at = rows.select("key", F.col("parent").alias("next"), F.col("id").alias("least"), F.lit(0).cast("bigint").alias("turn"))
    ahead = 1
    while True:
        step = at.alias("a").join(at.alias("b"), F.expr("a.next = b.key")).select(
            F.col("a.key").alias("key"), F.col("b.next").alias("next"), F.least("a.least", "b.least").alias("least"),
            F.when(F.expr("b.least < a.least"), F.col("b.turn") + F.lit(ahead)).otherwise(F.col("a.turn")).alias("turn"),
            F.expr("b.least < a.least").alias("moved"),
        )
        step = cut(step)
        ahead *= 2
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return rows.join(at.select("key", F.col("least").alias("root"), "turn"), "key").select(
        "key", "id", "parent", "size", "root", F.lit(-1).cast("bigint").alias("depth"),
        (F.array("id") if paths else F.lit(None).cast("array<string>")).alias("path"), F.lit(True).alias("on_circle"), F.col("turn").cast("bigint").alias("turn")
    )


def peel(linked: DataFrame, residual_rows: int = RESIDUAL_ROWS, paths: bool = True) -> DataFrame:
    """Places every row of linked_nodes (runs log of the depth jobs, and one per level of trees too large for a task).

    Paths take room in the square of the depth; without them a chain may be as long as it likes.
    """
    linked = cut(linked)
    dealt, rest = by_tree(linked, residual_rows)
    placed = _peel_in_task(dealt, "top", paths)
    return placed if rest is None else placed.unionByName(_peel_rounds(rest, residual_rows, paths))


def _peel_rounds(linked: DataFrame, residual_rows: int, paths: bool) -> DataFrame:
    """The same in rounds over all tasks, until what is left fits one."""
    alive, leaves, rounds, count = cut(linked), None, [], None
    while True:
        count = alive.count()
        if count <= residual_rows:
            break
        step = cut(_round(alive, leaves))
        off = step.where("leaf").drop("leaf")
        alive, leaves = step.where("not leaf").drop("leaf"), off
        if off.isEmpty():  # only circles are left
            break
        rounds.append(off)
    rest = _round(alive, leaves).drop("leaf") if leaves is not None else alive
    if count > residual_rows:
        placed = _circles(rest, paths)
    else:
        placed = _peel_in_task(rest.coalesce(1), None, paths)
    if not rounds:
        return placed
    placed = cut(placed)
    for k, off in enumerate(reversed(rounds)):
        up = placed.select(F.col("key").alias("parent"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("path").alias("p"), "turn")
        top = F.col("parent").isNull()
        here = off.join(up, "parent", "left").select(
            "key", "id", "parent", "size",
            F.when(top, F.col("id")).otherwise(F.col("r")).alias("root"),
            F.when(top, F.lit(0)).when(F.col("d") < 0, F.lit(-1)).otherwise(F.col("d") + 1).cast("bigint").alias("depth"),
            (F.when(top, F.array("id")).otherwise(F.concat("p", F.array("id"))) if paths else F.lit(None).cast("array<string>")).alias("path"),
            F.lit(False).alias("on_circle"),
            "turn",
        )
        last = k == len(rounds) - 1
        placed = placed.unionByName(here if last else cut(here))
    return placed


def hierarchy(records: DataFrame, id_col: str = "id", parent_col: str = "supersedes", residual_rows: int = RESIDUAL_ROWS) -> DataFrame:
    """Every node: id, parent, root, depth, path (root first), subtree_size, on_circle, into_circle; for nodes into a circle
    branch, from the node of the circle down to the node itself, and turn, the links from that node of the circle up to the root."""
    nodes = nodes_of(records, id_col, parent_col)
    return _shown(nodes, peel(linked_nodes(nodes), residual_rows))


def _shown(nodes: DataFrame, peeled: DataFrame) -> DataFrame:
    placed = peeled.select("key", F.col("parent").alias("up"), "size", "root", "depth", "path", "on_circle", "turn")
    return nodes.select("key", "id").join(placed, "key", "left").select(
        "id", F.col("up").alias("parent"), F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.when(F.col("depth").isNull(), F.array("id")).when(F.col("depth") >= 0, F.col("path")).alias("path"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("subtree_size"),
        F.coalesce("on_circle", F.lit(False)).alias("on_circle"),
        (F.coalesce(F.col("depth"), F.lit(0)) < 0).alias("into_circle"),
        F.when(F.col("depth") < 0, F.col("path")).alias("branch"), "turn",
    )


def found(records: DataFrame, residual_rows: int = RESIDUAL_ROWS) -> DataFrame:
    """id, root, depth of every record whose parent exists."""
    return peel(linked_nodes(nodes_of(records)), residual_rows, paths=False).where("parent is not null").select("id", "root", "depth")


def successors(records: DataFrame, id_col: str = "id", parent_col: str = "supersedes", residual_rows: int = RESIDUAL_ROWS) -> DataFrame:
    """id, descendant, distance, from the lists that leaves send to their parents; of trees too large for a task from their paths."""
    linked = cut(linked_nodes(nodes_of(records, id_col, parent_col)))
    dealt, rest = by_tree(linked, residual_rows)
    out = _lists_in_task(dealt, "top")
    if rest is None:
        return out
    rest = cut(rest)
    if rest.count() <= residual_rows:
        return out.unionByName(_lists_in_task(rest.coalesce(1), None))
    return out.unionByName(descendants(_shown(rest, _peel_rounds(rest, residual_rows, True))))


def descendants(placed: DataFrame) -> DataFrame:
    """id, descendant, distance of hierarchy's rows: one row per pair, so that a hub never becomes one long array.

    On a circle distance is the fewest links from the descendant up to id.
    """
    lines = placed.select(F.col("id").alias("descendant"), F.coalesce("path", "branch").alias("line"))
    down = lines.select("descendant", (F.size("line") - 1).alias("last"), F.posexplode("line").alias("at", "id")).where("at < last").select(
        "id", "descendant", (F.col("last") - F.col("at")).cast("bigint").alias("distance")
    )
    # the other nodes of a circle, from each of its nodes and from each below it
    into = placed.where("into_circle").select(F.col("id").alias("descendant"), "root", "turn", (F.size("branch") - 1).alias("below"))
    ring = placed.where("on_circle").select("id", "root", F.col("turn").alias("of"))
    long = ring.groupBy("root").agg((F.max("of") + 1).alias("long"))
    around = into.join(ring.join(long, "root"), "root").where("turn <> of").select(
        "id", "descendant", (F.col("below") + F.pmod(F.col("turn") - F.col("of"), F.col("long"))).cast("bigint").alias("distance")
    )
    return down.unionByName(around)
