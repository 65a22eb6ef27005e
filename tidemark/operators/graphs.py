"""Directed graphs as tables of edges (src, dst): reachability, cycles, layers.

Nodes may be of any comparable type, structs too. Every round is an equi-join and
is written to the shared folder, so lineage stays short; a node with very many edges is
one row per edge and never gathered. Both sides of a join are dealt out by key: edges and
nodes of regular ids are a few bytes a row as files, so by their size a join would send
tables to the driver that take many times that in its memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Rounds after which the parts found so far are written as one table.
FOLD = 8


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of two tables that grow with the graph; neither is broadcast."""
    return left.join(right.hint("merge"), on, how)


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows (node, label): all nodes from which edges lead to a node of ``seeds`` (node, label), those included.

    Each round takes only the pairs that the round before has found, one edge
    further, so cycles end by themselves. As many rounds as the longest way.
    """
    known = fresh = materialize(seeds.select("node", "label").distinct(), "reached")
    rounds = 0
    while True:
        ahead = _met(fresh.withColumnRenamed("node", "dst"), edges, "dst").select(F.col("src").alias("node"), "label").distinct()
        fresh = materialize(_met(ahead, known, ["node", "label"], "left_anti"), "reached")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
        rounds += 1
        if rounds % FOLD == 0:
            known = materialize(known, "reached")


def chain_ends(links: DataFrame) -> DataFrame:
    """Rows (node, end) of a table (node, next) with one row per node: the first node of its way that has no next.

    Each round doubles the distance that a pointer covers. Nodes whose way runs into a
    cycle have no end and no row; they are what is left when a round settles nobody.
    """
    more = links.select(F.col("node").alias("end"), F.lit(True).alias("_more"))
    pointers = _met(links.select("node", F.col("next").alias("end")), more, "end", "left")
    pointers = materialize(pointers.select("node", "end", F.coalesce("_more", F.lit(False)).alias("open")), "pointers")
    left = pointers.where("open").count()
    while left:
        ahead = pointers.select(F.col("node").alias("end"), F.col("end").alias("_to"), F.col("open").alias("_open"))
        moved = _met(pointers.where("open"), ahead, "end").select("node", F.col("_to").alias("end"), F.col("_open").alias("open"))
        pointers = materialize(pointers.where("NOT open").unionByName(moved), "pointers")
        before, left = left, pointers.where("open").count()
        if left == before:
            break
    return pointers.where("NOT open").select("node", "end")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out among them; all edges of cycles stay."""
    edges = materialize(edges, "edges")
    left = edges.count()
    while left:
        into = edges.select(F.col("dst").alias("src")).distinct()
        out_of = edges.select(F.col("src").alias("dst")).distinct()
        edges = materialize(_met(_met(edges, into, "src", "left_semi"), out_of, "dst", "left_semi").select("src", "dst"), "edges")
        before, left = left, edges.count()
        if left == before:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """Rows (node, colour): the smallest node from which edges lead to it, itself included.

    Only nodes whose colour has changed pass it on.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = materialize(nodes.withColumn("colour", F.col("node")), "colours")
    changed = colours
    while True:
        offered = _met(changed.withColumnRenamed("node", "src"), edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
        after = materialize(_met(colours, offered, "node", "left"), "colours")
        changed = after.where("offer < colour").select("node", F.col("offer").alias("colour"))
        if changed.isEmpty():
            return colours
        colours = after.select("node", F.least("colour", "offer").alias("colour"))


def components_of_cycles(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of every node on a cycle; a component is named by its smallest node.

    Nodes that can't lie on a cycle are trimmed first. Then every node takes the
    smallest node that reaches it as its colour; a node of its own colour and those of that
    colour that reach it back are one strongly connected component. What is left goes on:
    one turn per component that lies behind another one. An edge from a node to itself is a cycle.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    loops = materialize(edges.where("src = dst").select(F.col("src").alias("node")), "loops")
    rest = _trimmed(edges.where("src <> dst"))
    found = loops.select("node", F.col("node").alias("component"))
    while not rest.isEmpty():
        colours = materialize(_colours(rest), "colours")
        ends = _met(rest, colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src")
        ends = _met(ends, colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inside = materialize(ends.where("a = b").select("src", "dst"), "inside")
        roots = colours.where("node = colour").select("node", F.col("colour").alias("label"))
        members = spread(inside, roots).select("node", F.col("label").alias("component"))
        several = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        found = found.unionByName(materialize(_met(members, several, "component", "left_semi").select("node", "component"), "cycles"))
        gone = members.select("node")
        rest = _met(_met(rest, gone.withColumnRenamed("node", "src"), "src", "left_anti"), gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = _trimmed(rest.select("src", "dst"))
    return found.groupBy("node").agg(F.min("component").alias("component"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, layer, state): src depends on dst, so a node's layer is one above the highest that it depends on.

    Rounds take away the nodes that wait for nothing. What is left never gets a
    layer: it is on a cycle (state ``CYCLE``) or waits for one (``BLOCKED``); others are ``READY``.
    Edges to nodes that are not in ``nodes`` don't hold back, nor do those from a node to itself
    give a layer (such a node is a cycle).
    """
    nodes = materialize(nodes.select("node").where("node IS NOT NULL").distinct(), "nodes")
    known = _met(edges.select("src", "dst").distinct(), nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    edges = materialize(_met(known, nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
    waiting, held, layer = nodes, edges, 0
    done = None
    while True:
        ready = _met(waiting, held.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        ready = materialize(ready.withColumn("layer", F.lit(layer)), "layer")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        waiting = materialize(_met(waiting, ready, "node", "left_anti"), "nodes")
        held = materialize(_met(held, ready.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
        layer += 1
    stuck = waiting.select("node", F.lit(None).cast("int").alias("layer"))
    cycles = components_of_cycles(held).select("node", F.lit("CYCLE").alias("state"))
    stuck = _met(stuck, cycles, "node", "left").withColumn("state", F.coalesce("state", F.lit("BLOCKED")))
    return stuck if done is None else done.withColumn("state", F.lit("READY")).unionByName(stuck)
