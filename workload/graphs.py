"""Trees from triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from fumikura.operators import graph
from fumikura.plans import harvest as harvesting
from fumikura.session import scratch_path, stored

from . import base, joins
from .base import HOME, ROOTS, TRIPLES, query
from .joins import HARVEST


@query("g1_union", f"WITH {HARVEST} SELECT s, bit_or(1 << pattern) AS patterns FROM hits GROUP BY s")
def union(spark, sf):
    hits = joins.harvested(spark, sf).hits
    return hits.groupBy("s").agg(F.sum(F.call_function("shiftleft", F.lit(1), F.col("pattern"))).alias("patterns"))


@query(
    "h1_frontier",
    f"""WITH RECURSIVE {TRIPLES}, {ROOTS},
    tree AS (
      SELECT DISTINCT uri AS root, CAST(1 AS BIGINT) AS depth, uri AS node, [uri] AS path FROM roots JOIN triples ON s = uri
      UNION
      SELECT tree.root, tree.depth + 1, t.o, list_append(tree.path, t.o) FROM tree JOIN triples t ON t.s = tree.node
      WHERE (starts_with(t.o, '_:') OR starts_with(t.o, tree.root)) AND NOT list_contains(tree.path, t.o)
        AND t.o IN (SELECT s FROM triples))
    SELECT root, depth, node, array_to_string(path, ' > ') AS path FROM tree""",
)
def frontier(spark, sf):
    rows = graph.frontier(base.triples(spark, sf), base.root_list(spark, sf), paths=True)
    return rows.select("root", F.col("depth").cast("bigint"), "node", F.array_join("path", " > ").alias("path"))


@query(
    "h1_reached",
    f"""WITH RECURSIVE {TRIPLES}, {ROOTS},
    tree AS (
      SELECT DISTINCT uri AS root, CAST(1 AS BIGINT) AS depth, uri AS node FROM roots JOIN triples ON s = uri
      UNION
      SELECT tree.root, tree.depth + 1, t.o FROM tree JOIN triples t ON t.s = tree.node
      WHERE (starts_with(t.o, '_:') OR starts_with(t.o, tree.root)) AND t.o IN (SELECT s FROM triples) AND tree.depth < 6)
    SELECT root, min(depth) AS depth, node FROM tree GROUP BY root, node""",
)
def reached(spark, sf):
    rows = graph.frontier(base.triples(spark, sf), base.root_list(spark, sf))
    return rows.select("root", F.col("depth").cast("bigint"), "node")


def _node(c: str, price: str, location: str, related: str, nid: str) -> str:
    """SQL of a customer node's JSON, without the closing brace."""
    return f"""'{{"@id":"' || {nid} || '","rdf:type":"{HOME}type/customer","rdfs:label":"' || {c}.c_name
      || '","schema:name":"' || lower({c}.c_name) || '","schema:about":"{HOME}segment#' || {c}.c_mktsegment
      || '","schema:description":"' || {c}.c_mktsegment || ' buyer","schema:location":' || {location}
      || ',"schema:price":' || {price} || ',"skos:related":[' || {related} || ',"{HOME}supplier/' || {c}.c_nationkey || '"]'"""


def _addr(c: str, geo: str) -> str:
    nid = f"'{HOME}customer/' || {c}.c_custkey"
    return f"""'{{"@id":"' || {nid} || '#addr","schema:addressCountry":"{HOME}nation/' || {c}.c_nationkey
      || '","schema:geo":' || {geo} || '}}'"""


def _bal(c: str) -> str:
    return f"""'{{"@id":"_:bal' || {c}.c_custkey || '","schema:value":"' || CAST(round({c}.c_acctbal * 100) AS BIGINT) || '"}}'"""


def _tree_sql() -> str:
    def nid(c):
        return f"'{HOME}customer/' || {c}.c_custkey"

    def link(c, tail=""):
        return f"""'"' || {nid(c)} || '{tail}"'"""

    def cyc(c, tail=""):
        return f"""'{{"@id":"' || {nid(c)} || '{tail}","meta":"cyclic_reference"}}'"""

    geo = f"""'{{"@id":"' || {nid('a')} || '#addr/geo","rdfs:label":"Geo of ' || a.c_name || '","skos:broader":'
      || {cyc('a', '#addr')} || ',"skos:related":' || {cyc('a')} || '}}'"""
    link10 = lambda c: f"""'"{HOME}customer/' || ({c}.c_custkey * 10) || '"'"""
    flat = _node("x", "'\"_:bal' || x.c_custkey || '\"'", link("x", "#addr"), link10("x"), nid("x")) + " || '}'"
    # depth 2: address and balance are expanded, the next customer is a depth-3 node of links
    mid = (
        _node("b", _bal("b"), _addr("b", link("b", "#addr/geo")), f"coalesce(f.doc, {link10('b')})", nid("b"))
        + " || '}'"
    )
    top = _node(
        "a",
        _bal("a"),
        _addr("a", geo),
        f"CASE WHEN a.c_custkey = 0 THEN {cyc('a')} ELSE coalesce(m.doc, {link10('a')}) END",
        nid("a"),
    ) + """ || ',"status":"success"}'"""
    return f"""WITH {ROOTS},
    flat AS (SELECT x.c_custkey, {flat} AS doc FROM customer x),
    mid AS (SELECT b.c_custkey, {mid} AS doc FROM customer b LEFT JOIN flat f ON f.c_custkey = b.c_custkey * 10),
    top AS (SELECT {nid('a')} AS root, {top} AS doc FROM customer a
      LEFT JOIN mid m ON m.c_custkey = a.c_custkey * 10)
    SELECT uri AS root, '' AS part, coalesce(doc, '{{"uri":"' || uri || '","status":"failed"}}') AS doc
    FROM roots LEFT JOIN top ON root = uri"""


@query("h1_resumed", _tree_sql())
def resumed(spark, sf):
    """A harvest of the buyers, then one of the whole list that goes on from it; no root is written twice."""
    path, triples = scratch_path(spark, "harvest"), stored(base.triples(spark, sf))
    roots = base.root_list(spark, sf)
    harvesting.harvest_documents(triples, roots.where(F.contains("uri", F.lit("/customer/"))), path, derived=False)
    return harvesting.harvest_documents(triples, roots, path, batches=1, derived=False)


@query("h1_tree", _tree_sql())
def tree(spark, sf):
    return graph.nested_documents(base.triples(spark, sf), base.root_list(spark, sf), depth=3)
