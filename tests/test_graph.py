import json
import random

import pytest
from pyspark.sql import functions as F

from fumikura.operators import graph, scale
from fumikura.plans.harvest import harvest, harvest_documents, harvest_patterns
from fumikura.sources import records
from fumikura.sources.triples import binding_rows

S = "http://schema.org/"
FACTS = [
    ("http://x1", S + "name", "one"),
    ("http://x1", S + "part", "http://x1#a"),
    ("http://x1", S + "part", "http://x1#a"),
    ("http://x1", S + "also", "http://x1#a"),
    ("http://x1", S + "also", "_:b"),
    ("http://x1", S + "also", "http://other"),
    ("http://x1", S + "next", "http://x10"),
    ("http://x1#a", S + "up", "http://x1"),
    ("http://x1#a", S + "deep", "http://x1#a/z"),
    ("http://x1#a", S + "none", "http://x1#nothing"),
    ("http://x1#a/z", S + "name", "zed"),
    ("http://x1#a/z", S + "deeper", "http://x1#a/z/y"),
    ("http://x1#a/z/y", S + "name", "why"),
    ("_:b", S + "value", "5"),
    ("_:b", S + "self", "_:b"),
    ("http://x10", S + "name", "ten"),
    ("http://other", S + "name", "far"),
]


def triples(spark, facts=FACTS):
    rows = [(s, p, o, i) for i, (s, p, o) in enumerate(facts)]
    return spark.createDataFrame(rows, "s string, p string, o string, ord bigint").repartition(3)


def roots(spark, *uris):
    return spark.createDataFrame([(u,) for u in uris], "uri string")


def brute_document(facts, root, depth):
    """Tree by recursion over a dict, the depth counted in node levels."""
    known = {}
    for s, p, o in facts:
        known.setdefault(s, {}).setdefault(p, []).append(o)

    def node(at, path):
        out = {"@id": at}
        for p, objects in known[at].items():
            values = []
            for o in objects:
                inner = o in known and (o.startswith(root) or o.startswith("_:"))
                if inner and o in path:
                    values.append({"@id": o, "meta": "cyclic_reference"})
                elif inner and len(path) < depth:
                    values.append(node(o, path + [o]))
                else:
                    values.append(o)
            out[p.replace(S, "schema:")] = values[0] if len(values) == 1 else values
        return out

    return {**node(root, [root]), "status": "success"} if root in known else {"uri": root, "status": "failed"}


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_documents(spark, depth):
    uris = ["http://x1", "http://x10", "http://gone", "http://other"]
    docs = graph.nested_documents(triples(spark), roots(spark, *uris), depth).collect()
    got = {r.root: json.loads(r.doc) for r in docs}
    assert got == {u: brute_document(FACTS, u, depth) for u in uris}
    assert list(got["http://x1"]) == list(brute_document(FACTS, "http://x1", depth))


def test_boundary_keeps_x10_out_of_x1(spark):
    doc = graph.nested_documents(triples(spark), roots(spark, "http://x1"), boundary="[#/]").first().doc
    assert json.loads(doc)["schema:next"] == "http://x10"


def test_escapes_in_documents(spark):
    facts = [("http://r", S + "name", 'a "b"\n[\\] 楽')]
    doc = graph.nested_documents(triples(spark, facts), roots(spark, "http://r")).first().doc
    assert json.loads(doc)["schema:name"] == 'a "b"\n[\\] 楽'


def test_large_roots_are_cut_into_parts_that_are_whole_together(spark):
    facts = [("http://r", S + "name", f"n{i}") for i in range(25)] + [("http://q", S + "name", "q")]
    facts += [("http://r", S + "loc", "http://r#a")] + [("http://r#a", S + "k", str(i)) for i in range(4)]
    for stride in (1, 1000):  # also with gaps in the order
        spaced = triples(spark, facts).withColumn("ord", F.col("ord") * stride)
        docs = graph.nested_documents(spaced, roots(spark, "http://r", "http://q"), most=10).collect()
        parts = [json.loads(r.doc) for r in sorted(docs, key=lambda r: int(r.part or 0)) if r.root == "http://r"]
        assert len(parts) >= 3 and all(p["@id"] == "http://r" and p["part"] == i for i, p in enumerate(parts, 1))
        names = [p["schema:name"] for p in parts if "schema:name" in p]
        assert all(isinstance(v, list) for v in names) and [v for x in names for v in x] == [f"n{i}" for i in range(25)]
        inner = [p["schema:loc"] for p in parts if "schema:loc" in p]
        assert inner == [{"@id": "http://r#a", "schema:k": ["0", "1", "2", "3"]}]
        assert [r.part for r in docs if r.root == "http://q"] == [""]


@pytest.mark.parametrize("limit", [None, 2])
def test_frontier(spark, rows, limit):
    got = graph.frontier(triples(spark), roots(spark, "http://x1", "http://gone"), limit)
    ways = graph.frontier(triples(spark), roots(spark, "http://x1", "http://gone"), limit, paths=True)
    assert rows(ways.select("depth", "node").distinct()) == rows(got, "depth", "node")
    want = [
        (1, "http://x1"), (2, "_:b"), (2, "http://x1#a"), (2, "http://x10"), (3, "http://x1#a/z"), (4, "http://x1#a/z/y"),
    ]
    assert rows(got, "depth", "node") == [x for x in want if limit is None or x[0] <= limit]


def test_large_inner_nodes_join_page_by_page(spark, rows):
    want = rows(graph.expand(triples(spark), roots(spark, "http://x1", "http://x10"), 4))
    assert rows(graph.expand(triples(spark), roots(spark, "http://x1", "http://x10"), 4, most=1)) == want


def test_groups_keep_order_and_duplicates_and_page(spark):
    got = {(r.s, r.p): r.objects for r in graph.grouped_objects(triples(spark)).collect()}
    assert got["http://x1", S + "part"] == ["http://x1#a", "http://x1#a"]
    assert got["http://x1", S + "also"] == ["http://x1#a", "_:b", "http://other"]
    facts = [("hot", "p", f"o{i}") for i in range(23)] + [("cold", "p", "x")]
    paged = graph.grouped_objects(triples(spark, facts), most=5).orderBy("s", "page").collect()
    assert [r.objects for r in paged if r.s == "cold"] == [["x"]]
    hot = [r.objects for r in paged if r.s == "hot"]
    assert max(map(len, hot)) <= 5 and [o for page in hot for o in page] == [f"o{i}" for i in range(23)]
    sparse = triples(spark, facts).withColumn("ord", F.col("ord") * 50)
    assert [r.objects for r in graph.grouped_objects(sparse, most=5).orderBy("s", "page").collect() if r.s == "hot"] == hot
    ones = graph.grouped_objects(triples(spark, facts), most=2).where("s = 'hot'").orderBy("page")
    assert [r.j for r in ones.select(graph.collapsed("objects", "total").alias("j")).collect()][-1] == '["o22"]'


def test_collapse(spark):
    df = spark.createDataFrame([(["a"],), (["a", 'b"'],)], "v array<string>")
    assert [r.j for r in df.select(graph.collapsed("v").alias("j")).collect()] == ['"a"', '["a","b\\""]']


def test_harvest_counts_hits_and_new_ids(spark, rows):
    kind = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    facts = []
    for i in range(8):
        facts.append((f"u{i}", kind, "T" if i < 7 else "other"))
        facts.append((f"u{i}", S + "about", "http://jla.or.jp/data/ndc#761" if i % 2 else "x"))
        facts.append((f"u{i}", label, "音楽" if i < 3 else "絵"))
        facts.append((f"u{i}", label, "楽譜") if i == 1 else (f"u{i}", S + "description", "樂譜" if i == 6 else "-"))
    done = harvest_patterns(triples(spark, facts), "T")
    assert rows(done.stats, "pattern", "hits", "new_ids") == [(1, 3, 3), (2, 4, 2), (3, 0, 0), (4, 1, 1)]
    assert [r.uri for r in done.uris.collect()] == ["u0", "u1", "u2", "u3", "u5", "u6"]
    per_subject = done.hits.where("pattern = 2")
    page = lambda last, n: [r.s for r in graph.page_after(per_subject, last, n).collect()]
    assert page(None, 2) == ["u0", "u1"] and page("u0", 5) == ["u1", "u1", "u2"] and page("u2", 5) == []


def test_failed_roots_and_restriction(spark, rows, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    wanted = roots(spark, "http://x1", "http://gone", "http://gone")
    assert rows(graph.failed_roots(triples(spark), wanted)) == [("http://gone", "failed")]
    assert graph.of_roots(triples(spark), wanted).count() == 7


def test_binding_rows(spark):
    docs = spark.createDataFrame(
        [('{"results":{"bindings":[{"s":{"value":"a"},"p":{"value":"b"},"o":{"value":"c"}}]}}',), ('{"results":{"bindings":[]}}',)],
        "raw string",
    ).select(F.from_json("raw", "results struct<bindings: array<struct<s: struct<value: string>, p: struct<value: string>, o: struct<value: string>>>>").alias("d")).select("d.results")
    assert [tuple(r) for r in binding_rows(docs).collect()] == [(0, "a", "b", "c")]


def test_long_chain_has_a_plan_of_constant_size(spark, rows, monkeypatch):
    n = 40
    facts = [(f"http://r#{i}" if i else "http://r", S + "next", f"http://r#{i + 1}") for i in range(n - 1)] + [(f"http://r#{n - 1}", S + "name", "end")]
    sizes = []
    append = graph.Buckets.append

    def measured(self, df, partition=None):
        if partition:
            sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return append(self, df, partition)

    monkeypatch.setattr(graph.Buckets, "append", measured)
    got = graph.frontier(triples(spark, facts), roots(spark, "http://r"))
    assert rows(got, "depth") == sorted([(i + 1,) for i in range(n)], key=repr)
    assert len(sizes) == n + 1 and max(sizes[2:]) < 1.5 * min(sizes[2:])


def test_cycles_end_and_tables_are_forgotten(spark, rows):
    facts = [("http://r", S + "a", "http://r#x"), ("http://r#x", S + "b", "http://r#y"), ("http://r#y", S + "c", "http://r#x"), ("http://r#y", S + "d", "http://r")]
    got = graph.frontier(triples(spark, facts), roots(spark, "http://r"))
    assert rows(got, "depth", "node") == [(1, "http://r"), (2, "http://r#x"), (3, "http://r#y")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("reached_", "links_"))]
    assert graph.frontier(triples(spark, facts), roots(spark, "http://none")).count() == 0


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_documents_that_share_nodes(spark, depth):
    """A node under several parents, under the same parent twice, and in cycles of several lengths."""
    r = "http://r"
    facts = [(r, S + "a", r + "#1"), (r, S + "b", r + "#1"), (r, S + "b", r + "#2"), (r + "#1", S + "c", r + "#3"), (r + "#2", S + "c", r + "#3")]
    facts += [(r + "#3", S + "d", r + "#1"), (r + "#3", S + "d", "_:z"), ("_:z", S + "e", r + "#3"), ("_:z", S + "f", r), (r + "#2", S + "c", r + "#2"), (r, S + "a", r + "#1")]
    facts += [("http://q", S + "g", "_:z")]
    docs = graph.nested_documents(triples(spark, facts), roots(spark, r, "http://q"), depth).collect()
    assert {d.root: json.loads(d.doc) for d in docs} == {u: brute_document(facts, u, depth) for u in (r, "http://q")}


def test_pages_read_the_files_they_lie_in(spark):
    rng = random.Random(2)
    keys = [(f"k{i:05}", rng.choice([1, 1, 3])) for i in range(3000)]
    hits = spark.createDataFrame(rng.sample(keys, len(keys)), "s string, hits bigint")
    store = graph.page_store(hits)
    files = store.index.count()
    assert files > 2 and store.index.agg(F.sum("hits")).first()[0] == sum(n for _, n in keys)
    every = [k for k, n in keys for _ in range(n)]
    for last in (None, "k00000", "k01499", "k02998x", "zzz", ""):
        page = store.after(last, 50)
        want = [k for k in every if last is None or k > last][:50]
        assert [r.s for r in page.collect()] == want
        assert len(page.inputFiles()) <= 2
    assert [r.s for r in store.after("k00000", 6000).collect()] == [k for k in every if k > "k00000"]
    assert graph.page_store(hits.limit(0)).after(None, 5).count() == 0


def test_harvest_goes_on_where_it_stopped(spark, rows, tmp_path, monkeypatch):
    path, asked = str(tmp_path / "docs"), []
    fold = graph.nested_documents

    def failing(facts, uris, **options):
        asked.append(sorted(r.uri for r in uris.collect()))
        if len(asked) == 2:
            raise RuntimeError("lost")
        return fold(facts, uris, **options)

    wanted = [f"http://r{i}" for i in range(12)] + ["http://x1", "http://x1", None]
    facts = FACTS + [(f"http://r{i}", S + "name", f"n{i}") for i in range(10)]
    monkeypatch.setattr(graph, "nested_documents", failing)
    with pytest.raises(RuntimeError):
        harvest_documents(triples(spark, facts), roots(spark, *wanted), path, batches=3)
    assert rows(spark.read.json(path), "root") == [(u,) for u in asked[0]]  # the first batch is kept
    whole = harvest_documents(triples(spark, facts), roots(spark, *reversed(wanted), "http://other"), path, batches=3)
    assert not set(asked[0]) & {u for batch in asked[2:] for u in batch}  # and not folded again
    plain = fold(triples(spark, facts), roots(spark, *sorted(set(filter(None, wanted))), "http://other"))
    assert rows(whole, "root", "part", "doc") == rows(plain, "root", "part", "doc")
    asked.clear()
    assert harvest_documents(triples(spark, facts), roots(spark, *wanted), path).count() == whole.count() and not asked


def test_harvest_flow_from_patterns(spark, rows, tmp_path):
    facts = [("http://a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "T"), ("http://a", S + "name", "楽譜"), ("http://b", S + "name", "楽譜")]
    found, docs = harvest(triples(spark, facts), "T", str(tmp_path / "docs"))
    assert rows(found.uris) == [("http://a",)] and [json.loads(r.doc)["schema:name"] for r in docs.collect()] == ["楽譜"]


def test_a_run_that_ends_before_its_output_is_written_loses_no_key(spark, rows, tmp_path, monkeypatch):
    path, write = str(tmp_path / "out"), records.write_jsonl
    frame = spark.createDataFrame([("a",), ("b",)], "uri string")

    def failing(*args, **options):
        raise RuntimeError("lost")

    monkeypatch.setattr(records, "write_jsonl", failing)
    with pytest.raises(RuntimeError):
        records.append_pending(frame, path)
    monkeypatch.setattr(records, "write_jsonl", write)
    records.append_pending(frame, path)
    records.append_pending(frame, path)
    assert rows(spark.read.json(path), "uri") == [("a",), ("b",)]


def test_groups_are_dealt_out_by_the_number_of_rows(spark, monkeypatch):
    """A task gathers so many rows, whatever the number of shuffle partitions."""
    monkeypatch.setattr(scale, "TASK_ROWS", 2)
    facts = spark.createDataFrame([(f"s{i}", "p", f"o{i}", i) for i in range(20)], "s string, p string, o string, ord bigint")
    groups = graph.grouped_objects(facts)
    assert groups.rdd.getNumPartitions() == 10
    assert sorted((r.s, r.objects) for r in groups.collect()) == sorted((f"s{i}", [f"o{i}"]) for i in range(20))


@pytest.mark.parametrize("batches", [1, 4])
def test_harvest_looks_nodes_up_once_for_all_batches(spark, rows, tmp_path, monkeypatch, batches):
    """The triples are joined once, and not at all below roots that lead nowhere."""
    path, paged, counted = str(tmp_path / "docs"), graph._paged, []
    monkeypatch.setattr(graph, "_paged", lambda *args: counted.append(args) or paged(*args))
    wanted = [f"http://r{i}" for i in range(12)] + ["http://r0", "http://x1", None]
    facts = FACTS + [(f"http://r{i}", S + "name", f"n{i}") for i in range(10)] + [(f"http://r{i}", S + "part", f"http://r{i}#a") for i in range(5)]
    facts += [(f"http://r{i}#a", S + "name", f"of {i}") for i in range(4)] + [(None, S + "name", "nobody"), ("http://r1", S + "part", None)]
    whole = harvest_documents(triples(spark, facts), roots(spark, *wanted), path, batches=batches)
    assert len(counted) == 1
    plain = graph.nested_documents(triples(spark, facts), roots(spark, *sorted(set(filter(None, wanted)))))
    assert rows(whole, "root", "part", "doc") == rows(plain, "root", "part", "doc")
    counted.clear()
    whole = harvest_documents(triples(spark, facts), roots(spark, *wanted, "http://none"), path, batches=batches)
    assert not counted and whole.count() == len(set(filter(None, wanted))) + 1
