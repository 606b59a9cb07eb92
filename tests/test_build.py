"""Curated lists, selection, prompts, the service and the command line."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from annales import __main__ as cli
from annales import api
from annales.operators import collect, extract, graph, search, traverse
from annales.plans import pipeline
from annales.session import ensure_checkpoint_dir
from annales.sources import files
from annales.sources.remote import EntitySource

ROOT = "/root/testdata/sf0.001"


def test_backbone(spark):
    capitals = spark.createDataFrame([("Hoa Thành", "Nhà A", 1000, 1010), (None, "Nhà A", 1, 2)], "place string, polity string, start_year int, end_year int")
    lists = spark.createDataFrame(
        [("d", 1, "Nhà A", "Ông X", None, "Hoa Thành", None, None, 1000, 1010), ("d", 2, "Nhà B", None, "Ông Y", None, "Nhà A", "Nhà C", 1010, None), ("d", 3, "Nhà C", None, None, None, None, None, None, None), ("d", 4, "Nhà C", None, None, None, "Nhà C", None, None, None), ("e", 1, None, "Ông Z", None, None, None, None, 1, 2)],
        "section string, position int, name string, founder string, ruler string, capital string, predecessor string, successor string, start_year int, end_year int",
    )
    got = sorted((r["head"], r["relation"], r["tail"]) for r in extract.from_backbone(capitals, lists).collect())
    # The explicit predecessor isn't told again by the chain; the successor is, once each way of telling.
    assert got == sorted([("Hoa Thành", "CAPITAL_OF", "Nhà A")] * 2 + [("Ông X", "FOUNDED", "Nhà A"), ("Ông Y", "RULED", "Nhà B"), ("Nhà B", "SUCCEEDED", "Nhà A"), ("Nhà C", "SUCCEEDED", "Nhà B"), ("Nhà C", "SUCCEEDED", "Nhà B")])
    assert extract.from_backbone(capitals.limit(0), lists.limit(0)).count() == 0
    with pytest.raises(ValueError):
        extract.from_backbone(None, None)


def test_structured(spark):
    shape = "head string, relation string, tail string, start_year int, end_year int, year_target string, confidence double, source string"
    backbone = spark.createDataFrame([("A", "RULED", "B", None, None, None, 1.0, "x")], shape)
    wiki = spark.createDataFrame([("C", "RULED", "D", None, None, None, 0.9, "y", 1), ("E", "RULED", "F", None, None, None, 0.9, "y", 2), ("G", "RULED", "H", None, None, None, 0.9, "y", 3)], shape + ", article_id long")
    articles = spark.createDataFrame([(1, "p1", None), (2, "p2", None), (3, "px", "e1")], "page_id long, period_id string, era_id string")
    dim = spark.createDataFrame([("p1", "e1"), ("p2", "e2")], "id string, era_id string")
    heads = lambda **k: sorted((r["head"], r["source"]) for r in extract.structured(backbone, articles, {"wikidata": wiki}, **k).collect())
    assert heads() == [("A", "x"), ("C", "wikidata"), ("E", "wikidata"), ("G", "wikidata")]
    assert heads(era="e1", periods=dim) == [("A", "x"), ("C", "wikidata"), ("G", "wikidata")]
    assert heads(period="p2") == [("A", "x"), ("E", "wikidata")]


def test_prompts(spark):
    chunks = spark.createDataFrame([("c1", "H", "văn bản", "Nhà A", [f"r{i}" for i in range(10)]), ("c2", None, "khác", None, None)], "id string, header string, text string, period_name string, roles array<string>")
    found = spark.createDataFrame([("c1", "Ông X", "Person"), ("c1", "Nhà A", "Polity"), ("c1", "?", None)], "chunk_id string, name string, type string")
    one, two = ({r["id"]: r["prompt"] for r in extract.prompts(chunks, e).collect()} for e in (None, found))
    assert one["c1"].startswith("H\n\nvăn bản\n\nperiod: Nhà A\nroles: r0, ") and "r7" in one["c1"] and "r8" not in one["c1"] and one["c2"] == "khác"
    assert "- Ông X (Person)" in two["c1"] and "- RULED: (Person) -> (Polity)" in two["c1"] and "BORN_IN" not in two["c1"]
    keys = {}
    find = lambda rows: keys.setdefault("first", rows) and found
    relate = lambda rows: rows.select("id", "call_key")
    entities, triplets = extract.two_passes(chunks, find, relate)
    other = extract.two_passes(chunks, lambda rows: found.where("name <> '?' AND name <> 'Nhà A'"), relate)[1]
    assert triplets.first()["call_key"] != other.first()["call_key"] and entities.count() == 3


def test_collect(spark):
    assert [r[0] for r in spark.createDataFrame([("1945",), ("năm 40 TCN",), ("Thế kỷ X",), ("Danh sách vua",), ("Thế kỷ10",), ("Đại La",), (None,)], "t string").select(collect.is_article(F.col("t"))).collect()] == [False, False, False, False, True, True, False]
    leads = spark.createDataFrame([(1, "A (chữ Nôm: x) (897 – 944) là vua. B (1 – 2)."), (2, "B. (năm 1010)"), (3, "C (năm 40)"), (4, None), (5, "D (944 – 897)")], "id int, lead string")
    assert sorted(tuple(r) for r in collect.lead_years(leads, "id").collect()) == [(1, 897, 944), (3, 40, 40)]
    row = collect.records(spark.createDataFrame([(1, "A", None)], "page_id int, title string, tier string")).first()
    assert len(row) == 21 and row["tier"] == "B" and row["aliases"] == [] and row["in_links"] == 0 and row["label"] is None
    kind = "page_id long, title string, classes array<string>, births array<int>, start_year int, end_year int"
    seeds = spark.createDataFrame([(1, "S", "p")], "page_id long, title string, period_id string").withColumns({"start_year": F.lit(1000), "end_year": F.lit(None).cast("int")})
    others = spark.createDataFrame([(2, "A", ["Q5"], [], 1005, None), (3, "B", ["Q9"], [], 1005, None), (4, "C", ["Q5"], [1940], 1005, None), (5, "1945", ["Q5"], [], 1005, None), (6, "D", ["Q5"], [], 1990, None), (7, "E", ["Q5"], [], 1006, None), (8, "F", ["Q5"], [], None, None), (9, "S", ["Q5"], [], 1005, None)], kind)
    links = spark.createDataFrame([(1, "A"), (1, "B"), (1, "F"), (2, "S"), (2, "S"), (8, "S"), (6, "S")], "page_id long, target string")
    dim = spark.createDataFrame([("p", 900, 1100, False, 1)], "id string, start_year int, end_year int, parallel boolean, position int")
    caps = spark.createDataFrame([("p", 3)], "period_id string, cap int")
    kept, rejected = collect.collected(seeds, others, links, dim, caps, ("Q5",))
    assert {r["title"]: (r["period_id"], r["is_seed"]) for r in kept.collect()} == {"S": ("p", True), "A": ("p", False), "F": ("p", False)}
    assert [tuple(r) for r in rejected.collect()] == [("B", ["Q9"], 1)]


def test_graph_parts(spark):
    one = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, v string")
    two = spark.createDataFrame([("b", "2"), ("c", "2"), ("c", "2")], "id string, v string")
    assert sorted(tuple(r) for r in graph.united(one, two, "id").collect()) == [("a", "1"), ("b", "1"), ("c", "2")]
    rows = one.select("id", F.struct("v").alias("s"), F.create_map("id", "v").alias("m"), F.array("v").alias("l"), F.array(F.struct("v")).alias("ls"), "v")
    assert graph.scalar_properties(rows, ("v",)).columns == ["id", "l"]
    edges = spark.createDataFrame([("a", "R", "b", ["2", "1"], 1, "x"), ("a", "R", "b", ["1", None], 2, "y"), ("a", "R", "c", None, 1, "z")], "src string, rel string, dst string, evidence array<string>, seq int, role string")
    assert {r["id"]: (r["role"], r["evidence"]) for r in graph.merge_edges(edges, "seq").collect()} == {"rel:a:R:b": ("y", ["1", "2"]), "rel:a:R:c": ("z", [])}


def test_pageranks_agree(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "d"), ("b", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("q", "a"), ("r", "c"), ("r", "none"), ("s", "none")], "query_id string, id string")
    copied = edges.crossJoin(seeds.select("query_id").distinct())
    get = lambda df: {(r["query_id"], r["node"]): r["score"] for r in df.collect()}
    one, two, three = get(traverse.pagerank(seeds, copied, tolerance=0.02)), get(traverse.pagerank_over(seeds, edges, tolerance=0.02)), get(traverse.pagerank_near(seeds, copied, tolerance=1e-6))
    assert one.keys() == two.keys() == three.keys() and {q for q, _ in one} == {"q", "r"}
    assert all(abs(one[k] - two[k]) < 1e-9 and abs(one[k] - three[k]) < 0.15 for k in one)
    assert set(get(traverse.pagerank_near(seeds, copied, iterations=2)).values()) == {1.0} == set(get(traverse.pagerank_over(seeds, edges, iterations=2)).values())
    assert traverse.pagerank_over(seeds.where("query_id = 's'"), edges).count() == 0 == traverse.pagerank_near(seeds.where("query_id = 's'"), copied).count()


def test_vectors(spark, monkeypatch):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 3.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [1.0]), ("g", [float("nan"), 1.0]), ("h", [4.0, 0.0])], "id string, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "query_id int, vector array<float>")
    want = [(1, 1, "a"), (1, 2, "h"), (2, 1, "c"), (2, 2, "b")]
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in search.vector_topk(asked, vectors, 2).collect()) == want
    monkeypatch.setattr(search, "MOST_QUESTIONS", 1)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in search.vector_topk(asked, vectors, 2).collect()) == want
    assert search.vector_topk(asked.limit(0), vectors, 2).count() == 0 == search.vector_topk(asked, vectors.limit(0), 2).count()


def test_full_text_index(spark):
    docs = spark.createDataFrame([("1", "Sông lớn, sông dài"), ("2", "núi"), ("3", ""), ("4", None), ("5", "...")], "id string, text string")
    index = search.inverted_index(docs)
    assert sorted((r["term"], r["id"], r["tf"], r["length"]) for r in index.collect()) == [("", "1", 1, 4), ("", "2", 1, 1), ("dài", "1", 1, 4), ("lớn", "1", 1, 4), ("núi", "2", 1, 1), ("sông", "1", 2, 4)]
    asked = spark.createDataFrame([("q", "sông"), ("q", "núi"), ("r", "biển")], "query_id string, term string")
    one = [tuple(r) for r in search.scored_hits(index, asked, 5).orderBy("rank").collect()]
    two = [tuple(r) for r in search.bm25_topk(spark.createDataFrame([("q", "Sông núi?"), ("r", "biển")], "query_id string, query string"), docs, 5).orderBy("rank").collect()]
    assert one == two and [r[1] for r in one] == ["2", "1"]


def test_scope(spark):
    shape = "query_id string, low int, high int, periods array<string>"
    rules = spark.createDataFrame([("a", 1, 2, ["p"]), ("b", None, None, []), ("c", None, None, ["p"])], shape)
    asked = spark.createDataFrame([("a", 5, 6), ("b", 5, 6)], "query_id string, low int, high int")
    told = spark.createDataFrame([("a", 8, 9, ["t"]), ("c", 8, 9, [])], shape)
    assert sorted(tuple(r) for r in pipeline.choose_scope(rules, asked, told).collect()) == [("a", 1, 2, ["t"]), ("b", 5, 6, []), ("c", 8, 9, ["p"])]
    assert pipeline.choose_scope(rules).where("query_id = 'b'").first()["low"] is None


def test_wikidata_source(spark, tmp_path):
    entity = {"id": "Q1", "labels": {"vi": {"value": "A"}}, "aliases": {"vi": [{"value": "B"}]}, "claims": {"P569": [{"rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": {"time": "+0900-01-01T00:00:00Z", "precision": 9}}}}, {"rank": "deprecated", "mainsnak": {"snaktype": "value", "datavalue": {"value": {"time": "+0800"}}}}], "P22": [{"mainsnak": {"snaktype": "somevalue"}}]}}
    path = tmp_path / "e.json"
    path.write_text(json.dumps(entity) + "\n" + json.dumps({"id": "Q2", "missing": ""}) + "\n")
    spark.dataSource.register(EntitySource)
    rows = spark.read.format("wikidata_entities").options(ids='["Q1", "Q2", "Q3", "Q1"]', answers=str(path)).load()
    got = rows.collect()
    assert len(got) == 1 and got[0]["labels"] == {"vi": "A"} and got[0]["aliases"] == {"vi": ["B"]}
    assert files.claims(rows, ("P569",), ("P22",)).first().asDict()["times"] == {"P569": ["+0900-01-01T00:00:00Z"]}


def test_merge_survives(spark, tmp_path):
    table = f"{tmp_path}/t"
    row = lambda *xs: spark.createDataFrame(list(xs), "id string, part string, v int")
    files.merge_partitions(spark, row(("1", "p", 1)), table, "id", "part")
    # A run cut off between the two renames left the old table set aside.
    (tmp_path / "t").rename(tmp_path / "t.old")
    files.merge_partitions(spark, row(("2", "q", 2)), table, "id", "part")
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == ["1", "2"] and not (tmp_path / "t.old").exists()


def test_checkpoint_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


@pytest.fixture(scope="module")
def service(spark):
    return api.Service(spark, pipeline.open_store(spark, ROOT))


def test_service(service):
    assert api.route(service, "GET", "/health")["status"] == "ok"
    listed = api.route(service, "GET", "/periods")
    assert len(listed) == 14 and api.route(service, "GET", "/periods/p08")["next"] == "p09"
    assert len(api.route(service, "GET", "/periods/p08/items?limit=3")) <= 3
    top = api.route(service, "GET", "/entities?type=Person&limit=2")
    assert len(top) == 2 and api.route(service, "GET", f"/entity/{top[0]['id']}")["name"] == top[0]["name"]
    assert isinstance(api.route(service, "GET", f"/entity/{top[0]['id']}/passages"), list)
    assert {r["label"] for r in api.route(service, "GET", "/stats")["labels"]} == {"Chunk", "Entity", "Period", "Relation"}
    for path in ("/entity/none", "/nowhere", "/periods/p99"):
        with pytest.raises(api.NotFound):
            api.route(service, "GET", path)
    with pytest.raises(ValueError):
        api.route(service, "GET", "/entities?wrong=1")
    asked = api.route(service, "POST", "/document/ask", {"question": "Ai đắp đê?", "text": "Dân phu đắp đê năm 1300. Vua về kinh."})
    assert "đắp đê" in asked["answer"]


def test_retrieve_and_chat(service):
    found = api.route(service, "POST", "/retrieve", {"question": "Nhà Thạch có việc gì năm 1300?"})
    assert found["plan"][0]["periods"] == ["p08"] and len(found["context"]) == 1 and len(found["chunks"]) <= 12
    events = list(api.route(service, "POST", "/chat", {"question": "Nhà Thạch có việc gì?", "mode": "vector"}))
    assert [e for e, _ in events][0] == "plan" and events[-1][0] == "done"
    assert "".join(t for e, t in events if e == "token").strip() == events[-1][1]["answer"].strip()


def test_server(service):
    server = api.serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        with urllib.request.urlopen(f"{root}/health", timeout=60) as answer:
            assert json.load(answer)["status"] == "ok"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{root}/entity/none", timeout=60)
        assert e.value.code == 404
    finally:
        server.shutdown()


def test_command_line(spark, capsys):
    assert cli.main(["--data", ROOT, "doctor"], spark) == 0 and cli.main(["--data", "/nowhere", "doctor"], spark) == 1
    assert cli.main(["--data", ROOT, "periods", "--check"], spark) == 0
    assert cli.main(["--data", ROOT, "stats"], spark) == 0 and cli.main(["--data", ROOT, "stats", "--by-period"], spark) == 0
    assert cli.main(["--data", ROOT, "build", "--dry-run", "--skip-to", "load"], spark) == 0
    assert capsys.readouterr().out.endswith("load\nembed\n")
