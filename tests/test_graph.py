import random

import pytest
from pyspark.sql import functions as F

from annales.config import DEFAULT
from annales.functions.fuzzy import mean_ratio
from annales.operators import browse, collect, context, extract, graph, periods, resolve, search, traverse
from annales.plans import pipeline
from annales.sources import files
from annales.sources.remote import DiskCache, PageSource
from annales.sources.tables import latest
from annales.streaming.resume import extract_stream

EDGES = [  # a parallel pair, a loop, a hub, undated and far edges, two equal ways from a to d
    ("e1", "a", "b", "RULED", 1000, 1010), ("e2", "a", "b", "OPPOSED", 1005, None), ("e3", "b", "d", "RULED", None, None), ("e4", "a", "c", "RULED", 1003, 1004),
    ("e5", "c", "d", "RULED", 1002, None), ("e6", "d", "d", "RULED", 1000, None), ("e7", "h", "a", "RULED", 1001, None), ("e8", "h", "e", "RULED", 1001, None), ("e9", "h", "f", "RULED", 1900, None),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "edge_id string, src string, dst string, rel string, start_year int, end_year int").cache()


def test_degrees(edges):
    got = {r["id"]: r["degree"] for r in graph.degrees(edges).collect()}
    assert got == {"a": 4, "b": 3, "c": 2, "d": 3, "h": 3, "e": 1, "f": 1}
    assert graph.degree_bound(graph.degrees(edges), "p99") == 4 and graph.degree_bound(graph.degrees(edges), None) is None


def test_expand(spark, edges):
    seeds = spark.createDataFrame([("q", "a"), ("z", "none")], "query_id string, id string")
    got = traverse.expand(seeds, edges, hops=2).collect()
    assert {r["node"] for r in got if r["hop"] == 1} == {"b", "c", "h"}
    # Back over the parallel edge, not over the same one.
    assert sum(r["node"] == "a" for r in got) == 2 and all(len(set(r["edges"])) == len(r["edges"]) for r in got)
    kept = traverse.expand(seeds, traverse.passable(edges, ["RULED"], 1000, 1010), graph.degrees(edges), 2, 3).collect()
    assert {r["node"] for r in kept} == {"b", "c", "d", "h", "e"}
    assert len(traverse.expand(seeds, edges, hops=9, limit=5).collect()) == 5


def test_shortest_paths(spark, edges):
    pairs = spark.createDataFrame([("q1", "a", "d"), ("q2", "a", "a"), ("q3", "e", "d"), ("q4", "a", "nowhere")], "query_id string, a string, b string")
    got = traverse.shortest_paths(pairs, edges, limit=None).collect()
    assert sorted(tuple(r["nodes"]) for r in got if r["query_id"] == "q1") == [("a", "b", "d"), ("a", "b", "d"), ("a", "c", "d")]
    assert {r["hops"] for r in got if r["query_id"] == "q3"} == {4} and {r["query_id"] for r in got} == {"q1", "q3"}
    blocked = traverse.shortest_paths(pairs, edges, graph.degrees(edges), max_degree=3, limit=1).collect()
    assert [r["query_id"] for r in blocked] == ["q1"]


def test_pagerank(spark, edges):
    seeds = spark.createDataFrame([("q", "a"), ("q", "zz"), ("r", "zz")], "query_id string, id string")
    rows = edges.select("src", "dst").crossJoin(spark.createDataFrame([("q",), ("r",)], "query_id string"))
    got = {r["node"]: r["score"] for r in traverse.pagerank(seeds, rows, tolerance=1e-9).where("query_id = 'q'").collect()}
    links = {}
    for _, s, t, *_ in EDGES:
        links.setdefault(s, set()).add(t)
        links.setdefault(t, set()).add(s)
    rank = {n: 1 / len(links) for n in links}
    for _ in range(200):
        rank = {n: 0.85 * sum(rank[m] / len(links[m]) for m in links if n in links[m]) + (0.15 if n == "a" else 0) for n in links}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-6 for n in rank)


def test_merge_and_names(spark):
    rows = spark.createDataFrame([("a", "R", "b", 1, ["c2", "c1"], 1), ("a", "R", "b", 2, ["c2"], 2), ("a", "R", "b", 3, None, 3)], "src string, rel string, dst string, start_year int, evidence array<string>, seq int")
    one = graph.merge_edges(rows.unionByName(rows), "seq").collect()
    assert len(one) == 1 and one[0]["start_year"] == 3 and one[0]["evidence"] == ["c1", "c2"] and one[0]["id"] == "rel:a:R:b"
    nodes = spark.createDataFrame([("1", "X", 10), ("2", "X", None), ("3", "Y", 5), ("4", None, None), ("5", None, None)], "id string, name string, start_year int")
    assert {r["id"]: r["display_name"] for r in graph.display_names(nodes).collect()} == {"1": "X (10)", "2": "X", "3": "Y", "4": None, "5": None}


def test_periods(spark):
    dim = spark.createDataFrame([("p1", "Một", 0, 10, False, 1), ("p2", "Hai", 10, 20, False, 2), ("p3", "Ba", 5, 30, True, 3), ("p4", "Bốn", 40, 50, False, 4)], "id string, name string, start_year int, end_year int, parallel boolean, position int")
    rows = spark.createDataFrame([("a", 10, None, []), ("b", None, None, ["p2", "x"]), ("c", 35, 38, []), ("d", 8, 19, ["p1"])], "id string, start_year int, end_year int, period_ids array<string>")
    got = {(r["id"], r["period_id"]) for r in periods.in_period(rows, dim).collect()}
    assert got == {("a", "p1"), ("a", "p2"), ("a", "p3"), ("b", "p2"), ("d", "p1"), ("d", "p2"), ("d", "p3")}
    wide = periods.interval_join(rows.drop("period_ids"), dim, dim_rows=10**9, width=7).select("id", "p_id").collect()
    assert sorted((r[0], r[1]) for r in wide) == sorted((r[0], r[1]) for r in periods.interval_join(rows.drop("period_ids"), dim).select("id", "p_id").collect())
    assert [(r["gap_start"], r["gap_end"]) for r in periods.gaps(dim).collect()] == [(31, 39)]
    assert [(r["id"], r["next_id"]) for r in periods.chain(dim).orderBy("id").collect()] == [("p1", "p2"), ("p2", "p4"), ("p4", None)]
    articles = rows.select("id", "start_year", "end_year").withColumn("seed_period", F.when(F.col("id") == "c", "p9")).withColumn("hint_periods", F.when(F.col("id") == "a", F.array(F.lit("p3"))).otherwise(F.array().cast("array<string>")))
    assert {r["id"]: r["period_id"] for r in periods.main_period(articles, dim, "id").collect()} == {"a": "p3", "b": None, "c": "p9", "d": "p2"}


def test_search_and_fusion(spark):
    docs = spark.createDataFrame([("1", "trận Bạch Đằng"), ("2", "sông Bạch Đằng sông"), ("3", None), ("4", ""), ("5", "AND ( \" ~")], "id string, text string")
    asked = spark.createDataFrame([("q", 'Bạch Đằng: "sông"?'), ("e", "")], "query_id string, query string")
    got = search.bm25_topk(asked, docs, 5).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [("q", "2"), ("q", "1")]
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 2.0]), ("3", None), ("4", [0.0, 0.0]), ("5", [3.0, 0.0])], "id string, vector array<double>")
    near = search.vector_topk(spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<double>"), vectors, 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in near] == [("1", 1.0), ("5", 1.0)]
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, id string, rank int")
    fused = search.rrf([(a, 1.0), (b, 1.0), (a, 0.0)])
    assert [r["id"] for r in fused.orderBy("rank").collect()] == ["y", "x", "z"]
    boosted = search.boost_evidence(fused, spark.createDataFrame([("q", "z")], "query_id string, id string"), factor=3.0)
    assert [r["id"] for r in boosted.orderBy("rank").collect()] == ["z", "y", "x"]
    assert DEFAULT.weights("relational") == (0.2, 0.4, 0.4) and DEFAULT.weights("?", "vector") == (1.0, 0.0, 0.0) and DEFAULT.weights("?") == (0.5, 0.5, 0.0)


def test_validation(spark):
    rows = [
        ("Nguyễn Huệ", "COMMANDED", "Trận Ngọc Hồi", "Nguyễn Huệ chỉ huy trận", 1789, 1789, 0.9, "Năm ấy  Nguyễn Huệ chỉ huy trận.", "Person", "Event"),
        ("A", "COMMANDED", "B", "không có", 1950, 1940, 0.5, "khác hẳn", "Person", "Place"),
        (None, "RELATED_TO", "B", None, None, None, None, None, None, None),
        ("", None, "", "", None, None, None, "", None, None),
    ]
    df = spark.createDataFrame(rows, "head string, relation string, tail string, evidence string, start_year int, end_year int, confidence double, chunk_text string, head_type string, tail_type string")
    got = [sorted(r["reasons"]) for r in extract.reasons(df).collect()]
    assert [] in got and sorted(["tail_type_invalid", "evidence_not_in_chunk", "low_confidence", "after_1945", "start_year_gt_end_year"]) in got
    assert sorted(["head_or_tail_missing", "relation_not_in_ontology", "evidence_not_in_chunk"]) in got and sorted(["head_or_tail_missing", "relation_missing", "evidence_not_in_chunk"]) in got


def test_structured(spark):
    labels = "map<string,struct<label:string>>"
    articles = spark.createDataFrame([("Vua", 1, 1000, 1050, {"P22": ["Q1"], "P40": ["Q2"], "P999": ["Q3", "Q4"]}, {"Q1": ("Cha",), "Q2": ("Vua",)})], f"title string, page_id long, start_year int, end_year int, rels map<string,array<string>>, labels {labels}")
    got = {(r["head"], r["relation"], r["tail"]) for r in extract.from_wikidata(articles).collect()}
    assert got == {("Vua", "CHILD_OF", "Cha")}
    assert [(r["prop"], r["n"]) for r in extract.unmapped_properties(articles).collect()] == [("P999", 2)]
    boxes = spark.createDataFrame([("Trận", 2, None, None, "Hộp thông tin xung đột quân sự", {"chỉ huy 1": "A (x)\nB\nkhông rõ", "lạ": "z"})], "title string, page_id long, start_year int, end_year int, template string, fields map<string,string>")
    assert {(r["head"], r["relation"], r["tail"]) for r in extract.from_infobox(boxes).collect()} == {("A", "COMMANDED", "Trận"), ("B", "COMMANDED", "Trận")}
    rulers = spark.createDataFrame([("g", 1, "A"), ("g", 2, "A"), ("g", 3, "B")], "g string, n int, name string")
    assert [(r["head"], r["tail"]) for r in extract.succession(rulers, "g", "n").collect()] == [("B", "A")]


def test_resolution(spark):
    rows = [(1, "Trận Bạch Đằng", "Event", 938, None, []), (2, "Trận Bạch Đằng", "Event", 1288, None, []), (3, "Trận Bạch Đằng", "Event", 939, None, []), (4, "Hoa Lư", "Place", None, None, ["Kinh đô Hoa Lư"]), (5, "kinh đô  hoa lư", "Place", None, None, []), (6, "Hoa Lư", "Person", None, None, []), (7, "X", "Person", None, "Q9", ["Y"]), (8, "Y", "Person", None, None, [])]
    df = spark.createDataFrame(rows, "seq long, name string, type string, start_year int, qid string, aliases array<string>").withColumn("g", F.lit("all"))
    got = {r["seq"]: r["entity_id"] for r in resolve.resolve_mentions(df, "g").collect()}
    assert got[1] == "local:tran-bach-dang-938" and got[2] == "local:tran-bach-dang-1288" and got[3] == got[1]
    assert got[4] == got[5] == "local:hoa-lu" and got[6] == "local:hoa-lu-person" and got[7] == got[8] == "qid:Q9"
    names = spark.createDataFrame([("1", "lý thường kiệt công", "Person", None), ("2", "lý thường kiệt công ạ", "Person", None), ("3", "lý thường kiệt công", "Place", None)], "id string, name string, type string, start_year int")
    assert [(r["id_a"], r["id_b"]) for r in resolve.fuzzy_pairs(names).collect()] == [("1", "2")]


def test_resolution_across_letters(spark):
    # Aliases and near names under another first letter, and near names without a common word; as one pass over all.
    rows = [(1, "Đề Thỏng", "Person", None, None, ["Lữ Lụng Thảo Thỏng"]), (2, "Lữ Lụng Thảo Thỏng", "Person", None, None, []), (3, "Thăngxlongkinhthành", "Place", None, None, []), (4, "Zthăngxlongkinhthành", "Place", None, None, []), (5, "Ông lý thường kiệt công", "Person", None, None, []), (6, "lý thường kiệt công ông", "Person", None, None, []), (7, "Hoa Lư", "Place", None, None, None), (8, "", None, None, None, [])]
    df = spark.createDataFrame(rows, "seq long, name string, type string, start_year int, qid string, aliases array<string>").withColumn("g", F.lit("all"))
    got, one = ({r["seq"]: r["entity_id"] for r in resolve.resolve_mentions(df, g).collect()} for g in (None, "g"))
    assert got == one and got[1] == got[2] and got[3] == got[4] and got[5] == got[6] and len(set(got.values())) == 5


def test_resolution_of_many_groups(spark):
    # Thousands of groups aren't a call of Python each, and one that goes on from batch to batch stays one; repeats aren't held again.
    rows = [(i, f"Hoa Lư {i % 3000:04}" if i % 2 else "Đại Việt", "Place", None, f"Q{i % 3000}" if i % 2 else None, ["Đại  Việt xưa"] if not i % 4 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "seq long, name string, type string, start_year int, qid string, aliases array<string>").withColumn("g", F.when(F.col("seq") % 2 == 1, F.col("seq") % 3000))
    resolved = resolve.resolve_mentions(df, "g")
    assert "FlatMapGroups" not in resolved._jdf.queryExecution().toString()
    got = {r["seq"]: r["entity_id"] for r in resolved.collect()}
    assert got == {i: f"qid:Q{i % 3000}" if i % 2 else "local:dai-viet" for i in range(6000)}
    resolver = resolve.Resolver()
    assert {resolver.resolve("Đại Việt", "Place", None, None, "local:x", ["Đại Việt xưa"]) for _ in range(50)} == {"local:x"} and len(resolver.by_type["Place"]) == 2


def test_fuzzy_pairs_whole(spark):
    # No common word, blanks that aren't counted, repeated words, words put elsewhere, years of events; few comparisons in a crowd of one word.
    rows = [("1", "Thăngxlongkinhthành", "Place", None), ("2", "Zthăngxlongkinhthành", "Place", None), ("3", "ly\t \t    thai     to", "Person", None), ("4", "ly thai to", "Person", None), ("5", "lan lan", "Person", None), ("6", "lan lam", "Person", None)]
    rows += [("7", "khởi nghĩa ba đình lớn a", "Event", 1886), ("8", "a khởi nghĩa ba đình lớn", "Event", 1887), ("9", "khởi nghĩa ba đình lớn a", "Event", 1889), ("A", "khởi nghĩa ba đình lớn a", "Event", None)]
    draw = random.Random(1)
    crowd = [(f"c{i}", "khương " + " ".join(draw.choice("bcdghklmnpqrstvx") + draw.choice("aeiouyăâêôơưàèìòùáé") + draw.choice("cmnpt") for _ in range(3)), "Person", None) for i in range(400)]
    df = spark.createDataFrame(rows + crowd, "id string, name string, type string, start_year int")
    named = [(r[0], " ".join(r[1].lower().split()), r[2]) for r in rows[:6] + crowd]
    want = {(a, b) for a, x, t in named for b, y, u in named if a < b and t == u and (t != "Person" or a[0] == b[0] == "c" or "c" not in a[0] + b[0]) and mean_ratio(x, y) >= 92}
    got = {(r["id_a"], r["id_b"]) for r in resolve.fuzzy_pairs(df).collect()}
    assert got == want | {("7", "8")} and {("1", "2"), ("3", "4"), ("5", "6")} <= got
    names = df.where("type = 'Person'").select("type", F.lower("name").alias("_n")).distinct()
    assert resolve._near_names(names, resolve.DEFAULT).where("_x <> _y").count() < 4000  # of 79,800 that share the word


def test_selection(spark):
    kind, chosen = collect.profile("era:e1", [{"id": "p", "era_id": "e1"}, {"id": "q", "era_id": "e2"}])
    assert kind == "era" and [p["id"] for p in chosen] == ["p"] and collect.profile("mini", [])[0] == "mini"
    with pytest.raises(ValueError):
        collect.profile("period:none", [])
    dim = spark.createDataFrame([("p", 1), ("q", 2)], "id string, quota int")
    assert {r["period_id"]: r["cap"] for r in collect.quotas(dim, "full", 10).collect()} == {"p": 3, "q": 7}
    tree = spark.createDataFrame([("root", "A", False), ("root", "sub", True), ("sub", "B", False), ("sub", "root", True)], "category string, member string, is_category boolean")
    assert {r["page"] for r in collect.categories_below(tree, "root", 2).collect()} == {"A", "B"}


def test_context(spark):
    ranked = spark.createDataFrame([("q", i, 500) for i in range(1, 6)] + [("z", 1, 5000)], "query_id string, rank int, tokens int")
    assert sorted((r["query_id"], r["n"]) for r in context.within_budget(ranked).collect()) == [("q", 1), ("q", 2), ("z", 1)]
    trips = spark.createDataFrame([("q", "e", "A", "CHILD_OF", "b", None, 1228, ["c1", "c9"])], "query_id string, edge_id string, head string, rel string, tail string, role string, start_year int, evidence array<string>")
    cited = spark.createDataFrame([("q", 3, "c1")], "query_id string, n int, id string")
    assert context.relation_lines(trips, cited).first()["line"] == "A —CHILD_OF(1228)→ b [3]"


def test_sources(spark, tmp_path):
    schema = "id string, v int"
    assert files.read_json_lines(spark, f"{tmp_path}/none", schema).count() == 0
    (tmp_path / "a.jsonl").write_text('{"id":"1","v":1}\n\n{"id":"2"}\n')
    rows = files.read_json_lines(spark, f"{tmp_path}/*.jsonl", schema)
    assert sorted((r["id"], r["v"]) for r in rows.collect()) == [("1", 1), ("2", None)]
    table = f"{tmp_path}/t"
    files.merge_partitions(spark, spark.createDataFrame([("1", "p", 1), ("2", "p", 1)], "id string, part string, v int"), table, "id", "part")
    files.merge_partitions(spark, spark.createDataFrame([("1", "q", 2)], "id string, part string, v int"), table, "id", "part")
    assert sorted((r["id"], r["part"], r["v"]) for r in spark.read.parquet(table).collect()) == [("1", "q", 2), ("2", "p", 1)]
    answers = tmp_path / "pages.json"
    answers.write_text('{"title":"A","page_id":1,"wikitext":"x"}\n{"title":"B","redirect":"A"}\n')
    spark.dataSource.register(PageSource)
    got = spark.read.format("pages").option("titles", '["A","B","C"]').option("answers", str(answers)).load().collect()
    assert [(r["requested"], r["title"], r["missing"]) for r in got] == [("A", "A", False), ("B", "A", False), ("C", None, True)]
    calls = []
    cache = DiskCache(f"{tmp_path}/cache")
    for _ in range(2):
        assert cache.get("api", {"b": 1, "a": 2}, lambda: calls.append(1) or {"x": 1}) == {"x": 1}
    assert calls == [1]
    with pytest.raises(ValueError):
        files.unique(spark.createDataFrame([("1",), ("1",)], "id string"), "id")


def test_latest(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), ("a", 2, "z"), (None, 9, "n"), ("b", None, "k")], "id string, t int, v string")
    assert {r["id"]: r["v"] for r in latest(rows, "id", "t").collect()} == {"a": "z", "b": "k"}
    assert latest(rows.limit(0), "id", "t").count() == 0


def test_stream_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "t") for i in range(20)], "id string, text string")
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    work = lambda df: df.withColumn("error", F.when(F.col("id") == "7", "bad"))
    for part in (rows.where("id < '15'"), rows.where("id >= '12'")):
        part.write.mode("append").parquet(source)
        extract_stream(spark, source, "id string, text string", sink, f"{tmp_path}/cp", work, dead=f"{tmp_path}/dead").awaitTermination()
    got = [r["id"] for r in spark.read.parquet(sink).collect()]
    assert len(got) == len(set(got)) == 19 and spark.read.parquet(f"{tmp_path}/dead").count() == 1


def test_build():
    ran = []
    steps = {s: (lambda s=s: ran.append(s)) for s in pipeline.STAGES}
    assert pipeline.build(steps, skip_to="resolve") == ["resolve", "load", "embed"] == ran
    assert pipeline.build(steps, dry_run=True) == list(pipeline.STAGES) and len(ran) == 3
    with pytest.raises(ValueError):
        pipeline.build(steps, skip_to="nothing")
    with pytest.raises(RuntimeError):
        pipeline.build({"parse": lambda: 1 / 0})


def test_browse(spark, edges):
    nodes = spark.createDataFrame([(x, x.upper(), "Person", None) for x in "abcdefh"] + [("i", "I", "Event", 5)], "id string, name string, type string, start_year int")
    got = {r["id"]: r["neighbours"] for r in browse.neighbours(edges, nodes, nodes.select("id")).collect()}
    assert got["d"] == ["B", "C"] and got["i"] == [] and got["a"] == ["B", "C", "H"]
    none = spark.createDataFrame([], "id string, period_id string")
    assert [r["id"] for r in browse.entities(nodes, graph.degrees(edges), none, limit=2).collect()] == ["a", "b"]
