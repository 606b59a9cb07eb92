import unicodedata

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annales.llm import leakage, markup, names, neighbours, spam, survivor
from annales.llm.leakage import leaked_items
from annales.llm.markup import blocks, clean, marked_blocks
from annales.llm.mixing import mix_shares, mix_sources, pfair_pattern, source_sizes
from annales.llm.names import name_links, same_names
from annales.llm.neighbours import hadamard, similar_vectors
from annales.llm.spam import spam_scores
from annales.llm.splitting import split_oversized, split_text
from annales.llm.survivor import consensus, field_values, nearest, survivors
from annales.llm.tokens import token_count
from annales.llm.visual import canonical


def clashing(df):
    """The table with extra columns named like ones used inside the operators."""
    return df.withColumns({c: F.lit("x") for c in ("_key", "_text", "_value", "vid", "doc", "_row", "rank", "_n", "score", "kind") if c not in df.columns})


# 1 markup


def found(text):
    return {(k, b) for k, b, _ in blocks(text) if k != "text"}


def test_markup_languages():
    same = {("heading", "Mục & hai"), ("list_item", "Một hai"), ("list_item", "ba"), ("code", "a < 1; * x"), ("formula", "x^2")}
    wiki = "{{Thông tin x|a=[[b]]\n* c}}\nĐầu.<ref>\n* d</ref>\n== Mục & [[a|hai]] ==<!-- == z == -->\n* '''Một''' [http://x hai]\n**ba<ref name=q />\n<pre>a < 1;\n* x</pre>\n<math>x^2</math>\n<nowiki>* không</nowiki>\n[[Thể loại:A]]\n{|\n|-\n* bảng\n|}"
    html_ = "<h1>Tên</h1><h2 class='a'>Mục &amp; <b>hai</b></h2><ul><li>Một&nbsp;hai<ul><li>ba</ul></ul><pre><code>a &lt; 1;\n* x</code></pre>\\(x^2\\)<script>'<h2>x</h2>'</script><!-- <li>y</li> -->"
    md = "# Tên\n\n## Mục & [hai](<http://x y> \"t\") ##\n\n- *Một* [hai][1]\n  - __ba__\n\n```c\na < 1;\n* x\n```\n\nTa có $x^2$ nhé.\n\n[1]: http://a"
    tex = "\\documentclass{a}\n% \\section{z}\n\\begin{document}\\section*{Mục \\& \\textbf{hai}}\\label{s}\n\\begin{itemize}\n\\item {\\bf Một}~hai\\footnote{k}\n\\begin{enumerate}\\item ba\\cite{q}\\end{enumerate}\\end{itemize}\n\\begin{verbatim}\na < 1;\n* x\n\\end{verbatim}\n\\[ x^2 \\]\n\\end{document}"
    for text in (wiki, html_, md, tex, wiki.replace("\n", "\r\n"), md.replace("\n", "\r\n")):
        assert found(text) == same, text
    assert found("Mục\n---\n\nGiá 3 < 5 quan, bản số #12. Tiền $5; tên_cũ\n1) a\n2. b") == {("heading", "Mục"), ("list_item", "a"), ("list_item", "b")}


def test_markup_odd():
    for text in (None, "", "  ", "<pre>mở", "{{mở", "[[", "$$", "``` x", "\\begin{itemize}\\item", "<li>", "== ==", "\x02\x03 9", "<h2>x", "*" * 5000, "[" * 5000):
        blocks(text)
    assert clean(None) is None and clean("") == "" and found("<h2>x") == {("heading", "x")}
    assert "## A" in clean("== A ==\nMột đoạn văn đủ dài để được giữ lại trong văn bản sạch vì nó có nhiều từ và của là các.")


def test_two_passes():
    assert markup.second_pass(["good", "short", "good", "short", "bad", "near", "bad"]) == ["good", "good", "good", "bad", "bad", "bad", "bad"]
    assert markup.second_pass(["short"]) == ["good"] and markup.second_pass([]) == []


def test_markup_table(spark):
    df = spark.createDataFrame([(1, "== A ==\n* b"), (1, "== A ==\n* b"), (2, None), (3, ""), (None, "== C ==")], "revision_id long, wikitext string")
    got = marked_blocks(clashing(df)).collect()
    assert sorted((r["revision_id"], r["kind"], r["body"]) for r in got) == [(1, "heading", "A")] * 2 + [(1, "list_item", "b")] * 2
    assert marked_blocks(df.limit(0)).count() == 0


# 1 labels


def _labelled_page(rng, wiki):
    """A page of paragraphs between planted menus, link rows and notices, and which of its text blocks are prose."""
    prose = ["Năm ấy các bô lão trong làng đã họp lại ở đình để bàn về việc sửa con đê, vì nước lũ dâng cao và không ai muốn mất mùa thêm một lần nữa.", "The garrison rebuilt the old ferry landing near the market, and the envoys that came in the spring said it was the best they had seen on the river.", "Khi thành bị phá thì người dân của bảy làng dời lên núi, còn những người ở lại thì lập một ngôi miếu nhỏ để thờ các vị đã mất trong trận ấy."]
    noise = ["[[Trang chủ]] | [[Giới thiệu]] | [[Liên hệ]] | [[Bản đồ]]", "[[Đăng nhập]] [[Đăng ký]] [[Giỏ hàng]] [[Tìm kiếm]]", "Bản quyền 2020", "[https://a.example Chia sẻ] [https://b.example In trang] [https://c.example Gửi thư]"]
    parts = [(noise[int(i)], False) for i in rng.integers(len(noise), size=2)] + [(prose[int(i)], True) for i in rng.integers(len(prose), size=int(rng.integers(2, 6)))] + [(noise[int(i)], False) for i in rng.integers(len(noise), size=3)]
    return "\n\n".join(p if wiki else p.replace("[[", "[").replace("]]", "](x)") if "[[" in p else p for p, _ in parts), [good for _, good in parts]


def test_planted_menus_are_told_from_prose():
    rng = np.random.default_rng(2)
    seen = {True: [], False: []}
    for n in range(200):
        text, good = _labelled_page(rng, n % 2 == 0)
        labels = [label for kind, _, label in blocks(text) if kind == "text"]
        assert len(labels) == len(good), text
        for label, is_good in zip(labels, good):
            seen[is_good].append(label == "good")
    # Prose that is kept, and menus that are dropped, of 200 pages.
    assert np.mean(seen[True]) >= 0.98 and 1 - np.mean(seen[False]) >= 0.98


# 2 neighbours


def brute(vectors, k, least):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    out = set()
    for i, a in enumerate(ids):
        near = sorted(((-round(float(m[i] @ m[j]), 6), b) for j, b in enumerate(ids) if i != j))[:k]
        out |= {(a, b) for s, b in near if -s >= least}
    return out


@pytest.mark.parametrize("crowded", [20_000, 40])
def test_neighbours(spark, crowded):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    vectors = {f"{i}-{j}": (base[i] + 0.2 * rng.normal(size=64)) * rng.uniform(0.1, 9) for i in range(60) for j in range(4)}
    vectors |= {f"copy-{j:02d}": base[0] * (1 + j) for j in range(30)}
    rows = [(k, [float(x) for x in v], 1) for k, v in vectors.items()] + [("null", None, 1), ("short", [1.0] * 32, 1), ("zero", [0.0] * 64, 1), ("nan", [float("nan")] * 64, 1), ("hole", [None] * 64, 1), (None, [1.0] * 64, 1), ("0-0", [1.0] * 64, 0)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, load_seq int")
    got = {(r["id"], r["other"]) for r in similar_vectors(clashing(df), k=3, least=0.6, order=("load_seq",), crowded_at=crowded).collect()}
    want = brute(vectors, 3, 0.6)
    assert len(got & want) >= 0.97 * len(want) and not {i for p in got for i in p} & {"null", "short", "zero", "nan", "hole"}
    assert ("copy-05", "copy-00") in got and all(a != b for a, b in got)


def test_neighbours_empty(spark):
    df = spark.createDataFrame([], "id string, embedding array<float>")
    assert similar_vectors(df).count() == 0
    h = hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


@pytest.mark.parametrize("second", [0, 1, 2, 4, 8, 16, 32, 64])
def test_far_neighbours_meet(second):
    # Directions in loose families: the five nearest are far from 0.85 and must share a bucket with the searcher in 9 of 10 cases.
    rng = np.random.default_rng(3)
    unit = np.repeat(rng.normal(size=(2500, 64)), 8, axis=0) + rng.normal(size=(20000, 64)) * 1.0
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    close = unit[::200] @ unit.T
    close[np.arange(100), np.arange(0, 20000, 200)] = -2
    nearest = np.argsort(-close, axis=1)[:, :5]
    own = neighbours.codes(unit, second, probes=0)[0]
    tried = np.concatenate([own[::200][:, :, None], neighbours.codes(unit[::200], second, probes=neighbours.probes_for(second, -1.0))[1]], axis=2)
    met = (own[nearest][:, :, :, None] == tried[:, None]).any(axis=(2, 3))
    assert met.mean() >= 0.9


def test_few_search(spark):
    rng = np.random.default_rng(4)
    unit = np.repeat(rng.normal(size=(50, 64)), 8, axis=0) + rng.normal(size=(400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"{i:03}", u.tolist()) for i, u in enumerate(unit)], "id string, embedding array<double>")
    got = similar_vectors(df, queries=df.where("id < '040'").select("id")).collect()
    close = unit @ unit.T - 3 * np.eye(400)
    true = {(i, j) for i in range(40) for j in np.argsort(-close[i])[:5]}
    assert {r["id"] for r in got} == {f"{i:03}" for i in range(40)} and len(got) == 200
    assert len(true & {(int(r["id"]), int(r["other"])) for r in got}) >= 0.9 * len(true)


# 3 names


def _ways(x, y):
    """Ways in which two names meet."""
    one, two = ({c & ~1: c & 1 for c in sorted(names.form_codes(n), reverse=True)} for n in (x, y))
    return {names.WAYS.get(((f & 15) >> 1, one[f] + two[f])) for f in one.keys() & two.keys()} - {None}


def test_rewritings():
    for way, a, b in (
        (names.WHOLE, "Tạ Phừng Mỏng Thời", "Taj Phuwngf Mongr Thowif"), (names.WHOLE, "Bàng Sòi Nhoài Dướng", "Bang2 Soi2 Nhoai2 Du7o7ng1"), (names.WHOLE, "Thạch Tợi Báng Đấm", "Báng Đấm, Thạch Tợi"),
        (names.INITIALED, "Quách Lào Sựng Nhoan", "Q. L. Sựng Nhoan"), (names.LETTERED, "Học xã Khuyến Nông Doai Trăn", "Học xã KN Doai Trăn"), (names.LETTERED, "Học xã Khuyến Nông Doai Trăn", "H.X.K.N.D.T."),
        (names.WHOLE, "Bá Học Khê Voãi", "Cụ Bá Học Khê Voãi (古城)"), (names.NICKNAMED, "Nghiêm Phải Voái Soại", "Chánh Soại"), (names.RUN_ON, "Khương Rán Khai Nỏng", "KhươngRán Khainỏng"),
        (names.REPLACED, "Lữ Vão Troại Xiễn", "Lữ Dão Troại Xiễn"), (names.MISSING, "Quách Dổng Thàm Phung", "Quách Thàm Phung"), (names.MISSING, "Chử Hàm Khão Xùng", "Chử Khão Xùng"), (names.TWO, "Phí Tền Sẩm Phào", "phi tne sam puao"),
    ):
        assert way in _ways(a, b), (a, b, _ways(a, b))
    assert not _ways("Nghiêm Phải Voái Soại", "Lữ Dão Troại Soại") and not _ways("Lữ Vão Troại Xiễn", "Tạ Phừng Mỏng Thời")
    assert names.form_codes("") == () == names.form_codes("!!")
    assert len(names.form_codes("Moi Lan " * 20_000)) < 50_000


def _people(spark):
    d = "Người Chình Xầm; võ tướng, từng đòi lại mấy chục mẫu dâu."
    rows = [
        ("a", 1, "Thạch Tợi Báng Đấm", None, "Person", d, 1430, 1460), ("b", 2, "Báng Đấm, Thạch Tợi", [], None, None, 1429, 1460), ("c", 3, "T. T. Báng Đấm", [], "Person", "Quê Chình Xầm.", None, 1461),
        ("d", 4, "Thạch Tợi Báng Đấm", [], "Person", "Quê Xủng Sần.", 1700, 1760), ("f", 6, "Thạch Tợi Báng Đấm", [], "Place", d, 1430, 1460),
        ("g", 7, None, None, None, None, None, None), ("a", 8, "Thạch Tợi Báng Đấm", ["x"], "Person", None, 0, 99999), (None, 9, "Z", None, None, None, None, None), ("a", 1, "Thạch Tợi Báng Đấm", None, "Person", d, 1430, 1460),
        # One agreeing year, or nothing but the name, and no contradiction.
        ("m", 10, "Quách Thàm Dổng Phung", [], "Person", None, 1500, None), ("n", 11, "Quách Thàm Dổng Phung", None, "Person", "Quê Xủng Sần.", 1501, None), ("q", 12, "Phí Tền Sẩm Phào", [], "Person", None, None, None), ("r", 13, "phi ten sam phao", [], "Person", "", None, None),
    ]
    # Other people, each under two ids in another order of tokens, a tenth with a namesake of other times and places.
    rng = np.random.default_rng(5)
    syllables = [a + b for a in ("Kh", "L", "M", "Ng", "S", "T", "V", "X") for b in ("an", "ech", "im", "oang", "uy", "ong")]
    filler = []
    for i in range(150):
        w, year, place = rng.choice(syllables, 4), int(rng.integers(900, 1900)), " ".join(rng.choice(syllables, 2))
        for j, name in enumerate((" ".join(w), f"{w[2]} {w[3]}, {w[0]} {w[1]}", " ".join(w))[: 3 if i % 10 == 0 else 2]):
            filler.append((f"z{i}-{j}", 100 + 3 * i + j, name, [], "Person", f"Quê {place if j < 2 else ' '.join(rng.choice(syllables, 2))}.", year + 400 * (j == 2), None if i % 3 else year + 40 + 400 * (j == 2)))
    return spark.createDataFrame(rows + filler, "id string, rec_id long, name string, aliases array<string>, type string, description string, start_year int, end_year int")


def test_names(spark):
    got = {(r["id_a"], r["id_b"]) for r in same_names(clashing(_people(spark))).collect()}
    assert {p for p in got if not p[0].startswith("z")} == {("a", "b"), ("a", "c"), ("b", "c"), ("m", "n"), ("q", "r")}
    assert {p for p in got if p[0].startswith("z")} == {(f"z{i}-0", f"z{i}-1") for i in range(150)}
    assert name_links(_people(spark).limit(0)).count() == 0


def test_crowded_names(spark):
    # Sixty namesakes of one place, of as many years, lie between two records of one year and place.
    crowd = [(f"c{i:02}", "Thạch Tợi Báng", "Quê Chình Xầm.", 1000 + 10 * i) for i in range(60)] + [("u", "Thạch Tợi Báng", "Quê Chình Xầm.", 1900), ("v", "Thạch Tợi Báng", "Quê Chình Xầm.", 1901)]
    filler = [(f"z{i:03}", f"Khương {chr(97 + i % 26)}{chr(97 + i // 26)}a Moi Lan", "Quê Vùng Xa.", 100 + i) for i in range(600)]
    df = spark.createDataFrame([(i, n, [], "Person", d, y, None) for i, n, d, y in crowd + filler], "id string, name string, aliases array<string>, type string, description string, start_year int, end_year int")
    assert [(r["a"], r["b"]) for r in name_links(df).collect() if not r["a"].startswith("z")] == [("u", "v")]
    # All that meet are compared, whatever the blocks; the surest way and the rarest form count.
    rows = [(k, f"{i:02}", kind, 0, n) for k, kind, n in ((1, names.BAG, 17), (2, names.BAG, 2), (3, names.STYLE, 1), (4, names.INITIALS, 3)) for i in range(n)]
    got = names._met(spark.createDataFrame(rows, "key long, id string, kind int, partial int, n int"), 3).collect()
    assert {(r["a"], r["b"]): r["stratum"] for r in got} == {(f"{i:02}", f"{j:02}"): 1 if j < 2 else 4 for i in range(17) for j in range(i + 1, 17)} and len(got) == 136


def test_names_of_many_ids_meet_without_a_fact(spark):
    # Twenty ids of one name: most share a place, one tells nothing.
    crowd = [(f"c{i:02}", "Thạch Tợi Báng Đấm", "Quê Chình Xầm.") for i in range(18)] + [("u", "Thạch Tợi Báng Đấm", None), ("v", "Thạch Tợi Báng Đấm", "Quê Chình Xầm.")]
    filler = [(f"z{i:03}", f"Khương {chr(97 + i % 26)}{chr(97 + i // 26)}a Moi Lan", "Quê Vùng Xa.") for i in range(300)]
    df = spark.createDataFrame([(i, n, [], "Person", d, None, None) for i, n, d in crowd + filler], "id string, name string, aliases array<string>, type string, description string, start_year int, end_year int")
    got = {(r["id_a"], r["id_b"]) for r in same_names(df).collect() if not r["id_a"].startswith("z")}
    assert got == {(a, b) for a, *_ in crowd for b, *_ in crowd if a < b}
    # A rare phrase in common is a fact, too.
    told = [("u", "Thạch Tợi Báng Đấm", "thợ rèn mù một mắt"), ("v", "Thạch Tợi Báng Đấm", "thợ rèn mù một mắt")] + [(f"c{i:02}", "Thạch Tợi Báng Đấm", f"Quê Vùng {chr(65 + i)}a.") for i in range(18)]
    filler = [(f"z{i:04}", f"Khương {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}a Moi Lan", f"Quê Núi {chr(97 + i % 30 % 26)}{chr(97 + i % 30 // 26)}a.".title()) for i in range(900)]
    df = spark.createDataFrame([(i, n, [], "Person", d, None, None) for i, n, d in told + filler], "id string, name string, aliases array<string>, type string, description string, start_year int, end_year int")
    assert [(r["a"], r["b"]) for r in name_links(df).collect() if not r["a"].startswith("z")] == [("u", "v")]


def test_name_weights():
    # 900 pairs of namesakes of whom a third agree in their years, and as many random pairs: shares and weights follow the data.
    rows = [(1, 8, 0, 0, 0, 300), (1, 4, 0, 0, 0, 590), (1, 8, 0, 0, 2, 1), (65 * 9, 8, 0, 0, 0, 5), (65 * 9, 4, 0, 0, 0, 5000)]
    cells = pd.DataFrame(rows, columns=["stratum", "years", "places", "told", "types", "n"])
    odds = names.weights(cells, {})
    assert odds[0] > 3 and odds[1] < -3 and odds[0] > odds[3] and odds[4] < odds[1]
    # Where only pairs with a common fact were compared, the share counts over all pairs.
    assert names.weights(cells, {65 * 9: 1e6})[3] < odds[3]


# 4 splitting


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\u0301#é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_split_round_trip(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[n:e] for _, n, e, _ in pieces) == text
    assert all(e - s <= limit and n - s <= overlap and s <= n for s, n, e, _ in pieces)
    assert all(e > n for _, n, e, _ in pieces) or text == ""


def test_split_boundaries():
    text = "A" * 30 + "\n\n" + "B. " * 10 + "\n## C\n" + "D" * 30
    pieces = split_text(text, 70, 0)
    assert text[pieces[0][0] : pieces[0][2]].endswith("\n") and text[pieces[1][0] :].startswith("## C")
    assert len(split_text("x" * 2400)) == 1 and len(split_text("x" * 2401)) == 2


def test_split_table(spark):
    rows = [("a", "s", "câu một. " * 600, 1), ("a", "t", "câu hai. " * 600, 2), ("b", None, "ngắn", 1), ("c", None, None, 1), ("d", None, "", 1), (None, None, "x" * 3000, 1), ("e", None, "y" * 200_000, 1)]
    df = spark.createDataFrame(rows, "id string, section_path string, text string, load_seq int")
    got = split_oversized(clashing(df), order=("load_seq",)).collect()
    assert {r["id"] for r in got} == {"a", "b", "c", "d", "e"} and {r["section_path"] for r in got if r["id"] == "a"} == {"t"}
    assert all(r["text"] is None or len(r["text"]) <= 2400 for r in got) and sum(len(r["text"]) - r["overlap_chars"] for r in got if r["id"] == "e") == 200_000
    assert {r["id"] for r in split_oversized(df, order=("load_seq",), only_oversized=True).collect()} == {"a", "e"}
    assert split_oversized(df.limit(0)).count() == 0


# 5 survivors


def test_consensus_of_planted_groups(spark):
    # 300 groups: a description told rightly by three records, with single words lost, changed or added by four others, one of them the most trusted.
    rng = np.random.default_rng(8)
    vocabulary = [a + b for a in ("kh", "l", "m", "ng", "s", "t") for b in ("an", "ech", "im", "oang", "uy")]
    rows, truth = [], {}
    for g in range(300):
        words = list(rng.choice(vocabulary, 12))
        truth[str(g)] = " ".join(words)
        for k in range(7):
            told, at = list(words), int(rng.integers(12))
            if k >= 3:
                told[at : at + 1] = [[], ["sai"], [words[at], "thua"]][int(rng.integers(3))]
            rows.append((str(g), "description", " ".join(told), 10 * g + k, 3 if k == 6 else 2, None))
    values = spark.createDataFrame(rows, "id string, field_name string, value string, rec_id long, trust int, updated_at timestamp")
    right = lambda weights: sum(r["value"] == truth[r["id"]] for r in survivors(values, weights).collect())
    assert right("additive") == 300 and right("priority") < 30


def test_consensus():
    assert consensus(["a b c", "a x c", "a b c d"], [1, 1, 1]) == ["a", "b", "c"]
    assert nearest(["a x c", "a b c", "a b d"], [1, 1, 1]) in (1, 0) and nearest(["a b", "c d"], [1.0, 0.5]) == 0


def test_survivors(spark):
    day = "2024-01-0"
    rows = [
        ("g", 1, "Một người.", 1000, 1050, "low", day + "3"), ("g", 2, "đang cập nhật", 1001, 900, "high", day + "1"), ("g", 3, "Vua nước.", 0, 1051, "high", None), ("g", 4, "Vua nước.", None, 99999, "high", None),
        ("h", 5, "x", 1, 2, None, None), ("k", 6, None, None, None, None, None), ("k", 7, "…", 0, None, "none", None), ("g", 1, "Một người.", 1000, 1050, "low", day + "3"), (None, 8, "a b", 1, 1, "low", None), ("g", None, "a b", 1, 1, "low", None),
    ]
    df = spark.createDataFrame(rows, "id string, rec_id long, description string, start_year int, end_year int, source string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at")).withColumn("ingested_at", F.lit(1))
    trust = spark.createDataFrame([("high", 2), ("low", 1)], "source string, trust int")
    values = field_values(clashing(df), trust)
    got = {(r["id"], r["field_name"], r["rec_id"]) for r in survivors(values).collect()}
    assert got == {("g", "description", 4), ("g", "start_year", 1), ("g", "end_year", 3)}
    assert {r["value"] for r in survivors(values, "additive").where("field_name = 'description'").collect()} == {"Vua nước."}
    assert survivors(field_values(df.limit(0), trust)).count() == 0


def test_priority_is_an_order(spark):
    # The strict order is one aggregation, without an alignment that can't change it; it names what the vote would.
    rng = np.random.default_rng(4)
    rows = [(str(g), "description", " ".join(rng.choice(["a", "b", "c", "d"], rng.integers(1, 6))), 20 * g + k, int(rng.integers(3)), None) for g in range(200) for k in range(12)]
    got = survivors(spark.createDataFrame(rows, "id string, field_name string, value string, rec_id long, trust int, updated_at timestamp"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    told = {r["id"]: (r["value"], r["rec_id"]) for r in got.collect()}
    for g in range(200):
        ranked = sorted((r for r in rows if r[0] == str(g)), key=lambda r: (-r[4], -r[3]))
        values = list(dict.fromkeys(r[2] for r in ranked))
        assert told[str(g)] == (values[nearest(values, [2.0**-i for i in range(len(values))])], ranked[0][3])


def test_large_group(spark):
    df = spark.range(3000).select(F.lit("g").alias("id"), F.col("id").alias("rec_id"), F.concat(F.lit("vua nước "), F.col("id").cast("string")).alias("description"), F.lit(1000).alias("start_year"), F.lit(None).cast("int").alias("end_year"), F.lit("s").alias("source"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(1).alias("ingested_at"))
    values = field_values(df, spark.createDataFrame([("s", 3)], "source string, trust int"))
    assert {(r["field_name"], r["rec_id"]) for r in survivors(values).collect()} == {("description", 2999), ("start_year", 2999)}
    assert survivors(values, "additive").count() == 2


@pytest.mark.parametrize("text, good", [("Võ tướng.", True), ("N/A", False), ("chưa  rõ", False), ("…………", False), ("xxxxxxx", False), ("<description>", False), ("{{{mô tả}}}", False), ("Mô tả sẽ được bổ sung sau khi đối chiếu nguồn.", False), (" ", False), (None, False), ("—", False), ("Không rõ năm sinh, là thợ khắc.", True)])
def test_usable(spark, text, good):
    assert spark.createDataFrame([(text,)], "t string").select(survivor.usable_text(F.col("t")).alias("u")).first()["u"] is good


# 6 visual


def test_visual(spark):
    pairs = [("Ｋｈương", "Khương"), (unicodedata.normalize("NFD", "Viễn Đệ"), "Viễn Đệ"), ("a\u200bb\u00a0c", "ab c"), ("Νhong", "Nhong"), ("L.Đ.С.Τ.", "L.Đ.C.T."), ("Ðựng Ɖửng", "Đựng Đửng"), ("Ⅹ‑x", "X-x"), ("\u200b", ""), ("e\u0302\u0323", "ệ")]
    same = ["Khương (Лагерь)", "“a” – b…", "古城", "", None, "Νήσος", "x\ny"]
    rows = [(i, v) for i, (v, _) in enumerate(pairs)] + [(100 + i, v) for i, v in enumerate(same)] + [(0, pairs[0][0]), (None, "Ｋ"), (200, "ａ" * 20_000)]
    df = spark.createDataFrame(rows, "id long, name string")
    got = {(r["id"], r["name"]): (r["canonical"], r["changed"]) for r in canonical(clashing(df), "id", "name").collect()}
    for i, (v, w) in enumerate(pairs):
        assert got[i, v] == (w, True), v
    for i, v in enumerate(same):
        assert got[100 + i, v] == (v, False), v
    assert got[None, "Ｋ"] == ("K", True) and got[200, "ａ" * 20_000] == ("a" * 20_000, True)
    assert canonical(df.limit(0), "id", "name").count() == 0


# 7 leakage

WORDS = [f"{a}{b}{c}" for a in ("k", "m", "ng", "tr", "v") for b in ("a", "e", "o", "oa", "uye") for c in ("n", "t", "nh", "m")]


def _passage(seed, n=60):
    rng = np.random.default_rng(seed)
    return [WORDS[i] for i in rng.integers(0, len(WORDS), n)]


def test_leaks(spark):
    p, q = _passage(1), _passage(2)
    replaced = [w if i % 9 else "khac" for i, w in enumerate(p)]
    marked = " ".join(w + (f"[{i}]" if i % 5 == 0 else "") for i, w in enumerate(p[:40]))
    docs = [(1, "mở " + " ".join(p[5:35]) + " kết"), (2, " ".join(replaced).upper()), (3, marked.replace(" ", "\n", 5)), (4, " ".join(sorted(p))), (5, " ".join(p[:9])), (6, "<b>" + "</b> <i>".join(p[10:40])), (7, None), (8, ""), (9, " ".join(p[3:30] + q[3:30])), (10, " ".join(p[:25] + ["xen", "vao"] + p[25:50])), (1, "mở " + " ".join(p[5:35]) + " kết"), (None, " ".join(p)), (11, "từ " * 200_000 + " ".join(q))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, None, " ".join(p)), (2, " ".join(q), None), (3, "", "ngắn"), (None, " ".join(p), None)], "item_id int, question string, passage string")
    got = {(r["doc"], r["item"]) for r in leaked_items(clashing(docs), clashing(items)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (6, 1), (9, 1), (9, 2), (10, 1), (11, 2)}
    assert leaked_items(docs, items.limit(0)).count() == 0 and leaked_items(docs.limit(0), items).count() == 0


def test_long_leaks():
    # A copied passage of 150 words is one stretch; own words after 60 that three items share count.
    text = [f"w{i}" for i in range(150)]
    stock = [f"s{i}" for i in range(60)]
    probe = leakage.Probe([(1, text)] + [(k, stock + [f"o{k}x{i}" for i in range(30)]) for k in (2, 3, 4)])
    code = lambda body: [probe.vocabulary.get(w, 0) for w in body] + [-1] * 3
    one, two = code(["a", *text, "b"]), code(stock + [f"o2x{i}" for i in range(30)])
    got = probe.leaks(np.array(one + two), np.array([0, len(one)]))
    assert [tuple(int(x) for x in r) for r in zip(*got)] == [(0, 1, 150, 150), (1, 2, 90, 90)]


def test_leak_words():
    assert leakage.words("Đường&nbsp;ĐÊ\u0301 <b>x</b>y [12] 1010 Ｎａ Νa") == ["duong", "de", "x", "y", "1010", "na", "na"]
    assert leakage.words(None) == [] and leakage.words("") == []


# 8 mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 300), min_size=1))
def test_pfair(slots):
    pattern, period = pfair_pattern(slots), sum(slots.values())
    assert len(pattern) == period and pfair_pattern({}) == []
    for name, n in slots.items():
        done, at = 0, [t for t, x in enumerate(pattern) if x == name]
        for t, x in enumerate(pattern, 1):
            done += x == name
            assert abs(done * period - t * n) < period
        # Every block lies between its release and its deadline.
        assert all(j * period // n <= t < -(-(j + 1) * period // n) for j, t in enumerate(at)) and len(at) == n


def test_mixture(spark):
    rows = [(i, "a", "w " * 50) for i in range(100)] + [(1000 + i, "b", "w " * 50) for i in range(10)] + [(5000, None, "w w"), (5001, "a", None), (5002, "a", ""), (5003, "c", "w " * 500)] + [(6000 + i, "d", "w " * 20) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.499999, 1), ("b", 0.5, 2), ("none", 0.0, 1), ("gone", 0.1, 3), (None, 0.1, 1), ("d", 1e-6, None)], "source string, target_share double, max_repeats int")
    sizes = source_sizes(clashing(docs), token_count(F.col("text")))
    report = {r["source"]: r for r in mix_shares(sizes, targets, block_tokens=256).collect()}
    assert {s for s, r in report.items() if not r["reachable"]} == {"b", "gone"} and report["none"]["n_docs"] == 0
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9 and report["d"]["used_docs"] == 1
    used = mix_sources(sizes, targets, block_tokens=256).collect()
    copies = {}
    for r in used:
        copies[r["doc"]] = copies.get(r["doc"], 0) + 1
    assert max(copies.values()) == 2 and {r["source"] for r in used} == {"a", "b", "d"} and all(copies[1000 + i] == 2 for i in range(10))
    # Reported shares are those of the rows; the plan is kept to within a document.
    given_ = {s: sum(r["tokens"] for r in used if r["source"] == s) for s in "abd"}
    assert all(given_[s] == report[s]["given_tokens"] and abs(given_[s] - report[s]["planned_tokens"]) <= max(r["tokens"] for r in used) for s in "abd")
    assert len({(r["slot"], r["source"]) for r in used}) == len({r["slot"] for r in used})
    # However little room the schedule has, every source keeps its share, to within a block and a document.
    few = mix_sources(sizes, targets, block_tokens=16, most_slots=10).collect()
    assert {(r["doc"], r["copy"]) for r in few} == {(r["doc"], r["copy"]) for r in used} and max(r["slot"] for r in few) < 13
    ordered, done, total = sorted(used, key=lambda r: (r["slot"], r["block"])), 0, sum(given_.values())
    for i, r in enumerate(ordered):
        done += r["tokens"] * (r["source"] == "b")
        assert abs(done - sum(x["tokens"] for x in ordered[: i + 1]) * given_["b"] / total) < 2 * 256 + 500
    assert mix_shares(sizes.limit(0), targets).where("NOT reachable").count() == 0 and mix_sources(sizes.limit(0), targets).count() == 0


# 9 spam


def _pages(spark):
    rng = np.random.default_rng(3)
    subjects, verbs, things, ends = ["các bô lão", "dân phu", "người lái đò", "thợ khắc"], ["sửa", "đòi lại", "giao nộp", "kiểm kê"], ["cây cầu ngói", "ngôi miếu", "ruộng tế", "kho thóc"], ["ở Sông Moi", "trong hạt Núi Lan", "khi bệnh dịch vừa lui", "trước khi thành bị phá"]
    pick = lambda xs: xs[rng.integers(len(xs))]
    sentence = lambda: f"{pick(subjects)} {pick(verbs)} {pick(things)} {pick(ends)}.".capitalize()
    rows = [(i, " ".join(sentence() for _ in range(8))) for i in range(260)] + [(i, "\n".join("- " + sentence() for _ in range(8))) for i in range(260, 300)]
    rows += [(1001, " ".join("#giare #banhang" for _ in range(40))), (1002, "áo tế giá rẻ, " * 40), (1003, "\n".join(f"* [[Núi Lan {i}]]" for i in range(40))), (1004, "\n".join(f"http://a{i}.example/x" for i in range(40))), (1005, sentence() + " " + "mua gốm giá rẻ vì gốm bán sỉ tại gốm lò. " * 20)]
    # Four copies of shuffled words, led and ended by real sentences; they are prose by their build.
    words = " ".join(sentence() for _ in range(12)).split(" ")
    rows += [(1006 + i, text) for text in [sentence() + " " + " ".join(words[j] for j in rng.permutation(len(words))) + " " + sentence()] for i in range(4)]
    rows += [(2001, "\n".join("- " + sentence() for _ in range(9))), (2002, " ".join(sentence() for _ in range(9)) + "\nhttp://a.example\nhttp://b.example"), (2003, None), (2004, ""), (2005, "..."), (2001, rows[0][1]), (None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_spam(spark):
    got = spam_scores(clashing(_pages(spark))).collect()
    assert {r["doc"] for r in got if r["spam"]} == set(range(1001, 1010))
    assert all(r["abnormal_share"] is None for r in got if r["doc"] in (2003, 2004, 2005)) and len(got) == 315
    assert spam_scores(_pages(spark).limit(0)).count() == 0
    nothing = spam_scores(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert nothing[0]["spam"] is False


def test_trigram_costs():
    model = spam.Trigrams(12, np.array([0, 11, (0 * 12 + 11) * 12 + 10]), np.array([5, 5, 5]))
    cost = model.costs(np.array([0, 11, 10, 0]), np.array([0]))
    assert cost[2] < 1 and np.isfinite(cost).all()


def test_spam_kinds(spark):
    """Pages of addresses and of link titles are found though articles end in such; half a page out of order is no keywords."""
    rng = np.random.default_rng(5)
    pick = lambda xs: xs[rng.integers(len(xs))]
    sentence = lambda: " ".join(map(pick, (["Các bô lão", "Dân phu", "Người lái đò"], ["sửa", "đòi lại", "giao nộp", "kiểm kê"], ["cây cầu ngói", "ngôi miếu", "ruộng tế"], ["ở Sông Moi", "trong hạt Núi Lan", "gần Cửa Nhai"], ["khi bệnh dịch vừa lui", "trước khi thành bị phá", "vì nước lũ dâng cao quá mức"]))) + "."
    prose = lambda n: " ".join(sentence() for _ in range(n))
    name = lambda: pick(["Sông", "Núi", "Cửa"]) + " " + pick(["Moi", "Lan", "Nhai"]) + " " + pick(["Ngoan", "Tụy", "Hân"])
    titles = lambda n: "Xem thêm: " + " | ".join(pick(["Bản đồ cũ", "Nguồn gốc tên gọi", "Khai quật lần hai"]) + " " + name() for _ in range(n))
    links = lambda n: "\n".join(f"http://a{rng.integers(9999)}.example/x" for _ in range(n))

    def shuffled(n):
        words = prose(n).split(" ")
        return " ".join(words[j] for j in rng.permutation(len(words))) + "."

    rows = [(i, prose(10)) for i in range(200)] + [(i, prose(10) + "\nXem thêm:\n" + links(4)) for i in range(200, 280)] + [(i, titles(8) + "\n" + prose(8)) for i in range(280, 320)]
    rows += [(1001 + i, links(20 + i)) for i in range(5)] + [(1006 + i, titles(20 + i) + "\n" * (i % 2) + prose(i % 2)) for i in range(5)] + [(2001 + i, prose(4) + " " + shuffled(7)) for i in range(5)]
    got = {r["doc"]: r for r in spam_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, r in got.items() if r["spam"]} == set(range(1001, 1011))
    assert all(got[k]["abnormal_share"] > 0.5 for k in range(2001, 2006))


def test_spam_knows_the_same_at_any_size(spark):
    """What five pages have is known among 1,000 pages, not among 20,000."""
    coder = spam.Coder()
    for n, known in ((1000, True), (20000, False)):
        names = ["".join("bcdghklm"[i >> k & 7] + "aeiouyou"[i >> k + 3 & 7] for k in (0, 6, 12)).capitalize() for i in range(n)]
        texts = [f"{x} sửa {x} cây cầu {x} ở làng {x} bên" + (" 7 8." if i < 5 else ".") + f" Dân phu {x} đòi lại {x} ruộng tế {x} khi bệnh lui ở {x}." for i, x in enumerate(names)]
        pages = spark.createDataFrame([(coder.page(t), True) for t in texts], "raw binary, prose boolean")
        function = spam._function_words(pages)
        keys, _ = spam._trigrams(pages, function)
        assert len(keys) and (keys % (len(spam.CLASSES) + len(function)) == spam.NUMBER).any() == known
