from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.operators import chunking, graph, ingest, papers


def one(spark, value, expr, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(expr(F.col("v"))).first()[0]


def test_index_terms_same_in_jvm_and_python(spark):
    texts = ["CPU usage of the node-1.5 is -- high_", "检索增强生成 RAG 系统", "字 a b cc d-e...f", "", "Ünïcode—dash"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    jvm = [r[0] for r in df.select(tx.index_terms(F.col("v"))).collect()]
    py = [[p for w in tx.index_words(t) for p in tx.index_pieces(w)] for t in texts]
    assert jvm == py
    assert jvm[0] == ["cpu_usage", "node-1.5", "high"]
    assert jvm[1] == ["检索", "索增", "增强", "强生", "生成", "rag", "系统"]


def test_normalize_and_preview(spark):
    assert one(spark, "a\x00 \t b\n\n \n c \n", tx.normalize_text) == "a b\n\nc"
    assert one(spark, "abcdef  ghij", lambda c: tx.preview(c, 8)) == "abcdef..."
    assert one(spark, "abc", lambda c: tx.preview(c, 0)) == "a..."
    assert [one(spark, v, tx.rough_tokens) for v in ("", "a", "abcde")] == [0, 1, 2]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_split_covers_text_within_size(text, size, overlap):
    spans = chunking.split_with_offsets(text, size, overlap)
    end = 0
    for a, b in spans:
        assert a <= end and 0 < b - a <= size and b > end
        end = b
    assert end == len(text)
    assert all(a2 >= b1 - overlap for (_, b1), (a2, _) in zip(spans, spans[1:]))


def test_three_levels_nest(spark):
    text = ("Satz eins ist kurz. " * 60 + "\n\n") * 4
    df = spark.createDataFrame([("f.txt", 2, text)], "filename string, page_number int, text string")
    rows = chunking.three_levels(df, "filename").collect()
    by_id = {r.chunk_id: r for r in rows}
    assert [r.chunk_idx for r in rows] == list(range(len(rows)))
    for r in rows:
        limit = rules.CHUNK_LEVELS[r.chunk_level - 1][0]
        assert len(r.text) <= limit and text.strip()[r.start_index:r.start_index + len(r.text)] == r.text
        if r.chunk_level > 1:
            assert r.text in by_id[r.parent_chunk_id].text
            assert by_id[r.root_chunk_id].chunk_level == 1
    assert "f.txt::p2::l1::0" in by_id


def test_merge_small_follows_the_fold(spark):
    sizes = [400, 100, 350, 50, 50, 900, 200, 200]
    rows = [(1, i, chr(97 + i) * n) for i, n in enumerate(sizes)]
    got = chunking.merge_small(spark.createDataFrame(rows, "d int, pos int, text string"), "d", "pos", 300, 1000).orderBy("merged_idx").collect()
    want, cur = [], None
    for _, _, t in rows:
        if cur is None:
            cur = t
        elif len(t) < 300 and len(cur) < 1000:
            cur += "\n\n" + t
        else:
            want.append(cur)
            cur = t
    assert [r.text for r in got] == want + [cur]


def test_html_text(spark):
    html = "<html><style>p{}</style><script>x<b>1</b></script><h1>A &amp; B</h1><p>one<br>two</p><noscript>no</noscript><div>three</div></html>"
    assert one(spark, html, ingest.html_text).split() == ["A", "&", "B", "one", "two", "three"]


def test_markdown_sections_carry_headings(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n## C\n# D\nz")], "id int, text string")
    rows = chunking.markdown_sections(df, "id").orderBy("section").collect()
    assert [(r.h1, r.h2) for r in rows] == [("", ""), ("A", ""), ("A", "B"), ("A", "C"), ("D", "")]


def test_slug(spark):
    got = [one(spark, v, graph.slug) for v in ("Café: Déjà Vu (2)", "深度 学习", "A / B", "a--b")]
    assert got == ["cafe-deja-vu-2", "深度学习", "a-b", "a-b"]


def test_author_names(spark):
    f = lambda v: one(spark, v, graph.author_names)
    assert f("Smith, J., Zhang, W.") == ["Smith, J.", "Zhang, W."]
    assert f("Zhang Wei; Li Ming") == ["Zhang Wei", "Li Ming"]
    assert f("Ann Lee, Bo Chen and Cy Dow") == ["Ann Lee", "Bo Chen", "Cy Dow"]
    assert f("Smith, John") == ["Smith, John"]


def test_citations(spark):
    t = "See [1, 2] and [2]; (Smith & Lee, 2020a), Wang et al. (2019) and again (Smith & Lee, 2020a)."
    df = spark.createDataFrame([("p", t)], "p string, t string")
    got = {r.target for r in graph.citations(df, "p", "t").collect()}
    assert got == {"paper/ref-1", "paper/ref-2", "paper/smith-&-lee-2020a", "paper/wang-et-al-2019"}


def test_report_sections(spark):
    df = spark.createDataFrame([(1, "# T\nskip\n## One\n- a\nb\n### sub\n\n## Two\n- c")], "id int, text string")
    rows = papers.report_sections(df, "id").orderBy("section", "bullet").collect()
    assert [(r.title, r.text) for r in rows] == [("One", "a"), ("One", "b"), ("Two", "c")]


def test_abstract_from_index(spark):
    df = spark.createDataFrame([({"a": [0, 2], "b": [1]},)], "v map<string,array<int>>")
    assert df.select(papers.abstract_from_index(F.col("v"))).first()[0] == "a b a"


def test_doi_from_url(spark):
    f = lambda v: one(spark, v, papers.doi_from_url)
    assert f("https://arxiv.org/pdf/2101.00001v2.pdf") == "10.48550/arXiv.2101.00001"
    assert f("https://doi.org/10.1000/xyz.5).") == "10.1000/xyz.5"
    assert f("https://example.org/a") == ""
