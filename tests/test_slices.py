"""Hot keys and far values: work is dealt by rows, results stay those of a plain computation."""

import random
import statistics

from pyspark.sql import functions as F

from corpusflow.functions.skew import in_slices
from corpusflow.operators import chunking, memory, papers, profile


def test_quartiles_with_one_far_value(spark):
    values = [float(i) for i in range(2000)] + [1e12] + [7.0] * 500
    df = spark.createDataFrame([(v, None if i % 3 else i) for i, v in enumerate(values)], "v double, w int")
    got = {r.column_name: r for r in profile.numeric_summary(df).collect()}
    q = statistics.quantiles(values, n=4, method="inclusive")
    assert [got["v"].q25, got["v"].median, got["v"].q75] == q
    w = [i for i in range(len(values)) if i % 3 == 0]
    assert [got["w"].q25, got["w"].median, got["w"].q75] == statistics.quantiles(w, n=4, method="inclusive")
    assert (got["w"].n, got["w"].nulls) == (len(w), len(values) - len(w))
    sizes = [r["count"] for r in in_slices(df.select("v").distinct(), ["v"], "t").groupBy("_slice").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2 * min(sizes)


def test_running_total_of_a_hot_key(spark):
    r = random.Random(3)
    rows = [(i, "a" if i % 10 else r.choice(["b", None]), r.choice([None, *range(300)]), r.choice([None, 1.5, 2.0, 1e9])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, k string, t int, x double")
    df = df.withColumn("t", F.timestamp_seconds("t"))
    df.createOrReplaceTempView("hot_rows")
    want = spark.sql("""select id, cast(sum(cast(x as decimal(38,12))) over (partition by k order by t) as double) as running_total,
     rank() over (partition by k order by x desc) as amount_rank from hot_rows""")
    got = profile.running_total_and_rank(df, "k", "t", "x", "id").select("id", "running_total", "amount_rank")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _similar(a: str, b: str) -> bool:
    x, y = set(a), set(b)
    return a == b or bool(x | y) and len(x & y) / len(x | y) > 0.8


def test_duplicates_below_a_hot_title(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        text = "".join(r.sample("abcdefghijklmnopqrstuvwxyz0123456789", r.randint(8, 24)))
        if i % 7 == 0 and rows:
            text = r.choice(rows)[2] + r.choice(["", "!", "?"])
        rows.append((i, "hot" if i % 10 else r.choice(["cold", None]), text))
    rows += [(400, "hot", None), (401, "hot", ""), (402, "hot", ""), (403, "hot", "x" * 5000)]
    df = spark.createDataFrame(rows, "id int, title string, content string")
    want = set()
    for i, t, c in rows:
        if t is not None and c is not None and any(u == t and d is not None and j < i and _similar(c, d) for j, u, d in rows):
            want.add(i)
    for block in (1024, 4):  # one block a key, and many
        assert {x.id for x in memory.duplicates(df, "id", block=block).collect()} == want
    assert memory.duplicates(df.limit(0), "id").count() == 0


def test_sections_of_a_long_text(spark):
    texts = ["intro\n# A\nx\n## B\ny\n```\n# no\n## no\n```\n## C\nz\n# D\nw", "## only\nt", "", None, "# T\n" + "\n## s\nline" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [tuple(r) for r in chunking.markdown_sections(df, "id").orderBy("id", "section").collect()]
    assert [g for g in got if g[0] == 0] == [
        (0, 0, "", "", "intro"), (0, 1, "A", "", "# A\nx"), (0, 2, "A", "B", "## B\ny\n```\n# no\n## no\n```"), (0, 3, "A", "C", "## C\nz"), (0, 4, "D", "", "# D\nw")]
    assert [g for g in got if g[0] == 1] == [(1, 0, "", "only", "## only\nt")]
    assert [g[0] for g in got].count(4) == 3001 and all(g[2] == "T" for g in got if g[0] == 4) and not [g for g in got if g[0] in (2, 3)]


def test_report_lines(spark, tmp_path):
    sessions = spark.createDataFrame([("a", "A", "yes"), ("b", None, None), ("c", "C", "")], "session_id string, title string, answer string")
    learnings = spark.createDataFrame([("a", 1, 1, "x"), ("a", 0, 2, "y"), ("a", 2, 1, " X "), ("z", 0, 1, "gone")], "session_id string, branch_id int, rank int, learning string")
    sources = spark.createDataFrame(
        [("a", 1, i, f"t{i % 40}", "", None, "http://u" if i == 3 else "", "web") for i in range(60)] + [("c", 0, 0, None, "", "", "", "web")],
        "session_id string, branch_id int, pos int, title string, authors string, year string, url string, source string")
    got = {r.session_id: r.report for r in papers.report_markdown(sessions, learnings, sources).collect()}
    refs = "\n".join(f"[{i + 1}] t{i}" + ("\n    http://u" if i == 3 else "") + " [Web]" for i in range(40))
    none = "本轮未产出有效研究结论。"
    assert got == {
        "a": f"# A\n\n## 核心发现\n- y\n- x\n\n## 研究结论\nyes\n\n## 参考文献\n\n{refs}\n",
        "b": f"# \n\n## 研究结论\n{none}\n",
        "c": f"# C\n\n## 研究结论\n{none}\n"}
    lines = papers.report_lines(sessions, learnings, sources)
    path = str(tmp_path / "reports")
    papers.write_reports(lines, path)
    stored = spark.read.json(path)
    assert stored.count() == lines.count() and stored.where("session_id = 'z'").count() == 0
    assert papers.report_lines(sessions.limit(0), learnings, sources).count() == 0
