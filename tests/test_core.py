import math

from pyspark.sql import functions as F

from quern.functions import text, urls
from quern.operators import evaluate, feedback, graph, index, search
from quern.plans.search_queries import osa_distance


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_tokens_fold_and_drop_stop_words(spark):
    assert column(spark, ["The Café of x1", None, "", "a" * 65], text.tokens) == [["cafe", "x1"], [], [], []]


def test_urls(spark):
    assert column(spark, ["HTTP://EX.com:80//a//b/?b=2&a=1#f", "https://ex.com/", "nothing", None], urls.normalise) == ["http://ex.com/a/b?a=1&b=2", "https://ex.com/", None, None]
    assert column(spark, ["ftp://ex.com/x", "http://10.0.0.1/", "http://localhost/", "", None, "https://ok.org"], urls.validate) == ["scheme", "private", "private", "empty", "empty", None]
    assert column(spark, ["news.bbc.co.uk", "a.b.ex.com", "127.0.0.1", "localhost"], urls.registrable) == ["bbc.co.uk", "ex.com", "127.0.0.1", "localhost"]


def test_html_text(spark):
    assert column(spark, ["<p>Hello &amp; World &lt;3</p><script>x</script><p>&#65;&#x42;</p>"], text.visible_text) == ["Hello & World <3\nAB"]


def test_metrics_of_hand_fixture(spark):
    qrels = spark.createDataFrame([("q", "c", "s", d, g) for d, g in (("A", 3), ("B", 2), ("C", 1), ("D", 0))], "query_id string, category string, split string, doc_id string, grade int")
    run = spark.createDataFrame([("q", d, float(s)) for d, s in (("B", 4), ("A", 3), ("D", 2), ("C", 1))], "query_id string, doc_id string, score double")
    r = evaluate.evaluate(run, qrels, 4).first()
    assert math.isclose(r.dcg, 7.847184833, abs_tol=1e-5) and math.isclose(r.ndcg, 0.83544778, abs_tol=1e-5)
    assert (r.precision, r.recall, r.rr) == (0.75, 1.0, 1.0) and math.isclose(r.ap, 0.91666667, abs_tol=1e-5)


def test_pagerank_chain_cycle_and_empty(spark):
    edges = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    chain = {r.url: r.score for r in graph.pagerank(edges([("A", "B"), ("B", "C")]), iterations=100, tolerance=1e-10).collect()}
    assert all(math.isclose(chain[k], v, abs_tol=1e-7) for k, v in (("A", 0.18441678), ("B", 0.34117105), ("C", 0.47441217)))
    cycle = [r.score for r in graph.pagerank(edges([("A", "B"), ("B", "C"), ("C", "A")]), iterations=5).collect()]
    assert all(math.isclose(s, 1 / 3) for s in cycle)
    assert graph.pagerank(edges([]), iterations=3).count() == 0


def test_osa_distance():
    assert [osa_distance(*p) for p in (("pyhton", "python"), ("ca", "abc"), ("", "ab"), ("x", "x"))] == [1, 3, 2, 0]


def test_segments_latest_document_wins(spark):
    seg = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "old", 1), (2, "a", "x", 5), (1, "b", "y", 1), (1, "c", "z", 1)], "segment_seq int, id string, term string, tf int")
    dead = spark.createDataFrame([(2, "b")], "segment_seq int, id string")
    assert sorted(map(tuple, index.merge_segments(seg, dead).collect())) == [(1, "c", "z", 1), (2, "a", "x", 5)]


def test_query_parsing(spark):
    q = spark.createDataFrame([("1", 'site:a.org "big red" state-of-the-art -bad'), ("2", None), ("3", "x" * 300)], "query_id string, raw_query string")
    r = {x.query_id: x for x in search.parse(q).collect()}
    assert r["1"].site == "a.org" and r["1"].phrases == [["big", "red"]] and r["1"].negated == ["bad"] and set(r["1"].terms) == {"state", "big", "red"}
    assert r["2"].is_empty and r["3"].is_clamped


def test_burst_counts_neighbours(spark):
    f = spark.createDataFrame([(str(i), 1000 + i) for i in range(6)] + [("far", 2000), ("none", None)], "feedback_id string, s long").select("feedback_id", F.timestamp_seconds("s").alias("ts"))
    r = {x.feedback_id: (x.n_near, x.strength) for x in feedback.bursts(f).collect()}
    assert r["0"] == (6, 0.1) and r["far"] == (1, 1.0) and "none" not in r
