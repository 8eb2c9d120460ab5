"""Findings of round 2."""

import re

from pyspark.sql import functions as F

from quern.operators import search, store
from quern.plans import search_queries


def _documents(spark, n):
    rows = [(f"d{i:03}", f"https://{'ab'[i % 2]}.org/p{i}", f"t{i % 7} red", "big" if i % 4 == 0 else None, "", " ".join(["blue"] * (i % 5) + ["green" if i % 3 == 0 else "grey", f"rare{i}"])) for i in range(n)]
    rows += [("blank", "https://a.org/", " ", None, None, ""), ("silent", "https://a.org/s", "...", None, None, None)]
    d = spark.createDataFrame(rows, "id string, url string, title string, headings string, description string, body_text string")
    return d.withColumns({"language": F.lit("en"), "last_modified": F.lit(None).cast("timestamp"), "crawled_at": F.lit(None).cast("timestamp")})


def test_f1_index_of_query_terms_is_the_stored_one_and_prunes_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BLOCK_DOCUMENTS", 1)  # many ranges, so that marks take several words and rows
    monkeypatch.setattr(search, "WORDS", 1)
    q = [("1", "red blue"), ("2", "green -blue big"), ("3", "intitle:t3 grey"), ("4", "site:a.org red blue green"), ("5", "rare5 rare17 red"), ("6", "blue -blue"), ("7", "nothing"), ("8", None)]
    parsed = search.parse(spark.createDataFrame(q, "query_id string, raw_query string"))
    documents = _documents(spark, 200)
    store.build(documents, str(tmp_path / "index"))
    stored, small = store.load(spark, str(tmp_path / "index")), store.over_terms(documents, search.vocabulary(parsed))
    words = [r.term for r in search.vocabulary(parsed).collect()]
    rows = lambda df, *cols: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())
    for a, b, cols in ((stored.postings.filter(F.col("term").isin(words)), small.postings, ["term", "id", "block", "tf", "tf_title", "tf_body", "impact"]), (stored.blocks.filter(F.col("term").isin(words)), small.blocks, ["term", "block", "n", "max_tf", "bound"]),
                       (stored.dictionary.filter(F.col("term").isin(words)), small.dictionary, ["term", "df", "total_tf", "bound"]), (stored.stats, small.stats, ["n_documents", "avg_title", "avg_body", "avg_length"])):
        assert rows(a, *cols) == rows(b, *cols)
    assert small.n_blocks == 201
    best = {(how.__name__, ix is small): rows(search_queries._best(ix, parsed, how), "query_id", "rank", "id", "score") for how in (search.exhaustive, search.maxscore, search.wand) for ix in (stored, small)}
    assert len({str(v) for v in best.values()}) == 1 and {r[0] for r in best["wand", True]} == {"1", "2", "3", "4", "5"}
    # a range that isn't given is skipped: of the pruned form only what lies in it comes
    one = small.postings.filter("id = 'd007'").select(F.lit("1").alias("query_id"), "block").distinct()
    lies = {r.id for r in small.postings.join(one, "block").collect()}
    assert {r.id for r in search.scores(search.query_terms(parsed), parsed, small, ranges=one).collect()} == lies and "d007" in lies


def test_f1_topk_equivalence_shuffles_no_matches_and_stores_no_full_index(spark, monkeypatch):
    monkeypatch.setattr(store, "build", None)  # the index of all terms isn't made
    out = search_queries.topk_equivalence(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and all(r.n and not r.maxscore_differs and not r.wand_differs for r in rows)
    moved = re.findall(r" Exchange hashpartitioning\((.*?), \d+\)", out._jdf.queryExecution().executedPlan().toString())
    assert moved and not [m for m in moved if re.search(r"\bid#", m)]


def test_f2_segment_merge_unites_no_partitioned_branches(spark):
    from quern.plans import index_queries

    merged = index_queries.segment_merge(spark, "/root/testdata/sf0.001")
    assert merged.count() and "Union" not in merged._jdf.queryExecution().executedPlan().toString()


def test_f3_segment_merge_keeps_the_latest_segment_only(spark):
    from quern.plans import index_queries

    whole = index_queries.postings(spark, "/root/testdata/sf0.001").groupBy("id").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).collect()
    wanted = set()
    for r in whole:
        seq = 3 if r.id[0] < "4" else 1 if r.id[0] < "8" else 2
        if seq == 3 or r.id[1] != "0":
            wanted.add((seq, r.id, r.n, r.tf + (r.n if seq == 3 else 0)))
    rows = [tuple(r) for r in index_queries.segment_merge(spark, "/root/testdata/sf0.001").collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted


def test_f3_merged_segments_hold_no_rows_without_an_id(spark):
    from quern.operators import index

    segments = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "x", 2), (1, "b", "x", 1), (2, None, "x", 1), (2, None, "y", 4)], "segment_seq int, id string, term string, tf int")
    tombstones = spark.createDataFrame([(1, "b"), (2, None)], "segment_seq int, id string")
    for dead in (tombstones, tombstones.filter("id is not null")):
        assert [tuple(r) for r in index.merge_segments(segments, dead).collect()] == [(2, "a", "x", 2)]


def test_f4_of_a_repeated_local_time_the_later_counts(spark):
    from quern.functions import instant

    # the hour that comes twice, just before and after it, the one left out, and other days
    rows = [("02:14 cet to sydney", "1996-10-27", "12:14"), ("01:59 cet to utc", "1996-10-27", "23:59"), ("02:14 cet to utc", "1996-10-27", "01:14"), ("03:00 cet to utc", "1996-10-27", "02:00"), ("02:30 cet to utc", "1996-03-31", "01:30"),
            ("1:30am est to utc", "1996-10-27", "06:30"), ("01:30 est to utc", "1996-10-26", "05:30"), ("02:14 cet to utc", "1996-10-26", "00:14"), ("25:00 cet to utc", "1996-10-26", None)]
    d = spark.createDataFrame(rows, "q string, day string, wanted string")
    assert [r for r in d.select("q", "wanted", instant.clock(F.col("q"), F.col("day").cast("timestamp")).alias("got")).collect() if r.wanted != r.got] == []


def test_p10_texts_plainly_of_another_script_are_passed_on_whole(monkeypatch):
    import random

    import pyarrow as pa

    from quern.llm import lookalike

    plain = ["Это один текст из слов, и только.\nВторая строка iPhone 15, ещё.", "Ένα κείμενο με λέξεις\nκαι δεύτερη γραμμή", None, "plain", ""]
    draw = random.Random(1)
    letters = "aceopxyABдяжаесоАЕlі \n\n.αβγΏ̀ ​҃··;̈́ёй1-é각ᅡᆨﬁＡΩÅ豈\U0001d400‍"
    texts = plain + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 14))) for _ in range(20_000)]
    assert lookalike.canonical_array(pa.array(texts)).to_pylist() == [t if t is None else lookalike.canonical_text(t) for t in texts]
    monkeypatch.setattr(lookalike, "canonical_text", None)  # not called
    assert lookalike.canonical_array(pa.array(plain)).to_pylist() == plain


def test_p10_sentences_look_for_sequences_only_where_one_begins():
    from quern.llm import abuse

    class Counted(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    guard = abuse.Guard(sequences={("grim", "ugly", "tide"): ("hateful", 0.5), ("grim", "bin"): ("sexual", 0.3)})
    guard.sequences = Counted(guard.sequences)
    said = "Every other part of this long sentence tells that a grim ugly tide rolls in and a grim bin stands by."
    assert abuse.sentence_score(said, {}, guard) == (0.5, "hateful") and guard.sequences.n <= 6
    assert abuse.sentence_score("A quite harmless sentence, grim as the tide.", {}, guard)[0] == 0
    assert abuse.sentence_score("Shut up you i d i o t!", {})[0] >= 1


def test_p7_template_lines_scan_bodies_once(spark):
    from quern.llm import sitelines

    d = spark.read.parquet("/root/testdata/sf0.001/raw_documents.parquet")
    out = sitelines.template_lines(d, 2)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert rows and len(re.findall(r"MapInArrow scan", plan)) == 1 and "ReusedExchange" in plan


def test_p7_lengths_do_not_depend_on_the_value_before():
    import pyarrow as pa

    from quern.llm import cutoff

    #                 code points, utf8, utf16, html, json, crlf
    wanted = {"a\r": [2, 2, 2, 2, 3, 2], "\nb": [2, 2, 2, 2, 3, 3], "x\r\ny": [4, 4, 4, 4, 6, 4], "": [0] * 6, "é<€\U0001f600\"": [5, 11, 6, 13, 27, 5], "\n": [1, 1, 1, 1, 2, 2]}
    assert dict(zip(wanted, cutoff.measure(pa.array(list(wanted))).tolist())) == wanted
    assert cutoff.measure(pa.array([None, "plain"], pa.string())).tolist() == [[0] * 6, [5] * 6]
    assert cutoff.ending("see (...)")[1] and cutoff.ending("see <a href='x")[1] and cutoff.ending("caf\\u00")[1] and not cutoff.ending("it ends. Then so")[1]
