"""Answers to many queries at once, out of their first results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import answers as A


def candidates(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, rank, position, sentence, score, n_matched, words): the sentences of each query's first documents that are fit to answer.
    results: (query_id, id, rank, title, body); queries: (query_id, raw_query). Bodies are read up to the answer's own bounds."""
    q = queries.select("query_id", A.words(F.trim(F.coalesce("raw_query", F.lit("")))).alias("query")).filter(F.size("query") > 0)
    r = results.filter(F.col("rank") <= A.MAX_DOCUMENTS).select("query_id", "id", "rank", A.words(A.sanitise(F.col("title"), 200)).alias("title"), A.sanitise(F.col("body"), A.DOCUMENT_CHARS).alias("body")).join(q, "query_id")
    s = r.select("query_id", "id", "rank", "title", "query", F.posexplode(A.sentences(F.col("body"))).alias("position", "sentence")).filter(~A.is_poor(F.col("sentence")))
    return s.withColumn("s", A.score(F.col("sentence"), F.col("query"), F.col("title"), F.col("rank"), F.col("position"))).select("query_id", "id", "rank", "position", "sentence", "s.score", "s.n_matched", "s.words")


def selected(found: DataFrame) -> DataFrame:
    """(query_id, place, id, sentence, score, citation): the chosen sentences of each query in order, cited by the number of their document.
    A query has at most as many candidates as its few first documents have sentences."""
    key = F.struct((-F.col("score")).alias("k"), F.col("rank"), F.col("position"), "score", "sentence", "words", "id", "n_matched")
    g = found.groupBy("query_id").agg(F.sort_array(F.collect_list(key)).alias("c"))
    g = g.filter(F.exists("c", lambda x: (x["n_matched"] >= 1) & (x["score"] >= A.RELEVANCE)))
    g = g.select("query_id", A.choose(F.col("c")).alias("c")).withColumn("order", F.array_distinct(F.transform("c", lambda x: x["id"])))
    out = g.select("query_id", "order", F.posexplode("c").alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("place"), "x.id", "x.sentence", "x.score", F.array_position("order", F.col("x.id")).cast("int").alias("citation"))


def disagreements(passages: DataFrame) -> DataFrame:
    """(query_id, topic, n_positive, n_negative): topics on which a query's passages (query_id, id, sentence) of different documents disagree, by
    pairs of opposite statements; and verbs for which they give different years."""
    out = None
    for topic, (yes, no) in A.POLARITY.items():
        g = passages.groupBy("query_id").agg(F.collect_set(F.when(F.col("sentence").rlike("(?i)" + yes), F.col("id"))).alias("y"), F.collect_set(F.when(F.col("sentence").rlike("(?i)" + no), F.col("id"))).alias("n"))
        g = g.filter((F.size(F.array_except("y", "n")) > 0) & (F.size("n") > 0)).select("query_id", F.lit(topic).alias("topic"), F.size("y").alias("n_positive"), F.size("n").alias("n_negative"))
        out = g if out is None else out.unionByName(g)
    claims = passages.select("query_id", "id", F.lower(F.regexp_extract("sentence", A.YEAR_CLAIM, 1)).alias("verb"), F.regexp_extract("sentence", A.YEAR_CLAIM, 2).alias("year")).filter("verb != ''").distinct()
    years = claims.groupBy("query_id", "verb").agg(F.count_distinct("year").alias("n_years"), F.count_distinct("id").alias("n_documents")).filter("n_years > 1 and n_documents > 1")
    return out.unionByName(years.select("query_id", F.concat(F.lit("year "), "verb").alias("topic"), F.col("n_years").alias("n_positive"), F.col("n_documents").alias("n_negative")))


def assembled(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, status, answer, n_sentences, n_citations, disputed): one row per query. status is answered, insufficient_evidence, or
    no_relevant_sources where there is no word to look for."""
    s = selected(found)
    a = s.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sentence", "citation"))), lambda x: F.concat(x["sentence"], F.lit(" ["), x["citation"].cast("string"), F.lit("]"))), " ").alias("answer"),
                                  F.count("*").alias("n_sentences"), F.count_distinct("citation").alias("n_citations"))
    d = disagreements(s).groupBy("query_id").agg(F.min("topic").alias("disputed"))
    asked = queries.select("query_id", (F.size(A.words(F.trim(F.coalesce("raw_query", F.lit(""))))) > 0).alias("asks"))
    out = asked.join(a, "query_id", "left").join(d, "query_id", "left")
    status = F.when(~F.col("asks"), "no_relevant_sources").when(F.col("answer").isNotNull(), "answered").otherwise("insufficient_evidence")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("query_id", status.alias("status"), F.coalesce("answer", F.lit("")).alias("answer"), n("n_sentences"), n("n_citations"), "disputed")
