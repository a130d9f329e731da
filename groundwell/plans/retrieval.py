"""Queries over passages: retrieval, fusion, reranking and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions.text import STOPWORDS, domain, tokens
from groundwell.operators import features as fs
from groundwell.operators import ranker
from groundwell.operators import retrieval as r
from groundwell.operators.conflicts import conflicts
from groundwell.sources.tables import DOMAIN_SQL, PASSAGES_SQL, passages, read, vectors
from groundwell.sources.work import kept, saved, work_path

DEPTH = 50
AFTER = "2021-06-01"
#: Pages and vectors have the ids of the first documents, which are the oldest.
PAGES_AFTER = "2020-03-01"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is indexed of a passage: its title and its text. Passages without a text aren't."""
    p = passages(spark, sf_dir).where(F.coalesce("text", F.lit("")) != "")
    return p.select(F.col("doc_id").alias("id"), F.when(F.coalesce("title", F.lit("")) != "", F.concat("title", F.lit(". "), "text")).otherwise(F.col("text")).alias("text"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a table's passages: written by the first query that needs it, and searched by all later ones until the table's files change."""
    path = kept(read(spark, sf_dir, "documents"), "passages", lambda p: r.write_index(_titled(spark, sf_dir), p))
    return r.read_index(spark, path)


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.search(_index(spark, sf_dir), _queries(spark, sf_dir))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's vector is that with its id: the tables have no other."""
    return vectors(spark, sf_dir).join(r.small(_queries(spark, sf_dir).select(F.col("qid").alias("id"))), "id", "left_semi").select(F.col("id").alias("qid"), "vector")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top(_bm25(spark, sf_dir), 10, ["qid"], F.desc("score"), "id")


def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms from what is stored: an index of postings that is written once and searched twice, by all words and by a question's first eight."""
    held = r.index(_titled(spark, sf_dir))
    whole = _queries(spark, sf_dir)
    short = whole.select("qid", F.array_join(F.slice(tokens(F.col("text")), 1, 8), " ").alias("text"))
    both = [r.top(r.search(held, q), 10, ["qid"], F.desc("score"), "id").select(F.lit(n).alias("words"), "*") for n, q in (("all", whole), ("first", short))]
    return both[0].unionByName(both[1])


def bm25_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two thirds of the passages, to which all are added: those that it has stay, the others come. The search is that of one index of all."""
    docs, path = _titled(spark, sf_dir), work_path(spark, "index")
    r.write_index(docs.where("id % 3 > 0"), path)
    return r.top(r.search(r.append(docs, path), _queries(spark, sf_dir)), 10, ["qid"], F.desc("score"), "id")


def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return r.dense_top(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector"), 10)


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top(_bm25(spark, sf_dir), DEPTH, ["qid"], F.desc("score"), "id")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.dense_top(vectors(spark, sf_dir), _query_vectors(spark, sf_dir), DEPTH, keep_self=True)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.fused(_dense(spark, sf_dir), _sparse(spark, sf_dir), 10)


def retrieve_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry for all modes: fused with weights of the arms, and each arm alone; blank queries have no rows."""
    asked = _queries(spark, sf_dir).where(F.trim("text") != "").select("qid")
    dense, sparse = [saved(a.join(r.small(asked), "qid", "left_semi"), "arm") for a in (_dense(spark, sf_dir), _sparse(spark, sf_dir))]
    none = dense.limit(0)
    modes = {"weighted": r.fused(dense, sparse, 10, {"dense": 0.7, "sparse": 1.3}), "dense_only": r.fused(dense, none, 10), "sparse_only": r.fused(none, sparse, 10)}
    out = [df.select(F.lit(m).alias("mode"), "qid", "id", "rrf", "rank", "both") for m, df in modes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a question's first ten that reach a score."""
    return r.top(_dense(spark, sf_dir).where("score >= 0.3").drop("rank"), 10, ["qid"], F.desc("score"), "id")


def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse search in three domains (the hosts of pages with a document's id) from a date on; document frequencies stay those of all."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), domain(F.col("url")).alias("source_domain"))
    p = passages(spark, sf_dir).select("doc_id", "published").join(pages, "doc_id", "left")
    some = [x.source_domain for x in pages.groupBy("source_domain").count().orderBy("source_domain").limit(3).collect()]
    ok = p.where(r.passes(domains=some, published_after=PAGES_AFTER)).select(F.col("doc_id").alias("id"))
    return r.top(_bm25(spark, sf_dir).join(ok, "id", "left_semi"), 10, ["qid"], F.desc("score"), "id")


def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms see only what the filter lets pass; document frequencies stay those of all passages."""
    ok = passages(spark, sf_dir).where(r.passes(published_after=AFTER, exclude_sections=["Abstract"])).select(F.col("doc_id").alias("id"))
    sparse = r.top(_bm25(spark, sf_dir).join(ok, "id", "left_semi"), DEPTH, ["qid"], F.desc("score"), "id")
    dense = r.dense_top(vectors(spark, sf_dir).join(ok, "id", "left_semi"), _query_vectors(spark, sf_dir), DEPTH, keep_self=True)
    return r.fused(dense.select("qid", "id", "score", "rank"), sparse.select("qid", "id", "score", "rank"), 10)


def _route(qid):
    return F.element_at(F.array(F.lit("arxiv_meta"), F.lit("arxiv_fulltext"), F.lit("web"), F.lit("evidence_store")), (qid % 4 + 1).cast("int"))


def route_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question's route lets pass, or all where that is nothing; the first 30, reranked."""
    scored = _bm25(spark, sf_dir).withColumn("route", _route(F.col("qid")))
    p = passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "source_type", "section")
    ok = scored.join(p, "id").withColumn("ok", r.route_filter(F.col("route")))
    first = r.top(r.with_fallback(ok, "ok"), 30, ["qid"], F.desc("score"), "id")
    both = first.join(_docs(spark, sf_dir).withColumnRenamed("text", "passage"), "id").join(r.small(_queries(spark, sf_dir).withColumnRenamed("text", "question")), "qid")
    return r.rerank(both, 10, 30, r.overlap_logit(F.col("question"), F.col("passage"))).select("qid", "id", "route", "score", "fusion_rank", "rerank_score", "rank", "fallback")


def reranked(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """qid, id, fusion_rank, score, rerank_score, rank of the best evidence of each question."""
    cut = _sparse(spark, sf_dir).where("rank <= 30")
    both = cut.join(_docs(spark, sf_dir).withColumnRenamed("text", "passage"), "id").join(r.small(_queries(spark, sf_dir).withColumnRenamed("text", "question")), "qid")
    return r.rerank(both, k, 30, r.overlap_logit(F.col("question"), F.col("passage"))).select("qid", "id", "fusion_rank", "score", "rerank_score", "rank")


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir)


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, label and grade: a vector with a question's label has grade 2, one with the next label grade 1."""
    own = _query_vectors(spark, sf_dir).select("qid").join(vectors(spark, sf_dir).select(F.col("id").alias("qid"), F.col("label").alias("want")), "qid")
    return own.select("qid", F.explode(F.array(F.struct(F.col("want").alias("label"), F.lit(2).alias("grade")), F.struct((F.col("want") + 1).alias("label"), F.lit(1).alias("grade")))).alias("x")).select("qid", "x.*")


def _graded(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows (qid, id, ...) with their grade, null for what isn't graded. The graded pairs are never written out."""
    return rows.join(vectors(spark, sf_dir).select("id", "label"), "id", "left").join(_wanted(spark, sf_dir), ["qid", "label"], "left").drop("label")


def _grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, grade, n: how many vectors have each grade, from the numbers of each label."""
    n = vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _wanted(spark, sf_dir).join(n, "label").select("qid", "grade", "n")


def _runs(spark: SparkSession, sf_dir: str, candidates: int = 20) -> DataFrame:
    """The first 20 of each configuration; R4 reranks so many fused candidates, of which 30 reach the scorer."""
    dense, sparse = saved(_dense(spark, sf_dir), "dense"), saved(_sparse(spark, sf_dir), "sparse")
    both = saved(r.fused(dense, sparse, candidates), "fused")
    r4 = both.where("rank <= 30").join(_docs(spark, sf_dir).withColumnRenamed("text", "passage"), "id").join(r.small(_queries(spark, sf_dir).withColumnRenamed("text", "question")), "qid")
    r4 = r.rerank(r4, 20, 30, r.overlap_logit(F.col("question"), F.col("passage")))
    tag = lambda df, name: df.where("rank <= 20").select(F.lit(name).alias("config"), "qid", "id", "rank")
    return tag(dense, "R1").unionByName(tag(sparse, "R2")).unionByName(tag(both, "R3")).unionByName(tag(r4, "R4"))


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = r.metrics(_graded(_runs(spark, sf_dir), spark, sf_dir), _grade_counts(spark, sf_dir))
    return m.groupBy("config").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "recall", "strict_recall", "mrr")])


def fitted_order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    """R5: the fused candidates in the order of a ranker that was fitted on the graded ones of even questions. config, qid, id, rank, and the weights."""
    both = saved(r.fused(saved(_dense(spark, sf_dir), "dense"), saved(_sparse(spark, sf_dir), "sparse"), 40), "fused")
    texts = both.join(_docs(spark, sf_dir).withColumnRenamed("text", "passage"), "id", "left").join(r.small(_queries(spark, sf_dir).withColumnRenamed("text", "question")), "qid")
    held = saved(ranker.with_features(texts, "question", "passage").select("qid", "id", F.col("rank").alias("fusion_rank"), *[f"f_{f}" for f in ranker.FEATURES]), "features")
    graded = _graded(held, spark, sf_dir).withColumn("grade", F.coalesce("grade", F.lit(0)))
    weights = ranker.fit(graded.where("qid % 2 = 0"))
    r5 = r.top(held.withColumn("score", ranker.score(weights)), 20, ["qid"], F.desc("score"), "fusion_rank")
    r3 = held.where("fusion_rank <= 20").select(F.lit("R3").alias("config"), "qid", "id", F.col("fusion_rank").alias("rank"))
    return r3.unionByName(r5.select(F.lit("R5").alias("config"), "qid", "id", "rank")), weights


def fitted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of fusion (R3) and of the fitted ranker over it (R5) on the odd questions, which it hasn't seen."""
    runs = fitted_order(spark, sf_dir)[0].where("qid % 2 = 1")
    m = r.metrics(_graded(runs, spark, sf_dir), _grade_counts(spark, sf_dir))
    return m.groupBy("config").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "recall", "strict_recall", "mrr")])


def expected_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ir_metrics(spark, sf_dir).groupBy().pivot("config", ["R1", "R2", "R3", "R4"]).agg(F.max("ndcg"))
    return m.select((F.col("R3") >= F.greatest("R1", "R2")).alias("fusion_helps"), (F.col("R4") >= F.col("R3")).alias("rerank_helps"))


def _pooled(runs: DataFrame) -> DataFrame:
    return runs.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("configs"), F.min("rank").alias("best_rank"))


def pooled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the measured runs: as R4 only reorders R3, it adds no candidate. label_pool is the pool to label."""
    return _pooled(_runs(spark, sf_dir))


def label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's pool: R4 chooses its 20 from the 40 first fused, so it adds what the reranker lifts."""
    return _pooled(_runs(spark, sf_dir, 40))


def qrels_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the measured runs' pool is graded, for each question."""
    return _coverage(_graded(pooled_candidates(spark, sf_dir), spark, sf_dir))


def label_pool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the reference's pool is graded, for each question."""
    return _coverage(_graded(label_pool(spark, sf_dir), spark, sf_dir))


def _coverage(pool: DataFrame) -> DataFrame:
    return pool.groupBy("qid").agg(
        F.count(F.lit(1)).alias("pooled"), F.count("grade").alias("graded"), F.sum((F.coalesce("grade", F.lit(0)) >= 2).cast("long")).alias("strict"), (F.count("grade") >= F.count(F.lit(1))).alias("complete"), F.coalesce(F.bool_or(F.col("grade") >= 1), F.lit(False)).alias("has_relevant")
    )


def judged_but_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many judged ids of a question the corpus doesn't have; the corpus is what was ingested, passages of 200 characters or more."""
    corpus = _docs(spark, sf_dir).where(F.length("text") >= 200)
    lost = vectors(spark, sf_dir).join(corpus, "id", "left_anti").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _wanted(spark, sf_dir).join(lost, "label").groupBy("qid").agg(F.sum("n").alias("missing"))


def corpus_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of a snapshot by source type, section and year."""
    return passages(spark, sf_dir).groupBy("source_type", "section", F.substring("published", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("passages"), F.count_distinct("source_id").alias("sources"))


def label_health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by source, and over all sources in the row without a source."""
    both = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rate = F.round(F.avg(F.col("quality").cast("double")), 6).alias("rate")
    return both.rollup("source").agg(F.grouping("source").cast("int").alias("overall"), F.count(F.lit(1)).alias("labelled"), F.sum("quality").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"), rate, (F.countDistinct("quality") < 2).alias("degenerate"))


FEATURES = list(fs.IMPUTE)
ROUTES = ["evidence_store", "arxiv_meta", "web", "arxiv_fulltext", "elsewhere"]
VERDICTS = ["SUPPORTED", "PARTIAL", "UNSUPPORTED", "CONTRADICTED", "UNHEARD"]


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments as they are stored, a JSON text for each query, read into rows: qid, passage, grade (null where nobody judged yet). Queries are
    tens of neighbouring labelled documents."""
    each = read(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 10).alias("qid"), F.col("doc_id").cast("string").alias("passage"), F.when(F.col("doc_id") % 6 > 0, F.col("quality") + F.col("toxic")).cast("int").alias("grade"))
    stored = each.groupBy("qid").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("passage", "grade"))).alias("judgments")), {"ignoreNullFields": "false"}).alias("value"))
    held = stored.select("qid", F.from_json("value", "judgments map<string,int>").alias("j"))
    return held.select("qid", F.explode("j.judgments").alias("passage", "grade"))


def judgments_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query: its pool, judged passages, the histogram of grades, the rate of relevant ones, and whether it tells nothing (one grade only)."""
    j = _judgments(spark, sf_dir)
    of = lambda g: F.sum((F.coalesce("grade", F.lit(-1)) == g).cast("int"))
    return j.groupBy("qid").agg(
        F.count(F.lit(1)).alias("pool"), F.count("grade").alias("judged"), of(0).alias("n0"), of(1).alias("n1"), of(2).alias("n2"), F.round(F.coalesce(F.avg((F.col("grade") >= 1).cast("double")), F.lit(0.0)), 6).alias("rate"), (F.count_distinct("grade") < 2).alias("degenerate"))


def judgment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight totals over all queries with a judgment, and the spread of their rates."""
    q = judgments_loaded(spark, sf_dir).where("judged > 0")
    some, whole = F.col("n1") + F.col("n2") > 0, F.col("judged") >= F.col("pool")
    n = lambda ok: F.coalesce(F.sum(ok.cast("int")), F.lit(0))
    return q.agg(
        F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("judged"), F.lit(0)).alias("judgments"), F.coalesce(F.sum("pool"), F.lit(0)).alias("pooled"), F.coalesce(F.sum(F.col("n1") + F.col("n2")), F.lit(0)).alias("relevant"), n(some).alias("queries_with_relevant"), n(whole).alias("queries_complete"),
        n(some & whole).alias("queries_usable"), F.round(F.coalesce(F.avg("judged"), F.lit(0.0)), 6).alias("mean_judgments"), F.round(F.max("rate") - F.min("rate"), 6).alias("spread"), n(F.col("degenerate")).alias("degenerate"))


def sufficiency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten features of each question's evidence. Verdicts, checked premises, rounds and routes are rules on the question's id, as the tables have none."""
    best = saved(reranked(spark, sf_dir), "reranked")
    found = pairs_of(spark, sf_dir, best, most=None).groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    e = best.join(passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "source_id", "published"), "id")
    q = F.col("qid")
    some = lambda values, at, n: F.slice(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"), n.cast("int"))
    f = fs.evidence_features(e, "2026-09-06").join(found, "qid", "left")
    f = f.select(
        "qid", "n", "f1", "f2", "f3", "f4", fs.contradiction_rate(F.col("found"), F.col("n"), q % 7 != 0).alias("f5"), fs.entailment_strength(some(VERDICTS, q, q % 4)).alias("f6"),
        fs.premise_grounding(q % 5 != 0, (q % 3) / 2).alias("f7"), (q % 4).cast("double").alias("f8"), fs.route_escalation(some(ROUTES, q, q % 3)).alias("f9"), "f10",
    )
    return f.withColumn("completeness", fs.completeness(FEATURES))


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty columns: the features with their neutral values where they're missing, each with a flag that says so."""
    return sufficiency_features(spark, sf_dir).select("qid", *fs.vector_columns(FEATURES))


def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a question's evidence from different sources: of 15 pairs at most, those whose numbers differ most.

    The score is a stand-in for an entailment model: the share of the two texts' numbers that only one of them has."""
    return pairs_of(spark, sf_dir, reranked(spark, sf_dir))


def evidence_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a question's evidence that say the same but for a number, a negation or a date."""
    p = passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "source_id", "text")
    return conflicts(reranked(spark, sf_dir).select("qid", "id").join(p, "id"))


def pairs_of(spark: SparkSession, sf_dir: str, best: DataFrame, most: int | None = 15) -> DataFrame:
    """The contradictions among a question's pairs of passages from different sources: among its first so many, or among all."""
    e = best.join(passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "source_id", "text"), "id")
    numbers = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"[0-9]+"), F.lit(0)))
    e = e.select("qid", F.col("rank").alias("pos"), "id", "source_id", numbers.alias("numbers"))
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.pos") < F.col("b.pos")) & (F.col("a.source_id") != F.col("b.source_id"))).select(
        F.col("a.qid").alias("qid"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.numbers").alias("x"), F.col("b.numbers").alias("y")
    )
    if most is not None:
        pairs = r.top(pairs, most, ["qid"], F.col("pos_a"), F.col("pos_b"))
    union, both = F.size(F.array_union("x", "y")), F.size(F.array_intersect("x", "y"))
    scored = pairs.withColumn("score", F.when(union > 0, F.round((union - both) / union, 6)).otherwise(0.0))
    kept = scored.withColumn("scanned", F.count(F.lit(1)).over(Window.partitionBy("qid"))).where("score >= 0.6")
    return kept.select("qid", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "score", "scanned")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens_sql(column: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({_STOP}))"


def _bm25_sql(n: str = "", words: str = "") -> str:
    """The SQL of all scores, in tables whose names end with n, for the words of each question that the slice takes."""
    part = "qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))"
    return f"""dt{n} AS (SELECT doc_id AS id, {_tokens_sql("'Document ' || doc_id || '. ' || text")} AS ts, {_tokens_sql("text")} AS ps FROM documents WHERE coalesce(text, '') <> ''),
qt{n} AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_tokens_sql("text")}{words}) AS term FROM benchmark) GROUP BY ALL),
tf{n} AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM dt{n}) WHERE term IN (SELECT term FROM qt{n}) GROUP BY ALL),
df{n} AS (SELECT term, count(*) AS df FROM tf{n} GROUP BY term), nn{n} AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM dt{n}),
bm{n} AS (SELECT qid, id, round(sum({part}), 6) AS score FROM tf{n} JOIN df{n} USING (term) JOIN qt{n} USING (term), nn{n} GROUP BY qid, id HAVING round(sum({part}), 6) > 0)"""


_BM25_SQL = _bm25_sql()


def _top_sql(name: str, source: str, k: int, order: str = "score DESC, id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}) AS INT) AS rank FROM {source}) WHERE rank <= {k})"


_COS_SQL = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"
_SPARSE_SQL = f"{_BM25_SQL},\n{_top_sql('sparse', 'bm', DEPTH)}"
_DENSE_SQL = f"ds AS (SELECT q.vec_id AS qid, v.vec_id AS id, {_COS_SQL} AS score FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),\n{_top_sql('dense', 'ds', DEPTH)}"
_FUSE_SQL = """fz AS (SELECT qid, id, round(sum(1 / (60 + rank)), 9) AS rrf, max(rank) FILTER (arm = 'dense') AS dense_rank, max(rank) FILTER (arm = 'sparse') AS sparse_rank,
  max(score) FILTER (arm = 'dense') AS dense_score, max(score) FILTER (arm = 'sparse') AS sparse_score FROM (SELECT 'dense' AS arm, qid, id, rank, score FROM dense UNION ALL SELECT 'sparse', qid, id, rank, score FROM sparse) GROUP BY qid, id)"""
_FUSED_OUT = "SELECT qid, id, rrf, dense_rank, sparse_rank, dense_score, sparse_score, rank, dense_rank IS NOT NULL AND sparse_rank IS NOT NULL AS both FROM fused"
_OVERLAP_SQL = "round(CASE WHEN len(list_distinct(qq.ts)) > 0 THEN 12.0 * len(list_intersect(list_distinct(qq.ts), dt.ps)) / len(list_distinct(qq.ts)) - 4.0 ELSE -4.0 END, 6)"
_QQ_SQL = f"qq AS (SELECT item_id AS qid, {_tokens_sql('text')} AS ts FROM benchmark)"
_RERANK_SQL = f"""{_SPARSE_SQL}, {_QQ_SQL},
rr0 AS (SELECT sparse.qid, sparse.id, sparse.rank AS fusion_rank, sparse.score, {_OVERLAP_SQL} AS rerank_score FROM sparse JOIN dt USING (id) JOIN qq ON qq.qid = sparse.qid WHERE sparse.rank <= 30),
{_top_sql("rr", "rr0", 8, "rerank_score DESC, fusion_rank")}"""
_QRELS_SQL = """qv AS (SELECT vec_id AS qid, label AS want FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
qrels AS (SELECT qid, vec_id AS id, CASE WHEN label = want THEN 2 ELSE 1 END AS grade FROM qv JOIN embeddings ON label = want OR label = want + 1)"""
_RUNS_SQL = f"""{_DENSE_SQL}, {_SPARSE_SQL}, {_FUSE_SQL}, {_top_sql("fused", "fz", 20, "rrf DESC, id")}, {_QQ_SQL},
r40 AS (SELECT fused.qid, fused.id, fused.rank AS fusion_rank, {_OVERLAP_SQL} AS rerank_score FROM fused JOIN dt USING (id) JOIN qq ON qq.qid = fused.qid),
{_top_sql("r4", "r40", 20, "rerank_score DESC, fusion_rank")},
runs AS (SELECT 'R1' AS config, qid, id, rank FROM dense WHERE rank <= 20 UNION ALL SELECT 'R2', qid, id, rank FROM sparse WHERE rank <= 20 UNION ALL SELECT 'R3', qid, id, rank FROM fused UNION ALL SELECT 'R4', qid, id, rank FROM r4)"""
_LABEL_RUNS_SQL = f"""{_DENSE_SQL}, {_SPARSE_SQL}, {_FUSE_SQL}, {_top_sql("fused", "fz", 40, "rrf DESC, id")}, {_QQ_SQL},
r40 AS (SELECT fused.qid, fused.id, fused.rank AS fusion_rank, {_OVERLAP_SQL} AS rerank_score FROM fused JOIN dt USING (id) JOIN qq ON qq.qid = fused.qid WHERE fused.rank <= 30),
{_top_sql("r4", "r40", 20, "rerank_score DESC, fusion_rank")},
runs AS (SELECT 'R1' AS config, qid, id, rank FROM dense WHERE rank <= 20 UNION ALL SELECT 'R2', qid, id, rank FROM sparse WHERE rank <= 20 UNION ALL SELECT 'R3', qid, id, rank FROM fused WHERE rank <= 20 UNION ALL SELECT 'R4', qid, id, rank FROM r4)"""
_METRICS_SQL = f"""{_RUNS_SQL}, {_QRELS_SQL},
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS rank FROM qrels),
ideal AS (SELECT qid, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS ideal, count(*) AS relevant, count(*) FILTER (grade >= 2) AS strict FROM best GROUP BY qid),
graded AS (SELECT config, runs.qid, runs.id, rank, coalesce(grade, 0) AS grade FROM runs LEFT JOIN qrels ON runs.qid = qrels.qid AND runs.id = qrels.id),
own AS (SELECT config, qid, coalesce(sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg, count(*) FILTER (rank <= 20 AND grade >= 1) AS found, count(*) FILTER (rank <= 20 AND grade >= 2) AS found_strict, min(rank) FILTER (grade >= 2) AS first FROM graded GROUP BY ALL),
m AS (SELECT config, qid, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg, CASE WHEN relevant > 0 THEN found / relevant ELSE 0 END AS recall, CASE WHEN strict > 0 THEN found_strict / strict ELSE 0 END AS strict_recall, coalesce(1 / first, 0) AS mrr FROM own JOIN ideal USING (qid)),
ms AS (SELECT config, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(strict_recall), 6) AS strict_recall, round(avg(mrr), 6) AS mrr FROM m GROUP BY config)"""
_POOL_SQL = "pool AS (SELECT qid, id, count(*) AS configs, min(rank) AS best_rank FROM runs GROUP BY qid, id)"


def _pairs_sql(some: str = "") -> str:
    """The SQL of the contradictions among a question's pairs of passages; some: a condition on n, their place in the question."""
    return rf"""e AS (SELECT rr.qid, rr.rank AS pos, rr.id, source_id, list_distinct(regexp_extract_all(text, '[0-9]+')) AS nums FROM rr JOIN passages ON rr.id = passages.doc_id),
pr AS (SELECT a.qid, a.pos AS pa, b.pos AS pb, a.id AS ia, b.id AS ib, len(list_distinct(list_concat(a.nums, b.nums))) AS u, len(list_intersect(a.nums, b.nums)) AS c FROM e a JOIN e b ON a.qid = b.qid AND a.pos < b.pos AND a.source_id <> b.source_id),
pn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pa, pb) AS n FROM pr), pk AS (SELECT *, CASE WHEN u > 0 THEN round((u - c) / u, 6) ELSE 0.0 END AS score, count(*) OVER (PARTITION BY qid) AS scanned FROM pn{some}),
prs AS (SELECT qid, least(ia, ib) AS id_a, greatest(ia, ib) AS id_b, score, scanned FROM pk WHERE score >= 0.6)"""


_PAIRS_SQL = _pairs_sql(" WHERE n <= 15")
_FEATURES_SQL = f"""{_RERANK_SQL}, {PASSAGES_SQL},
ev AS (SELECT rr.qid, rr.rerank_score, source_id, published FROM rr JOIN passages ON rr.id = passages.doc_id),
g AS (SELECT qid, count(*) AS n, list(rerank_score ORDER BY rerank_score DESC) AS s, CAST(count(DISTINCT nullif(source_id, '')) AS DOUBLE) AS f4, list(CAST(published AS DATE) ORDER BY published) FILTER (published IS NOT NULL) AS d FROM ev GROUP BY qid),
f AS (SELECT qid, n, round(s[1], 6) AS f1, round(list_sum(s[1:3]) / len(s[1:3]), 6) AS f2, CASE WHEN len(s) >= 5 THEN round(s[1] - s[5], 6) END AS f3, f4,
  CASE WHEN len(d) > 0 THEN round(greatest(0, least(1, 1 - date_diff('day', d[CAST(len(d) // 2 + 1 AS INT)], DATE '2026-09-06') / 365.25 / 8)), 6) END AS f10 FROM g),
{_pairs_sql()}, cn AS (SELECT qid, count(*) AS found FROM prs GROUP BY qid),
h AS (SELECT f.*, CASE WHEN qid % 7 <> 0 THEN CASE WHEN n < 2 THEN 0.0 ELSE round(coalesce(found, 0) / (n * (n - 1) / 2), 6) END END AS f5,
  CASE WHEN qid % 4 > 0 THEN list_aggregate(list_transform({VERDICTS}[CAST(qid % 5 + 1 AS INT):CAST(least(5, qid % 5 + qid % 4) AS INT)], lambda v: CASE WHEN v = 'SUPPORTED' THEN 1.0 WHEN v IN ('UNSUPPORTED', 'CONTRADICTED') THEN 0.0 ELSE 0.5 END), 'avg') END AS f6,
  CASE WHEN qid % 5 <> 0 THEN (qid % 3) / 2 END AS f7, CAST(qid % 4 AS DOUBLE) AS f8,
  CASE WHEN qid % 3 > 0 THEN list_max(list_transform({ROUTES}[CAST(qid % 5 + 1 AS INT):CAST(least(5, qid % 5 + qid % 3) AS INT)], lambda v: CASE WHEN v = 'evidence_store' THEN 0 WHEN v = 'arxiv_fulltext' THEN 2 ELSE 1 END)) / 2 END AS f9 FROM f LEFT JOIN cn USING (qid)),
feats AS (SELECT qid, n, f1, f2, f3, f4, f5, round(f6, 6) AS f6, CAST(f7 AS DOUBLE) AS f7, f8, CAST(f9 AS DOUBLE) AS f9, f10, round(({" + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in fs.IMPUTE)}) / 10, 6) AS completeness FROM h)"""
_JUDGED_SQL = """jd AS (SELECT doc_id // 10 AS qid, CASE WHEN doc_id % 6 > 0 THEN quality + toxic END AS grade FROM labels),
jq AS (SELECT qid, count(*) AS pool, count(grade) AS judged, count(*) FILTER (grade = 0) AS n0, count(*) FILTER (grade = 1) AS n1, count(*) FILTER (grade = 2) AS n2, round(coalesce(avg(CAST(grade >= 1 AS DOUBLE)), 0.0), 6) AS rate, count(DISTINCT grade) < 2 AS degenerate FROM jd GROUP BY qid)"""
_ROUTE_SQL = "(['arxiv_meta', 'arxiv_fulltext', 'web', 'evidence_store'])[CAST(qid % 4 + 1 AS INT)]"

QUERIES = {
    "bm25_topk": bm25_topk, "bm25_statistics": bm25_statistics, "dense_topk": dense_topk, "rrf_fusion": rrf_fusion, "hybrid_filtered": hybrid_filtered, "route_fallback": route_fallback,
    "rerank_topk": rerank_topk, "ir_metrics": ir_metrics, "expected_ordering": expected_ordering, "pooled_candidates": pooled_candidates, "qrels_coverage": qrels_coverage,
    "judged_but_missing": judged_but_missing, "label_health_rollup": label_health_rollup, "sufficiency_features": sufficiency_features, "feature_vector": feature_vector, "contradiction_pairs": contradiction_pairs,
    "label_pool": label_pool, "label_pool_coverage": label_pool_coverage, "bm25_indexed": bm25_indexed, "bm25_append": bm25_append, "dense_threshold": dense_threshold, "domain_filter": domain_filter,
    "evidence_conflicts": evidence_conflicts, "fitted_metrics": fitted_metrics, "retrieve_modes": retrieve_modes, "corpus_types": corpus_types, "judgments_loaded": judgments_loaded, "judgment_totals": judgment_totals,
}

ORACLE_SQL = {
    "bm25_topk": f"WITH {_BM25_SQL}, {_top_sql('t', 'bm', 10)} SELECT qid, id, score, rank FROM t",
    "bm25_statistics": f"WITH {_BM25_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM dt) GROUP BY ALL) GROUP BY term",
    "dense_topk": f"WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, {_COS_SQL} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), {_top_sql('t', 's', 10)} SELECT qid, id, score, rank FROM t",
    "rrf_fusion": f"WITH {_DENSE_SQL}, {_SPARSE_SQL}, {_FUSE_SQL}, {_top_sql('fused', 'fz', 10, 'rrf DESC, id')} {_FUSED_OUT}",
    "hybrid_filtered": f"""WITH {PASSAGES_SQL}, ok AS (SELECT doc_id AS id FROM passages WHERE published >= '{AFTER}' AND coalesce(section <> 'Abstract', true)),
ds AS (SELECT q.vec_id AS qid, v.vec_id AS id, {_COS_SQL} AS score FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT id FROM ok)), {_top_sql('dense', 'ds', DEPTH)},
{_BM25_SQL}, bf AS (SELECT * FROM bm WHERE id IN (SELECT id FROM ok)), {_top_sql('sparse', 'bf', DEPTH)}, {_FUSE_SQL}, {_top_sql('fused', 'fz', 10, 'rrf DESC, id')} {_FUSED_OUT}""",
    "route_fallback": f"""WITH {_BM25_SQL}, {PASSAGES_SQL}, {_QQ_SQL}, s AS (SELECT qid, bm.id, {_ROUTE_SQL} AS route, score, source_type, section FROM bm JOIN passages ON bm.id = doc_id),
o AS (SELECT *, CASE route WHEN 'arxiv_meta' THEN source_type = 'arxiv' AND coalesce(section = 'Abstract', false) WHEN 'arxiv_fulltext' THEN source_type = 'arxiv' AND coalesce(section <> 'Abstract', true) WHEN 'web' THEN source_type = 'web' ELSE true END AS ok FROM s),
w AS (SELECT *, NOT bool_or(ok) OVER (PARTITION BY qid) AS fallback FROM o), x AS (SELECT * FROM w WHERE ok OR fallback), {_top_sql('t', 'x', 30)}, y AS (SELECT t.qid, t.id, route, score, t.rank AS fusion_rank, fallback, {_OVERLAP_SQL} AS rerank_score FROM t JOIN dt USING (id) JOIN qq ON qq.qid = t.qid),
{_top_sql('z', 'y', 10, 'rerank_score DESC, fusion_rank')} SELECT qid, id, route, score, fusion_rank, rerank_score, rank, fallback FROM z""",
    "rerank_topk": f"WITH {_RERANK_SQL} SELECT qid, id, fusion_rank, score, rerank_score, rank FROM rr",
    "ir_metrics": f"WITH {_METRICS_SQL} SELECT * FROM ms",
    "expected_ordering": f"WITH {_METRICS_SQL}, o AS (SELECT max(ndcg) FILTER (config = 'R1') AS a, max(ndcg) FILTER (config = 'R2') AS b, max(ndcg) FILTER (config = 'R3') AS c, max(ndcg) FILTER (config = 'R4') AS d FROM ms) SELECT c >= greatest(a, b) AS fusion_helps, d >= c AS rerank_helps FROM o",
    "pooled_candidates": f"WITH {_RUNS_SQL}, {_POOL_SQL} SELECT * FROM pool",
    "qrels_coverage": f"WITH {_RUNS_SQL}, {_POOL_SQL}, {_QRELS_SQL} SELECT pool.qid, count(*) AS pooled, count(grade) AS graded, count(*) FILTER (grade >= 2) AS strict, count(grade) >= count(*) AS complete, coalesce(bool_or(grade >= 1), false) AS has_relevant FROM pool LEFT JOIN qrels ON pool.qid = qrels.qid AND pool.id = qrels.id GROUP BY pool.qid",
    "label_pool": f"WITH {_LABEL_RUNS_SQL}, {_POOL_SQL} SELECT * FROM pool",
    "label_pool_coverage": f"WITH {_LABEL_RUNS_SQL}, {_POOL_SQL}, {_QRELS_SQL} SELECT pool.qid, count(*) AS pooled, count(grade) AS graded, count(*) FILTER (grade >= 2) AS strict, count(grade) >= count(*) AS complete, coalesce(bool_or(grade >= 1), false) AS has_relevant FROM pool LEFT JOIN qrels ON pool.qid = qrels.qid AND pool.id = qrels.id GROUP BY pool.qid",
    "judged_but_missing": f"WITH {_QRELS_SQL} SELECT qid, count(*) AS missing FROM qrels WHERE id NOT IN (SELECT doc_id FROM documents WHERE length(text) >= 200) GROUP BY qid",
    "label_health_rollup": "SELECT source, CAST(grouping(source) AS INT) AS overall, count(*) AS labelled, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic, round(avg(CAST(quality AS DOUBLE)), 6) AS rate, count(DISTINCT quality) < 2 AS degenerate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)",
    "sufficiency_features": f"WITH {_FEATURES_SQL} SELECT * FROM feats",
    "feature_vector": f"WITH {_FEATURES_SQL} SELECT qid, " + ", ".join(f"coalesce({c}, {v}) AS {c}, CAST({c} IS NULL AS INT) AS {c}_missing" for c, v in fs.IMPUTE.items()) + " FROM feats",
    "contradiction_pairs": f"WITH {_RERANK_SQL}, {PASSAGES_SQL}, {_PAIRS_SQL} SELECT * FROM prs",
    "bm25_indexed": f"WITH {_BM25_SQL}, {_top_sql('t', 'bm', 10)}, {_bm25_sql('2', '[1:8]')}, {_top_sql('t2', 'bm2', 10)} SELECT 'all' AS words, * FROM t UNION ALL SELECT 'first', * FROM t2",
    "bm25_append": f"WITH {_BM25_SQL}, {_top_sql('t', 'bm', 10)} SELECT qid, id, score, rank FROM t",
    "dense_threshold": f"WITH {_DENSE_SQL}, dd AS (SELECT qid, id, score FROM dense WHERE score >= 0.3), {_top_sql('t', 'dd', 10)} SELECT qid, id, score, rank FROM t",
    "domain_filter": f"""WITH {PASSAGES_SQL}, pg AS (SELECT page_id, {DOMAIN_SQL} AS dom FROM pages), dm AS (SELECT DISTINCT dom FROM pg ORDER BY dom LIMIT 3),
ok AS (SELECT doc_id AS id FROM passages JOIN pg ON page_id = doc_id WHERE dom IN (SELECT dom FROM dm) AND published >= '{PAGES_AFTER}'), {_BM25_SQL}, bf AS (SELECT * FROM bm WHERE id IN (SELECT id FROM ok)), {_top_sql('t', 'bf', 10)} SELECT qid, id, score, rank FROM t""",
    "retrieve_modes": f"""WITH {_DENSE_SQL}, {_SPARSE_SQL}, lists AS (SELECT 'dense' AS arm, qid, id, rank FROM dense UNION ALL SELECT 'sparse', qid, id, rank FROM sparse),
md AS (SELECT 'weighted' AS mode, *, CASE arm WHEN 'dense' THEN 0.7 ELSE 1.3 END AS w FROM lists UNION ALL SELECT arm || '_only', *, 1.0 FROM lists),
sc AS (SELECT mode, qid, id, round(sum(w / (60 + rank)), 9) AS rrf, count(*) = 2 AS two FROM md WHERE qid IN (SELECT item_id FROM benchmark WHERE trim(text) <> '') GROUP BY mode, qid, id)
SELECT mode, qid, id, rrf, CAST(row_number() OVER (PARTITION BY mode, qid ORDER BY rrf DESC, id) AS INT) AS rank, two AS both FROM sc QUALIFY rank <= 10""",
    "judgments_loaded": f"WITH {_JUDGED_SQL} SELECT * FROM jq",
    "judgment_totals": f"""WITH {_JUDGED_SQL}, k AS (SELECT *, n1 + n2 > 0 AS s1, judged >= pool AS w1 FROM jq WHERE judged > 0) SELECT count(*) AS queries, CAST(sum(judged) AS BIGINT) AS judgments, CAST(sum(pool) AS BIGINT) AS pooled, CAST(sum(n1 + n2) AS BIGINT) AS relevant, count(*) FILTER (s1) AS queries_with_relevant, count(*) FILTER (w1) AS queries_complete,
  count(*) FILTER (s1 AND w1) AS queries_usable, round(avg(judged), 6) AS mean_judgments, round(max(rate) - min(rate), 6) AS spread, count(*) FILTER (degenerate) AS degenerate FROM k""",
    "corpus_types": f"WITH {PASSAGES_SQL} SELECT source_type, section, substr(published, 1, 4) AS year, count(*) AS passages, count(DISTINCT source_id) AS sources FROM passages GROUP BY ALL",
}
