"""Queries over drafts: sentences and their verdicts, citations, evidence of questions, premises, and what a report says.

Sentences, raw verdicts and cited labels of a run are rules on the keys of its questions, as the tables have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import text as t
from groundwell.operators import drafts as dr
from groundwell.operators import features as fs
from groundwell.operators import passages as op
from groundwell.operators import retrieval as r
from groundwell.operators import rules
from groundwell.plans import decisions, retrieval
from groundwell.sources.tables import PASSAGES_SQL, PLAN_SQL, passages, plan_rows, read

RAW = ["SUPPORTED", "PARTIAL", "UNSUPPORTED", "CONTRADICTED", "NOT_A_CLAIM", "GAP_STATEMENT", "GIBBERISH"]
STRAY = ["", " [citation needed]", " [UNRESOLVED]", " [Pabcdefabcdef]", " [3]"]
#: Forms of citations that models write, and the form that is wanted.
FORMS = {" [P1, P3]": " [P01][P03]", " 【P7】": " [P07]", " (P5 and P12)": " [P05][P12]", " [P2-P4; P9]": " [P02][P03][P04][P09]", " [P1-P99]": " [P1-P99]", " [P08]": " [P08]"}


def _nth(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, idx, pos, seed and citations (passages): three sentences for each question of a run."""
    p = plan_rows(spark, sf_dir).select("run", "pos", "part", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    cited = F.slice(F.array((F.col("part") + 3) % 12, (F.col("part") + 7) % 12), 1, ((F.col("part") + F.col("k")) % 3).cast("int"))
    return p.select("run", ((F.col("pos") - 1) * 3 + F.col("k")).alias("idx"), "pos", (F.col("part") + F.col("k")).alias("seed"), F.col("part").alias("part"), cited.alias("citations"))


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence as discourse, gap or claim, with its verdict and owner."""
    s = sentences(spark, sf_dir)
    said = F.array(F.when(F.col("seed") % 11 > 0, F.struct(F.lit(1).alias("turn"), _nth(RAW, F.col("seed")).alias("name"))), F.when((F.col("part") % 2 == 0) & (F.col("seed") % 11 > 0), F.struct(F.lit(2).alias("turn"), _nth(RAW, F.col("seed") + 3).alias("name"))))
    given = rules.last_verdicts(s.select("run", "idx", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("v")).select("run", "idx", "v.*"))
    owners = decisions.passage_owner(spark, sf_dir).select("run", "passage", F.concat(F.lit("sq"), F.col("owner").cast("string")).alias("owner"))
    return rules.judged_sentences(s, given, owners)


def claim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dr.claim_counts(claim_verdicts(spark, sf_dir))


def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that a draft cites (the first ones of its run), as the passages they stand for."""
    shown = decisions.round_robin_evidence(spark, sf_dir)
    cited = shown.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), (F.col("run") % 14 + 1).cast("int"))).alias("place"))
    return dr.cited_passages(cited, shown).select("run", F.array_join(F.col("passages").cast("array<string>"), ",").alias("passages"), "unknown")


def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with citations as models write them and stray remarks: the plain form, the text without remarks, and sentences that cite nothing."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    written = F.concat("text", _nth(list(FORMS), F.col("turn") + F.col("conv_id")))
    marked = F.concat("text", _nth(STRAY, F.col("turn") + F.col("conv_id")), F.lit("."))
    return c.select("conv_id", "turn", F.md5(op.plain_citations(written)).alias("plain_md5"), F.md5(op.without_markers(marked)).alias("unmarked_md5"), op.uncited(marked).alias("uncited"))


def evidence_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each question in its order; a question without a list gets the run's passages that were stored under it, by passage."""
    held = decisions.evidence(spark, sf_dir)
    stored = held.select("run", (F.col("passage") % 7 + 1).cast("int").alias("pos"), "passage")
    return dr.evidence_of(plan_rows(spark, sf_dir), held, stored)


def own_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each question's evidence, by its own scores where it has them, or else by those of the question that came first."""
    e = decisions.evidence(spark, sf_dir).withColumn("score", F.round((F.col("passage") * 7 + F.col("pos")) % 10 / 2, 6))
    return dr.best_scores(e, e.where("pos % 3 > 0"))


def evidence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that a draft is written from."""
    return dr.selected(decisions.evidence(spark, sf_dir))


def draft_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turns as a draft, joined to findings on the text in lower case without extra blanks; of several findings the first."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("draft"), F.col("turn").alias("at"), "text", _nth(RAW[:4], F.col("turn") + F.col("conv_id")).alias("verdict"))
    return dr.with_findings(c, c.where("at % 3 <> 1")).select(F.col("draft").alias("conv_id"), F.col("at").alias("turn"), "verdict")


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The footnotes of runs with the passage behind each (documents whose id is the passage's number), in order; unknown ones stay, empty."""
    from groundwell.plans import records

    p = passages(spark, sf_dir).where("doc_id % 5 <> 3").select(F.col("doc_id").alias("passage"), "title", "source_id", "section")
    return records.footnotes(spark, sf_dir).select("run", "number", "passage").join(retrieval.r.small(p.where("passage < 12")), "passage", "left").select("run", "number", "title", "source_id", "section")


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sources of each question's evidence: 0 of a question without any, where the feature is missing."""
    of = passages(spark, sf_dir).where("doc_id < 12").select(F.col("doc_id").alias("passage"), F.when(F.col("doc_id") % 5 != 3, F.col("source_id")).alias("source_id"))
    e = decisions.evidence(spark, sf_dir).select(F.struct("run", "pos").alias("qid"), "passage").join(r.small(of), "passage", "left")
    return fs.source_counts(plan_rows(spark, sf_dir).select(F.struct("run", "pos").alias("qid")), e).select("qid.run", "qid.pos", "sources", "f4")


def premise_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four questions of a run as claims, with verdicts by number: numbers out of range are dropped, labels become passages, unknown ones go."""
    p = plan_rows(spark, sf_dir)
    claims = p.select("run", (F.col("pos") - 1).alias("idx"), F.col("kind").alias("centrality"))
    said = p.select("run", F.col("pos").alias("at"), (F.col("part") % 6).cast("int").alias("idx"), _nth(["SUPPORTED", "UNVERIFIABLE", "CONTRADICTED"], F.col("supp")).alias("verdict"), (F.col("part") % 16).cast("int").alias("label"))
    return dr.premises(claims, said, decisions.round_robin_evidence(spark, sf_dir))


def premise_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model lists as a question's premises (the turns of a conversation, every third as a bare string, every fifth without a text), read from its reply."""
    c = read(spark, sf_dir, "conversations").where("turn < 12").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    said = F.when(F.col("turn") % 2 == 0, "Incidental").when(F.col("turn") % 7 != 0, "core")
    whole = F.to_json(F.struct(F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("text")).alias("text"), said.alias("centrality")))
    item = F.when(F.col("turn") % 3 == 2, F.concat(F.lit('"'), F.md5("text"), F.lit('"'))).otherwise(whole)
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))), lambda v: v["x"]), ",")
    replies = c.groupBy(F.col("conv_id").alias("run")).agg(F.concat(F.lit('{"presuppositions":['), one, F.lit("]}")).alias("reply"))
    return dr.extracted_premises(replies).select(F.col("run").alias("conv_id"), "idx", F.md5("text").alias("text_md5"), "centrality")


def premise_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of ten neighbouring questions as claims: twelve candidates of each, of which four stay after reranking, labelled as they first appear."""
    claims = read(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 10).alias("run"), (F.col("item_id") % 10).alias("claim"), F.col("item_id").alias("qid"), F.col("text").alias("question")).where("claim < 4")
    first = r.top(retrieval._bm25(spark, sf_dir), 12, ["qid"], F.desc("score"), "id").join(r.small(claims), "qid")
    both = first.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage")), "id")
    return rules.labelled(r.rerank(both, 4, 12, r.overlap_logit(F.col("question"), F.col("passage"))))


def premise_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planner is told: the first four confirmed claims, and the first correction of a core claim that was contradicted."""
    return dr.premise_note(premise_verdicts(spark, sf_dir).select("run", "idx", "centrality", "verdict", F.concat(F.lit("claim "), F.col("idx").cast("string")).alias("text"), F.concat(F.lit("see passage "), F.col("passage").cast("string")).alias("correction")))


def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt's evidence of each question."""
    e = retrieval.reranked(spark, sf_dir).join(passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "source_id", "section", "text"), "id")
    return dr.evidence_block(e, "qid").select("qid", F.length("block").alias("chars"), F.md5("block").alias("evidence_md5"))


def question_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's gaps as a report lists them."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", t.gap_line(F.col("text")).alias("gap"))
    derived = lambda ok: F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct("turn", "gap")))), lambda x: x["gap"])
    g = c.groupBy("conv_id").agg(derived(F.col("turn") % 4 < 2).alias("recorded"), derived(F.col("turn") % 2 == 0).alias("unresolved"))
    decided = F.when(F.col("conv_id") % 3 == 0, F.slice("unresolved", 1, 2)).when(F.col("conv_id") % 3 == 1, F.array().cast("array<string>"))
    listed = dr.listed_gaps(decided, F.col("recorded"), F.col("unresolved"))
    return g.select("conv_id", F.size(listed).alias("gaps"), F.md5(F.array_join(dr.shown_gaps(listed), "\n")).alias("list_md5"))


def banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline of each run's report, and why a threshold decided so."""
    open_ = decisions.resolve_heuristic(spark, sf_dir).where("kind = 'core'").groupBy("run").agg(
        F.sum(F.col("resolved").cast("int")).alias("done"), F.count(F.lit(1)).alias("of"), F.sort_array(F.collect_list(F.when(~F.col("resolved"), F.col("pos")))).alias("open"))
    d = decisions.decide_terminal(spark, sf_dir).join(open_, "run", "left")
    text = dr.rationale(F.col("score"), F.col("done"), F.col("of"), F.col("open"), F.col("terminal"))
    return d.select("run", dr.banner(F.col("rule"), F.col("terminal")).alias("banner"), F.when(F.col("rule") == "threshold", text).alias("rationale"))


_EV, _FIND = decisions._EV, decisions._FIND
_D = decisions.ORACLE_SQL
_RAW = "(['SUPPORTED', 'PARTIAL', 'UNSUPPORTED', 'CONTRADICTED', 'NOT_A_CLAIM', 'GAP_STATEMENT', 'GIBBERISH'])"
_CLAIMS_SQL = f"""{PLAN_SQL}, {_EV}, st0 AS (SELECT run, pos, part, unnest([0, 1, 2]) AS k FROM plan),
st AS (SELECT run, (pos - 1) * 3 + k AS idx, part, part + k AS seed, ([(part + 3) % 12, (part + 7) % 12])[1:CAST((part + k) % 3 AS INT)] AS cites FROM st0),
gv AS (SELECT run, idx, CASE WHEN part % 2 = 0 THEN {_RAW}[CAST((seed + 3) % 7 + 1 AS INT)] ELSE {_RAW}[CAST(seed % 7 + 1 AS INT)] END AS name FROM st WHERE seed % 11 > 0),
ow AS (SELECT run, passage, pos AS owner FROM ev QUALIFY row_number() OVER (PARTITION BY run, passage ORDER BY status = 'abandoned', pos, rank) = 1),
co AS (SELECT run, idx, min_by(owner, nth) AS owner FROM (SELECT run, idx, unnest(cites) AS passage, generate_subscripts(cites, 1) AS nth FROM st) JOIN ow USING (run, passage) GROUP BY ALL),
j AS (SELECT st.run, st.idx, len(cites) > 0 AS has, CASE WHEN name IS NULL OR name = 'GIBBERISH' THEN 'UNSUPPORTED' ELSE name END AS v, owner FROM st LEFT JOIN gv ON st.run = gv.run AND st.idx = gv.idx LEFT JOIN co ON st.run = co.run AND st.idx = co.idx),
cv AS (SELECT run, idx, CASE WHEN v = 'NOT_A_CLAIM' THEN 'discourse' WHEN v = 'GAP_STATEMENT' AND NOT has THEN 'gap' ELSE 'claim' END AS kind, CASE WHEN NOT has OR v = 'GAP_STATEMENT' THEN 'UNSUPPORTED' ELSE v END AS v, coalesce('sq' || owner, '') AS o FROM j),
cl AS (SELECT run, idx, kind, CASE WHEN kind = 'claim' THEN v END AS verdict, CASE WHEN kind = 'claim' THEN o END AS owner FROM cv)"""
_PREMISES_SQL = f"""sd AS (SELECT run, CAST(part % 6 AS INT) AS idx, max_by((['SUPPORTED', 'UNVERIFIABLE', 'CONTRADICTED'])[CAST(supp % 3 + 1 AS INT)], pos) AS verdict, max_by(CAST(part % 16 AS INT), pos) AS label FROM plan GROUP BY ALL),
pv AS (SELECT c.run, c.pos - 1 AS idx, c.kind AS centrality, verdict, r.passage FROM plan c JOIN sd ON sd.run = c.run AND sd.idx = c.pos - 1 LEFT JOIN ({_D['round_robin_evidence']}) r ON r.run = c.run AND r.place = sd.label WHERE c.pos <= 4)"""
_FORM = "(" + repr(list(FORMS)) + ")[CAST((turn + conv_id) % 6 + 1 AS INT)]"
_MARK = "(" + repr(STRAY) + ")[CAST((turn + conv_id) % 5 + 1 AS INT)]"
_GAP_SQL = r"""c AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '[ .]+$', '') AS p FROM conversations WHERE role = 'user'),
g AS (SELECT conv_id, turn, 'could not establish: ' || CASE WHEN length(p) > 200 THEN regexp_replace(regexp_replace(substr(p, 1, 200), ' [^ ]*$', ''), '[ ,;:]+$', '') || '…' ELSE p END AS gap FROM c)"""

QUERIES = {
    f.__name__: f
    for f in (
        claim_verdicts, claim_summary, citation_labels, citation_forms, evidence_for, own_scores, evidence_select, draft_findings, source_list, premise_verdicts, source_counts, premise_claims, premise_evidence, premise_note, evidence_text, question_gaps, banners,
    )
}

ORACLE_SQL = {
    "claim_verdicts": f"WITH {_CLAIMS_SQL} SELECT * FROM cl",
    "claim_summary": f"WITH {_CLAIMS_SQL} SELECT run, CAST(count(*) FILTER (kind = 'claim' AND verdict <> 'CONTRADICTED') AS BIGINT) AS kept, count(*) FILTER (verdict = 'SUPPORTED') AS supported, count(*) FILTER (verdict IN ('PARTIAL', 'UNSUPPORTED')) AS marked, count(*) FILTER (verdict = 'CONTRADICTED') AS dropped, count(*) FILTER (kind = 'discourse') AS discourse, count(*) FILTER (kind = 'gap') AS gaps FROM cl GROUP BY run",
    "citation_labels": f"WITH r AS ({_D['round_robin_evidence']}), n AS (SELECT DISTINCT run, unnest(generate_series(1, CAST(run % 14 + 1 AS INT))) AS place FROM r) SELECT n.run, coalesce(string_agg(CAST(passage AS VARCHAR), ',' ORDER BY n.place), '') AS passages, count(*) FILTER (passage IS NULL) AS unknown FROM n LEFT JOIN r ON n.run = r.run AND n.place = r.place GROUP BY n.run",
    "citation_forms": rf"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || (['{"', '".join(FORMS.values())}'])[CAST((turn + conv_id) % 6 + 1 AS INT)] AS plain, coalesce(text, '') || {_MARK} || '.' AS marked, coalesce(text, '') || CASE WHEN (turn + conv_id) % 5 IN (1, 2) THEN '.' ELSE {_MARK} || '.' END AS clean FROM conversations)
SELECT conv_id, turn, md5(plain) AS plain_md5, md5(clean) AS unmarked_md5, CAST(len(list_filter(string_split(regexp_replace(marked, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 40 AND NOT regexp_matches(s, '\[(P[0-9a-f]{{12}})\]'))) AS INT) AS uncited FROM c""",
    "evidence_for": f"""WITH {PLAN_SQL}, {_EV}, s AS (SELECT DISTINCT run, passage, CAST(passage % 7 + 1 AS INT) AS pos FROM ev)
SELECT run, pos, rank, passage, false AS fallback FROM ev UNION ALL SELECT s.run, s.pos, CAST(row_number() OVER (PARTITION BY s.run, s.pos ORDER BY passage) AS INT), passage, true FROM plan JOIN s ON plan.run = s.run AND plan.pos = s.pos WHERE supp % 5 = 0""",
    "own_scores": f"""WITH {PLAN_SQL}, {_EV}, e AS (SELECT *, (passage * 7 + pos) % 10 / 2 AS score FROM ev), f AS (SELECT run, passage, score AS stored FROM e QUALIFY row_number() OVER (PARTITION BY run, passage ORDER BY pos, rank) = 1),
b AS (SELECT e.run, e.pos, stored, CASE WHEN e.pos % 3 > 0 THEN score ELSE stored END AS x FROM e JOIN f ON e.run = f.run AND e.passage = f.passage) SELECT run, pos, max(x) AS f1, count(*) FILTER (x <> stored) AS overridden FROM b GROUP BY ALL""",
    "evidence_select": f"WITH {PLAN_SQL}, {_EV}, f AS (SELECT run, passage, status = 'abandoned' AS dead, pos, rank FROM ev QUALIFY row_number() OVER (PARTITION BY run, passage ORDER BY status = 'abandoned', pos, rank) = 1) SELECT run, passage, CAST(row_number() OVER (PARTITION BY run ORDER BY dead, pos, rank, passage) AS INT) AS place, NOT dead AS live FROM f QUALIFY place <= 24",
    "draft_findings": r"""WITH c AS (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS norm FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, norm, min_by((['SUPPORTED', 'PARTIAL', 'UNSUPPORTED', 'CONTRADICTED'])[CAST((turn + conv_id) % 4 + 1 AS INT)], turn) AS verdict FROM c WHERE turn % 3 <> 1 GROUP BY ALL) SELECT c.conv_id, c.turn, verdict FROM c LEFT JOIN f ON c.conv_id = f.conv_id AND c.norm = f.norm""",
    "source_list": f"WITH {PLAN_SQL}, {_EV}, {PASSAGES_SQL.replace('p AS (', 'pp AS (', 1).replace('FROM p)', 'FROM pp)')}, f AS (SELECT run, passage, min(pos * 100 + rank) AS first FROM ev WHERE status <> 'abandoned' GROUP BY ALL), n AS (SELECT run, passage, CAST(row_number() OVER (PARTITION BY run ORDER BY first, passage) AS INT) AS number FROM f) SELECT run, number, title, source_id, section FROM n LEFT JOIN (SELECT * FROM passages WHERE doc_id % 5 <> 3) x ON doc_id = passage",
    "premise_evidence": f"""WITH {retrieval._BM25_SQL}, {retrieval._QQ_SQL}, b12 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS fr FROM bm QUALIFY fr <= 12),
k AS (SELECT b12.qid, b12.id, fr, {retrieval._OVERLAP_SQL} AS rs FROM b12 JOIN dt USING (id) JOIN qq ON qq.qid = b12.qid), t AS (SELECT qid // 10 AS run, qid % 10 AS claim, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rs DESC, fr) AS INT) AS rank FROM k WHERE qid % 10 < 4 QUALIFY rank <= 4),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY run, id ORDER BY claim, rank) = 1) SELECT run, id, claim, rank, printf('P%02d', row_number() OVER (PARTITION BY run ORDER BY claim, rank, id)) AS label FROM f""",
    "premise_verdicts": f"WITH {PLAN_SQL}, {_PREMISES_SQL} SELECT * FROM pv",
    "source_counts": f"""WITH {PLAN_SQL}, {_EV}, {PASSAGES_SQL.replace('p AS (', 'pp AS (', 1).replace('FROM p)', 'FROM pp)')}, x AS (SELECT doc_id AS passage, CASE WHEN doc_id % 5 <> 3 THEN nullif(source_id, '') END AS src FROM passages WHERE doc_id < 12),
n AS (SELECT run, pos, count(DISTINCT src) AS k FROM ev LEFT JOIN x USING (passage) GROUP BY run, pos) SELECT p.run, p.pos, coalesce(k, 0) AS sources, CAST(k AS DOUBLE) AS f4 FROM plan p LEFT JOIN n ON n.run = p.run AND n.pos = p.pos""",
    "premise_claims": """WITH c AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS text FROM conversations WHERE turn < 12 AND turn % 3 <> 2 AND turn % 5 <> 4)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, md5(text) AS text_md5, CASE WHEN turn % 2 = 0 THEN 'incidental' ELSE 'core' END AS centrality FROM c WHERE text <> '' QUALIFY idx < 4""",
    "premise_note": f"""WITH {PLAN_SQL}, {_PREMISES_SQL}, b AS (SELECT *, verdict = 'CONTRADICTED' AND centrality = 'core' AS bad FROM pv)
SELECT run, coalesce(array_to_string((list('claim ' || idx ORDER BY idx) FILTER (verdict = 'SUPPORTED'))[1:4], '; '), '') AS established, bool_or(bad) AS warned, min_by('see passage ' || passage, idx) FILTER (bad AND passage IS NOT NULL) AS correction FROM b GROUP BY run""",
    "evidence_text": f"""WITH {PASSAGES_SQL}, r AS ({retrieval.ORACLE_SQL['rerank_topk']}), w AS (SELECT qid, string_agg(printf('[P%02d] ', rank) || concat_ws(', ', source_id, section) || chr(10) || substr(text, 1, 900), chr(10) || chr(10) ORDER BY rank) AS w FROM r JOIN passages ON r.id = passages.doc_id GROUP BY qid)
SELECT qid, CAST(length(w) AS INT) AS chars, md5(w) AS evidence_md5 FROM w""",
    "question_gaps": rf"""WITH {_GAP_SQL}, l AS (SELECT conv_id, coalesce(list(gap ORDER BY turn) FILTER (turn % 4 < 2), []) AS r, coalesce(list(gap ORDER BY turn) FILTER (turn % 2 = 0), []) AS u FROM g GROUP BY conv_id),
x AS (SELECT conv_id, list_concat(r, u) AS a, u FROM l), d AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN u[1:2] WHEN 1 THEN [] ELSE list_filter(a, lambda v, i: list_position(a, v) = i) END AS g FROM x)
SELECT conv_id, CAST(len(g) AS INT) AS gaps, md5(coalesce(array_to_string(list_transform(g, lambda v: trim(regexp_replace(v, '^could not establish: ', '')) || CASE WHEN regexp_matches(v, '[.?!]$') THEN '' ELSE '.' END), chr(10)), '')) AS list_md5 FROM d""",
    "banners": f"""WITH d AS ({_D['decide_terminal']}), h AS ({_D['resolve_heuristic']}), o AS (SELECT run, count(*) FILTER (resolved) AS done, count(*) AS n, list('sq' || pos ORDER BY pos) FILTER (NOT resolved) AS open FROM h WHERE kind = 'core' GROUP BY run)
SELECT d.run, CASE rule {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in list(dr.BANNERS.items())[:3])} ELSE CASE terminal {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in list(dr.BANNERS.items())[3:])} END END AS banner,
  CASE WHEN rule = 'threshold' THEN printf('%.2f: ', score) || done || ' of ' || n || ' resolved.' || CASE WHEN len(open) > 0 AND terminal <> 'ANSWER' THEN ' Not established: ' || array_to_string(open[1:3], '; ') || CASE WHEN len(open) > 3 THEN ' (+' || (len(open) - 3) || ' more)' ELSE '' END || '.' ELSE '' END END AS rationale FROM d LEFT JOIN o ON d.run = o.run""",
}
