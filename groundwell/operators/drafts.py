"""What a draft is written from and what becomes of it: evidence of questions, citations, findings, premises, gaps, headlines.

A run's rows have its key in `run`, those of a question its place in the plan in `pos`. An evidence list (`listed`) has run, pos, status
(of the question; abandoned ones are dead, all others live), rank and passage. Rows with a null run
are a run of their own where rows are grouped, and meet nothing where two tables meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import text as t

MOST_PASSAGES, MOST_PREMISES, MOST_OPEN = 24, 4, 3
GAP_PREFIX = "^could not establish: "
BANNERS = {"premise": "Rests on a false premise", "system_failure": "The run failed", "no_evidence": "No evidence was found", "ANSWER": "Answered", "PARTIAL": "Answered in part", "ABSTAIN": "Not answered"}


def _dead() -> Column:
    return F.col("status").eqNullSafe("abandoned")


def owners(listed: DataFrame) -> DataFrame:
    """run, passage, owner (pos) and live: a passage belongs to the first live question that lists it, or else to the first dead one."""
    e = listed.groupBy("run", "passage").agg(F.min(F.struct(_dead().cast("int").alias("dead"), "pos")).alias("o"))
    return e.select("run", "passage", F.col("o.pos").alias("owner"), (F.col("o.dead") == 0).alias("live"))


def selected(listed: DataFrame, most: int = MOST_PASSAGES) -> DataFrame:
    """run, passage, place and live: passages of live questions in plan order, then the others, each once, `most` of a run."""
    first = listed.groupBy("run", "passage").agg(F.min(F.struct(_dead().cast("int").alias("dead"), "pos", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("at.dead", "at.pos", "at.rank", "passage"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("run", "passage", "place", (F.col("at.dead") == 0).alias("live"))


def round_robin(listed: DataFrame, most: int = MOST_PASSAGES) -> DataFrame:
    """run, passage, place and live: each live question's best passage, then each one's next; passages of no live question come last."""
    live = F.when(~_dead(), F.struct("rank", "pos"))
    first = listed.groupBy("run", "passage").agg(F.min(live).alias("at"), F.min(F.struct("pos", "rank")).alias("dead"))
    order = Window.partitionBy("run").orderBy(F.col("at.rank").asc_nulls_last(), "at.pos", "dead.pos", "dead.rank", "passage")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("run", "passage", "place", F.col("at").isNotNull().alias("live"))


def evidence_of(questions: DataFrame, listed: DataFrame, stored: DataFrame) -> DataFrame:
    """run, pos, rank, passage and fallback. questions (run, pos) without a list get what is stored under them (run, pos, passage), by passage, each once."""
    own = listed.select("run", "pos", "rank", "passage", F.lit(False).alias("fallback"))
    bare = questions.select("run", "pos").distinct().join(listed.select("run", "pos"), ["run", "pos"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("run", "pos").orderBy("passage"))
    found = bare.join(stored.select("run", "pos", "passage").distinct(), ["run", "pos"])
    return own.unionByName(found.select("run", "pos", rank.alias("rank"), "passage", F.lit(True).alias("fallback")))


def best_scores(listed: DataFrame, own: DataFrame) -> DataFrame:
    """run, pos, f1 and overridden. listed with score; own (run, pos, passage, score) are scores that a question has itself.

    A passage is stored with the score of the question that came first; a question's own score goes before it (the highest of several).
    f1 is the best of a question's list, overridden the passages whose own score is another than the stored one."""
    first = listed.groupBy("run", "passage").agg(F.min_by("score", F.struct("pos", "rank")).alias("stored"))
    mine = own.groupBy("run", "pos", "passage").agg(F.max("score").alias("own"))
    both = listed.select("run", "pos", "passage").join(first, ["run", "passage"]).join(mine, ["run", "pos", "passage"], "left")
    score = F.coalesce("own", "stored")
    return both.groupBy("run", "pos").agg(F.max(score).alias("f1"), F.sum((~score.eqNullSafe(F.col("stored"))).cast("int")).alias("overridden"))


def plain(text: Column) -> Column:
    """The form in which a draft's sentences and its findings meet: lower case, without extra blanks."""
    return F.lower(t.clean(text))


def with_findings(sentences: DataFrame, findings: DataFrame) -> DataFrame:
    """sentences (draft, at, text) with the verdict of the first of findings (draft, at, text, verdict) whose text is the same but for case and blanks, else null."""
    first = findings.groupBy("draft", F.md5(plain(F.col("text"))).alias("norm")).agg(F.min_by("verdict", "at").alias("verdict"))
    return sentences.select("draft", "at", F.md5(plain(F.col("text"))).alias("norm")).join(first, ["draft", "norm"], "left").select("draft", "at", "verdict")


def cited_passages(cited: DataFrame, shown: DataFrame) -> DataFrame:
    """run, passages (of the labels that a draft cites, in their order) and unknown (labels beyond the list). cited (run, place), shown (run, place, passage)."""
    both = cited.join(shown.select("run", "place", "passage"), ["run", "place"], "left")
    known = F.transform(F.sort_array(F.collect_set(F.when(F.col("passage").isNotNull(), F.struct("place", "passage")))), lambda x: x["passage"])
    return both.groupBy("run").agg(known.alias("passages"), F.sum(F.col("passage").isNull().cast("int")).alias("unknown"))


def claim_counts(judged: DataFrame) -> DataFrame:
    """judged (run, kind, verdict) by run: claims that stay (contradicted ones are dropped), those supported, marked and dropped, and other sentences."""
    is_in = lambda c, *v: F.sum(F.coalesce(F.col(c).isin(*v), F.lit(False)).cast("int"))
    kept = is_in("kind", "claim") - is_in("verdict", "CONTRADICTED")
    return judged.groupBy("run").agg(kept.alias("kept"), is_in("verdict", "SUPPORTED").alias("supported"), is_in("verdict", "PARTIAL", "UNSUPPORTED").alias("marked"), is_in("verdict", "CONTRADICTED").alias("dropped"), is_in("kind", "discourse").alias("discourse"), is_in("kind", "gap").alias("gaps"))


def extracted_premises(replies: DataFrame) -> DataFrame:
    """replies (run, reply: JSON with a list `presuppositions`) to run, idx (from 0), text and centrality: the first four with a text. What isn't an object, or
    has no text but blanks, is left out; centrality is incidental only where that is said, else core. A reply that isn't JSON, or has no list, has no rows."""
    items = F.from_json(F.get_json_object("reply", "$.presuppositions"), "array<string>")
    text = lambda x: F.trim(F.coalesce(F.get_json_object(x, "$.text"), F.lit("")))
    usable = F.slice(F.filter(items, lambda x: F.coalesce(x.startswith("{"), F.lit(False)) & (text(x) != "")), 1, MOST_PREMISES)
    said = F.lower(F.coalesce(F.get_json_object("x", "$.centrality"), F.lit("")))
    rows = replies.select("run", F.posexplode(usable).alias("idx", "x"))
    return rows.select("run", "idx", text(F.col("x")).alias("text"), F.when(said == "incidental", "incidental").otherwise("core").alias("centrality"))


def premises(claims: DataFrame, said: DataFrame, shown: DataFrame) -> DataFrame:
    """run, idx, centrality, verdict and passage of the first four claims (run, idx from 0, centrality) that have a verdict.

    said (run, idx, at, verdict, label): of several the last; numbers of no claim go. A label is a place in shown (run, place, passage); unknown ones are null."""
    c = claims.where(F.col("idx") < MOST_PREMISES).select("run", "idx", "centrality")
    last = said.groupBy("run", "idx").agg(F.max_by(F.struct("verdict", "label"), "at").alias("v"))
    places = shown.select("run", F.col("place").alias("label"), "passage")
    return c.join(last, ["run", "idx"]).select("run", "idx", "centrality", "v.*").join(places, ["run", "label"], "left").select("run", "idx", "centrality", "verdict", "passage")


def premise_note(verdicts: DataFrame) -> DataFrame:
    """verdicts (run, idx, text, centrality, verdict, correction) by run: the first four confirmed claims in order, whether a core claim is contradicted,
    and the first correction of such a claim."""
    confirmed = F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("verdict") == "SUPPORTED", F.struct("idx", "text")))), lambda x: x["text"]), 1, MOST_PREMISES)
    bad = F.coalesce((F.col("verdict") == "CONTRADICTED") & (F.col("centrality") == "core"), F.lit(False))
    return verdicts.groupBy("run").agg(F.array_join(confirmed, "; ").alias("established"), F.bool_or(bad).alias("warned"), F.min_by("correction", F.when(bad & F.col("correction").isNotNull(), F.col("idx"))).alias("correction"))


def grounding(verdicts: DataFrame) -> DataFrame:
    """verdicts (run, pos, kind, verdict) by run: mean strength of the core claims (of all without a core; 1 without any), whether one is contradicted,
    the first such, and how many are confirmed."""
    core = F.coalesce(F.col("kind") == "core", F.lit(False))
    used = core | (F.max(core.cast("int")).over(Window.partitionBy("run")) == 0)
    v = verdicts.select("run", "pos", "verdict", used.alias("used"))
    strength = F.when(F.col("verdict") == "SUPPORTED", 1.0).when(F.col("verdict") == "CONTRADICTED", 0.0).otherwise(0.5)
    bad = F.col("used") & F.coalesce(F.col("verdict") == "CONTRADICTED", F.lit(False))
    confirmed = F.col("used") & F.coalesce(F.col("verdict") == "SUPPORTED", F.lit(False))
    return v.groupBy("run").agg(F.round(F.coalesce(F.avg(F.when(F.col("used"), strength)), F.lit(1.0)), 6).alias("grounding"), F.bool_or(bad).alias("failed"), F.min(F.when(bad, F.col("pos"))).alias("first_failure"), F.sum(confirmed.cast("int")).alias("confirmed"))


def evidence_block(found: DataFrame, key: str, chars: int = 900) -> DataFrame:
    """found (key, rank, source_id, section, text) as the evidence of a prompt: key and block, a header and the first characters of each passage in order."""
    one = F.concat(F.format_string("[P%02d] ", "rank"), F.concat_ws(", ", "source_id", "section"), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("one")))), lambda x: x["one"]), "\n\n")
    return found.groupBy(key).agg(whole.alias("block"))


def listed_gaps(decided: Column, recorded: Column, unresolved: Column) -> Column:
    """The gaps that a report lists: those of the decision if it has a list, an empty one too, or else what was recorded and derived, each once."""
    return F.coalesce(decided, F.array_distinct(F.concat(recorded, unresolved)))


def shown_gaps(gaps: Column) -> Column:
    """Gaps without their prefix, each ending in a mark."""
    bare = F.transform(gaps, lambda x: F.trim(F.regexp_replace(x, GAP_PREFIX, "")))
    return F.transform(bare, lambda x: F.when(x.rlike(r"[.?!]$"), x).otherwise(F.concat(x, F.lit("."))))


def banner(rule: Column, terminal: Column) -> Column:
    """A report's headline: the rule's own, or else the decision's."""
    of = lambda c: [F.when(c == k, v) for k, v in BANNERS.items()]
    return F.coalesce(*of(rule), *of(terminal))


def rationale(score: Column, done: Column, total: Column, open_: Column, terminal: Column) -> Column:
    """Why a threshold decided so: the score, how many core questions are resolved, and (but for an answer) the first three that aren't (open_, their places)."""
    names = F.array_join(F.transform(F.slice(open_, 1, MOST_OPEN), lambda x: F.concat(F.lit("sq"), x.cast("string"))), "; ")
    more = F.when(F.size(open_) > MOST_OPEN, F.concat(F.lit(" (+"), (F.size(open_) - MOST_OPEN).cast("string"), F.lit(" more)"))).otherwise("")
    listed = F.when((F.size(open_) > 0) & (terminal != "ANSWER"), F.concat(F.lit(" Not established: "), names, more, F.lit("."))).otherwise("")
    return F.concat(F.format_string("%.2f: ", F.bround(score, 2)), done.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" resolved."), listed)
