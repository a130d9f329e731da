"""Rules about errors, providers, claims, plans and routed claims, as columns and tables of any source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What messages of providers say about the limit that was met, and about requests to repeat in plain form; statuses to try again.
PLAIN_400 = ("json_validate_failed", "failed to validate json", "context_length", "too large", "overloaded")
DAY_LIMIT = ("per day", "(tpd)", "(rpd)", "perday")
MINUTE_LIMIT = ("per minute", "(tpm)", "(rpm)", "perminute")
TRY_AGAIN = r"(?i)try again in\s+(?:(\d+(?:\.\d+)?)m)?\s*(?:(\d+(?:\.\d+)?)s)?"
RETRY = (500, 502, 503, 504)
WAIT = 60.0
# The verdicts of a sentence, and what a router may do with a claim.
VERDICTS = ("SUPPORTED", "PARTIAL", "UNSUPPORTED", "CONTRADICTED", "NOT_A_CLAIM", "GAP_STATEMENT")
FREE_ACTIONS = ("ACCEPT", "DROP_CLAIM", "HEDGE", "UNRESOLVED")
COSTLY_ACTIONS = ("RE_RETRIEVE", "REVISE_PLAN")


def error_action(status: Column, message: Column, kind: Column, retry: tuple[int, ...] = RETRY) -> Column:
    """What to do about an error, by status, message and the error's type: retry, retry_plain, wait, switch (for good), switch_keep or fatal. The first rule that applies."""
    says = lambda words: F.greatest(*[F.contains(F.lower(F.coalesce(message, F.lit(""))), F.lit(w)) for w in words])
    broken = F.contains(F.coalesce(kind, F.lit("")), F.lit("Timeout")) | F.contains(F.coalesce(kind, F.lit("")), F.lit("Connection"))
    is_ = lambda *codes: F.coalesce(status.isin(*codes), F.lit(False))
    return (
        F.when(is_(400) & says(PLAIN_400), "retry_plain")
        .when(is_(429) & says(DAY_LIMIT), "switch")
        .when(is_(429) & says(MINUTE_LIMIT), "wait")
        .when(is_(429), "switch_keep")
        .when(is_(401, 403), "fatal")
        .when(is_(*retry), "retry")
        .when(broken, "retry")
        .when(F.coalesce(status.between(400, 499), F.lit(False)), "fatal")
        .otherwise("retry")
    )


def error_wait(message: Column, header: Column) -> Column:
    """Seconds to wait: what the header says, or else the message, or else a minute."""
    part = lambda n: F.nullif(F.regexp_extract(F.coalesce(message, F.lit("")), TRY_AGAIN, n), F.lit("")).cast("double")
    asked = F.when(part(1).isNotNull() | part(2).isNotNull(), F.coalesce(part(1), F.lit(0.0)) * 60 + F.coalesce(part(2), F.lit(0.0)))
    said = header.try_cast("double")
    return F.coalesce(F.when(said.isNotNull(), F.greatest(F.lit(0.0), said)), asked, F.lit(WAIT))


def first_provider(results: DataFrame, key: str, order: str) -> DataFrame:
    """results with the provider's place in order: those of the first provider that has any for the key. Unusable results are left out before."""
    first = results.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    return results.join(first, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_first"))).drop("_key", "_first")


def last_verdicts(raw: DataFrame) -> DataFrame:
    """raw (run, idx, turn, name) to run, idx and given: the last verdict of each sentence; a name that isn't known is UNSUPPORTED."""
    last = raw.groupBy("run", "idx").agg(F.max_by("name", "turn").alias("name"))
    return last.select("run", "idx", F.when(F.col("name").isin(*VERDICTS), F.col("name")).otherwise("UNSUPPORTED").alias("given"))


def judged_sentences(sentences: DataFrame, given: DataFrame, owners: DataFrame) -> DataFrame:
    """sentences (run, idx, citations), given (run, idx, given) and owners (run, passage, owner) to run, idx, kind, verdict and owner.

    A sentence is discourse, a gap or a claim. A claim without a citation, a gap statement that cites, and a sentence without a
    verdict are unsupported; a claim belongs to the owner of its first citation that has one, or to nobody ('')."""
    cited = sentences.select("run", "idx", F.posexplode("citations").alias("at", "passage")).join(owners, ["run", "passage"])
    owner = cited.groupBy("run", "idx").agg(F.min_by("owner", "at").alias("owner"))
    both = sentences.join(given, ["run", "idx"], "left").join(owner, ["run", "idx"], "left")
    v, has = F.coalesce("given", F.lit("UNSUPPORTED")), F.size("citations") > 0
    kind = F.when(v == "NOT_A_CLAIM", "discourse").when((v == "GAP_STATEMENT") & ~has, "gap").otherwise("claim")
    verdict = F.when(~has | (v == "GAP_STATEMENT"), "UNSUPPORTED").otherwise(v)
    return both.select("run", "idx", kind.alias("kind"), F.when(kind == "claim", verdict).alias("verdict"), F.when(kind == "claim", F.coalesce("owner", F.lit(""))).alias("owner"))


def rewritten_plan(plan: DataFrame) -> DataFrame:
    """plan (run, id, status, rounds, hit, action, differs, parts, into) to run, id, status, rounds, covered_by and gap.

    The question that is hit is rewritten (if the new text differs), split into its usable parts (two at least; three stay), merged into
    a question of the plan (into; null if there is no such), or given up. What can't be done gives it up, and leaves a gap."""
    row = lambda id_, status, rounds, covered, gap: F.struct(id_.alias("id"), status.alias("status"), rounds.cast("int").alias("rounds"), covered.cast("string").alias("covered_by"), F.lit(gap).alias("gap"))
    one, rounds, none, zero, given_up, fresh = F.col("id"), F.col("rounds"), F.lit(None), F.lit(0), F.lit("abandoned"), F.lit("pending")
    parts = F.least(F.lit(3), F.col("parts"))
    lost = F.array(row(one, given_up, rounds, none, True))
    children = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), parts).cast("int")), lambda i: row(F.concat(one, F.lit("."), i.cast("string")), fresh, zero, none, False))
    new = (
        F.when(~F.col("hit"), F.array(row(one, F.col("status"), rounds, none, False)))
        .when((F.col("action") == "REWRITE") & F.col("differs"), F.array(row(one, fresh, zero, none, False)))
        .when((F.col("action") == "SPLIT") & (parts >= 2), children)
        .when((F.col("action") == "MERGE") & F.col("into").isNotNull(), F.array(row(one, given_up, rounds, F.col("into"), False)))
        .otherwise(lost)
    )
    return plan.select("run", F.explode(new).alias("x")).select("run", "x.*")


def available_actions(retrieval: Column, revision: Column) -> Column:
    """What a run can do with a claim, given that it can retrieve, and that it can revise its plan."""
    return F.array_compact(F.array(*map(F.lit, FREE_ACTIONS), F.when(retrieval, "RE_RETRIEVE"), F.when(retrieval & revision, "REVISE_PLAN")))


def claim_gate(asked: Column, available: Column, owned: Column, query: Column, tried: Column) -> Column:
    """Why an action can't be taken: it isn't available, costs something and no question owns the claim, or its query is blank or was tried. Null if it can."""
    plain = lambda x: F.lower(F.trim(x))
    again = (F.trim(query) == "") | F.array_contains(F.transform(tried, plain), plain(query))
    return F.when(~F.array_contains(available, asked), "unavailable").when(asked.isin(*COSTLY_ACTIONS) & ~owned, "no owner").when((asked == "RE_RETRIEVE") & again, "no new query")


def routed_plan(plan: DataFrame, routed: DataFrame) -> DataFrame:
    """plan (run, pos, status) after routed claims (run, pos, claim, action; those of owned claims alone): run, pos, status, reopened_from and
    draft_cleared. Claims in order reopen their question or make it insufficient; the verdict that retrieval had reached is kept, once."""
    r = routed.where(F.col("action").isin(*COSTLY_ACTIONS))
    last = r.groupBy("run", "pos").agg(F.max_by("action", "claim").alias("last"), F.max(F.when(F.col("action") == "RE_RETRIEVE", F.col("claim"))).alias("reopened"), F.min(F.when(F.col("action") == "REVISE_PLAN", F.col("claim"))).alias("revised"))
    p = plan.select("run", "pos", "status").join(last, ["run", "pos"], "left")
    before = F.when(F.coalesce(F.col("revised") < F.col("reopened"), F.lit(False)), "insufficient").when(F.col("status").isin("abandoned", "insufficient", "sufficient"), F.col("status"))
    now = F.when(F.col("last") == "RE_RETRIEVE", "in_progress").when(F.col("last") == "REVISE_PLAN", "insufficient").otherwise(F.col("status"))
    work = F.max(F.col("last").isNotNull().cast("int")).over(Window.partitionBy("run")) == 1
    return p.select("run", "pos", now.alias("status"), F.when(F.col("reopened").isNotNull(), before).alias("reopened_from"), work.alias("draft_cleared"))


def labelled(found: DataFrame) -> DataFrame:
    """found (run, claim, rank, id), the evidence of a run's claims: run, id, claim, rank and label, P01 and on in the order in which passages first appear."""
    first = found.groupBy("run", "id").agg(F.min(F.struct("claim", "rank")).alias("x"))
    n = F.row_number().over(Window.partitionBy("run").orderBy("x.claim", "x.rank", "id"))
    return first.select("run", "id", "x.claim", "x.rank", F.format_string("P%02d", n).alias("label"))
