"""Conflicts between passages of one question's evidence, sentence by sentence.

Sentences of different sources meet where they share rare words: of each sentence the KEYS words that the fewest sentences of all
evidence have. A pair is aligned if most of the words of the shorter sentence, numbers and negations aside, are in the other too.
An aligned pair conflicts if the numbers of a unit have no value in common, if only one of the two is negated, or if both
have dates of the same form and none in common. A question's evidence is a short list, so its pairs are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import tokens
from groundwell.operators.passages import SENTENCE_END
from groundwell.operators.retrieval import small
from groundwell.sources.work import saved

KEYS, ALIGNED, LEAST_WORDS = 4, 0.6, 3
# Units by their spellings, words that negate, and dates.
UNITS = {"%": "percent", "percent": "percent", "pct": "percent", "kilometres": "km", "kilometers": "km", "km": "km", "kg": "kg", "kilograms": "kg", "years": "year", "year": "year", "days": "day", "day": "day", "hours": "hour", "hour": "hour", "million": "million", "billion": "billion"}
NEGATION = r"(?i)\b(?:not|no|never|none|neither|nor|cannot|without)\b|n't\b"
DAY, YEAR = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"\b(?:1[89]|20)[0-9]{2}\b"
NUMBER = r"(?<![0-9A-Za-z.-])([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*(%|[A-Za-z]+))?"


def figures(sentence: Column) -> Column:
    """The numbers of a sentence as structs of unit ('' if it has none that is known) and value; dates and years aren't numbers."""
    plain = F.regexp_replace(F.regexp_replace(sentence, DAY, " "), YEAR + r"(?!\s*(?:%|[A-Za-z]*(?:km|kg|percent)))", " ")
    value = F.transform(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    unit = F.transform(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(2)), lambda x: F.coalesce(*[F.when(F.lower(x) == a, b) for a, b in UNITS.items()], F.lit("")))
    return F.zip_with(unit, value, lambda u, v: F.struct(u.alias("unit"), v.alias("value")))


def content(sentence: Column) -> Column:
    """Its words, without numbers, units and negations."""
    plain = F.regexp_replace(F.regexp_replace(sentence, NEGATION, " "), NUMBER, " ")
    return F.array_distinct(F.filter(tokens(plain), lambda w: ~w.isin(*UNITS) & ~w.rlike("^[0-9]+$")))


def sentences_of(evidence: DataFrame) -> DataFrame:
    """evidence (qid, id, source_id, text) to its sentences with what is compared: words, numbers, negated, days and years."""
    each = evidence.select("qid", "id", "source_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), SENTENCE_END.pattern)).alias("at", "sentence"))
    found = each.select(
        "qid", "id", "source_id", "at", "sentence", content(F.col("sentence")).alias("words"), figures(F.col("sentence")).alias("figures"), (F.size(F.regexp_extract_all("sentence", F.lit(NEGATION), F.lit(0))) % 2 == 1).alias("negated"),
        F.regexp_extract_all("sentence", F.lit(DAY), F.lit(0)).alias("days"), F.regexp_extract_all(F.regexp_replace("sentence", DAY, " "), F.lit(YEAR), F.lit(0)).alias("years"),
    )
    return found.where(F.size("words") >= LEAST_WORDS)


def aligned_pairs(sentences: DataFrame) -> DataFrame:
    """Pairs of sentences of a question's different passages and sources that say the same but for figures, negations and dates."""
    held = saved(sentences, "sentences")
    words = held.select("qid", "id", "at", F.explode("words").alias("word"))
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rare = words.join(small(df), "word").groupBy("qid", "id", "at").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "word"))), 1, KEYS)["word"].alias("keys"))
    keyed = rare.select("qid", "id", "at", F.explode("keys").alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.qid").alias("qid"), F.col("a.id").alias("id_a"), F.col("a.at").alias("at_a"), F.col("b.id").alias("id_b"), F.col("b.at").alias("at_b")).distinct()
    side = lambda s: held.select(F.col("qid"), *[F.col(c).alias(f"{c}_{s}") for c in held.columns if c != "qid"])
    both = met.join(side("a"), ["qid", "id_a", "at_a"]).join(side("b"), ["qid", "id_b", "at_b"]).where(F.col("source_id_a") != F.col("source_id_b"))
    share = F.size(F.array_intersect("words_a", "words_b")) / F.least(F.size("words_a"), F.size("words_b"))
    return both.withColumn("share", F.round(share, 6)).where((F.col("share") >= ALIGNED) & (F.greatest(F.size("words_a"), F.size("words_b")) <= 2 * F.least(F.size("words_a"), F.size("words_b"))))


def apart(a: Column, b: Column) -> Column:
    """Both lists have something, and nothing in common."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) == 0)


def conflicts(evidence: DataFrame) -> DataFrame:
    """evidence (qid, id, source_id, text) to qid, id_a, id_b, at_a, at_b, share, kinds (of number, negation, date)."""
    units = F.array_distinct(F.transform(F.concat("figures_a", "figures_b"), lambda x: x["unit"]))
    of = lambda side, u: F.transform(F.filter(F.col(f"figures_{side}"), lambda x: x["unit"] == u), lambda x: x["value"])
    number = F.exists(units, lambda u: apart(of("a", u), of("b", u)))
    date = apart(F.col("days_a"), F.col("days_b")) | apart(F.col("years_a"), F.col("years_b"))
    kinds = F.array_compact(F.array(F.when(number, "number"), F.when(F.col("negated_a") != F.col("negated_b"), "negation"), F.when(date, "date")))
    return aligned_pairs(sentences_of(evidence)).withColumn("kinds", kinds).where(F.size("kinds") > 0).select("qid", "id_a", "id_b", "at_a", "at_b", "share", F.array_join("kinds", ",").alias("kinds"))
