"""Column functions on text: tokens, repair, sections, addresses, gap lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
# English stop words.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that",
    "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
# Headings and the sections they stand for, in the order in which they are tried as a heading's beginning.
SECTIONS = {
    "abstract": "Abstract", "introduction": "Introduction", "intro": "Introduction", "background": "Background", "preliminaries": "Background",
    "related work": "Related Work", "related works": "Related Work", "prior work": "Related Work", "method": "Method", "methods": "Method",
    "methodology": "Method", "approach": "Method", "our approach": "Method", "model": "Method", "architecture": "Method", "experiments": "Experiments",
    "experimental setup": "Experiments", "experimental settings": "Experiments", "setup": "Experiments", "evaluation": "Experiments", "results": "Results",
    "results and discussion": "Results", "main results": "Results", "findings": "Results", "analysis": "Analysis", "ablation": "Ablation",
    "ablations": "Ablation", "ablation study": "Ablation", "ablation studies": "Ablation", "discussion": "Discussion", "limitations": "Limitations",
    "limitations and future work": "Limitations", "conclusion": "Conclusion", "conclusions": "Conclusion", "conclusion and future work": "Conclusion",
    "future work": "Conclusion", "references": "References", "bibliography": "References", "acknowledgments": "Acknowledgments",
    "acknowledgements": "Acknowledgments", "appendix": "Appendix", "supplementary material": "Appendix",
}
NON_EVIDENCE = ("References", "Acknowledgments")
# Numbered headings, and lines that only number a page.
NUMBERED = r"^\s*(\d+(?:\.\d+)*)\.?\s+([A-Za-z][\w \-&:,]{2,70})\s*$"
ROMAN = r"^\s*([IVXL]+)\.?\s+([A-Za-z][\w \-&:,]{2,70})\s*$"
PAGE_NOISE = r"^\s*(?:\d{1,4}|[ivxlIVXL]{1,6}|Page \d+.*)\s*$"


def tokens(text: Column) -> Column:
    """Lower-case words without stop words; null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS))


def clean(text: Column) -> Column:
    """Runs of blanks as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def dehyphenate(text: Column) -> Column:
    """Words that were split at a line's end, in one piece."""
    return F.regexp_replace(text, r"([\p{L}\p{N}_])[-‐‑]\s*\n\s*([\p{L}\p{N}_])", "$1$2")


def is_noise(line: Column) -> Column:
    return line.rlike(PAGE_NOISE)


def heading_key(heading: Column) -> Column:
    """A heading without its number and marks, in lower case."""
    plain = F.trim(F.regexp_replace(F.coalesce(heading, F.lit("")), r"^\s*(?:\d+(?:\.\d+)*|[IVXL]+)\.?\s*", ""))
    return F.regexp_replace(F.lower(F.regexp_replace(plain, r"^[:.\- \t]+|[:.\- \t]+$", "")), r"\s+", " ")


def section_of(key: Column) -> Column:
    """The section that a heading_key stands for, or null: the key itself, or the first heading that it begins with."""
    known = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    begins = F.get(F.filter(F.array(*[F.lit(k) for k in SECTIONS]), lambda k: key.startswith(F.concat(k, F.lit(" ")))), F.lit(0))
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, begins))


def canonical_section(heading: Column) -> Column:
    """The section a heading stands for, or null."""
    return section_of(heading_key(heading))


def header(bare: Column, key: Column) -> Column:
    """A struct for a heading (its section may be null), null for any other line. bare: the trimmed line, key: its heading_key."""
    none = F.lit(None).cast("struct<section:string>")
    numbered = bare.rlike(NUMBERED)
    named = F.struct(section_of(key).alias("section"))
    return (
        F.when((bare == "") | (F.length(bare) > 90), none)
        .when(bare.rlike(r"[.,;:]$"), F.when(numbered, named))
        .when(numbered | bare.rlike(ROMAN), named)
        .when(F.size(F.split(bare, r"\s+")) <= 6, F.when(named["section"].isNotNull(), named))
        .otherwise(none)
    )


def with_sections(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per section of a text: keep, at (line number of the heading), section and body. What comes before the first heading is `Front Matter`.

    In steps, so that no step's array is made anew for each of its elements."""
    kept = [F.col(c) for c in keep]
    lines = F.filter(F.transform(F.split(dehyphenate(F.coalesce(F.col(text), F.lit(""))), r"\r\n|\n|\r", -1), lambda x, i: F.struct(x.alias("line"), F.trim(x).alias("bare"), i.alias("at"))), lambda x: ~is_noise(x["line"]))
    d = docs.select(*kept, lines.alias("_l"))
    d = d.select(*kept, F.transform("_l", lambda x: F.struct(x["line"].alias("line"), x["at"].alias("at"), x["bare"].alias("bare"), F.when(F.length(x["bare"]) <= 90, heading_key(x["bare"])).alias("key"))).alias("_l"))
    d = d.select(*kept, F.transform("_l", lambda x: F.struct(x["line"].alias("line"), x["at"].alias("at"), header(x["bare"], x["key"]).alias("head"))).alias("_l"))
    # places of the headings in the array of lines, with a first one before it and the end after it
    places = F.filter(F.transform("_l", lambda x, i: F.when(x["head"].isNotNull(), i + 1)), lambda i: i.isNotNull())
    d = d.select(*kept, "_l", F.concat(F.array(F.lit(0)), places).alias("_h"))
    d = d.select(*kept, "_l", "_h", F.posexplode("_h").alias("_k", "_i"))
    d = d.select(*kept, F.get("_l", F.col("_i") - 1).alias("_x"), F.slice("_l", F.col("_i") + 1, F.coalesce(F.get("_h", F.col("_k") + 1) - 1, F.size("_l")) - F.col("_i")).alias("_own"), "_i")
    d = d.select(*kept, F.when(F.col("_i") == 0, -1).otherwise(F.col("_x.at")).alias("at"), F.when(F.col("_i") == 0, "Front Matter").otherwise(F.col("_x.head.section")).alias("section"), clean(F.array_join(F.transform("_own", lambda x: x["line"]), " ")).alias("body"))
    return d.where((F.col("body") != "") & ~F.coalesce(F.col("section").isin(*NON_EVIDENCE), F.lit(False)))


def domain(url: Column) -> Column:
    """Host and port in lower case without a leading www., or `unknown`."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")
    return F.when(host == "", "unknown").otherwise(host)


def html_text(html: Column) -> Column:
    """The text between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return clean(F.regexp_replace(bare, r"<[^>]*>", " "))


def passage_id(source: Column, section: Column, text: Column) -> Column:
    parts = F.concat_ws("\0", source, F.coalesce(section, F.lit("")), text)
    return F.concat(F.lit("P"), F.substring(F.sha2(parts, 256), 1, 12))


def draft_digest(draft: Column) -> Column:
    return F.substring(F.sha2(F.trim(F.coalesce(draft, F.lit(""))), 256), 1, 16)


def gap_line(text: Column) -> Column:
    """The line that names an open question: 200 characters at most, cut at a blank."""
    plain = F.regexp_replace(clean(text), r"[ .]+$", "")
    cut = F.concat(F.regexp_replace(F.regexp_replace(F.substring(plain, 1, 200), r" [^ ]*$", ""), r"[ ,;:]+$", ""), F.lit("…"))
    return F.concat(F.lit("could not establish: "), F.when(F.length(plain) > 200, cut).otherwise(plain))
