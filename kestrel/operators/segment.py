"""Segmentation: paragraphs, sentences with offsets, chunks, structural and candidate extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import text as T

EMPTY = "array<string>"


def paragraphs(docs: DataFrame, sep: str = "\n\n", min_len: int = 60) -> DataFrame:
    """(doc_id, idx, text) of paragraphs of at least `min_len` characters; the whole text where there is none."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), sep), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= min_len)
    return docs.select("doc_id", F.when(F.size(parts) > 0, parts).otherwise(F.array(F.coalesce("text", F.lit("")))).alias("p")).select("doc_id", F.posexplode("p").alias("idx", "text"))


def keep_short(c: Column) -> Column:
    """Short sentences that anchor provisions: a bare number with a dot or dash, or a bare reference."""
    return c.rlike(r"^\s*\d{1,3}[A-Za-z]?\s*[.\x{2013}\x{2014}\-]{1,2}\s*$") | c.rlike(rf"(?i)^\s*(?:{T.LEGAL})\s+\d+[A-Za-z]?(?:\([0-9A-Za-z]+\))*\s*$")


def sentence_parts(c: Column) -> Column:
    """Pieces between sentence ends and line ends of a cleaned text; each separator is one character."""
    return F.split(F.regexp_replace(c, r"([.!?]) ", "$1\n"), "\n")


def sentences(docs: DataFrame, min_chars: int = 30) -> DataFrame:
    """(doc_id, idx, sent_id, text, start_char, end_char); idx counts all pieces, offsets are in the cleaned text."""
    every = docs.select("doc_id", F.posexplode(sentence_parts(T.clean_whitespace(F.coalesce("text", F.lit(""))))).alias("idx", "text"))
    before = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    placed = every.withColumn("start_char", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")).withColumn("end_char", F.col("start_char") + F.length("text"))
    kept = placed.withColumn("text", F.trim("text")).filter((F.length("text") >= min_chars) | keep_short(F.col("text")))
    return kept.select("doc_id", "idx", F.concat(F.lit("sent:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("idx").cast("string")).alias("sent_id"), "text", "start_char", "end_char")


def chunks(docs: DataFrame, size: int = 160, overlap: int = 40) -> DataFrame:
    """(doc_id, chunk_id, text) of overlapping runs of words; the last one ends with the text."""
    step = max(1, size - overlap)
    words = docs.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step)).cast("int") * step
    at = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("s"))
    end = F.least(F.col("s") + size, F.size("w"))
    return at.select("doc_id", F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("s").cast("string"), F.lit("-"), end.cast("string")).alias("chunk_id"), F.array_join(F.slice("w", F.col("s") + 1, size), " ").alias("text"))


def char_chunks(docs: DataFrame, max_chars: int, sep: str = "\n\n") -> DataFrame:
    """(doc_id, para, start_char, end_char, text): paragraphs, long ones by a sliding window; offsets are in the paragraph."""
    overlap = min(600, max_chars // 6)
    step = max_chars - overlap
    para = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), sep)).alias("para", "p")).filter(F.length("p") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.length("p") - max_chars) / step)).cast("int") * step
    at = para.select("doc_id", "para", "p", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start_char"))
    end = F.least(F.col("start_char") + max_chars, F.length("p"))
    return at.select("doc_id", "para", "start_char", end.alias("end_char"), F.substring("p", F.col("start_char") + 1, end - F.col("start_char")).alias("text"))


def middle_window(c: Column, words: int = 50) -> Column:
    """The middle words of a text."""
    w = T.tokens(c)
    start = F.greatest(F.lit(0), F.floor((F.size(w) - words) / 2)).cast("int")
    return F.array_join(F.when(F.size(w) > words, F.slice(w, start + 1, words)).otherwise(w), " ")


# Fixed values: (label, canonical form, pattern) of structural entities.
STRUCTURE = [
    ("INSTITUTION", "president", r"\bPresident\b"),
    ("INSTITUTION", "parliament", r"\bParliament\b"),
    ("INSTITUTION", "state legislature", r"\bState\s+Legislature\b"),
    ("INSTITUTION", "state legislature", r"\bLegislature\s+of\s+the\s+State\b"),
    ("INSTITUTION", "affected state legislature", r"\bLegislature\s+of\s+each\s+of\s+the\s+affected\s+States\b"),
    ("INSTITUTION", "governor", r"\bGovernor\b"),
    ("LEGAL_CONCEPT", "fundamental rights", r"\bFundamental\s+Rights\b"),
    ("LEGAL_CONCEPT", "directive principles of state policy", r"\bDirective\s+Principles\s+of\s+State\s+Policy\b"),
    ("LEGAL_CONCEPT", "directive principles", r"\bDirective\s+Principles\b"),
    ("LEGAL_CONCEPT", "directive principles", r"\bDPSP\b"),
    ("PROCEDURAL_REQUIREMENT", "presidential recommendation", r"\brecommendation\s+of\s+the\s+President\b"),
    ("PROCEDURAL_REQUIREMENT", "legislature consultation", r"\brefer\s+the\s+Bill\s+to\s+the\s+Legislature\b"),
    ("PROCEDURAL_REQUIREMENT", "views of affected state", r"\bfor\s+expressing\s+its\s+views\b"),
    ("PROCEDURAL_REQUIREMENT", "consultation", r"\bconsultation\b"),
]
HEADING = r"(?im)^[ \t]*(\d{1,3}[A-Za-z]?)[ \t]*[.\-\x{2013}\x{2014}]{1,2}[ \t]*([^\n]{4,160})$"


def _labelled(xs: Column, mark: Column, name: str) -> Column:
    return F.transform(xs, lambda x: F.struct(mark, x.alias(name)))


def structure(docs: DataFrame) -> DataFrame:
    """(doc_id, label, canonical, n): structural entities and how often each occurs in a text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    article = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)\bArticle\s+(\d{1,3}[A-Za-z]?)\b"), F.lit(1)), lambda x: F.concat(F.lit("article "), F.lower(x)))
    heads = F.arrays_zip(F.regexp_extract_all(t, F.lit(HEADING), F.lit(1)).alias("n"), F.regexp_extract_all(t, F.lit(HEADING), F.lit(2)).alias("title"))
    lettered = F.filter(heads, lambda h: F.length(F.regexp_replace(h["title"], "[^A-Za-z]", "")) >= 6)
    heading = F.transform(lettered, lambda h: F.concat(F.lit("article "), F.lower(h["n"])))
    part = F.transform(F.regexp_extract_all(t, F.lit(r"(?im)^[ \t]*PART[ \t]+([IVXLCDM]{1,7})\b[^\n]*$"), F.lit(1)), lambda x: F.concat(F.lit("part "), F.lower(x)))
    sched = F.transform(F.regexp_extract_all(t, F.lit(r"(?im)^[ \t]*(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)[ \t]+SCHEDULE\b[^\n]*$"), F.lit(1)), lambda x: F.concat(F.lower(x), F.lit(" schedule")))
    found = [("ARTICLE", F.concat(article, heading)), ("PART", part), ("SCHEDULE", sched)]
    found += [(label, F.array_repeat(F.lit(canon), F.regexp_count(t, F.lit("(?i)" + p)))) for label, canon, p in STRUCTURE]
    every = F.flatten(F.array(*[_labelled(xs, F.lit(label).alias("label"), "canonical") for label, xs in found]))
    return docs.select("doc_id", F.explode(every).alias("e")).groupBy("doc_id", "e.label", "e.canonical").agg(F.count("*").alias("n"))


def provision_headings(docs: DataFrame, per_canonical: int = 8, per_doc: int = 240) -> DataFrame:
    """(doc_id, ord, canonical) of numbered headings of texts that speak of a constitution."""
    pat = r"(?m)^[ \t]{0,3}(\d{1,3}[A-Za-z]?)\s*[.\x{2013}\x{2014}\-]{1,2}\s*(?=[(A-Za-z])"
    of = docs.filter(F.col("text").rlike(r"(?i)\bconstitution\b") | F.col("doc_id").cast("string").rlike("(?i)constitution"))
    heads = of.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pat), F.lit(1))).alias("ord", "h"))
    heads = heads.filter(F.regexp_extract("h", r"^(\d+)", 1).cast("int").between(1, 450)).withColumn("canonical", F.concat(F.lit("article "), F.regexp_replace(F.lower("h"), "^0+", "")))
    heads = heads.withColumn("a", F.row_number().over(W.partitionBy("doc_id", "canonical").orderBy("ord"))).filter(F.col("a") <= per_canonical)
    return heads.withColumn("b", F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))).filter(F.col("b") <= per_doc).select("doc_id", "ord", "canonical")


def rule_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, surface, score) of references 4, expanded ranges 6, defined terms 6 and capitalised runs 2."""
    t = F.coalesce(F.col("text"), F.lit(""))
    every = lambda p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    found = [
        (every(f"({T.LEGAL_REF})", 1), 4),
        (T.expand_ranges(t), 6),
        (every(r"""(?i)(?:^|\s)["']([^"']{2,80}?)["']\s+(?:shall\s+)?means\b""", 1), 6),
        (every(r"(?i)\b([A-Z][A-Za-z0-9\-]*(?:\s+[A-Z][A-Za-z0-9\-]*){0,6})\s+(?:shall\s+)?mean(?:s)?\b", 1), 6),
        (every(r"""(?i)\breferred\s+to\s+as\s+["']?([^"'\n\r]{2,80})["']?""", 1), 6),
        (every(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5})\b", 1), 2),
    ]
    rows = F.flatten(F.array(*[_labelled(F.transform(xs, F.trim), F.lit(s).alias("score"), "surface") for xs, s in found]))
    return docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.surface", "r.score").filter(F.col("surface") != "")


def scored_candidates(cands: DataFrame) -> DataFrame:
    """(doc_id, norm, surface, score, freq) per normalised form: least surface, sums; surfaces of 2 to 120, forms over 2 characters."""
    n = cands.withColumn("norm", T.normalize_surface(F.col("surface"))).filter(F.length("surface").between(2, 120)).filter(F.length("norm") > 2)
    return n.groupBy("doc_id", "norm").agg(F.min("surface").alias("surface"), F.sum("score").alias("score"), F.count("*").alias("freq"))


def candidate_budget(n_chars: Column) -> Column:
    """How many candidates a text may have: 200 to 1400, by the logarithm of its length."""
    return F.least(F.greatest(F.floor(350 + 120 * F.log10(F.greatest(n_chars, F.lit(10)) / 10000.0 + 1)), F.lit(200)), F.lit(1400)).cast("int")


def ranked_candidates(scored: DataFrame, sizes: DataFrame) -> DataFrame:
    """The best candidates of each text within its budget: by score, frequency, length, then form."""
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("freq"), F.desc(F.length("surface")), "norm")
    return scored.join(sizes, "doc_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= candidate_budget(F.col("n_chars"))).select("doc_id", "norm", "score", "freq", "rank")
