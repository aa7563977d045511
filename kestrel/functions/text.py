"""Text scalars as column expressions; Java regular expressions with ASCII classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of a legal reference, as an alternation.
LEGAL = "Article|Section|Clause|Chapter|Part|Schedule|Rule|Regulation"
LEGAL_REF = rf"(?i)\b(?:{LEGAL})\s+(?:\d+[A-Za-z]?)(?:\([0-9A-Za-z]+\))*\b"
RANGE = r"(?i)\bArticles?\s+\d+[A-Za-z]\s*[-\x{2013}\x{2014}]\s*\d*[A-Za-z]\b"


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def clean_whitespace(c: Column) -> Column:
    """No-break spaces and tabs to single spaces, line ends to \\n, at most one empty line, stripped."""
    c = _sub(_sub(_sub(c, " ", " "), "\r\n?", "\n"), "[ \t]+", " ")
    return _sub(_sub(c, "\n{2,}", "\n\n"), r"^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces."""
    return F.trim(_sub(_sub(F.lower(clean_whitespace(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def normalize_surface(c: Column) -> Column:
    """Canonical form of an entity surface: the same alphabet as normalize_text."""
    return F.trim(_sub(_sub(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def index_norm(c: Column) -> Column:
    return F.lower(F.trim(_sub(c, r"\s+", " ")))


def tokens(c: Column) -> Column:
    """White-space tokens; empty for an empty text."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def digest(*parts: Column) -> Column:
    """sha256 of the parts joined by two pipes."""
    return F.sha2(F.concat_ws("||", *parts), 256)


def edge_id(src: Column, kind: Column, dst: Column, sid: Column) -> Column:
    return F.substring(digest(src, kind, dst, sid), 1, 16)


def is_legal_id(c: Column) -> Column:
    return normalize_surface(c).rlike(rf"^({LEGAL.lower()})\s+\d+[a-z]?$")


def node_id(canonical: Column) -> Column:
    """Stable node id of a canonical form."""
    n = normalize_surface(canonical)
    named = lambda *xs: n.isin(*xs)
    under = F.replace(n, F.lit(" "), F.lit("_"))
    part = lambda p, g=1: F.regexp_extract(n, p, g)
    ordinal = r"^(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+schedule$"
    return (
        F.when(n == "", F.lit("ent:unknown"))
        .when(n.rlike(r"^article\s+\d{1,3}[a-z]?$"), F.concat(F.lit("art:"), part(r"^article\s+(\d{1,3}[a-z]?)$")))
        .when(n.rlike(r"^section\s+\d{1,4}[a-z]?$"), F.concat(F.lit("sec:"), part(r"^section\s+(\d{1,4}[a-z]?)$")))
        .when(n.rlike(r"^part\s+[ivxlcdm]{1,7}$"), F.concat(F.lit("part:"), part(r"^part\s+([ivxlcdm]{1,7})$")))
        .when(n.rlike(ordinal), F.concat(F.lit("sched:"), part(ordinal)))
        .when(named("president", "parliament", "governor", "state legislature", "affected state legislature"), F.concat(F.lit("inst:"), under))
        .when(named("fundamental rights", "directive principles", "directive principles of state policy"), F.concat(F.lit("concept:"), under))
        .when(named("presidential recommendation", "legislature consultation", "views of affected state", "consultation"), F.concat(F.lit("proc:"), under))
        .otherwise(F.concat(F.lit("ent:"), under))
    )


def expand_ranges(c: Column) -> Column:
    """'Articles 31A-31C' as [Article 31A, Article 31B, Article 31C]; same number, at most ten apart, either order."""
    raw = F.regexp_extract_all(c, F.lit(f"({RANGE})"), F.lit(1))

    def expand(m: Column) -> Column:
        pat = r"(?i)(\d+)([A-Za-z])\s*[-\x{2013}\x{2014}]\s*(\d*)([A-Za-z])$"
        n1, n2 = F.regexp_extract(m, pat, 1), F.regexp_extract(m, pat, 3)
        a, b = F.ascii(F.upper(F.regexp_extract(m, pat, 2))), F.ascii(F.upper(F.regexp_extract(m, pat, 4)))
        lo, hi = F.least(a, b), F.greatest(a, b)
        ok = ((n2 == "") | (n1 == n2)) & (hi - lo <= 10)
        return F.when(ok, F.transform(F.sequence(lo, hi), lambda k: F.concat(F.lit("Article "), n1, F.char(k)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(raw, expand))


def surface_variants(c: Column) -> Column:
    """Spellings of a surface, longest first: quotes, hyphens, commas, dots and ampersands varied."""
    squeeze = lambda x: F.trim(_sub(x, r"\s+", " "))
    s = squeeze(F.translate(c, "“”‘’", "\"\"''"))
    rep = lambda a, b: F.replace(s, F.lit(a), F.lit(b))
    every = F.array(s, rep("-", " "), rep(" ", "-"), rep(",", " "), rep(".", " "), rep("&", " and "), rep("&", " "))
    kept = F.array_distinct(F.filter(F.transform(every, squeeze), lambda x: x != ""))
    keyed = F.array_sort(F.transform(kept, lambda x: F.struct((-F.length(x)).alias("n"), F.lower(x).alias("l"), x.alias("x"))))
    return F.transform(keyed, lambda k: k["x"])


def surface_pattern(c: Column) -> Column:
    """A pattern for a surface: escaped, white space flexible, word ends where it is alphanumeric."""
    s = F.trim(c)
    esc = _sub(_sub(s, r"([^A-Za-z0-9_\s])", r"\\$1"), r"\s+", r"\\s+")
    return F.concat(F.lit("(?i)"), F.when(s.rlike(r"^[A-Za-z0-9_\- ]+$"), F.concat(F.lit(r"\b"), esc, F.lit(r"\b"))).otherwise(esc))


def snippet(c: Column, start: Column, end: Column, before: int = 80, after: int = 80) -> Column:
    """Characters around a span given from zero."""
    lo = F.greatest(start - before, F.lit(0))
    return F.substring(c, lo + 1, end + after - lo)


def acronyms(c: Column) -> Column:
    """Pairs 'Long Form (LF)' as structs of the long form and the acronym."""
    pat = r"([A-Z][A-Za-z]+(?:\s+[A-Za-z]+){1,6})\s+\(([A-Z]{2,})\)"
    return F.arrays_zip(F.regexp_extract_all(c, F.lit(pat), F.lit(1)).alias("long_form"), F.regexp_extract_all(c, F.lit(pat), F.lit(2)).alias("acronym"))


def schema_name(c: Column, prefix: str = "") -> Column:
    """A label safe for property-graph stores."""
    s = F.trim(F.coalesce(c, F.lit("")))
    t = _sub(_sub(_sub(s, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")
    return F.when(t == "", F.lit(f"{prefix}UNKNOWN")).when(t.rlike("^[0-9]"), F.concat(F.lit(prefix or "X_"), t)).otherwise(t)


def display_name(fallback: Column, *candidates: Column) -> Column:
    """First non-blank candidate on one line, 160 characters; else the fallback."""
    line = [F.nullif(F.trim(_sub(c, r"\s+", " ")), F.lit("")) for c in candidates]
    return F.coalesce(*[F.substring(x, 1, 160) for x in line], fallback)


def safe_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default))


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))
