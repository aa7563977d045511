"""Registered queries of the text, segmentation, filter and source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import rules
from kestrel.functions import text as T
from kestrel.operators import retrieve, segment, spans
from kestrel.plans.base import rows, table, values
from kestrel.sources import io

SURFACES = ("id int, s string", [(i, s) for i, s in enumerate(["  Third-Party  Liability! ", "Article 31A", "article 13(2)(b)", "Section 12", "PART III", "First Schedule", "President", "State Legislature", "Fundamental Rights", "consultation", "", "S&P Global, Inc.", "Act, 1988", "motor vehicles act", "Article 1234", "tenth   schedule", "DPSP", "Views of affected state"])])
QUESTIONS = ("id int, q string", [(i, s) for i, s in enumerate(["What is X?", "How to claim", "A vs B", "Why so", "Suppose a fire", "Tell me more", "What is the difference between A and B", "List all exclusions", "give an example of theft", "is anything missing here", "overview of the policy", "How does the statutory override interact with exclusions", "Article 3 and views of states", "Articles 31A-31C and article 13", "31A-32C", "top 10", "how are the communities organized into clusters", "tl;dr please", "war and third party liability", "third party liability"])])
TEXTS = ("doc_id int, text string", [(0, "World Health Organization (WHO) met the European Central Bank (ECB) today."), (1, "Articles 31A-31C apply. Articles 9C-9A too, but Articles 31A-32C do not."), (2, "The President may, on recommendation of the President, consult. Governor and Parliament.\n1. Regulated supply of power\nPART III RIGHTS\nFirst Schedule\nArticle 3 stands; see Section 12(2) and Article 31A."), (3, '"Loss" means damage. Insured Person means a person. It is referred to as Policy Holder, maybe.'), (4, "Constitution of Examples\n1. Name of the union\n2. Admission of states\n31A. Saving of laws\n500. Too large"), (5, "not covered by general exceptions; right of recovery from the insured; nuclear war"), (6, "notwithstanding the motor vehicles act, the insurer shall pay the third party"), (7, ""), (8, "3."), (9, "Article 3"), (10, "ok.")])
LABELS = ("id int, s string", [(i, s) for i, s in enumerate(["part of", "PartOf", "subject to", "3x", "Not Withstanding", "right of recovery", "obligates", "x", "saves", "listed on!", "related"])])


def _over(name, cols):
    """A query that selects expressions over a table; they are made when it runs."""
    return lambda spark, sf: table(spark, sf, name).select(*cols())


def _fix(fixture, cols):
    return lambda spark, sf: rows(spark, fixture).select(*cols())


CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({c}, chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def clean_sql(c: str) -> str:
    return CLEAN_SQL.format(c=c)


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({clean_sql(c)}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def surface_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def any_sql(c: str, words: list[str]) -> str:
    q = lambda w: w.replace("'", "''")
    return "(" + " OR ".join(f"starts_with({c}, '{q(w[1:])}')" if w[0] == "^" else f"contains({c}, '{q(w)}')" for w in words) + ")"


def tag_sql(c: str, tag: str) -> str:
    return f"coalesce(regexp_matches({c}, '{rules.TAGS[tag]}', 'i'), false)"


_n = surface_sql("s")
_u = f"replace({_n}, ' ', '_')"
NODE_SQL = rf"""CASE WHEN {_n} = '' THEN 'ent:unknown'
 WHEN regexp_full_match({_n}, 'article\s+\d{{1,3}}[a-z]?') THEN 'art:' || regexp_extract({_n}, 'article\s+(.*)', 1)
 WHEN regexp_full_match({_n}, 'section\s+\d{{1,4}}[a-z]?') THEN 'sec:' || regexp_extract({_n}, 'section\s+(.*)', 1)
 WHEN regexp_full_match({_n}, 'part\s+[ivxlcdm]{{1,7}}') THEN 'part:' || regexp_extract({_n}, 'part\s+(.*)', 1)
 WHEN regexp_full_match({_n}, '(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+schedule') THEN 'sched:' || regexp_extract({_n}, '^([a-z]+)', 1)
 WHEN {_n} IN ('president','parliament','governor','state legislature','affected state legislature') THEN 'inst:' || {_u}
 WHEN {_n} IN ('fundamental rights','directive principles','directive principles of state policy') THEN 'concept:' || {_u}
 WHEN {_n} IN ('presidential recommendation','legislature consultation','views of affected state','consultation') THEN 'proc:' || {_u}
 ELSE 'ent:' || {_u} END"""
_lq = "trim(lower(coalesce(q, '')))"
CLASS_SQL = "CASE " + " ".join(f"WHEN {any_sql(_lq, w)} THEN '{n}'" for n, w in rules.CLASSES) + " ELSE 'general' END"
_words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"


def seg1(spark, sf):
    return segment.paragraphs(table(spark, sf, "documents"), "\n", 60)


SEG1_SQL = r"""WITH p AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
  list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 60) AS p FROM documents),
u AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [t] END AS p FROM p)
SELECT doc_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS idx, unnest(p) AS text FROM u"""
SENT_SQL = rf"""WITH c AS (SELECT doc_id, string_split(regexp_replace({clean_sql("coalesce(text, '')")}, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS p FROM documents),
u AS (SELECT doc_id, unnest(range(0, len(p))) AS idx, unnest(p) AS text FROM c),
o AS (SELECT doc_id, idx, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, 'sent:' || doc_id || ':' || idx AS sent_id, trim(text) AS text, CAST(s AS BIGINT) AS start_char, CAST(s + length(text) AS BIGINT) AS end_char
FROM o WHERE length(trim(text)) >= 30 OR regexp_matches(trim(text), '^\s*\d{{1,3}}[A-Za-z]?\s*[.\x{{2013}}\x{{2014}}\-]{{1,2}}\s*$') OR regexp_matches(trim(text), '^\s*({T.LEGAL})\s+\d+[A-Za-z]?(\([0-9A-Za-z]+\))*\s*$', 'i')"""
CHUNK_SQL = rf"""WITH w AS (SELECT doc_id, {_words} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 160) / 120.0)) AS BIGINT) * 120 + 1, 120)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, 'chunk:' || doc_id || ':' || s || '-' || least(s + 160, len(w)) AS chunk_id, array_to_string(list_slice(w, s + 1, s + 160), ' ') AS text FROM s"""


def seg6(spark, sf):
    return segment.structure(rows(spark, TEXTS))


def seg8(spark, sf):
    return segment.rule_candidates(rows(spark, TEXTS)).groupBy("doc_id", "surface", "score").agg(F.count("*").alias("n"))


def agg12(spark, sf):
    return segment.scored_candidates(segment.rule_candidates(table(spark, sf, "documents").select("doc_id", "text")))


def srt3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    sizes = docs.select("doc_id", F.length("text").alias("n_chars"))
    return segment.ranked_candidates(segment.scored_candidates(segment.rule_candidates(docs)), sizes)


def seg9(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spans.seed_mentions(docs, rows(spark, ("surface string", [("Apache License",), ("MIT License",), ("worthless",)])))


def seg11(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", segment.middle_window(F.coalesce(F.col("text"), F.lit("")), 20).alias("middle"))


_CW = _words
SEG11_SQL = rf"""WITH w AS (SELECT conv_id, turn, {_CW} AS w FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN len(w) > 20 THEN list_slice(w, CAST(greatest(0, floor((len(w) - 20) / 2.0)) AS BIGINT) + 1, CAST(greatest(0, floor((len(w) - 20) / 2.0)) AS BIGINT) + 20) ELSE w END, ' ') AS middle FROM w"""


def ded1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spans.dedup_in_order(docs, segment.sentence_parts(T.clean_whitespace(F.coalesce(F.col("text"), F.lit("")))), 0.9)


def src1(spark, sf):
    return io.corpus(table(spark, sf, "documents"), table(spark, sf, "pages")).select("doc_id", F.length("text").alias("n"))


def src4(spark, sf):
    return table(spark, sf, "pages").select("page_id", io.url_slug(F.col("url")).alias("doc_id"), io.html_text(F.col("html")).alias("text"))


_h = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gsi'), '<style\b.*?</style>', ' ', 'gsi'), '<noscript\b.*?</noscript>', ' ', 'gsi'), '<[^>]*>', chr(10), 'gs')"
for _a, _b in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _h = f"replace({_h}, '{_a}', {_b})"
SLUG_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
HTML_SQL = clean_sql(rf"regexp_replace({_h}, '\n\s*', chr(10), 'g')").replace("{{", "{")

SHORT_SQL = rf"(regexp_matches(text, '^\s*\d{{1,3}}[A-Za-z]?\s*[.\x{{2013}}\x{{2014}}\-]{{1,2}}\s*$') OR regexp_matches(text, '^\s*({T.LEGAL})\s+\d+[A-Za-z]?(\([0-9A-Za-z]+\))*\s*$', 'i'))"
_sp = ", ".join(f"('{a}', '{b}')" for a, b in rules.SPELLINGS.items())

def queries() -> dict:
    """name: (query, SQL or None)."""
    return {
        "txt1_clean_whitespace": (_over("documents", lambda: ["doc_id", T.clean_whitespace(F.col("text")).alias("text")]), f"SELECT doc_id, {clean_sql('text')} AS text FROM documents"),
        "txt2_normalize_text": (_over("documents", lambda: ["doc_id", T.normalize_text(F.col("text")).alias("text")]), f"SELECT doc_id, {norm_sql('text')} AS text FROM documents"),
        "txt3_normalize_surface": (_fix(SURFACES, lambda: ["id", T.normalize_surface(F.col("s")).alias("n")]), f"WITH {values(SURFACES, 'f')} SELECT id, {_n} AS n FROM f"),
        "txt4_index_norm": (_over("conversations", lambda: ["conv_id", "turn", T.index_norm(F.col("text")).alias("text")]), r"SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text FROM conversations"),
        "txt5_sanitize_evidence": (lambda s, d: table(s, d, "documents").select("doc_id", spans.sanitize_evidence(F.col("text")).alias("text")), None),
        "txt6_digest": (_over("documents", lambda: ["doc_id", T.digest(F.col("lang"), F.col("text")).alias("digest")]), "SELECT doc_id, sha256(concat_ws('||', lang, text)) AS digest FROM documents"),
        "txt7_canonical_json": (_over("nation", lambda: [F.to_json(F.struct("n_name", "n_nationkey", "n_regionkey")).alias("j")]), "SELECT CAST(to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey}) AS VARCHAR) AS j FROM nation"),
        "txt9_acronyms": (lambda s, d: rows(s, TEXTS).select("doc_id", F.explode(T.acronyms(F.col("text"))).alias("x")).select("doc_id", "x.*").toDF("doc_id", "long_form", "acronym"), rf"WITH {values(TEXTS, 'f')} SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][A-Za-z]+(?:\s+[A-Za-z]+){{1,6}})\s+\(([A-Z]{{2,}})\)', 1)) AS long_form, unnest(regexp_extract_all(text, '([A-Z][A-Za-z]+(?:\s+[A-Za-z]+){{1,6}})\s+\(([A-Z]{{2,}})\)', 2)) AS acronym FROM f"),
        "txt10_node_id": (_fix(SURFACES, lambda: ["id", T.node_id(F.col("s")).alias("node_id")]), f"WITH {values(SURFACES, 'f')} SELECT id, {NODE_SQL} AS node_id FROM f"),
        "txt11_legal_id": (_fix(SURFACES, lambda: ["id", T.is_legal_id(F.col("s")).alias("legal")]), rf"WITH {values(SURFACES, 'f')} SELECT id, regexp_full_match({_n}, '({T.LEGAL.lower()})\s+\d+[a-z]?') AS legal FROM f"),
        "txt12_expand_ranges": (lambda s, d: rows(s, TEXTS).select("doc_id", F.explode(T.expand_ranges(F.col("text"))).alias("ref")), rf"""WITH {values(TEXTS, 'f')}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, 'Articles?\s+(\d+[A-Za-z]\s*-\s*\d*[A-Za-z])\b', 1)) AS m FROM f),
p AS (SELECT doc_id, regexp_extract(m, '^(\d+)', 1) AS n1, regexp_extract(m, '-\s*(\d*)', 1) AS n2, ascii(upper(regexp_extract(m, '^\d+([A-Za-z])', 1))) AS a, ascii(upper(regexp_extract(m, '([A-Za-z])$', 1))) AS b FROM m)
SELECT doc_id, 'Article ' || n1 || chr(unnest(range(least(a, b), greatest(a, b) + 1))::INTEGER) AS ref FROM p WHERE (n2 = '' OR n1 = n2) AND abs(a - b) <= 10"""),
        "txt13_variants": (_fix(SURFACES, lambda: ["id", F.array_join(T.surface_variants(F.col("s")), "|").alias("v")]), rf"""WITH {values(SURFACES, 'f')}, s AS (SELECT id, trim(regexp_replace(s, '\s+', ' ', 'g')) AS s FROM f),
v AS (SELECT id, unnest([s, replace(s, '-', ' '), replace(s, ' ', '-'), replace(s, ',', ' '), replace(s, '.', ' '), replace(s, '&', ' and '), replace(s, '&', ' ')]) AS v FROM s),
c AS (SELECT DISTINCT id, trim(regexp_replace(v, '\s+', ' ', 'g')) AS v FROM v), g AS (SELECT id, string_agg(v, '|' ORDER BY length(v) DESC, lower(v), v) AS v FROM c WHERE v <> '' GROUP BY id)
SELECT f.id, coalesce(g.v, '') AS v FROM f LEFT JOIN g ON f.id = g.id"""),
        "txt14_pattern_hits": (lambda s, d: rows(s, SURFACES).filter("trim(s) <> ''").select("id", T.surface_pattern(F.col("s")).alias("p"), "s").selectExpr("id", "regexp_like(upper(s), p) AS hit"), f"WITH {values(SURFACES, 'f')} SELECT id, true AS hit FROM f WHERE trim(s) <> ''"),
        "txt15_snippet": (_over("documents", lambda: ["doc_id", T.snippet(F.col("text"), F.lit(100), F.lit(120)).alias("context")]), "SELECT doc_id, substr(text, 21, 180) AS context FROM documents"),
        "txt16_tokens": (_over("documents", lambda: ["doc_id", F.size(T.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("n"), F.size(F.array_distinct(T.tokens(F.coalesce(F.col("text"), F.lit(""))))).alias("d")]), f"SELECT doc_id, CAST(len({_words}) AS INTEGER) AS n, CAST(len(list_distinct({_words})) AS INTEGER) AS d FROM documents"),
        "txt17_tags": (_fix(TEXTS, lambda: ["doc_id", F.array_join(rules.tags(F.col("text")), ",").alias("tags")]), f"WITH {values(TEXTS, 'f')} SELECT doc_id, concat_ws(',', {', '.join(f'''CASE WHEN {tag_sql('text', t)} THEN '{t}' END''' for t in sorted(rules.TAGS))}) AS tags FROM f"),
        "txt18_interaction": (_fix(QUESTIONS, lambda: ["id", rules.is_interaction(F.col("q")).alias("interaction"), F.array_join(rules.required_tags(F.col("q")), ",").alias("required"), rules.filters_war(F.col("q")).alias("war")]), f"WITH {values(QUESTIONS, 'f')} SELECT id, {any_sql('lower(q)', rules.INTERACTION)} AS interaction, CASE WHEN {any_sql('lower(q)', rules.INTERACTION)} THEN 'exclusion,override,recovery' ELSE '' END AS required, {any_sql('lower(q)', rules.WAR_TOPIC)} AND NOT {any_sql('lower(q)', rules.WAR_WORDS)} AS war FROM f"),
        "txt19_classify": (_fix(QUESTIONS, lambda: ["id", rules.classify(F.col("q")).alias("c")]), f"WITH {values(QUESTIONS, 'f')} SELECT id, {CLASS_SQL} AS c FROM f"),
        "txt20_boost": (_fix(QUESTIONS, lambda: ["id", rules.community_boost(F.col("q")).alias("b")]), f"WITH {values(QUESTIONS, 'f')} SELECT id, CAST(CASE {CLASS_SQL} WHEN 'definition' THEN 0.05 WHEN 'overview' THEN 0.45 WHEN 'comparison' THEN 0.2 WHEN 'missing' THEN 0.05 ELSE 0.15 END AS DOUBLE) AS b FROM f"),
        "txt21_intents": (_fix(QUESTIONS, lambda: ["id", rules.is_summary(F.col("q")).alias("summary"), rules.is_structural(F.col("q")).alias("structural")]), f"WITH {values(QUESTIONS, 'f')} SELECT id, {any_sql('lower(q)', rules.SUMMARY)} AS summary, {any_sql('lower(q)', rules.STRUCTURAL)} AS structural FROM f"),
        "txt22_article_ids": (_fix(QUESTIONS, lambda: ["id", F.array_join(rules.article_ids(F.col("q")), ",").alias("ids")]), rf"""WITH {values(QUESTIONS, 'f')}, a AS (SELECT id, 'art:' || lower(unnest(regexp_extract_all(q, 'article\s+(\d{{1,3}}[a-z]?)\b', 1, 'i'))) AS x FROM f),
r AS (SELECT id, unnest(regexp_extract_all(q, '\b(\d{{1,3}}[A-Za-z]\s*-\s*\d{{1,3}}[A-Za-z])\b', 1)) AS m FROM f),
p AS (SELECT id, regexp_extract(m, '^(\d+)', 1) AS n1, lower(regexp_extract(m, '^\d+([A-Za-z])', 1)) AS c1, regexp_extract(m, '-\s*(\d+)', 1) AS n2, lower(regexp_extract(m, '([A-Za-z])$', 1)) AS c2 FROM r),
e AS (SELECT id, 'art:' || n1 || chr(unnest(range(least(ascii(c1), ascii(c2)), greatest(ascii(c1), ascii(c2)) + 1))::INTEGER) AS x FROM p WHERE n1 = n2 UNION ALL SELECT id, 'art:' || n1 || c1 FROM p WHERE n1 <> n2 UNION ALL SELECT id, 'art:' || n2 || c2 FROM p WHERE n1 <> n2),
g AS (SELECT id, string_agg(DISTINCT x, ',' ORDER BY x) AS ids FROM (SELECT * FROM a UNION ALL SELECT * FROM e) GROUP BY id)
SELECT f.id, coalesce(g.ids, '') AS ids FROM f LEFT JOIN g ON f.id = g.id"""),
        "txt23_required_relations": (_fix(QUESTIONS, lambda: ["id", F.array_join(rules.required_relations(F.col("q")), ",").alias("r")]), f"WITH {values(QUESTIONS, 'f')} SELECT id, concat_ws(',', CASE WHEN contains(lower(q), 'article 3') AND {any_sql('lower(q)', ['safeguard', 'views', 'consider', 'recommend', 'consult'])} THEN 'CONSIDERS_VIEWS_OF,REQUIRES_CONSULTATION_WITH,REQUIRES_RECOMMENDATION_FROM' END, CASE WHEN contains(lower(q), 'article 13') AND {any_sql('lower(q)', ['31a', '31b', '31c'])} THEN 'LIMITS,OVERRIDES,SAVES_LAWS_FROM_INVALIDATION,SUBJECT_TO' END) AS r FROM f"),
        "txt24_relation_label": (_fix(LABELS, lambda: ["id", rules.relation_label(F.col("s")).alias("label")]), rf"""WITH {values(LABELS, 'f')}, y(k, v) AS (VALUES {_sp}), n AS (SELECT id, regexp_replace(regexp_replace(upper(trim(s)), '\s+', '_', 'g'), '[^A-Z0-9_]', '', 'g') AS s FROM f),
a AS (SELECT id, coalesce(v, s) AS s FROM n LEFT JOIN y ON replace(s, '_', '') = k), b AS (SELECT id, coalesce(v, s) AS s FROM a LEFT JOIN y ON s = k)
SELECT id, CASE WHEN regexp_full_match(substr(s, 1, 48), '[A-Z][A-Z0-9_]{{1,47}}') THEN substr(s, 1, 48) END AS label FROM b"""),
        "txt25_augment": (_fix(QUESTIONS, lambda: ["id", rules.augment(F.col("q"), rules.required_tags(F.col("q"))).alias("q")]), f"WITH {values(QUESTIONS, 'f')} SELECT id, CASE WHEN {any_sql('lower(q)', rules.INTERACTION)} THEN q || chr(10) || chr(10) || 'Focus: right of recovery reimbursement repay recover from insured; statutory obligation notwithstanding motor vehicles act insurer shall pay third party; exclusion general exceptions not covered' ELSE q END AS q FROM f"),
        "txt28_safe_cast": (_over("part", lambda: ["p_partkey", T.safe_int(F.regexp_extract("p_brand", "#(.*)", 1), -1).alias("brand"), T.safe_float(F.col("p_type")).alias("x")]), "SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(p_brand, '#(.*)', 1) AS BIGINT), -1) AS brand, coalesce(TRY_CAST(p_type AS DOUBLE), 0.0) AS x FROM part"),
        "txt29_questions": (_over("events", lambda: ["event_id", F.explode(F.coalesce(F.from_json("props", "array<string>"), F.array("props"))).alias("q")]), "SELECT event_id, props AS q FROM events"),
        "seg1_paragraphs": (seg1, SEG1_SQL),
        "seg2_sentences": (lambda s, d: segment.sentences(table(s, d, "documents")), SENT_SQL),
        "seg3_keep_short": (_fix(TEXTS, lambda: ["doc_id", segment.keep_short(F.col("text")).alias("keep")]), f"WITH {values(TEXTS, 'f')} SELECT doc_id, {SHORT_SQL} AS keep FROM f"),
        "seg4_chunks": (lambda s, d: segment.chunks(table(s, d, "documents")), CHUNK_SQL),
        "seg5_char_chunks": (lambda s, d: segment.char_chunks(table(s, d, "documents"), 1200, "\n"), r"""WITH p AS (SELECT doc_id, unnest(range(0, len(p))) AS para, unnest(p) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
s AS (SELECT doc_id, para, p, unnest(range(0, CAST(greatest(0, ceil((length(p) - 1200) / 1000.0)) AS BIGINT) * 1000 + 1, 1000)) AS s FROM p WHERE length(p) > 0)
SELECT doc_id, CAST(para AS INTEGER) AS para, CAST(s AS INTEGER) AS start_char, CAST(least(s + 1200, length(p)) AS INTEGER) AS end_char, substr(p, s + 1, 1200) AS text FROM s"""),
        "seg6_structure": (seg6, None),
        "seg7_provisions": (lambda s, d: segment.provision_headings(rows(s, TEXTS)), None),
        "seg8_rule_candidates": (seg8, None),
        "seg9_seg10_mention_spans": (seg9, None),
        "seg11_middle_window": (seg11, SEG11_SQL),
        "agg12_candidates": (agg12, None),
        "agg17_budget": (_over("documents", lambda: ["doc_id", segment.candidate_budget(F.length(F.col("text"))).alias("budget")]), "SELECT doc_id, CAST(least(greatest(floor(350 + 120 * log10(greatest(length(text), 10) / 10000.0 + 1)), 200), 1400) AS INTEGER) AS budget FROM documents"),
        "srt3_ranked_candidates": (srt3, None),
        "ded1_greedy_sentences": (ded1, None),
        "flt1_min_chars": (lambda s, d: table(s, d, "conversations").filter(F.length(T.index_norm(F.col("text"))) >= retrieve.min_chars(F.when(F.col("role") == "user", "ENTITY").otherwise("CHUNK"))).select("conv_id", "turn"), r"SELECT conv_id, turn FROM conversations WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= CASE WHEN role = 'user' THEN 6 ELSE 40 END"),
        "flt5_war_noise": (_fix(TEXTS, lambda: ["doc_id", rules.is_war_noise(F.col("text")).alias("noise")]), f"WITH {values(TEXTS, 'f')} SELECT doc_id, {tag_sql('text', 'war_nuclear')} AND NOT ({' OR '.join(tag_sql('text', t) for t in rules.CORE_TAGS)}) AS noise FROM f"),
        "flt7_junk_clusters": (lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.collect_list(F.regexp_extract("p_brand", "#(.*)", 1)).alias("i")).select("p_brand", F.forall("i", lambda x: x.rlike("^[0-9]+$") | (F.length(x) <= 1)).alias("junk")), "SELECT p_brand, bool_and(regexp_full_match(regexp_extract(p_brand, '#(.*)', 1), '[0-9]+') OR length(regexp_extract(p_brand, '#(.*)', 1)) <= 1) AS junk FROM part GROUP BY p_brand"),
        "flt8_surface_length": (_over("part", lambda: ["p_partkey", (F.length("p_name").between(2, 120) & (F.length(T.normalize_surface(F.col("p_name"))) > 2)).alias("ok")]), f"SELECT p_partkey, length(p_name) BETWEEN 2 AND 120 AND length({surface_sql('p_name')}) > 2 AS ok FROM part"),
        "agg13_tag_coverage": (lambda s, d: rows(s, TEXTS).agg(*[F.count_if(rules.has_tag(F.col("text"), t)).alias(t) for t in sorted(rules.TAGS)]), f"WITH {values(TEXTS, 'f')} SELECT {', '.join(f'count(*) FILTER ({tag_sql(chr(116) + chr(101) + chr(120) + chr(116), t)}) AS {t}' for t in sorted(rules.TAGS))} FROM f"),
        "agg16_distinct_texts": (lambda s, d: table(s, d, "documents").select("doc_id", "text").join(table(s, d, "documents").groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "text").select("doc_id", "first_id", "n"), "SELECT d.doc_id, g.first_id, g.n FROM documents d JOIN (SELECT text, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text) g ON d.text = g.text"),
        "src1_corpus": (src1, f"SELECT 'doc_' || doc_id AS doc_id, CAST(length({clean_sql('text')}) AS INTEGER) AS n FROM documents UNION ALL SELECT {SLUG_SQL}, CAST(length({HTML_SQL}) AS INTEGER) FROM pages"),
        "src4_html_text": (src4, f"SELECT page_id, {SLUG_SQL} AS doc_id, {HTML_SQL} AS text FROM pages"),
        "snk5_export_names": (_over("supplier", lambda: ["s_suppkey", T.schema_name(F.col("s_name")).alias("label"), T.display_name(F.col("s_suppkey").cast("string"), F.col("s_name")).alias("name"), io.clean_number(F.col("s_acctbal")).alias("x")]), "SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(trim(s_name), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS label, substr(trim(s_name), 1, 160) AS name, s_acctbal AS x FROM supplier"),
    }

