"""Queries of report sections, features and silver labels; the SQL says in DuckDB's words what the definitions say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import labels as L
from ..operators import reports as R
from .registry import query
from .tables import GRAPHS, REPORTS, TRISTATE, graphs, reports, silver_labels, table

_STOP = "|".join(X.HEADERS)
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NORMAL = _TRIM.format(r"regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_SECTION = "nullif(" + _TRIM.format(r"regexp_extract(t, '(?is)(?:^|\n)\s*{0}\s*:?\s*(.*?)(?:\n\s*(?:" + _STOP + r")\s*:?\s*|\z)', 1)") + ", '')"
_OWN = "nullif(" + _TRIM.format(r"regexp_extract(t, '(?ims)^\s*{0}\s*:?\s*(.*?)(?:^\s*(?:" + _STOP + r")\s*:?\s*$|\z)', 1)") + ", '')"
_PARTS = ", ".join(f"{_SECTION.format(k)} AS {k.lower()}" for k in ("FINDINGS", "IMPRESSION", "ADDENDUM"))
_LAST = r"string_split(regexp_replace(t, '\n\s*\n+', chr(10) || chr(10), 'g'), chr(10) || chr(10))[-1]"
PARSED = f"{REPORTS}, n AS (SELECT subject, study, {_NORMAL.format('report_text')} AS t FROM reports), s0 AS (SELECT *, {_PARTS}, {_LAST} AS last_paragraph FROM n), s AS (SELECT *, {_TRIM.format("coalesce(impression, '') || chr(10) || coalesce(findings, '')")} AS scope_both, coalesce(impression, findings, last_paragraph, t) AS scope_fallback FROM s0)"


def _near(c: str, *groups: str, within: int = 120) -> str:
    return f"regexp_matches({c}, '" + f".{{0,{within}}}".join(f"({g})" for g in groups) + "')"


_A = "bilateral|bibasilar|both lungs"
_FEATURES = {
    "text_present": f"{_near('f', R.SPREAD, R.OPACITY)} OR {_near('f', R.OPACITY, R.SPREAD)}",
    "text_uncertain": f"{_near('f', R.DOUBT_BEFORE, R.SPREAD_CORE, R.OPACITY_CORE)} OR {_near('f', R.SPREAD_CORE, R.DOUBT_BETWEEN, R.OPACITY_CORE)}",
    "text_negated": f"{_near('f', R.DENIED_BEFORE, R.SPREAD_CORE, R.OPACITY_CORE)} OR {_near('f', R.SPREAD_CORE, R.OPACITY_CORE, R.DENIED_AFTER)}",
    "text_right": _near("f", "right", R.OPACITY_CORE, within=80),
    "text_left": _near("f", "left", R.OPACITY_CORE, within=80),
    "text_edema": _near("f", f"{_A}|diffuse", R.EDEMA),
    "text_atelectasis": _near("f", _A, R.ATELECTASIS),
    "text_airspace": _near("f", f"{_A}|diffuse|multifocal", R.AIRSPACE),
    "text_present_both": _near("b", R.SPREAD, R.OPACITY_CORE),
    "text_present_fallback": _near("fb", R.SPREAD, R.OPACITY_CORE),
}
TEXTS = f"{PARSED}, low AS (SELECT subject, study, lower(t) AS f, lower(coalesce(scope_both, '')) AS b, lower(coalesce(scope_fallback, '')) AS fb FROM s), tx AS (SELECT study, {', '.join(f'{v} AS {k}' for k, v in _FEATURES.items())} FROM low)"
_M = lambda c, p: f"regexp_matches({c}, '{p}')"
_P, _BOTH = "l = 'OBS-DP'", _M("tt", R.GRAPH_BOTH)
_GRAPH = {
    "graph_present": f"{_M('st', R.GRAPH_OPACITY)} AND {_P}",
    "graph_uncertain": f"{_M('st', R.GRAPH_OPACITY)} AND l = 'OBS-U'",
    "graph_absent": f"{_M('st', R.GRAPH_OPACITY)} AND l = 'OBS-DA'",
    "graph_left": f"{_M('st', R.GRAPH_OPACITY)} AND {_P} AND {_M('tt', R.GRAPH_LEFT)}",
    "graph_right": f"{_M('st', R.GRAPH_OPACITY)} AND {_P} AND {_M('tt', R.GRAPH_RIGHT)}",
    "graph_both": f"{_M('st', R.GRAPH_OPACITY)} AND {_P} AND {_BOTH}",
    "graph_both_uncertain": f"{_M('st', R.GRAPH_OPACITY)} AND l = 'OBS-U' AND {_BOTH}",
    "graph_edema": f"{_M('st', R.EDEMA)} AND {_P} AND {_BOTH}",
    "graph_atelectasis": f"{_M('st', R.ATELECTASIS)} AND {_P} AND {_BOTH}",
    "graph_airspace": f"{_M('st', R.AIRSPACE)} AND {_P} AND {_BOTH}",
}
GRAPHED = f"{GRAPHS}, g AS (SELECT study, count(*) AS n_relations, {', '.join(f'bool_or({v}) AS {k}' for k, v in _GRAPH.items())}, list_sort(list(DISTINCT l || ': ' || st || ' -> ' || tt) FILTER ({_M('st', R.GRAPH_OPACITY)} AND tt IS NOT NULL))[1:20] AS examples FROM x GROUP BY study), gb AS (SELECT *, coalesce(graph_both, FALSE) OR (coalesce(graph_left, FALSE) AND coalesce(graph_right, FALSE)) AS graph_strict, coalesce(graph_both, FALSE) OR coalesce(graph_both_uncertain, FALSE) OR (coalesce(graph_left, FALSE) AND coalesce(graph_right, FALSE)) AS graph_sensitive FROM g)"
_C = lambda *names: ", ".join(f"coalesce({n}, FALSE) AS {n}" for n in names)
SILVER = f"""{TEXTS}, {GRAPHED}, {TRISTATE},
j AS (SELECT s.study, coalesce(lo, 0) AS lo, coalesce(le, 0) AS le, coalesce(lc, 0) AS lc, coalesce(la, 0) AS la, tri.study IS NOT NULL AS hl, {_C('text_present', 'text_uncertain', 'text_negated', 'text_edema', 'text_atelectasis', 'text_airspace', 'graph_strict', 'graph_sensitive', 'graph_both_uncertain', 'graph_edema', 'graph_atelectasis', 'graph_airspace')} FROM s LEFT JOIN tri USING (study) LEFT JOIN gb USING (study) LEFT JOIN tx USING (study)),
k AS (SELECT *, graph_edema OR text_edema AS edema, graph_atelectasis OR text_atelectasis AS atelectasis, graph_airspace OR text_airspace AS airspace, graph_both_uncertain OR text_uncertain AS uncertain,
(graph_strict OR text_present) AND NOT text_negated AS ss, (graph_sensitive OR text_present OR text_uncertain OR graph_edema OR text_edema OR graph_atelectasis OR text_atelectasis OR graph_airspace OR text_airspace) AND NOT text_negated AS se,
hl AND lo = 0 AND le = 0 AND lc = 0 AND la = 0 AND NOT graph_sensitive AND NOT text_present AND NOT text_uncertain AND NOT text_edema AND NOT text_atelectasis AND NOT text_airspace AS neg FROM j),
v AS (SELECT study, ss OR se OR uncertain AS any_opacity, (graph_strict OR text_present OR text_uncertain OR edema OR airspace) AND NOT text_negated AS not_atelectatic, CASE WHEN ss THEN 1 WHEN neg THEN 0 END AS silver_strict, CASE WHEN se THEN 1 WHEN neg THEN 0 END AS silver_sensitive,
CASE WHEN graph_strict AND text_present THEN 0.95 WHEN graph_strict THEN 0.90 WHEN text_present AND NOT text_negated THEN 0.85 WHEN graph_sensitive THEN 0.75 WHEN uncertain THEN 0.55 WHEN lo = 1 THEN 0.35 WHEN lo = -1 THEN 0.30 WHEN hl AND lo = 0 THEN 0.05 END::DOUBLE AS silver_score,
CASE WHEN graph_strict AND text_present THEN 'radgraph_strict_plus_regex' WHEN graph_strict THEN 'radgraph_strict' WHEN text_present AND NOT text_negated THEN 'regex_strict' WHEN graph_sensitive THEN 'radgraph_sensitive' WHEN uncertain THEN 'regex_or_radgraph_uncertain' WHEN lo = 1 THEN 'chexpert_lung_opacity_only' WHEN lo = -1 THEN 'chexpert_lung_opacity_uncertain_only' WHEN hl AND lo = 0 THEN 'chexpert_negative' ELSE 'unclassified' END AS silver_source,
list_filter([CASE WHEN graph_strict <> text_present THEN 'radgraph_regex_disagreement' END, CASE WHEN text_negated AND (graph_strict OR text_present) THEN 'positive_and_negated_conflict' END, CASE WHEN lo = 1 AND NOT graph_sensitive AND NOT text_present THEN 'broad_opacity_without_bilateral_signal' END], lambda x: x IS NOT NULL) AS flags,
CASE WHEN graph_strict <> text_present OR uncertain THEN 'high' WHEN lo = 1 AND NOT graph_sensitive AND NOT text_present THEN 'medium' ELSE 'low' END AS review_priority FROM k)"""


def _parsed(spark, sf_dir, **kind):
    return R.sections(reports(spark, sf_dir), **kind)


def _graphed(spark, sf_dir):
    rel, e = graphs(spark, sf_dir)
    return R.bilateral(R.graph_features(R.expanded_relations(rel, e, ["study"]), ["study"]))


def silver(spark, sf_dir):
    d = R.text_features(_parsed(spark, sf_dir)).select("subject", "study", *_FEATURES)
    return R.silver(R.star(d, silver_labels(spark, sf_dir), _graphed(spark, sf_dir), ["study"]))


@query(f"WITH {SILVER} SELECT study, silver_source, review_priority FROM v")
def silver_from_tables(spark, sf_dir):
    """The same labels where text features are a table of their own: three joins."""
    d = _parsed(spark, sf_dir)
    texts = R.text_features(d).select("study", *_FEATURES)
    return R.silver(R.star(d.select("study"), silver_labels(spark, sf_dir), _graphed(spark, sf_dir), ["study"], texts)).select("study", "silver_source", "review_priority")


@query(f"WITH {SILVER} SELECT coalesce(silver_strict, -9) AS silver_strict, coalesce(silver_sensitive, -9) AS silver_sensitive, silver_source, count(*) AS n, round(avg(silver_score), 6) AS mean_score FROM v GROUP BY ALL")
def label_prevalence(spark, sf_dir):
    """Sections, features of texts and graphs, three joins, silver labels, and how often each comes."""
    return silver(spark, sf_dir).fillna(-9, ["silver_strict", "silver_sensitive"]).groupBy("silver_strict", "silver_sensitive", "silver_source").agg(F.count("*").alias("n"), F.round(F.avg("silver_score"), 6).alias("mean_score"))


@query(f"WITH {SILVER} SELECT study, any_opacity, not_atelectatic, coalesce(silver_strict, -9) AS silver_strict, coalesce(silver_sensitive, -9) AS silver_sensitive, silver_score, silver_source, array_to_string(flags, '|') AS flags, review_priority FROM v")
def silver_label_table(spark, sf_dir):
    d = silver(spark, sf_dir).fillna(-9, ["silver_strict", "silver_sensitive"])
    return d.select("study", "any_opacity", "not_atelectatic", "silver_strict", "silver_sensitive", "silver_score", "silver_source", F.array_join("qa_flags", "|").alias("flags"), "review_priority")


@query(f"WITH {SILVER} SELECT study, silver_source FROM v WHERE review_priority = 'high' ORDER BY sha256(study::VARCHAR), study LIMIT 200")
def review_queue(spark, sf_dir):
    return L.hashed_queue(silver(spark, sf_dir).where("review_priority = 'high'").select("study", "silver_source"), "study")


@query(f"WITH {PARSED} SELECT subject, study FROM s WHERE t IS NOT NULL ORDER BY sha256(subject || '-' || study::VARCHAR), subject, study LIMIT 300")
def limited_extract(spark, sf_dir):
    d = R.model_extract(_parsed(spark, sf_dir), ["subject", "study"])
    return R.limited_extract(d, "subject", "study", 300)


_SHA = lambda c: f"sha256(coalesce({c}, '-'))"


@query(f"WITH {PARSED} SELECT study, {', '.join(f'{_SHA(c)} AS {c}' for c in ('findings', 'impression', 'addendum', 'last_paragraph', 'scope_both', 'scope_fallback'))}, findings IS NOT NULL AS has_findings, impression IS NOT NULL AS has_impression, addendum IS NOT NULL AS has_addendum FROM s")
def report_sections(spark, sf_dir):
    columns = ("findings", "impression", "addendum", "last_paragraph", "scope_both", "scope_fallback")
    return _parsed(spark, sf_dir).select("study", *(F.sha2(F.coalesce(c, F.lit("-")), 256).alias(c) for c in columns), "has_findings", "has_impression", "has_addendum")


_BLANKS = f"{REPORTS}, n AS (SELECT study, {_TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(report_text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM reports)"


@query(f"WITH {_BLANKS} SELECT study, {_SHA(_OWN.format('FINDINGS'))} AS findings, {_SHA(_OWN.format('IMPRESSION'))} AS impression, {_SHA(_OWN.format('ADDENDUM'))} AS addendum FROM n")
def report_sections_own_line(spark, sf_dir):
    """The other definition: only a header alone on its line ends a section, and blanks are collapsed."""
    d = _parsed(spark, sf_dir, own_line=True)
    return d.select("study", *(F.sha2(F.coalesce(c, F.lit("-")), 256).alias(c) for c in ("findings", "impression", "addendum")))


@query(f"WITH {TEXTS} SELECT * FROM tx")
def text_features(spark, sf_dir):
    return R.text_features(_parsed(spark, sf_dir)).select("study", *_FEATURES)


@query(f"WITH {GRAPHED} SELECT study, n_relations, {', '.join(f'coalesce({k}::INT, -1) AS {k}' for k in _GRAPH)}, graph_strict, graph_sensitive, coalesce(array_to_string(examples, '|'), '') AS examples FROM gb")
def graph_report_features(spark, sf_dir):
    g = _graphed(spark, sf_dir)
    return g.select("study", "n_relations", *(F.coalesce(F.col(k).cast("int"), F.lit(-1)).alias(k) for k in _GRAPH), "graph_strict", "graph_sensitive", F.array_join("examples", "|").alias("examples"))


_W = r"[0-9A-Za-z_]+"


@query(f"WITH w AS (SELECT doc_id, text, list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: len(regexp_extract_all(x, '{_W}'))) AS runs FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(text) AS n_characters, len(regexp_extract_all(text, '{_W}')) AS n_words, list_max(runs) AS longest_run, length(text) > 16000 AS too_many_characters, list_max(runs) > 500 AS too_long_run FROM w")
def text_lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", *(c.alias(k) for k, c in X.text_lengths(F.col("text"), word=_W).items()))


@query("SELECT doc_id, CASE WHEN id IS NULL THEN 'missing' WHEN id = '' THEN 'empty' WHEN regexp_matches(id, '^\\s|\\s$') THEN 'leading_or_trailing_whitespace' WHEN id IN ('.', '..') THEN 'dot_path_component' WHEN id LIKE '%.' THEN 'trailing_dot' WHEN regexp_matches(id, '[<>:\"/\\\\|?*]') THEN 'windows_invalid_character' WHEN regexp_matches(upper(string_split(id, '.')[1]), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN 'windows_reserved_device_name' ELSE 'fine' END AS reason FROM (SELECT doc_id, [NULL, '', ' a', '..', 'a.', 'a:b', 'con.x', 'a_' || doc_id::VARCHAR][(doc_id % 8)::INT + 1] AS id FROM documents)")
def unsafe_ids(spark, sf_dir):
    ids = F.array(F.lit(None).cast("string"), *map(F.lit, ("", " a", "..", "a.", "a:b", "con.x")), X.rendered_id("a_{doc_id}", doc_id=F.col("doc_id")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(ids, F.pmod("doc_id", F.lit(8)).cast("int")).alias("id"))
    return d.select("doc_id", F.coalesce(X.unsafe_id_reason(F.col("id")), F.lit("fine")).alias("reason"))
