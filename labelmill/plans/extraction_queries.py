"""Queries of the extraction stages; their SQL walks over all tokens with windows."""

from __future__ import annotations

import json
import tempfile
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import stemming
from ..operators import validation as V
from ..sources.readers import extraction_spec
from .registry import query
from .tables import REPORTS, reports, table


def short_stem(word: str) -> str:
    """A stemmer that SQL can say too: lower case without a final s."""
    w = word.lower()
    return w[:-1] if len(w) > 3 and w.endswith("s") else w


SPEC = X.Spec(
    terms=(("the", "OBJECT"), ("of the", "OBJECT"), ("de la", "OBJECT"), ("anan", "SIDE"), ("with", "SIDE"), ("la", "SIDE"), ("tin", "SIDE"), ("will", "OBJECT"), ("with the", "FINAL"), ("skipped term", "SIDE")),
    cues=(("to", X.NEGATION), ("is", X.NEGATION), ("not", X.NEGATION), ("et", X.AFTER), ("of", X.AFTER), ("to be", X.PSEUDO), ("is the", X.PSEUDO), ("not the", X.PSEUDO), ("and", X.CONJUNCTION), ("und", X.CONJUNCTION)),
    rules=(("SIDE", "OBJECT"), ("OBJECT", "SIDE")),
    abbreviations=frozenset({"of.", "the", "on.", "st", "re."}),
    excluded=frozenset({"skipped term"}),
    stem=short_stem,
    longest_sentence=40,
)
#: The same with terms that are rare in the texts.
RARE = replace(
    SPEC,
    terms=(("para", "OBJECT"), ("of an", "OBJECT"), ("para la", "OBJECT"), ("anan", "SIDE"), ("thanea", "SIDE"), ("los", "SIDE"), ("retion", "SIDE"), ("ertion", "OBJECT"), ("with an", "FINAL"), ("skipped term", "SIDE")),
)

_ENTRY = lambda e: f"('{e[0]}', '{e[1][0]}', '{e[1][1] if len(e[1]) > 1 else ''}', {len(e[1])}, '{e[2]}', {e[3]}, '{e[4]}')"
_W = "PARTITION BY doc_id ORDER BY pos"
_NO_S = "CASE WHEN length(form) > 3 AND form LIKE '%s' THEN left(form, -1) ELSE form END"


def _tokens(spec: X.Spec, source: str = "documents", stem: str = _NO_S, ctes: str = "") -> str:
    """Common table expressions up to m, the matches; at most two words a term or cue."""
    abbreviations = ", ".join(f"'{a}'" for a in sorted(spec.abbreviations))
    return rf"""{ctes}z AS (SELECT doc_id, regexp_extract_all(text, '\s+|{spec.token_pattern}') AS l FROM {source} WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(l) AS piece, unnest(range(len(l))) AS pos FROM z),
p1 AS (SELECT *, regexp_matches(piece, '^\s') AS blank, length(piece) AS n FROM p),
p2 AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0, sum(blank::INT) OVER (ORDER BY doc_id, pos) AS run FROM p1),
p3 AS (SELECT doc_id, piece, pos, n, run, (b0 - first_value(b0) OVER ({_W}))::BIGINT AS begin, pos = min(pos) OVER (PARTITION BY doc_id) AS head FROM p2 WHERE NOT blank OR TRUE),
r AS (SELECT doc_id, run, string_agg(piece, '' ORDER BY pos) FILTER (NOT regexp_matches(piece, '^\s')) AS word, coalesce(any_value(piece) FILTER (regexp_matches(piece, '^\s')), '') AS gap, min(pos) AS p0 FROM p3 GROUP BY ALL),
r1 AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY p0) AS before FROM r WHERE word IS NOT NULL),
r2 AS (SELECT *, before IS NULL OR regexp_matches(gap, '[\r\n]') OR (before LIKE '%.' AND NOT (regexp_matches(gap, '^[ \t]*$') AND ((before IN ({abbreviations}) AND (regexp_matches(word, '^\p{{Ll}}') OR word LIKE '\_\_\_%' ESCAPE '\')) OR (lower(left(before, -1)) = left(before, -1) AND upper(left(before, -1)) <> left(before, -1) AND left(before, -1) IN ({abbreviations}) AND regexp_matches(word, '^\p{{Ll}}'))))) AS starts FROM r1),
r3 AS (SELECT doc_id, run, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY p0) - 1 AS sentence FROM r2),
t0 AS (SELECT p3.doc_id, piece, begin, begin + n AS "end", sentence::BIGINT AS sentence, row_number() OVER (PARTITION BY p3.doc_id ORDER BY pos) - 1 AS token FROM p3 JOIN r3 ON r3.doc_id = p3.doc_id AND r3.run = p3.run WHERE NOT regexp_matches(piece, '^\s')),
t1 AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, sentence ORDER BY token) - 1) // {spec.longest_sentence} AS part, lower(piece) AS form FROM t0),
t2 AS (SELECT *, {stem} AS stem, coalesce(bool_or(regexp_matches(piece, '\p{{L}}')) OVER (PARTITION BY doc_id, sentence, part ORDER BY token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS letters FROM t1),
t AS (SELECT *, lead(form) OVER v AS form2, lead(stem) OVER v AS stem2, lead("end") OVER v AS end2 FROM t2 WINDOW v AS (PARTITION BY doc_id, sentence, part ORDER BY token)),
d(kind, w1, w2, n, tag, no, phrase) AS (VALUES {', '.join(map(_ENTRY, spec.entries()))}),
m AS (SELECT doc_id, sentence, part, kind, token AS first, token + n - 1 AS last, begin, CASE WHEN n = 1 THEN "end" ELSE end2 END AS "end", tag, no, phrase, letters FROM t JOIN d ON (kind = 't' AND stem = w1 AND (n = 1 OR stem2 = w2)) OR (kind = 'c' AND form = w1 AND (n = 1 OR form2 = w2)))"""
_CUT = "EXISTS (SELECT 1 FROM m s WHERE s.kind = 'c' AND s.tag = 'conjunctions' AND (s.doc_id, s.sentence, s.part) = (e.doc_id, e.sentence, e.part) AND s.begin >= {0} AND s.\"end\" <= {1})"


def _asserted(tokens: str, scope: int = 11) -> str:
    return f"""{tokens},
e AS (SELECT * FROM m WHERE kind = 't'),
before AS (SELECT e.doc_id, e.sentence, e.part, e.begin, e."end", e.no, c.phrase, row_number() OVER (PARTITION BY e.doc_id, e.begin, e."end", e.no ORDER BY c."end" DESC, c.begin DESC, c.no) AS place FROM e JOIN m c ON c.kind = 'c' AND c.tag = 'negPhrases' AND (c.doc_id, c.sentence, c.part) = (e.doc_id, e.sentence, e.part) AND c."end" <= e.begin AND e.first - c.last - 1 <= {scope}
 WHERE NOT {_CUT.format('c."end"', 'e.begin')} AND NOT EXISTS (SELECT 1 FROM m q WHERE q.kind = 'c' AND q.tag = 'pseNegPhrases' AND (q.doc_id, q.sentence, q.part) = (e.doc_id, e.sentence, e.part) AND (q.letters OR q.phrase LIKE 'not %') AND ((c.begin < q."end" AND q.begin < c."end") OR (c."end" <= q.begin AND q."end" <= e.begin)))),
behind AS (SELECT e.doc_id, e.begin, e."end", e.no, c.phrase, row_number() OVER (PARTITION BY e.doc_id, e.begin, e."end", e.no ORDER BY c.begin, c."end", c.no) AS place FROM e JOIN m c ON c.kind = 'c' AND c.tag = 'postNegPhrases' AND (c.doc_id, c.sentence, c.part) = (e.doc_id, e.sentence, e.part) AND c.begin >= e."end" AND c.first - e.last - 1 <= {scope} WHERE NOT {_CUT.format('e."end"', 'c.begin')}),
a AS (SELECT e.*, coalesce(x.phrase, y.phrase) AS cue, CASE WHEN coalesce(x.phrase, y.phrase) IS NULL THEN 'present' ELSE 'absent' END AS assertion FROM e LEFT JOIN before x ON x.place = 1 AND (x.doc_id, x.begin, x."end", x.no) = (e.doc_id, e.begin, e."end", e.no) LEFT JOIN behind y ON y.place = 1 AND (y.doc_id, y.begin, y."end", y.no) = (e.doc_id, e.begin, e."end", e.no))"""


def _adjacent(k: int, source: str, a: str, b: str) -> str:
    """The pass over neighbours: every later entity of the second tag with no gap in between, by a join."""
    return f"""n{k}0 AS (SELECT *, NOT coalesce(lag("end") OVER w <= begin AND first - lag(last) OVER w = 1, FALSE) AS broken FROM {source} WHERE tag <> 'FINAL' WINDOW w AS (PARTITION BY doc_id, sentence, part ORDER BY begin, "end", no)),
n{k}1 AS (SELECT *, sum(broken::INT) OVER (PARTITION BY doc_id, sentence, part ORDER BY begin, "end", no) AS cluster FROM n{k}0),
n{k}2 AS (SELECT f.doc_id, f.begin, f."end", f.no, arg_min([s.begin, s."end", s.no, s.last], [s.begin, s."end", s.no]) AS hit FROM n{k}1 f JOIN n{k}1 s ON (s.doc_id, s.sentence, s.part, s.cluster) = (f.doc_id, f.sentence, f.part, f.cluster) AND [s.begin, s."end", s.no] > [f.begin, f."end", f.no] WHERE f.tag = '{a}' AND s.tag = '{b}' GROUP BY ALL),
n{k} AS (SELECT s.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM n{k}2 h WHERE h.doc_id = s.doc_id AND h.hit[1:3] = [s.begin, s."end", s.no]) THEN 'FINAL' ELSE s.tag END AS tag) FROM {source} s)"""


def _distant(k: int, source: str, a: str, b: str) -> str:
    return f"""f{k}0 AS (SELECT f.doc_id, f.begin, f."end", f.no, arg_min([s.begin, s."end", s.no], [s.begin, s."end", s.no]) AS hit FROM {source} f JOIN {source} s ON (s.doc_id, s.sentence, s.part) = (f.doc_id, f.sentence, f.part) AND s.begin >= f."end" AND s.first - f.last - 1 BETWEEN 0 AND 5 LEFT JOIN n{k}2 h ON (h.doc_id, h.begin, h."end", h.no) = (f.doc_id, f.begin, f."end", f.no)
 WHERE f.tag = '{a}' AND s.tag = '{b}' AND CASE WHEN h.hit IS NULL THEN NOT EXISTS (SELECT 1 FROM {source} x WHERE x.tag = 'FINAL' AND (x.doc_id, x.sentence, x.part) = (f.doc_id, f.sentence, f.part) AND x.begin >= f."end" AND x."end" <= s.begin) ELSE h.hit[2] <= s.begin AND s.first - h.hit[4] = 1 END GROUP BY ALL),
f{k} AS (SELECT s.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM f{k}0 h WHERE h.doc_id = s.doc_id AND h.hit = [s.begin, s."end", s.no]) THEN 'FINAL' ELSE s.tag END AS tag) FROM {source} s)"""


def _promoted(asserted: str, rules) -> str:
    one, two = rules
    return f"{asserted}, u AS (SELECT * FROM a WHERE assertion = 'present'), {_adjacent(0, 'u', *one)}, {_adjacent(1, 'n0', *two)}, {_distant(0, 'n1', *one)}, {_distant(1, 'f0', *two)}, o AS (SELECT * FROM f1 WHERE tag = 'FINAL')"


_TOKENS, _RARE_TOKENS = _tokens(SPEC), _tokens(RARE)
_PROMOTED = _promoted(_asserted(_TOKENS), SPEC.rules)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f'WITH {_TOKENS} SELECT doc_id, sentence, part::BIGINT AS part, kind, first, last, begin, "end", tag, no, letters AND tag = \'pseNegPhrases\' AS letters FROM m')
def dictionary_matches(spark, sf_dir):
    """Places of all terms (by stem) and cues, with sentences and offsets."""
    return X.marks(_docs(spark, sf_dir), SPEC).select("doc_id", "sentence", "part", "kind", "first", "last", "begin", "end", "tag", "no", (F.col("letters") & (F.col("tag") == X.PSEUDO)).alias("letters"))


@query(f'WITH {_asserted(_RARE_TOKENS)} SELECT doc_id, begin, "end", tag, no, assertion, coalesce(cue, \'\') AS cue FROM a')
def entity_assertions(spark, sf_dir):
    return X.assertions(X.marks(_docs(spark, sf_dir), RARE), RARE).select("doc_id", "begin", "end", "tag", "no", "assertion", F.coalesce("cue", F.lit("")).alias("cue"))


@query(f'WITH {_PROMOTED} SELECT doc_id, begin, "end", no, phrase FROM o')
def promoted_entities(spark, sf_dir):
    return X.promoted(X.assertions(X.marks(_docs(spark, sf_dir), SPEC), SPEC), SPEC).select("doc_id", "begin", "end", "no", "phrase")


@query(f"WITH {_PROMOTED}, n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n_entities, (coalesce(n, 0) > 0)::INT AS label FROM documents LEFT JOIN n USING (doc_id)")
def document_predictions(spark, sf_dir):
    """All stages: one prediction per document."""
    return X.extract(_docs(spark, sf_dir), SPEC)[1].withColumn("label", F.col("label").cast("int"))


#: A specification of full size as its files have it: 23 terms, matched by English stems, and 240 cues made by a rule.
TERMS = {
    "OBJECT": ("hazy opacity", "opacity", "edema", "interstitial edema", "consolidation", "volume loss", "pneumonia", "atelectasis", "infiltrate", "disease", "loss"),
    "SIDE": ("bilateral", "both lungs", "lung", "diffuse", "multifocal", "bibasilar", "right lower", "left lung", "lower", "interstitial"),
    "FINAL": ("multifocal pneumonia", "bilateral infiltrate"),
}
CUES = {
    X.NEGATION: (("no", "not", "nothing", "cannot", "without", "never"), ("", "evidence", "sign", "of", "exclude", "bilateral", "any", "new", "more", "definite")),
    X.AFTER: (("have", "has", "are", "is", "was", "were"), ("cleared", "resolved", "excluded", "absent", "gone", "unlikely", "improved", "normal", "clear", "negative")),
    X.PSEUDO: (("no", "not", "cannot", "never", "without", "nothing"), ("only", "further", "change", "increase", "exclude disease", "certain", "cause", "doubt", "longer", "matter")),
    X.CONJUNCTION: (("but", "though", "however", "while", "except", "yet"), ("", "there", "the", "with", "both", "left", "right", "now", "still", "also")),
}
RULES = (("SIDE", "OBJECT"), ("OBJECT", "SIDE"))
# What the stemmer makes of the forms of the terms' words in these texts.
STEMS = {
    "hazy": "hazi", "opacity": "opac", "opacities": "opac", "edema": "edema", "interstitial": "interstiti", "consolidation": "consolid", "volume": "volum", "loss": "loss", "pneumonia": "pneumonia", "atelectasis": "atelectasi",
    "infiltrate": "infiltr", "infiltrates": "infiltr", "disease": "diseas", "bilateral": "bilater", "both": "both", "lungs": "lung", "lung": "lung", "diffuse": "diffus", "multifocal": "multifoc", "bibasilar": "bibasilar", "right": "right", "lower": "lower", "left": "left",
}


def _cue_lines() -> list[tuple[str, str]]:
    return [(f"{a} {b}".strip(), category) for category, (first, second) in CUES.items() for a in first for b in second]


def spec_from_files(spark) -> X.Spec:
    """The specification written to files in the shared folder, and read from them."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")).rstrip("/") + "/labelmill-spec"
    dictionary = {"terms": [{"term": t, "tag": tag} for tag, terms in TERMS.items() for t in terms], "rules": RULES, "final": "FINAL", "longest_sentence": 60, "excluded": ["loss"]}
    files = {"dictionary.json": json.dumps(dictionary), "cues.txt": "\n".join("\t".join(x) for x in _cue_lines()), "rules.conf": "DELIMETER=" + "DEL".join(".,;:!?()") + "\nSTRING_NO_SPLIT=x", "abbreviations.txt": "Dr.\nst.\nre."}
    for name, content in files.items():
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return extraction_spec(spark, *(f"{folder}/{name}" for name in files), stem=stemming.stem)


_FULL = X.Spec(
    terms=tuple((t, tag) for tag, terms in TERMS.items() for t in terms), cues=tuple(_cue_lines()), rules=RULES, longest_sentence=60, excluded=frozenset({"loss"}), abbreviations=frozenset({"Dr.", "st.", "re."}), stem=lambda w: STEMS.get(w.lower(), w.lower())
)
_STEMMED = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in STEMS.items()) + "}[form], form)"
_FULL_TOKENS = _tokens(_FULL, "(SELECT study AS doc_id, report_text AS text FROM reports)", _STEMMED, REPORTS + ", ")


def _report_texts(spark, sf_dir):
    return reports(spark, sf_dir).select(F.col("study").alias("doc_id"), F.col("report_text").alias("text"))


@query(f"WITH {_asserted(_FULL_TOKENS)} SELECT doc_id, begin, \"end\", tag, no, phrase, assertion, coalesce(cue, '') AS cue FROM a")
def report_assertions(spark, sf_dir):
    """Entities of reports by a specification of full size, read from its files and matched by stems."""
    spec = spec_from_files(spark)
    found = X.assertions(X.marks(_report_texts(spark, sf_dir), spec, True), spec)
    return found.select("doc_id", "begin", "end", "tag", "no", "phrase", "assertion", F.coalesce("cue", F.lit("")).alias("cue"))


@query(f"WITH {_promoted(_asserted(_FULL_TOKENS), RULES)}, n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1) SELECT study AS doc_id, coalesce(n, 0) AS n_entities, (coalesce(n, 0) > 0)::INT AS label FROM reports LEFT JOIN n ON n.doc_id = study")
def report_predictions(spark, sf_dir):
    """One prediction per report by the same specification; raises if a report's number repeats."""
    _, per_report, again = X.extract(_report_texts(spark, sf_dir), spec_from_files(spark))
    V.require(again)
    return per_report.withColumn("label", F.col("label").cast("int"))


@query(f"""WITH {_RARE_TOKENS}, e AS (SELECT * FROM m WHERE kind = 't'), b AS (SELECT doc_id, list(DISTINCT [begin, "end", no]) AS l FROM e WHERE NOT (doc_id % 10 = 0 AND no = 3) GROUP BY 1), w AS (SELECT doc_id, list(DISTINCT [begin, "end", no]) AS l FROM e GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (len(w.l) = len(b.l)) AS exact FROM w LEFT JOIN b USING (doc_id)""")
def stage_agreement(spark, sf_dir):
    """The matching stage run by two specifications, of which one lacks a term in every tenth document."""
    docs, spec = _docs(spark, sf_dir), replace(RARE, cues=())  # terms are compared, whose places do not depend on cues
    lacking = replace(spec, excluded=spec.excluded | {spec.terms[3][0]})
    other = X.marks(docs.where("pmod(doc_id, 10) <> 0"), spec).unionByName(X.marks(docs.where("pmod(doc_id, 10) = 0"), lacking))
    return X.stage_agreement(X.marks(docs, spec), other, ["begin", "end", "no"])
