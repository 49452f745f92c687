"""Queries that compare two runs of an extractor, of which the second has planted differences, and audit output sets."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..operators import parity as P
from .registry import query
from .tables import table

_K = lambda n, v, c="l_linenumber": F.pmod(c, F.lit(n)) == v
SIDES = """a AS (SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber * 10 AS start, l_linenumber * 10 + 5 AS "end", sha256(l_returnflag) AS es, CASE WHEN l_linestatus = 'O' THEN 'FINAL' ELSE 'SIDE' END AS tag, 'present' AS assertion, NULL::VARCHAR AS cui, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS position, l_orderkey AS k FROM lineitem),
b AS (SELECT doc_id, start, "end", CASE WHEN k % 13 = 1 AND position = 2 THEN 'x' ELSE es END AS es, CASE WHEN k % 17 = 3 THEN 'FINAL' ELSE tag END AS tag, assertion, cui, CASE WHEN k % 19 = 5 THEN -position ELSE position END AS position, k FROM a WHERE NOT (k % 11 = 4 AND position = 1) AND k % 101 <> 7 UNION ALL SELECT doc_id, start, "end", es, tag, assertion, cui, position + 100, k FROM a WHERE k % 23 = 6 AND position = 1 AND k % 101 <> 7),
pa AS (SELECT doc_id, k, 'evaluable' AS status, count(*) FILTER (tag = 'FINAL') AS n FROM a GROUP BY ALL), pb AS (SELECT doc_id, k, CASE WHEN k % 29 = 8 THEN 'non_evaluable' ELSE 'evaluable' END AS status, count(*) FILTER (tag = 'FINAL') AS n FROM b GROUP BY ALL),
f AS (SELECT a.* FROM a WHERE doc_id IN (SELECT doc_id FROM pb)), g AS (SELECT b.* FROM b WHERE doc_id IN (SELECT doc_id FROM pa)),
c AS (SELECT doc_id, start, "end", es, tag, assertion, cui, sum(x) AS x, sum(y) AS y FROM (SELECT *, 1 AS x, 0 AS y FROM f UNION ALL SELECT *, 0, 1 FROM g) GROUP BY ALL)"""


FIELDS_DIFFER = """fh AS (SELECT *, sha256('{"start":"' || start || '","end":"' || "end" || '","entity_sha256":"' || es || '","semantic_tag":"' || tag || '","assertion":"' || assertion || '","cui":"\\u0000"}') AS h, row_number() OVER (PARTITION BY doc_id, start, "end", es, tag ORDER BY position) AS occ FROM f), gh AS (SELECT *, sha256('{"start":"' || start || '","end":"' || "end" || '","entity_sha256":"' || es || '","semantic_tag":"' || tag || '","assertion":"' || assertion || '","cui":"\\u0000"}') AS h, row_number() OVER (PARTITION BY doc_id, start, "end", es, tag ORDER BY position) AS occ FROM g),
fm AS (SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY h, occ) AS nth FROM fh) x JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY h, occ) AS nth FROM gh) y USING (doc_id, start, "end", nth) WHERE x.h <> y.h)"""
ORDERED = """fp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS place FROM f), gp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS place FROM g), s AS (SELECT doc_id FROM c GROUP BY 1 HAVING bool_and(x = y)),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, start, "end", es, tag ORDER BY place) AS occ, * EXCLUDE (doc_id) FROM fp), q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, start, "end", es, tag ORDER BY place) AS occ, * EXCLUDE (doc_id) FROM gp),
om AS (SELECT o.doc_id, (o.place - 1)::BIGINT AS position FROM o JOIN q USING (doc_id, place) WHERE doc_id IN (SELECT doc_id FROM s) AND (o.start, o."end", o.es, o.tag, o.occ) IS DISTINCT FROM (q.start, q."end", q.es, q.tag, q.occ))"""


def _runs(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    l = table(spark, sf_dir, "lineitem").withColumn("position", F.row_number().over(w))  # noqa: E741
    l = l.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "position").persist(StorageLevel.DISK_ONLY)  # noqa: E741  all parts of both runs read it
    a = l.select(F.col("l_orderkey").cast("string").alias("doc_id"), (F.col("l_linenumber") * 10).cast("bigint").alias("start"), (F.col("l_linenumber") * 10 + 5).cast("bigint").alias("end"), F.sha2("l_returnflag", 256).alias("entity_sha256"), F.when(F.col("l_linestatus") == "O", "FINAL").otherwise("SIDE").alias("semantic_tag"), F.lit("present").alias("assertion"), F.lit(None).cast("string").alias("cui"), "position", F.col("l_orderkey").alias("k"))
    k = lambda n, v: _K(n, v, "k")
    there = a.where(~k(101, 7))
    kept = F.when(~(k(11, 4) & (F.col("position") == 1)), F.struct(F.when(k(13, 1) & (F.col("position") == 2), "x").otherwise(F.col("entity_sha256")).alias("entity_sha256"), F.when(k(17, 3), "FINAL").otherwise(F.col("semantic_tag")).alias("semantic_tag"), F.when(k(19, 5), -F.col("position")).otherwise(F.col("position")).alias("position")))
    more = F.when(k(23, 6) & (F.col("position") == 1), F.struct("entity_sha256", "semantic_tag", (F.col("position") + 100).alias("position")))
    b = there.select("doc_id", "start", "end", "assertion", "cui", "k", F.inline(F.array_compact(F.array(kept, more)))).select(a.columns)
    of = lambda df, status: df.groupBy("doc_id", "k").agg(F.count_if(F.col("semantic_tag") == "FINAL").alias("n_entities")).withColumns({"status": status, "label": (F.col("n_entities") > 0).cast("int")}).select("doc_id", "status", "label", "n_entities")
    return (a.drop("k"), of(a, F.lit("evaluable"))), (b.drop("k"), of(b, F.when(k(29, 8), "non_evaluable").otherwise("evaluable")))


@query(f"""WITH {SIDES} SELECT mismatch, doc_id, field, expected, actual FROM (
SELECT 'missing_document' AS mismatch, doc_id, 'document' AS field, 'present' AS expected, 'missing' AS actual FROM pa WHERE doc_id NOT IN (SELECT doc_id FROM pb)
UNION ALL SELECT 'document_status_mismatch', doc_id, 'status', pa.status, pb.status FROM pa JOIN pb USING (doc_id) WHERE pa.status <> pb.status
UNION ALL SELECT 'document_label_mismatch', doc_id, 'label', (pa.n > 0)::INT::VARCHAR, (pb.n > 0)::INT::VARCHAR FROM pa JOIN pb USING (doc_id) WHERE (pa.n > 0) <> (pb.n > 0)
UNION ALL SELECT 'document_count_mismatch', doc_id, 'n_entities', pa.n::VARCHAR, pb.n::VARCHAR FROM pa JOIN pb USING (doc_id) WHERE pa.n <> pb.n)""")
def document_parity(spark, sf_dir):
    (_, ep), (_, ap) = _runs(spark, sf_dir)
    return P.document_mismatches(ep, ap)


@query(f"""WITH {SIDES}, {FIELDS_DIFFER} SELECT mismatch, doc_id, coalesce(start, -1) AS start, sum(n)::BIGINT AS n FROM (SELECT 'missing_entity' AS mismatch, doc_id, start, x - y AS n FROM c WHERE x > y UNION ALL SELECT 'unexpected_entity', doc_id, start, y - x FROM c WHERE y > x UNION ALL SELECT 'multiplicity_mismatch', doc_id, NULL, count(*) FROM c WHERE x > 0 AND y > 0 AND x <> y GROUP BY doc_id UNION ALL SELECT 'field_mismatch', doc_id, start, 1 FROM fm) GROUP BY ALL""")
def entity_parity_ledger(spark, sf_dir):
    """Missing and unexpected entities with multiplicity, and places whose fields differ, of documents that are not equal."""
    (ee, ep), (ae, ap) = _runs(spark, sf_dir)
    both = ep.select("doc_id").join(ap.select("doc_id"), "doc_id")
    found = P.entity_mismatches(*P.differing(ee.join(both, "doc_id", "left_semi"), ae.join(both, "doc_id", "left_semi")))
    return found.groupBy("mismatch", "doc_id", F.coalesce("start", F.lit(-1)).alias("start")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))


@query(f"""WITH {SIDES}, {ORDERED} SELECT doc_id, position FROM om""")
def order_parity(spark, sf_dir):
    (ee, _), (ae, _) = _runs(spark, sf_dir)
    return P.order_mismatches(*P.differing(ee, ae)).select("doc_id", "position")


@query(f"""WITH {SIDES}, {FIELDS_DIFFER}, {ORDERED} SELECT (SELECT coalesce(sum(x - y), 0)::BIGINT FROM c WHERE x > y) AS missing_entity, (SELECT coalesce(sum(y - x), 0)::BIGINT FROM c WHERE y > x) AS unexpected_entity, (SELECT count(*) FROM c WHERE x > 0 AND y > 0 AND x <> y) AS multiplicity_mismatch, (SELECT count(*) FROM fm) AS field_mismatch, (SELECT count(*) FROM om) AS order_positions, (SELECT count(DISTINCT doc_id) FROM om) AS order_documents, (SELECT count(*) FROM pa WHERE doc_id NOT IN (SELECT doc_id FROM pb)) AS missing_document, (SELECT count(*) FROM pb WHERE doc_id NOT IN (SELECT doc_id FROM pa)) AS unexpected_document,
(SELECT count(*) FROM pa JOIN pb USING (doc_id) WHERE pa.status <> pb.status) AS document_status_mismatch, (SELECT count(*) FROM pa JOIN pb USING (doc_id) WHERE (pa.n > 0) <> (pb.n > 0)) AS document_label_mismatch, (SELECT count(*) FROM pa JOIN pb USING (doc_id) WHERE pa.n <> pb.n) AS document_count_mismatch, FALSE AS passed""")
def parity_summary(spark, sf_dir):
    return P.parity(*_runs(spark, sf_dir))[3]


@query(f"""WITH {SIDES}, r AS (SELECT doc_id, status, (n > 0)::INT AS label, CASE WHEN k % 31 = 2 THEN n + 1 WHEN k % 37 = 3 THEN NULL ELSE n END AS n, n AS t FROM pb WHERE k % 41 <> 9 UNION ALL SELECT doc_id, status, (n > 0)::INT, n, n FROM pb WHERE k % 43 = 5 AND k % 41 <> 9),
c1 AS (SELECT 'entities_without_prediction' AS "check", count(*) AS n_rows FROM pb WHERE k % 41 = 9 UNION ALL SELECT 'count_agrees', count(*) FROM r WHERE status = 'evaluable' AND n IS DISTINCT FROM t UNION ALL SELECT 'non_evaluable_is_empty', count(*) FROM r WHERE status <> 'evaluable' UNION ALL SELECT 'duplicate_documents', sum(m)::BIGINT FROM (SELECT count(*) AS m FROM r GROUP BY doc_id HAVING count(*) > 1)) SELECT "check", 'error' AS severity, n_rows FROM c1 WHERE n_rows > 0""")
def parity_input_checks(spark, sf_dir):
    _, (e, p) = _runs(spark, sf_dir)
    p = p.withColumn("k", F.col("doc_id").cast("bigint")).where(~_K(41, 9, "k"))
    bad = p.withColumn("n_entities", F.when(_K(31, 2, "k"), F.col("n_entities") + 1).when(~_K(37, 3, "k"), F.col("n_entities")))
    return P.input_checks(e, bad.unionByName(p.where(_K(43, 5, "k"))).drop("k"), "final")


@query(f"WITH {SIDES}, s AS (SELECT doc_id, bool_and(x = y) AS same_entities FROM (SELECT doc_id, start, \"end\", es, tag, sum(x) AS x, sum(y) AS y FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY ALL) GROUP BY 1) SELECT same_entities, count(*) AS n FROM s GROUP BY 1")
def exact_repeats(spark, sf_dir):
    (ee, _), (ae, _) = _runs(spark, sf_dir)
    return P.exact_repeat(ee, ae).groupBy("same_entities").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 2 AS start FROM documents WHERE length(text) > 12 AND doc_id % 6 = 1")
def uncovered_entities(spark, sf_dir):
    """Spans from the third to the ninth unit of each text, every sixth of which claims another text."""
    d = table(spark, sf_dir, "documents").where("length(text) > 12").select("doc_id", F.concat(F.lit("\U0001f642"), "text").alias("text"))
    e = d.select("doc_id", F.lit(2).alias("start"), F.lit(9).alias("end"), F.when(_K(6, 1, "doc_id"), F.lit("?")).otherwise(F.substring("text", 2, 7)).alias("entity_text"))
    return P.uncovered(e, d).select("doc_id", "start")


AUDIT = """m AS (SELECT DISTINCT l_orderkey::VARCHAR AS doc_id, l_orderkey AS k FROM lineitem WHERE l_orderkey % 10 <> 9), fl AS (SELECT DISTINCT l_orderkey::VARCHAR AS doc_id, l_orderkey AS k, l_orderkey::VARCHAR || '.tsv' AS file, CASE WHEN l_orderkey % 7 = 3 THEN 'parse_error' ELSE 'parsed' END AS status FROM lineitem WHERE l_orderkey % 8 <> 2 UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, l_orderkey, l_orderkey::VARCHAR || '.txt', 'parsed' FROM lineitem WHERE l_orderkey % 15 = 4),
en AS (SELECT l_orderkey::VARCHAR AS doc_id, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS f FROM lineitem GROUP BY 1), pf AS (SELECT doc_id, count(*) AS n_files, min(file) AS file, min(status) AS status FROM fl GROUP BY 1),
au AS (SELECT m.doc_id, coalesce(pf.file, '') AS file, pf.doc_id IS NOT NULL AS "exists", coalesce(n_files, 0) AS n_files, CASE WHEN n_files IS NULL THEN 'missing_output' WHEN n_files > 1 THEN 'duplicate_output' ELSE status END AS parse_status, coalesce(n_files = 1 AND status = 'parsed', FALSE) AS ok, en.n, en.f FROM m LEFT JOIN pf USING (doc_id) LEFT JOIN en USING (doc_id))"""


def _audit(spark, sf_dir):
    l, k = table(spark, sf_dir, "lineitem"), lambda n, v: _K(n, v, "l_orderkey")  # noqa: E741, E731
    name = F.col("l_orderkey").cast("string")
    keys = l.select("l_orderkey").distinct()
    files = keys.where(~k(8, 2)).select(name.alias("doc_id"), F.concat(name, F.lit(".tsv")).alias("file"), F.when(k(7, 3), "parse_error").otherwise("parsed").alias("status"), F.when(k(7, 3), "missing start").alias("reason"))
    files = files.unionByName(keys.where(k(15, 4)).select(name.alias("doc_id"), F.concat(name, F.lit(".txt")).alias("file"), F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("reason")))
    entities = l.select(name.alias("doc_id"), F.when(F.col("l_linestatus") == "O", "Final").otherwise("side").alias("semantic_tag"))
    return P.output_audit(keys.where(~k(10, 9)).select(name.alias("doc_id")), files, entities, "FINAL")


@query(f"WITH {AUDIT} SELECT doc_id, file, \"exists\", parse_status, CASE WHEN ok THEN n ELSE 0 END AS entity_count, CASE WHEN ok THEN f ELSE 0 END AS final_count, CASE WHEN ok THEN (f > 0)::INT ELSE -1 END AS label, n_files, CASE WHEN n_files > 1 THEN 'multiple_output_files' WHEN parse_status = 'parse_error' THEN 'missing start' ELSE '' END AS reason FROM au")
def output_audit(spark, sf_dir):
    return _audit(spark, sf_dir)[0].fillna(-1, ["label"])


@query(f"""WITH {AUDIT}, ux AS (SELECT * FROM fl WHERE doc_id NOT IN (SELECT doc_id FROM m)), u AS (SELECT count(*) AS n, array_to_string(list_sort(list(file))[1:20], '|') AS l FROM ux), d AS (SELECT doc_id, count(*) AS k FROM fl GROUP BY 1 HAVING count(*) > 1), dd AS (SELECT count(*) AS n, coalesce(sum(k), 0)::BIGINT AS k, array_to_string(list_sort(list(doc_id))[1:20], '|') AS l FROM d)
SELECT count(*) AS expected, count(*) FILTER ("exists") AS matched, count(*) FILTER (NOT "exists") AS missing, any_value(dd.n) AS repeated, any_value(dd.k) AS repeated_files, any_value(dd.l) AS repeated_examples, count(*) FILTER (ok) AS parsed, count(*) FILTER (parse_status IN ('parse_error', 'duplicate_output')) AS failed, count(*) FILTER (ok AND f > 0) AS positive, count(*) FILTER (ok AND f = 0) AS negative, any_value(u.n) AS unexpected, any_value(u.l) AS unexpected_examples, (sum(n_files) + any_value(u.n))::BIGINT AS observed, count(*) FILTER (ok) AS evaluable, count(*) FILTER (NOT ok) AS non_evaluable,
'some_input_files_have_no_clamp_output|unexpected_output_files_without_manifest_rows|duplicate_output_files_for_doc_ids' AS warnings FROM au, u, dd""")
def output_audit_summary(spark, sf_dir):
    lists = ("warnings", "unexpected_examples", "repeated_examples")
    return P.audit_summary(*_audit(spark, sf_dir)).withColumns({c: F.array_join(c, "|") for c in lists})


@query("SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def value_frequencies(spark, sf_dir):
    return P.frequencies(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


# Letters, marks, digits and connectors: what a word is made of where nothing else is said.
_WORD = r"'[\p{L}\p{M}\p{Nd}\p{Pc}]+'"
_MANIFEST = """v AS (SELECT doc_id, CASE WHEN doc_id % 20 = 3 THEN '' WHEN doc_id % 20 = 4 THEN NULL ELSE text END AS text, CASE doc_id % 9 WHEN 0 THEN '..' WHEN 1 THEN ' ' WHEN 2 THEN 'twin' ELSE 'd' || doc_id::VARCHAR END AS id FROM documents),
w AS (SELECT *, CASE WHEN coalesce(text, '') = '' THEN 'missing_text' WHEN trim(id) = '' THEN 'unsafe_doc_id:missing' WHEN id = '..' THEN 'unsafe_doc_id:trailing_dot' ELSE '' END AS r FROM v),
x AS (SELECT *, CASE WHEN r = '' AND id = 'twin' AND count(*) FILTER (r = '') OVER (PARTITION BY id) > 1 THEN 'duplicate_doc_id' ELSE r END AS reason FROM w)"""


def _manifest(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.pmod("doc_id", F.lit(9))
    d = d.select("doc_id", F.when(_K(20, 3, "doc_id"), "").when(~_K(20, 4, "doc_id"), F.col("text")).alias("text"), F.when(k == 0, "..").when(k == 1, " ").when(k == 2, "twin").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("id"))
    return P.export_manifest(d, "{id}", ["id"])


@query(f"WITH {_MANIFEST} SELECT doc_id, CASE WHEN reason = '' THEN 'candidate' ELSE 'skipped' END AS export_status, replace(reason, 'trailing_dot', 'dot_path_component') AS reason, CASE WHEN reason = '' THEN length(text) ELSE -1 END AS n_characters FROM x")
def export_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir).fillna(-1, ["n_characters"]).select("doc_id", "export_status", "reason", "n_characters")


@query(f"WITH {_MANIFEST} SELECT count(*) AS rows, count(*) FILTER (reason = '') AS exported, count(*) FILTER (reason <> '') AS skipped, count(*) FILTER (reason = 'missing_text') AS missing_text, count(*) FILTER (reason = 'duplicate_doc_id') AS duplicate_doc_id, count(*) FILTER (reason LIKE 'unsafe%') AS unsafe_doc_id, count(*) FILTER (reason = '' AND length(text) > 16000) AS too_many_characters, max(length(text)) FILTER (reason = '') AS most_n_characters, count(*) FILTER (reason = '' AND run > 500) AS too_long_run, max(words) FILTER (reason = '') AS most_n_words, max(run) FILTER (reason = '') AS most_longest_run FROM (SELECT *, len(regexp_extract_all(text, {_WORD})) AS words, list_max(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda y: len(regexp_extract_all(y, {_WORD})))) AS run FROM x)")
def export_manifest_summary(spark, sf_dir):
    return P.manifest_summary(_manifest(spark, sf_dir))
