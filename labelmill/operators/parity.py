"""Comparing two runs of an extractor, and auditing a set of outputs against what was expected.

Entities: doc_id, start, end, entity_sha256, semantic_tag, assertion, cui, in order of ``position`` within a document. Mismatch
tables carry hashes, never texts.
"""

from __future__ import annotations

import functools
import operator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .validation import failed

FIELDS = ["start", "end", "entity_sha256", "semantic_tag", "assertion", "cui"]
ENTITY_MISMATCH = "mismatch string, doc_id string, start bigint, end bigint, occurrence bigint, n bigint, entity_sha256 string, expected_hash string, actual_hash string"
DOCUMENT_MISMATCH = "mismatch string, doc_id string, field string, expected string, actual string"
ORDER_MISMATCH = "mismatch string, doc_id string, position bigint, expected_hash string, actual_hash string"
# What a parse status says about a document.
PARSE_STATUS = {"parsed": "evaluable", "parsed_empty": "evaluable", "missing_output": "non_evaluable", "duplicate_output": "non_evaluable", "parse_error": "non_evaluable"}


def digest(fields: list[str] = FIELDS, *more: str) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in (*fields, *more)))), 256)


def numbered(e: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Entities with their occurrence among equal ones and their hash, and their place in the document's order."""
    same = Window.partitionBy("doc_id", *fields).orderBy("position")
    return e.withColumn("occurrence", F.row_number().over(same) - 1).withColumn("hash", digest(fields)).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")))


def status_of(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions with one status, evaluable or non_evaluable, from prediction_status, parse_status or both; failed checks."""
    clean = lambda c: F.lower(X.ws_trim(F.col(c)))
    mapped = F.create_map(*(F.lit(x) for kv in PARSE_STATUS.items() for x in kv))
    said = [c for c in ("prediction_status", "parse_status") if c in p.columns]
    if not said:
        raise ValueError("predictions need prediction_status or parse_status")
    of = {"prediction_status": F.when(clean("prediction_status").isin("evaluable", "non_evaluable"), clean("prediction_status"))} if "prediction_status" in said else {}
    of |= {"parse_status": F.try_element_at(mapped, clean("parse_status"))} if "parse_status" in said else {}
    conflict = F.lit(False) if len(of) < 2 else F.coalesce(of["prediction_status"] != of["parse_status"], F.lit(False))
    rows = p.withColumn("status", F.coalesce(*of.values()))
    return rows, failed(p, {f"{c}_known": v.isNull() for c, v in of.items()} | {"status_conflict": conflict})


def input_checks(entities: DataFrame, predictions: DataFrame, tag: str) -> DataFrame:
    """Failed checks of one side: ids, unique documents, orphans, and that status, label and count agree with the entities.

    predictions: doc_id, status, label, n_entities. Evaluable documents have as many entities of the tag as they say, and
    label 1 if any; others have none and neither label nor count.
    """
    n = entities.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.lower("semantic_tag") == tag.lower()).alias("tagged"))
    j = predictions.withColumn("there", F.lit(True)).join(n, "doc_id", "full").fillna(0, ["rows", "tagged"])
    there, ok = F.coalesce("there", F.lit(False)), F.coalesce(F.col("status") == "evaluable", F.lit(False))
    label, count = F.col("label"), F.col("n_entities")
    return failed(j, {
        "doc_id_present": X.blank_to_null(F.col("doc_id")).isNull(),
        "entities_without_prediction": ~there,
        "label_range": label.isNotNull() & ~label.isin(0, 1),
        "count_range": F.coalesce(count < 0, F.lit(False)),
        "count_agrees": there & ok & ~count.eqNullSafe(F.col("tagged")),
        "label_agrees": there & ok & ~label.eqNullSafe((F.col("tagged") > 0).cast("int")),
        "non_evaluable_is_empty": there & ~ok & ((F.col("rows") > 0) | label.isNotNull() | count.isNotNull()),
    }, {"duplicate_documents": ["doc_id"]})


def document_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Documents that one side lacks, and differing status, label or count. Both: doc_id, status, label, n_entities."""
    b = {c: f"_a_{c}" for c in ("status", "label", "n_entities")}
    j = expected.select("doc_id", *b).withColumn("_e", F.lit(True)).join(actual.select("doc_id", *(F.col(c).alias(o) for c, o in b.items())).withColumn("_a", F.lit(True)), "doc_id", "full")
    both = F.col("_e").isNotNull() & F.col("_a").isNotNull()
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    row = lambda when, kind, field, e, a: F.when(when, F.struct(F.lit(kind).alias("mismatch"), F.lit(field).alias("field"), e.alias("expected"), a.alias("actual")))
    found = [row(F.col("_a").isNull(), "missing_document", "document", F.lit("present"), F.lit("missing")), row(F.col("_e").isNull(), "unexpected_document", "document", F.lit("missing"), F.lit("present"))]
    found += [row(both & ~F.col(c).eqNullSafe(F.col(o)), f"document_{k}_mismatch", c, shown(c), shown(o)) for k, (c, o) in zip(("status", "label", "count"), b.items(), strict=True)]
    return j.select("doc_id", F.inline(F.array_compact(F.array(*found)))).select("mismatch", "doc_id", "field", "expected", "actual")


def entity_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing and unexpected entities, differing multiplicities, and fields that differ at one place. Both: numbered."""
    key = ["doc_id", *FIELDS]
    j = _counts(expected, actual, key)
    none = lambda t: F.lit(None).cast(t)
    entity = lambda kind, n: F.struct(F.lit(kind).alias("mismatch"), F.col("start"), F.col("end"), none("bigint").alias("occurrence"), n.cast("bigint").alias("n"), F.col("entity_sha256"), none("string").alias("expected_hash"), none("string").alias("actual_hash"))
    sides = F.array_compact(F.array(F.when(F.col("e") > F.col("a"), entity("missing_entity", F.col("e") - F.col("a"))), F.when(F.col("a") > F.col("e"), entity("unexpected_entity", F.col("a") - F.col("e")))))
    out = j.select("doc_id", F.inline(sides))
    many = j.where("e > 0 and a > 0 and e <> a").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("multiplicity_mismatch").alias("mismatch"), *(none("bigint").alias(c) for c in ("start", "end", "occurrence")), "n", *(none("string").alias(c) for c in ("entity_sha256", "expected_hash", "actual_hash")))
    spot = Window.partitionBy("doc_id", "start", "end").orderBy("hash", "occurrence")
    at = lambda df, name: df.withColumn("nth", F.row_number().over(spot) - 1).select("doc_id", "start", "end", "nth", F.col("hash").alias(name))
    fields = at(expected, "expected_hash").join(at(actual, "actual_hash"), ["doc_id", "start", "end", "nth"]).where("expected_hash <> actual_hash")
    fields = fields.select("doc_id", F.lit("field_mismatch").alias("mismatch"), "start", "end", F.col("nth").cast("bigint").alias("occurrence"), none("bigint").alias("n"), none("string").alias("entity_sha256"), "expected_hash", "actual_hash")
    return out.unionByName(many).unionByName(fields).select("mismatch", "doc_id", "start", "end", "occurrence", "n", "entity_sha256", "expected_hash", "actual_hash")


def _counts(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """How often each entity is on either side."""
    rows = expected.select(*key, "hash", F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(*key, "hash", F.lit(0).alias("e"), F.lit(1).alias("a")))
    return rows.groupBy(*key, "hash").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))


def order_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Places at which documents of the same entities list different ones. Both: numbered."""
    same = _counts(expected, actual, ["doc_id", *FIELDS]).groupBy("doc_id").agg(F.bool_and(F.col("e") == F.col("a")).alias("same")).where("same").select("doc_id")
    at = lambda df, name: df.select("doc_id", "place", F.sha2(F.concat_ws("|", "hash", F.col("occurrence").cast("string")), 256).alias(name))
    j = at(expected, "expected_hash").join(at(actual, "actual_hash"), ["doc_id", "place"]).where("expected_hash <> actual_hash").join(same, "doc_id", "left_semi")
    return j.select(F.lit("order_mismatch").alias("mismatch"), "doc_id", (F.col("place") - 1).cast("bigint").alias("position"), "expected_hash", "actual_hash")


def compared(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """doc_id of both sides with same_entities (the same multiset) and same_rows (also in the same positions).

    Per document hashes of entities, whatever their order (who_) and with their positions (where_), are added up for one
    side and taken off for the other: all sums are 0 if both are the same. Only sums leave a task, never entities.
    """
    side = lambda e, sign: e.select("doc_id", *FIELDS, "position", F.lit(sign).cast("bigint").alias("_sign"))
    sums = {"who": [F.sum("_sign")], "where": []}
    for name, columns in (("who", FIELDS), ("where", [*FIELDS, "position"])):
        for k in range(2):
            h = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns), F.lit(k))
            sums[name] += [F.sum(part * F.col("_sign")) for part in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    none = lambda *kinds: functools.reduce(operator.and_, (c == 0 for kind in kinds for c in sums[kind]))
    rows = side(expected, 1).unionByName(side(actual, -1))
    return rows.groupBy("doc_id").agg(none("who").alias("same_entities"), none("who", "where").alias("same_rows"))


def differing(expected: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' entities, numbered, of documents that are not the same in both: all others need no look. They are kept
    on the executors' disks, compressed, as every kind of mismatch reads them."""
    docs = compared(expected, actual).where("not same_rows").select("doc_id").persist(StorageLevel.DISK_ONLY)
    of = lambda side: numbered(side.join(docs, "doc_id", "left_semi")).persist(StorageLevel.DISK_ONLY)
    return of(expected), of(actual)


def parity(expected: tuple[DataFrame, DataFrame], actual: tuple[DataFrame, DataFrame], require_order: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entity, document and order mismatches, and one summary row. Each side: entities, predictions with status."""
    (ee, ep), (ae, ap) = expected, actual
    both = ep.select("doc_id").join(ap.select("doc_id"), "doc_id")
    ne, na = differing(ee.join(both, "doc_id", "left_semi"), ae.join(both, "doc_id", "left_semi"))
    entities, documents, orders = entity_mismatches(ne, na), document_mismatches(ep, ap), order_mismatches(ne, na)
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("mismatch") == kind, F.col("n"))), F.lit(0)).alias(kind)
    kinds = ("missing_entity", "unexpected_entity", "multiplicity_mismatch", "field_mismatch", "missing_document", "unexpected_document", "document_status_mismatch", "document_label_mismatch", "document_count_mismatch")
    every = entities.select("mismatch", F.coalesce("n", F.lit(1)).alias("n")).unionByName(documents.select("mismatch", F.lit(1).cast("bigint").alias("n"))).unionByName(orders.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit("order_positions").alias("mismatch"), "n")).unionByName(orders.select("doc_id").distinct().select(F.lit("order_documents").alias("mismatch"), F.lit(1).cast("bigint").alias("n")))
    summary = every.agg(*(n(k) for k in (*kinds, "order_positions", "order_documents")))
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])) + (F.col("order_documents") if require_order else F.lit(0))
    return entities, documents, orders, summary.withColumn("passed", total == 0)


def parity_complete(summary: DataFrame, expected_documents: int, documents: DataFrame) -> DataFrame:
    """Failed checks before a run's predictions are used: the comparison passed, in order, for all expected documents."""
    n = documents.agg(F.countDistinct("doc_id").alias("documents"))
    return failed(summary.join(F.broadcast(n)), {"passed": ~F.col("passed"), "order": F.col("order_documents") > 0, "document_count": F.col("documents") != expected_documents})  # one row each


def exact_repeat(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per document of two runs: whether entities are the same multiset, and whether their order differs. Only documents
    whose positions differ are numbered."""
    moved = order_mismatches(*differing(first, second)).select("doc_id").distinct().withColumn("order_differs", F.lit(True))
    return compared(first, second).select("doc_id", "same_entities").join(moved, "doc_id", "left").fillna(False, ["order_differs"])


def uncovered(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities whose text is not what their document has at their UTF-16 offsets. entities: doc_id, start, end, entity_text."""
    j = entities.join(docs.select("doc_id", "text"), "doc_id", "left")
    covered = X.covered_text(F.col("text"), X.code_point_offset(F.col("text"), F.col("start")), X.code_point_offset(F.col("text"), F.col("end")))
    return j.withColumn("covered", covered).where(~F.col("covered").eqNullSafe(F.col("entity_text"))).drop("text")


def output_audit(manifest: DataFrame, files: DataFrame, entities: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """One row per expected document: whether an output is there, how it was read, entities and label; and unexpected files.

    manifest: doc_id; files: doc_id, file, status, reason (one row per file). Label is null where the output can't be judged.
    """
    per = files.groupBy("doc_id").agg(F.count("*").alias("n_files"), F.min("file").alias("file"), F.min("status").alias("one_status"), F.min("reason").alias("one_reason"))
    n = entities.groupBy("doc_id").agg(F.count("*").alias("entity_count"), F.count_if(F.upper("semantic_tag") == tag.upper()).alias("final_count"))
    j = manifest.select("doc_id").join(per, "doc_id", "left").join(n, "doc_id", "left").fillna(0, ["n_files", "entity_count", "final_count"])
    status = F.when(F.col("n_files") == 0, "missing_output").when(F.col("n_files") > 1, "duplicate_output").otherwise(F.col("one_status"))
    ok = status.isin("parsed", "parsed_empty")
    rows = j.select("doc_id", F.coalesce("file", F.lit("")).alias("file"), (F.col("n_files") > 0).alias("exists"), status.alias("parse_status"), F.when(F.col("n_files") > 1, "multiple_output_files").otherwise(F.coalesce("one_reason", F.lit(""))).alias("reason"), F.when(ok, F.col("entity_count")).otherwise(0).alias("entity_count"), F.when(ok, F.col("final_count")).otherwise(0).alias("final_count"), F.when(ok, (F.col("final_count") > 0).cast("int")).alias("label"), "n_files")
    return rows, files.join(manifest.select("doc_id"), "doc_id", "left_anti")


def audit_summary(audit: DataFrame, unexpected: DataFrame) -> DataFrame:
    """One row over an audit: counts, the documents with several outputs and those outputs, examples, and warnings.

    unexpected: doc_id and file of outputs of documents that were not expected; several of one document count as repeated.
    """
    extra = unexpected.groupBy("doc_id").agg(F.count("*").alias("n_files"))
    again = audit.where("n_files > 1").select("doc_id", "n_files").unionByName(extra.where("n_files > 1"))
    g = audit.agg(
        F.count("*").alias("expected"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("matched_files"), F.count_if("exists").alias("matched"), F.count_if(~F.col("exists")).alias("missing"),
        F.count_if(F.col("parse_status").isin("parsed", "parsed_empty")).alias("parsed"), F.count_if(F.col("parse_status").isin("parse_error", "duplicate_output")).alias("failed"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"),
    )
    one = lambda df, c, name: df.select(F.col(c).alias("v")).orderBy("v").limit(20).agg(F.array_sort(F.collect_list("v")).alias(name))
    for row in (unexpected.agg(F.count("*").alias("unexpected")), again.agg(F.count("*").alias("repeated"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("repeated_files")), one(unexpected, "file", "unexpected_examples"), one(again, "doc_id", "repeated_examples")):
        g = g.join(F.broadcast(row))  # one row each
    judged = F.col("positive") + F.col("negative")
    # The warnings.
    warnings = {
        "some_input_files_have_no_clamp_output": F.col("missing") > 0,
        "unexpected_output_files_without_manifest_rows": F.col("unexpected") > 0,
        "duplicate_output_files_for_doc_ids": F.col("repeated") > 0,
        "all_evaluable_predictions_have_one_class": (judged > 0) & ((F.col("positive") == 0) | (F.col("negative") == 0)),
    }
    return g.withColumns({"observed": F.col("matched_files") + F.col("unexpected"), "evaluable": judged, "non_evaluable": F.col("expected") - judged, "warnings": F.array_compact(F.array(*(F.when(c, name) for name, c in warnings.items())))}).drop("matched_files")


def frequencies(entities: DataFrame, *columns: str) -> DataFrame:
    """How often each value of each column comes: column, value, n."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))
    return entities.select(F.inline(each)).groupBy("column", "value").agg(F.count("*").alias("n"))


def export_manifest(docs: DataFrame, template: str, parts: list[str], text: str = "text") -> DataFrame:
    """Per row of docs: its safe id, lengths with flags, and whether it can be exported or why not.

    A row without a text, or whose id cannot name a file, is skipped; so are all rows that share an id.
    """
    lengths = X.text_lengths(F.col(text))
    there = F.coalesce(F.col(text) != "", F.lit(False))
    d = docs.withColumn("safe_id", F.when(there, X.rendered_id(template, **{p: F.col(p) for p in parts})))
    d = d.withColumn("reason", F.when(~there, "missing_text").otherwise(F.concat(F.lit("unsafe_doc_id:"), X.unsafe_id_reason(F.col("safe_id")))))
    again = d.where("reason is null").groupBy("safe_id").agg((F.count("*") > 1).alias("again"))
    d = d.join(again, "safe_id", "left").withColumn("reason", F.when(F.col("again"), "duplicate_doc_id").otherwise(F.col("reason"))).drop("again")
    good = F.col("reason").isNull()
    return d.withColumns({k: F.when(good, c) for k, c in lengths.items()} | {"export_status": F.when(good, "candidate").otherwise("skipped"), "reason": F.coalesce("reason", F.lit(""))}).drop(text)


def manifest_summary(m: DataFrame) -> DataFrame:
    """One row over an export manifest: rows by status and reason, over-length texts and maxima."""
    why = lambda r: F.count_if(F.col("reason") == r)
    top = lambda c: F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(f"most_{c}")
    return m.agg(F.count("*").alias("rows"), F.count_if(F.col("export_status") != "skipped").alias("exported"), F.count_if(F.col("export_status") == "skipped").alias("skipped"), why("missing_text").alias("missing_text"), why("duplicate_doc_id").alias("duplicate_doc_id"), F.count_if(F.col("reason").startswith("unsafe_doc_id:")).alias("unsafe_doc_id"), F.count_if("too_many_characters").alias("too_many_characters"), F.count_if("too_long_run").alias("too_long_run"), top("n_characters"), top("n_words"), top("longest_run"))
