"""Readers of report trees, label and rating files, nested entity JSON and extractor outputs.

All read with Spark's own formats, so paths may lie in any store that Spark knows.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, ws_trim
from ..operators.extraction import Spec
from ..operators.labels import example_values
from ..operators.validation import failed, values_differ
from .json_members import json_members


def normalised_names(df: DataFrame) -> DataFrame:
    """Column names in lower case, other signs than letters and digits as underscores."""
    return df.toDF(*(re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in df.columns))


def report_tree(spark: SparkSession, root: str, subject: str = r"/p(\d{8})/", study: str = r"s(\d{8})\.txt$") -> tuple[DataFrame, DataFrame]:
    """subject_id, study_id, report_text of all s*.txt below root, and failed checks: paths without ids, repeated studies, no files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "s*.txt").load(root)
    part = lambda p: F.nullif(F.regexp_extract("path", p, 1), F.lit("")).try_cast("bigint")
    rows = files.select(part(subject).alias("subject_id"), part(study).alias("study_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("report_text"))
    ids = files.select(part(subject).alias("subject_id"), part(study).alias("study_id"))  # the contents are not read for the checks
    none = ids.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("has_files").alias("check"), F.lit("error").alias("severity"), F.lit(0).cast("bigint").alias("n_rows"))
    checks = failed(ids, {"ids_in_path": F.col("subject_id").isNull() | F.col("study_id").isNull()}).unionByName(failed(ids.where("study_id is not null"), {}, {"study_repeats": ["study_id"]}))
    return rows, checks.unionByName(none)


def label_csv(spark: SparkSession, path: str, ids: list[str], labels: list[str]) -> DataFrame:
    """Label file with strict ids and lenient labels (null on bad input); only labels that are there are kept."""
    df = normalised_names(spark.read.csv(path, header=True))
    return df.select(*(F.col(c).cast("bigint").alias(c) for c in ids), *(F.col(c).try_cast("double").cast("int").alias(c) for c in labels if c in df.columns))


ENTITY = "struct<tokens:string,label:string,labels:string,start_ix:bigint,end_ix:bigint,relations:array<array<string>>>"


REPORT = f"struct<text:string,data_source:string,data_split:string,entities:map<string,{ENTITY}>>"


def graph_rows(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """report_key and r (a struct) of nested JSON: report key to text and entities.

    The files hold an object on each line, or (whole_file) one object each over any number of lines, of any size: blocks
    of it are read by tasks of their own and cut at the object's members (json_members). Tokens and labels may be strings or lists; malformed relations are skipped.
    """
    if whole_file:
        parsed = json_members(spark, path).select(F.parse_json("member").alias("v"))
        keys = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        rows = keys.select(F.col("key").alias("report_key"), F.from_json(F.to_json("value"), REPORT).alias("r"))
    else:
        raw = spark.read.text(path).where(F.trim("value") != "")
        rows = raw.select(F.explode(F.from_json("value", f"map<string,{REPORT}>")).alias("report_key", "r"))
    return rows


def _flat(c, sep: str):
    return F.when(c.startswith("["), F.array_join(F.from_json(c, "array<string>"), sep)).otherwise(c)


def graph_reports(rows: DataFrame) -> DataFrame:
    return rows.select("report_key", "r.text", "r.data_source", "r.data_split")


def graph_entities(rows: DataFrame) -> DataFrame:
    e = rows.select("report_key", F.explode("r.entities").alias("entity_id", "e"))
    return e.select("report_key", "entity_id", _flat(F.col("e.tokens"), " ").alias("tokens"), _flat(F.coalesce("e.label", "e.labels"), "|").alias("label"), "e.start_ix", "e.end_ix")


def graph_relations(rows: DataFrame) -> DataFrame:
    e = rows.select("report_key", F.explode("r.entities").alias("entity_id", "e"))
    pairs = e.select("report_key", F.col("entity_id").alias("source_id"), F.explode(F.filter("e.relations", lambda r: F.size(r) == 2)).alias("r"))
    return pairs.select("report_key", "source_id", F.get("r", F.lit(0)).alias("relation"), F.get("r", F.lit(1)).alias("target_id"))


#: What a parse of entity graphs is cut into; the cuts that writers.flattened takes.
GRAPH_TABLES = {"reports": graph_reports, "entities": graph_entities, "relations": graph_relations}


def entity_graphs(spark: SparkSession, path: str, whole_file: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports, entities and relations of nested JSON (graph_rows). Each is read on its own; to write all three from one
    parse, use writers.flattened with GRAPH_TABLES."""
    rows = graph_rows(spark, path, whole_file)
    return tuple(cut(rows) for cut in GRAPH_TABLES.values())


def documents(spark: SparkSession, path: str, fmt: str, id_column: str, text_column: str, id_prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """doc_id (with prefix) and text from csv, parquet or json lines, plain or gzip, and failed checks: blank and repeated ids.

    Gzip files can't be split, so rows of such are dealt anew.
    """
    df = spark.read.format(fmt).options(**({"header": "true", "multiLine": "true", "escape": '"'} if fmt == "csv" else {})).load(path)
    if absent := [c for c in (id_column, text_column) if c not in df.columns]:
        raise ValueError(f"missing columns: {absent}")
    rows = df.select(F.concat(F.lit(id_prefix), blank_to_null(F.col(id_column))).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if path.endswith(".gz"):
        rows = rows.repartition("doc_id")
    return rows, failed(rows, {"id_present": F.col("doc_id").isNull()}).unionByName(failed(rows.where("doc_id is not null"), {}, {"id_repeats": ["doc_id"]}))


def mapped_ids(entities: DataFrame, key: str = "report_key", pattern: str = r"s(\d{8})", most_unmapped: float = 0.01) -> DataFrame:
    """entities with study_id from their key; raises if too large a share has none."""
    rows = entities.withColumn("study_id", F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")).try_cast("bigint"))
    share = rows.agg(F.avg(F.col("study_id").isNull().cast("double"))).first()[0] or 0.0
    if share > most_unmapped:
        raise ValueError(f"{share:.2%} of rows have no study id")
    return rows


def rater_exports(spark: SparkSession, paths: dict[str, str], case: str, ratings: dict[str, str], completions: dict[str, str], ids: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A row per case and rater from one CSV for each rater, read as strings; and failed checks of each export.

    ratings and completions: task to column. The rater comes from the configuration, never from the file. ids: further
    identifiers to keep where they exist; all other columns, texts above all, are dropped. Columns must be there.
    """
    wanted = [case, *ratings.values(), *completions.values()]
    frames, checks = [], []
    for rater, path in paths.items():
        raw = spark.read.csv(path, header=True, inferSchema=False)
        if absent := [c for c in wanted if c not in raw.columns]:
            raise ValueError(f"export of {rater} is missing columns: {absent}")
        text = lambda c: blank_to_null(F.col(c))
        state = {t: text(c).try_cast("double") for t, c in completions.items()}
        value = {t: text(c).try_cast("double") for t, c in ratings.items()}
        rows = raw.select(text(case).alias("case_id"), F.lit(rater).alias("rater"), *((text(c) if c in raw.columns else F.lit(None).cast("string")).alias(k) for k, c in (ids or {}).items()), *(v.alias(f"{t}_rating") for t, v in value.items()), *(v.cast("int").alias(f"{t}_complete") for t, v in state.items()), *(text(c).isNotNull().alias(f"_{t}") for t, c in completions.items()), *((v % 1 == 0).alias(f"_{t}_whole") for t, v in state.items()))
        bad = {"case_id_present": F.col("case_id").isNull()}
        for t in ratings:
            done = F.coalesce(F.col(f"{t}_complete") == 2, F.lit(False))
            bad[f"{t}_completion"] = F.col(f"_{t}") & ~F.coalesce(F.col(f"{t}_complete").isin(0, 1, 2) & F.col(f"_{t}_whole"), F.lit(False))
            bad[f"{t}_rating"] = done & ~F.coalesce(F.col(f"{t}_rating").between(0, 100), F.lit(False))
        empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("has_rows").alias("check"), F.lit("error").alias("severity"), F.lit(0).cast("bigint").alias("n_rows"))
        checks.append(failed(rows, bad, {"case_repeats": ["case_id"]}).unionByName(empty).withColumn("rater", F.lit(rater)))
        frames.append(rows.drop(*(f"_{t}" for t in completions), *(f"_{t}_whole" for t in completions)))
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(frames), union(checks)


# The names, letters and digits only, under which extractors write a field.
FIELDS = {
    "start": "start begin offsetstart spanstart",
    "end": "end stop offsetend spanend",
    "semantic_tag": "semantic semantictag type tag",
    "assertion": "assertion assertionstatus certainty negation",
    "cui": "cui conceptid",
    "attribute": "attribute attributes feature features",
    "entity_text": "entity entitytext coveredtext text mention",
}
ALIASES = {alias: field for field, names in FIELDS.items() for alias in names.split()}


REQUIRED = ("start", "end", "semantic_tag", "assertion", "cui", "entity_text")


def complete_outputs(spark: SparkSession, path: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and status of a complete set of tab-separated outputs; raises, naming examples, if anything is wrong.

    Every document of the manifest (doc_id) must have one output and no other may. A file needs all fields, whole offsets
    with 0 <= start <= end, no more cells than its header, a tag and a text; its first bad row names the error. The word
    null stands for no value. A file without a byte is as good as absent: Spark does not read it.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.\w+$", 1), r"(?i)\.txt$", "").alias("doc_id"), F.split(F.regexp_replace(text, "^\ufeff|\r(?=\n)", ""), "\n").alias("lines"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    lookup = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    name = lambda h: F.coalesce(F.try_element_at(lookup, F.regexp_replace(F.lower(ws_trim(h)), r"(?U)[\W_]", "")), F.lit(""))
    head = F.get("lines", F.lit(0))
    files = files.withColumns({"header": F.when(ws_trim(head) != "", F.transform(F.split(head, "\t"), name)).otherwise(F.array().cast("array<string>")), "lines": F.slice("lines", 2, 1 << 30)})
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("header")))
    files = files.withColumn("fault", F.when(~F.col("valid"), "decode_error").when(F.size("header") == 0, "missing_header").when(F.size(lacking) > 0, F.concat(F.lit("missing_required_fields:"), F.array_join(lacking, ","))))
    rows = files.where("fault is null").select("doc_id", "header", F.posexplode("lines").alias("n", "line")).where("line <> ''").withColumn("cells", F.split("line", "\t", -1))
    cell = lambda k: blank_to_null(F.get("cells", F.array_position("header", k).cast("int") - 1))
    value = lambda k: F.when(F.lower(cell(k)) != "null", cell(k))
    whole = lambda k: F.when(cell(k).rlike(r"^[+-]?\d+$"), cell(k).try_cast("bigint"))
    rows = rows.select("doc_id", (F.col("n") + 2).alias("row"), (F.size("cells") > F.size("header")).alias("extra"), whole("start").alias("start"), whole("end").alias("end"), cell("semantic_tag").alias("semantic_tag"), value("assertion").alias("assertion"), value("cui").alias("cui"), F.when(F.array_contains("header", "attribute"), value("attribute")).alias("attribute"), cell("entity_text").alias("entity_text"))
    span = F.coalesce((F.col("start") >= 0) & (F.col("end") >= F.col("start")), F.lit(False))
    fault = F.when(F.col("extra"), "extra_fields").when(~span, "invalid_offsets").when(F.col("semantic_tag").isNull(), "blank_semantic_tag").when(F.col("entity_text").isNull(), "blank_entity_text")
    rows = rows.withColumn("fault", F.concat(fault, F.lit(":row_"), F.col("row").cast("string")))
    per = rows.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("row"))).alias("row_fault"))
    status = files.groupBy("doc_id").agg(F.count("*").alias("n_files"), F.min("fault").alias("fault")).join(per, "doc_id", "left").withColumn("expected", F.lit(False)).drop("expected")
    status = manifest.select("doc_id").withColumn("expected", F.lit(True)).join(status, "doc_id", "full")
    reason = F.when(F.col("expected").isNull(), "unexpected_output").when(F.col("n_files").isNull(), "missing_output").when(F.col("n_files") > 1, "several_outputs").otherwise(F.coalesce("fault", "row_fault"))
    status = status.select("doc_id", reason.alias("reason"), F.when(F.coalesce("n_entities", F.lit(0)) > 0, "parsed").otherwise("parsed_empty").alias("status"))
    bad = example_values(status.where("reason is not null").select(F.concat_ws(":", "doc_id", "reason").alias("found")), "found", 20).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} outputs are not as they must be: {bad['examples']}")
    return rows.drop("extra", "fault").withColumn("entity_sha256", F.sha2("entity_text", 256)), status.drop("reason")


# Suffixes of outputs that are read, and of those that can't be.
READ, UNREAD = ("csv", "tsv", "txt"), ("xmi", "xmi.gz", "xdi")
#: Cells of a row of an output at most; rows with more are malformed.
CELLS = 64


def extractor_outputs(spark: SparkSession, path: str, required: tuple[str, ...] = ("semantic_tag",)) -> tuple[DataFrame, DataFrame]:
    """Entities of many small outputs, and per file a status: parsed, parsed_empty or parse_error with a reason.

    .csv files are separated by commas, with quotes; .tsv files by tabs; of .txt files the header's more frequent one of
    tab, comma and semicolon counts. Other formats, and files without a known or a required field, are errors. Files in
    a folder Archive are left out; offsets that are no whole numbers are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").contains("/Archive/"))
    name_of = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name_of, r"(?i)\.(xmi\.gz|[^.]+)$", 1))
    text = F.regexp_replace(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n"), "^\ufeff", "")
    files = files.select(name_of.alias("file"), F.regexp_replace(name_of, r"(?i)\.(xmi\.gz|[^.]+)$", "").alias("doc_id"), suffix.alias("suffix"), text.alias("text")).where(F.col("suffix").isin(*READ, *UNREAD))
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    counts = [F.regexp_count(head, F.lit(s)) for s in ("\t", ",", ";")]
    sniffed = F.when((counts[0] >= counts[1]) & (counts[0] >= counts[2]), "\t").when(counts[1] >= counts[2], ",").otherwise(";")
    files = files.withColumn("separator", F.when(F.col("suffix") == "csv", ",").when(F.col("suffix") == "tsv", "\t").otherwise(sniffed))
    lookup = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    name = lambda h: F.coalesce(F.try_element_at(lookup, F.regexp_replace(F.lower(ws_trim(h)), r"(?U)[\W_]", "")), F.lit(""))
    schema = ", ".join(f"c{k} string" for k in range(CELLS))
    # Rows by separator, so that each is read with constant options; a quoted cell may hold separators and line breaks.
    cut = lambda s: F.transform(F.regexp_extract_all("text", F.lit(r'((?:"(?:[^"]|"")*"|[^"\n])+)'), F.lit(1)), lambda row: F.from_csv(row, schema, {"sep": s, "escape": '"', "mode": "PERMISSIVE"}))
    quoted = lambda s: F.transform(cut(s), lambda r: F.array(*(r[f"c{k}"] for k in range(CELLS))))
    plain = F.transform(F.filter(F.split("text", "\n"), lambda x: ws_trim(x) != ""), lambda row: F.split(row, "\t", -1))
    rows = F.when(F.col("separator") == "\t", plain).when(F.col("separator") == ",", quoted(",")).otherwise(quoted(";"))
    files = files.withColumn("rows", F.filter(rows, lambda r: F.exists(r, lambda c: c.isNotNull() & (ws_trim(c) != ""))))
    files = files.withColumns({"header": F.transform(F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>")), name), "rows": F.slice("rows", 2, 1 << 30)})
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("header"))
    known = F.exists("header", lambda h: h != "")
    reason = F.when(F.col("suffix").isin(*UNREAD), F.concat(F.lit("unsupported_output_format:."), "suffix")).when(ws_trim(F.col("text")) == "", F.lit(None)).when(~known, "no_recognized_fields").when(F.size(missing) > 0, F.concat(F.lit("missing_required_field:"), F.array_join(missing, ",")))
    files = files.withColumn("reason", reason)
    status = files.select("doc_id", "file", F.when(F.col("reason").isNotNull(), "parse_error").when((ws_trim(F.col("text")) == "") | (F.size("rows") == 0), "parsed_empty").otherwise("parsed").alias("status"), "reason")
    good = files.where("reason is null").select("doc_id", "header", F.posexplode("rows").alias("row_no", "cells"))
    cell = lambda k: blank_to_null(F.get("cells", F.array_position("header", k).cast("int") - 1))
    entities = good.select("doc_id", "row_no", cell("start").try_cast("bigint").alias("start"), cell("end").try_cast("bigint").alias("end"), *(cell(k).alias(k) for k in ("semantic_tag", "assertion", "cui", "attribute", "entity_text")), F.sha2(cell("entity_text"), 256).alias("entity_sha256"))
    return entities, status


def _quoted(name: str) -> str:
    """A table or schema name of up to three parts, each quoted; anything but letters, digits, _ and - is refused."""
    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(re.fullmatch(r"[A-Za-z_][\w-]*", p) for p in parts):
        raise ValueError(f"not a table name: {name!r}")
    return ".".join(f"`{p}`" for p in parts)


def schema_listing(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW SCHEMAS").orderBy("namespace")


def catalog_listing(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {_quoted(database)}").select("namespace", "tableName").orderBy("tableName")


def named_table(spark: SparkSession, name: str, columns: list[str], text_column: str, dataset: str, limit: int | None = None) -> DataFrame:
    """Columns of a table with a constant source_dataset, of rows with a text; with a limit the first by those columns."""
    rows = spark.table(_quoted(name)).where(F.col(text_column).isNotNull()).select(F.lit(dataset).alias("source_dataset"), *columns, text_column)
    return rows if limit is None else rows.orderBy(*columns).limit(limit)


def typed_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its suffix: .parquet, or .csv (plain or gzip) with a header; without a schema CSV values are strings."""
    plain = path.rstrip("/").removesuffix(".gz")
    if plain.endswith(".parquet"):
        return spark.read.parquet(path)
    if plain.endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    raise ValueError(f"neither CSV nor Parquet: {path}")


def packet_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a packet of (gzip) JSON lines; blank lines are skipped, anything but an object raises when it is read."""
    lines = spark.read.text(path).where(ws_trim(F.col("value")) != "")
    whole = F.when(ws_trim(F.col("value")).startswith("{"), F.col("value")).otherwise(F.raise_error(F.lit("a packet line is not an object")))
    return lines.select(F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def status_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, status, run_id and models of many small status objects; absent files and non-objects are skipped."""
    jvm = spark.sparkContext._jvm
    there = [p for p in paths if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(q)]
    schema = "name string, status string, reason string, details struct<run_id:string,models:array<string>>"
    if not there:
        return spark.createDataFrame([], "name string, status string, reason string, run_id string, models array<string>")
    raw = spark.read.text(there, wholetext=True).where(ws_trim(F.col("value")).startswith("{"))
    return raw.select(F.from_json("value", schema).alias("r")).where("r.name is not null").select("r.name", "r.status", "r.reason", "r.details.run_id", "r.details.models")


def metric_tables(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """Metric CSVs one below the other; columns may differ, but each must have the required ones."""
    out = None
    for path in paths:
        one = spark.read.csv(path, header=True, inferSchema=True)
        if absent := [c for c in required if c not in one.columns]:
            raise ValueError(f"{path} is missing columns: {absent}")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def planning_inputs(spark: SparkSession, interrater: str, input_qa: str, tasks: tuple[str, ...] = ("image", "report")) -> tuple[DataFrame, DataFrame]:
    """A pilot's reliability and check tables, with their required columns, for exactly these tasks."""
    a = metric_tables(spark, [interrater], ["task", "rated_cases", "complete_cases", "share_25", "share_50", "icc_single", "status"])
    b = metric_tables(spark, [input_qa], ["check", "value"])
    if found := [tuple(r) for r in values_differ(a, "task", list(tasks), subset=False).collect()]:
        raise ValueError(f"tasks are not {tasks}: {found}")
    return a, b


def extraction_spec(spark: SparkSession, dictionary: str, cues: str, token_rules: str, abbreviations: str | None = None, stem: Callable[[str], str] | None = None) -> Spec:
    """A Spec from its files, of fixed size, read on the driver.

    dictionary: JSON with terms [{term, tag}], rules [[first, second]], final, and any other field of Spec. cues: phrase
    and category by tab on each line, in order. token_rules: delimiters after DELIMETER=, with DEL between them.
    abbreviations: one on each line.
    """
    read = lambda p: [r["value"] for r in spark.read.text(p, wholetext=True).collect()][0]
    found = json.loads(read(dictionary))
    lines = [(k, x.split("\t")) for k, x in enumerate(read(cues).splitlines(), 1) if x.strip()]
    if bad := [k for k, x in lines if len(x) != 2 or not all(x)]:
        raise ValueError(f"malformed cue rows: {bad[:5]}")
    signs = [s for x in read(token_rules).splitlines() if x.startswith("DELIMETER=") for s in x.split("=", 1)[1].split("DEL")]
    signs = [{r"\t": "\t", r"\'": "'", r"\\": "\\"}.get(s, s) for s in signs]
    if not signs or any(len(s) != 1 for s in signs):
        raise ValueError(f"delimiters must be single characters: {signs}")
    more = {k: frozenset(v) if k == "excluded" else tuple(v) if isinstance(v, list) else v for k, v in found.items() if k not in ("terms", "rules")}
    short = frozenset(x for x in read(abbreviations).splitlines() if x) if abbreviations else frozenset()
    return Spec(terms=tuple((t["term"], t["tag"]) for t in found["terms"]), cues=tuple(tuple(x) for _, x in lines), rules=tuple(tuple(r) for r in found.get("rules", [])), delimiters="".join(signs), abbreviations=short, stem=stem, **more)
