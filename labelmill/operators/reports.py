"""Weak labels of reports: sections and text scopes, features of texts and graphs, silver labels.

Word lists are parameters in form of module constants; texts are searched in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The word lists behind the features.
SPREAD = "bilateral|bilaterally|diffuse|diffusely|multifocal|both lungs|bibasilar|biapical"
SPREAD_CORE = "bilateral|diffuse|multifocal|bibasilar"
OPACITY = "opacit|infiltrat|air ?space|consolidat|edema|oedema|hazy|haze|density|densities|disease|ground[- ]glass|interstitial"
OPACITY_CORE = "opacit|infiltrat|air ?space|consolidat|edema|hazy|interstitial"
DOUBT_BEFORE = "possible|possibly|may represent|could represent|cannot exclude|difficult to exclude|questionable|suspected|likely|probably|favor"
DOUBT_BETWEEN = "possible|possibly|may represent|could represent|cannot exclude|questionable|suspected"
DENIED_BEFORE = "no|without|absent|resolved|cleared|clear of|negative for|free of"
DENIED_AFTER = "resolved|cleared|improved to resolution"
EDEMA = "edema|oedema|vascular congestion|congestive|chf|fluid overload"
ATELECTASIS = "atelecta|volume loss|low volume"
AIRSPACE = "air ?space|consolidat|pneumonia|infiltrat"
GRAPH_OPACITY = "opacity|opacities|infiltrat|air ?space|consolidat|edema|oedema|hazy|haze|density|densities|disease|ground[- ]glass|interstitial"
GRAPH_LEFT = "left lung|left base|left lung base|left lower|left upper|left mid|left hemithorax|left perihilar|left lower lobe|left upper lobe"
GRAPH_RIGHT = GRAPH_LEFT.replace("left", "right")
GRAPH_BOTH = "bilateral|bilaterally|both lungs|bibasilar|biapical|diffuse|diffusely|multifocal|widespread|bilateral bases|bilateral lower|bilateral perihilar"
PRESENT, UNSURE, ABSENT, LOCATED = "OBS-DP", "OBS-U", "OBS-DA", "located_at"

#: Literal words of which one is in each text that a feature can match.
_SPREAD_WORDS = "bilateral|diffuse|multifocal|both lungs|bibasilar|biapical"


def base(raw: DataFrame, subject: str = "subject", study: str = "study", text: str = "report_text") -> DataFrame:
    """Typed ids (null where malformed) and texts; rows without a text are dropped."""
    return raw.where(F.col(text).isNotNull()).select(F.col(subject).try_cast("bigint").alias("subject"), F.col(study).try_cast("bigint").alias("study"), F.col(text).alias("report_text"))


def sections(reports: DataFrame, own_line: bool = False, primary: str = "full") -> DataFrame:
    """Normalised text, its sections, and the text scopes that follow from them.

    own_line: a header ends a section only alone on its line; blanks are then collapsed and blank paragraphs left out.
    primary: which scope labels are read from: ``full``, ``both`` (impression and findings) or ``fallback``.
    """
    if primary not in ("full", "both", "fallback"):
        raise ValueError(f"unknown text scope {primary!r}")
    text = F.col("report_text")
    d = reports.withColumn("report_text", X.normalise(text, collapse_blanks=own_line))
    d = d.withColumns({k.lower(): X.section(text, k, own_line=own_line) for k in ("FINDINGS", "IMPRESSION", "ADDENDUM")} | {"last_paragraph": X.last_paragraph(text, drop_blank=own_line)})
    both = X.ws_trim(F.concat(F.coalesce("impression", F.lit("")), F.lit("\n"), F.coalesce("findings", F.lit(""))))
    d = d.withColumns({"scope_both": both, "scope_fallback": F.coalesce("impression", "findings", "last_paragraph", "report_text")})
    first = {"full": text, "both": F.coalesce(F.nullif("scope_both", F.lit("")), "scope_fallback") if own_line else F.col("scope_both"), "fallback": F.col("scope_fallback")}
    return d.withColumns({"scope_primary": first[primary]} | {f"has_{k}": F.col(k).isNotNull() for k in ("findings", "impression", "addendum")})


def text_features(d: DataFrame) -> DataFrame:
    """Ten booleans: seven kinds of mention in the whole report with two sides, and spread opacity in the two other scopes."""
    # A chain of words stays on one line, so lines without the words that all chains of a kind need are left out first.
    about = lambda k, words: X.lines_with(F.lower(F.coalesce(k, F.lit(""))), words)
    d = d.withColumns({f"_{k}": about(k, _SPREAD_WORDS) for k in ("report_text", "scope_both", "scope_fallback")} | {f"_{k}": about("report_text", k) for k in ("right", "left")})
    full, find = F.col("_report_text"), X.guarded_rlike
    spread = lambda c, opacity, *more: find(c, _SPREAD_WORDS, X.chain(SPREAD, opacity), *more)
    out = d.withColumns({
        "text_present": spread(full, OPACITY, X.chain(OPACITY, SPREAD)),
        "text_uncertain": find(full, _SPREAD_WORDS, X.chain(DOUBT_BEFORE, SPREAD_CORE, OPACITY_CORE), X.chain(SPREAD_CORE, DOUBT_BETWEEN, OPACITY_CORE)),
        "text_negated": find(full, _SPREAD_WORDS, X.chain(DENIED_BEFORE, SPREAD_CORE, OPACITY_CORE), X.chain(SPREAD_CORE, OPACITY_CORE, DENIED_AFTER)),
        "text_right": find(F.col("_right"), "right", X.chain("right", OPACITY_CORE, within=80)),
        "text_left": find(F.col("_left"), "left", X.chain("left", OPACITY_CORE, within=80)),
        "text_edema": find(full, _SPREAD_WORDS, X.chain("bilateral|bibasilar|both lungs|diffuse", EDEMA)),
        "text_atelectasis": find(full, _SPREAD_WORDS, X.chain("bilateral|bibasilar|both lungs", ATELECTASIS)),
        "text_airspace": find(full, _SPREAD_WORDS, X.chain("bilateral|bibasilar|both lungs|diffuse|multifocal", AIRSPACE)),
        "text_present_both": spread(F.col("_scope_both"), OPACITY_CORE),
        "text_present_fallback": spread(F.col("_scope_fallback"), OPACITY_CORE),
    })
    return out.drop("_report_text", "_scope_both", "_scope_fallback", "_right", "_left")


def expanded_relations(relations: DataFrame, entities: DataFrame, key: list[str]) -> DataFrame:
    """Relations with tokens (lower case) and label of both entities. relations: key, source_id, target_id, relation."""
    side = lambda s: entities.select(*key, F.col("entity_id").alias(f"{s}_id"), F.lower("tokens").alias(f"{s}_tokens"), F.col("label").alias(f"{s}_label"))
    return relations.join(side("source"), [*key, "source_id"], "left").join(side("target"), [*key, "target_id"], "left")


def graph_features(expanded: DataFrame, key: list[str]) -> DataFrame:
    """Per report over its relations of place: their number, ten booleans (null where no relation can tell) and examples.

    Examples are the first 20 in order, so that a re-run gives the same.
    """
    source, target, label = F.col("source_tokens"), F.col("target_tokens"), F.col("source_label")
    opacity, present, both = source.rlike(GRAPH_OPACITY), label == PRESENT, target.rlike(GRAPH_BOTH)
    flags = {
        "graph_present": opacity & present,
        "graph_uncertain": opacity & (label == UNSURE),
        "graph_absent": opacity & (label == ABSENT),
        "graph_left": opacity & present & target.rlike(GRAPH_LEFT),
        "graph_right": opacity & present & target.rlike(GRAPH_RIGHT),
        "graph_both": opacity & present & both,
        "graph_both_uncertain": opacity & (label == UNSURE) & both,
        "graph_edema": source.rlike(EDEMA) & present & both,
        "graph_atelectasis": source.rlike(ATELECTASIS) & present & both,
        "graph_airspace": source.rlike(AIRSPACE) & present & both,
    }
    example = F.when(opacity, F.concat(label, F.lit(": "), source, F.lit(" -> "), target))
    rows = expanded.where(F.col("relation") == LOCATED)
    return rows.groupBy(*key).agg(F.count("*").alias("n_relations"), *(F.bool_or(c).alias(k) for k, c in flags.items()), F.slice(F.array_sort(F.collect_set(example)), 1, 20).alias("examples"))


def bilateral(features: DataFrame) -> DataFrame:
    """graph_strict: both sides at once or each on its own; graph_sensitive: also uncertain mentions."""
    strict = _yes("graph_both") | (_yes("graph_left") & _yes("graph_right"))
    return features.withColumns({"graph_strict": strict, "graph_sensitive": strict | _yes("graph_both_uncertain")})


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def star(reports: DataFrame, labels: DataFrame, graphs: DataFrame, key: list[str], texts: DataFrame | None = None) -> DataFrame:
    """Reports with what is known of each: left joins on one key. has_labels tells whether a label row was there.

    texts: text features that are kept in a table of their own; made from the reports in the same job they stand in the
    reports' rows already, which spares a join and reading every text twice.
    """
    out = reports.join(labels.withColumn("has_labels", F.lit(True)), key, "left").join(graphs, key, "left")
    out = out if texts is None else out.join(texts, key, "left")
    return out.withColumn("has_labels", _yes("has_labels"))


def silver(d: DataFrame, version: str | None = None) -> DataFrame:
    """Composite flags, strict and sensitive labels (1, 0 or null), score with its source, flags and review priority.

    d has the text_ and graph_ features, has_labels, and label_opacity, label_edema, label_consolidation and
    label_atelectasis (1, 0, -1 for uncertain, or null). version: also adds the time of the run and its version.
    """
    tp, tu, tn = (_yes(f"text_{k}") for k in ("present", "uncertain", "negated"))
    strict, sensitive = _yes("graph_strict"), _yes("graph_sensitive")
    label = lambda k: F.coalesce(F.col(f"label_{k}"), F.lit(0))
    either = {k: _yes(f"graph_{k}") | _yes(f"text_{k}") for k in ("edema", "atelectasis", "airspace")}
    uncertain = _yes("graph_both_uncertain") | tu
    strict_signal = (strict | tp) & ~tn
    sensitive_signal = (sensitive | tp | tu | either["edema"] | either["atelectasis"] | either["airspace"]) & ~tn
    quiet = ~(sensitive | tp | tu | _yes("text_edema") | _yes("text_atelectasis") | _yes("text_airspace"))
    negative = F.col("has_labels") & (label("opacity") == 0) & (label("edema") == 0) & (label("consolidation") == 0) & (label("atelectasis") == 0) & quiet
    alone = (label("opacity") == 1) & ~sensitive & ~tp
    # The scores and the names of what they come from, first match first, and of the flags.
    rungs = (
        (strict & tp, 0.95, "radgraph_strict_plus_regex"),
        (strict, 0.90, "radgraph_strict"),
        (tp & ~tn, 0.85, "regex_strict"),
        (sensitive, 0.75, "radgraph_sensitive"),
        (uncertain, 0.55, "regex_or_radgraph_uncertain"),
        (label("opacity") == 1, 0.35, "chexpert_lung_opacity_only"),
        (label("opacity") == -1, 0.30, "chexpert_lung_opacity_uncertain_only"),
        (F.col("has_labels") & (label("opacity") == 0), 0.05, "chexpert_negative"),
    )
    flags = F.array_compact(F.array(F.when(strict != tp, "radgraph_regex_disagreement"), F.when(tn & (strict | tp), "positive_and_negated_conflict"), F.when(alone, "broad_opacity_without_bilateral_signal")))
    priority = F.when((strict != tp) | uncertain, "high").when(alone, "medium").otherwise("low")
    out = d.withColumns(either | {
        "uncertain": uncertain, "any_opacity": strict_signal | sensitive_signal | uncertain, "not_atelectatic": (strict | tp | tu | either["edema"] | either["airspace"]) & ~tn,
        "silver_strict": F.when(strict_signal, 1).when(negative, 0), "silver_sensitive": F.when(sensitive_signal, 1).when(negative, 0),
        "silver_score": _ladder([(c, s) for c, s, _ in rungs]), "silver_source": F.coalesce(_ladder([(c, n) for c, _, n in rungs]), F.lit("unclassified")),
        "qa_flags": flags, "review_priority": priority,
    })
    return out if version is None else out.withColumns({"created_at": F.current_timestamp(), "version": F.lit(version)})


def _ladder(rungs: list[tuple[Column, object]]) -> Column:
    """The value of the first condition that holds, or null."""
    out = F.when(rungs[0][0], F.lit(rungs[0][1]))
    for condition, value in rungs[1:]:
        out = out.when(condition, F.lit(value))
    return out


def model_extract(d: DataFrame, columns: list[str], text: str = "report_text") -> DataFrame:
    """The columns that model development needs, of rows with a text."""
    return d.where(F.col(text).isNotNull()).select(*columns)


def limited_extract(d: DataFrame, subject: str, study: str, n: int) -> DataFrame:
    """n rows by the hash of both ids: the same rows at every run."""
    return d.orderBy(F.sha2(F.concat_ws("-", F.col(subject).cast("string"), F.col(study).cast("string")), 256), subject, study).limit(n)
