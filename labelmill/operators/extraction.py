"""Dictionary entities with assertion and promotion over a corpus.

Texts are read one by one in Arrow batches by a small Python reader: tokens, sentences, and the places where a term
or cue stands. (The same in column lambdas, which are interpreted, took four times as long on sf0.1.) Only matches leave
it, so no token is shuffled or sorted. They meet once by sentence, where assertion and promotion are decided by Spark.

What is looked for is a Spec; positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import duplicates, occurrence_number

NEGATION, AFTER, PSEUDO, CONJUNCTION = "negPhrases", "postNegPhrases", "pseNegPhrases", "conjunctions"
KEY = ["doc_id", "sentence", "part"]


@dataclass(frozen=True)
class Spec:
    """terms: (term, tag), cues: (phrase, category) in order; rules: (first tag, second tag) promotes the second.

    stem maps a word to its stem; None: folded case.
    """

    terms: tuple[tuple[str, str], ...]
    cues: tuple[tuple[str, str], ...]
    rules: tuple[tuple[str, str], ...] = ()
    final: str = "FINAL"
    abbreviations: frozenset[str] = frozenset()
    delimiters: str = ".,;:!?()"
    excluded: frozenset[str] = frozenset()
    stem: Callable[[str], str] | None = None
    newline_ends_sentence: bool = True
    longest_sentence: int = 500
    scope: int = 11
    within: int = 5
    removed: tuple[str, ...] = ("absent",)

    @property
    def token_pattern(self) -> str:
        d = re.escape("".join(sorted(set(self.delimiters))))
        return rf"\d+|[^\s\d{d}][^\s{d}]*|[{d}]"

    def words(self, phrase: str) -> list[str]:
        return [w.casefold() for w in re.findall(self.token_pattern, phrase)]

    def entries(self) -> list[tuple[str, list[str], str, int, str]]:
        """(kind, words, tag, number, phrase) of all terms, by stems, and cues, by folded case."""
        fold = self.stem or str.casefold
        found = [("t", [fold(w) for w in self.words(t)], tag, k, t) for k, (t, tag) in enumerate(self.terms) if t not in self.excluded]
        found += [("c", self.words(p), category, k, p) for k, (p, category) in enumerate(self.cues)]
        return [e for e in found if e[1]]


#: Distinct tokens that a worker remembers before it starts anew, and characters of the longest; longer ones are looked up
#: each time, so that what is remembered is bounded in bytes.
REMEMBERED, LONGEST = 200_000, 64
#: Matches that leave a worker at once, be they of many texts or of a part of one.
AT_ONCE = 8192


class Trie:
    """Phrases as paths of word numbers (from 1), with a failure link from each node to its longest proper ending."""

    def __init__(self, phrases: list[tuple[int, list[int]]]):
        """phrases: (entry, word numbers)."""
        self.steps: list[dict[int, int]] = [{}]
        self.fails, self.ends = [0], [[]]
        for entry, words in phrases:
            node = 0
            for w in words:
                if w not in self.steps[node]:
                    self.steps[node][w] = len(self.steps)
                    self.steps.append({})
                    self.fails.append(0)
                    self.ends.append([])
                node = self.steps[node][w]
            self.ends[node].append((entry, len(words)))
        level = list(self.steps[0].values())
        while level:
            deeper = []
            for node in level:
                for w, child in self.steps[node].items():
                    self.fails[child] = self.step(self.fails[node], w)
                    self.ends[child] = self.ends[child] + self.ends[self.fails[child]]
                    deeper.append(child)
            level = deeper

    def step(self, node: int, word: int) -> int:
        while word not in self.steps[node]:
            if not node:
                return 0
            node = self.fails[node]
        return self.steps[node][word]


class Words(dict):
    """A token's word numbers, as a term's word by its stem and as a cue's by its folded form, in one number; 0 if it
    is neither. Each distinct token of usual length is folded and stemmed once."""

    def __init__(self, terms: dict[str, int], cues: dict[str, int], stem: Callable[[str], str] | None):
        super().__init__()
        self.terms, self.cues, self.stem = terms, cues, stem

    def __missing__(self, token: str) -> int:
        form = token.casefold()
        code = self.terms.get(self.stem(form) if self.stem else form, 0) << 20 | self.cues.get(form, 0)
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = code
        return code


#: What may end a sentence: a period before blanks, or a line break.
_BREAKS, _PERIODS = re.compile(r"\.\s+|[\r\n]\s*"), re.compile(r"\.\s+")


class Reader:
    """Finds the places of a Spec's terms and cues in a text.

    A sentence without a word of a term or cue costs its cutting into tokens and a look-up of each. Else tokens that
    are such words walk two tries, for terms and for cues, and places are made out for what they find.
    """

    def __init__(self, spec: Spec):
        self.spec = spec
        self.token = re.compile(spec.token_pattern)
        self.entries = spec.entries()
        numbers: dict[str, dict[str, int]] = {"t": {}, "c": {}}
        phrases: dict[str, list[tuple[int, list[int]]]] = {"t": [], "c": []}
        for e, (kind, words, *_) in enumerate(self.entries):
            phrases[kind].append((e, [numbers[kind].setdefault(w, len(numbers[kind]) + 1) for w in words]))
        self.terms, self.cues = Trie(phrases["t"]), Trie(phrases["c"])
        self.words = Words(numbers["t"], numbers["c"], spec.stem)
        self.openers = {e for e, x in enumerate(self.entries) if x[0] == "c" and x[2] == PSEUDO}
        self.breaks = _BREAKS if spec.newline_ends_sentence else _PERIODS

    def joined_on(self, text: str, end: int, gap: str) -> bool:
        """Whether the period at end closes an abbreviation rather than a sentence."""
        short = self.spec.abbreviations
        if not short or gap.strip(" \t"):
            return False
        k = end
        while k and not text[k - 1].isspace():
            k -= 1
        word, after = text[k:end], end + len(gap)
        small = after < len(text) and text[after].islower()
        return word in short and (small or text.startswith("___", after)) or word[:-1].islower() and word[:-1] in short and small

    def sentences(self, text: str) -> list[int]:
        """Where sentences begin, and the text's end."""
        first = len(text) - len(text.lstrip())
        out, newline = [first], self.spec.newline_ends_sentence
        for m in self.breaks.finditer(text, first):
            gap, start = m[0].lstrip("."), m.start() + (text[m.start()] == ".")
            if newline and ("\n" in gap or "\r" in gap) or not self.joined_on(text, start, gap):
                out.append(m.end())
        return out if out[-1] == len(text) else [*out, len(text)]

    def found(self, codes: list[int], at: list[int]) -> list[tuple[int, int, int]]:
        """(first token, last token, entry) of all phrases, whatever sentences they lie in."""
        out, term, cue, before = [], 0, 0, -2
        terms, cues = self.terms, self.cues
        for k in at:
            if k != before + 1:
                term = cue = 0
            before = k
            t, c = codes[k] >> 20, codes[k] & 0xFFFFF
            term, cue = terms.step(term, t) if t else 0, cues.step(cue, c) if c else 0
            for e, n in terms.ends[term] if term else ():
                out.append((k - n + 1, k, e))
            for e, n in cues.ends[cue] if cue else ():
                out.append((k - n + 1, k, e))
        out.sort()
        return out

    def matches(self, text: str, with_terms: bool = False):
        """(entry, first token, last token, sentence, part, begin, end, letters before in the part) of each match; if
        with_terms, only of parts of sentences that hold a term."""
        begins, ahead, longest, token, word = self.sentences(text), 0, self.spec.longest_sentence, self.token, self.words.__getitem__
        for sentence, (start, end) in enumerate(zip(begins, begins[1:], strict=False)):
            codes = list(map(word, token.findall(text, start, end)))
            most = max(codes, default=0)
            if most >= 1 << 20 or most and not with_terms:
                found = [(i, j, e) for i, j, e in self.found(codes, [k for k, c in enumerate(codes) if c]) if i // longest == j // longest]
                if with_terms:
                    parts = {i // longest for i, _, e in found if self.entries[e][0] == "t"}
                    found = [x for x in found if x[0] // longest in parts]
                spans = [m.span() for m in token.finditer(text, start, end)] if found else ()
                for first, last, e in found:
                    part = first // longest
                    letters = e in self.openers and any(map(str.isalpha, text[spans[part * longest][0] : spans[first][0]]))
                    yield e, ahead + first, ahead + last, sentence, part, spans[first][0], spans[last][1], letters
            ahead += len(codes)


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
MARKS = "doc_id {0}, sentence int, part int, kind string, first int, last int, begin int, end int, begin16 int, end16 int, tag string, no int, phrase string, letters boolean"


def marks(docs: DataFrame, spec: Spec, with_terms: bool = False) -> DataFrame:
    """Every place where a term's or cue's words stand in a row within a sentence; overlaps are kept. docs: doc_id, text.
    With with_terms only of parts of sentences that hold a term, which is all that assertions need.

    Columns: doc_id, sentence, part (of a sentence of more than longest_sentence tokens), kind (t or c), first and last
    (token numbers), begin and end, begin16 and end16 (in UTF-16 units), tag, no, phrase, and letters (for pseudo-cues:
    whether the part of the sentence before holds a letter).
    """
    names = [x.split()[0] for x in MARKS.split(", ")]
    reader = Reader(spec)  # goes to workers with the function; as large as the specification

    def run(batches):
        columns = [pa.array([e[k] for e in reader.entries], t) for k, t in ((0, pa.string()), (2, pa.string()), (3, pa.int32()), (4, pa.string()))]

        def packed(ids, rows, found):
            entry, first, last, sentence, part, begin, end, letters, begin16, end16 = zip(*found, strict=True)
            kind, tag, no, phrase = (c.take(pa.array(entry, pa.int32())) for c in columns)
            ints = {k: pa.array(v, pa.int32()) for k, v in (("sentence", sentence), ("part", part), ("first", first), ("last", last), ("begin", begin), ("end", end), ("begin16", begin16), ("end16", end16))}
            every = ints | {"doc_id": ids.take(pa.array(rows, pa.int32())), "kind": kind, "tag": tag, "no": no, "phrase": phrase, "letters": pa.array(letters, pa.bool_())}
            return pa.RecordBatch.from_arrays([every[n] for n in names], names)

        for batch in batches:
            rows, found = [], []
            for row, value in enumerate(batch.column("text")):
                text = value.as_py()
                if not text:
                    continue
                far = [] if text.isascii() else [m.start() for m in _ASTRAL.finditer(text)]
                for x in reader.matches(text, with_terms):
                    rows.append(row)
                    found.append((*x, x[5] + bisect_left(far, x[5]), x[6] + bisect_left(far, x[6])))
                    if len(found) == AT_ONCE:
                        yield packed(batch.column("doc_id"), rows, found)
                        rows, found = [], []
            if found:
                yield packed(batch.column("doc_id"), rows, found)

    return docs.select("doc_id", "text").mapInArrow(run, MARKS.format(docs.schema["doc_id"].dataType.simpleString()))


def assertions(found: DataFrame, spec: Spec) -> DataFrame:
    """The entities of marks with assertion and the cue that decided it.

    An entity is absent by the latest negation that ends before it, or else by the earliest that follows it, at most
    ``scope`` tokens away. A negation does not reach over a conjunction, nor one before the entity if a pseudo-cue
    overlaps it or stands between; a pseudo-cue counts if it starts with "not" or letters stand before it.
    """
    item = F.struct(*(c for c in found.columns if c not in KEY))
    groups = found.groupBy(*KEY).agg(F.collect_list(item).alias("m"))
    cues = lambda kind: F.filter("m", lambda c: (c["kind"] == "c") & (c["tag"] == kind))
    groups = groups.where(F.exists("m", lambda c: c["kind"] == "t")).withColumns({"neg": cues(NEGATION), "post": cues(AFTER), "stops": cues(CONJUNCTION), "pse": F.filter(cues(PSEUDO), lambda p: p["letters"] | F.lower(p["phrase"]).startswith("not "))})
    cut = lambda a, b: F.exists("stops", lambda k: (k["begin"] >= a) & (k["end"] <= b))

    def judged(e: Column) -> Column:
        def before(c: Column) -> Column:
            blocked = F.exists("pse", lambda p: ((c["begin"] < p["end"]) & (p["begin"] < c["end"])) | ((c["end"] <= p["begin"]) & (p["end"] <= e["begin"])))
            return (c["end"] <= e["begin"]) & (e["first"] - c["last"] - 1 <= spec.scope) & ~cut(c["end"], e["begin"]) & ~blocked

        def behind(c: Column) -> Column:
            return (c["begin"] >= e["end"]) & (c["first"] - e["last"] - 1 <= spec.scope) & ~cut(e["end"], c["begin"])

        one = F.array_max(F.transform(F.filter("neg", before), lambda c: F.struct(c["end"], c["begin"], -c["no"], c["phrase"].alias("phrase"))))
        two = F.array_min(F.transform(F.filter("post", behind), lambda c: F.struct(c["begin"], c["end"], c["no"], c["phrase"].alias("phrase"))))
        cue = F.coalesce(one["phrase"], two["phrase"])
        return F.struct(*(e[c].alias(c) for c in found.columns if c not in (*KEY, "kind", "letters")), F.when(cue.isNotNull(), "absent").otherwise("present").alias("assertion"), cue.alias("cue"))

    return groups.select(*KEY, F.inline(F.transform(F.filter("m", lambda c: c["kind"] == "t"), judged)))


def _fits(target: Column, tag: str, spec: Spec) -> Callable[[Column], Column]:
    """Whether an entity ahead may be promoted for the row's; target: the row's neighbour that was promoted, or null."""

    def fits(x: Column) -> Column:
        gap = x["first"] - F.col("last") - 1
        crosses = F.exists("near", lambda f: (f["tag"] == spec.final) & (f["begin"] >= F.col("end")) & (f["end"] <= x["begin"]))
        touches = (target["end"] <= x["begin"]) & (x["first"] - target["last"] == 1)
        return (x["tag"] == tag) & (x["begin"] >= F.col("end")) & (gap >= 0) & (gap <= spec.within) & F.when(target.isNull(), ~crosses).otherwise(touches)

    return fits


def promoted(entities: DataFrame, spec: Spec) -> DataFrame:
    """Entities that are or become ``final``: per rule a pass over neighbours, then per rule one over a distance.

    Neighbours are entities of the rules' tags in order, with no token between. The first later entity of the second tag
    in such a row is promoted. Over a distance of at most ``within`` tokens the first fitting one is; an entity whose
    neighbour was promoted may only take one that touches that neighbour, another may not reach over a final one. Each
    pass sees what the one before has left.
    """
    tags = {t for rule in spec.rules for t in rule}
    order = ["begin", "end", "no"]
    e = entities.where(~F.col("assertion").isin(*spec.removed)) if spec.removed else entities
    for k, (a, b) in enumerate(spec.rules):
        e = e.withColumn("in_play", F.col("tag").isin(*sorted(tags)))
        w = Window.partitionBy(*KEY, "in_play").orderBy(*order)
        touches = (F.lag("end").over(w) <= F.col("begin")) & (F.col("first") - F.lag("last").over(w) == 1)
        e = e.withColumn("broken", (~F.coalesce(touches, F.lit(False))).cast("int"))
        e = e.withColumn("cluster", F.sum("broken").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        row = Window.partitionBy(*KEY, "in_play", "cluster")
        before = row.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        behind = row.orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
        span = F.struct("end", "last")
        e = e.withColumns({
            f"target{k}": F.when(F.col("in_play") & (F.col("tag") == a), F.last(F.when(F.col("tag") == b, span), ignorenulls=True).over(behind)),
            "hit": F.col("in_play") & (F.col("tag") == b) & (F.last(F.when(F.col("tag").isin(a, b), F.col("tag")), ignorenulls=True).over(before) == a),
        }).withColumn("tag", F.when(F.coalesce("hit", F.lit(False)), spec.final).otherwise(F.col("tag")))
    reach = spec.within + 1 + max((len(x[1]) for x in spec.entries() if x[0] == "t"), default=1)
    for k, (a, b) in enumerate(spec.rules):
        near = Window.partitionBy(*KEY).orderBy("first")
        e = e.withColumn("near", F.collect_list(F.struct(*order, "first", "last", "tag")).over(near.rangeBetween(0, reach)))
        pick = F.array_min(F.transform(F.filter("near", _fits(F.col(f"target{k}"), b, spec)), lambda x: F.struct(*(x[c].alias(c) for c in order))))
        e = e.withColumn("pick", F.when(F.col("tag") == a, pick)).withColumn("picks", F.collect_set("pick").over(near.rangeBetween(-reach, 0)))
        e = e.withColumn("tag", F.when(F.array_contains("picks", F.struct(*order)), spec.final).otherwise(F.col("tag")))
    return e.where(F.col("tag") == spec.final).select(*KEY, "first", "last", "begin", "end", "begin16", "end16", "tag", "no", "phrase", "assertion", "cue")


def predictions(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per document: number of final entities and label (1 if there are any)."""
    n = entities.groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    return docs.select("doc_id").join(n, "doc_id", "left").fillna(0, ["n_entities"]).withColumn("label", (F.col("n_entities") > 0).cast("byte"))


def extract(docs: DataFrame, spec: Spec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Final entities, numbered among equal ones; one prediction per document; and the ids that repeat with their number
    of rows, as a check to be required (validation.require) before the rest is believed."""
    found = promoted(assertions(marks(docs, spec, True), spec), spec)
    found = occurrence_number(found, ["doc_id", "begin16", "end16", "tag", "assertion", "phrase"], ["no"])
    again = duplicates(docs, ["doc_id"]).agg(F.count("*").alias("n_rows")).where("n_rows > 0").select(F.lit("document_id_repeats").alias("check"), F.lit("error").alias("severity"), "n_rows")
    return found, predictions(docs, found), again


def stage_agreement(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Of all documents of two runs of a stage: how many have exactly the same rows, in number and fields, in both."""
    digest = lambda df, name: df.groupBy("doc_id").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.to_json(F.struct(*fields))))), 256).alias(name))
    both = digest(a, "a").join(digest(b, "b"), "doc_id", "full")
    return both.agg(F.count("*").alias("documents"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("exact"))
