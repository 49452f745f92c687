"""Document fingerprints by winnowing, with DataFrame functions only.

A text is cut into pieces: words of at most ``PIECE_CHARS`` characters without blanks, and the single code
points of longer runs, so that no cut depends on where a run starts. Each piece has a code; at each piece the codes of a
gram make a rolling hash (a cyclic polynomial): ``gram`` pieces from a word, ``LONG_GRAM`` from a code point. Of every ``window`` consecutive
hashes the least is kept, the rightmost of equals, with its position. Two texts that share the pieces of
``window`` consecutive whole grams share a kept hash. At a text's end grams are as long as it allows;
texts of fewer pieces than a gram are hashed whole.

A fingerprint is a string ``hash:position,...`` in order of position (position counts pieces, the
hash is 10 hexadecimal digits). Likeness is the Jaccard similarity of the sets of hashes: 1 for two
empty fingerprints, 0 for an empty and another. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import parallelism

GRAM, WINDOW, PIECE_CHARS, LONG_GRAM = 3, 8, 16, 16
#: One-letter words keep the blank before them, which tells them from code points of long runs.
PIECES = rf" \S(?!\S)|(?<!\S)\S{{2,{PIECE_CHARS}}}+(?!\S)|\S"
MARKS = "struct<hashes:array<bigint>,positions:array<int>>"
#: Where hash and position are packed, positions take the low bits beside 40 bits of hash.
POSITION = (1 << 23) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rotated(x: Column, n: Column) -> Column:
    """The 64 bits of x turned left by n places (0 to 63)."""
    return F.call_function("shiftleft", x, n).bitwiseOR(F.call_function("shiftrightunsigned", x, 64 - n))


def running(codes: Column) -> Column:
    """Running hashes of an array of codes: at each place the exclusive or of all codes before it, code j turned right by j.

    They are held in chunks of 64, each from 0 (``inner``), beside what all chunks before add up to (``before``).
    """
    grown = lambda acc, c: F.array_append(acc, F.element_at(acc, -1).bitwiseXOR(_rotated(c, (65 - F.size(acc)).bitwiseAND(F.lit(63)))))
    zero = F.array(F.lit(0).cast("bigint"))
    inner = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(codes) - 1, 6)), lambda k: F.aggregate(F.slice(codes, F.shiftleft(k, 6) + 1, F.lit(64)), zero, grown))
    total = lambda x: F.aggregate(x, zero, lambda acc, c: F.array_append(acc, F.element_at(acc, -1).bitwiseXOR(F.element_at(c, -1))))
    return let(inner, lambda x: F.struct(x.alias("inner"), total(x).alias("before")))


def rolled(sums: Column, start: Column, end: Column, n: Column) -> Column:
    """The cyclic polynomial hash of codes start to end: the exclusive or of code j turned left by end - 1 - j.

    It is what rolling a window over the codes gives (out goes the first, turned as often as the window is long; in
    comes the next), read off two running hashes, so windows of any length cost the same.
    """

    def at(i: Column) -> Column:
        k = F.shiftright(F.least(i, n - 1), 6)
        return F.get(F.get(sums["inner"], k), i - F.shiftleft(k, 6)).bitwiseXOR(F.get(sums["before"], k))

    return _rotated(at(end).bitwiseXOR(at(start)), (end - 1).bitwiseAND(F.lit(63)))


def direct(codes: list[Column]) -> Column:
    """The same hash of a few codes, which costs no more than an update would: all but the last turned left."""
    out = codes[-1]
    for k, c in enumerate(codes[:-1]):
        turn = len(codes) - 1 - k
        out = out.bitwiseXOR(F.shiftleft(c, turn).bitwiseOR(F.shiftrightunsigned(c, 64 - turn)))
    return out


def marks(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprint as 40-bit hashes and their positions, in order of position."""

    def over(pieces: Column) -> Column:
        n = F.size(pieces)
        count = F.greatest(n - (gram - 1), F.lit(1))

        def mark(x: Column) -> Callable[[Column], Column]:
            codes, sums = x["codes"], x["sums"]

            def one(i: Column) -> Column:
                short = F.when(n >= gram, direct([F.get(codes, i + j) for j in range(gram)]))
                for size in range(gram - 1, 0, -1):
                    short = short.when(n == size, direct([F.get(codes, F.lit(j)) for j in range(size)]))
                long = rolled(sums, i, F.least(i + LONG_GRAM, n), n)
                return F.struct(F.shiftright(F.when(F.char_length(F.get(pieces, i)) == 1, long).otherwise(short), 24).alias("hash"), (-i).alias("back"))

            return one

        def choose(grams: Column) -> Column:
            windows = F.greatest(count - (window - 1), F.lit(1))
            return F.transform(F.sequence(F.lit(1), windows), lambda i: F.array_min(F.slice(grams, i, window)))

        def once(least: Column) -> Column:  # equal ones are neighbours, as positions never fall
            return F.filter(least, lambda v, i: (i == 0) | (v["back"] != F.get(least, i - 1)["back"]))

        def fields(found: Column) -> Column:
            h = F.transform(found, lambda v: v["hash"].bitwiseAND(F.lit((1 << 40) - 1)))
            return F.struct(h.alias("hashes"), F.transform(found, lambda v: -v["back"]).alias("positions"))

        # Running hashes are made only for texts that have long runs.
        points = F.exists(pieces, lambda p: F.char_length(p) == 1)
        both = lambda codes: F.struct(codes.alias("codes"), F.when(points, running(codes)).alias("sums"))
        grams = let(let(F.transform(pieces, lambda p: F.xxhash64(p)), both), lambda x: F.transform(F.sequence(F.lit(0), count - 1), mark(x)))
        found = let(let(grams, choose), lambda v: let(let(v, once), fields))
        return F.when(n == 0, F.struct(F.array().cast("array<bigint>").alias("hashes"), F.array().cast("array<int>").alias("positions"))).otherwise(found)

    blanks = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", " " * 5)
    return let(F.regexp_extract_all(blanks, F.lit(PIECES), F.lit(0)), over)


def kept(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprint of a text of at most POSITION pieces as packed longs, hash above inverted position."""
    pack = lambda h, p: F.shiftleft(h, 23).bitwiseOR(F.lit(POSITION) - p.cast("long"))
    return let(marks(text, gram, window), lambda m: F.zip_with(m["hashes"], m["positions"], pack))


def shown(m: Column) -> Column:
    """The fingerprint's string form."""
    one = lambda h, p: F.concat(F.lpad(F.hex(h), 10, "0"), F.lit(":"), p.cast("string"))
    return F.array_join(F.zip_with(m["hashes"], m["positions"], one), ",")


def hashes(m: Column) -> Column:
    return F.array_distinct(m["hashes"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with each text's fingerprint in string form."""
    return df.withColumn(out, shown(marks(F.col(text_col))))


def literal(values: list[int | None], kind: str) -> Column:
    """An array as one constant of the plan, however many values it has."""
    return F.from_json(F.lit("[" + ",".join("null" if v is None else str(v) for v in values) + "]"), f"array<{kind}>")


def below(sorted_values: list[int], x: Column) -> Column:
    """How many of the sorted values are less than x, by halving."""
    values, steps = literal(sorted_values, "bigint"), [1 << k for k in reversed(range(len(sorted_values).bit_length()))]
    if not steps:
        return F.lit(0)
    more = lambda n, s: F.when((n + s <= len(sorted_values)) & (F.get(values, n + s - 1) < x), n + s).otherwise(n)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), more)


def with_next(df: DataFrame, buckets: int) -> DataFrame:
    """df with the row that follows in descending order of doc_id (after the last, the first) as columns
    next_text and next_marks.

    doc_id is cut at quantiles into buckets, each ordered on its own; the row that opens a bucket is
    also sent, marked, to the end of the bucket before it. Null ids come last. Rows of equal id are
    ordered by text. Only the bounds and opening ids (a number per bucket) reach the driver.
    """
    bounds = sorted(set(df.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10000)).first()[0] or []))
    # Bucket 0 has the nulls, then ascending ids.
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(1 + below(bounds, F.col("doc_id")))
    ids = df.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("opens")).collect()
    opens: list[int | None] = [None] * (len(bounds) + 2)
    for r in ids:
        opens[r["bucket"]] = r["opens"]
    present = sorted(r["bucket"] for r in ids)
    if not present:
        return df.withColumns({"next_text": F.lit(None).cast("string"), "next_marks": F.lit(None).cast(MARKS)})
    # Descending order: the bucket after k is the next smaller one; after the smallest comes the largest.
    before = [0] * len(opens)
    for i, k in enumerate(present):
        before[k] = present[(i + 1) % len(present)]
    target, opening = F.get(literal(before, "int"), F.col("bucket")), F.get(literal(opens, "bigint"), F.col("bucket"))
    placed = df.withColumn("bucket", bucket).withColumn("copies", F.when(F.col("doc_id").eqNullSafe(opening), F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("border")), F.struct(target.alias("to"), F.lit(True).alias("border")))).otherwise(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("border")))))
    placed = placed.withColumn("copy", F.explode("copies")).select("*", "copy.to", "copy.border").drop("copies", "copy", "bucket")
    w = Window.partitionBy("to").orderBy("border", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    following = placed.withColumns({"next_text": F.lead("text").over(w), "next_marks": F.lead("marks").over(w)})
    return following.where(~F.col("border")).drop("to", "border")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    The edited text has its last third of code points replaced by as many of the next document's first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("marks", marks(F.col("text"))), 4 * parallelism(docs.sparkSession))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.when(third > 0, F.expr("substring(coalesce(next_text, ''), 1, cast(floor(char_length(text) / 3) as int))")).otherwise("")))
    rows = rows.withColumn("edited_marks", marks(F.col("edited")))
    own, new, following = (hashes(F.col(c)) for c in ("marks", "edited_marks", "next_marks"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("marks")).alias("fingerprint"),
        shown(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"),
        likeness(own, following).alias("near_next"),
    )


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
