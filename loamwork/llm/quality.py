"""Quality rules: base counts and distribution divergence, in DataFrame functions only.

A document's character-class and common-word histograms are compared with the reference of its language by the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). A reference is the mean of the normalised
histograms of all documents of that language that pass the base rules and are long enough. Guards: a histogram with
fewer than `min_chars` characters or `min_words` words decides nothing, and the document is kept by that rule.

Defined results: a null text has no words and fails the base rule; a null or unknown language is compared with the
reference of all documents by character classes alone; repeated rows are judged alike; an empty table gives an empty
result; input columns of the same name as a result column are not read; a language of which no document is fit for a
reference decides nothing (distance 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, table, written

#: The commonest function words of each language; the last bin of the histogram holds all other words.
COMMON = {
    "en": "the of and to in a is that for it was on with as by be at this from or an are".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans au sur pas par avec ce il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo como".split(),
}
CLASSES = ["upper", "digit", "space", "stop", "symbol"]
#: Counted as characters; what is left are letters and the rest.
KEEP = {"upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+", "space": WORD, "stop": r"""[^.,;:!?'"()\-]+""", "symbol": r"[^#*$%&|<>@/\\\[\]{}^~`_+=]+"}
LIMITS = {"min_chars": 60, "min_words": 20, "max_class_distance": 0.32, "max_word_distance": 0.45}


def base_features(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The base counts and the two raw histograms (arrays of long) of every row. Plans are laid out so that each array
    is computed once and read from the row by what follows."""
    carry = ["doc_id"] if carry is None else carry
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.when(F.col("lang").isin(list(COMMON)), F.col("lang"))
    a = docs.select(*carry, text.alias("q_text"), lang.alias("q_lang"))
    kept = lambda pattern: F.length(F.regexp_replace("q_text", F.lit(pattern), F.lit(""))).cast("long")
    lists = F.coalesce(*(F.when(F.col("q_lang") == k, F.array(*map(F.lit, v))) for k, v in COMMON.items()), F.array().cast("array<string>"))
    b = a.select(
        *carry, "q_lang", F.length("q_text").cast("long").alias("q_len"), *(kept(KEEP[k]).alias(f"q_{k}") for k in CLASSES),
        kept(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.filter(F.split("q_text", SPACE + "+"), lambda w: w != "").alias("q_words"),
        F.filter(F.split("q_text", "\n"), lambda x: x.rlike(WORD)).alias("q_lines"), lists.alias("q_list"),
    )
    c = b.select(
        *carry, "q_lang", "q_len", *(f"q_{k}" for k in CLASSES), "n_symbols", F.size("q_words").cast("long").alias("n_words"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(q_words) < 5, cast(array() as array<bigint>), transform(sequence(0, size(q_words) - 5), i -> xxhash64(q_words[i], q_words[i + 1], q_words[i + 2], q_words[i + 3], q_words[i + 4])))").alias("q_grams"),
        F.expr("if(q_lang is null, cast(array() as array<bigint>), filter(transform(q_words, w -> array_position(q_list, lower(w))), p -> p > 0))").alias("q_common"),
    )
    # the grams are sorted only where one of them occurs twice
    d = c.withColumn("q_sorted", F.expr("if(size(array_distinct(q_grams)) < size(q_grams), sort_array(transform(q_grams, (g, i) -> struct(g, i))), cast(array() as array<struct<g:bigint,i:int>>))")).drop("q_grams")
    e = d.withColumn("q_at", F.expr("sort_array(transform(filter(transform(q_sorted, (x, i) -> struct(x.i as p, ((i > 0 and get(q_sorted, i - 1).g = x.g) or (i + 1 < size(q_sorted) and get(q_sorted, i + 1).g = x.g)) as twice)), x -> x.twice), x -> x.p))")).drop("q_sorted")
    covered = F.expr("aggregate(transform(q_at, (p, i) -> if(i + 1 < size(q_at), least(get(q_at, i + 1) - p, 5), 5)), 0L, (s, x) -> s + x)")
    bins = F.transform(F.sequence(F.lit(1), F.lit(len(COMMON["en"]))), lambda k: F.size(F.filter("q_common", lambda p: p == k)).cast("long"))
    rest = F.col("q_len") - sum((F.col(f"q_{k}") for k in CLASSES), F.lit(0))
    return e.select(
        *carry, "q_lang", "n_words", (F.col("q_len") - F.col("q_space")).alias("word_chars"), "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"),
        "q_len", F.array(*(F.col(f"q_{k}") for k in CLASSES), rest).alias("q_class"),
        F.concat(bins, F.array(F.col("n_words") - F.size("q_common"))).alias("q_word"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _shares(counts: str) -> Column:
    """Parts of a million, whole numbers: their sums do not depend on the order."""
    return F.expr(f"transform({counts}, x -> cast(floor(1000000D * x / greatest(aggregate({counts}, 0L, (s, y) -> s + y), 1)) as bigint))")


def references(features: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """One row for each language and one (null) for all documents, at most five: (ref_lang, ref_class, ref_word)."""
    n_class, n_word = len(CLASSES) + 1, len(COMMON["en"]) + 1
    ok = features.filter(~F.col("base_failed") & (F.col("q_len") >= limits["min_chars"]) & (F.col("n_words") >= limits["min_words"]))
    shares = ok.select("q_lang", _shares("q_class").alias("c"), _shares("q_word").alias("w"))
    sums = [F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n_class)] + [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(n_word)]
    per = shares.groupBy("q_lang").agg(*sums)
    row = lambda of: [F.lit(of) if of is None else F.col(of), *(F.array(*(F.col(f"{k}{i}") for i in range(n))) for k, n in (("c", n_class), ("w", n_word)))]
    names = ["ref_lang", "ref_class", "ref_word"]
    total = per.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in per.columns[1:]))
    return (
        per.filter("q_lang is not null").select(*(x.alias(n) for x, n in zip(row("q_lang"), names, strict=True)))
        .unionByName(total.select(*(x.alias(n) for x, n in zip(row(None), names, strict=True))).withColumn("ref_lang", F.lit(None).cast("string")))
    )


def js_distance(p: str, q: str) -> Column:
    """The Jensen-Shannon distance of two arrays of counts; 0 if either is empty of counts, or null."""
    total = lambda x: f"cast(aggregate({x}, 0L, (s, v) -> s + v) as double)"
    part = "if(x.a = 0, 0D, x.a * log2(2 * x.a / (x.a + x.b))) + if(x.b = 0, 0D, x.b * log2(2 * x.b / (x.a + x.b)))"
    return F.expr(
        f"if({total(p)} = 0 or {total(q)} = 0, 0D, sqrt(greatest(0D, aggregate(transform(zip_with(transform({p}, v -> v / {total(p)}), transform({q}, v -> v / {total(q)}), (a, b) -> struct(a, b)), "
        f"x -> ({part}) / 2), 0D, (s, v) -> s + v))))"
    )


def judged(features: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """`features` with class_distance, word_distance and kept. The references, five rows at most, are broadcast."""
    refs = references(features, limits)
    out = features.join(F.broadcast(refs), features["q_lang"].eqNullSafe(refs["ref_lang"]), "left")
    out = out.withColumns({"class_distance": js_distance("q_class", "ref_class"), "word_distance": js_distance("q_word", "ref_word")})
    far_class = (F.col("q_len") >= limits["min_chars"]) & (F.coalesce("class_distance", F.lit(0.0)) > limits["max_class_distance"])
    far_word = F.col("q_lang").isNotNull() & (F.col("n_words") >= limits["min_words"]) & (F.coalesce("word_distance", F.lit(0.0)) > limits["max_word_distance"])
    return out.withColumn("kept", ~F.col("base_failed") & ~far_class & ~far_word)


def quality_filter(docs: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """The rows of `docs` that the rules keep, with its columns. Nothing is shuffled: rows are written once beside their
    counts, the references come from the counts alone, and the verdict is read off the written row."""
    names = docs.columns
    row, = fresh(docs, "q_row")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(row), "text", "lang")
    features = written(base_features(packed, [row]), "quality")
    return judged(features, limits).filter("kept").select(*(F.col(row)[c].alias(c) for c in names))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    features = written(base_features(table(spark, sf_dir, "documents")), "quality")
    return judged(features).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
