"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame functions only.

The lexicon holds the terms (runs of letters and digits, lower case) whose document frequency lies in a band, so whose
inverse document frequency is neither low nor high. Each of 64 random subsets of the lexicon, at two densities (every
64th and every 1024th term), gives one I-Match signature: the hash of the document's sorted distinct terms in the
subset. The fingerprint is the 128 signatures, four hexadecimal digits each, 0000 where a subset holds none of the
document's terms. The likeness of two fingerprints is the share of equal signatures among those that either has, at the
density where that is larger (the thin one serves long documents and counts only if it has enough signatures).

A document without terms in the band takes all its terms instead; one without any term, its text's hash.

The lexicon is every term of the band. Up to MAX_LEXICON terms it goes into the plan as a literal; a larger one stays a
table, and the documents' terms are joined to it by a shuffle, with the same results.

Defined results: a null text is empty; equal texts have equal fingerprints; documents are ordered by doc_id (any whole
number) descending, null last, ties by the text's hash, rows alike in both as they come; of a single document the next is
itself; a text of any length is read whole, as one row of a task; an empty table gives an empty result; extra columns are
not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SUBSETS, DENSE, THIN = 64, 64, 1024
LOW, HIGH, MAX_LEXICON = 0.004, 0.10, 20_000
#: Signatures that the thin subsets must have to count.
ENOUGH = 8
#: Documents that a run of neighbours has on average, and runs at most.
RUN, MAX_RUNS = 500, 40_000


def terms(text: Column) -> Column:
    """The hashes of a text's distinct terms, ascending."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.sort_array(F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)))


def band(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): the hashes of all terms in the band, a written table."""
    distinct = docs.select(terms(F.coalesce("text", F.lit(""))).alias("t"))
    n = docs.count()
    counted = distinct.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return written(counted.filter((F.col("df") >= low * n) & (F.col("df") <= max(high * n, 1))).select("term"), "lexicon")


def listed(words: DataFrame, limit: int) -> list[int]:
    return [r[0] for r in words.limit(limit).collect()]


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, limit: int = MAX_LEXICON) -> list[int]:
    """Hashes of the terms in the band: all of them, or any `limit` where there are more."""
    return listed(band(docs, low, high), limit)


def joined(rows: DataFrame, words: DataFrame, names: list[str]) -> DataFrame:
    """What `selected` does to each column of `names`, for a lexicon of any size."""
    row = "lexicon_row"
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "lexicon_rows")
    out = rows
    for name in names:
        found = rows.select(row, F.explode(name).alias("term")).join(words, "term", "left_semi").groupBy(row).agg(F.sort_array(F.collect_list("term")).alias("in_lexicon"))
        out = out.join(found, row, "left").withColumn(name, F.coalesce("in_lexicon", name)).drop("in_lexicon")
    return out.drop(row)


def selected(t: str, words: list[int]) -> Column:
    """Of the array `t` of term hashes, those in the lexicon, or all if none is."""
    if not words:
        return F.col(t)
    literal = ",".join(f"{w}L" if w > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)" for w in words)
    return F.expr(f"transform(array(filter({t}, x -> x in ({literal}))), f -> if(size(f) = 0, {t}, f))[0]")


def _parts(t: str, skip: int) -> str:
    """SUBSETS arrays: the elements of the array `t` by the SUBSETS values of the bits from `skip` on, each ascending. The
    elements are rotated so that those bits lead, and sorted once with a mark before each part, so that parts are slices."""
    turn, back = skip + 6, 64 - skip - 6
    least = "shiftleft(1L, 63)"
    marks = f"transform(sequence(0, {SUBSETS - 1}), j -> shiftleft(cast(j as bigint), 58))"
    rotated = f"transform({t}, x -> shiftrightunsigned(x ^ {least}, {turn}) | shiftleft(x ^ {least}, {back}))"
    restored = f"shiftleft(x, {turn}) | shiftrightunsigned(x, {back})"
    # the first half of the parts comes last, since its marks are not negative
    end = f"if(j = {SUBSETS // 2 - 1}, size(a.r) + 1, a.at[(j + 1) % {SUBSETS}])"
    cut = f"transform(sequence(0, {SUBSETS - 1}), j -> sort_array(transform(slice(a.r, cast(a.at[j] + 1 as int), cast({end} - a.at[j] - 1 as int)), x -> ({restored}) ^ {least})))"
    placed = f"transform(array(sort_array(concat({rotated}, {marks}))), r -> struct(r, transform({marks}, m -> array_position(r, m)) as at))"
    return f"transform({placed}, a -> {cut})[0]"


def fingerprint(chosen: str) -> Column:
    """From an array of the selected terms, ascending, the 128 signatures: of the terms by their last six bits, and of the
    1024 parts by the ten bits after the eighth, the first 64."""
    one = "if(size(f) = 0, '0000', lpad(lower(hex(1 + pmod(xxhash64(f), 65535))), 4, '0'))"
    few = f"filter({chosen}, x -> pmod(shiftright(x, 8), {THIN}) < {SUBSETS})"
    return F.expr(f"array_join(transform(concat({_parts(chosen, 0)}, {_parts(few, 8)}), f -> {one}), '')")


def likeness(a: str, b: str) -> Column:
    """The likeness of two fingerprints, 0 to 1."""
    part = lambda x, first: f"transform(sequence({first}, {first + SUBSETS - 1}), j -> substring({x}, 4 * j + 1, 4))"
    pair = lambda first: f"zip_with({part(a, first)}, {part(b, first)}, (x, y) -> if(x = '0000' and y = '0000', 0, if(x = y, 1001, 1000)))"
    total = lambda first: f"aggregate({pair(first)}, 0, (s, v) -> s + v)"
    share = lambda s, enough: f"if({s} div 1000 >= {enough}, ({s} % 1000) / ({s} div 1000), 0D)"
    return F.expr(f"case when {a} = {b} then 1D else greatest(transform(array({total(0)}), s -> {share('s', 1)})[0], transform(array({total(SUBSETS)}), s -> {share('s', ENOUGH)})[0]) end")


def _below(bounds: list[int], op: str) -> str:
    """How many of the ascending `bounds` stand in the relation `op` to doc_id, in two steps of about their square root."""
    width = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    number = lambda b: f"{b}L" if b > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)"
    listed = lambda c: f"array({', '.join(map(number, c))})"
    count = lambda of: f"size(filter({of}, b -> b {op} cast(doc_id as bigint)))"
    inner = count(f"array({', '.join(map(listed, chunks))})[k - 1]")
    return f"transform(array({count(listed([c[0] for c in chunks]))}), k -> if(k = 0, 0, (k - 1) * {width} + {inner}))[0]"


def neighbours(docs: DataFrame) -> DataFrame:
    """(run, guest, doc_id, tie, text): the documents dealt into runs of neighbours of about equal numbers, and at the end
    of each run a guest, the first document of the run that comes after it in descending order. Runs follow the ranks of
    doc_ids (a sketch of quantiles, MAX_RUNS numbers at most); a doc_id that has several runs' rows, and the rows without a
    doc_id, are dealt by the texts' hashes, which is their order."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    share = (F.col("tie") / F.lit(2.0**64) + 0.5).cast("double")  # 0 to 1
    none = -1 - F.least(F.floor(share * max(1, min(MAX_RUNS, -(-nulls // RUN)))), F.lit(max(0, min(MAX_RUNS, -(-nulls // RUN)) - 1)))
    runs = max(1, min(MAX_RUNS, -(-(n - nulls) // RUN)))
    bounds = []
    if runs > 1:
        bounds = sorted(docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), [i / runs for i in range(1, runs)], 10 * runs)).first()[0])
    low, high = (F.expr(_below(bounds, op)) if bounds else F.lit(0) for op in ("<", "<="))
    run = F.when(F.col("doc_id").isNull(), none).otherwise(high - F.least(F.floor(share * (high - low + 1)), high - low))
    d = d.withColumn("run", run.cast("long"))
    heads = written(d.groupBy("run").agg(F.max_by("text", F.struct("doc_id", F.bitwise_not("tie"))).alias("text")), "run_heads")
    # the numbers of the runs, 2 * MAX_RUNS at most, are put in order in one task
    after = heads.select("run", F.coalesce(F.lag("run").over(Window.orderBy("run")), F.lit(heads.agg(F.max("run")).first()[0])).alias("next_run"))
    guests = after.join(heads.withColumnRenamed("run", "next_run"), "next_run").select("run", F.lit(1).alias("guest"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return d.select("run", F.lit(0).alias("guest"), "doc_id", "tie", "text").unionByName(guests)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row. A text's
    edited form has its last third replaced by as many characters from the start of the next document. The texts are
    shuffled once, by run; the second window finds its rows where the first left them."""
    words = band(docs)
    some = listed(words, MAX_LEXICON + 1)
    w = Window.partitionBy("run").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    a = neighbours(docs).withColumn("next_text", F.lead("text").over(w)).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    a = a.withColumn("edited", F.when(F.col("guest") == 0, F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))).otherwise(F.lit("")))
    b = a.select("run", "guest", "doc_id", "tie", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), terms(F.col("text")).alias("t"), terms(F.col("edited")).alias("e"), F.xxhash64("edited").alias("e_hash"))
    b = b.withColumns({"t": F.when(F.size("t") > 0, F.col("t")).otherwise(F.array("tie")), "e": F.when(F.size("e") > 0, F.col("e")).otherwise(F.array("e_hash"))})
    b = b.withColumns({"t": selected("t", some), "e": selected("e", some)}) if len(some) <= MAX_LEXICON else joined(b, words, ["t", "e"])
    c = b.select("run", "guest", "doc_id", "tie", "n_chars", "edited_sha256", fingerprint("t").alias("fingerprint"), fingerprint("e").alias("edited_fingerprint"))
    c = c.withColumn("next_fingerprint", F.lead("fingerprint").over(w)).filter("guest = 0")
    return c.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def op9_imatch(spark, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))
