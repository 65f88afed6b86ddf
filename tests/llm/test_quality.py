import math
import re
from collections import Counter, defaultdict

import pytest

from loamwork.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    repeat = len(covered)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(words) < 10 or 100 * repeat > 20 * len(words)


def histograms(text, lang):
    text = text or ""
    kinds = [lambda c: c.isupper(), lambda c: c in "0123456789", lambda c: c in " \t\n\x0b\x0c\r", lambda c: c in ".,;:!?'\"()-", lambda c: c in "#*$%&|<>@/\\[]{}^~`_+="]
    classes = [sum(map(k, text)) for k in kinds]
    listed = quality.COMMON.get(lang, [])
    common = Counter(w.lower() for w in WORD.findall(text) if w.lower() in listed)
    bins = [common[w] for w in listed] or [0] * len(quality.COMMON["en"])
    return [*classes, len(text) - sum(classes)], [*bins, len(WORD.findall(text)) - sum(common.values())]


def shares(counts):
    total = max(sum(counts), 1)
    return [math.floor(1000000.0 * x / total) for x in counts]


def distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    return math.sqrt(max(0.0, sum((a * math.log2(2 * a / (a + b)) if a else 0.0) + (b * math.log2(2 * b / (a + b)) if b else 0.0) for a, b in zip(p, q, strict=True)) / 2))


def brute(rows):
    """doc_id, the base counts, kept, and the two distances, of (doc_id, text, lang)."""
    lim = quality.LIMITS
    lang_of = lambda x: x if x in quality.COMMON else None
    full = [(i, base(t), lang_of(lang), len(t or ""), *histograms(t, lang_of(lang))) for i, t, lang in rows]
    refs = defaultdict(lambda: [[0] * 6, [0] * (len(quality.COMMON["en"]) + 1)])
    for _, b, lang, n, c, w in full:
        if not b[5] and n >= lim["min_chars"] and b[0] >= lim["min_words"]:
            for key in {lang, None}:
                refs[key] = [[x + y for x, y in zip(a, s, strict=True)] for a, s in zip(refs[key], (shares(c), shares(w)), strict=True)]
    out = []
    for i, b, lang, n, c, w in full:
        ref = refs.get(lang)
        d = (distance(c, ref[0]), distance(w, ref[1])) if ref else (0.0, 0.0)
        far = n >= lim["min_chars"] and d[0] > lim["max_class_distance"] or lang is not None and b[0] >= lim["min_words"] and d[1] > lim["max_word_distance"]
        out.append((i, *b, not b[5] and not far, *d))
    return out


def close(got, want):
    key = lambda r: (str(r[0]), r[1:8])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:8]) == tuple(w[:8])
        assert g[8] == pytest.approx(w[8], abs=1e-9) and g[9] == pytest.approx(w[9], abs=1e-9)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = brute(rows)
    close([tuple(r) for r in quality.op10_quality_rules(spark, folder).collect()], want)
    assert 0.5 < sum(w[7] for w in want) / len(want) < 1


ODD = [
    (1, None, "en"), (1, None, "en"), (2, "", "en"), (3, " \t\n", "de"), (4, "a b c d e " * 3, "en"), (5, "a b c d e f g h i j a b c d e k l m n o p q r s t u v w x y z", "en"),
    (6, "x\x1cy\xa0z\x85q " * 12, None), (7, "line one\nline one\n\n \nline two\r\nline two\r", "xx"), (None, "the of and to in a is that for it was on with as by be at this from or an are", "en"),
    (8, "# * $ % & | < > " * 9, "fr"), (9, "The quick, brown fox; it is 12 years old. " * 2 + "And then it ran away from all the other dogs of the town", "en"), (10, "ÉCOLE Straße 𝔘 ²" * 30, "fr"), (11, "b b b b b b b b b b", "es"),
]


def test_odd_rows(spark, docs, as_table):
    rows = docs(*((i, t, lang, "s") for i, t, lang in ODD))
    want = brute(ODD)
    close([tuple(r) for r in quality.op10_quality_rules(spark, as_table(rows)).collect()], want)
    kept = quality.quality_filter(rows.withColumnRenamed("source", "q_text").withColumnRenamed("n_chars", "q_row"))
    assert kept.columns == ["doc_id", "text", "lang", "q_text", "q_row"]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for (i, t, _), w in zip(ODD, want, strict=True) if w[7])


def test_empty(spark, docs, as_table):
    none = docs((1, "a")).limit(0)
    assert quality.op10_quality_rules(spark, as_table(none)).count() == 0 and quality.quality_filter(none).count() == 0


def test_native(spark):
    plan = quality.op10_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
