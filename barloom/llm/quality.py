"""Quality rules by distribution divergence, in DataFrame functions alone.

A text's histograms of character classes and of its language's common words
are compared with the language's reference by Jensen-Shannon distance (base 2,
0 to 1). A reference is the sum of the histograms of all texts of the language
that pass the base rules.

The fewer words a text has, the further its word histogram lies from the
reference by chance alone: the square of the distance falls as 1 / words. So the
word cut is a curve, square > WORD_SQUARE + WORD_NOISE / n_words, for every text
that passes the base rules. Its two numbers were chosen by the quality labels of
sf0.1 (3,534 texts that pass the base rules) among the curves that reject no
text labelled good there, and then by those of check_s; check_l had no part in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import JAVA_SPACE, settle, words_column

# Common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "be", "by", "as", "are", "this", "from", "or", "an", "at", "not", "have"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "il"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como", "más", "pero", "o"],
}
SYMBOLS = "#*$%&|<>"
#: Words below which the base rule fails a text; share of its words in repeated 3-word windows beyond which it does.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Characters that a class histogram needs; class distance beyond which a text is rejected; the curve of the word distance.
LEAST_CHARS, MOST_CLASS_DISTANCE = 300, 0.28
WORD_SQUARE, WORD_NOISE = 0.036, 5.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = F.size(words)

    def marked(hashes: Column) -> Column:
        s = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])))
            places = F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
            return F.aggregate(places, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(s, covered))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0).cast("bigint")).otherwise(let(hashes, marked))


# Character classes and how their runs are found in a text without small letters.
CLASSES = ["small", "capital", "digit", "space", "point", "symbol", "other"]
CLASS_PATTERNS = {"capital": "[A-Z]+", "digit": "[0-9]+", "space": JAVA_SPACE + "+", "point": "[.,;:!?'\"()\\[\\]\\-/]+", "symbol": "[#*$%&|<>{}=+_\\\\^~`@]+"}


def _class_sizes(text: Column, rest: Column) -> dict[str, Column]:
    """Characters of each class; rest is text without small letters."""
    left = F.length(rest)
    out = {c: left - F.length(F.regexp_replace(rest, p, "")) for c, p in CLASS_PATTERNS.items()}
    out["small"] = F.length(text) - left
    out["other"] = F.length(text) - sum(out.values(), F.lit(0))
    return out


def _common(text: Column, lang: Column) -> Column:
    """Counts of the language's common words, in the list's order, then of all other pieces between punctuation; null without a list."""
    plain = F.split(F.lower(text), "[\\x20\\x09-\\x0D.,;:!?'\"()\\[\\]\\-/]+")

    def of(listed: list[str]) -> Callable[[Column], Column]:
        rest = lambda words, c: F.concat(c, F.array((F.size(words) - F.aggregate(c, F.lit(0.0), lambda a, v: a + v)).cast("double")))
        return lambda words: let(_counts(words, listed), lambda c: rest(words, c))

    def chosen(words: Column) -> Column:
        out = F.lit(None).cast("array<double>")
        for name, listed in COMMON_WORDS.items():
            out = F.when(lang == name, of(listed)(words)).otherwise(out)
        return out

    return F.when(lang.isin(*COMMON_WORDS), let(plain, chosen))


def _counts(words: Column, listed: list[str]) -> Column:
    """How often each listed word occurs, by one pass over the sorted places of those found."""
    places = F.array(*map(F.lit, listed))
    found = F.sort_array(F.transform(F.filter(words, lambda w: w.isin(listed)), lambda w: F.array_position(places, w).cast("int")))
    none = F.array().cast("array<double>")

    def flush(a: Column, x: Column) -> Column:
        return F.concat(a["counts"], F.when(a["last"] > 0, F.array(a["run"])).otherwise(none), F.array_repeat(F.lit(0.0), x - a["last"] - 1))

    def step(a: Column, x: Column) -> Column:
        same = F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["counts"].alias("counts"))
        return F.when(x == a["last"], same).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("run"), flush(a, x).alias("counts")))

    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("run"), none.alias("counts"))
    return F.aggregate(F.concat(found, F.array(F.lit(len(listed) + 1))), start, step, lambda a: a["counts"])


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length; null if either is null or empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def between(t: Column) -> Column:
        def part(x: Column, y: Column) -> Column:
            a, b = x / t[0], y / t[1]
            half = lambda u: F.when(u > 0, u * F.log2(2 * u / (a + b))).otherwise(0.0)
            return (half(a) + half(b)) / 2

        return F.sqrt(F.greatest(total(F.zip_with(p, q, part)), F.lit(0.0)))

    return F.when((total(p) > 0) & (total(q) > 0), let(F.array(total(p), total(q)), between))


def measures(docs: DataFrame) -> DataFrame:
    """docs with the base measures, base_failed and the two histograms."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.withColumns({"__words": words_column(F.col("text")), "__lines": lines, "__rest": F.regexp_replace(text, "[a-z]+", "")})
    sizes = _class_sizes(text, F.col("__rest"))
    rows = rows.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "classes": F.array(*(sizes[c].cast("double") for c in CLASSES)),
            "n_symbols": (F.length("__rest") - F.length(F.regexp_replace("__rest", f"[{SYMBOLS}]+", ""))).cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": repeat_words(F.col("__words")),
            "common": _common(text, F.col("lang")),
        }
    )
    total = F.aggregate("classes", F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("word_chars", (total - F.col("classes")[CLASSES.index("space")]).cast("bigint"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rows.drop("__words", "__lines", "__rest").withColumn("base_failed", failed)


def judged(docs: DataFrame) -> DataFrame:
    """(rid: hash of doc_id, text and lang, doc_id, lang, the base measures, base_failed, class_distance, word_distance, kept).

    docs needs doc_id, text and lang. Null and empty texts have no words and
    fail the base rules. Rows of a null or unlisted language are compared by
    character classes alone, null languages with each other. Distances are null
    where a histogram is empty; a text below LEAST_CHARS is compared by words alone.
    """
    own = docs.select(_rid(docs).alias("rid"), docs["doc_id"], docs["text"], docs["lang"].cast("string").alias("lang"))
    rows = settle(measures(own).drop("text"), "quality")
    passed = rows.where(~F.col("base_failed"))
    sums = lambda c, n: F.when(F.count(c) > 0, F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n))))
    longest = max(map(len, COMMON_WORDS.values())) + 1
    reference = passed.groupBy("lang").agg(sums("classes", len(CLASSES)).alias("ref_classes"), sums("common", longest).alias("ref_common"))
    both = rows.join(F.broadcast(reference.withColumnRenamed("lang", "ref_lang")), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    out = both.withColumns({"class_distance": distance(F.col("classes"), F.col("ref_classes")), "word_distance": distance(F.col("common"), F.col("ref_common"))})
    chars = F.aggregate("classes", F.lit(0.0), lambda a, v: a + v)
    odd = ((chars >= LEAST_CHARS) & (F.col("class_distance") > MOST_CLASS_DISTANCE)) | (F.pow("word_distance", F.lit(2)) > WORD_SQUARE + WORD_NOISE / F.greatest("n_words", F.lit(1)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def _rid(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"], docs["lang"].cast("string"))


def good_rows(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, without the rows that judged() rejects."""
    gone = judged(docs).where(~F.col("kept")).select(F.col("rid").alias("__gone")).distinct()
    return docs.join(gone, _rid(docs) == F.col("__gone"), "left_anti")
