"""Quality rules: base counts of a text, and its divergence from language references.

A text is described by two histograms: its characters by class, and its words by a
fixed list of common words (all others together). The references are the same
histograms summed over all documents of a language. The verdict compares by the
Jensen-Shannon divergence (base 2), with the closest language; each histogram counts
only above a minimum length, for a short text has no distribution to speak of.

Languages without a list get one from the table: the words that most of their documents
hold. Their documents are judged by the words of their own language only, and not at all
by words while it has too few documents for a reference.

All of it is column expressions inside one pass over the documents, and one small
aggregation (a row for each language); documents of unlisted languages are read again
for their words. Windows of eight words are compared by their 64-bit hash, inside one text.

Defined results: a null text has no words, so it fails the base rules; a null language
has no reference words, so its documents are judged by their characters only, with the
closest listed language; without any reference no text is rejected by divergence;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_climbs.llm import words
from spark_climbs.materialize import materialize

#: Common words by language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich für ist",
    "en": "the of and to in a is that for it with on",
    "es": "de la que el en y a los se del las por",
    "fr": "de la le et les des en un du une est pour",
}
#: Characters by class; white space is what is not in a word, and the rest are letters.
CLASSES = {
    "upper": "\\p{Lu}",
    "digit": "\\p{Nd}",
    "stop": "[.,;:'\"()-]",
    "symbol": "[#*$%&|<>!?=+/@^~_\\[\\]{}\\\\]",
}
#: Most characters, of none of the counted classes; taken out before counting.
PLAIN = "[a-z\\x20\\x09-\\x0D]+"
WINDOW, MIN_WORDS, MAX_REPEATED_PCT = 8, 20, 30
#: Lengths from which the histograms count, and the divergences that reject.
MIN_CHARS, MIN_COMMON = 100, 60
MAX_CLASS_DIVERGENCE, MAX_WORD_DIVERGENCE = 0.06, 0.08
#: Common words found for an unlisted language, and the documents that it takes.
FOUND_WORDS, MIN_DOCUMENTS = 12, 30

VOCABULARY = sorted({w for listed in COMMON_WORDS.values() for w in listed.split()})


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paired(keys: Column, gap: int) -> Column:
    """Hash of every element with the one ``gap`` places on."""

    def pairs(k: Column) -> Column:
        n = F.greatest(F.size(k) - gap, F.lit(0))
        return F.zip_with(F.slice(k, F.lit(1), n), F.slice(k, F.lit(1 + gap), n), lambda x, y: F.xxhash64(x, y))

    return _let(keys, pairs)


def _unique(keys: Column) -> Column:
    return F.size(F.array_distinct(keys)) == F.size(keys)


def _covered(keys: Column, size: int) -> Column:
    """Number of places inside windows whose key occurs twice or more."""

    def among(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda k, x: F.get(s, k)["h"] == x["h"]
        twin = F.transform(s, lambda x, k: F.when(((k > 0) & same(k - 1, x)) | ((k < last) & same(k + 1, x)), x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

        def step(a: Column, i: Column) -> Column:
            n = a["n"] + i + size - F.greatest(a["end"], i)
            return F.struct(n.cast("int").alias("n"), (i + size).cast("int").alias("end"))

        return F.aggregate(F.sort_array(F.array_compact(twin)), start, step, lambda a: a["n"].cast("long"))

    placed = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(_unique(keys), F.lit(0).cast("long")).otherwise(_let(placed, among))


def repeated_words(of: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the array. Keys of
    four words come first: while they are all different, so are those of eight."""
    none = F.lit(0).cast("long")
    eight = lambda k: F.when(_unique(k), none).otherwise(_let(_paired(k, 4), lambda e: _covered(e, WINDOW)))
    return F.when(F.size(of) <= WINDOW, none).otherwise(_let(_paired(_paired(of, 1), 2), eight))


def _char_counts(text: Column, word_chars: Column) -> Column:
    """Characters of every class, then white space, then the rest."""

    def rare(rest: Column) -> Column:
        each = [F.regexp_count(rest, F.lit(pattern)) for pattern in CLASSES.values()]
        return F.array(*each, F.length(text) - word_chars, word_chars - reduce(lambda a, b: a + b, each))

    return _let(F.regexp_replace(text, PLAIN, ""), rare)


def _word_counts(of: Column) -> Column:
    """Array with the count of every common word, the other words last."""
    known = F.filter(of, lambda w: w.isin(*VOCABULARY))
    each = lambda sel: F.array(*[F.size(sel) - F.size(F.array_remove(sel, w)) for w in VOCABULARY])
    return _let(known, lambda sel: F.concat(each(sel), F.array(F.size(of) - F.size(sel))))


def measure(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__q``: the base counts and both histograms."""
    text, of = words.whole(F.col("text")), F.col("__w")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(words.WORD))
    cut = documents.withColumn("__w", words.words(F.col("text"))).withColumn("__c", F.length(F.array_join(of, "")))
    return cut.withColumn(
        "__q",
        F.struct(
            F.size(of).cast("long").alias("n_words"),
            F.col("__c").cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(of).alias("n_repeat_words"),
            _char_counts(text, F.col("__c")).alias("classes"),
            _word_counts(of).alias("common"),
        ),
    ).drop("__w", "__c")


def references(measured: DataFrame) -> list[dict]:
    """The histograms of each listed language, over all documents: at most as many rows
    as ``COMMON_WORDS`` has languages."""
    n_classes, n_words = len(CLASSES) + 2, len(VOCABULARY) + 1
    sums = measured.filter(F.col("lang").isin(*COMMON_WORDS)).groupBy("lang").agg(
        F.array(*[F.sum(F.col("__q.classes")[i]) for i in range(n_classes)]).alias("classes"),
        F.array(*[F.sum(F.col("__q.common")[i]) for i in range(n_words)]).alias("common"),
    )
    return [r.asDict() for r in sums.orderBy("lang").collect() if sum(r["common"]) > 0]


def found_references(others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measured documents of unlisted languages with ``__own``, the counts of their
    language's words, and a row for each such language: ``__lang`` and the histograms as
    shares (``__common`` is null for a language of too few documents)."""
    listed = F.explode(F.array_distinct(words.words(F.col("text")))).alias("word")
    held = others.select("lang", listed).groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = held.withColumn("place", place).filter(F.col("place") <= FOUND_WORDS)
    lists = top.groupBy(F.col("lang").alias("__lang")).agg(F.sort_array(F.collect_list("word")).alias("__list"))
    lists = materialize(lists, "common_words")

    def counts(of: Column) -> Column:
        each = [F.coalesce(F.size(of) - F.size(F.array_remove(of, F.get("__list", F.lit(k)))), F.lit(0)) for k in range(FOUND_WORDS)]
        return _let(F.array(*each), lambda x: F.concat(x, F.array(F.size(of) - F.aggregate(x, F.lit(0), lambda a, b: a + b))))

    counted = others.join(lists, F.col("lang") == F.col("__lang"), "left").withColumn("__own", _let(words.words(F.col("text")), counts))
    counted = counted.drop("__lang", "__list")

    def shares(column: str, n: int) -> Column:
        sums = F.array(*[F.sum(F.col(column)[k]).cast("double") for k in range(n)])
        return F.transform(sums, lambda x: F.try_divide(x, F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)))

    enough = lambda x: F.when(F.count("*") >= MIN_DOCUMENTS, x)
    own = counted.groupBy(F.col("lang").alias("__lang")).agg(
        shares("__q.classes", len(CLASSES) + 2).alias("__classes"), enough(shares("__own", FOUND_WORDS + 1)).alias("__common")
    )
    return counted, materialize(own, "references")


def divergence(counts: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon divergence in bits of a histogram (an array) from a reference (of
    counts, or a column of shares)."""
    if isinstance(reference, Column):
        q = reference
    else:
        whole = sum(reference)
        q = F.array(*[F.lit(x / whole) for x in reference])

    def against(total: Column) -> Column:
        def term(c: Column, b: Column) -> Column:
            a = c.cast("double") / total
            m = (a + b) / 2
            return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0)) + F.when(b > 0, b * F.log2(b / m)).otherwise(F.lit(0.0))

        return F.aggregate(F.zip_with(counts, q, term), F.lit(0.0), lambda s, x: s + x) / 2

    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(total > 0, _let(total, against)).otherwise(F.lit(0.0))


def _closest(found: list[Column]) -> Column:
    return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(0.0)


def judge(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__q`` (base counts), ``__base_failed``, ``__kept`` and both
    divergences. The texts are measured once, into a table."""
    measured = materialize(measure(documents), "measured")
    known = references(measured)
    q = F.col("__q")
    classes = [divergence(q["classes"], r["classes"]) for r in known]
    common = [divergence(q["common"], r["common"]) for r in known]
    unlisted = F.coalesce(~F.col("lang").isin(*COMMON_WORDS), F.lit(False))
    by_words = F.when(F.col("lang").isNotNull(), _closest(common)).otherwise(F.lit(0.0))
    out = measured.filter(~unlisted).withColumns({"__class_divergence": _closest(classes), "__word_divergence": by_words})
    others = measured.filter(unlisted)
    if not others.isEmpty():
        counted, own = found_references(others)
        counted = counted.join(own, F.col("lang") == F.col("__lang"), "left")
        by_words = F.coalesce(divergence(F.col("__own"), F.col("__common")), F.lit(0.0))
        by_classes = _closest([*classes, divergence(q["classes"], F.col("__classes"))])
        counted = counted.withColumns({"__class_divergence": by_classes, "__word_divergence": by_words})
        out = out.unionByName(counted.select(*out.columns))
    base = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PCT * q["n_words"])
    odd = ((q["word_chars"] >= MIN_CHARS) & (F.col("__class_divergence") > MAX_CLASS_DIVERGENCE)) | (
        (q["n_words"] >= MIN_COMMON) & (F.col("__word_divergence") > MAX_WORD_DIVERGENCE)
    )
    return out.withColumns({"__base_failed": base, "__kept": ~base & ~odd})


def verdicts(documents: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` of every document."""
    counts = [f"__q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    judged = judge(documents.select("doc_id", "lang", "text"))
    return judged.select("doc_id", *counts, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def accepted(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    inner, outer = words.carried(documents, "lang", "text")
    return outer(judge(inner).filter("__kept"))
