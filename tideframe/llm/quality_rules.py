"""Quality rules: base counts and divergence from language references, in DataFrame expressions only.

A document's histogram over character classes and its histogram over common words are compared with references of its
language by Jensen-Shannon distance. References are means over all documents of the language with enough words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm.common import documents, stage, text_of

# Common words of each language.
COMMON_WORDS = {
    "de": "als auf aus bei dem den der des die ein eine einen für ist mit nicht sich und von zu".split(),
    "en": "a and are as at be by for from in is it of on or that the this to was with".split(),
    "es": "al como con de del el en es la las lo los más no para por que se su un una y".split(),
    "fr": "avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une".split(),
}
#: Stands for a language without a word list of its own.
OTHER = "*"
_SPACE = r"[\x20\x09-\x0D]+"
# Characters that count as symbols.
_SYMBOLS = r"[#*$%&|<>]"
#: Character classes besides "other"; each is a pattern of runs.
_CLASSES = {"lower": r"[\p{Ll}\p{Lo}\p{Lm}]+", "upper": r"[\p{Lu}\p{Lt}]+", "digit": r"\p{N}+", "stop": r"[.,;:!?'\"()-]+", "symbol": r"[#*$%&|<>]+"}


def with_repeat_words(df: DataFrame, words: str, to: str) -> DataFrame:
    """Add the number of words covered by 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash. Only texts whose windows aren't all different are sorted.
    """
    w, n = F.col(words), F.size(words)
    hashes = F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))))
    df = df.withColumn("_h", hashes)
    df = df.withColumn("_ordered", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.zip_with(F.col("_ordered"), F.slice("_ordered", 2, F.size("_ordered")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_starts", F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(i, i + 1, i + 2)))))
    return df.withColumn(to, F.when(F.col("_ordered").isNull(), 0).otherwise(covered).cast("long")).drop("_h", "_ordered", "_starts")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms that each sum to 1."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts and histograms of each document."""
    text = text_of(text_col)
    lang = F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col)).otherwise(F.lit(OTHER)) if lang_col in docs.columns else F.lit(OTHER)
    base = docs.select(F.col(id_col), text.alias("text"), lang.alias("ref"), F.array_remove(F.split(text, _SPACE), "").alias("words"))
    vocabulary = sorted(set(reduce(lambda a, b: a + b, COMMON_WORDS.values())))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D.,;:!?]+"), lambda w: w.isin(*vocabulary))
    base = with_repeat_words(base, "words", "n_repeat_words").select(id_col, "ref", "n_repeat_words", F.size("words").cast("long").alias("n_words"), F.array_join("words", "").alias("joined"), lines.alias("lines"), F.concat(F.lit("<"), F.array_join(common, "><"), F.lit(">")).alias("common"))
    length = F.length("joined")
    classes = [length - F.length(F.regexp_replace("joined", pattern, "")) for pattern in _CLASSES.values()]
    occurrences = [((F.octet_length("common") - F.octet_length(F.replace("common", F.lit(f"<{w}>"), F.lit("")))) / len(f"<{w}>".encode())).cast("long") for w in vocabulary]
    counted = base.select(
        id_col,
        "ref",
        "n_words",
        length.cast("long").alias("word_chars"),
        F.array(*classes).alias("_classes"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*occurrences).alias("_common"),
    )
    # Splitting at punctuation can find more common words than there are words.
    counted = counted.withColumn("_known", F.aggregate("_common", F.lit(0).cast("long"), lambda s, x: s + x)).withColumn("_all", F.greatest("n_words", "_known"))
    rest = F.col("word_chars") - F.aggregate("_classes", F.lit(0).cast("long"), lambda s, x: s + x)
    return counted.select(
        id_col, "ref", "n_words", "word_chars",
        F.col("_classes")[list(_CLASSES).index("symbol")].cast("long").alias("n_symbols"),
        "n_dup_lines", "n_repeat_words",
        F.when(F.col("word_chars") > 0, F.transform(F.concat("_classes", F.array(rest)), lambda x: x / F.col("word_chars"))).alias("chars"),
        F.when(F.col("_all") > 0, F.transform(F.concat("_common", F.array(F.col("_all") - F.col("_known"))), lambda x: x / F.col("_all"))).alias("common"),
    )


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, guard_words: int = 100, max_char_distance: float = 0.3, max_word_distance: float = 0.6, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated 3-word windows. Of the
    rest, a document of at least guard_words words is dropped when either distance from its language's reference is
    over the limit; shorter ones are kept, because their histograms say little. A null or unknown language is held
    against the mean over all languages. Null and empty texts have zero counts, null distances and fail the base.
    Repeated rows are judged each. References come from documents that pass the base; without any, distances are null
    and nothing more is dropped. An empty table gives an empty result. Other columns are not read.
    """
    m = stage(measures(docs, id_col, text_col, lang_col), "measures")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    m = m.withColumn("base_failed", failed)

    def reference(g) -> DataFrame:
        bins = lambda c, n: F.array(*(F.avg(F.col(c)[i]) for i in range(n)))
        n_common = len(set(reduce(lambda a, b: a + b, COMMON_WORDS.values()))) + 1
        return g.agg(bins("chars", len(_CLASSES) + 1).alias("ref_chars"), bins("common", n_common).alias("ref_common"))

    sound = m.where(~F.col("base_failed") & (F.col("n_words") >= guard_words))
    by_lang = reference(sound.where(F.col("ref") != OTHER).groupBy("ref"))
    overall = reference(sound).select(F.lit(OTHER).alias("ref"), "ref_chars", "ref_common")
    references = by_lang.unionByName(overall)  # one row for each language of COMMON_WORDS at most, and one more
    judged = m.join(F.broadcast(references), "ref", "left").withColumn("char_distance", js_distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", js_distance(F.col("common"), F.col("ref_common")))
    far = (F.col("n_words") >= guard_words) & ((F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance")


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
