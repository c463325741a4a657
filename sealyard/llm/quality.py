"""Quality rules: countable faults of a text, and how much it reads like trusted text.

Likelihood ratio: texts become hashed features (words, pairs of neighbouring words, and the last characters
of both). One multinomial over the hash buckets is estimated from trusted documents and one from all
documents; a document's score is the mean over its features of log(trusted / all), and a document is kept
when it breaks no base rule and its score reaches a fixed threshold. Everything is Column expressions.

Every row gets one result row. A NULL or empty text has no words and fails the base rules; equal texts get
equal results; a repeated id is scored row by row; an empty table gives an empty result. Columns of the
input that are named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.llm.common import SPACE, table, without

#: Hash buckets of the two multinomials, a power of two.
BUCKETS = 16384
#: Trusted documents that the target multinomial is estimated from, at most.
TRUSTED = 8192
#: Mean log ratio per feature below which a document does not read like trusted text.
THRESHOLD = -0.35
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, also where a lambda uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words between white space; empty for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+")
    # Only the first and the last part can be empty.
    return F.array_remove(parts, "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more.

    Windows are sorted by 32 bits of hash and 32 bits of position, as plain longs; only those whose hash
    bits meet a neighbour's are compared as text.
    """

    def place(bits: Column) -> Column:
        return bits.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def alike(bits: Column) -> Column:
        following = F.slice(bits, 2, F.size(bits))
        first = F.array_compact(F.zip_with(bits, following, lambda x, y: F.when(_same_hash(x, y), x)))
        second = F.array_compact(F.zip_with(bits, following, lambda x, y: F.when(_same_hash(x, y), y)))
        return _let(first, lambda f: F.when(F.size(f) == 0, f).otherwise(F.array_union(f, second)))

    def starts(w: Column) -> Column:
        def window(i: Column) -> Column:
            return F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

        bits = F.transform(
            F.slice(w, 1, F.size(w) - 2),
            lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), 32).bitwiseOR(i.cast("bigint")),
        )
        candidates = F.transform(
            _let(F.sort_array(bits), alike),
            lambda x: _let(place(x), lambda i: F.struct(window(i).alias("g"), i.alias("i"))),
        )
        return _let(
            F.sort_array(candidates),
            lambda c: F.sort_array(
                F.transform(
                    F.filter(
                        c,
                        lambda x, j: x["g"].eqNullSafe(F.get(c, j - 1)["g"]) | x["g"].eqNullSafe(F.get(c, j + 1)["g"]),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(s: Column) -> Column:
        return F.aggregate(
            F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        )

    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(
        _let(words, lambda w: _let(starts(w), covered))
    )


def _same_hash(x: Column, y: Column) -> Column:
    return F.shiftrightunsigned(x.bitwiseXOR(y), 32) == 0


def base_rules(df: DataFrame, text: str = "text", more: list[Column] = ()) -> DataFrame:
    """``df`` with the counts of the base rules and ``base_failed``; ``more`` columns may use ``_words``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    t = F.coalesce(F.col(text), F.lit(""))
    # The blank rule keeps lines that hold anything but white space.
    lines = F.filter(F.split(t, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    counted = without(df, [*names, "_words", "_lines"]).select("*", words_of(t).alias("_words"), lines.alias("_lines"))
    counted = counted.select(
        "*",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        *more,
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed")).drop("_words", "_lines")


def _buckets(x: Column, following: Column, buckets: int) -> list[Column]:
    """Buckets of the features at a word: the word, it with the next one, and the last characters of both."""

    def end(y: Column) -> Column:
        return F.substring(y, -2, 2)

    hashes = [F.xxhash64(x), F.xxhash64(x, following), F.xxhash64(end(x), end(following), F.lit(1))]
    return [h.bitwiseAND(F.lit(buckets - 1)).cast("int") for h in hashes]


def trusted_sample(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids of at most ``limit`` documents labelled good, spread by a hash of the id; fewer if fewer are."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return good.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_ratio(df: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(trusted / all) of each bucket, from all rows of ``df`` and those whose id is in ``trusted``.

    Only one row per bucket reaches the driver. ``trusted`` is a bounded sample and is broadcast.
    """
    marked = F.broadcast(trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")))
    counts = (
        df.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        .join(marked, "_id", "left")
        .select(F.coalesce("_good", F.lit(0)).alias("good"), words_of(F.col("_text")).alias("w"))
        .select("good", "w", F.posexplode("w").alias("i", "x"))
        .select("good", F.explode(F.array(*_buckets(F.col("x"), F.get("w", F.col("i") + 1), buckets))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("good").alias("good"))
        .collect()
    )
    import math

    total, good = sum(r.n for r in counts), sum(r.good for r in counts)
    if not good:
        return [0.0] * buckets
    seen = {r.bucket: (r.good, r.n) for r in counts}

    def ratio(b: int) -> float:
        g, n = seen.get(b, (0, 0))
        return math.log((g + 0.5) / (good + 0.5 * buckets)) - math.log((n + 0.5) / (total + 0.5 * buckets))

    return [ratio(b) for b in range(buckets)]


def score_ratio(df: DataFrame, weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``base_rules`` of ``df`` with ``ratio_score`` and ``kept``."""
    # One literal of the plan: the text is folded into an array of doubles while planning.
    table_of = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    def mean(words: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            one, two, three = _buckets(x, F.get(words, i + 1), len(weights))
            return F.get(table_of, one) + F.get(table_of, two) + F.get(table_of, three)

        total = F.aggregate(F.transform(words, at), F.lit(0.0), lambda a, x: a + x)
        return total / F.greatest(3 * F.size(words), F.lit(1))

    ratio = _let(F.col("_words"), mean).alias("ratio_score")
    scored = base_rules(without(df, ["ratio_score", "kept"]), more=[ratio])
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio_score") >= threshold))


def rate_quality(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the base counts, ``ratio_score`` and ``kept``, fitted to ``df`` and its labels."""
    return score_ratio(df, fit_ratio(df, trusted_sample(labels)), threshold)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = rate_quality(documents, table(spark, sf_dir, "labels"))
    return rated.drop("text")


QUERIES = {"op2_quality_rules": op2_quality_rules}
