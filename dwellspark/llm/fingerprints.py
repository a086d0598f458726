"""Document fingerprints: bottom-k sketches of shingle hashes, by column functions alone.

A sketch is the sorted array of the k smallest distinct hashes of a text's word shingles. Sketches of
parts merge into the sketch of the whole (smallest k of both), and estimate how many distinct shingles
there are, how alike two sets are and how far one holds the other.

The edited text of a document takes its end from the next document in descending id order. Documents go to
id ranges (cut at approximate quantiles of the ids) with one shuffle; within a range the next document is the
one before in a sorted window, and the largest document of each range is also sent to the range above.

Defined results: null and empty texts have an empty sketch and the fingerprint ''; two empty sketches
are alike (1.0), an empty and another are not (0.0); fewer words than a shingle are one shingle; rows with the
same id follow one another by text, and the next of each is the row that follows; a null id comes last, after
the smallest; the next of the last row is the first; with one row it is its own next; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dwellspark.llm.common import cut

BLANKS = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once: inside a lambda Spark would compute it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """Hashes of all n-word shingles of a text; fewer words are one shingle."""
    words = F.filter(F.split(F.translate(text, _UPPER, _LOWER), BLANKS), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n)))))


def sketch(text: Column, k: int = 128, n: int = 5) -> Column:
    """The k smallest distinct shingle hashes, in order."""
    return F.slice(F.array_sort(F.array_distinct(shingle_hashes(text, n))), 1, k)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """Sketch of the union of two sets from their sketches."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = 128) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the place of the k-th hash."""
    place = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / place)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold."""
    both = _let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of a's shingles that b holds."""
    together = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), together / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    """The sketch as a string: hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def sketch_of_parts(parts: DataFrame, by: str, column: str = "sketch", k: int = 128) -> DataFrame:
    """Merged sketch of each group of parts: its k smallest distinct hashes, ranked and cut before the shuffle."""
    each = parts.select(by, F.explode(column).alias("h")).distinct()
    kept = each.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy("h"))).where(F.col("r") <= k)
    return kept.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias(column))  # k hashes a group at most


def _cuts_below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts lie below a value: among every n-th of them first, then in the n that follow."""
    n = max(1, round(len(cuts) ** 0.5))
    count = lambda among: F.size(F.filter(among, lambda b: b < value))
    some, every = (F.lit(c).cast("array<bigint>") for c in (cuts[::n], cuts))
    return F.when(value.isNull(), None).otherwise(_let(count(some), lambda c: F.when(c == 0, 0).otherwise((c - 1) * n + count(F.slice(every, (c - 1) * n + 1, n)))))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in descending id order."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] or []
    placed = rows.withColumn("range", F.coalesce(_cuts_below(sorted(set(cuts)), F.col("doc_id")) + 1, F.lit(0)))  # a null id lies below all others
    tops = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max(F.struct("doc_id", F.xxhash64("text").alias("x"))).alias("top")).collect()}  # a row a range
    order = sorted(tops)
    # The first document of each range follows the last one of the range above; that of the highest follows the lowest's last.
    to = F.create_map(*[F.lit(v) for i, r in enumerate(order) for v in (r, order[(i + 1) % len(order)])]) if order else F.create_map(F.lit(0), F.lit(0))
    top = F.create_map(*[v for r in order for v in (F.lit(r), F.struct(F.lit(tops[r]["doc_id"]).cast("long").alias("doc_id"), F.lit(tops[r]["x"]).alias("x")))]) if order else None
    if top is None:
        return rows.withColumn("next_text", F.lit(""))
    is_top = F.coalesce(F.col("doc_id"), F.lit(0)).eqNullSafe(F.coalesce(top[F.col("range")]["doc_id"], F.lit(0))) & (
        F.xxhash64("text") == top[F.col("range")]["x"])
    sent = placed.withColumn("send", F.explode(F.when(is_top, F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")),
                                                                      F.struct(to[F.col("range")].alias("at"), F.lit(True).alias("guest"))))
                                               .otherwise(F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest"))))))
    w = W.partitionBy("send.at").orderBy("send.guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))
    return sent.withColumn("next_text", F.lead("text").over(w)).where(~F.col("send.guest")).select("doc_id", "text", "next_text")


def fingerprint_report(docs: DataFrame, k: int = 128, n: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 2) AS INT))"),
                      F.expr("substring(next_text, 1, CAST(floor(length(text) / 2) AS INT))"))
    rows = with_next(docs).withColumn("edited", F.when(half == 0, F.col("text")).otherwise(edited))
    made = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       sketch(F.col("text"), k, n).alias("a"), sketch(F.col("edited"), k, n).alias("b"), sketch(F.col("next_text"), k, n).alias("c"))
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
                       resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("c"), k).alias("near_next"),
                       distinct_shingles(F.col("a"), k).alias("distinct_shingles"), containment(F.col("a"), F.col("b"), k).alias("held_by_edited"))
