"""Mixing sources to target weights, by column functions alone.

Source i holds the token share p_i; its weight is p_i^a / sum p_j^a. The exponent a is bisected to meet one
target: an entropy of the weights (in nats), or the most times that any source is repeated for each time the
least repeated one is. Exponents are tried 32 at a time: each round sums p^a over the table of sources and
narrows the bracket to one of its 32 parts.

Weights become a plan: source i is drawn for `budget * weight_i` tokens. Every full pass over the source (epoch) takes all of its
documents; the last, partial pass takes them in the order of a keyed digest until its budget is met. A
document belongs to the pass if its first token does, so each token budget is met within one document. Where that
document lies is found by opening digest ranges: sums over 1,024 ranges of a source, then over 1,024
ranges of the one that the budget ends in, then its rows. No source is sorted or held in one task.

Rows are dealt to blocks of about `block_tokens` by another digest, and have a place in the block, so reading
blocks in order gives a permutation in which every block has the mixture.

Defined results: a null source is a source of its own; documents without words weigh one token; repeated rows are
drawn each, rows that share id and source share the digest and are cut together by text; other columns are ignored; an empty table
gives an empty plan; with one source every target gives weight 1.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from dwellspark.llm.common import cut

STEPS = 32
ROUNDS = 6


def tokens_of(text) -> F.Column:
    """Words of a text, one at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1)).cast("long")


def solve_exponent(sources: DataFrame, target: str, value: float) -> float:
    """The exponent between 0 and 1 for which the weights meet the target.

    `sources` has the shares `p`. target "entropy": weights of that entropy (falling in a); "repeats": the most
    repeated source is drawn `value` times as often as the least (falling in a). A target out of reach gives
    the nearer end."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        tries = [lo + (hi - lo) * i / STEPS for i in range(STEPS + 1)]
        powered = sources.select("p", F.posexplode(F.array(*[F.lit(a) for a in tries])).alias("i", "a")).groupBy("i", "a").agg(
            F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.col("a") * F.log("p")).alias("s"),
            F.max(F.log("p") * (F.col("a") - 1)).alias("most"), F.min(F.log("p") * (F.col("a") - 1)).alias("least"))
        rows = powered.orderBy("i").collect()  # STEPS + 1 rows
        if not rows or rows[0]["z"] is None:
            return 1.0
        got = [math.log(r["z"]) - r["s"] / r["z"] if target == "entropy" else math.exp(r["most"] - r["least"]) for r in rows]
        above = [i for i, g in enumerate(got) if g >= value]
        if not above:
            return tries[0]
        i = above[-1]
        if i == STEPS:
            return tries[-1]
        lo, hi = tries[i], tries[i + 1]
    return round((lo + hi) / 2, 6)


def weights(docs: DataFrame, target: str = "repeats", value: float = 2.0, budget: float | None = None) -> DataFrame:
    """source, tokens, share, weight, quota (tokens to draw), epochs (full passes), rest (tokens of the partial pass).

    `budget` is in tokens; without one the least repeated source gets one full pass, so that no document is left out."""
    per = cut(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    total = per.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    shares = per.withColumn("p", F.col("tokens") / F.lit(float(total)))
    a = solve_exponent(shares, target, value)
    scale = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.max(F.pow("p", F.lit(1.0 - a))).alias("least")).first()
    z, least = scale["z"] or 1.0, scale["least"] or 1.0
    drawn = budget if budget is not None else total * z * least
    w = F.pow("p", F.lit(a)) / F.lit(z)
    quota = F.floor(w * F.lit(float(drawn)) * (1 + 1e-12) + 1e-6).cast("long")
    return (shares.select("source", "tokens", "docs", F.col("p").alias("share"), w.alias("weight"), quota.alias("quota"))
            .withColumn("epochs", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
            .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens")))


def _digit(key, at: int, n: int = 10):
    """`n` bits of a hexadecimal digest, from bit `at` of its first 60 on."""
    return F.shiftright(F.conv(F.substring(key, 1, 15), 16, 10).cast("long"), 60 - at - n).bitwiseAND(F.lit((1 << n) - 1))


def _opened(rows: DataFrame, level: str, left: str) -> DataFrame:
    """For each source, the range at `level` in which `left` tokens end, and what is left inside it."""
    sums = rows.groupBy("source", left, level).agg(F.sum("tokens").alias("t"))
    w = W.partitionBy("source").orderBy(level)  # 1,024 rows a source at most
    run = sums.withColumn("upto", F.sum("t").over(w)).withColumn("before", F.col("upto") - F.col("t"))
    return run.where((F.col("before") < F.col(left)) & (F.col("upto") >= F.col(left))).select(
        F.col("source").alias("o_source"), F.col(level).alias(f"o_{level}"), (F.col(left) - F.col("before")).alias(f"left_{level}"))


def plan(docs: DataFrame, table: DataFrame, seed: int = 7, block_tokens: int = 1_000_000) -> DataFrame:
    """One row a draw: doc_id, source, epoch, tokens, block, place. `docs` has doc_id, source, tokens and ord, which parts rows of one id."""
    key = lambda what: F.md5(F.concat_ws(":", F.lit(seed), F.lit(what), F.coalesce(F.col("source"), F.lit("?")), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    t = table.select(F.col("source").alias("t_source"), "epochs", "rest", "quota")
    joined = docs.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    full = joined.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("doc_id", "source", "tokens", "ord", "epoch")
    part = joined.where("rest > 0").withColumn("epoch", F.col("epochs") + 1).withColumn("key", key("rest")).withColumn("a", _digit("key", 0)).withColumn("b", _digit("key", 10))
    same = F.col("source").eqNullSafe(F.col("o_source"))
    first = _opened(part, "a", "rest")
    inside = part.join(first, same).drop("o_source")
    whole = inside.where("a < o_a").select("doc_id", "source", "tokens", "ord", "epoch")
    edge = inside.where("a = o_a").drop("o_a")
    second = _opened(edge, "b", "left_a")
    inner = edge.join(second, same).drop("o_source")
    whole2 = inner.where("b < o_b").select("doc_id", "source", "tokens", "ord", "epoch")
    w = W.partitionBy("source").orderBy("key", "doc_id", "ord").rowsBetween(W.unboundedPreceding, -1)  # a millionth of a source
    last = (inner.where("b = o_b").withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).where("before < left_b")
            .select("doc_id", "source", "tokens", "ord", "epoch"))
    drawn = full.union(whole).union(whole2).union(last)
    total = table.agg(F.sum("quota").alias("q")).first()["q"] or 0
    blocks = max(1, round(total / block_tokens))
    order = drawn.withColumn("key", key("order")).withColumn("block", (_digit("key", 0, 40) % F.lit(blocks)).cast("int"))
    place = F.row_number().over(W.partitionBy("block").orderBy("key", "doc_id", "source", "ord"))  # about block_tokens
    return order.withColumn("place", place).select("doc_id", "source", "epoch", "tokens", "block", "place", "ord")


def mixture(docs: DataFrame, target: str = "repeats", value: float = 2.0, budget: float | None = None, seed: int = 7,
            block_tokens: int = 1_000_000) -> DataFrame:
    """The drawn documents: doc_id, source, epoch, tokens, block and place."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", tokens_of(F.col("text")).alias("tokens"),
                           F.xxhash64("text").alias("ord")))
    return plan(rows, cut(weights(rows, target, value, budget)), seed, block_tokens).drop("ord")


def drawn_documents(docs: DataFrame, target: str = "repeats", value: float = 2.0, seed: int = 7) -> DataFrame:
    """The documents themselves, each as often as it is drawn and with its own columns."""
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", tokens_of(F.col("text")).alias("tokens"),
                           F.xxhash64("text").alias("ord")))
    drawn = plan(rows, cut(weights(rows, target, value)), seed).groupBy("doc_id", "source", "ord").agg(F.count("*").alias("n"))
    # Rows alike in id, source and text are drawn as a group; each of them gets its share of the draws.
    alike = rows.groupBy("doc_id", "source", "ord").agg(F.count("*").alias("m"))
    times = drawn.join(alike, (drawn["doc_id"].eqNullSafe(alike["doc_id"])) & drawn["source"].eqNullSafe(alike["source"]) & (drawn["ord"] == alike["ord"])).select(
        drawn["doc_id"].alias("d_id"), drawn["source"].alias("d_source"), drawn["ord"].alias("d_ord"), F.ceil(F.col("n") / F.col("m")).cast("int").alias("d_times"))
    ours = docs.join(times, docs["doc_id"].cast("long").eqNullSafe(F.col("d_id")) & docs["source"].eqNullSafe(F.col("d_source")) & (F.xxhash64(docs["text"]) == F.col("d_ord")))
    return ours.withColumn("d_times", F.explode(F.sequence(F.lit(1), F.col("d_times")))).select(*[docs[c] for c in docs.columns])


def mixture_sql(value: float = 2.0, seed: int = 7, block_tokens: int = 1_000_000) -> str:
    """The rows of `mixture` for the target "repeats" in DuckDB SQL; the exponent has a closed form there."""
    key = lambda what: f"md5({seed} || ':{what}:' || coalesce(source, '?') || ':' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '?'))"
    return f"""
    WITH d AS (SELECT doc_id, source, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS tokens FROM documents),
    p AS (SELECT source, sum(tokens) AS t, sum(tokens) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM d) AS p FROM d GROUP BY 1),
    a AS (SELECT CASE WHEN max(p) = min(p) THEN 0.0 ELSE round(greatest(0.0, 1 - ln({value}) / ln(max(p) / min(p))), 6) END AS a, sum(t) AS total FROM p),
    z AS (SELECT sum(pow(p, a)) AS z, max(pow(p, 1 - a)) AS l FROM p, a),
    w AS (SELECT source, CAST(t AS BIGINT) AS t, CAST(floor(pow(p, a) / z * (total * z * l) * (1 + 1e-12) + 1e-6) AS BIGINT) AS quota FROM p, a, z),
    q AS (SELECT source, quota, quota // t AS epochs, quota - (quota // t) * t AS rest FROM w),
    f AS (SELECT doc_id, d.source, tokens, unnest(range(1, epochs + 1)) AS epoch FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
    r0 AS (SELECT doc_id, d.source, tokens, epochs + 1 AS epoch, rest FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE rest > 0),
    r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY {key('rest')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r0),
    x AS (SELECT doc_id, source, tokens, epoch FROM f UNION ALL SELECT doc_id, source, tokens, epoch FROM r WHERE before < rest),
    o AS (SELECT *, {key('order')} AS key, greatest(1, CAST(round_even((SELECT sum(quota) FROM q) / {block_tokens}, 0) AS BIGINT)) AS blocks FROM x)
    SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST(tokens AS BIGINT) AS tokens, CAST((('0x' || substr(key, 1, 15))::BIGINT >> 20) % blocks AS INTEGER) AS block,
           CAST(row_number() OVER (PARTITION BY (('0x' || substr(key, 1, 15))::BIGINT >> 20) % blocks ORDER BY key, doc_id, source) AS INTEGER) AS place FROM o"""
