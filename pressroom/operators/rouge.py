"""ROUGE evaluation.

* Tokens: lower-case runs of letters and digits.  The common ROUGE tokenizer
  keeps only ``[a-z0-9]``, which splits Hungarian and Czech words at every
  accented letter; ``ascii=True`` reproduces it, the default keeps Unicode
  letters.
* ROUGE-N (R2, R3): n-grams of both sides are exploded, tagged with their
  side and counted per (pair, n-gram) in one aggregation; the clipped overlap
  is ``sum(least(c_pred, c_ref))`` per pair.  precision = overlap / max(#pred,
  1), recall = overlap / max(#ref, 1), F = 2PR / (P + R), 0 when both are 0.
* ROUGE-L (R4): longest common subsequence, bit-parallel over 60-bit words in
  higher-order functions on token arrays: no Python in the plan.
* R5: the corpus score is the mean over pairs, or low, middle and high of a seeded
  Poisson bootstrap, rounded to 4 digits (T13).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.functions.text import round4

#: P(X <= k) of a Poisson(1) variable, k = 0..9
_POISSON_CDF = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10)]

UNICODE_TOKEN_RE = r"[\pL\pN]+"
ASCII_TOKEN_RE = r"[a-z0-9]+"


def tokens(text: Column, ascii: bool = False) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ASCII_TOKEN_RE if ascii else UNICODE_TOKEN_RE), 0)


def ngrams(toks: Column, n: int) -> Column:
    """Array of space-joined n-grams (empty when fewer than n tokens)."""
    if n == 1:
        return toks
    k = F.size(toks) - n
    return F.when(k >= 0, F.transform(
        F.sequence(F.lit(0), k),
        lambda i: F.array_join(F.slice(toks, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _prf(overlap: Column, n_pred: Column, n_ref: Column, prefix: str) -> list[Column]:
    p = overlap / F.greatest(n_pred, F.lit(1))
    r = overlap / F.greatest(n_ref, F.lit(1))
    f = F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [p.alias(f"{prefix}_precision"), r.alias(f"{prefix}_recall"), f.alias(f"{prefix}_fmeasure")]


def _overlaps(tok: DataFrame, orders: tuple[int, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """(_id, overlap{n}, n_pred{n}, n_ref{n} per order) from token arrays ``tp``, ``tr``:
    one explode of the n-grams of all orders and both sides.  ``carry``: columns of
    the pair that are kept."""
    side = lambda c, n, p, r: F.transform(ngrams(F.col(c), n), lambda x: F.struct(
        F.lit(n).alias("n"), x.alias("gram"), F.lit(p).alias("p"), F.lit(r).alias("r")))
    grams = F.concat(*[side(c, n, p, 1 - p) for n in orders for c, p in (("tp", 1), ("tr", 0))])
    # a pair with no n-gram at all keeps a null row (explode_outer), so every pair survives
    per_gram = tok.select("_id", *carry, F.explode_outer(grams).alias("e")) \
        .select("_id", *carry, "e.*").groupBy("_id", "n", "gram") \
        .agg(F.sum("p").alias("cp"), F.sum("r").alias("cr"), *[F.first(c).alias(c) for c in carry])
    of = lambda n, c: F.coalesce(F.sum(F.when(F.col("n") == n, c)), F.lit(0))
    return per_gram.groupBy("_id").agg(*[F.first(c).alias(c) for c in carry], *[x for n in orders for x in (
        of(n, F.least("cp", "cr")).cast("double").alias(f"overlap{n}"),
        of(n, F.col("cp")).alias(f"n_pred{n}"), of(n, F.col("cr")).alias(f"n_ref{n}"))])


def _token_arrays(pairs: DataFrame, id_col: str, pred_col: str, ref_col: str, ascii: bool) -> DataFrame:
    # tokens first, as columns: referenced inside the n-gram lambda, an
    # expression would be re-evaluated for every n-gram
    from pressroom.session import spread
    src = spread(pairs.select(F.col(id_col).alias("_id"), pred_col, ref_col), "_id")
    return src.select("_id", tokens(F.col(pred_col), ascii).alias("tp"), tokens(F.col(ref_col), ascii).alias("tr"))


def rouge_n(pairs: DataFrame, n: int, id_col: str = "uuid", pred_col: str = "generated",
            ref_col: str = "article", ascii: bool = False) -> DataFrame:
    """Per pair: rouge{n}_precision / _recall / _fmeasure (unrounded)."""
    j = _overlaps(_token_arrays(pairs, id_col, pred_col, ref_col, ascii), (n,))
    return j.select(F.col("_id").alias(id_col), *_prf(
        F.col(f"overlap{n}"), F.col(f"n_pred{n}"), F.col(f"n_ref{n}"), f"rouge{n}"))


def _bind(x: Column, body) -> Column:
    """``body`` of ``x``, with ``x`` evaluated once however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


#: Bits of the reference that one word of the bit vector holds; the sum of two words and a carry fits a long.
LCS_BITS = 60
_FULL = (1 << LCS_BITS) - 1


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, bit-parallel (Hyyro
    2004) over words of LCS_BITS bits: bit j of ``v`` is 0 where the subsequence of the
    part of ``a`` seen so far and ``b[:j + 1]`` grows.  Tokens of one side only change
    nothing, so both sides become numbers of their common tokens first.  Null or empty
    sides have length 0."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    number = lambda toks, keys: F.transform(toks, lambda t: F.array_position(keys, t).cast("int"))
    first = F.lit(0).cast("long")

    def mask(s: Column, key: Column) -> Column:
        """The places of a token in b, a word of LCS_BITS places at a time, lowest place first."""
        return F.transform(F.sequence(F.lit(0), s["words"] - 1), lambda w: F.aggregate(
            F.reverse(F.slice(s["b"], w * LCS_BITS + 1, F.lit(LCS_BITS))), first,
            lambda bits, t: F.shiftleft(bits, 1) + F.when(t == key, 1).otherwise(0)))

    def step(v: Column, m: Column) -> Column:
        """v' = (v + (v & m)) | (v & ~m), the carry passed from word to word."""
        def word(acc: Column, x: Column) -> Column:
            total = x["v"] + x["v"].bitwiseAND(x["m"]) + acc["carry"]
            out = total.bitwiseAND(F.lit(_FULL)).bitwiseOR(x["v"] - x["v"].bitwiseAND(x["m"]))
            return F.struct(F.shiftright(total, LCS_BITS).alias("carry"), F.concat(acc["out"], F.array(out)).alias("out"))
        zero = F.struct(first.alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.zip_with(v, m, lambda x, y: F.struct(x.alias("v"), y.alias("m"))), zero, word, lambda acc: acc["out"])

    def length(s: Column) -> Column:
        masks = F.transform(F.sequence(F.lit(1), s["keys"]), lambda k: mask(s, k))
        start = F.array_repeat(F.lit(_FULL), s["words"])
        end = _bind(masks, lambda known: F.aggregate(F.filter(s["a"], lambda t: t > 0), start,
                                                     lambda v, t: step(v, F.get(known, t - 1))))
        return F.aggregate(end, first, lambda n, x: n + LCS_BITS - F.bit_count(x))

    numbered = lambda keys: F.struct(
        number(a, keys).alias("a"), number(b, keys).alias("b"), F.size(keys).alias("keys"),
        F.ceil(F.size(b) / LCS_BITS).cast("int").alias("words"))
    return _bind(F.array_intersect(a, b), lambda keys: F.when(
        F.size(keys) > 0, _bind(numbered(keys), length)).otherwise(first))


def rouge_l(pairs: DataFrame, id_col: str = "uuid", pred_col: str = "generated",
            ref_col: str = "article", ascii: bool = False) -> DataFrame:
    """Per pair: rougeL_precision / _recall / _fmeasure (unrounded)."""
    t = pairs.select(F.col(id_col), tokens(F.col(pred_col), ascii).alias("tp"),
                     tokens(F.col(ref_col), ascii).alias("tr"))
    t = t.withColumn("lcs", lcs_length(F.col("tp"), F.col("tr")).cast("double"))
    return t.select(id_col, *_prf(F.col("lcs"), F.size("tp"), F.size("tr"), "rougeL"))


def rouge_scores(pairs: DataFrame, id_col: str = "uuid", pred_col: str = "generated",
                 ref_col: str = "article", ascii: bool = False, with_l: bool = True) -> DataFrame:
    """Per pair: the nine (or six without L) ROUGE numbers.  Each text is tokenised
    once; the length of the common subsequence rides along with the token counts."""
    t = _token_arrays(pairs, id_col, pred_col, ref_col, ascii)
    if not with_l:
        j, numbers = _overlaps(t, (1, 2)), ()
    else:
        t = t.withColumn("lcs", lcs_length(F.col("tp"), F.col("tr")).cast("double"))
        j, numbers = _overlaps(t, (1, 2), carry=("lcs",)), _prf(F.col("lcs"), F.col("n_pred1"), F.col("n_ref1"), "rougeL")
    return j.select(F.col("_id").alias(id_col), *[c for n in (1, 2) for c in _prf(
        F.col(f"overlap{n}"), F.col(f"n_pred{n}"), F.col(f"n_ref{n}"), f"rouge{n}")], *numbers)


def corpus_scores(per_pair: DataFrame, id_col: str = "uuid") -> DataFrame:
    """R5 + T13: one row, the mean of each score over pairs, rounded to 4 digits."""
    cols = [c for c in per_pair.columns if c != id_col]
    return per_pair.agg(*[round4(F.avg(c)).alias(c) for c in cols])


def bootstrap_scores(per_pair: DataFrame, id_col: str = "uuid", rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(score, low, mid, high): 2.5 %, 50 % and 97.5 % points of the corpus mean
    over ``rounds`` resamples, rounded to 4 digits.

    A pair's weight in a round is a Poisson(1) draw, which resamples without a global
    shuffle of rows.  The draw is a function of (id, round, seed), so reruns and any
    partitioning agree.  One pass: pairs x rounds rows fold map-side into
    rounds x scores sums, whose size does not depend on the corpus."""
    cols = [c for c in per_pair.columns if c != id_col]
    # 28 bits of the md5 as a uniform number, compared with the cumulative Poisson(1) weights
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col("round").cast("string"),
                                             F.lit(str(seed)))), 1, 7), 16, 10).cast("double") / float(1 << 28)
    w = sum((F.when(u >= c, 1).otherwise(0) for c in _POISSON_CDF), F.lit(0))
    drawn = per_pair.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", w)
    sums = drawn.groupBy("round").agg(F.sum("w").alias("w"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in cols]) \
        .where("w > 0")
    long = sums.select("round", F.explode(F.array(*[
        F.struct(F.lit(c).alias("score"), (F.col(c) / F.col("w")).alias("mean")) for c in cols])).alias("s"))
    return long.groupBy("s.score").agg(*[round4(F.percentile("s.mean", F.lit(q))).alias(name)
                                         for name, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))])
