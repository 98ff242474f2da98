"""Near-duplicate removal.

Semantics (reference): every pair of documents that shares an LSH bucket in
some band and whose signatures agree on at least ``min_jaccard`` of the slots
is a duplicate pair; the *older* side (crawl date, then uuid, a total order)
loses.  A document is dropped iff it loses some pair; there is no transitive
closure.

Plan, without emitting all pairs of a bucket:

1. D11 exact copies: identical texts have identical signatures, so every
   copy but the newest loses to the newest.  ``max(struct(date, uuid))`` per
   text hash is a partially aggregated group-by, safe when one text is a
   third of the corpus.  The text hash comes from a narrow pass (no
   shingles) and meets the signatures on id; copies are dropped before
   banding, so they never fill a bucket.
2. D3 bands -> per bucket its newest member (the *leader*), again a
   partially aggregated ``max``.
3. Round 1: each non-leader member is verified against its bucket leader
   only: at most ``num_bands`` pairs per document.
4. Round 2 (exact remainder): members not yet proven losers meet other newer
   members of their buckets in a set-similarity join (``setjoin``): only those
   that share a rare element of a prefix, never all pairs of a bucket, which
   may hold any number of short texts of one template.  Sharing a band and
   agreeing on enough slots implies such an element, so together the rounds
   cover every newer bucket-mate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.config import DEFAULT, Config
from pressroom.operators import minhash as M
from pressroom.operators.salted import SALTS, salt, with_newest  # noqa: F401  SALTS: parts of a hot key
from pressroom.operators.setjoin import newer_matches
from pressroom.session import cut_lineage


def order_key(date_col: str = "cc_date", id_col: str = "uuid"):
    """Total order of D6: crawl date, then uuid."""
    return F.struct(F.col(date_col).alias("d"), F.col(id_col).alias("u"))


def exact_duplicates(df: DataFrame, text_col: str = "article", id_col: str = "uuid",
                     date_col: str = "cc_date") -> DataFrame:
    """(uuid, kept_uuid, is_kept) for every row; the newest copy of each
    text is kept."""
    keyed = df.select(id_col, F.sha2(F.col(text_col), 256).alias("_th"),
                      order_key(date_col, id_col).alias("_ord"))
    return with_newest(keyed, ["_th"], id_col, "_ord", "_best") \
        .select(id_col, F.col("_best.u").alias("kept_uuid"), (F.col("_ord") == F.col("_best")).alias("is_kept"))


def _signed(pairs: DataFrame, sigs: DataFrame, id_col: str) -> DataFrame:
    """Pairs (x, y) with both signatures.  A ``y`` that leads a large bucket is in many
    pairs, so its signature goes to the salts of their x."""
    sx = sigs.select(F.col(id_col).alias("x"), F.col("sig").alias("sx"))
    sy = sigs.select(F.col(id_col).alias("y"), F.col("sig").alias("sy"))
    ys = pairs.select("y", salt("x")).distinct().join(sy, "y")
    return pairs.join(sx, "x").withColumn("_salt", salt("x")).join(ys, ["y", "_salt"])


def _agree(cfg: Config) -> Column:
    return M.agreement(F.col("sx"), F.col("sy")) >= cfg.min_agree


def _share_band(cfg: Config) -> Column:
    r = cfg.rows_per_band
    return F.exists(F.sequence(F.lit(0), F.lit(cfg.num_bands - 1)),
                    lambda b: F.slice("sx", b * r + 1, F.lit(r)) == F.slice("sy", b * r + 1, F.lit(r)))


def _verify(pairs: DataFrame, sigs: DataFrame, id_col: str, cfg: Config) -> DataFrame:
    """Keep pairs (x, y) whose signatures agree on >= min_agree slots."""
    return _signed(pairs, sigs, id_col).where(_agree(cfg)).select("x", "y")


def _verify_exact(pairs: DataFrame, shingles: DataFrame, cfg: Config) -> DataFrame:
    """D5 option: keep pairs whose shingle *sets* have Jaccard >= min_jaccard.

    ``shingles`` is (id, g) with distinct windows per document, restricted to
    documents that share a bucket.  |A n B| comes from joining the pair with
    x's shingles and then with y's on (y, g): work is the sum of |A| over the
    (at most ``num_bands``-per-document) pairs, never a cross product.
    """
    sizes = shingles.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ax = pairs.join(shingles.withColumnRenamed("id", "x"), "x")
    inter = (ax.join(shingles.withColumnRenamed("id", "y"), ["y", "g"])
             .groupBy("x", "y").agg(F.count(F.lit(1)).alias("i")))
    j = (inter.join(sizes.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x")
         .join(sizes.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y"))
    # i / (nx + ny - i) >= t  <=>  i >= t * (nx + ny - i), compared in exact decimals
    t = F.lit(str(cfg.min_jaccard)).cast("decimal(10,6)")
    return j.where(F.col("i") >= t * (F.col("nx") + F.col("ny") - F.col("i"))).select("x", "y")


def keyed_signatures(df: DataFrame, text_col: str = "article", id_col: str = "uuid",
                     date_col: str = "cc_date", cfg: Config = DEFAULT, materialize: bool = True) -> DataFrame:
    """(uuid, ord, best, sig): signatures with the D6 order key and, per exact
    text, the order key of its newest copy (D11).

    * Signatures are grouped by id alone, so their rows come out
      hash-partitioned by id.
    * The text hash and order key come from a second, narrow pass over the
      text (sha2, no shingles): the newest copy per text is a partially
      aggregated ``max``, joined back on the hash over narrow rows, in
      salted parts (a hot text neither folds nor joins in one task).
    * The two meet on id: only the narrow side is shuffled, never the
      signature rows.

    The result feeds every later step (copies, bands, both verification
    rounds), so it is written once to the shared checkpoint folder:
    reliable storage that survives executor loss and cuts the lineage back
    to the text.  Consumers then read a finished table instead of each
    re-running the aggregate and the joins.
    """
    sigs = M.signatures(df, id_col, text_col, cfg)
    keys = df.select(id_col, F.sha2(F.col(text_col), 256).alias("_th"),
                     order_key(date_col, id_col).alias("ord"))
    kb = with_newest(keys, ["_th"], id_col, "ord", "best").select(id_col, "ord", "best")
    # texts below one shingle have no signature, but copies among them count
    out = kb.join(sigs, id_col, "left").select(id_col, "ord", "best", "sig")
    if materialize:
        out = cut_lineage(out, bucket_by=id_col)   # verification joins on id shuffle only the pairs
    return out


def near_duplicate_losers(df: DataFrame, text_col: str = "article", id_col: str = "uuid",
                          date_col: str = "cc_date", cfg: Config = DEFAULT,
                          materialize: bool = True) -> DataFrame:
    """D4-D6 + D11: (uuid, winner) for every document that loses a verified pair.

    ``winner`` is one newer document it loses to.
    """
    ks = keyed_signatures(df, text_col, id_col, date_col, cfg, materialize)
    copy_losers = ks.where(F.col("ord") != F.col("best")) \
                    .select(F.col(id_col), F.col("best.u").alias("winner"))
    sigs = ks.where((F.col("ord") == F.col("best")) & F.col("sig").isNotNull()).select(id_col, "ord", "sig")

    near = bucket_losers(sigs, df, text_col, id_col, cfg)
    return copy_losers.unionByName(near)


def bucket_losers(sigs: DataFrame, df: DataFrame | None = None, text_col: str = "article", id_col: str = "uuid",
                  cfg: Config = DEFAULT) -> DataFrame:
    """D3-D6 on signatures (uuid, ord, sig): (uuid, winner) for each that shares a bucket with a
    newer one and is verified against it.  The texts of ``df`` are read for exact Jaccard only."""
    members = M.bands(sigs, id_col, ["ord"], cfg)
    m = with_newest(members, ["band", "bucket"], id_col, "ord", "lead", shared=True)
    behind = m.where(F.col("ord") < F.col("lead"))

    def shingles(ids):
        docs = df.join(ids, id_col, "left_semi").select(id_col, text_col)
        return docs.select(F.col(id_col).alias("id"),
                           F.explode(M.shingle_windows(F.col(text_col), cfg.char_ngram)).alias("g")).distinct()

    # round 1: against the bucket leader
    p1 = behind.select(F.col(id_col).alias("x"), F.col("lead.u").alias("y")).distinct()
    l1 = _verify_exact(p1, shingles(m.select(id_col).distinct()), cfg) if cfg.exact_jaccard else _verify(p1, sigs, id_col, cfg)
    l1x = cut_lineage(l1.groupBy("x").agg(F.min("y").alias("y")))

    # round 2: members not yet proven losers, among the members of their buckets
    open_ = cut_lineage(behind.join(l1x.select(F.col("x").alias(id_col)), id_col, "left_anti")
                        .select("band", "bucket", F.col(id_col).alias("id")))
    if open_.isEmpty():
        return l1x.select(F.col("x").alias(id_col), F.col("y").alias("winner"))
    mates = cut_lineage(m.join(open_.select("band", "bucket").distinct(), ["band", "bucket"], "left_semi")
                        .select(F.col(id_col).alias("id"), F.col("ord").alias("key")).distinct())
    if cfg.exact_jaccard:
        near = shingles(mates.select(F.col("id").alias(id_col)))
        tokens = near.join(mates, "id").select("id", "key", F.col("g").alias("token"))
        t = F.lit(str(cfg.min_jaccard)).cast("decimal(10,6)")
        l2 = newer_matches(tokens, open_, lambda n: n - F.ceil(t * n) + 1,
                           lambda p: _verify_exact(_signed(p, sigs, id_col).where(_share_band(cfg)).select("x", "y"), near, cfg),
                           lambda nx, ny: (t * nx <= ny) & (t * ny <= nx))
    else:
        # a signature as a set: slot and value in one number (values are below 2**40)
        tokens = sigs.join(mates.select(F.col("id").alias(id_col), "key"), id_col) \
            .select(F.col(id_col).alias("id"), "key", F.posexplode("sig").alias("slot", "h")) \
            .select("id", "key", (F.col("h") * cfg.num_perm + F.col("slot")).alias("token"))
        l2 = newer_matches(tokens, open_, lambda n: n - cfg.min_agree + 1,
                           lambda p: _signed(p, sigs, id_col).where(_agree(cfg) & _share_band(cfg)).select("x", "y"))
    both = l1x.unionByName(l2)
    return both.groupBy("x").agg(F.min("y").alias("winner")).select(F.col("x").alias(id_col), "winner")


def drop_losers(df: DataFrame, losers: DataFrame, id_col: str = "uuid") -> DataFrame:
    """Anti-join on the loser ids."""
    return df.join(losers.select(id_col), id_col, "left_anti")
