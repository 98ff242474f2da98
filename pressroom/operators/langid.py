"""Language identification as a Spark job (C3), and the language filter (C4).

The reference calls a pretrained classifier file that is not shipped.  Here
the model is trained and applied with joins and aggregates:

* features: lower-cased letter runs (``\\pL+``) of the text with newlines
  turned to blanks (T8);
* train: ``explode`` words -> ``groupBy(lang, word).count()`` (partially
  aggregated, so a hot word folds map-side) -> add-one smoothed
  log-probabilities, scaled by 1000 and rounded to integers so that the
  scores are exact sums independent of summation order;
* score: a document's word counts join the profile on ``word`` (AQE splits
  hot words such as articles), ``sum(count * (logp - unseen))`` per
  (document, language) plus the per-language base
  ``n_words * unseen + prior``; the language with the highest score wins
  (ties: the smaller code).

The per-language table has one row per language, a bounded dimension; it
is collected once to build the candidate list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.functions.text import newlines_to_blanks

WORD_RE = r"\pL+"
SCALE = 1000


def words(text_col: str = "article"):
    return F.regexp_extract_all(F.lower(newlines_to_blanks(text_col)), F.lit(WORD_RE), 0)


def counted(ws: str):
    """A list of words as array<struct<word, k>>: each distinct word and how often it occurs.  Sorted, a word's
    occurrences are neighbours, and the places where another begins give the counts."""
    def of(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(starts), lambda at: F.transform(
            F.slice(at, F.lit(1), F.size(at) - 1),
            lambda i, j: F.struct(F.get(s, i).alias("word"), (F.get(at, j + 1) - i).cast("long").alias("k"))))
    some = F.when(F.size(ws) > 0, F.col(ws))
    return F.flatten(F.flatten(F.transform(F.array(F.sort_array(some)), of)))


def train(labelled: DataFrame, text_col: str = "article", lang_col: str = "lang",
          materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Return (profile(word, lang, gain), langs(lang, unseen, prior)).

    ``gain`` = scaled log P(word | lang) minus the language's unseen-word
    value, so only words present in a profile contribute a join row.  The
    word counts are the model: they are written once to the shared
    checkpoint folder, and every later step reads that table instead of
    re-tokenising the training text.
    """
    from pressroom.session import cut_lineage, spread
    labels = labelled.where(F.col(lang_col).isNotNull())
    # document counts per language from a pruned scan (no text read)
    docs = labels.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("nd"))
    lab = spread(labels.select(text_col, lang_col))
    w = lab.select(F.col(lang_col).alias("lang"), F.explode(words(text_col)).alias("word"))
    counts = w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    if materialize:
        counts = cut_lineage(counts)
    # two scalars of the training set (one number each)
    v = counts.select("word").distinct().count()
    n = labels.count()
    totals = counts.groupBy("lang").agg(F.sum("c").alias("t"))
    langs = totals.join(docs, "lang").select(
        "lang", "t",
        F.round(F.log(F.lit(1.0) / (F.col("t") + F.lit(v))) * SCALE).cast("long").alias("unseen"),
        F.round(F.log(F.col("nd") / F.lit(float(n))) * SCALE).cast("long").alias("prior"))
    # one row per language: broadcast is bounded by the number of languages
    profile = (counts.join(F.broadcast(langs.select("lang", "t", "unseen")), "lang")
               .select("word", "lang",
                       (F.round(F.log((F.col("c") + F.lit(1.0)) / (F.col("t") + F.lit(v))) * SCALE).cast("long")
                        - F.col("unseen")).alias("gain")))
    return profile, langs.select("lang", "unseen", "prior")


def identify(df: DataFrame, profile: DataFrame, langs: DataFrame, id_col: str = "uuid",
             text_col: str = "article", out_col: str = "language") -> DataFrame:
    """(id, language): best-scoring language per document; a text without
    letters gets the language of the highest prior.

    The words of a document are extracted and counted once, within its row; their
    number rides along the explode.  Per (document, language) the profile gains are summed
    (partial aggregation; the profile join is broadcast by AQE when small,
    else split by its skew handling), then one aggregation per document
    scores every candidate language: ``n * unseen + prior + gain``.
    """
    from pressroom.session import spread
    # the languages as one array value, computed within the plan
    cand = langs.agg(F.sort_array(F.collect_list(F.struct("lang", "unseen", "prior")))).scalar()
    src = spread(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_id")
    ws = src.select("_id", words("_t").alias("ws"))
    # a text's words are counted within its row: only distinct ones are shuffled, and once
    per_word = ws.select("_id", F.size("ws").cast("long").alias("n"), F.explode_outer(counted("ws")).alias("w")) \
        .select("_id", "n", F.col("w.word").alias("word"), F.coalesce("w.k", F.lit(0)).alias("k"))
    gains = (per_word.join(profile, "word", "left")
             .groupBy("_id", "lang").agg(F.sum(F.col("k") * F.col("gain")).alias("g"), F.first("n").alias("n")))
    per_doc = gains.groupBy("_id").agg(
        F.first("n").alias("n"),
        F.map_from_entries(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "g")))).alias("gm"))
    # score each candidate; the best is the smallest (-score, code)
    scored = F.transform(F.col("cand"), lambda c: F.struct(
        (-(F.col("n") * c["unseen"] + c["prior"] + F.coalesce(F.try_element_at("gm", c["lang"]), F.lit(0)))).alias("s"),
        c["lang"].alias("lang")))
    return per_doc.withColumn("cand", cand).select(F.col("_id").alias(id_col), F.array_min(scored)["lang"].alias(out_col))


def filter_languages(df: DataFrame, allowed, lang_col: str = "language") -> DataFrame:
    """C4."""
    return df.where(F.col(lang_col).isin(list(allowed)))
