"""Sentence boundaries with abbreviations learned from the corpus.

Which words end in a full stop without ending a sentence is learned without labels, after
Kiss and Strunk (2006): an abbreviation and its full stop are a collocation.  One aggregation
counts each word with and without a full stop behind it.  The word's evidence is the
log-likelihood ratio of "nearly always with a full stop" against "as often as any token",
made smaller by its length and by each occurrence without the full stop, larger by full
stops within it.

All words above a threshold are learned.  The stored model is those of most evidence, of
bounded size, applied map-only: tokens that end a sentence by their last sign are taken by
one regular expression, and those that are abbreviations, initials or ordinals are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions.text import strip_ws

#: Least evidence of an abbreviation, and the share of full stops it is held to have (published values).
THRESHOLD = 0.3
NEARLY_ALWAYS = 0.99
#: Size of the stored model: the words of most evidence, ties by the word.
SIZE = 5000

_BLANKS = r"[\x20\x09-\x0D]+"
_ENDS = r"([^\x20\x09-\x0D]*[.!?])(?=[\x20\x09-\x0D])"
#: An ordinal: a number with a full stop before a lower-case word.
_ORDINAL = r"(?<![^\x20\x09-\x0D])[^\pL\pN\x20\x09-\x0D]*\pN+[.](?=[\x20\x09-\x0D]+\p{Ll})"


def _core(token: Column) -> Column:
    """A token in lower case without the signs around it; a full stop at its end stays."""
    return F.lower(F.regexp_replace(token, r"^[^\pL\pN]+|[^\pL\pN.]+$", ""))


def _stopped(core: Column) -> Column:
    """One full stop at the end, no more."""
    return core.rlike(r"[^.][.]$")


def learn_abbreviations(df: DataFrame, text: str = "article", threshold: float = THRESHOLD) -> DataFrame:
    """(word, stops, others, score): all words of ``text`` that are abbreviations, without
    their last full stop, those of most evidence first.  A word holds a letter; numbers and
    bare signs count as tokens only.  Null and empty texts have no tokens; no rows give no words."""
    # the tokens as they stand are counted first, so each distinct one is taken apart once
    tokens = df.select(F.explode(F.split(F.trim(F.regexp_replace(F.col(text), _BLANKS, " ")), " ")).alias("t")) \
        .where("t != ''").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    core = tokens.select(_core(F.col("t")).alias("core"), "n")
    stop = _stopped(F.col("core"))
    # whether a word holds a letter is a result of its group: as a condition on the word it would be moved
    # below the count of tokens, which the words and the share could then no longer have in common
    counts = core.groupBy(F.regexp_replace("core", "[.]+$", "").alias("word")) \
        .agg(F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("stops"), F.sum(F.when(stop, 0).otherwise(F.col("n"))).alias("others"),
             F.bool_or(F.col("core").rlike(r"\pL")).alias("lettered"))
    # one row: the share of full stops among all tokens, kept off 0 and 1
    base = core.agg(F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("s"), F.sum("n").alias("n")) \
        .select(F.greatest(F.least(F.col("s") / F.col("n"), F.lit(1 - 1e-9)), F.lit(1e-9)).alias("p"))
    held = counts.where(F.col("lettered") & (F.col("stops") > 0)).crossJoin(F.broadcast(base))  # base: one row
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    size_ = (F.length("word") - inner).cast("double")
    plain = F.col("stops") * F.ln("p") + F.col("others") * F.ln(1 - F.col("p"))
    bound = F.col("stops") * F.ln(F.lit(NEARLY_ALWAYS)) + F.col("others") * F.ln(F.lit(1 - NEARLY_ALWAYS))
    score = -2 * (plain - bound) * F.exp(-size_) * (inner + 1) * F.pow(size_, -F.col("others").cast("double"))
    return held.select("word", "stops", "others", score.alias("score")).where(F.col("score") >= threshold) \
        .orderBy(F.desc("score"), "word")


def strongest(words: DataFrame, size: int = SIZE) -> DataFrame:
    """The model of learned words: the ``size`` of most evidence, ties by the word."""
    return words.orderBy(F.desc("score"), "word").limit(size)


def save_abbreviations(words: DataFrame, path: str) -> None:
    """The model as a table; a stored one is never replaced."""
    words.write.mode("errorifexists").parquet(path)


def load_abbreviations(spark: SparkSession, path: str, most: int = SIZE) -> list[str]:
    """The stored words, at most ``most``; a larger table is refused before it is read."""
    table = spark.read.schema("word string").parquet(path)
    n = table.count()
    if n > most:
        raise ValueError(f"{path}: {n} abbreviations are more than {most}")
    return sorted(r["word"] for r in table.collect())


def sentence_count(text: Column | str, abbreviations: list[str]) -> Column:
    """T4 with learned abbreviations: tokens that end in ``.``, ``!`` or ``?`` before another
    token end a sentence, and so does the text.  A full stop after an abbreviation or a
    single letter doesn't, nor after a number before a lower-case word.  Blank: 0; null: null."""
    s = strip_ws(F.col(text) if isinstance(text, str) else text)
    ends = F.regexp_extract_all(s, F.lit(_ENDS), F.lit(1))

    def goes_on(token: Column) -> Column:
        core = _core(token)
        word = F.regexp_replace(core, "[.]$", "")
        return token.endswith(".") & _stopped(core) & (word.isin(abbreviations) | word.rlike(r"^\pL$"))

    count = F.size(ends) - F.size(F.filter(ends, goes_on)) - F.regexp_count(s, F.lit(_ORDINAL)) + 1
    return F.when(s == "", F.lit(0)).when(s.isNotNull(), count).cast("long")
