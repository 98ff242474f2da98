"""Deduplicate-and-split plan (D10): D11 -> D1..D7 -> D8/D9 (-> K3 via sinks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.config import DEFAULT, Config
from pressroom.operators import dedup as D
from pressroom.operators import split as S


def deduplicate(articles: DataFrame, cfg: Config = DEFAULT, text_col: str = "article",
                id_col: str = "uuid", date_col: str = "cc_date", site_col: str = "site") -> DataFrame:
    """Articles without near-duplicate losers, with a ``split`` column.

    Losers and split labels are computed on narrow rows (ids, dates, sites,
    signatures); the article text meets them in one final join, so the text
    is shuffled once, for the write.  An id is judged and labelled once: rows that
    repeat an id and site stay or go together, each once, and their texts count as one.
    """
    losers = D.near_duplicate_losers(articles, text_col, id_col, date_col, cfg)
    ids = articles.select(id_col, site_col).distinct()  # a pruned scan: no text
    labels = S.assign_split(D.drop_losers(ids, losers, id_col), cfg, site_col, id_col) \
              .select(F.col(id_col).alias("_id"), F.col(site_col).alias("_site"), "split")
    return articles.join(labels, (F.col(id_col) == F.col("_id")) & F.col(site_col).eqNullSafe(F.col("_site"))).drop("_id", "_site")
