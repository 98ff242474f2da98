"""Page -> article extraction plan (H12 with U1, U2, U3, H1-H11, T1, T6, T7, K8).

One DataFrame plan over all sites together.  A page's tokens stay arrays of its
row: raw pages are shuffled by ``page_id``, so that a file's one split isn't one
task's work, and what is left of their texts once more, for the window that brings
pages of one id together (Python helpers forget how rows are dealt).  The result
has one row per page that passed the URL filter, with ``reject_reason`` null for
articles (K8 keeps the rest).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions import urls as U
from pressroom.functions.dates import parse_human_date, parse_relative_date
from pressroom.functions.text import nfkc
from pressroom.operators import html as H
from pressroom.operators.index import filter_blocked_urls, with_domain_and_site
from pressroom.sources.site_rules import ALL_RULES, sites
from pressroom.sources.tables import crawl_date

MODIFIED = "Módosítva"  # fixed value: index.hu's "modified" marker in date text


def article_id(url, cc_date):
    """Deterministic id (the reference draws a random UUID4, which would
    change on every task retry)."""
    return F.sha2(F.concat_ws("|", url, cc_date.cast("string")), 256)


def prepare_pages(pages: DataFrame, url_rules=U.BAD_URL_RULES) -> DataFrame:
    """U1 filter, then U2/U3 and the crawl date (pages adapter: epoch + page_id days
    when the source carries no ``cc_date``)."""
    p = filter_blocked_urls(pages, url_rules)
    p = with_domain_and_site(p)
    if "cc_date" not in p.columns:
        p = p.withColumn("cc_date", crawl_date(F.col("page_id")))
    return p


def _texts(pages: DataFrame, rules) -> DataFrame:
    """Pages with, in place of the html, validity, date mode, and the body, date and fallback texts.
    A null html has none; pages that share an id share their texts, tokens of one position side by side."""
    has_html = F.col("html").isNotNull()
    t = H.with_tokens(pages.withColumns({"has_html": has_html, "rules": H.rules_of(F.col("site"), rules)}))
    t = t.withColumn("m", H.matched_rules(F.col("toks"), F.col("tree"), F.col("rules")))
    opened = lambda role: F.filter(H.with_role(F.col("m"), role), lambda t: t["kind"] == "open")
    spans = lambda m: F.transform(m, lambda t: F.struct(t["pos"].alias("pos"), t["end"].alias("end")))
    ranked = lambda role: F.transform(opened(role), lambda t: F.struct(
        H.best_of_role(t["rules"], role).alias("best"), t["pos"].alias("pos"), t["end"].alias("end")))
    parts = F.struct(
        (F.size(H.with_role(F.col("m"), "reject")) > 0).alias("invalid"),
        spans(H.with_role(F.col("m"), "remove")).alias("remove"),
        spans(H.with_role(F.col("m"), "lead")).alias("lead"),
        F.transform(ranked("body"), lambda t: F.struct(t["best"]["priority"].alias("priority"), t["pos"].alias("pos"),
                                                       t["end"].alias("end"))).alias("body"),
        F.transform(ranked("date"), lambda t: F.struct(t["best"]["priority"].alias("priority"), t["pos"].alias("pos"),
                                                       t["end"].alias("end"), t["best"]["mode"].alias("mode"))).alias("date"),
        spans(opened("date_fallback")).alias("fallback"),
        F.transform("toks", H.piece).alias("pieces"))
    kept = [c for c in pages.columns if c != "html"]
    t = t.select(*kept, F.when(F.col("has_html"), parts).alias("parts"))
    t = t.select(*kept, F.collect_list("parts").over(Window.partitionBy("page_id")).alias("copies"))
    every = lambda f: F.flatten(F.col(f"copies.{f}"))
    t = t.select(*kept, F.exists("copies.invalid", lambda x: x).alias("invalid"), H.merged_pieces(F.col("copies.pieces")).alias("pieces"),
                 *[every(f).alias(f) for f in ("remove", "lead", "body", "date", "fallback")])
    t = t.withColumns({"removed": H.coverage(F.col("remove"), F.size("pieces")), "in_lead": H.coverage(F.col("lead"), F.size("pieces"))})

    # H2/H3/H9: first element of the best rule, per page
    live = lambda f: F.filter(f, lambda s: ~H.covered(F.col("removed"), s["pos"]))
    t = t.select(*kept, "invalid", "pieces", "removed", "in_lead", F.array_min(live("body")).alias("b"),
                 F.array_min(live("date")).alias("d"), F.array_min(live("fallback")).alias("f"))

    def text(s: str, *without: str) -> Column:
        start, dropped = F.col(f"{s}.pos"), [F.col(c) for c in without]
        whole = F.slice("pieces", start + 1, F.col(f"{s}.end") - start + 1)
        held = F.filter(whole, lambda x, i: ~reduce(or_, [H.covered(d, start + i) for d in dropped]))
        any_dropped = reduce(or_, [F.size(d) > 0 for d in dropped])
        return F.coalesce(H.join_pieces(F.when(any_dropped, held).otherwise(whole)), F.lit(""))

    texts = F.struct(F.col("d.mode").alias("date_mode"), text("b", "removed", "in_lead").alias("body_text"),
                     text("d", "removed").alias("date_text"), text("f", "removed").alias("fb_text"))
    # an array of one: a condition on the texts isn't pushed below this, which would work them out twice
    return t.select(*kept, "invalid", F.explode(F.array(texts)).alias("texts")).select(*kept, "invalid", "texts.*")


def extract(pages: DataFrame, rules=ALL_RULES, url_rules=U.BAD_URL_RULES,
            num_partitions: int | None = None, relative_dates: bool = False) -> DataFrame:
    """All pages with (uuid, article, domain, url, date_of_creation, cc_date, site,
    page_id, reject_reason).  ``relative_dates``: "yesterday" and the like count too, as seen at
    the crawl; the last projection then outgrows code generation, so it is off unless asked for."""
    p = prepare_pages(pages, url_rules)
    known = sites(rules)
    n = num_partitions or int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # of pages without a site's rules or without id, the html isn't asked for
    html = F.when(F.col("site").isin(known) & F.col("page_id").isNotNull(), F.col("html"))
    p = p.select("page_id", "url", "domain", "site", "cc_date", html.alias("html"))
    # the one shuffle of raw HTML
    texts = _texts(p.repartition(n, "page_id"), rules)
    # T6 with the per-site date modes: choose the text(s) first, parse once or twice
    dt, fb, mode = F.col("date_text"), F.col("fb_text"), F.col("date_mode")
    cut = F.trim(F.split(dt, MODIFIED).getItem(0))
    texts = texts.withColumns({
        "_d1": (F.when(mode == "cut", F.when(F.coalesce(cut, F.lit("")) != "", cut).otherwise(fb))
                .when(mode == "first_line", F.split(dt, "\n").getItem(0))
                .when(mode.isNotNull(), dt)
                .otherwise(fb)),
        "_d2": F.when(mode == "first_line", dt),
    })
    crawled = F.col("cc_date").cast("timestamp_ntz")
    parsers = [parse_human_date] + [lambda d: parse_relative_date(d, crawled)] * relative_dates
    date_of_creation = F.coalesce(*[parse(F.col(d)) for d in ("_d1", "_d2") for parse in parsers])

    body_blank = F.coalesce(F.trim(F.col("body_text")), F.lit("")) == ""
    reason = (F.when(~F.col("site").isin(known), F.lit("unknown_site"))
              .when(F.coalesce(F.col("invalid"), F.lit(False)), F.lit("invalid_page"))
              .when(body_blank, F.lit("missing_article")))
    return texts.select(
        "page_id",
        article_id(F.col("url"), F.col("cc_date")).alias("uuid"),
        F.when(reason.isNull(), nfkc(F.col("body_text"))).alias("article"),
        "domain", "url",
        F.when(reason.isNull(), date_of_creation).alias("date_of_creation"),
        "cc_date", "site",
        reason.alias("reject_reason"))


def articles(extracted: DataFrame) -> DataFrame:
    """H12 result: the pages that became articles."""
    return extracted.where(F.col("reject_reason").isNull()).drop("reject_reason", "page_id")


def rejects(extracted: DataFrame) -> DataFrame:
    """K8: the pages that did not, with their reason."""
    return extracted.where(F.col("reject_reason").isNotNull()).select("page_id", "url", "site", "reject_reason")
