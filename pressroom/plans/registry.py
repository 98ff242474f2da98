"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of SURVEY section 2 that has a table binding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressroom.plans import corpus
from pressroom.session import ensure_conf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_conf(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return deco


@register("flagship_clean_length_describe")
def _flagship(spark, sf):
    """C1 + C2 then G1: length statistics per site after cleaning."""
    return corpus.flagship(spark, sf)


# ---- statistics (G*) -------------------------------------------------------
from pressroom.operators import stats as G  # noqa: E402
from pressroom.operators import clean as C  # noqa: E402
from pressroom.sources.tables import articles_from_documents, read_table  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@register("g1_describe_length_raw")
def _g1(spark, sf):
    return G.describe(corpus.articles_with_stats(spark, sf), "article_length", "domain")


@register("g2_describe_words_raw")
def _g2(spark, sf):
    return G.describe(corpus.articles_with_stats(spark, sf), "word_count", "domain")


@register("g2_describe_words_clean")
def _g2c(spark, sf):
    return G.describe(corpus.length_word_filtered(spark, sf), "word_count", "domain")


@register("g3_histogram_length_per_site")
def _g3(spark, sf):
    return G.histogram(corpus.articles_with_stats(spark, sf), "article_length", "site")


@register("g3_histogram_words_per_site")
def _g3w(spark, sf):
    return G.histogram(corpus.articles_with_stats(spark, sf), "word_count", "site")


@register("g4_histogram_length_all_raw")
def _g4(spark, sf):
    return G.histogram(corpus.articles_with_stats(spark, sf), "article_length", None)


@register("g4_histogram_words_all_clean")
def _g4c(spark, sf):
    return G.histogram(corpus.length_word_filtered(spark, sf), "word_count", None)


@register("g5_yearly_articles")
def _g5(spark, sf):
    return G.yearly_counts(articles_from_documents(spark, sf), "date_of_creation", "uuid")


@register("g5_yearly_orders")
def _g5o(spark, sf):
    return G.yearly_counts(read_table(spark, sf, "orders"), "o_orderdate", "o_orderkey")


@register("g5_yearly_events")
def _g5e(spark, sf):
    # the events are of 2024, after the articles' last year
    return G.yearly_counts(read_table(spark, sf, "events"), "ts", "event_id", year_max=2024)


@register("g6_yearly_by_language_sets")
def _g6(spark, sf):
    return G.yearly_counts_grouping_sets(articles_from_documents(spark, sf), "lang",
                                         "date_of_creation", "uuid")


@register("g7_describe_length_rollup")
def _g7(spark, sf):
    return G.describe_rollup(corpus.articles_with_stats(spark, sf), "article_length", "site")


@register("g8_raw_vs_clean_length")
def _g8(spark, sf):
    return corpus.raw_vs_clean(spark, sf, "article_length")


# ---- text scalars, cleaning filters, audit (T*, C*, K9, S4) ----------------

@register("t2_t5_text_scalars")
def _t(spark, sf):
    return corpus.text_scalars(spark, sf)


@register("t1_nfkc")
def _t1(spark, sf):
    return corpus.nfkc_check(spark, sf)


@register("c1_c2_length_word_filter")
def _c12(spark, sf):
    return corpus.length_word_filtered(spark, sf).select("uuid", "site", "article_length", "word_count")


@register("c5_sentence_filter")
def _c5(spark, sf):
    return corpus.sentence_filtered(spark, sf)


@register("k9_stage_audit")
def _k9(spark, sf):
    return corpus.stage_counts(spark, sf)


@register("s4_site_selection_substring")
def _s4(spark, sf):
    return corpus.site_selection(spark, sf, "src1,src2", exact=False)


@register("s4_site_selection_exact")
def _s4e(spark, sf):
    return corpus.site_selection(spark, sf, "src1,src2", exact=True)


# ---- near-duplicate removal and split (D*) ---------------------------------
from pressroom.operators import dedup as D  # noqa: E402
from pressroom.operators import minhash as M  # noqa: E402
from pressroom.operators import rank as RK  # noqa: E402
from pressroom.operators import split as S  # noqa: E402
from pressroom.plans import dedup as DP  # noqa: E402


def _dedup_input(spark, sf):
    """All articles, of any length."""
    return articles_from_documents(spark, sf).select("uuid", "article", "cc_date", "site", "domain")


@register("d11_exact_duplicates")
def _d11(spark, sf):
    ex = D.exact_duplicates(_dedup_input(spark, sf))
    return ex.where(~F.col("is_kept")).select("uuid", "kept_uuid")


@register("d2_minhash_signatures")
def _d2(spark, sf):
    return M.signatures(_dedup_input(spark, sf))


@register("d3_lsh_shared_buckets")
def _d3(spark, sf):
    b = M.bands(M.signatures(_dedup_input(spark, sf)))
    per = b.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return per.groupBy("band").agg(F.count(F.lit(1)).alias("n_buckets"),
                                   F.sum("size").cast("long").alias("n_members"))


@register("d6_near_duplicate_losers")
def _d6(spark, sf):
    return D.near_duplicate_losers(_dedup_input(spark, sf)).select("uuid")


@register("d9_split_assignment")
def _d9(spark, sf):
    a = _dedup_input(spark, sf)
    return S.assign_split(a).select("uuid", "site", "split", "rank")


@register("d8_seeded_shuffle")
def _d8(spark, sf):
    """Every article's place in the seeded order of all."""
    a = _dedup_input(spark, sf).select("uuid", S.shuffle_key(123).alias("key"))
    return RK.global_rank(a, [F.asc("key"), F.asc("uuid")]).select("uuid", "rank")


@register("d10_dedup_split")
def _d10(spark, sf):
    return DP.deduplicate(_dedup_input(spark, sf)).select("uuid", "site", "split")


# ---- URL and crawl-index operators over pages (U*, I*) ---------------------
from pressroom.functions import urls as U  # noqa: E402
from pressroom.operators import index as I  # noqa: E402

# Test binding for U1: the reference's rules name four news sites that the
# driver's pages do not contain, so a second rule set of the same form
# exercises the filter on the pages' own hosts.
BINDING_URL_RULES = (r"m\..*", r"blog\..*\?.*", r".*\.example\.net/en/1.*")


@register("u1_url_blocklist_reference_rules")
def _u1(spark, sf):
    return I.filter_blocked_urls(read_table(spark, sf, "pages")).select("page_id", "url")


@register("u1_url_blocklist_binding_rules")
def _u1b(spark, sf):
    return I.filter_blocked_urls(read_table(spark, sf, "pages"), BINDING_URL_RULES).select("page_id", "url")


@register("s6_u1_rule_file")
def _s6(spark, sf):
    """U1 with rules that are written to a file, with blanks and empty lines, and read back."""
    path = _scratch(spark, "rules")
    spark.createDataFrame([(f"  {r}\t",) for r in BINDING_URL_RULES] + [("",), ("   ",)], "value string").write.text(path)
    return I.filter_blocked_urls(read_table(spark, sf, "pages"), FS.read_url_rules(spark, path)).select("page_id", "url")


@register("u2_u3_domain_and_site")
def _u2(spark, sf):
    # the pages' own hosts and, over the same pages, hosts that they lack
    p = read_table(spark, sf, "pages").select("page_id", "url")
    other = ("www.news.com.au", "shop.co.jp", "10.20.30.40", "co.uk")
    urls = [F.col("url"), *[F.regexp_replace("url", "://[^/?#:]+", f"://{h}") for h in other],
            F.lit("http://bad host/%zz"), F.lit(None).cast("string")]
    p = p.select("page_id", F.posexplode(F.array(*urls)).alias("variant", "url"))
    return I.with_domain_and_site(p).select("page_id", "variant", U.host(F.col("url")).alias("host"), "domain", "site")


@register("u6_crawl_timestamp_parse")
def _u6(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", U.crawl_timestamp(F.date_format("ts", U.CRAWL_DATE_FORMAT)).alias("crawl_ts"))


@register("i1_mime_filter")
def _i1(spark, sf):
    # every page as it is, behind a comment, behind an XML declaration, and twice as no HTML
    html = F.col("html")
    variants = (html, F.concat(F.lit("<!-- a long comment before it all, of over sixty-four characters -->"), html),
                F.concat(F.lit('<?xml version="1.0"?>\n'), html), F.concat(F.lit("plain "), html), F.regexp_replace(html, "(?i)<html", "<htmlx"))
    p = read_table(spark, sf, "pages").select("page_id", F.posexplode(F.array(*[U.sniff_mime(v) for v in variants])).alias("variant", "mime"))
    return I.filter_mime(p, I.allowed_mimes_table(spark))


@register("i2_index_url_dedup")
def _i2(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", "url")
    return I.dedup_index_urls(p).select("canonical_url", "page_id", "url")


# ---- HTML extraction (H*, K8) -----------------------------------------------
from pressroom.operators import html as H  # noqa: E402
from pressroom.plans import scrape  # noqa: E402


@register("h1_token_counts")
def _h1(spark, sf):
    t = H.tokenize(read_table(spark, sf, "pages").select("page_id", "html"), keep=())
    return t.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(F.col("kind") == "open").alias("n_open"),
        F.count_if(F.col("kind") == "close").alias("n_close"),
        F.count_if(F.col("kind") == "void").alias("n_void"),
        F.count_if(F.col("kind") == "text").alias("n_text"))


@register("h12_extract_articles")
def _h12(spark, sf):
    ex = scrape.extract(read_table(spark, sf, "pages"))
    return scrape.articles(ex).select("uuid", "article", "domain", "url", "date_of_creation",
                                      "cc_date", "site")


@register("k8_reject_reasons")
def _k8(spark, sf):
    ex = scrape.extract(read_table(spark, sf, "pages"), url_rules=BINDING_URL_RULES)
    return ex.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")) \
             .agg(F.count(F.lit(1)).alias("n"))


# ---- language identification and the clean pipeline (C3, C4, C6) ----------
from pressroom.session import spread  # noqa: E402

@register("c3_language_id")
def _c3(spark, sf):
    return corpus.language_ids(spark, sf)


@register("c6_clean_pipeline")
def _c6(spark, sf):
    return corpus.clean(spark, sf).select("uuid", "site", "lang")


from pressroom.operators import trigrams as TG  # noqa: E402


def _held_out():
    return F.conv(F.substring(F.md5("uuid"), 1, 8), 16, 10).cast("long") % 3 == 1


def _stored_model(spark, articles):
    """A model of the labelled articles outside the held-out third, stored and loaded again."""
    path = _scratch(spark, "language-model")
    TG.save_model(TG.train(articles.where(~_held_out())), path)
    return TG.load_model(spark, path)


@register("c3_trigram_language")
def _c3t(spark, sf):
    """Every article by a stored trigram model that hasn't seen the held-out third."""
    a = articles_from_documents(spark, sf)
    model = _stored_model(spark, a)
    return spread(a, "uuid").select("uuid", TG.language(spark, F.col("article"), model).alias("language"),
                                    _held_out().alias("held_out"), "lang")


@register("c6_clean_stored_model")
def _c6t(spark, sf):
    a = articles_from_documents(spark, sf, corpus.DOCS_CFG)
    return corpus.clean_with_model(a, _stored_model(spark, a)).select("uuid", "site", "lang")


# ---- learned sentence boundaries (T4, C5) ------------------------------------
from pressroom.operators import sentences as SE  # noqa: E402


def _abbreviated(spark, sf):
    """Every article with an abbreviation before each third kind of word: the data has none of its own."""
    a = articles_from_documents(spark, sf, with_lang=False)
    return a.withColumn("article", F.regexp_replace("article", r" ([a-h])", " Nr. č. 7. $1"))


def _stored_abbreviations(spark, articles):
    """The abbreviations of most evidence in all articles, stored and loaded again."""
    path = _scratch(spark, "abbreviations")
    SE.save_abbreviations(SE.strongest(SE.learn_abbreviations(articles)), path)
    return SE.load_abbreviations(spark, path)


@register("t4_abbreviations")
def _t4a(spark, sf):
    return SE.learn_abbreviations(_abbreviated(spark, sf)).select("word", "stops", "others", F.round("score", 6).alias("score"))


@register("t4_c5_learned_sentences")
def _t4s(spark, sf):
    a = _abbreviated(spark, sf)
    words = _stored_abbreviations(spark, a)
    return C.filter_sentences(a, abbreviations=words).select("uuid", SE.sentence_count("article", words).alias("sentences"))


# ---- ROUGE (R*) and training examples (E*) ----------------------------------
from pressroom.operators import encode as EN  # noqa: E402
from pressroom.operators import rouge as R  # noqa: E402
from pressroom.sources.tables import prediction_pairs  # noqa: E402


def _round6(df, keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


@register("r1_prediction_pairs")
def _r1(spark, sf):
    return prediction_pairs(spark, sf)


@register("r2_rouge1_per_pair")
def _r2(spark, sf):
    return _round6(R.rouge_n(prediction_pairs(spark, sf), 1), ["uuid"])


@register("r3_rouge2_per_pair")
def _r3(spark, sf):
    return _round6(R.rouge_n(prediction_pairs(spark, sf), 2), ["uuid"])


@register("r3_rouge2_per_pair_ascii")
def _r3a(spark, sf):
    return _round6(R.rouge_n(prediction_pairs(spark, sf), 2, ascii=True), ["uuid"])


@register("r4_rougeL_per_pair")
def _r4(spark, sf):
    return _round6(R.rouge_l(prediction_pairs(spark, sf)), ["uuid"])


@register("r5_rouge_n_corpus")
def _r5(spark, sf):
    return R.corpus_scores(R.rouge_scores(prediction_pairs(spark, sf), with_l=False))


@register("r5_rouge_all_corpus")
def _r5all(spark, sf):
    return R.corpus_scores(R.rouge_scores(prediction_pairs(spark, sf), with_l=True))


@register("r5_bootstrap")
def _r5b(spark, sf):
    return R.bootstrap_scores(R.rouge_scores(prediction_pairs(spark, sf), with_l=True))


def _examples(spark, sf):
    """All articles; ``input`` is the site and the whole text."""
    a = articles_from_documents(spark, sf)
    return EN.load_examples(a.withColumn("input", F.concat_ws(" ", "site", "article")))


@register("e1_load_examples")
def _e1(spark, sf):
    return _examples(spark, sf)


@register("e2_e6_encode_examples")
def _e2(spark, sf):
    ex = _examples(spark, sf)
    vocab = EN.build_vocab(ex, ["article"])
    return EN.encode(ex, vocab)


@register("e7_e8_decode_labels")
def _e8(spark, sf):
    ex = _examples(spark, sf)
    vocab = EN.build_vocab(ex, ["article"])
    enc = EN.encode(ex, vocab)
    return EN.decode(enc, "labels", vocab)


# ---- crawl index and public suffixes (I1, I2, U2) ------------------------------
from pressroom.operators import domains as DM  # noqa: E402
from pressroom.sources import crawl_index as CI  # noqa: E402

#: rules of all kinds for the queries' hosts
SUFFIX_RULES = ("// rules of all kinds", "com", "net", "org", "jp", "co.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "uk", "co.uk",
                "*.ck", "!www.ck", "blogs.example.org", "", "a.very.long.name")
#: hosts put in place of the pages' own
OTHER_HOSTS = ("www.shop.co.jp", "a.b.kawasaki.jp", "x.city.kawasaki.jp", "kawasaki.jp", "www.ck", "deep.www.ck", "a.bar.ck", "bar.ck",
               "me.blogs.example.org", "unknown.tld", "localhost", "10.20.30.40", "co.uk", "is.a.very.long.name")


@register("u2_public_suffix_domain")
def _u2p(spark, sf):
    """All pages under their own host and under hosts that meet each kind of rule."""
    path = _scratch(spark, "suffixes")
    spark.createDataFrame([(r,) for r in SUFFIX_RULES], "value string").write.text(path)
    p = read_table(spark, sf, "pages").select("page_id", "url")
    urls = [F.col("url"), *[F.regexp_replace("url", "://[^/?#:]+", f"://{h}") for h in OTHER_HOSTS], F.lit(None).cast("string")]
    p = p.select("page_id", F.posexplode(F.array(*urls)).alias("variant", "url"))
    return DM.with_registered_domain(p, DM.read_suffix_rules(spark, path)).select("page_id", "variant", "host", "suffix", "domain", "site")


@register("i1_i2_crawl_index")
def _i12(spark, sf):
    """An index of four captures of every page, written, read, filtered by MIME type and reduced to the
    newest: as it is; under the other scheme and ``www.``, an hour later, as XHTML; in capitals with a fragment,
    earlier; and last as a PDF, which isn't wanted."""
    path = _scratch(spark, "index")
    p = read_table(spark, sf, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    other = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.)?", "//"), "^//", "ftp://www.")
    upper = F.concat(F.upper("url"), F.lit("#top"))
    kinds = [("url", F.col("url"), "text/html", 60), ("other", other, "application/xhtml+xml", 120), ("upper", upper, "text/html", 0),
             ("pdf", F.col("url"), "application/pdf", 180)]
    captures = p.select("page_id", "html", F.explode(F.array(*[F.struct(F.lit(m).alias("mime"), u.alias("url"), F.lit(t).alias("minutes"))
                                                               for _, u, m, t in kinds])).alias("c"))
    captures = captures.select("c.url", "c.mime", (F.lit("2021-07-24 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("c.minutes"))).alias("captured"),
                               F.lit(200).alias("status"), F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("length"),
                               F.col("page_id").alias("offset"), F.lit("part.warc.gz").alias("filename"))
    CI.write_index(captures, path)
    return CI.wanted_captures(CI.read_index(spark, path), I.allowed_mimes_table(spark)).select(
        "key", "captured", "url", "mime", "status", "digest", "length", "offset")


# ---- subword tokens from a stored vocabulary (E2-E8) -------------------------
import public_tokenizers  # noqa: E402

from pressroom.operators import subword as SW  # noqa: E402

#: the vocabulary file that the queries read; executors have it too
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@register("e2_e8_subword_ids")
def _e2s(spark, sf):
    """The pieces of every whole article, and the text that they decode to."""
    v = SW.read_byte_level(spark, VOCABULARY)
    a = spread(articles_from_documents(spark, sf).select("uuid", "article"), "uuid")
    x = a.select("uuid", SW.piece_ids(spark, SW.words(F.col("article")), v).alias("ids"))
    return x.select("uuid", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                    F.sha2(SW.decode(F.col("ids"), v), 256).alias("decoded_sha256"))


@register("e2_e6_subword_examples")
def _e6s(spark, sf):
    return SW.encode(spread(_examples(spark, sf), "uuid"), SW.read_byte_level(spark, VOCABULARY))


# ---- files, streaming, dates (S*, K1, T6, T9, T12) --------------------------
import uuid as _uuid  # noqa: E402

from pressroom.functions import dates as DT  # noqa: E402
from pressroom.session import ensure_checkpoint_dir  # noqa: E402
from pressroom.sinks import writers as W  # noqa: E402
from pressroom.sources import files as FS  # noqa: E402


def _scratch(spark, tag):
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{_uuid.uuid4().hex}"


@register("s2_k1_articles_jsonl_roundtrip")
def _s2(spark, sf):
    path = _scratch(spark, "articles")
    a = articles_from_documents(spark, sf, with_lang=False)
    W.append_articles(a, path)
    W.append_articles(a, path)  # a rerun appends nothing
    return FS.read_articles(spark, path).select("uuid", "article", "domain", "url", "date_of_creation",
                                                "cc_date", "site")


@register("st_streaming_extract")
def _st(spark, sf):
    from pressroom.streaming.extract import start_extract_stream
    out, ck = _scratch(spark, "stream-out"), _scratch(spark, "stream-ck")
    # a glob, because the file source watches a directory
    q = start_extract_stream(spark, f"{sf.rstrip('/')}/pages.parque[t]", out, ck)
    q.awaitTermination()
    return FS.read_articles(spark, out).select("uuid", "article", "domain", "url", "date_of_creation",
                                               "cc_date", "site")


@register("t6_human_date_parse")
def _t6(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "ts")
    parts = [e.select("event_id", F.lit(l).alias("layout"), DT.render_date(F.col("ts"), l).alias("text"))
             for l in DT.RENDER_LAYOUTS]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.select("event_id", "layout", DT.parse_human_date(F.col("text")).alias("parsed"))


@register("t6_relative_dates")
def _t6_relative(spark, sf):
    """Every event's time as the moment a page is seen: times before it in all units and languages, a day's
    word with and without a time, and a word that is no date."""
    e = read_table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("now"))
    # an event is two numbers and dozens of texts: a file's one split would be one task's work
    e = e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = (F.pmod("event_id", F.lit(60)) + 1).cast("int")
    said = [F.struct(F.lit(f"{lang} {unit}").alias("said"), DT.render_ago(n, unit, lang).alias("text"))
            for lang in DT.AGO_FORMS for unit in DT.UNITS]
    said += [F.struct(F.lit(word).alias("said"), F.lit(word).alias("text")) for word in (*DT.DAYS_BACK, "soon")]
    said += [F.struct(F.lit(f"{word} 07:45").alias("said"), F.lit(f"{word}, 07:45").alias("text")) for word in DT.DAYS_BACK]
    rows = e.select("event_id", "now", F.explode(F.array(*said)).alias("s")).select("event_id", "now", "s.*")
    return rows.select("event_id", "said", DT.parse_relative_date(F.col("text"), F.col("now")).alias("parsed"))


@register("t9_t12_iso_roundtrip")
def _t9(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "ts")
    iso = DT.iso_text(F.col("ts"))
    return e.select("event_id", iso.alias("iso"), DT.to_timestamp_column(iso).alias("back"))


@register("k3_write_splits_roundtrip")
def _k3(spark, sf):
    path = _scratch(spark, "splits")
    W.write_splits(DP.deduplicate(_dedup_input(spark, sf)), path)
    back = spark.read.schema("uuid string").json(path)  # split and site come from the directories
    return back.groupBy("split", "site").agg(F.count(F.lit(1)).alias("n"))


@register("k7_s8_encoded_roundtrip")
def _k7(spark, sf):
    path = _scratch(spark, "encoded")
    ex = _examples(spark, sf)
    W.write_encoded(EN.encode(ex, EN.build_vocab(ex, ["article"])), path)
    return FS.read_encoded(spark, path)


@register("d5_losers_exact_jaccard")
def _d5(spark, sf):
    from pressroom.config import Config
    return D.near_duplicate_losers(_dedup_input(spark, sf), cfg=Config(exact_jaccard=True)).select("uuid")


# ---- page layouts of the four sites (H3, H5-H11, K8) -------------------------

LAYOUT_URLS = ("https://telex.hu/belfold/2021/07/24/", "https://telex.hu/kulfold/", "https://index.hu/gazdasag/",
               "https://index.hu/sport/", "https://www.ac24.cz/zpravy/", "https://www.ac24.cz/clanek/",
               "https://www.parlamentnilisty.cz/arena/", "https://www.ac24.cz/prazdny/", "https://www.nowhere.org/",
               "https://index.hu/belfold/")
LAYOUT_HTML = (
    '<body><p class="history--original">2021. j&uacute;lius 24., szombat 10:32</p><div class=article-html-content>'
    '<p>@P@</p><figure class="image"><figcaption>caption</figcaption></figure><p><a href="/legfrissebb"><strong>newest'
    '</strong></a> and more</p><table><tr><td>cell</table></div></body>',
    '<body><div class="liveblog"></div><div class="article-html-content"><p>@P@</p></div></body>',
    '<body><div class="datum">2021. július 25. 08:15 Módosítva: 2021. július 25. 09:00</div><div class="cikk-torzs">'
    '<p><strong>lead</strong></p><p>@P@</p><div class="cikk-bottom-box">advert</div></div></body>',
    '<body><span class="ido"> </span><time class="t-asd_share-date_date">2021-07-26 12:00</time>'
    '<div class="szoveg"><p>@P@<br>line</p></div></body>',
    '<body><time class="published">24. července 2021 v 14:05</time><div class="component-inner"><p>@P@</p>'
    '<script>var a = "</p>";</script><figure><img src="a.jpg"><figcaption>caption</figcaption></figure><p>end</p></div></body>',
    '<body><time class="updated">25. 7. 2021 9:30</time><div id="ac24-article-content">1 < 2 <div class="socbuttons">share'
    '<b>it</div><p>@P@</div></body>',
    '<body><div class="time">25/07/2021 9:30</div><section class="article-content"><p>a <img src="x>y.png"> b</p>'
    '<section class="poll">poll</section><p>@P@</p></section></body>',
    '<body><div class="other">@P@</div></body>',
    '<body><article>@P@</article></body>',
    '<body><div class="pp-article-site"><div class="text">@P@</div></div></body>',
)


def whole_layout_pages(spark, sf):
    """Every page in every layout, around its article's whole inner html: ten rows a page, numbered
    page_id * 10 + layout.  An article that isn't closed ends at the footer or with the page."""
    page = F.coalesce("html", F.lit(""))
    inner = F.when(page.rlike("(?i)</article>"), F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*)</article>", 1)) \
        .otherwise(F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*?)(?:<footer|\z)", 1))
    layouts = [F.struct(F.lit(u).alias("url"), F.lit(h.replace("<p>@P@", "<div>@P@</div><p>")).alias("html"))
               for u, h in zip(LAYOUT_URLS, LAYOUT_HTML)]
    # a file's one split would be one task's work, ten layouts of every page
    pages = read_table(spark, sf, "pages").select("page_id", "html").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = pages.select("page_id", inner.alias("inner"))
    p = p.select("page_id", "inner", F.posexplode(F.array(*layouts)).alias("k", "layout"))
    number = F.col("page_id") * 10 + F.col("k")
    return p.select(number.alias("page_id"), F.concat("layout.url", number.cast("string")).alias("url"),
                    F.replace(F.col("layout.html"), F.lit("@P@"), F.col("inner")).alias("html"))


@register("h2_h12_site_layouts_whole")
def _layouts_whole(spark, sf):
    ex = scrape.extract(whole_layout_pages(spark, sf))
    return ex.select("page_id", "site", "domain", "article", "date_of_creation", "reject_reason")


@register("k8_reject_log_layouts_whole")
def _k8w(spark, sf):
    return scrape.rejects(scrape.extract(whole_layout_pages(spark, sf)))


# ---- round trips through files (S1, S5, S7, K1, K2, K4-K6, U4, U5) ---------------

def _warc_records(spark, sf):
    """(value): all pages as the bytes of WARC records, each twice, at a time of its own, every third body
    in Latin-1."""
    crlf = "\r\n"
    p = read_table(spark, sf, "pages")
    p = p.select("page_id", "url", F.concat("html", F.lit("é")).alias("html"))
    p = p.unionByName(p)
    latin = F.regexp_replace("html", r"[^\x00-\xff]", "?")
    body = F.when(F.col("page_id") % 3 == 0, F.encode(latin, "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    block = F.concat(F.encode(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html{crlf}{crlf}"), "UTF-8"), body)
    head = F.concat(F.lit(f"WARC/1.0{crlf}WARC-Type: response{crlf}WARC-Target-URI: "), "url",
                    F.lit(f"{crlf}WARC-Date: "), F.date_format(F.timestamp_seconds(F.col("page_id") + 1_627_122_720), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                    F.lit(f"{crlf}Content-Length: "),
                    F.octet_length(block).cast("string"), F.lit(crlf + crlf))
    return p.select(F.concat(F.encode(head, "UTF-8"), block).alias("value"))


@register("s1_u4_u5_warc_roundtrip")
def _s1(spark, sf):
    """All pages as WARC records, and back."""
    from pressroom.sources.warc import read_warc_pages
    path = _scratch(spark, "warc")
    _warc_records(spark, sf).select(F.col("value").cast("string")) \
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    # every record is written twice; the second is no page of its own
    return read_warc_pages(spark, path).select("url", "cc_date", F.sha2("html", 256).alias("html_sha"))


@register("s1_warc_member_index")
def _s1_index(spark, sf):
    """The same records, each a gzip member, found and read again by their offsets."""
    from pressroom.sources.warc_members import read_indexed_pages, write_members
    path = _scratch(spark, "members")
    end = F.encode(F.lit("\r\n\r\n"), "UTF-8")
    write_members(_warc_records(spark, sf).select(F.concat("value", end).alias("value")), path)
    return read_indexed_pages(spark, path).select("url", "cc_date", F.sha2("html", 256).alias("html_sha"))


@register("k1_append_repeated_ids")
def _k1(spark, sf):
    """A batch that holds every article twice is stored once."""
    path = _scratch(spark, "repeated")
    a = articles_from_documents(spark, sf, with_lang=False)
    W.append_articles(a.unionByName(a), path)
    return FS.read_articles(spark, path).select("uuid", "article", "site")


@register("k1_append_by_year")
def _k1y(spark, sf):
    """Three appends, each with half of the rows of the one before; ids are looked up in the years of their own batch."""
    path = _scratch(spark, "by-year")
    a = articles_from_documents(spark, sf, with_lang=False)
    third = F.pmod(F.xxhash64("uuid"), F.lit(4))
    for low, high in ((0, 1), (1, 2), (2, 3)):
        W.append_articles(a.where(third.between(low, high)), path, within="cc_date", unit="year")
    return FS.read_articles(spark, path).select("uuid", "article", "site")


@register("k2_overwrite_by_site")
def _k2(spark, sf):
    """All articles, then those of every second id again with a mark: the sites written anew hold only these."""
    path = _scratch(spark, "overwrite")
    a = articles_from_documents(spark, sf, with_lang=False).select("uuid", "url", "site")
    W.overwrite_by_site(a, path)
    again = a.where((F.col("uuid").cast("long") % 2 == 0) & (F.col("site") < "n"))
    W.overwrite_by_site(again.withColumn("url", F.lit("again")), path)
    return spark.read.schema("uuid string, url string, site string").json(path).select("uuid", "url", "site")


@register("k4_stats_csv_roundtrip")
def _k4(spark, sf):
    path = _scratch(spark, "stats")
    d = G.describe(corpus.articles_with_stats(spark, sf), "article_length", "domain")
    W.write_stats_csv(d, path)
    return spark.read.schema(d.schema).option("header", True).csv(path)


@register("k5_metrics_json_roundtrip")
def _k5(spark, sf):
    path = _scratch(spark, "metrics")
    m = R.corpus_scores(R.rouge_scores(prediction_pairs(spark, sf), with_l=True))
    W.write_metrics_json(m, path)
    return spark.read.schema(m.schema).json(path)


@register("k6_s5_predictions_roundtrip")
def _k6(spark, sf):
    path = _scratch(spark, "predictions")
    W.write_predictions(prediction_pairs(spark, sf), path)
    return FS.read_predictions(spark, path).select("uuid", "generated", "article")


@register("s7_site_by_url_prefix")
def _s7(spark, sf):
    """A written SITE|URL list, joined to the pages by URL prefix."""
    path = _scratch(spark, "sites")
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    prefix = F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/?#]+/[^/?#]*)", 1)
    pages.where("page_id % 3 = 0").select(F.concat_ws("|", F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([^/?#]+)", 1), prefix)
                                          .alias("value")).distinct().write.text(path)
    return I.with_listed_site(pages, FS.read_site_list(spark, path)).select("page_id", "listed_site")
