"""U2 with a public-suffix table: registered domains by rules as rows.

A rule file has a rule a line: a suffix (``co.uk``), a wildcard (``*.ck``: any one label
before it) or an exception to one (``!www.ck``); ``//`` opens a comment.  Each distinct host
offers its own suffixes, which meet the rules by equality, so neither the rules
nor the hosts need to fit a pattern or a task.  An exception prevails, else the longest rule;
without any, the last label is the suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions import urls as U
from pressroom.operators.salted import meet
from pressroom.sources.files import read_lines

ADDRESS = r"^(\d{1,3}\.){3}\d{1,3}$|^\["


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, kind) with kind plain, wild or except; a rule given twice is one."""
    rule = F.lower(F.regexp_extract("value", r"^\s*([^\s/]\S*)", 1))
    rows = read_lines(spark, path).where(~F.col("value").rlike(r"^\s*//")).select(rule.alias("rule")).where("rule <> ''")
    kind = F.when(F.col("rule").startswith("!"), "except").when(F.col("rule").startswith("*."), "wild").otherwise("plain")
    return rows.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind")).distinct()


def registered_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix, domain) for each distinct non-null ``host``: the public suffix and the
    domain registered below it.  A host that is a suffix itself stays whole, and so does an
    address, which has no suffix."""
    h = hosts.where("host IS NOT NULL AND host <> ''").select("host").distinct()
    named = h.where(~F.col("host").rlike(ADDRESS)).select("host", F.split(F.regexp_replace("host", r"\.$", ""), r"\.").alias("labels"))
    n = F.size("labels")
    tail = lambda k: F.array_join(F.slice("labels", n - k + 1, k), ".")
    # a suffix of k labels: as it stands, as an exception, and by its k - 1 last labels as a wildcard
    own = named.select("host", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(
        k.alias("k"), tail(k).alias("s"), F.when(k > 1, tail(k - 1)).alias("parent")))).alias("c"))
    probes = own.select("host", "c.k", F.explode(F.array(
        F.struct(F.lit("plain").alias("kind"), F.col("c.s").alias("suffix")),
        F.struct(F.lit("except").alias("kind"), F.col("c.s").alias("suffix")),
        F.struct(F.lit("wild").alias("kind"), F.col("c.parent").alias("suffix")))).alias("p")) \
        .select("host", "k", "p.kind", "p.suffix").where("suffix IS NOT NULL")
    hits = meet(probes, rules, ["suffix", "kind"], "host")
    size = F.when(F.col("kind") == "except", F.col("k") - 1).otherwise(F.col("k"))
    best = hits.groupBy("host").agg(F.max_by(size, F.struct((F.col("kind") == "except"), "k")).alias("size"))
    k = F.least(F.coalesce("size", F.lit(1)), n)
    found = named.join(best, "host", "left").select(
        "host", tail(k).alias("suffix"), F.when(n <= k, F.array_join("labels", ".")).otherwise(tail(k + 1)).alias("domain"))
    none = F.lit(None).cast("string")
    return found.unionByName(h.where(F.col("host").rlike(ADDRESS)).select("host", none.alias("suffix"), F.col("host").alias("domain")))


def with_registered_domain(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """U2 + U3: ``pages`` with host, suffix, domain and site; null where the URL has no host.  A host
    that many pages share meets its domain in salted parts."""
    hosted = pages.withColumn("host", U.host(F.col(url_col)))
    # a join on a null host finds nothing, and its own row must stay
    known = meet(hosted.where("host IS NOT NULL"), registered_domains(hosted, rules), ["host"], id_col, "left")
    return known.unionByName(hosted.where("host IS NULL"), allowMissingColumns=True).withColumn("site", U.site_key(F.col("domain")))
