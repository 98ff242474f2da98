"""URL and crawl-record scalars (U1-U6) as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The URL blocklist of the reference, one regex per line,
# scheme and optional "www." excluded, in the reference's order.
# ---------------------------------------------------------------------------
BAD_URL_RULES = (
    r"telex.hu/cimke/.*",
    r"telex.hu/szerzo/.*",
    r"telex.hu/rss/.*",
    r"telex.hu/rovat/.*",
    r"telex.hu/dokumentum/.*",
    r"telex.hu/archivum/.*",
    r"telex.hu/napirajz/.*",
    r"telex.hu/video/.*",
    r"telex.hu/kedvenceink.*",
    r"telex.hu/legfrissebb.*",
    r"telex.hu/legfontosabb.*",
    r"telex.hu/vesezo/.*",
    r"telex.hu/english/.*",
    r"telex.hu/english\?.*",
    r"index.hu/wanted/.*",
    r"index.hu/24ora/\?cimke=.*",
    r"index.hu/kultur/musor/.*",
    r"index.hu/24ora/.*tol=.*&ig.*",
    r"index.hu/video/.*",
    r"index.hu/szarvas/.*",
    r"index.hu/szerzo/.*",
    r"index.hu/.*/cimkek/",
    r"index.hu/napirajz/.*",
    r"index.hu/politika/belfold/2006/elkurtuk/videok/.*",
    r"ac24.cz/.*/embed/.*",
    r"ac24.cz/.*/mailto/.*",
    r"ac24.cz/component/.*",
    r"ac24.cz/rubrika/.*",
    r"ac24.cz/v-puvodnim-zneni",
    r"ac24.cz/tag/.*",
    r"ac24.cz/uvod\?.*",
    r"ac24.cz/.*/\?format=feed&type=rss",
    r"ac24.cz/.*/index.php.*",
    r"parlamentnilisty.cz/profily/.*",
    r"parlamentnilisty.cz/profily\?p=.*",
    r"parlamentnilisty.cz/galerie/.*",
    r"parlamentnilisty.cz/tv/.*",
)

# Second-level names under which country domains register (U2): fixed values.
# ``x.<name>.<two letters>`` is a registered domain for each of them; everywhere
# else it is the last two labels.  ``extra`` names suffixes beyond the rule.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")

CRAWL_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def blocklist_pattern(rules=BAD_URL_RULES) -> str | None:
    """One start-anchored alternation.

    The reference compiles ``'^{}$'.format('|'.join(...))`` and uses
    ``match``; so every rule is anchored at the start and all but the last
    are prefix matches (the last ends in ``.*`` and is one too).  ``rlike``
    searches, hence the explicit ``^`` around one outer group.  No rules
    means no pattern (keep everything).
    """
    rules = [r.strip() for r in rules if r and r.strip()]
    if not rules:
        return None
    return r"^(?:https?://(?:www\.)?(?:" + "|".join(rules) + "))"


def is_blocked(url: Column, rules=BAD_URL_RULES) -> Column:
    pat = blocklist_pattern(rules)
    return F.lit(False) if pat is None else url.rlike(pat)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def registered_domain(url: Column, extra: tuple[str, ...] = ()) -> Column:
    """``domain.suffix``.  The suffix is the longest of ``extra`` that the host
    ends in, else ``<second level>.<country>`` by the rule above, else the last
    label.  A host that is a suffix itself, an IP address or a single label stays
    whole; a URL without a readable host gives null."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    by_rule = F.when(F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL) & (F.length(F.try_element_at(labels, F.lit(-1))) == 2),
                     F.lit(2)).otherwise(F.lit(1))
    k = by_rule
    for size in sorted({s.count(".") + 1 for s in extra}):
        own = [s for s in extra if s.count(".") + 1 == size]
        k = F.when((n >= size) & last(size).isin(*own), F.greatest(k, F.lit(size))).otherwise(k)
    address = h.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") | h.startswith("[")
    return F.when(address | (n <= k), h).otherwise(F.array_join(F.slice(labels, n - k, k + 1), "."))


def site_key(domain: Column) -> Column:
    """Text before the first dot."""
    return F.substring_index(domain, ".", 1)


def crawl_timestamp(s: Column) -> Column:
    """WARC-Date text to a naive timestamp; null when it does not fit."""
    return F.try_to_timestamp(s, F.lit(CRAWL_DATE_FORMAT)).cast("timestamp_ntz")


def decode_payload(b: Column) -> Column:
    """UTF-8 when valid, else Latin-1 (which decodes any byte string)."""
    as_utf8 = b.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(b, "ISO-8859-1"))


def canonical_url(url: Column) -> Column:
    """I2 key: no scheme, no ``www.``, no fragment, no trailing slash, lower-case host."""
    no_frag = F.regexp_replace(url, r"#.*$", "")
    no_scheme = F.regexp_replace(no_frag, r"^[A-Za-z][A-Za-z0-9+.-]*://(www\.)?", "")
    hostpart = F.lower(F.substring_index(no_scheme, "/", 1))
    rest = F.regexp_replace(no_scheme, r"^[^/]*", "")
    return F.regexp_replace(F.concat(hostpart, rest), r"/+$", "")


def sniff_mime(html: Column) -> Column:
    """I1 stand-in for the index's MIME field: HTML when the payload starts
    like an HTML document, after any byte-order mark, XML declaration and
    comments, else plain text."""
    start = r"(?is)^\x{FEFF}?\s*(?:(?:<\?xml.*?\?>|<!--.*?-->)\s*)*<(?:!doctype\s+html|html)\b"
    return F.when(html.rlike(start), F.lit("text/html")).otherwise(F.lit("text/plain"))
