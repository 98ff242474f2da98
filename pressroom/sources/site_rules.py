"""Per-site extraction rules as data rows.

The reference encodes these as one scraper class per site; here they are rows
of a rule table, compiled into column predicates by ``operators.html``.

Row fields: site, role, priority, selector, mode.
* role: ``body`` (first element of the best priority is the article),
  ``date`` (same, its text is parsed), ``date_fallback`` (used when the
  chosen date text is blank), ``reject`` (page is invalid when it occurs),
  ``remove`` (subtree dropped before date and body are read), ``lead``
  (subtree dropped from the body copy only).
* selector: a chain ``(tag, attr, value)`` from the outermost ancestor to the
  element, each step a direct child of the previous (``p > a[href=..] > strong``);
  attr is ``class`` (token of the class list), ``id``, ``href`` or None.
* mode (dates): ``whole`` text, ``first_line`` then whole, ``cut`` at
  "Módosítva".
* site ``*`` applies to every site.
"""

from __future__ import annotations

from dataclasses import dataclass

Step = tuple[str, str | None, str | None]


@dataclass(frozen=True)
class Rule:
    site: str
    role: str
    selector: tuple[Step, ...]
    priority: int = 0
    mode: str = "whole"


def _s(tag: str, attr: str | None = None, value: str | None = None) -> tuple[Step, ...]:
    return ((tag, attr, value),)


# ---------------------------------------------------------------------------
# The reference's extraction rules, site by site, in order.
# ---------------------------------------------------------------------------
REFERENCE_RULES: tuple[Rule, ...] = (
    # every site
    Rule("*", "remove", _s("table")),
    # telex
    Rule("telex", "body", _s("div", "class", "article-html-content"), 1),
    Rule("telex", "date", _s("p", "class", "history--original"), 1),
    Rule("telex", "date", _s("p", "id", "original_date"), 2),
    Rule("telex", "date", _s("div", "class", "article_date"), 3, "first_line"),
    Rule("telex", "reject", _s("div", "class", "liveblog")),
    Rule("telex", "remove", _s("div", "class", "long-img")),
    Rule("telex", "remove", _s("figure", "class", "media")),
    Rule("telex", "remove", _s("figure", "class", "image")),
    Rule("telex", "remove", _s("div", "class", "article-endbox-campaign-content")),
    Rule("telex", "remove", (("p", None, None), ("a", "href", "/legfrissebb"), ("strong", None, None))),
    # index
    Rule("index", "body", _s("div", "class", "cikk-torzs"), 1),
    Rule("index", "body", _s("div", "class", "text"), 2),
    Rule("index", "body", _s("div", "class", "post_text"), 3),
    Rule("index", "body", _s("div", "class", "szoveg"), 4),
    Rule("index", "lead", (("div", "class", "cikk-torzs"), ("p", None, None), ("strong", None, None))),
    Rule("index", "date", _s("div", "class", "datum"), 1, "cut"),
    Rule("index", "date", _s("time", "class", "m-asd_time_date"), 2, "cut"),
    Rule("index", "date", _s("span", "class", "ido"), 3, "cut"),
    Rule("index", "date_fallback", _s("time", "class", "t-asd_share-date_date"), 4),
    Rule("index", "reject", _s("div", "class", "pp-article-site")),
    Rule("index", "remove", _s("div", "class", "cikk-bottom-text-ad")),
    Rule("index", "remove", _s("div", "class", "cikk-bottom-box")),
    Rule("index", "remove", _s("div", "class", "pr__cikk-bottomcontent")),
    Rule("index", "remove", _s("nav", "class", "pager")),
    Rule("index", "remove", _s("div", "class", "iframe-embed-container")),
    Rule("index", "remove", _s("div", "class", "szerkfotogallery")),
    Rule("index", "remove", _s("div", "class", "szerkfotoimage")),
    Rule("index", "remove", _s("div", "class", "keretes-donate-doboz")),
    Rule("index", "remove", _s("aside", "class", "m-automatic-file-snippet")),
    Rule("index", "remove", _s("div", "class", "m-kepkuldes-box")),
    Rule("index", "remove", _s("div", "class", "nm_supported__wrapper")),
    Rule("index", "remove", _s("div", "class", "nm_thanks__wrapper")),
    Rule("index", "remove", _s("div", "class", "photographer")),
    Rule("index", "remove", _s("div", "class", "indavideo")),
    Rule("index", "remove", _s("div", "id", "index-social-box")),
    Rule("index", "remove", _s("blockquote", "class", "tiktok-embed")),
    Rule("index", "remove", _s("section", "class", "connected")),
    Rule("index", "remove", _s("div", "class", "post_bottom")),
    Rule("index", "remove", _s("div", "class", "nm_mini__wrapper")),
    Rule("index", "remove", _s("div", "class", "table_container")),
    Rule("index", "remove", _s("div", "class", "szoveg_spec_container")),
    # ac24
    Rule("ac24", "body", _s("div", "class", "post-content"), 1),
    Rule("ac24", "body", _s("div", "id", "ac24-article-content"), 2),
    Rule("ac24", "body", _s("div", "class", "ac24-article-content"), 3),
    Rule("ac24", "body", _s("div", "class", "component-inner"), 4),
    Rule("ac24", "date", _s("time", "class", "updated"), 1),
    Rule("ac24", "date", _s("time", "class", "published"), 2),
    Rule("ac24", "remove", _s("div", "class", "adswrapper_post")),
    Rule("ac24", "remove", _s("div", "class", "twitter-tweet")),
    Rule("ac24", "remove", _s("div", "class", "credits")),
    Rule("ac24", "remove", _s("div", "class", "socbuttons")),
    Rule("ac24", "remove", _s("div", "id", "jc")),
    Rule("ac24", "remove", _s("span", "class", "formInfo")),
    Rule("ac24", "remove", _s("figure")),
    Rule("ac24", "remove", _s("script")),
    # parlamentnilisty
    Rule("parlamentnilisty", "body", _s("section", "class", "article-content"), 1),
    Rule("parlamentnilisty", "date", _s("div", "class", "time"), 1),
    Rule("parlamentnilisty", "remove", _s("img")),
    Rule("parlamentnilisty", "remove", _s("section", "class", "poll")),
    Rule("parlamentnilisty", "remove", _s("section", "class", "related-articles-wrap")),
    Rule("parlamentnilisty", "remove", _s("section", "class", "in-article")),
)

# Test binding: the driver's pages share one layout (site "example"):
# the article element is the body; navigation, ads and footer are dropped.
BINDING_RULES: tuple[Rule, ...] = (
    Rule("example", "body", _s("article"), 1),
    Rule("example", "remove", _s("nav")),
    Rule("example", "remove", _s("div", "class", "ad")),
    Rule("example", "remove", _s("footer")),
)

ALL_RULES: tuple[Rule, ...] = REFERENCE_RULES + BINDING_RULES


def sites(rules=ALL_RULES) -> list[str]:
    return sorted({r.site for r in rules if r.site != "*"})
