"""HTML extraction without a DOM library.

A page is split into an array of tokens; one small Arrow-batched helper runs the
open-element stack over their names and says, per token, where its element ends
and which element is its parent.  A close tag ends the latest open element of its
name and all elements left open inside it; one without an open element is ignored.
So an unclosed element ends with its parent.  A page stays one row; the rest are
columns of its arrays:

* site rules: a literal map gives a page the rules of its site by the tag of their
  last step; attributes are read only of tokens whose tag has rules;
* child selectors compare the parent's and grandparent's name, class, id, href;
* removal: a token is dropped when a flagged element opened before it ends at or
  after it, a running maximum over the page.

So what is sorted and shuffled grows with pages, not with tokens, and a row never
holds more than the pages of one id.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "param", "source", "track", "wbr")
BLOCK = ("address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "figcaption",
         "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li",
         "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")

# A tag starts with a letter; a quoted attribute value may hold ">".  Other "<" are text.
TOKEN_RE = (r"""</?[A-Za-z](?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=)*+>|<[!?/][^>]*>|[^<]+|<""")
COMMENT_RE = r"(?s)<!--.*?-->"
SCRIPT_RE = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE_RE = r"(?is)<style\b[^>]*>.*?</style\s*>"


def _attr(tok: Column, name: str) -> Column:
    """Value of an attribute, quoted or not; empty when there is none."""
    pat = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tok.contains("="), F.concat(*[F.regexp_extract(tok, pat, g) for g in (1, 2, 3)])).otherwise(F.lit(""))


def _element(x: Column) -> Column:
    """What selectors ask of a token."""
    return F.struct(x["name"].alias("name"), F.split(F.trim(_attr(x["tok"], "class")), r"\s+").alias("cls"),
                    _attr(x["tok"], "id").alias("elem_id"), _attr(x["tok"], "href").alias("href"))


def mask(html: Column) -> Column:
    """Drop comments; empty script and style bodies (a script string may hold ``</p>``)."""
    h = F.when(html.contains("<!--"), F.regexp_replace(html, COMMENT_RE, "")).otherwise(html)
    h = F.regexp_replace(h, SCRIPT_RE, "<script></script>")
    return F.regexp_replace(h, STYLE_RE, "<style></style>")


_TREE = T.StructType([T.StructField("end", T.ArrayType(T.IntegerType())), T.StructField("parent", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_TREE)
def _element_tree(marks: pd.Series) -> pd.DataFrame:
    """Per token of a page, given as ``name``, ``/name`` or nothing between blanks: the position
    where its element ends (itself but for open tags) and that of its parent's open tag, -1 at the top."""
    ends, parents = [], []
    for text in marks:
        page = text.split(" ") if isinstance(text, str) else []
        n = len(page)
        end, parent, stack, is_open, top = list(range(n)), [-1] * n, [], {}, -1
        for i, mark in enumerate(page):
            if mark[:1] == "/":
                name = mark[1:]
                while is_open.get(name):  # without an open element of the name: ignored
                    j, inner = stack.pop()
                    is_open[inner] -= 1
                    end[j] = i if inner == name else i - 1
                    if inner == name:
                        break
                top = stack[-1][0] if stack else -1
            parent[i] = top
            if mark and mark[0] != "/":
                stack.append((i, mark))
                is_open[mark] = is_open.get(mark, 0) + 1
                top = i
        for j, _ in stack:
            end[j] = n - 1
        ends.append(end)
        parents.append(parent)
    return pd.DataFrame({"end": ends, "parent": parents})


def _tokens(html: Column) -> Column:
    """array<struct<tok, kind, name>>; a token that doesn't begin with "<" is text."""
    def kind(x: Column) -> Column:
        tok, name = x["tok"], x["name"]
        is_open_tag = tok.rlike(r"^<[A-Za-z].*(?s)>$")
        return (F.when(~tok.startswith("<"), F.lit("text"))
                .when(tok.startswith("</") & (name != ""), F.lit("close"))
                .when(is_open_tag & (name.isin(list(VOID)) | tok.rlike(r"/\s*>$")), F.lit("void"))
                .when(is_open_tag, F.lit("open"))
                .when(tok.rlike(r"^<[!?/]"), F.lit("other"))
                .otherwise(F.lit("text")))

    name = lambda tok: F.when(tok.startswith("<"), F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))).otherwise(F.lit(""))
    named = F.transform(F.regexp_extract_all(mask(html), F.lit(TOKEN_RE), 0), lambda tok: F.struct(tok.alias("tok"), name(tok).alias("name")))
    return F.transform(named, lambda x: F.struct(x["tok"].alias("tok"), kind(x).alias("kind"), x["name"].alias("name")))


def with_tokens(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """H1: ``toks``, the page's tokens (tok, kind, name), and ``tree``, their elements' ends and
    parents, in place of the html.  A null page has null tokens and an empty tree."""
    t = pages.withColumn("toks", _tokens(F.col(html_col))).drop(html_col)
    marks = F.transform("toks", lambda x: F.when(x["kind"] == "open", x["name"])
                        .when(x["kind"] == "close", F.concat(F.lit("/"), x["name"])).otherwise(F.lit("")))
    return t.withColumn("tree", _element_tree(F.when(F.size("toks") > 0, F.array_join(marks, " "))))


def tokenize(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
             keep: tuple[str, ...] = ("site",)) -> DataFrame:
    """H1, a row a token: (page_id, keep..., pos, tok, kind, name, cls, elem_id, href, end, anc1, anc2).

    ``end`` is the last position of the element a token opens (its own position for
    other tokens); ``anc1`` and ``anc2`` are (name, cls, elem_id, href) of parent and
    grandparent, null where there is none.  A null page has no tokens."""
    t = with_tokens(pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).alias("html")))
    # attributes only of the few open tags that are somebody's parent, at most once each
    t = t.withColumn("info", F.transform("toks", lambda x: F.when(x["kind"] == "open", _element(x))))
    at = lambda i: F.when(i >= 0, F.get("info", i))
    up = lambda i: F.when(i >= 0, F.get("tree.parent", i))
    t = t.select("page_id", *keep, F.posexplode(F.zip_with(
        "toks", F.arrays_zip(F.col("tree.end").alias("end"), F.col("tree.parent").alias("parent")),
        lambda x, e: F.struct(x["tok"], x["kind"], x["name"], e["end"],
                              at(e["parent"]).alias("anc1"), at(up(e["parent"])).alias("anc2")))).alias("pos", "t"))
    t = t.select("page_id", *keep, "pos", "t.*")
    tok = F.col("tok")
    return t.withColumns({
        "cls": F.split(F.trim(_attr(tok, "class")), r"\s+"),
        "elem_id": _attr(tok, "id"),
        "href": _attr(tok, "href"),
    })


# --------------------------------------------------------------------------- rules
#
# Rules are looked up, not expanded: a literal map gives the rules of a page's site
# (and of ``*``) by the tag of their last step, once per page.  Only tokens of those
# tags are looked into, so the cost per token does not grow with the number of sites.

_ENTRY = "struct<role:string,priority:int,mode:string,attr:string,value:string,p_tag:string,p_attr:string,p_value:string," \
         "g_tag:string,g_attr:string,g_value:string>"


def _by_tag(rules) -> Column:
    tags: dict[str, list] = {}
    for r in rules:
        tag, attr, value = r.selector[-1]
        near, far = (list(reversed(r.selector[:-1])) + [(None, None, None)] * 2)[:2]
        tags.setdefault(tag, []).append((r.role, r.priority, r.mode, attr, value, *near, *far))
    items = [x for tag, entries in tags.items()
             for x in (F.lit(tag), F.array(*[F.struct(*[F.lit(v) for v in e]) for e in entries]).cast(f"array<{_ENTRY}>"))]
    return F.create_map(*items).cast(f"map<string,array<{_ENTRY}>>")


def rules_of(site: Column, rules) -> Column:
    """map<tag, array<entry>>: the rules that hold for a site's pages."""
    items = [x for s in sorted({r.site for r in rules} - {"*"}) for x in (F.lit(s), _by_tag([r for r in rules if r.site in (s, "*")]))]
    everywhere = _by_tag([r for r in rules if r.site == "*"])
    return F.coalesce(F.try_element_at(F.create_map(*items), site), everywhere) if items else everywhere


def _attr_ok(el: Column, attr: Column, value: Column) -> Column:
    hit = (((attr == "class") & F.array_contains(el["cls"], value))
           | ((attr == "id") & (el["elem_id"] == value))
           | ((attr == "href") & (el["href"] == value)))
    return attr.isNull() | F.coalesce(hit, F.lit(False))


def _anc_ok(anc: Column, tag: Column, attr: Column, value: Column) -> Column:
    return tag.isNull() | F.coalesce((anc["name"] == tag) & _attr_ok(anc, attr, value), F.lit(False))


def matched_rules(toks: Column, tree: Column, rules: Column) -> Column:
    """array<struct<pos, end, kind, rules>>: the open and void tokens that end a selector of ``rules``
    (``rules_of``), with its entries."""
    tags = F.map_keys(rules)
    asked = F.filter(F.transform(toks, lambda x, i: F.when(x["kind"].isin("open", "void") & F.array_contains(tags, x["name"]), i)),
                     lambda i: i.isNotNull())
    found = F.transform(asked, lambda i: F.struct(i.alias("pos"), _element(F.get(toks, i)).alias("el")))
    found = F.transform(found, lambda t: F.struct(t["pos"].alias("pos"), F.filter(
        F.try_element_at(rules, t["el"]["name"]), lambda e: _attr_ok(t["el"], e["attr"], e["value"])).alias("rules")))
    found = F.filter(found, lambda t: F.size(t["rules"]) > 0)
    # parents are read only where a rule asks for them
    parent = lambda i: F.get(tree["parent"], i)
    at = lambda i: F.when(i >= 0, _element(F.get(toks, i)))
    above = lambda i: F.struct(at(parent(i)).alias("near"), at(F.when(parent(i) >= 0, parent(parent(i)))).alias("far"))
    found = F.transform(found, lambda t: F.struct(
        t["pos"].alias("pos"), t["rules"].alias("rules"),
        F.when(F.exists(t["rules"], lambda e: e["p_tag"].isNotNull()), above(t["pos"])).alias("above")))
    return F.transform(found, lambda t: F.struct(
        t["pos"].alias("pos"), F.get(tree["end"], t["pos"]).alias("end"), F.get(toks, t["pos"])["kind"].alias("kind"),
        F.filter(t["rules"], lambda e: _anc_ok(t["above"]["near"], e["p_tag"], e["p_attr"], e["p_value"])
                 & _anc_ok(t["above"]["far"], e["g_tag"], e["g_attr"], e["g_value"])).alias("rules")))


def with_role(matched: Column, role: str) -> Column:
    """The matched tokens that have an entry of ``role``."""
    return F.filter(matched, lambda t: F.exists(t["rules"], lambda e: e["role"] == role))


def best_of_role(entries: Column, role: str) -> Column:
    """min (priority, mode) among a token's entries of ``role``; null if none."""
    return F.array_min(F.transform(F.filter(entries, lambda e: e["role"] == role),
                                   lambda e: F.struct(e["priority"].alias("priority"), e["mode"].alias("mode"))))


# --------------------------------------------------------------------------- text

def _listed(texts) -> Column:
    """A fixed array<string> as one literal: with one a text, building the plan takes seconds."""
    return F.split(F.lit("\x1f".join(texts)), "\x1f")


def _code_point(n: Column) -> Column:
    """A numeric reference's character; those in 128-159 mean Windows-1252, and
    numbers of no character give U+FFFD."""
    ok = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    high = n - 0x10000
    unit = lambda u: F.lpad(F.hex(u), 4, "0")
    utf16 = F.when(n < 0x10000, unit(n)).otherwise(
        F.concat(unit(F.lit(0xD800) + F.shiftright(high, 10)), unit(F.lit(0xDC00) + high.bitwiseAND(F.lit(0x3FF)))))
    old = _listed(bytes([k]).decode("cp1252", "replace") for k in range(128, 160))
    return F.when(n.between(128, 159), F.get(old, (n - 128).cast("int"))) \
        .when(ok, F.decode(F.unhex(utf16), "UTF-16BE")).otherwise(F.lit("\ufffd"))


def _reference(r: Column, names: Column) -> Column:
    dec = F.regexp_extract(r, r"^&#(\d{1,9});?$", 1)
    hexa = F.regexp_extract(r, r"^&#[xX]([0-9A-Fa-f]{1,7});?$", 1)
    return (F.when(dec != "", _code_point(dec.try_cast("long")))
            .when(hexa != "", _code_point(F.conv(hexa, 16, 10).try_cast("long")))
            .otherwise(F.coalesce(F.try_element_at(names, F.substr(r, F.lit(2))), r)))


def decode_entities(s: Column) -> Column:
    """Named (the HTML5 table of Python's standard library) and numeric character
    references; unknown ones stay as they are.  Text without "&" is passed by."""
    # a map is searched from its start: the names that pages use most come first
    often = dict.fromkeys(k for k in ("amp;", "nbsp;", "quot;", "lt;", "gt;", *(f"{k};" for k in name2codepoint)))
    known = [k for k in (*often, *(k for k in html5 if k not in often)) if k.endswith(";")]
    names = F.map_from_arrays(_listed(known), _listed(html5[k] for k in known))
    parts = F.regexp_extract_all(s, F.lit(r"&(?:#\d{1,9};?|#[xX][0-9A-Fa-f]{1,7};?|[A-Za-z][A-Za-z0-9]*;)|[^&]+|&"), 0)
    return F.when(s.contains("&"), F.array_join(F.transform(
        parts, lambda r: F.when(r.rlike("^&."), _reference(r, names)).otherwise(r)), "")).otherwise(s)


def piece(x: Column) -> Column:
    """Plain-text contribution of a token: collapsed text, paragraph breaks for
    block tags, a line break for ``br``."""
    # a single blank stays as it is
    txt = F.regexp_replace(decode_entities(x["tok"]), r"[\t\r\n\f][ \t\r\n\f]*| [ \t\r\n\f]+", " ")
    return (F.when(x["kind"] == "text", txt)
            .when(x["name"] == "br", F.lit("\n"))
            .when(x["kind"].isin("open", "close", "void") & x["name"].isin(list(BLOCK)), F.lit("\n\n"))
            .otherwise(F.lit("")))


def merged_pieces(pages: Column) -> Column:
    """array<array<string>> -> array<string>: the pieces of one page as they are; of several that share
    an id, those of one position together, in their own order."""
    n = F.array_max(F.transform(pages, F.size))
    together = F.transform(F.slice(F.sequence(F.lit(0), n), F.lit(1), n),
                           lambda i: F.array_join(F.sort_array(F.transform(pages, lambda p: F.get(p, i))), ""))
    return F.when(F.size(pages) > 1, together).otherwise(F.get(pages, F.lit(0)))


def join_pieces(pieces: Column) -> Column:
    """array<string> -> normalised plain text (H8)."""
    s = F.array_join(pieces, "")
    s = F.regexp_replace(s, r"[ \t]*\n[ \t]*", "\n")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    s = F.regexp_replace(s, r" {2,}", " ")
    return F.regexp_replace(s, "^[\\s\u00a0]+|[\\s\u00a0]+$", "")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _coverage(starts: pd.Series, ends: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for start, end, k in zip(starts, ends, n):
        if start is None or not len(start):
            out.append([])
            continue
        last = np.full(int(k), -1)
        np.maximum.at(last, start, end)
        out.append(np.maximum.accumulate(last) >= np.arange(int(k)))
    return pd.Series(out)


def coverage(spans: Column, n: Column) -> Column:
    """array<boolean>: the tokens, of ``n``, inside any of the elements (pos, end); empty without elements."""
    return _coverage(F.transform(spans, lambda s: s["pos"]), F.transform(spans, lambda s: s["end"]), n)


def covered(inside: Column, i: Column) -> Column:
    return F.coalesce(F.get(inside, i), F.lit(False))
