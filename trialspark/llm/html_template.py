"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: start and end tags and text pieces, each told
apart by its path of open elements.  Within a host, a token's *occurrence
vector* says how often each page has it; tokens with the same vector form an
equivalence class.  Classes that occur on at least half of the host's pages
and have two tokens or more are the host's template.  On a page, a class
counts if its tokens come in the template's order and its tags nest; the rest
of the page are the slots of the template.

Vectors are never built: per (host, token) the page count, the total and two
hash sums over (page, count) identify a vector, so the deduction is one
aggregation with partial sums, whatever share of all pages a host holds.

Each slot lies in the innermost template element around it.  Slots inside
navigation, headers, footers, asides, forms, adverts, notices and comments are
left out, and so are scripts, styles and hidden elements, in the template or
not.  Parts are known by their tag or by a whole class, id or role name.  An
element around a main element is not left out by its name; parts that often
hold articles of their own (comments, sidebars, related pages) are only if the
page has another main element.  The main slots are those of the template's
article (or main) element.  The template places their edges: a container that
holds nothing but the template's text, before the first or after the last text
that varies, is frame (a notice, an offer) and goes.  Between varying texts
everything stays, however many pages share it, and so do headings, captions
and paragraphs at the edges; an article in which nothing varies keeps all.  A
page that breaks the template's main element, or has no template, stands for
itself: its own article or main element, else its body less the template's
text, or its whole body if nothing would be left.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import fresh, row_key, without
from trialspark.llm.host_reputation import url_host
from trialspark.operators.joins import join_by_size
from trialspark.session import materialize

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search
section summary table tbody td tfoot th thead title tr ul""".split())
#: Elements that never hold main text, and names of parts that don't.
SKIP = frozenset("""nav header footer aside form script style noscript template button select textarea iframe svg math
canvas object audio video menu dialog head title xmp noembed noframes""".split())
PARTS = frozenset("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie
cookies consent notice notices alert popup modal overlay newsletter subscribe signup sidebar aside nav navbar navigation
menu breadcrumb breadcrumbs header masthead footer comment comments disqus respond share sharing social related
recommended widget pagination pager hidden contentinfo complementary search ad-slot ad-container ad-wrapper ad-banner
cookie-notice cookie-notices cookie-banner cookie-consent cookie-bar site-header page-header site-footer page-footer
site-nav main-nav top-nav nav-menu main-menu side-bar comment-list comments-area comment-section""".split())
#: Inside a main element only these go: navigation, headers, footers, asides, forms, adverts, notices, comments, code.
MAIN_SKIP = frozenset("""nav header footer aside form script style template button select textarea iframe dialog head
title noembed noframes""".split())
MAIN_PARTS = PARTS - frozenset("""banner alert popup modal overlay newsletter subscribe signup share sharing social related
recommended widget pagination pager hidden search""".split())
MAIN_ROLES = frozenset("banner search".split())  # header and form, if given as a role
#: Parts that often hold article elements of their own, such as a comment or a teaser.
HOLDERS = frozenset("""comment comments disqus respond comment-list comments-area comment-section sidebar side-bar aside
complementary related recommended""".split())
#: Containers that frame an article; a shared heading, paragraph, quotation or caption is part of it.
WRAPPERS = frozenset("div section center table ul ol dl details fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag closes if they are open, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
          "option": ({"option"}, {"select"})}
_SCOPE = BLOCK - {"p"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MAX_TEXT_TOKEN = 200  # longer text pieces name themselves by a hash
MIN_SHARE = 0.5
#: A text token needs more: so many different pages, more than half of them, and a class with tags.
MIN_TEXT_PAGES = 3
#: What a page says, to tell copies: markup, scripts, comments and the head don't count.
_NOT_SAID = r"(?is)\A.*?<body\b[^>]*>|<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|<[^<>]*>|\s+"


class _Element:
    """An open element: what its tag and its names say, and whether a main element lies inside."""

    __slots__ = ("parent", "name", "path", "names", "roles", "hidden", "main", "holds")

    def __init__(self, parent: _Element | None, name: str, attrs: str) -> None:
        found = {}
        for m in _ATTR.finditer(attrs):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        named = " ".join(_html.unescape(found[k]) for k in ("class", "id", "role") if k in found)
        self.parent, self.name, self.holds = parent, name, False
        self.path = f"{parent.path if parent else ''}/{name}.{named}" if named else f"{parent.path if parent else ''}/{name}"
        self.names = {w.lower().replace("_", "-") for w in named.split()} if named else frozenset()
        self.roles = frozenset(found["role"].lower().split()) if "role" in found else frozenset()
        self.hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(
            r"display\s*:\s*none", found.get("style", ""), re.I))
        self.main = (name in ("article", "main") or "main" in self.roles) and not self.names & {"comment", "comments"}
        up = parent if self.main else None
        while up is not None and not up.holds:
            up.holds, up = True, up.parent

    def left_out(self, inside: bool, lift: bool) -> bool:
        """Whether the element goes, in a main element or not; ``lift``: holders of a main element stay too."""
        if self.hidden:
            return True
        skip, parts = (MAIN_SKIP, MAIN_PARTS) if inside else (SKIP, PARTS)
        # around a main element a form or a name says nothing about what is inside
        around = self.holds and not inside
        if self.name in skip and not (around and self.name == "form"):
            return True
        if self.main or self.name in ("article", "main", "html", "body") or re.fullmatch("h[1-6]", self.name):
            return bool(self.names & {"comment", "comments"}) and self.name not in ("html", "body")
        named = self.names & parts or inside and self.roles & MAIN_ROLES
        return bool(named) and not (around and (lift or not self.names & HOLDERS))


def _slots(elements: list[_Element]) -> dict[_Element, tuple[bool, str]]:
    """Per element whether it is left out, and the path of the main element around it or ""."""
    for lift in (False, True):
        flags: dict[_Element | None, tuple[bool, str]] = {None: (False, "")}
        for e in elements:  # parents come first
            out, inside = flags[e.parent]
            out = out or e.left_out(bool(inside), lift)
            flags[e] = (out, "" if out else inside or (e.path if e.main else ""))
        if any(inside for _, inside in flags.values()):
            break
        if not any(e.holds and e.names & HOLDERS for e in elements):
            break
    return flags


def walk(page: str) -> Iterator[tuple]:
    """Events of a page in order.

    ("open", path, name), ("close", path, name), ("text", path, raw text, left
    out?, path of the main element around it or "", element), ("break", path,
    name) for void elements.
    """
    elements: list[_Element] = []
    events = list(_parsed_events(page, elements))
    flags = _slots(elements)
    for kind, e, what in events:
        path = e.path if e else ""
        if kind == "raw":
            yield "text", path, what, True, "", e
        elif kind == "text":
            yield kind, path, what, *flags[e], e
        else:
            yield kind, path, what


def _parsed_events(page: str, elements: list[_Element]) -> Iterator[tuple]:
    """(kind, element around it or itself, name or text); the elements are added in the order they open."""
    stack: list[_Element] = []

    def top() -> _Element | None:
        return stack[-1] if stack else None

    def close(n: int) -> Iterator[tuple]:
        while len(stack) > n:
            e = stack.pop()
            yield "close", e, e.name

    def close_open(names: set, stop: set | frozenset) -> Iterator[tuple]:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                yield from close(i)
                return
            if stack[i].name in stop:
                return

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        m = _TOKEN.match(page, lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a lone < is text
            lt = page.find("<", lt + 1)
            m = _TOKEN.match(page, lt) if lt >= 0 else None
        end = lt if lt >= 0 else len(page)
        if end > at:
            yield "text", top(), page[at:end]
        if m is None:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue  # comment or declaration
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    yield from close(i)
                    break
            else:
                if name in BLOCK:
                    yield "break", top(), name
            continue
        if name in BLOCK:
            yield from close_open({"p"}, _SCOPE)
        if name in CLOSES:
            yield from close_open(*CLOSES[name])
        attrs = m[3] if m[3] is not None else m[6]
        if name in VOID:
            yield "break", top(), name
            continue
        stack.append(_Element(top(), name, attrs))
        elements.append(stack[-1])
        yield "open", stack[-1], name
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            end = stop.start() if stop else len(page)
            if end > at:
                yield "raw", top(), page[at:end]
            at = end
        elif attrs.endswith("/") and name in ("path", "use", "g"):
            yield from close(len(stack) - 1)
    yield from close(0)


def _piece(path: str, raw: str) -> str | None:
    """Name of a text token, None for white space."""
    t = " ".join(raw.split())
    if not t:
        return None
    import xxhash

    return f"t {path} {t}" if len(t) <= MAX_TEXT_TOKEN else f"t {path} #{xxhash.xxh64_hexdigest(t, 42)}"


def tokens(events: Iterable[tuple]) -> list[str]:
    """The tokens of a page's events in order, each with its path."""
    out = []
    for ev in events:
        if ev[0] == "text":
            t = None if ev[3] and ev[1].rpartition("/")[2].partition(".")[0] in RAW else _piece(ev[1], ev[2])
            if t:
                out.append(t)
        elif ev[0] != "break":
            out.append(f"{'<' if ev[0] == 'open' else '>'} {ev[1]}")
    return out


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, token, count, rank of the first occurrence, page key, copies of the page) per page and token."""
    for pdf in batches:
        rows = []
        for host, key, page, copies in zip(pdf["host"], pdf["key"], pdf["page"], pdf["copies"]):
            seen: dict[str, list[int]] = {}
            for i, t in enumerate(tokens(walk(page))):
                seen.setdefault(t, [0, i])[0] += 1
            rows += [(host, t, n, i, key, copies) for t, (n, i) in seen.items()]
        yield pd.DataFrame(rows, columns=["host", "token", "n", "at", "key", "copies"])


def templates(pages: DataFrame, host: str, html: str, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template): per host the tokens of its valid classes as lines ``class TAB token``, in page order.

    A class has two tokens or more with one occurrence vector and is on at
    least ``min_share`` of the host's pages, and on two.  Pages of a host that
    say the same count once.  Text that only copies share is no template: its
    class also has tags, and is on three pages and more than half of them.
    """
    said = row_key(F.regexp_replace("page", _NOT_SAID, ""))
    base = pages.select(F.col(f"`{host}`").alias("host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("page"))
    base = base.withColumns({"key": F.monotonically_increasing_id(), "said1": said[0], "said2": said[1]})
    bodies = materialize(base.groupBy("host", "said1", "said2").agg(F.count(F.lit(1)).alias("copies")), "page_bodies")
    n_pages = bodies.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    on = ["host", "said1", "said2"]
    repeated = materialize(bodies.filter("copies > 1").groupBy(F.xxhash64(*on).alias("body"))
                           .agg(F.max("copies").alias("copies")), "page_copies")  # its size decides the join
    base = join_by_size(base.select("host", "key", "page", F.xxhash64(*on).alias("body")), repeated, "body", "left")
    base = base.select("host", "key", "page", F.coalesce("copies", F.lit(1)).alias("copies"))
    seen = base.mapInPandas(_occurrences, "host string, token string, n long, at long, key long, copies long")
    vec = F.xxhash64("key", "n")
    stats = (seen.groupBy("host", "token")
             .agg(F.round(F.sum(1 / F.col("copies"))).cast("long").alias("pages"), F.sum("n").alias("total"),
                  F.sum(vec.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s1"), F.sum(F.shiftrightunsigned(vec, 32)).alias("s2"),
                  F.avg("at").alias("at"))
             .filter("pages >= 2"))
    stats = materialize(stats.join(n_pages, "host").filter(F.col("pages") >= min_share * F.col("of")), "template_tokens")
    vector = F.struct("pages", "total", "s1", "s2")
    tags = F.filter("of", lambda x: ~F.startswith(x["token"], F.lit("t ")))
    shared_text = (F.size(tags) > 0) & (F.col("vector.pages") >= MIN_TEXT_PAGES) & (F.col("vector.pages") * 2 > F.col("n_of"))
    classes = (stats.groupBy("host", vector.alias("vector"))
               .agg(F.collect_list(F.struct("at", "token")).alias("of"), F.max("of").alias("n_of"))
               .withColumn("of", F.when(shared_text, F.col("of")).otherwise(tags))
               .filter(F.size("of") >= 2)
               .select("host", F.xxhash64("vector").alias("cls"), F.explode("of").alias("t")))
    # a host's template has at most pages' tokens / min_share lines: as long as a few pages
    return classes.groupBy("host").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("t.at", F.hex("cls").alias("cls"), "t.token"))),
        lambda x: F.concat(x["cls"], F.lit("\t"), x["token"])), "\n").alias("template"))


def _parsed(template: str) -> dict[str, tuple[str, int]]:
    """Token -> (class, place in the template); the last templates are remembered."""
    if template not in _PARSED:
        if len(_PARSED) >= 1024:
            _PARSED.clear()
        _PARSED[template] = {line.partition("\t")[2]: (line.partition("\t")[0], i)
                             for i, line in enumerate(template.split("\n"))} if template else {}
    return _PARSED[template]


_PARSED: dict[str, dict[str, tuple[str, int]]] = {}


def fixed_tokens(page_tokens: list[str], template: str) -> set[str]:
    """The template tokens whose class holds on this page: in the template's order, with tags that nest."""
    of = _parsed(template)
    order: dict[str, list[int]] = {}
    open_tags: dict[str, int] = {}
    bad = set()
    first = set()
    for t in page_tokens:
        if t not in of:
            continue
        cls, i = of[t]
        if t[0] == "<":
            open_tags[t[2:]] = open_tags.get(t[2:], 0) + 1
        elif t[0] == ">":
            open_tags[t[2:]] = open_tags.get(t[2:], 0) - 1
            if f"< {t[2:]}" in of and open_tags[t[2:]] < 0:
                bad.add(cls)
        if t not in first:
            first.add(t)
            order.setdefault(cls, []).append(i)
    for cls, at in order.items():
        if any(b < a for a, b in zip(at, at[1:])):
            bad.add(cls)
    return {t for t in first if of[t][0] not in bad}


def _around(e: _Element | None) -> Iterator[_Element]:
    while e is not None:
        yield e
        e = e.parent


def framed(pieces: list[tuple[_Element, bool]]) -> set[int]:
    """Which of the pieces (element, in the template?) of main elements are frame: at a slot's edge, in a container.

    The edges are those of the outermost main element around the pieces.
    """
    out: set[int] = set()
    groups: dict[_Element, list[int]] = {}
    for i, (e, _) in enumerate(pieces):
        groups.setdefault([x for x in _around(e) if x.main][-1], []).append(i)
    for main, members in groups.items():
        varying = [i for i in members if not pieces[i][1]]
        if not varying:
            continue
        holds = {x for i in varying for x in _around(pieces[i][0])}
        frames: dict[_Element, list[int]] = {}
        for i in members:
            if varying[0] < i < varying[-1] or not pieces[i][1]:
                continue
            inside = list(_around(pieces[i][0]))
            inside = inside[:inside.index(main)]
            wrapper = [x for x in inside if x.name in WRAPPERS and x not in holds]
            if wrapper:
                frames.setdefault(wrapper[-1], []).append(i)
        for members_of in frames.values():
            if not all(any(x.name in HEADINGS for x in _around(pieces[i][0])) for i in members_of):
                out.update(members_of)
    return out


def main_text(page: str | None, template: str | None = "") -> str:
    """The blocks of the main slot, joined by blank lines.

    White space inside a block is one space, character references are decoded,
    empty blocks go.  Null and empty pages give an empty text.
    """
    if not page:
        return ""
    events = list(walk(page))
    named = tokens(events)
    fixed = fixed_tokens(named, template or "")
    own = {ev[4] for ev in events if ev[0] == "text" and ev[4] and not ev[3] and ev[2].strip()}
    mains = {p for p in own if f"< {p}" in fixed} or own
    if mains:  # text that a page repeats may share its vector with any tags
        times = Counter(named)
        fixed = {t for t in fixed if times[t] == 1}
    # the slots: what is not left out, in the main elements if there are any, and not in the template
    said = [i for i, ev in enumerate(events)
            if ev[0] == "text" and not ev[3] and ev[2].strip() and (not mains or ev[4] in mains)]
    shared = [_piece(events[i][1], events[i][2]) in fixed for i in said]
    if mains:
        gone = {said[i] for i in framed([(events[i][5], f) for i, f in zip(said, shared)])}
    else:
        gone = {i for i, f in zip(said, shared) if f} if not all(shared) else set()
    blocks, now = [], []

    def end_block() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for i, ev in enumerate(events):
        if ev[0] == "text":
            if not ev[3] and (not mains or ev[4] in mains) and i not in gone:
                now.append(_html.unescape(ev[2]))
        elif ev[2] in BLOCK:
            end_block()
        elif ev[2] == "br":
            now.append(" ")
    end_block()
    return "\n\n".join(blocks)


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` plus text and n_chars (code points).

    Pages of one host (from ``url``; null urls share an empty host) make its
    template; a host with a single page has none, and its page stands for
    itself.  Null html gives an empty text; repeated pages are kept and count
    once for the template.  Columns named text or n_chars are replaced; an empty table
    gives no rows.
    """
    pages = without(pages, ["text", "n_chars"])
    host, template, text = fresh(pages, "page_host", "page_template", "page_text")
    hosted = pages.withColumn(host, url_host(F.col(f"`{url}`")))
    found = materialize(templates(hosted, host, html), "page_templates")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, template in batches:
            yield pd.Series([main_text(p, t) for p, t in zip(page, template)], dtype=object)

    out = join_by_size(hosted, found.select(F.col("host").alias(host), F.col("template").alias(template)), host, "left")
    out = out.withColumn(text, extract(F.col(f"`{html}`"), F.col(template)))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], F.col(text).alias("text"),
                      F.char_length(text).cast("long").alias("n_chars"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract_main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
