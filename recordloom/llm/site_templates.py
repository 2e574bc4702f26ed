"""HTML extraction with removal of site templates.

Every element of a page is hashed with all below it.  Spark counts, per host, on how many different pages (different in their main text) each
subtree occurs; subtrees on at least ``LEAST`` pages and ``SHARE`` of the host's pages are its template.  Extraction drops the
template, then what is no article by its kind (``DROPPED`` elements, ``LABELS`` in class, id or role), and returns the blocks of the
main element around the largest article, else of all articles, else of the largest main element, else of what is left of the page.

A name in class, id or role counts only if all of its parts are label words or say no more than a place (``site-footer``, ``comment-list``): a
wrapper that ``has-sidebar`` and a box of ``search-results-analysis`` are text.  If all articles of a page lie in what its kind drops (a form
around the page), what holds the largest one stays; without articles a form stays if nothing else is left.

A recurring subtree is dropped only if it is a container (not a paragraph, heading, list item or quotation) that is short or mostly links,
inside an article and outside: a passage that many pages share, or an article that was copied, is text and stays.

Scale.  Counting moves one (host, hash, page text hash) per element and drops repeats inside tasks; the page itself is not shuffled.  A host has
at most (elements of a page) / ``SHARE`` template subtrees, so the list per host is bounded whatever the host's size.  The lists are broadcast
after their sum was checked; beyond the check they are joined by host, where adaptive execution splits a hot host.

Results.  One row per page row: ``page_id``, ``url``, ``text`` (blocks joined by an empty line; empty if there is none), ``n_chars``.  Character
references are decoded, white space inside a block is one space.  Null and empty html give an empty text.  Without url, or with one
that has no host, a page has no template and is extracted by kind alone.  Repeated rows are pages each.  Unclosed elements, comments and tags end with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored

LEAST, SHARE, SHORT, LINKS = 3, 0.05, 400, 0.5
BROADCAST_HASHES = 1_000_000

_RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|title|math|xmp|noembed|noframes"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_LABEL = re.compile(r"[a-z0-9]+")

# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset((
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table caption thead tbody tfoot tr ul").split())
CLOSED_BY = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
    "thead": "tr td th", "tbody": "tr td th thead", "tfoot": "tr td th tbody",
}
KEPT_APART = frozenset("ul ol dl table article main section div body".split())
DROPPED = frozenset("head nav aside footer form button select input option menu dialog datalist script style".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody".split())
ROOTS = frozenset("html body main article".split())
LABELS = frozenset((
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer sidebar sidebars aside cookie cookies consent gdpr notice "
    "notices alert banner banners popup modal overlay ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors "
    "promo promotion promotions share sharing social related recommended recommendations newsletter subscribe subscription signup login comment "
    "comments disqus respond reply replies complementary contentinfo search masthead toolbar widget widgets skip").split())
PAGE_HEADERS = frozenset("header topbar siteheader".split())
# Words that only say where or what shape a box is.
PLACES = frozenset((
    "site page main global primary secondary top bottom left right center inner outer fixed sticky floating mobile desktop container wrapper wrap "
    "box block bar area section panel group row col column column1 column2 list item items link links slot unit post posts entry article articles "
    "user reader content text title body message form icons buttons button js").split())
_KNOWN = LABELS | PAGE_HEADERS | PLACES


def _words(value: str) -> Iterator[str]:
    """Parts of the names that are made of known words, place words and numbers alone."""
    for name in value.lower().strip("\"'").split():
        parts = _LABEL.findall(name)
        if all(part in _KNOWN or part.isdigit() for part in parts):
            yield from parts


class Page:
    """Elements of a page in order, and what happens between them.

    ``tags``, ``labels``, ``parents`` by element; ``events``: text, or the number of an element that opens, or ~number where it closes;
    ``hashes``, ``letters`` and ``linked`` (letters inside links) of whole subtrees.
    """

    def __init__(self, html: str | None):
        self.tags, self.labels, self.parents = ["#page"], [frozenset()], [-1]
        self.events: list = []
        self.pieces: list = [[]]
        self.hashes, self.letters, self.linked = [0], [0], [0]
        self.open = [0]
        at = 0
        html = html or ""
        for token in _TOKEN.finditer(html):
            if token.start() > at:
                self._text(html[at:token.start()])
            at = token.end()
            name = token[3] or token[6]
            if name:
                name = name.lower()
                if token[2] or token[5]:
                    self._end(name)
                else:
                    self._start(name, token[4] or token[7] or "")
        if at < len(html):
            self._text(html[at:])
        while self.open:
            self._close()

    def _text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.events.append(text)
        if not text.isspace():
            own = self.open[-1]
            self.pieces[own].append(text)
            self.letters[own] += len(text)

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            self.events.append(None if name == "hr" else " ")  # None: a block ends
            return
        if name in BLOCKS:
            self._implied(("p",))
        if name in CLOSED_BY:
            self._implied(CLOSED_BY[name].split())
        labels = frozenset()
        if "=" in attributes:
            labels = frozenset(x for _, v in _NAMED.findall(attributes) for x in _words(v))
        number = len(self.tags)
        self.tags.append(name), self.labels.append(labels), self.parents.append(self.open[-1])
        self.pieces.append([]), self.hashes.append(0), self.letters.append(0), self.linked.append(0)
        self.open.append(number)
        self.events.append(number)

    def _implied(self, names) -> None:
        """End the nearest open element of these kinds, unless something that keeps its content apart is nearer."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag in names:
                while len(self.open) > depth:
                    self._close()
                return
            if tag in KEPT_APART:
                return

    def _end(self, name: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag == name:
                while len(self.open) > depth:
                    self._close()
                return
            if tag in BLOCKS and name not in BLOCKS:
                return

    def _close(self) -> None:
        number = self.open.pop()
        self.events.append(~number)
        pieces = self.pieces[number]
        self.hashes[number] = xxhash.xxh3_64_intdigest(f"{self.tags[number]}\x00" + "\x01".join(" ".join(p.split()) for p in pieces)) - 2**63
        self.pieces[number] = []
        if number:
            parent = self.parents[number]
            self.pieces[parent].append(f"\x02{self.hashes[number]}")
            self.letters[parent] += self.letters[number]
            self.linked[parent] += self.letters[number] if self.tags[number] == "a" else self.linked[number]

    # ---- what is main text ---------------------------------------------------------------

    def _by_kind(self, number: int, inside: bool) -> bool:
        tag, labels = self.tags[number], self.labels[number]
        if tag == "article":
            return bool(labels & {"comment", "comments", "related", "sponsored", "ad"})
        if tag == "#page" or tag in ROOTS:
            return False
        if tag in DROPPED or labels & LABELS:
            return True
        return not inside and (tag == "header" or bool(labels & PAGE_HEADERS))

    def _by_template(self, number: int, template) -> bool:
        tag = self.tags[number]
        if self.hashes[number] not in template or tag not in BLOCKS or tag in ROOTS:
            return False
        size = self.letters[number]
        return tag not in PROSE and (size <= SHORT or self.linked[number] > LINKS * size)

    def _drop(self, template, protected=frozenset()) -> list[bool]:
        """Whether each element is no main text, by itself or by one around it."""
        dropped = [False] * len(self.tags)
        inside = [False] * len(self.tags)
        for number in range(1, len(self.tags)):
            parent = self.parents[number]
            dropped[number] = dropped[parent]
            inside[number] = inside[parent] or self.tags[number] in ("article", "main")
            if not dropped[number] and number not in protected:
                dropped[number] = self._by_kind(number, inside[parent]) or (
                    bool(template) and self._by_template(number, template))
        return dropped

    def _around(self, number: int) -> list[int]:
        """The elements around an element, itself first."""
        found = []
        while number > 0:
            found.append(number)
            number = self.parents[number]
        return found

    def _largest(self, numbers: list[int]) -> int:
        return max(numbers, key=lambda n: (self.letters[n], -n))

    def _regions(self, template) -> tuple[list[bool], set[int]]:
        """What is dropped, and the elements whose text is the main text; 0 is the page."""
        dropped = self._drop(template)
        articles = [n for n, tag in enumerate(self.tags) if tag in ("article", "main") and not self._by_kind(n, True) and self.letters[n]]
        if articles and all(dropped[n] for n in articles):
            dropped = self._drop(template, frozenset(self._around(self._largest(articles))[1:]))
        elif not articles:
            forms = [n for n, tag in enumerate(self.tags) if tag == "form" and self.letters[n]]
            if forms and not self._has_text(dropped):
                dropped = self._drop(template, frozenset(self._around(self._largest(forms))))
        kept = [n for n in articles if not dropped[n] and self.tags[n] == "article"]
        if kept:
            mains = [n for n in self._around(self._largest(kept)) if self.tags[n] == "main"]
            return dropped, {mains[-1]} if mains else {n for n in kept if not any(self.tags[o] == "article" for o in self._around(n)[1:])}
        mains = [n for n in range(1, len(self.tags)) if not dropped[n] and (self.tags[n] == "main" or "main" in self.labels[n])]
        return dropped, {self._largest(mains)} if mains else {0}

    def _has_text(self, dropped: list[bool]) -> bool:
        own = list(self.letters)
        for number in range(1, len(self.tags)):
            own[self.parents[number]] -= self.letters[number]
        return any(size and not gone for size, gone in zip(own, dropped))

    def blocks(self, template=frozenset()) -> list[str]:
        """The blocks of the main text."""
        dropped, roots = self._regions(template)
        out, now, on, header = [], [], 0 in roots, 0

        def cut() -> None:
            text = " ".join("".join(now).split())
            now.clear()
            if text:
                out.append(text)

        for event in self.events:
            if isinstance(event, str):
                if on and not header:
                    now.append(event)
                continue
            if event is None:
                if on:
                    cut()
                continue
            number = event if event >= 0 else ~event
            if number in roots:
                on = event >= 0 or number == 0
            tag = self.tags[number]
            if tag in BLOCKS and (on or number in roots):
                cut()
            elif on and tag in ("td", "th"):
                now.append(" ")
            if dropped[number] and number:
                header += (1 if event >= 0 else -1) if not dropped[self.parents[number]] else 0
        cut()
        return out


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, hash, text hash) of every element of every page, once inside a batch."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            rows = set()
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                page = Page(html)
                text = xxhash.xxh3_64_intdigest("\n".join(page.blocks())) - 2**63
                rows.update((host, h, text) for n, h in enumerate(page.hashes) if page.letters[n] and page.tags[n] in BLOCKS and page.tags[n] not in ROOTS)
                rows.add((host, None, text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64())], ["host", "hash", "page"])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(
        F.col("page_id"), F.col("url"), F.col("html").cast("string").alias("html"), F.when(host != "", host).alias("host"))


def templates(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, hashes): the subtrees that recur on the host's pages."""
    rows = pages.filter("host is not null and html is not null").select("host", "html").mapInArrow(
        _hash_rows, "host string, hash bigint, page bigint").distinct()
    counts = rows.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.filter(F.col("hash").isNull() | (F.col("n") >= least)), "counts")
    sizes = counts.filter("hash is null").select("host", F.col("n").alias("all_pages"))
    often = counts.filter("hash is not null").join(sizes, "host").filter(F.col("n") >= share * F.col("all_pages"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            kept: dict[str, frozenset] = {}
            texts = []
            hosts = part.column("host").to_pylist()
            for i, html in enumerate(part.column("html").to_pylist()):
                if hosts[i] not in kept:
                    kept[hosts[i]] = frozenset(part.column("hashes")[i].as_py() or ())
                texts.append("\n\n".join(Page(html).blocks(kept[hosts[i]])))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    pages = with_host(pages)
    found = stored(templates(pages, least, share), "templates")
    total = found.agg(F.sum(F.size("hashes") + 8)).first()[0] or 0
    found = F.broadcast(found) if total <= BROADCAST_HASHES else found
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.join(found, "host", "left").select("page_id", "url", "html", "host", "hashes").mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
