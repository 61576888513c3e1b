"""HTML extraction by consensus paths of a host's pages.

Each page is read as blocks of text inside containers. A container's generalised
path is the tags and classes from the body down to it, digits replaced by "#", held
as a digest so that depth costs nothing. In a first pass every page scores its
containers by the text outside links in their own blocks and votes for the best
one's path; it also names the boxes inside that container with their texts. Spark
counts both by host: paths with enough votes win, and a box whose text stands on
half of the host's pages is part of the template, not of an article. Pages count there
by what is beside the box, its longest block, so that copies of a page, whole or
nearly so, count once and keep all parts of their article.

In a second pass a page is extracted again, without template boxes, from the first
winning path that holds about as much text as its own best container. A page whose
own best isn't a winner follows the host's majority path if that holds a fair share
of its text, else its own best. The best container is widened to parents as long as
what they add is mostly text outside links.

What is cut inside a container: elements whose tag or class says menu, header,
footer, sidebar, notice, advert, form, comments, script or style. A name says so if
all its words are marks or words of layout: "ad-box" does, "side-effects" doesn't. A
form, or a mark in a class, id or role, gives way only where the page would lose its
article: if no article or main element has text outside marks, the marks around the
one with most text; if there is no such element and no text outside links and marks,
the outermost mark with most text. How much of a page an element holds doesn't
matter, so comments longer than the article go all the same.

Tags are scanned once from left to right. A quote opens a value only after "=", an
unclosed one ends at the next ">"; an unclosed comment, script or style runs to the
end, as in browsers; other unclosed raw elements lose their tag only.

Defined results: null and empty html give the empty text; html without any
container is read from the body; a null or unreadable url has the empty host;
repeated page_ids are extracted alike; an empty table gives an empty table. Only
the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small_batches

#: Least share of a host's votes that a path needs, and their least number; how many paths and boxes are broadcast at most.
VOTE_SHARE, LEAST_VOTES, BROADCAST_ROWS = 0.01, 2, 20_000
#: A box is part of the template from this share of the host's different pages on, and this number of them.
BOX_SHARE, BOX_PAGES = 0.5, 3
#: A winning path is taken if it holds this share of the text of the page's own best container; the majority's path, if that isn't a winner, from the second on.
AS_MUCH, FAIR = 0.95, 0.25
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"[=>]")
_UNQUOTED = re.compile(r"[\s>]")
_NAMED = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
# HTML element names by role.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in "script style title textarea iframe noembed noframes xmp".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("html body main article section div td center".split())
_BOXES = frozenset("div section".split())
_BLOCKS = frozenset("address blockquote caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li main menu ol p pre section article summary table tbody td tfoot th thead tr ul body html head search".split())
_BOILERPLATE = frozenset("nav header footer aside form button dialog head menu select label fieldset".split())
_DRAWN = frozenset("svg noscript template".split())
_CLOSES_P = _BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "body", "html", "head"}
_CLOSED_BY_SAME = {"li": "ul ol menu", "dd": "dl", "dt": "dl", "tr": "table", "td": "table tr", "th": "table tr", "option": ""}
# Words of classes, ids and roles that mark what isn't the article, and words of layout that may stand beside them.
_NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted popup modal overlay"
    " nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager header masthead topbar footer colophon copyright"
    " sidebar side aside widget widgets rail related recommended recommendations trending popular tags share sharing social"
    " comment comments respond disqus replies discussion cookie cookies consent gdpr notice notices alert disclaimer"
    " newsletter subscribe subscription signup login search searchbox form skip hidden contentinfo complementary".split()
)
_LAYOUT = frozenset(
    "site page global top bottom left right main primary secondary box boxes wrap wrapper container block list item items inner outer bar area section sections"
    " post posts article articles entry story content body links link text title js icon icons button buttons panel col column slot unit zone group small large mobile desktop fixed sticky byline to".split()
)


@lru_cache(1 << 16)
def _mark(name: str) -> bool:
    """Whether a name says that something isn't the article."""
    words = [w for w in re.split(r"[-_0-9]+", re.sub("([a-z])([A-Z])", r"\1-\2", name).lower()) if len(w) > 1]
    return any(w in _NOT_ARTICLE for w in words) and all(w in _NOT_ARTICLE or w in _LAYOUT for w in words)


def _names(attributes: str) -> tuple[list[str], bool]:
    """Generalised class names, and whether a class, id or role is a mark."""
    names, mark = [], False
    for kind, a, b, c in _NAMED.findall(attributes):
        for name in unescape(a or b or c).split():
            mark = mark or _mark(name)
            if kind.lower() == "class":
                names.append(re.sub("[0-9]+", "#", name.lower()))
    return sorted(set(names)), mark


class Page:
    """Blocks of text, each with its container, and the containers' paths."""

    def __init__(self, html: str | None):
        #: Path (a digest), last name and parent of each container; the first is the document itself.
        self.paths, self.names, self.parents = [""], [""], [-1]
        #: Container, text and length of link text of each block outside boilerplate.
        self.blocks: list[tuple[int, str, int]] = []
        # the mark around each mark, the first being none; and the mark that each container stands in
        self._marks: list[int] = [0]
        self._marked: list[int] = [0]
        # pieces of the open block, and of the ended ones with their container: mark, text, whether in a link
        self._text: list[tuple[int, str, bool]] = []
        self._ended: list[tuple[int, list[tuple[int, str, bool]]]] = []
        # open elements: tag, container, mark (-1: inside boilerplate), whether inside a link; and how many of each tag
        self._open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self._count: Counter[str] = Counter()
        self._scan(html or "")
        self._end_block()
        self._choose_blocks()

    def _scan(self, html: str) -> None:
        """Hand on texts and tags, each character looked at a fixed number of times."""
        at, unclosed = 0, set()
        while (lt := html.find("<", at)) >= 0:
            name = _NAME.match(html, lt + 1)
            follows = html[lt + 1 : lt + 2]
            if not name and follows not in ("!", "?", "/"):
                self._add(html[at : lt + 1])
                at = lt + 1
                continue
            self._add(html[at:lt])
            if not name:  # a comment, a declaration or a broken end tag
                stop = "-->" if html.startswith("!--", lt + 1) else "]]>" if html.startswith("![CDATA[", lt + 1) else ">"
                end = html.find(stop, lt + 2)
                at = end + len(stop) if end >= 0 else len(html)
                continue
            end = self._tag_end(html, name.end())
            tag, closing = name.group(1).lower(), follows == "/"
            at = min(len(html), end + 1)
            if tag in _RAW and not closing:
                close = None if tag in unclosed else _RAW[tag].search(html, at)
                if close:
                    at = close.end()
                elif tag in ("script", "style"):
                    at = len(html)
                else:
                    unclosed.add(tag)
            elif end < len(html):
                self._tag(tag, closing, html[name.end() : end])
        self._add(html[at:])

    @staticmethod
    def _tag_end(html: str, at: int) -> int:
        """Where the tag's ">" stands; the end of html if nowhere."""
        while m := _VALUE.search(html, at):
            at = m.end()
            if m.group() == ">":
                return m.start()
            while html[at : at + 1].isspace():
                at += 1
            if html[at : at + 1] in ('"', "'"):
                close = html.find(html[at], at + 1)
                if close < 0:
                    end = html.find(">", at)
                    return end if end >= 0 else len(html)
                at = close + 1
            elif m := _UNQUOTED.search(html, at):
                at = m.start()
        return len(html)

    def _add(self, raw: str) -> None:
        _, _, mark, link = self._open[-1]
        if mark >= 0 and raw:
            self._text.append((mark, raw, link))

    def _end_block(self) -> None:
        if self._text:
            self._ended.append((self._open[-1][1], self._text))
            self._text = []

    def _choose_blocks(self) -> None:
        """Fill blocks with what no mark hides, where marks around the article give way."""
        held, own = [0] * len(self._marks), [0] * len(self.paths)
        for container, pieces in self._ended:
            for mark, raw, link in pieces:
                size = 0 if link else len("".join(raw.split()))
                held[mark] += size
                if mark == self._marked[container]:
                    own[container] += size
        for i in range(len(own) - 1, 0, -1):  # children come after their parents; what an inner mark hides isn't theirs
            if self._marked[i] == self._marked[self.parents[i]]:
                own[self.parents[i]] += own[i]
        seen = [i == 0 for i in range(len(self._marks))]
        articles = [i for i in range(len(own)) if own[i] and self._named(i)]
        if articles and not any(self._marked[i] == 0 for i in articles):
            mark = self._marked[max(articles, key=lambda i: (own[i], -i))]
            while mark:
                seen[mark], mark = True, self._marks[mark]
        elif not articles:
            around, inside = 0, held[:]
            for i in range(len(held) - 1, 0, -1):  # inner marks come after the ones around them
                if self._marks[i]:
                    inside[self._marks[i]] += inside[i]
            within: dict[int, list[int]] = {}
            for i in range(1, len(held)):
                within.setdefault(self._marks[i], []).append(i)
            while not held[around]:
                fullest = max(within.get(around, []), key=lambda i: (inside[i], -i), default=0)
                if not fullest or not inside[fullest]:
                    break
                seen[fullest], around = True, fullest
        for container, pieces in self._ended:
            text = " ".join(unescape("".join(raw for mark, raw, _ in pieces if seen[mark])).split())
            if text:
                self.blocks.append((container, text, sum(len(raw) for mark, raw, link in pieces if link and seen[mark])))
        self._ended = []

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            if self._open[-1][0] in _BLOCKS or self._open[-1][0] in _BOILERPLATE:
                self._end_block()
            self._count[self._open.pop()[0]] -= 1

    def _close_last(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth][0] == tag:
                self._close_to(depth)
                return

    def _tag(self, tag: str, closing: bool, attributes: str) -> None:
        if closing:
            if self._count[tag] > 0:
                self._close_last(tag)
            elif tag in _BLOCKS:
                self._end_block()
            return
        if tag == "br":
            self._add("\n")
            return
        if tag in _BLOCKS or tag in _BOILERPLATE:
            while self._count["svg"] > 0:  # a block never stands inside a drawing
                self._close_last("svg")
            self._end_block()
            if tag in _CLOSES_P:
                self._close_open("p", ("td", "th", "li", "blockquote", "div", "section", "article", "main", "body"))
            if tag in _CLOSED_BY_SAME:
                self._close_open(tag, _CLOSED_BY_SAME[tag].split())
        if tag == "a" and self._count["a"] > 0:
            self._close_last("a")
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCKS:
            return
        _, container, mark, link = self._open[-1]
        names, marked = _names(attributes) if "=" in attributes else ([], False)
        if tag in ("html", "body", "main", "article"):
            marked = False
        if tag in ("form", "fieldset") or tag in _DRAWN:
            marked = True
        elif tag in _BOILERPLATE:
            mark = -1
        if attributes and _HIDDEN.search(attributes):
            mark = -1
        if marked and mark >= 0:
            self._marks.append(mark)
            mark = len(self._marks) - 1
        if tag in _CONTAINERS:
            name = ".".join([tag, *names])
            self.paths.append(xxhash.xxh3_128_hexdigest(f"{self.paths[container]}>{name}"))
            self.names.append(name)
            self.parents.append(container)
            self._marked.append(mark)
            container = len(self.paths) - 1
        self._open.append((tag, container, mark, link or tag == "a"))
        self._count[tag] += 1

    def _close_open(self, tag: str, within: list[str] | tuple[str, ...]) -> None:
        """Close an open tag, unless one of within was opened inside it."""
        if self._count[tag] <= 0:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth][0] == tag:
                self._close_to(depth)
                return
            if self._open[depth][0] in within:
                return

    def best(self) -> int:
        """The container with the highest score (text outside links in its own blocks, and part of what its children have), widened."""
        own = [0.0] * len(self.paths)
        for container, text, link in self.blocks:
            own[container] += max(0, len(text) - 2 * link)
        score = own[:]
        for i in range(len(own) - 1, 0, -1):  # children come after their parents
            up = self.parents[i]
            score[up] += 0.8 * score[i]
        # an article or main element gets what a container around it can't make up
        for i in range(len(self.paths)):
            if self._named(i):
                score[i] *= 1.5
        return self._widened(max(range(len(score)), key=lambda i: (score[i], -i)))

    def _named(self, i: int) -> bool:
        return self.names[i].split(".", 1)[0] in ("article", "main")

    def _widened(self, best: int) -> int:
        """The last container around best up to which each one adds nothing, or text mostly outside links; around article or main only such."""
        length, links = [0] * len(self.paths), [0] * len(self.paths)
        for container, text, link in self.blocks:
            length[container] += len(text)
            links[container] += min(link, len(text))
        for i in range(len(length) - 1, 0, -1):
            length[self.parents[i]] += length[i]
            links[self.parents[i]] += links[i]
        at = best
        while self.parents[at] >= 0:
            up = self.parents[at]
            more, linked = length[up] - length[at], links[up] - links[at]
            if self._named(best) and not self._named(up) or 2 * linked > more:
                break
            at = up
            if more:
                best = up
        return best

    def boxes(self, around: int) -> dict[int, str]:
        """Containers inside one that are boxes with text, each with a digest of its path, texts and containers."""
        digests: dict[int, xxhash.xxh3_128] = {}
        for container, text, _ in self.blocks:
            digests.setdefault(container, xxhash.xxh3_128(self.paths[container])).update(text)
        for i in range(len(self.paths) - 1, 0, -1):  # children come after their parents
            if i in digests:
                up = self.parents[i]
                digests.setdefault(up, xxhash.xxh3_128(self.paths[up])).update(digests[i].digest())
        inside = self._inside({around})
        return {i: d.hexdigest() for i, d in digests.items() if i != around and inside[i] and self.names[i].split(".", 1)[0] in _BOXES}

    def beside(self, around: int, boxes: list[int]) -> list[str]:
        """For each box inside a container, a digest of the longest block of the container that isn't in the box."""
        n = len(self.paths)
        last = list(range(n))  # containers are numbered as they open, so those inside one follow it
        for i in range(n - 1, 0, -1):
            last[self.parents[i]] = max(last[self.parents[i]], last[i])
        longest = [""] * n
        inside = self._inside({around})
        for container, text, _ in self.blocks:
            if inside[container]:
                longest[container] = max(longest[container], text, key=len)
        before, after = [""] * (n + 1), [""] * (n + 1)
        for i in range(n):
            before[i + 1] = max(before[i], longest[i], key=len)
            after[n - 1 - i] = max(longest[n - 1 - i], after[n - i], key=len)
        return [xxhash.xxh3_128_hexdigest(max(before[i], after[last[i] + 1], key=len)) for i in boxes]

    def plain(self, containers: set[int], without: frozenset[int] | set[int] = frozenset()) -> int:
        """Length of the text outside links inside the containers."""
        inside = self._inside(containers, without)
        return sum(max(0, len(text) - link) for container, text, link in self.blocks if inside[container])

    def _inside(self, containers: set[int], without: frozenset[int] | set[int] = frozenset()) -> list[bool]:
        inside, out = [i in containers for i in range(len(self.paths))], [i in without for i in range(len(self.paths))]
        for i in range(1, len(inside)):
            out[i] = out[i] or out[self.parents[i]]
            inside[i] = inside[i] or inside[self.parents[i]]
        return [a and not b for a, b in zip(inside, out, strict=True)]

    def text(self, containers: set[int], without: frozenset[int] | set[int] = frozenset()) -> str:
        """All blocks inside the containers, in page order."""
        inside = self._inside(containers, without)
        return "\n".join(text for container, text, _ in self.blocks if inside[container])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, vote, box, beside): a page's vote with its longest block, or a box inside the container voted for with the longest block beside it."""
    for batch in batches:
        rows: list[tuple[str, str | None, str | None, str]] = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html)
            if page.blocks:
                best = page.best()
                boxes = page.boxes(best)
                rows.append((host, page.paths[best], None, xxhash.xxh3_128_hexdigest(max((text for _, text, _ in page.blocks), key=len))))
                rows += {(host, None, box, beside) for box, beside in zip(boxes.values(), page.beside(best, list(boxes)), strict=True)}
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "vote", "box", "beside"])


def extract(html: str | None, winners: list[str], template: list[str] = (), majority: bool = False) -> str:
    """The main text by the host's winning paths (most voted first, majority: whether the first has half of all votes), without its template's boxes."""
    page = Page(html)
    if not page.blocks:
        return ""
    best = page.best()
    whole = page.plain({best})
    known = set(template)
    boxes = {at for at, digest in page.boxes(best).items() if digest in known} if known else set()
    if boxes and 2 * page.plain({best}, boxes) < whole:  # copies of one page don't make it a template
        boxes = set()
    for path in winners:
        at = {i for i, p in enumerate(page.paths) if p == path}
        if at and page.plain(at) >= AS_MUCH * whole and (found := page.text(at, boxes)):
            return found
    if majority and page.paths[best] not in winners:
        at = {i for i, p in enumerate(page.paths) if p == winners[0]}
        if at and page.plain(at) >= FAIR * whole and (found := page.text(at)):
            return found
    return page.text({best}, boxes)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("html", "winners", "template", "majority"))
        texts = [extract(h, w or [], t or [], bool(m)) for h, w, t, m in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, winners, template, majority): each host's paths with enough votes, the most voted first (ties by path), its template's boxes, and whether the first path has half of all votes."""
    found = pages.select("host", "html").mapInArrow(_vote, "host string, vote string, box string, beside string")
    counts = materialize(found.groupBy("host", "vote", "box", "beside").agg(F.count("*").alias("n")), "votes")
    votes = counts.where("vote is not null").groupBy("host", "vote").agg(F.sum("n").alias("n"))
    enough = votes.join(votes.groupBy("host").agg(F.sum("n").alias("all")), "host").where((F.col("n") >= LEAST_VOTES) & (F.col("n") >= VOTE_SHARE * F.col("all")))
    contents = counts.where("vote is not null").select("host", "beside").distinct().groupBy("host").agg(F.count("*").alias("all"))
    boxes = counts.where("box is not null").groupBy("host", "box").agg(F.count("*").alias("n"))
    boxes = boxes.join(contents, "host").where((F.col("n") >= BOX_PAGES) & (F.col("n") >= BOX_SHARE * F.col("all")))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("vote").alias("path"))))
    winners = enough.groupBy("host").agg(ranked["path"].alias("winners"), (F.max(F.col("n") / F.col("all")) >= 0.5).alias("majority"))
    return winners.join(boxes.groupBy("host").agg(F.collect_list("box").alias("template")), "host", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row of pages."""
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    paths = materialize(host_paths(rows), "paths")
    few = (paths.agg(F.sum(F.size("winners") + F.size(F.coalesce("template", F.array())))).first()[0] or 0) <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "url", "html", "winners", "template", "majority")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    return joined.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op3_query(spark, sf_dir: str) -> DataFrame:
    found = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
