"""Main text of web pages by consensus of a host's pages.

Each page scores its containers; the tag-class path of the best one is its vote.
Votes are counted per host in Spark, and every page is extracted again from the
elements on its host's winning path, or from its own best container where it has
none of them. To these come what stands directly in the containers around them, headings
before them and neighbours with as much running text.

A class or id names furniture if one of its names consists of words for furniture and
of words that say nothing ("site-footer", but not "menu-closed" or "related-work"). Paragraphs and headings are
never left out by name, nor is an element that holds most of the page's text and
its article or first heading; forms, asides and roles are judged alike. Text is marked as it is read, so what stands before an element that is
left out, in one paragraph with it, stays.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import cut, join_uneven, short_batches

#: As many hosts' winners as may be broadcast: a row of them takes under 500 bytes.
BROADCAST_HOSTS = 100_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe".split())
_FOREIGN = frozenset(["svg"])
_DROPPED = frozenset("nav footer button select option dialog menu audio video canvas head template svg".split())
#: Left out too, unless they hold most of the page's text and its article, first heading or a name for it.
_DOUBTFUL = frozenset("aside form noscript".split())
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption address".split())
_CONTAINER = frozenset("html body div article main section header nav footer aside form ul ol dl table tbody thead tfoot center figure details summary fieldset hgroup dialog menu".split())
_BLOCK = _LEAF | _CONTAINER | {"hr", "title", "option"}
_HEADINGS = frozenset(["h1", "h2"])
_CLOSED_BY_BLOCK = frozenset(["p"])
_BAD = frozenset("nav navbar navigation menu submenu sidebar footer masthead ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus breadcrumb breadcrumbs pagination pager toolbar widget widgets search skip".split())
#: Words beside which a name still means furniture.
_PLAIN = frozenset("site page main top bottom left right header head bar box block area list item items link links icon icons button buttons btn inner outer wrap wrapper container content section slot unit zone panel col column row primary secondary global local mini main user reader post posts article articles entry story stories view form field text title body card cards count thread tree list js the by and more all new my".split())
_COMMENTS = frozenset("comment comments disqus".split())
_HEAD = frozenset(["header", "topbar"])
_GOOD = frozenset("article post entry story content main text body".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Longest attribute value whose brackets are read as text: a stray quote costs no more than this.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,4096}\"|'[^']{0,4096}')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
#: One attribute with its value, left to right, so that no value is read for attributes of its own.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _furniture(name: str, inside: bool) -> bool:
    words = [w.lower() for w in _PARTS.findall(name) if not w.isdigit()]
    head = not inside and any(w in _HEAD for w in words) and not any(w in _GOOD for w in words)
    return head or any(w in _BAD for w in words) and all(w in _BAD or w in _PLAIN for w in words)


class Page:
    """Blocks of text and the containers around them."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.path: list[str] = [""]
        self.bonus: list[float] = [0.1]
        self.blocks: list[tuple[str, int, float, str]] = []  # text, container, share of it in links, innermost block tag
        self._named: list[list[float]] = []  # of each element left out by name, role or doubtful tag: its text, whether it may be spared
        self._held: list[tuple[list[tuple[str, bool, tuple[int, ...]]], int, str]] = []  # pieces (text, linked, left out by), container, tag
        self._read(source)
        total = 0
        for pieces, *_ in self._held:
            for text, linked, named in pieces:
                size = 0 if linked else len(text.strip())
                total += size
                for i in named:
                    self._named[i][0] += size
        spared = {i for i, (held, main) in enumerate(self._named) if main and 2 * held > total}
        for pieces, box, tag in self._held:
            kept = [(text, linked) for text, linked, named in pieces if spared.issuperset(named)]
            whole = "".join(text for text, _ in kept)
            flat = _SPACE.sub(" ", entities.unescape(whole)).strip()
            if flat:
                self.blocks.append((flat, box, min(1.0, sum(len(text.strip()) for text, linked in kept if linked) / max(1, len(whole.strip()))), tag))

    def _attributes(self, tag: str, raw: str, inside: bool) -> tuple[str, bool, bool, float]:
        """Step of the general path; whether it's left out; whether its name is one of furniture; what its name is worth."""
        found: dict[str, str] = {}
        for m in _ATTR.finditer(raw) if raw.strip("/ ") else ():
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = found.get("class", "").split()
        step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in names})])
        names += found.get("id", "").split()
        words = {x.lower() for name in names for x in _PARTS.findall(name)}
        out = tag in _DROPPED or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        named = tag in _DOUBTFUL
        if tag not in ("html", "body") and tag not in _LEAF:
            out = out or tag == "header" and not inside
            named = named or found.get("role", "").lower() in _ROLES or tag not in ("article", "main") and any(_furniture(x, inside) for x in names) or tag == "article" and bool(words & _COMMENTS)
        return step, out, named, 3.0 if tag in ("article", "main") else 1.3 if words & _GOOD else 1.0

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, tuple[int, ...]]] = [("", 0, False, ())]  # tag, container, left out, left out by name
        text: list[tuple[str, bool, tuple[int, ...]]] = []
        at = links = inside = 0
        parent, path, bonus = self.parent, self.path, self.bonus

        def add(piece: str) -> None:
            """What stands in an element that is left out is never read."""
            if not stack[-1][2]:
                text.append((piece, links > 0, stack[-1][3]))

        def flush() -> None:
            # A block within an element that is left out ends nothing around that element.
            if text and not stack[-1][2]:
                tag = next((t for t, *_ in reversed(stack) if t in _BLOCK), "")
                self._held.append((text.copy(), stack[-1][1], tag))
                text.clear()

        def pop_to(i: int) -> None:
            nonlocal links, inside
            for tag, *_ in stack[i:]:
                links -= tag == "a"
                inside -= tag in ("article", "main")
            del stack[i:]

        size = len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            piece = source[at : m.start() if m else size]
            if piece:
                add(piece)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if tag in _BLOCK or any(t in _BLOCK for t, *_ in stack[i:]):
                            flush()
                        pop_to(i)
                        break
                else:
                    if tag in _BLOCK:
                        flush()
                continue
            raw = m[3] if m[2] else m[6]
            closed = raw.endswith("/")
            if tag in _RAW and not (closed and tag == "iframe"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else size
                add(" ")
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr"):
                    add(" " if tag == "br" else "")
                continue
            if tag in _BLOCK:
                # A drawing ends where text begins, closed or not.
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in _FOREIGN and tag != "title":
                        pop_to(i)
                        break
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    open_ = stack[i][0]
                    if open_ in _CLOSED_BY_BLOCK or open_ == tag == "li" or open_ in ("dt", "dd") and tag in ("dt", "dd"):
                        pop_to(i)
                        break
                    if open_ in _CONTAINER or open_ in _DROPPED or open_ in _DOUBTFUL:
                        break
            _, box, out, named = stack[-1]
            if raw.strip("/ ") or tag in _DROPPED or tag in _DOUBTFUL or tag == "header":
                step, left_out, furniture, worth = self._attributes(tag, raw, bool(inside))
                out = out or left_out
                if furniture and not closed:
                    named = (*named, len(self._named))
                    self._named.append([0.0, tag in _DOUBTFUL and worth > 1.0])
            else:
                step, worth = tag, 3.0 if tag in ("article", "main") else 1.0
            if tag in _CONTAINER:
                parent.append(box)
                path.append(f"{path[box]}/{step}")
                bonus.append(worth)
                box = len(path) - 1
            if tag in ("article", "main", "h1"):
                for i in named:
                    self._named[i][1] = True
            inside += tag in ("article", "main")
            links += tag == "a"
            if not closed or tag in _BLOCK:
                stack.append((tag, box, out, named))
            else:
                links -= tag == "a"
                inside -= tag in ("article", "main")
        del stack[1:]
        flush()

    def best(self) -> tuple[int, float]:
        """The best container and its score: text outside links, fading by a half at each step up."""
        score = [0.0] * len(self.path)
        for text, box, linked, _ in self.blocks:
            worth = len(text) * (1 - linked)
            while box >= 0 and worth >= 0.5:
                score[box] += worth
                worth *= 0.55
                box = self.parent[box]
        top = max(range(len(score)), key=lambda i: (score[i] * self.bonus[i], -i))
        return top, score[top] * self.bonus[top]

    def text(self, wanted: str | None) -> str:
        """Text of the elements on path ``wanted``, or of the best container if there are none."""
        chosen = {i for i, p in enumerate(self.path) if p == wanted} if wanted is not None else set()
        if not chosen or not self._inside(chosen):
            chosen = {self.best()[0]} if self.blocks else set()
        found = self._inside(chosen)
        around = self._around(chosen, found) if found else []
        return "\n\n".join(self.blocks[k][0] for k in sorted({*found, *around}))

    def _inside(self, chosen: set[int]) -> list[int]:
        """Numbers of the blocks in ``chosen`` containers."""
        within = [False] * len(self.path)
        for i, up in enumerate(self.parent):
            within[i] = i in chosen or up >= 0 and within[up]
        return [k for k, (_, box, _, _) in enumerate(self.blocks) if within[box]]

    def _around(self, chosen: set[int], found: list[int]) -> list[int]:
        """Blocks beside ``chosen`` that belong to their text.

        Of the containers around them: unlinked blocks that stand there directly, neighbours of at least a fifth
        of the text in long unlinked blocks (not of an article), and headings in neighbours before them.
        """
        size = sum(len(self.blocks[k][0]) for k in found)
        whole = any(self.bonus[i] == 3.0 for i in chosen)  # an article has all of its text inside
        above: dict[int, int] = {}  # container around the chosen ones: its child on the way to them
        for i in chosen:
            below, up = i, self.parent[i]
            while up >= 0 and self.path[up] not in ("", "/html", "/html/body", "/body"):
                above[up] = below
                below, up = up, self.parent[up]
            if up >= 0:
                above[up] = below
        taken, beside, more = set(found), {}, []
        for k, (text, box, linked, tag) in enumerate(self.blocks):
            if k in taken:
                continue
            root = box
            while root >= 0 and root not in above:
                below, root = root, self.parent[root]
            if root == box:
                if linked < 0.5 and (tag in _HEADINGS or len(text) >= 80 or self.parent[box] > 0 and self.path[box] not in ("/html/body", "/body") and tag in _LEAF):
                    more.append(k)
            elif root >= 0:
                beside.setdefault(below, []).append(k)
        for blocks in beside.values():
            long = sum(len(self.blocks[k][0]) * (1 - self.blocks[k][2]) for k in blocks if len(self.blocks[k][0]) >= 80)
            full = sum(len(self.blocks[k][0]) for k in blocks)
            if not whole and 5 * long >= size and 4 * long >= 3 * full:
                more += blocks
            elif blocks[-1] < found[0] and full < 300:
                more += [k for k in blocks if self.blocks[k][3] in _HEADINGS and self.blocks[k][2] < 0.5]
        return more


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), r"^www\.", "")


def host_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes, pages: each host's winning path, by votes, then score, then name; and how many pages voted."""
    short_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, float]] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(source.as_py())
                if page.blocks:
                    top, score = page.best()
                    out.append((host, page.path[top], score))
            yield pa.RecordBatch.from_pylist([{"host": h, "path": p, "score": s} for h, p, s in out], pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.float64())]))

    voted = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).mapInArrow(run, "host string, path string, score double")
    paths = voted.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    best = paths.groupBy("host").agg(F.max(F.struct("votes", F.round("score", 3).alias("score"), "path")).alias("b"), F.sum("votes").alias("pages"))
    return best.select("host", "b.path", "b.votes", "pages")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text, as does a page without text.
    Pages without a host share the host "". An empty table gives an empty result;
    repeated rows vote each; other columns aren't read.
    """
    winners = cut(host_paths(pages, id_col, url_col, html_col), "paths").select("host", "path", "pages")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = join_uneven(rows, winners, ["host"], "pages", F.xxhash64("page_id", "url"), BROADCAST_HOSTS).select("page_id", "url", "path", "html")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source.as_py()).text(path) for path, source in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
