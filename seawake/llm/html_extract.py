"""Main text of web pages by consensus of the pages of a host.

Every page scores its containers; the scores of a generalised tag-class path are added
up over the pages of its host, and the path with most of them is the host's. Each page is
then extracted again from the elements at that path, or from its own best container where
it has none there: from the articles that they are parts of, so that titles, leads and
further parts stay.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.common import batch, map_arrow, slices
from seawake.session import broadcast_if_small, stored

# --- fixed values ------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("article body div main section td blockquote".split())
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed fieldset footer form head header iframe input label legend map menu meter nav noscript "
    "object progress select template textarea title video".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "disqus feedback footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain "
    "pager pagination paywall popup privacy promo promos promotion recommendations recommended related replies reply respond rss search share sharing "
    "sidebar sidenav signup social sponsor sponsored subscribe subscription tags toolbar tooltip topbar widget widgets".split()
)
#: Those that name notices, advertisements and remarks rather than parts of a layout.
CERTAIN_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense comment comments consent cookie cookies copyright disclaimer disqus gdpr modal newsletter "
    "outbrain pager pagination paywall popup replies reply respond sponsor sponsored tooltip".split()
)
#: Of the text outside links that is not in elements of these: other words drop no element with more
#: than the share ``MOST``, and none at all where less than ``LEAST_LEFT`` would be left.
MOST = 2 / 3
LEAST_LEFT = 0.2
#: A page with so many characters is not dropped as a whole.
LONG_PAGE = 1000
#: Elements that a class never drops.
ALWAYS = frozenset("html body main article".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: The elements that an opening tag ends if they are open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body div section article main select".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)"
    r"(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A host's path outside the page's best container counts if it holds this share of its text.
LEAST_SHARE = 0.2
#: Sums of votes that a task holds before it hands them on.
HELD_VOTES = 100_000


class Page:
    """Elements of a page and its text in blocks.

    ``nodes`` are ``(parent, tag, path, dropped, good)`` with the parent's number, -1 for none, and
    dropped for a tag, role or style (what class words drop is judged when all text is known);
    ``blocks`` are ``[node, text, characters in links]`` in page order.
    """

    def __init__(self, source: str) -> None:
        self.nodes, self.blocks = [(-1, "", "", False, False)], []
        self.worded = [0]  # whether the element's own class or id speaks against it: 0, 1, or 2 if for certain
        self.stack, self.links, self.fresh = [0], 0, True
        at = 0
        for m in TAG.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = m["name"]
            if name:
                name = name.lower()
                if m["end"]:
                    self._close(name)
                else:
                    self._open(name, m["rest"])
        if at < len(source):
            self._text(source[at:])
        dropped = self._dropped_by_words() if any(self.worded) else [False] * len(self.nodes)
        self.blocks = [self._joined(node, [p for p in parts if not dropped[p[0]]]) for node, parts in self.blocks]
        self.blocks = [b for b in self.blocks if b[1]]

    @staticmethod
    def _joined(node: int, parts: list[tuple[int, str, bool]]) -> list:
        text = " ".join(html.unescape("".join(raw for _, raw, _ in parts)).split())
        return [node, text, sum(len(raw) for _, raw, linked in parts if linked)]

    def _dropped_by_words(self) -> list[bool]:
        """Of each element, whether it or one around it is dropped for its class or id. One that
        holds the page's largest article or main, or most of the page's text outside links, is not."""
        n = len(self.nodes)
        own, plain = [0] * n, [0] * n
        for _, parts in self.blocks:
            for node, raw, linked in parts:
                own[node] += 0 if linked else len("".join(raw.split()))
        plain[:] = own
        for k in range(n - 1, 0, -1):  # children have greater numbers
            plain[self.nodes[k][0]] += plain[k]
        articles = [k for k in range(1, n) if self.nodes[k][1] in ("article", "main") and plain[k] and not self.worded[k]]
        around = set(self._above(max(articles, key=lambda k: (plain[k], k), default=0)))

        def dropped(is_bad) -> tuple[list[bool], int]:
            out = [False] * n
            for k in range(1, n):
                out[k] = out[self.nodes[k][0]] or self.worded[k] and self.nodes[k][1] not in ALWAYS and k not in around and is_bad(k)
            return out, sum(c for c, gone in zip(own, out, strict=True) if not gone)

        certain, total = dropped(lambda k: self.worded[k] == 2)
        out, left = dropped(lambda k: self.worded[k] == 2 or plain[k] <= MOST * total)
        if left < LEAST_LEFT * total:
            out, left = certain, total
        return out if left or plain[0] < LONG_PAGE else [False] * n

    def _text(self, raw: str) -> None:
        node = self.stack[-1]
        if self.nodes[node][3]:
            return
        if self.fresh:
            if raw.isspace():
                return
            self.blocks.append((self._holder(), []))
            self.fresh = False
        self.blocks[-1][1].append((node, raw, self.links > 0))

    def _holder(self) -> int:
        """The nearest block element that is open."""
        return next((n for n in reversed(self.stack) if self.nodes[n][1] in BLOCK), 0)

    def _pop(self, to: int) -> None:
        for n in self.stack[to:]:
            self.links -= self.nodes[n][1] == "a"
        del self.stack[to:]

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self.fresh = True
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.nodes[self.stack[k]][1]
            if tag == name:
                self._pop(k)
                return
            if name not in BLOCK and tag in SCOPE:
                return

    def _open(self, name: str, rest: str) -> None:
        if name == "br":
            self._text(" ")
            return
        if name in BLOCK:
            self.fresh = True
            ends = (*ENDS.get(name, ()), "p")
            for k in range(len(self.stack) - 1, 0, -1):
                tag = self.nodes[self.stack[k]][1]
                if tag in ends:
                    self._pop(k)
                    break
                if tag in SCOPE:
                    break
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            return
        parent = self.stack[-1]
        *judged, worded = self._judge(parent, name, rest)
        self.nodes.append((parent, name, *judged))
        self.worded.append(worded)
        self.stack.append(len(self.nodes) - 1)
        self.links += name == "a"

    def _judge(self, parent: int, name: str, rest: str) -> tuple[str, bool, bool, int]:
        """Path, whether the element's text is dropped, and whether its names speak for it or against it."""
        found = {a[0].lower() or "hidden": a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(rest)} if rest else {}
        names = (found.get("class", "") + " " + found.get("id", "")).split()
        _, tag, path, dropped, _ = self.nodes[parent]
        words = {w.lower() for n in names if not n.startswith(("has-", "with-", "no-", "is-")) for w in WORDS.findall(n)}
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        bad = name in DROPPED or hidden or found.get("role", "").lower() in DROPPED_ROLES
        if name in HEADINGS and dropped and tag == "header" and not bad:
            dropped = not self._within_article(parent)
        good = not words.isdisjoint(GOOD_WORDS)
        worded = 0 if words.isdisjoint(DROPPED_WORDS) else 1 if good or words.isdisjoint(CERTAIN_WORDS) else 2
        classes = ".".join(sorted(re.sub(r"[0-9]+", "#", c.lower()) for c in found.get("class", "").split()))
        step = name + ("." + classes if classes else "")
        return f"{path}/{step}" if name in CONTAINER else path, dropped or bad, good, worded

    def _within_article(self, node: int) -> bool:
        while node > 0:
            if self.nodes[node][1] in ("article", "main"):
                return not self.nodes[node][3]
            node = self.nodes[node][0]
        return False

    def containers(self) -> dict[int, float]:
        """Score of each container: the text outside links in its own blocks, and half of
        what the containers right within it have."""
        own = {}
        for node, text, linked in self.blocks:
            while node > 0 and self.nodes[node][1] not in CONTAINER:
                node = self.nodes[node][0]
            plain = max(0, len(text) - linked)
            own[node] = own.get(node, 0) + plain * plain / len(text)
        total = dict(own)
        for node, score in own.items():
            up = self.nodes[node][0]
            while up > 0 and self.nodes[up][1] not in CONTAINER:
                up = self.nodes[up][0]
            if node > 0:
                total[up] = total.get(up, 0) + score / 2
        return {n: s * (1.25 if self.nodes[n][1] in ("article", "main") or self.nodes[n][4] else 1) for n, s in total.items()}

    def votes(self) -> dict[str, int]:
        """Millionths of the page's vote for each path, from all containers at it."""
        scores = self.containers()
        total, paths = sum(scores.values()) or 1.0, {}
        for n in sorted(scores):
            paths[self.nodes[n][2]] = paths.get(self.nodes[n][2], 0.0) + scores[n] / total
        return {path: round(share * 1e6) for path, share in paths.items()}

    def best(self) -> int | None:
        scores = self.containers()
        return max(scores, key=lambda n: (scores[n], -n)) if scores else None

    def text_of(self, roots: set[int]) -> str:
        """The text below any of the elements, block by block."""
        inside = [False] * len(self.nodes)
        for n, node in enumerate(self.nodes):
            inside[n] = n in roots or node[0] >= 0 and inside[node[0]]
        return "\n".join(text for node, text, _ in self.blocks if inside[node])

    def _above(self, node: int) -> list[int]:
        """The element and those around it, from the inside."""
        out = []
        while node > 0:
            out.append(node)
            node = self.nodes[node][0]
        return out

    def whole(self, roots: set[int]) -> set[int]:
        """For each element with text the article that it is part of: the nearest article or main
        around it, and a main around the only article in it. Without any, the
        smallest element below the body that adds text outside links."""
        plain, articles = [0] * len(self.nodes), [0] * len(self.nodes)
        some = [0] * len(self.nodes)
        for node, text, linked in self.blocks:
            plain[node] += max(0, len(text) - linked)
            some[node] += len(text)
        for n in range(len(self.nodes) - 1, 0, -1):  # children have greater numbers
            articles[n] += self.nodes[n][1] == "article" and some[n] > 0
            for count in (plain, articles, some):
                count[self.nodes[n][0]] += count[n]
        out = set()
        for root in roots:
            if not some[root]:
                continue
            above = self._above(root)
            found = next((n for n in above if self.nodes[n][1] in ("article", "main")), None)
            if found is not None:
                around = next((n for n in self._above(found) if self.nodes[n][1] == "main"), found)
                found = around if articles[around] == 1 else found
            elif self.nodes[root][1] not in ("body", "html"):
                below = [n for n in above if self.nodes[n][1] not in ("body", "html")]
                found = next((n for n in below if plain[n] > plain[root]), None)
            out.add(root if found is None else found)
        return out

    def parts_of(self, roots: set[int]) -> str:
        """The text of the whole articles of the elements. What lies right in the body, in no
        container, belongs to elements that no other one is around."""
        roots = self.whole(roots)
        body = {self.nodes[n][0] for n in roots if self.nodes[self.nodes[n][0]][1] == "body" and self.nodes[n][1] not in ("article", "main")}
        inside = [False] * len(self.nodes)
        for n, node in enumerate(self.nodes):
            inside[n] = n in roots or node[0] >= 0 and inside[node[0]]
        return "\n".join(text for node, text, linked in self.blocks if inside[node] or 2 * linked < len(text) and self._container(node) in body)

    def _container(self, node: int) -> int:
        return next((n for n in self._above(node) if self.nodes[n][1] in CONTAINER), 0)

    def extract(self, path: str | None) -> str:
        best = self.best()
        if best is None:
            return ""
        own = self.text_of({best})
        if path is not None and self.nodes[best][2] != path:
            shared = {n for n, node in enumerate(self.nodes) if node[2] == path and node[1] in CONTAINER}
            size = len(self.text_of(shared))
            # Elements within the own container are a part of it, and it is the larger one.
            if size and size >= LEAST_SHARE * len(own) and len(self.text_of({best, *shared})) > len(own):
                return self.parts_of(shared)
        return self.parts_of({n for n, node in enumerate(self.nodes) if node[2] == self.nodes[best][2] and node[1] == self.nodes[best][1]})


VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())])
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.withColumn("host", F.when(host != "", host))


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: the path with most votes of each host; ties go to the smaller path.
    A page's votes add up to one at most, so long pages do not outvote the others."""

    def vote(batches):
        held = {}

        def handed_on():
            rows = [(host, path, n) for (host, path), n in held.items()]
            held.clear()
            return batch(VOTES, *map(list, zip(*rows, strict=True)))

        for part, sources in slices(batches, "html"):
            for host, source in zip(part.column(0).to_pylist(), sources, strict=True):
                for path, n in Page(source).votes().items():
                    held[host, path] = held.get((host, path), 0) + n
                if len(held) >= HELD_VOTES:
                    yield handed_on()
        if held:
            yield handed_on()

    votes = map_arrow(with_host(pages).where("host IS NOT NULL").select("host", "html"), vote, VOTES)
    # Sums of whole numbers do not depend on the order in which they are added.
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min(F.struct(-F.col("votes"), F.col("path").alias("path"))).alias("first")).select("host", "first.path")


def main_texts(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages`` (page_id, url, html; other
    columns are ignored).

    White space within a block is one space, blocks are joined by line ends. A null
    or empty html, or one without text, gives an empty text. A page without url or host
    is extracted by itself. Repeated rows are returned each; an empty table gives no rows.
    """

    def extract(batches):
        for part, sources in slices(batches, "html"):
            paths = part.column(3).to_pylist()
            texts = [Page(s).extract(p) for s, p in zip(sources, paths, strict=True)]
            yield batch(TEXTS, part.column(0), part.column(1), texts, [len(t) for t in texts])

    paths = broadcast_if_small(stored(host_paths(pages), "host-paths"))  # else a join in which a large host is split
    both = with_host(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).join(paths, "host", "left")
    return map_arrow(both.select("page_id", "url", "html", "path"), extract, TEXTS)
