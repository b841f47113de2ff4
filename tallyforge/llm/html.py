"""Main text by a site style tree.

The DOMs of one host are merged by their paths (tags with class, id and role). A page is known by its blocks without evident boilerplate, so copies count once, whatever their ids, urls, scripts or menus.
Entropies, per host:

Content: a wording at a path that c of the host's m distinct pages have is spread evenly over them, so its entropy is log(c) / log(m) and its importance 1 less that; a path's content is worth the mean over its wordings.
Presentation: the entropy of the sequences of children that an element shows, to the base of the pages that have it. An element that most pages have, always in one presentation, is part of the template:
template = share of pages that have it * (1 - presentation entropy) * (1 - 1 / m). Its weight is what it holds beside the main path (the one with the most text, that of branches with evidence against them counting less): the greater of the ratios of their text and of the mean length of their blocks,
1 at most. Importance = (weight + (1 - weight) * (1 - template)) * (1 - evidence), and branches below LEAST go. Evidence comes from tags, roles and parts of names, and may only lower a branch's importance; with
`names=False` there is none and the tree decides alone. The host's main path and what leads to it never go, nor do headings and paragraphs that no evidence speaks against: no name empties a host's pages.
A page without the main path that has nothing but its host's template is empty. Decisions are taken once per host and layout (set of paths), on sums over the host.

In what stays, repeated wordings: composite importance of a branch has that of its l presentations weigh 1 - GAMMA^l, the mean of its content and its child branches the rest. On pages with any wording or path of
low importance, wordings of low importance go wherever they are, and so do whole branches of low composite importance, but for those that hold the page's main path.
Beside the main path, in the element that holds it, a wording must be on nearly every page (importance below SURE) to go: articles may share passages.
If less than LEFT of a page's text would stay, the page is a near copy rather than an article among boilerplate, and all repeated wordings stay. Hosts of one page show no repetition.

Null html is empty; a null url is a host of its own; pages are read whole however long, in linear time; repeated pages give a row each;
extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.text import mapped
from tallyforge.sources.tables import Scratch, written

PAGES, LEAST, SURE, LEFT, GAMMA = 2, 0.5, 0.1, 0.25, 0.9
#: Evidence of a tag, a role or a name that says nothing else, and of a name that says something else as well.
PLAIN, MIXED = 0.8, 0.4
DEEPEST = 512  # elements nested deeper count as part of the one at this depth, as in browsers
# fixed values: HTML's element kinds
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
#: What isn't shown as text, and what page parts the others are.
SKIP = frozenset("script style head noscript template iframe svg button select textarea object".split())
PARTS = frozenset("nav footer aside form dialog menu".split())
LISTS = frozenset("ul ol table".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dl dt dd li main article html body".split())
CLOSES_P = frozenset("p div ul ol dl table h1 h2 h3 h4 h5 h6 section article header footer nav aside form pre blockquote main figure hr".split())
ENDS_ITSELF = frozenset("li td th tr dt dd option".split())
ROLES = frozenset("navigation complementary contentinfo banner search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class and id names of branches that aren't the article. STRONG ones speak against any name, and plainly if its other parts are these, PLACES or THINGS; WEAK ones against a name without other parts than these and PLACES.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget widgets"
    " related recommended recommendations share sharing social cookie cookies consent popup modal newsletter subscribe subscription signup comment comments replies disqus pagination pager".split()
)
WEAK = frozenset("header banner notice login search form side toolbar recommend contentinfo complementary".split())
PLACES = frozenset("site page top bottom left right main global box bar block wrapper container area inner outer section panel primary secondary mobile desktop sticky fixed".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The attributes of a tag as HTML reads them: a quote is one only after "=".
_REST = re.compile(r"(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+>")
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


THINGS = frozenset("list lists item items post posts article articles button buttons link links text body title content thread form slot unit zone row col column inner icon icons label count bar tags stories news".split())


@lru_cache(maxsize=1 << 16)
def named(names: str) -> float:
    """What the class and id names of an element say against it."""
    most = 0.0
    for name in names.split():
        parts = _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if not STRONG.isdisjoint(parts):
            most = max(most, PLAIN if all(p in STRONG or p in WEAK or p in PLACES or p in THINGS for p in parts) else MIXED)
        elif not WEAK.isdisjoint(parts) and all(p in WEAK or p in PLACES for p in parts):
            most = PLAIN
    return most


@lru_cache(maxsize=1 << 16)
def evidence(path: str) -> float:
    """What the last element of a path is said to be: 0 for nothing against it."""
    above, _, sig = path.rpartition("/")
    head, _, role = sig.partition("[")
    tag, _, names = head.partition(".")
    if tag in PARTS or role.rstrip("]") in ROLES or (tag == "header" and not re.search(r"(?:^|/)(?:article|main)\b", above)):
        return PLAIN
    return 0.0 if tag in ("html", "body", "article", "main") else named(names.replace(".", " "))


def evident(path: str) -> bool:
    return any(evidence(q) >= PLAIN for q in _up(path))


class _Open:
    __slots__ = ("tag", "path", "noise", "inline", "children")

    def __init__(self, tag: str, path: str, noise: bool, inline: bool):
        self.tag, self.path, self.noise, self.inline, self.children = tag, path, noise, inline, []


class Page:
    """blocks: (path, text) of each leaf block in page order, but for what isn't shown; styles: path -> its sequences of children."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, str]] = []
        self.styles: dict[str, set[str]] = defaultdict(set)
        self.stack: list[_Open] = []
        self.buf: list[str] = []
        self.deeper: dict[str, int] = defaultdict(int)
        self._parse(html or "")

    def _flush(self) -> None:
        text = _SPACE.sub(" ", unescape("".join(self.buf))).strip()
        if text:
            top = next((o for o in reversed(self.stack) if not o.inline), None)
            if not (top and top.noise):
                self.blocks.append((top.path if top else "", text))
        self.buf.clear()

    def _text(self, text: str) -> None:
        if text and not (self.stack and self.stack[-1].inline):
            self.buf.append(text)

    def _pop(self, k: int) -> None:
        self._flush()
        for o in self.stack[k:]:
            if o.children and not o.noise:
                self.styles[o.path].add(",".join(o.children))
        del self.stack[k:]

    def _parse(self, html: str) -> None:
        at = 0
        while (lt := html.find("<", at)) >= 0:
            self._text(html[at:lt])
            nxt = html[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                close = "-->" if html.startswith("<!--", lt) else "]]>" if html.startswith("<![CDATA[", lt) else ">"
                end = html.find(close, lt + 2)
                at = len(html) if end < 0 else end + len(close)
                continue
            closing = nxt == "/"
            name = _NAME.match(html, lt + 1 + closing)
            if not name:
                if closing:  # a comment of a sort
                    end = html.find(">", lt)
                    at = len(html) if end < 0 else end + 1
                else:
                    self._text("<")
                    at = lt + 1
                continue
            rest = _REST.match(html, name.end())
            # a quote that never ends: the tag goes to its first ">"; there is one such place per kind of quote at most
            end = rest.end() if rest else html.find(">", name.end()) + 1
            at = end or len(html)
            tag = name[0].lower()
            if closing:
                self._close(tag)
            else:
                at = self._open(tag, html[name.end() : at - 1] if end else "", html, at)
        self._text(html[at:])
        self._pop(0)

    def _close(self, tag: str) -> None:
        if self.deeper[tag]:
            self.deeper[tag] -= 1
            self._flush()
            return
        k = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag == tag), None)
        if tag in INLINE:
            if k is not None and all(o.inline for o in self.stack[k:]):
                del self.stack[k:]
            return
        if k is None:
            self._flush()
        else:
            self._pop(k)

    def _open(self, tag: str, attributes: str, html: str, at: int) -> int:
        names = role = ""
        hidden = False
        if attributes and not attributes.isspace():
            for a in _ATTR.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    names = f"{names} {value}" if names else value
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                    hidden = True
        stack = self.stack
        if tag in INLINE:
            if tag == "br":
                self._text(" ")
            elif tag not in VOID and len(stack) < DEEPEST and (hidden or (names and named(names) >= PLAIN)):
                stack.append(_Open(tag, "", True, True))
            return at
        self._flush()
        while stack and stack[-1].inline:
            stack.pop()
        if tag in VOID:
            return at
        if tag in CLOSES_P and stack and stack[-1].tag == "p":
            self._pop(len(stack) - 1)
        if tag in ENDS_ITSELF and stack and stack[-1].tag == tag:
            self._pop(len(stack) - 1)
        if tag == "body" and stack and stack[-1].tag == "head":
            self._pop(len(stack) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            return end.end() if end else len(html)
        if len(stack) >= DEEPEST:
            self.deeper[tag] += 1
            return at
        noise = bool(stack) and stack[-1].noise or hidden or tag in SKIP
        sig = f"{tag}.{'.'.join(sorted(names.split()))}".replace("/", "_").replace("[", "_") if names else tag
        if role:
            sig = f"{sig}[{role}]"
        if stack and not noise and stack[-1].children[-1:] != [sig]:
            stack[-1].children.append(sig)  # a run of like children counts as one
        stack.append(_Open(tag, f"{stack[-1].path}/{sig}" if stack else sig, noise, False))
        return at


def path_id(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def wording_id(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


def branches(page: Page) -> list[tuple[int, int, float, float, int, int, int, int]]:
    """id, id of the element above (0: none), evidence, the greatest evidence from the root down to it, kind (2: prose, 1: a list or table, 0: others), text, blocks, and text of its own, of each path that has text in it or below."""
    out: dict[str, list[int]] = {}
    for p, t in page.blocks:
        for k, q in enumerate(_up(p)):
            x = out.setdefault(q, [0, 0, 0])
            x[0] += len(t)
            x[1] += 1
            x[2] += len(t) if k == 0 else 0
    at = [(q, q.rpartition("/")) for q in sorted(out)]
    kind = lambda tag: 2 if tag in PROSE else 1 if tag in LISTS else 0
    return [(path_id(q), path_id(up) if slash else 0, evidence(q), max(evidence(x) for x in _up(q)), kind(re.match(r"\w*", last)[0]), *out[q]) for q, (up, slash, last) in at]


def blocks(html: str | None) -> list[tuple[str, str]]:
    return Page(html).blocks


def template(nodes: list[dict], m: int, main: dict) -> list[int]:
    """Ids of the branches of one layout that are part of its host's template.

    nodes: id, up, hint, kind; on the host's m distinct pages n that have it, their text and blocks; worth, the entropy of its presentations. main: id, own text and blocks of the host's main path.
    """
    by = {v["id"]: v for v in nodes}

    def chain(v: dict) -> list[dict]:
        out = [v]
        while v["up"] in by:
            v = by[v["up"]]
            out.append(v)
        return out

    held = by.get(main["id"])
    line = {v["id"] for v in chain(held)} if held else set()
    length = main["own"] / max(1, main["blocks"])
    low: set[int] = set()
    for v in sorted(nodes, key=lambda v: len(chain(v))):  # parents first
        if v["id"] in line:
            continue
        if v["up"] in low:
            low.add(v["id"])
            continue
        hint = max(x["hint"] for x in chain(v) if x["id"] not in line)
        beside = v["kind"] == 2 or (v["kind"] == 1 and held and v["up"] == held["up"])
        if (beside and not hint) or not main["own"]:
            continue
        weight = min(1.0, max(v["text"] / main["own"], v["text"] / max(1, v["blocks"]) / length))
        fixed = 0.0 if beside else v["n"] / m * (1 - v["worth"]) * (1 - 1 / m)
        if (weight + (1 - weight) * (1 - fixed)) * (1 - hint) < LEAST:
            low.add(v["id"])
    return sorted(low)


def main_text(page: Page, cut: set[int], content: dict[int, float] | None, shown: dict[int, tuple[float, int]] | None) -> str:
    """cut: ids of the template's branches; content: importance of the page's wordings and paths, 1 where it has none; shown: entropy and number of presentations of its paths."""
    gone = {p for p in {p for p, _ in page.blocks} if any(path_id(q) in cut for q in _up(p))} if cut else ()
    own = [(p, t) for p, t in page.blocks if p not in gone]
    if own and content:
        worth = [content.get(wording_id(p, t), 1.0) for p, t in own]
        weight: dict[str, float] = defaultdict(float)
        for (p, t), w in zip(own, worth):
            weight[p] += len(t) * w
        low = low_branches(dict.fromkeys(weight), content, shown or {})
        held = max(weight, key=weight.get)  # ties: the first in the page
        gone = {q for q in low if not f"{held}/".startswith(f"{q}/")}
        around = held.rpartition("/")[0]
        stay = [(p, t) for (p, t), w in zip(own, worth) if w >= (SURE if p.startswith(f"{around}/") else LEAST) and gone.isdisjoint(_up(p))]
        if sum(len(t) for _, t in stay) >= LEFT * sum(len(t) for _, t in own):
            own = stay
    return "\n".join(t for _, t in own)


def _up(path: str) -> list[str]:
    """The path and those above it."""
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(len(parts), 0, -1)]


def low_branches(paths, content: dict[int, float], shown: dict[int, tuple[float, int]]) -> set[str]:
    """Branches whose composite importance is below LEAST; paths: those that have content."""
    parts: dict[str, list[float]] = defaultdict(list)
    for p in paths:
        parts[p].append(content.get(path_id(p), 1.0))
        for q in _up(p):
            parts[q]  # noqa: B018
    low = set()
    for q in sorted(parts, key=lambda x: -x.count("/")):  # children before their parents
        value = sum(parts[q]) / len(parts[q])
        if spread := shown.get(path_id(q)):
            own = GAMMA ** spread[1]
            value = (1 - own) * spread[0] + own * value
        if value < LEAST:
            low.add(q)
        if "/" in q:
            parts[q.rpartition("/")[0]].append(value)
    return low


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars. Without names, tags, roles and names are no evidence."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1))
    sited = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("html").alias("content"))

    def parse():
        def work(texts):
            rows = []
            for h in texts:
                p = Page(h)
                own = [(path_id(q), wording_id(q, t)) for q, t in p.blocks if not (names and evident(q))]
                key = path_id(",".join(str(w) for _, w in own))
                shown = [(path_id(q), path_id(";".join(sorted(s)))) for q, s in p.styles.items()]
                distinct = sorted(set(own))
                nodes = branches(p)
                layout = path_id(",".join(str(v[0]) for v in nodes))
                row = [key, layout, [x[0] for x in distinct], [x[1] for x in distinct], [x[0] for x in shown], [x[1] for x in shown]]
                rows.append((*row, *([v[k] for v in nodes] for k in range(8))))
            return None, list(zip(*rows))

        return work

    def decide():
        def work(rows):
            return None, [[template([{**v, "hint": v["hint"] if names else 0.0} for v in r["nodes"]], r["m"], r["main"]) for r in rows]]

        return work

    with Scratch(pages.sparkSession, "style-tree") as tmp:
        shape = "page long, layout long, path array<long>, wording array<long>, shown array<long>, style array<long>, id array<long>, up array<long>, hint array<float>, chain array<float>, kind array<int>, text array<int>, blocks array<int>, own array<int>"
        made = mapped(sited, parse, shape, ["host", "content"], "html")
        parsed = tmp.written(made.dropDuplicates(["host", "content"]), "dom")
        dom = tmp.written(parsed.dropDuplicates(["host", "page"]), "pages")
        hosts = tmp.written(dom.groupBy("host").agg(F.count("*").alias("m")), "hosts")
        # m comes in when there is a row per path or wording
        total = hosts.where(f"m >= {PAGES}")
        styles = dom.select("host", F.explode(F.arrays_zip("shown", "style")).alias("x")).groupBy("host", "x.shown", "x.style").agg(F.count("*").alias("c"))
        c, n = F.col("c"), F.col("n")
        # -sum(c/n * log(c/n)) / log(n) = (log(n) - sum(c * log(c)) / n) / log(n)
        entropy = styles.groupBy("host", F.col("shown").alias("id")).agg(F.sum("c").alias("n"), F.sum(c * F.log(c)).alias("s"), F.count("*").cast("int").alias("l"))
        entropy = tmp.written(entropy.select("host", "id", F.when(n > 1, 1 - F.col("s") / n / F.log(n)).otherwise(1.0).alias("worth"), "l", F.when(n > 1, 1 - F.col("s") / n / F.log(n)).otherwise(0.0).alias("varied")), "entropy")
        # the template: sums per host and path, decisions per host and layout
        part = dom.select("host", F.explode(F.arrays_zip("id", "chain", "text", "blocks", "own")).alias("x")).groupBy("host", "x.id", "x.chain").agg(F.count("*").alias("n"), *[F.sum(f"x.{k}").alias(k) for k in ("text", "blocks", "own")])
        part = tmp.written(part, "paths")
        heavy = F.col("own") * (1 - F.col("chain").cast("double")) if names else F.col("own")
        main = part.groupBy("host").agg(F.max_by(F.struct("id", "own", "blocks"), F.struct(heavy.alias("heavy"), F.col("id").alias("id"))).alias("main"))
        layouts = parsed.groupBy("host", "layout").agg(F.first(F.arrays_zip("id", "up", "hint", "kind")).alias("x")).select("host", "layout", F.explode("x").alias("x")).select("host", "layout", "x.*")
        node = layouts.join(part.drop("chain"), ["host", "id"]).join(entropy.select("host", "id", "varied"), ["host", "id"], "left").withColumn("worth", F.coalesce("varied", F.lit(0.0)))
        node = node.groupBy("host", "layout").agg(F.collect_list(F.struct("id", "up", "hint", "kind", "n", "text", "blocks", "worth")).alias("nodes")).join(hosts, "host").join(main, "host")
        low = tmp.written(mapped(node.select("host", "layout", F.struct("nodes", "m", "main").alias("r")), decide, "low array<long>", ["host", "layout"], "r").where("size(low) > 0"), "template")
        # repeated wordings in what isn't evident boilerplate
        count = dom.select("host", F.explode(F.arrays_zip("path", "wording")).alias("x")).groupBy("host", "x.path", "x.wording").agg(F.count("*").alias("c"))
        count = tmp.written(count, "wordings")
        spread = count.groupBy("host", F.col("path").alias("id")).agg(F.avg(F.log("c")).alias("spread")).where("spread > 0")
        both = spread.unionByName(count.where("c > 1").select("host", F.col("wording").alias("id"), F.log("c").alias("spread")))
        content = tmp.written(both.join(total, "host").select("host", "id", (1 - F.col("spread") / F.log("m")).alias("worth")), "content")
        ids = F.explode(F.array_distinct(F.concat("path", "wording"))).alias("id")
        met = parsed.select("host", "content", ids).join(content.where(F.col("worth") < LEAST), ["host", "id"], "left_semi").select("host", "content").distinct()
        met = tmp.written(met, "met")  # the pages that have something of low importance
        repeated = parsed.join(met, ["host", "content"], "left_semi")
        values = repeated.select("host", "content", ids).join(content, ["host", "id"]).select("host", "content", F.struct("id", F.col("worth"), F.lit(0).alias("l")).alias("v"))
        shown = repeated.select("host", "content", F.explode("shown").alias("id")).join(entropy, ["host", "id"]).select("host", "content", F.struct("id", "worth", "l").alias("v"))
        tree = values.unionByName(shown).groupBy("host", "content").agg(F.collect_list("v").alias("tree"))
        plain = parsed.select("host", "content", "layout").join(low, ["host", "layout"]).select("host", "content", "low")
        tree = written(plain.join(tree, ["host", "content"], "full_outer"), "trees")

    def cut():
        def work(rows):
            out = []
            for r in rows:
                tree = r["tree"] or []
                content = {v["id"]: v["worth"] for v in tree if not v["l"]}
                out.append(main_text(Page(r["html"]), set(r["low"] or ()), content, {v["id"]: (v["worth"], v["l"]) for v in tree if v["l"]}))
            return None, [out, [len(t) for t in out]]

        return work

    # one kind of join at every size
    page = sited.join(tree.hint("merge"), ["host", "content"], "left").select("page_id", "url", F.struct("html", "low", "tree").alias("page"))
    return mapped(page, cut, "text string, n_chars long", ["page_id", "url"], "page")
