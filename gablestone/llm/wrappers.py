"""Main text of web pages by union-free regular expressions inferred for each host.

A page is a balanced stream of block tags and texts. Two scans infer what its host's pages
have in common. The first counts, at every path of tags, on how many pages each text stands
and how many brothers of one tag there are: a text on at least half of the pages that have
its path is a constant of the template, and brothers whose number never changes are told
apart by their place. The second takes each page as such a token stream and aligns it, level
by level, with the wrapper found so far: what only one side has becomes optional, what
recurs or changes its order becomes a repeated group, and text that is no constant is a
slot. In this form a token stands at one place of its level only, so aligning costs no more
than reading, nothing is cut off, and a page is parsed by walking down the expression.

The wrapper is then judged by what pages put into its slots. The root is the element that
holds most of the changing prose, links not counted. Constants aren't main text, nor are
slots outside the root, slots that hold links only, and slots below elements whose tag or
class says menu, header, footer, sidebar, notice, advert, form, script, style or reader
comment; a class that also says content, or a lead paragraph, overrides the weaker words.
The third scan parses each page by its host's wrapper and emits the slots that are left.

Every page of every host goes into the wrappers. What a task holds, and the wrapper of a
host, grow with the different paths of tags that a host has, not with its pages. Pages
are not shuffled while the wrappers, whose bytes are summed first, are few enough to be
broadcast; beyond that they meet by host and a salt, so no host is one task.

Defined results: a null or empty html gives an empty text; pages without a readable host
share a wrapper; broken markup is balanced first (what is left open is closed, stray ends
are dropped); text without any tag is main text; a page of which more than half would be
constants keeps them, as it is one of many copies; a page with nothing in its host's slots
is judged by itself; of elements that hold equally much the first path by its hash is the
root; huge and deep pages are read whole; repeated pages are answered row by row; other
columns pass through.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gablestone.llm.common import Scratch, free_prefix, parts, read

#: A text is a constant if it stands on so many pages of a host, and on this share of those with its path.
EVIDENCE, SHARE = 5, 0.5
#: A slot with a larger share of its characters in links is no prose.
LINKED = 0.8
#: How much more a changing character says about the root than one of a constant.
CHANGING = 20
#: Shares of the prose by which an article or a main element is the root, and by which the search goes down.
ARTICLE, MAIN, DOWN = 1 / 3, 1 / 2, 0.7
#: Groups into which the tasks' wrappers of a host are first merged, and by which pages are salted.
FAN = 64
#: Bytes of wrappers that are broadcast, and entries that a task counts before it hands them on.
BROADCAST_BYTES, ENTRIES = 64 << 20, 200_000

# Elements by their role in HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "div", "section"}
NEVER = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "button", "select", "textarea", "title", "dialog", "menu", "audio", "video", "map", "xmp", "noembed", "noframes"}
#: Words of a class, id or role of what isn't the article; weaker ones, that other evidence overrides; those that say so outside it only.
STRONG = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer",
    "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "pager", "pagination", "paywall", "popup", "replies", "respond", "sidebar", "signup", "skip", "sponsor", "sponsored", "toolbar",
}
WEAK = {"alert", "banner", "copyright", "notice", "notices", "notification", "overlay", "promo", "promotion", "related", "recommended", "reply", "search", "share", "sharing", "social", "subscribe", "teaser", "widget"}
OUTSIDE = {"header", "masthead", "topbar", "top", "bottom", "toc"}
MARKS = STRONG | WEAK
CONTENT = {"article", "main", "post", "story", "entry", "content", "articlebody", "body", "lead", "intro"}
#: Weak words that a paragraph or heading of an article may well bear.
LEADS = {"teaser", "promo", "share", "social", "related", "banner"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"}
ROOT_WORDS = {"article", "main", "post", "story", "entry", "content"}
GOES_DOWN = {"html", "body", "div", "section", "table", "tbody", "tr", "td", "center", "main", "article"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = " \t\n\r\x0c"


@lru_cache(maxsize=20_000)
def _named(name: str, rest: str) -> str:
    """An element's key: its name, and the words of its class, id and role."""
    words = sorted({w for m in ATTRIBUTE.finditer(rest) for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or ("hidden" if m[1].lower() == "hidden" else "")).lower())}) if "=" in rest or "hidden" in rest else []
    return ".".join([name, *words])


def stream(page: str | None) -> Iterator[tuple[str, str, int]]:
    """Balanced events: ("<", key, 0), (">", key, 0) and ("#", raw text, characters in links).

    Inline tags are part of the text, but for those whose words mark them as no article.
    What scripts, styles and other raw elements hold is no text.
    """
    page = page or ""
    open_: list[str] = []
    held: list[str] = []
    at, n, link, linked = 0, len(page), False, 0

    def text():
        nonlocal linked
        if held:
            out = "".join(held)
            held.clear()
            if out.strip():
                yield "#", out, linked
        linked = 0

    def close(to: int):
        yield from text()
        while len(open_) > to:
            yield ">", open_.pop(), 0

    for m in iter(lambda: TAG.search(page, at), None):
        if m.start() > at:
            held.append(page[at : m.start()])
            linked += link and len(held[-1].strip())
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        link = (not m[1]) if name == "a" else link
        if m[1]:
            if name == "br":
                held.append(" ")
            elif name == "p" and not any(k.split(".", 1)[0] == "p" for k in open_):
                yield from text()
            elif name not in VOID:
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i].split(".", 1)[0] == name:
                        if name not in INLINE or all(k.split(".", 1)[0] in INLINE for k in open_[i:]):
                            yield from close(i)
                        break
            continue
        if name in VOID:
            if name in ("br", "hr", "img", "input"):
                held.append(" ")
            continue
        key = _named(name, m[3])
        if name in INLINE and not MARKS.intersection(key.split(".")[1:]) and "hidden" not in key:
            continue
        if name not in INLINE:
            # A block ends an open paragraph; items end the one before them in their list.
            for i in range(len(open_) - 1, -1, -1):
                k = open_[i].split(".", 1)[0]
                if k == "p" or k in CLOSES.get(name, ()):
                    yield from close(i)
                    if k == "p" and name in CLOSES:
                        continue
                    break
                if k in SCOPES:
                    break
        yield from text()
        yield "<", key, 0
        open_.append(key)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            yield ">", open_.pop(), 0
    if at < n:
        held.append(page[at:])
    yield from close(0)


# --- pages as trees ---------------------------------------------------------------
# An element is [key, plain path, kids]; a text is [None, text, characters in links, hash].
# Paths are chains of hashes, so that their size doesn't follow the depth of a page.


def chained(key: str, above: int) -> int:
    return xxhash.xxh64_intdigest(key, above)


def tree(page: str | None) -> list:
    """The page's elements that hold text, below a nameless top."""
    top: list = ["", 0, []]
    stack = [top]
    for kind, value, linked in stream(page):
        if kind == "<":
            here = stack[-1]
            new = [value, chained(value, here[1]), []]
            here[2].append(new)
            stack.append(new)
        elif kind == ">":
            if not stack.pop()[2]:
                stack[-1][2].pop()
        else:
            here = stack[-1]
            here[2].append([None, value, linked, chained(" ".join(value.split()), here[1])])
    return top


def elements(top: list) -> Iterator[list]:
    todo = [top]
    while todo:
        here = todo.pop()
        yield here
        todo.extend(k for k in reversed(here[2]) if k[0] is not None)


TEXT, PATH, BROTHERS, PARENT = range(4)


def count_page(page: str | None, counts: dict, host: str) -> None:
    """Add a page to what is counted: (host, kind, path, item) -> [n, fewest, most]."""
    texts, paths = set(), set()
    for here in elements(tree(page)):
        plain, brothers = here[1], {}
        for kid in here[2]:
            if kid[0] is None:
                texts.add((plain, kid[3]))
                paths.add(plain)
            else:
                brothers[kid[0]] = brothers.get(kid[0], 0) + 1
        if brothers:
            _counted(counts, (host, PARENT, plain, 0), 1)
            for key, n in brothers.items():
                _counted(counts, (host, BROTHERS, plain, chained(key, plain)), n)
    for plain, text in texts:
        _counted(counts, (host, TEXT, plain, text), 1)
    for plain in paths:
        _counted(counts, (host, PATH, plain, 0), 1)


def _counted(counts: dict, at: tuple, size: int) -> None:
    if (c := counts.get(at)) is None:
        counts[at] = [1, size, size]
    else:
        c[0] += 1
        c[1], c[2] = min(c[1], size), max(c[2], size)


class Template:
    """What is known of a host before its pages are aligned: constants and columns, as hashes."""

    def __init__(self, spec: str | None):
        d = json.loads(spec) if spec else {}
        self.constants, self.columns = set(d.get("t") or ()), set(d.get("c") or ())

    def walk(self, top: list) -> Iterator[tuple[int, int, str, list[str], list]]:
        """(path, path above, token, tokens of its level, texts) of each element, in page order.

        The tokens of a level are "#" for a slot, "#=hash" for a constant text, "key=hash"
        for an element of constant texts alone, "key/place" for a column, and else the key.
        """
        todo = [(0, 0, "", top)]
        while todo:
            path, above, token, here = todo.pop()
            tokens, below, place = [], [], {}
            for kid in here[2]:
                key = kid[0]
                if key is None:
                    tokens.append(f"#={kid[3]:x}" if kid[3] in self.constants else "#")
                    continue
                symbol = key
                if chained(key, here[1]) in self.columns:
                    place[key] = place.get(key, 0) + 1
                    symbol = f"{key}/{place[key]}"
                if all(k[0] is None and k[3] in self.constants for k in kid[2]):
                    symbol = f"{symbol}={chained(''.join(str(k[3]) for k in kid[2]), 0):x}"
                tokens.append(symbol)
                below.append((chained(symbol, path), path, symbol, kid))
            yield path, above, token, tokens, here[2]
            todo.extend(reversed(below))


# --- wrappers -----------------------------------------------------------------------
# A level is a row of groups [repeated, optional, [[token, optional], ...]]; a token stands in
# one group only.


def fold(tokens: list[str]) -> list:
    """One row of tokens as a level: what recurs is a repeated group with all that lies between."""
    last = {t: i for i, t in enumerate(tokens)}
    out, i = [], 0
    while i < len(tokens):
        end, j = last[tokens[i]], i
        while j <= end:
            end = max(end, last[tokens[j]])
            j += 1
        part = tokens[i : end + 1]
        body = list(dict.fromkeys(part))
        whole = len(part) % len(body) == 0 and body * (len(part) // len(body)) == part
        out.append([len(part) > 1, False, [[t, not whole] for t in (body if whole else sorted(body))]])
        i = end + 1
    return out


def align(a: list, b: list) -> list:
    """The level that covers both.

    Groups with common tokens meet. Where they would cross, or one meets several, all that
    lies between is one repeated group of optional tokens; what only one side has is optional.
    """
    if a == b:
        return a
    at = {t: j for j, g in enumerate(b) for t, _ in g[2]}
    met = [(i, min(js), max(js)) for i, g in enumerate(a) if (js := [at[t] for t, _ in g[2] if t in at])]
    clusters: list[list[int]] = []
    least = [len(b)] * (len(met) + 1)
    for k in range(len(met) - 1, -1, -1):
        least[k] = min(least[k + 1], met[k][1])
    for k, (i, lo, hi) in enumerate(met):
        if clusters and clusters[-1][3] >= least[k]:
            c = clusters[-1]
            c[1], c[2], c[3] = i, min(c[2], lo), max(c[3], hi)
        else:
            clusters.append([i, i, lo, hi])
    out, i, j = [], 0, 0
    for i0, i1, j0, j1 in [*clusters, [len(a), len(a), len(b), len(b)]]:
        out += [[r, True, ts] for r, _, ts in (*a[i:i0], *b[j:j0])]
        if i0 < len(a):
            out.append(_united(a[i0 : i1 + 1], b[j0 : j1 + 1]))
        i, j = i1 + 1, j1 + 1
    return out


def _united(x: list, y: list) -> list:
    if len(x) == len(y) == 1:
        (r, o, ts), (q, p, us) = x[0], y[0]
        if [t for t, _ in ts] == [t for t, _ in us]:
            return [r or q, o or p, [[t, m or n] for (t, m), (_, n) in zip(ts, us)]]
    for one, other in ((x, y), (y, x)):
        # A repeated group met by one copy of its tokens stays that group.
        if len(one) == 1 and not any(r for r, _, _ in other) and [t for t, _ in one[0][2]] == [t for _, _, ts in other for t, _ in ts]:
            inner = [o or m for _, o, ts in other for _, m in ts]
            return [one[0][0], one[0][1], [[t, m or n] for (t, m), n in zip(one[0][2], inner)]]
    return [True, any(g[1] for g in (*x, *y)), [[t, True] for t in sorted({t for g in (*x, *y) for t, _ in g[2]})]]


class Wrapper:
    """A host's expression: levels and tokens by path, and what its pages put into each slot."""

    def __init__(self, kept: dict | None = None):
        kept = kept or {}
        self.levels: dict[int, list] = {int(k): v for k, v in kept.get("levels", {}).items()}
        self.above: dict[int, tuple[int, str]] = {int(k): tuple(v) for k, v in kept.get("above", {}).items()}
        #: Characters of changing text, of them in links, and of constants.
        self.filled: dict[int, list[int]] = {int(k): v for k, v in kept.get("filled", {}).items()}
        self.shapes: set[int] = set()

    def kept(self) -> dict:
        return {"levels": self.levels, "above": self.above, "filled": self.filled}

    def add_page(self, page: str | None, template: Template) -> None:
        new, shape = [], 0
        for path, above, token, tokens, kids in template.walk(tree(page)):
            new.append((path, above, token, tokens))
            shape = chained(" ".join(tokens), shape)
            for t, kid in zip(tokens, (k for k in kids)):
                if kid[0] is None:
                    self.fill(path, [0, 0, len(kid[1])] if t != "#" else [len(kid[1]), kid[2], 0])
        if shape in self.shapes:
            return  # a shape is aligned once; more often would change nothing
        if len(self.shapes) >= ENTRIES:
            self.shapes.clear()
        self.shapes.add(shape)
        for path, above, token, tokens in new:
            self.meet(path, (above, token), fold(tokens))

    def fill(self, path: int, sizes: list[int]) -> None:
        have = self.filled.setdefault(path, [0, 0, 0])
        for i, n in enumerate(sizes):
            have[i] += n

    def meet(self, path: int, above: tuple[int, str], level: list) -> None:
        self.above[path] = above
        known = self.levels.get(path)
        self.levels[path] = level if known is None else align(known, level)

    def merge(self, other: Wrapper) -> None:
        for path, level in other.levels.items():
            self.meet(path, other.above[path], level)
        for path, sizes in other.filled.items():
            self.fill(path, sizes)

    def chain(self, path: int) -> list[tuple[int, str]]:
        """(path, token) of the elements from the top down to this one."""
        out = []
        while path:
            above, token = self.above[path]
            out.append((path, token))
            path = above
        return out[::-1]

    def expression(self, path: int = 0) -> str:
        """The wrapper in words."""

        def show(token: str) -> str:
            if token[0] == "#":
                return "#" if token == "#" else "'const'"
            name = re.split(r"[./=]", token)[0]
            return f"<{token.split('=')[0]}>{self.expression(chained(token, path))}</{name}>"

        sign = {(False, False): "", (False, True): "?", (True, False): "+", (True, True): "*"}
        out = []
        for repeated, optional, tokens in self.levels.get(path, []):
            inner = "".join(f"({show(t)})?" if o else show(t) for t, o in tokens)
            out.append(f"({inner}){s}" if (s := sign[bool(repeated), bool(optional)]) else inner)
        return "".join(out)


# --- judging slots --------------------------------------------------------------------


@lru_cache(maxsize=50_000)
def _read(token: str) -> tuple[str, frozenset[str]]:
    name, *words = re.split(r"[/=]", token)[0].split(".")
    return name, frozenset(words)


def no_article(token: str, inside: bool) -> bool:
    name, words = _read(token)
    if name in NEVER or "hidden" in words:
        return True
    if name in ("body", "html"):
        return False
    if words & STRONG and not words & CONTENT:
        return True
    weak = words & WEAK
    if weak and not words & CONTENT and not (inside and name in PROSE and weak <= LEADS):
        return True
    return not inside and (name == "header" or bool(words & OUTSIDE) and not words & CONTENT)


def _rank(token: str) -> int:
    """2 of an article, 1 of an element that says main content, else 0."""
    name, words = _read(token)
    if name == "article" or "articlebody" in words:
        return 2
    return int(name == "main" or name in ("div", "section", "td") and bool(words & ROOT_WORDS))


def root_of(chains: dict[int, list[tuple[int, str]]], filled: dict[int, list[int]]) -> int:
    """Path of the element that holds the article.

    That is an article that holds a third of the prose, else a main element with half of
    it, else what is reached going down to where no element holds most of the prose.
    """
    mass: dict[int, int] = {0: 0}
    token: dict[int, str] = {0: ""}
    depth: dict[int, int] = {0: 0}
    below: dict[int, set[int]] = {}
    for path, chain in chains.items():
        changing, linked, constant = filled.get(path, (0, 0, 0))
        prose = CHANGING * max(0, changing - linked) + constant
        above, inside, held = 0, False, [0]
        for i, (at, t) in enumerate(chain, 1):
            if no_article(t, inside):
                held = held[: 1 if i == 1 else None]
                prose = 0
                break
            inside = inside or _rank(t) > 0
            token[at], depth[at] = t, i
            below.setdefault(above, set()).add(at)
            held.append(at)
            above = at
        for at in held:
            mass[at] = mass.get(at, 0) + prose
    best = lambda paths: max(paths, key=lambda p: (mass[p], -depth[p], p))
    for rank, share in ((2, ARTICLE), (1, MAIN)):
        found = [p for p in mass if _rank(token[p]) == rank]
        if found and mass[best(found)] >= share * mass[0] and mass[best(found)]:
            return best(found)
    here = 0
    while paths := below.get(here):
        first = best(paths)
        if _read(token[first])[0] not in GOES_DOWN or not mass[first] or mass[first] < DOWN * mass[here]:
            break
        here = first
    return here


def judged(wrapper: Wrapper, template: Template) -> dict:
    """What a page needs of its host: constants, columns, the paths in the root, and which of them are links."""
    chains = {path: wrapper.chain(path) for path in wrapper.filled}
    root = root_of(chains, wrapper.filled)
    region, linked = [], []
    for path, chain in chains.items():
        at = next((i for i, (p, _) in enumerate(chain) if p == root), -1)
        if root and at < 0:
            continue
        if any(no_article(t, root != 0) for _, t in chain[at + 1 :]):
            continue
        region.append(path)
        changing, links, _ = wrapper.filled[path]
        if changing and links > LINKED * changing:
            linked.append(path)
    return {"t": sorted(template.constants), "c": sorted(template.columns), "region": sorted(region), "linked": sorted(linked)}


class Judge:
    """Parses pages by a judged wrapper."""

    def __init__(self, spec: str | None):
        d = json.loads(spec) if spec else {}
        self.template = Template(spec)
        self.region, self.linked = set(d.get("region") or ()), set(d.get("linked") or ())

    def slots(self, top: list) -> list[str]:
        """Raw texts of the page's main slots, in page order."""
        found: list[tuple[bool, str]] = []
        marks: dict[int, tuple[int, bool]] = {}
        for path, _, _, tokens, kids in self.template.walk(top):
            for t, kid in zip(tokens, kids):
                if kid[0] is None and path in self.region and not (t == "#" and path in self.linked):
                    marks[id(kid)] = (len(found), t != "#")
                    found.append((t != "#", kid[1]))
        constant = sum(len(v) for c, v in found if c)
        keep = 2 * constant > sum(len(v) for _, v in found)
        return [kid[1] for kid in texts_in_order(top) if (m := marks.get(id(kid))) and (keep or not m[1])]


def texts_in_order(top: list) -> Iterator[list]:
    todo = [top]
    while todo:
        here = todo.pop()
        if here[0] is None:
            yield here
        else:
            todo.extend(reversed(here[2]))


def alone(page: str | None) -> Judge:
    """The judge of a page that is the only one of its host."""
    wrapper, template = Wrapper(), Template(None)
    wrapper.add_page(page, template)
    return Judge(json.dumps(judged(wrapper, template)))


def main_text(page: str | None, judge: Judge | None) -> str:
    """Texts of the main slots: references decoded, white space made one space, blocks joined by one."""
    if not page:
        return ""
    top = tree(page)
    out = judge.slots(top) if judge else []
    if not out and top[2]:  # its host's wrapper has no main slot that this page fills
        out = alone(page).slots(top)
    return " ".join(" ".join(entities.unescape(x) for x in out).split())


# --- Spark ----------------------------------------------------------------------------

PARTIAL = "host string, part int, wrapper string"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


COUNTS = "host string, kind int, path long, item long, n long, lo long, hi long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict = {}

    def sent() -> pa.RecordBatch:
        keys = list(counts)
        cols = [[k[0] for k in keys], [k[1] for k in keys], [_signed(k[2]) for k in keys], [_signed(k[3]) for k in keys], *([counts[k][i] for k in keys] for i in range(3))]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["host", "kind", "path", "item", "n", "lo", "hi"])

    for batch in parts(batches):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            count_page(page, counts, host)
            if len(counts) > ENTRIES:
                yield sent()
                counts.clear()
    yield sent()


def templates(pages: DataFrame, html: str, host: Column, scratch: Scratch) -> DataFrame:
    """(host, spec): the constants and columns of each host that has any."""
    counted = pages.select(host.alias("host"), F.col(html).alias("html")).mapInArrow(_count, COUNTS)
    counted = counted.groupBy("host", "kind", "path", "item").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sure = counted.where((F.col("n") >= EVIDENCE) & (F.col("kind").isin(PATH, PARENT) | (F.col("kind") == TEXT) | ((F.col("lo") == F.col("hi")) & (F.col("lo") > 1))))
    sure = scratch.write(sure, "counts")
    whole = sure.where(F.col("kind").isin(PATH, PARENT)).select("host", "path", (F.col("kind") - 1).alias("kind"), F.col("n").alias("of"))
    some = sure.where(F.col("kind").isin(TEXT, BROTHERS)).join(whole, ["host", "path", "kind"])
    some = some.where(F.when(F.col("kind") == TEXT, F.col("n") >= SHARE * F.col("of")).otherwise(F.col("n") == F.col("of")))
    # At a path no more constants hold than twice the texts of a page there, so a host's spec is no larger than a few of its pages.
    each = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("item"))))
    spec = F.to_json(F.struct(each(TEXT).alias("t"), each(BROTHERS).alias("c")))
    return some.groupBy("host").agg(spec.alias("spec"))


@lru_cache(maxsize=2_000)
def _template(spec: str | None) -> Template:
    t = Template(spec)
    t.constants, t.columns = ({x & ((1 << 64) - 1) for x in s} for s in (t.constants, t.columns))
    return t


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    found: dict[str, Wrapper] = {}
    first, entries, part = "", 0, 0
    for batch in parts(batches):
        for host, page, spec in zip(*(c.to_pylist() for c in batch.columns)):
            if not first:  # tasks are told apart by what they read first, which a repeated task reads again
                first = f"{host} {page}"
                part = zlib.crc32(first.encode("utf-8", "replace")) % FAN
            w = found.setdefault(host, Wrapper())
            before = len(w.levels)
            w.add_page(page, _template(spec))
            entries += 1 + len(w.levels) - before
        if entries > ENTRIES:
            yield _sent(found, part)
            found, entries = {}, 0
    yield _sent(found, part)


def _sent(found: dict[str, Wrapper], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([json.dumps(w.kept()) for w in found.values()], pa.string())], names=["host", "part", "wrapper"])


def _merge(table: pa.Table) -> pa.Table:
    found: dict[str, Wrapper] = {}
    for host, _, wrapper in sorted(zip(*(table.column(c).to_pylist() for c in ("host", "part", "wrapper"))), key=lambda r: (r[0], len(r[2]), r[2])):
        found.setdefault(host, Wrapper()).merge(Wrapper(json.loads(wrapper)))
    return pa.Table.from_batches([_sent(found, 0)])


def infer(pages: DataFrame, html: str, host: Column, specs: DataFrame) -> DataFrame:
    """(host, wrapper): the expression of each host, from all of its pages."""
    have = meet_hosts(pages.select(host.alias("host"), F.col(html).alias("html")), specs, "host")
    partial = have.select("host", "html", "spec").mapInArrow(_grow, PARTIAL)
    return partial.groupBy("host", "part").applyInArrow(_merge, PARTIAL).groupBy("host").applyInArrow(_merge, PARTIAL).select("host", "wrapper")


def meet_hosts(pages: DataFrame, table: DataFrame, host: str) -> DataFrame:
    """pages with the row of their host, if there is one; ``table`` is (host, one text) and written.

    It is broadcast if its bytes are few; else both sides meet by host and salt.
    """
    value = next(c for c in table.columns if c != host)
    size = table.agg(F.sum(F.octet_length(host) + F.octet_length(value) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(table), host, "left")
    p = free_prefix(pages)
    salted = table.withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))))
    return pages.withColumn(f"{p}salt", F.floor(F.rand(7) * FAN).cast("int")).join(salted, [host, f"{p}salt"], "left").drop(f"{p}salt")


def _judge(wrappers: pa.Array, specs: pa.Array) -> pa.Array:
    return pa.array([json.dumps(judged(Wrapper(json.loads(w)), _template(s))) for w, s in zip(wrappers.to_pylist(), specs.to_pylist())], pa.string())


judge_wrappers = F.arrow_udf(_judge, T.StringType())


def _texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    judges: dict[str | None, Judge] = {}
    for pages, specs in parts(batches):
        out = []
        for page, spec in zip(pages.to_pylist(), specs.to_pylist()):
            if spec not in judges:
                if len(judges) > 2_000:
                    judges.clear()
                judges[spec] = Judge(spec)
            out.append(main_text(page, judges[spec]))
        yield pa.array(out, pa.string())


texts_by_wrapper = F.arrow_udf(_texts, T.StringType()).asNondeterministic()


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text") -> DataFrame:
    """pages with the main text in ``out``."""
    p = free_prefix(pages)
    spark = pages.sparkSession
    scratch = Scratch(spark)
    specs = scratch.write(templates(pages, html, host_of(F.col(url)), scratch), "templates")
    wrappers = scratch.write(infer(pages, html, host_of(F.col(url)), specs), "wrappers")
    judges = wrappers.join(specs, "host", "left").select(F.col("host").alias(f"{p}host"), judge_wrappers("wrapper", "spec").alias(f"{p}judge"))
    judges = scratch.write(judges, "judges")
    for name in ("counts", "templates", "wrappers"):
        scratch.drop(name)
    joined = meet_hosts(pages.withColumn(f"{p}host", host_of(F.col(url))), judges, f"{p}host")
    text = texts_by_wrapper(F.col(html), F.col(f"{p}judge")).alias(out)
    return joined.select(*[c for c in pages.columns if c != out], text)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
