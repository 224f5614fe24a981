"""Main text of web pages by wrappers inferred for each host.

A page is read as a stream of block tags and text; inline tags melt into the text. A wrapper is a
union-free regular expression over such streams, kept as a tree: a tag (with its class, id and role)
holds a sequence of items; an item may be optional or a repeated group; a text is a literal while
all pages agree on it and a slot once two differ. Pages are aligned with the wrapper so far:
equal neighbours fold into repeated groups, sequences are aligned so that items stand together which
have the same tag and most in common below, what only one side has becomes optional, and differing
texts become slots. Long sequences are parted at anchors first, so that memory stays bounded.
Two wrappers are aligned in the same way, so each task infers wrappers of its own pages and these
are merged by host, first in salted parts, so that a host with a third of all pages is shared out.

With a host's wrapper complete, its items are judged once. With three pages or more its structure
decides: going down from the root, the part that holds most of the text in slots is the main part, if it
neither repeats nor is missing from many pages; constant texts and lists of links in it are frame. Tags
break ties: an article or main element that has its share of this text is believed as it is, and tags of
frames (nav, footer, form ...) are no text. Names of classes count only on hosts of one or two pages,
where there is nothing to compare. A page's text is that of its items that the wrapper holds to be the
article.

Defined cases: null and empty html give an empty text; a null url is a host of its own; pages that
are alone on their host are their own wrapper; repeated rows get equal results; text that is the same
on all pages of a host goes only where no article element is found; broken markup ends as browsers
end it (a block tag closes a paragraph, the end closes all).
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE_BYTES, compact, partitions, table, volume
from .textarrays import packed, unpacked

#: Parts in which the wrappers of one host are merged before they meet: these at least, and one for each 64 MB of pages.
SALTS = 16
#: Cells of the table by which two sequences are aligned, at most.
CELLS = 1 << 18
#: Pages from which on a host's wrapper tells what is constant; share of a part's text below which nothing in it is its main part.
ENOUGH, MAIN = 3, 0.5
#: Open tags beyond which further ones are held to be siblings, as browsers do.
DEEP = 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A tag ends open ones of its right side that are nearest on the stack.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
_OUT = frozenset("head nav footer aside form button select noscript iframe object template svg canvas menu dialog script style title textarea audio video map".split())
_OUT_NAME = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed|s)?|promos?|promotions?|nav|navbar|navigation|menus?|breadcrumbs?|footer|header|masthead|topbar|sidebars?|side|widgets?|related|recommended|recommendations?|share|sharing|social|comments?|commentlist|respond|replies|reply|disqus|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|signup|login|toolbar|pagination|pager|skip|copyright|legal|disclaimer|search|complementary|contentinfo|dialog)(?:[^a-z]|$)"
)
#: Of these names, ones that also stand on what merely holds such parts: not believed of most of a page's text.
_WEAK_NAME = re.compile(r"(?:^|[^a-z])(?:ads?|nav|menus?|footer|header|topbar|sidebars?|side|widgets?|related|share|social|promos?|banners?|search)(?:[^a-z]|$)")
_HEADER = re.compile(r"(?<![a-z])header(?![a-z])")
_MAIN_NAME = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|main|post|entry|story|body)(?:[^a-z]|$)")

# A wrapper item: [sign, optional, repeated, pages, characters, characters in links, literal (see _literal) or None, items].
SIGN, OPTIONAL, REPEATED, PAGES, CHARS, LINKED, LITERAL, ITEMS = range(8)


def _sign(tag: str, attributes: str) -> str:
    names = []
    for m in _ATTRIBUTE.finditer(attributes):
        names += (m[2] or m[3] or m[4] or "").lower().split()
    return tag + "".join("." + re.sub(r"\d+", "0", n) for n in names)


def read(page: str) -> list:
    """The page's own tree: [sign, items]; a text is ["#", text, characters in links]."""
    root: list = ["", []]
    stack, text, linked, links = [root], [], 0, 0

    def flush():
        nonlocal linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                stack[-1][1].append(["#", joined, min(linked, len(joined))])
            text.clear()
            linked = 0

    for m in _TOKEN.finditer(page):
        if m[5] is not None:
            text.append(m[5])
            if links:
                linked += len(m[5].strip())
            continue
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), m[2]
        if tag in _INLINE and not (not closing and m[4] and _OUT_NAME.search(_sign("", m[4]))):
            if closing and any(n[0].split(".")[0] == tag for n in stack[1:]) and stack[-1][0].split(".")[0] == tag:
                flush()
                stack.pop()
            elif tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            text.append("\n")
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0].split(".")[0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in _CLOSE_P:
            links = 0
            if stack[-1][0].split(".")[0] == "p":
                stack.pop()
        ends = _SIBLINGS.get(tag, ())
        while len(stack) > 1 and stack[-1][0].split(".")[0] in ends:
            stack.pop()
        if tag in _VOID:
            continue
        node = [_sign(tag, m[4]) if m[4] else tag, []]
        stack[-1][1].append(node)
        if len(stack) < DEEP and not m[4].endswith("/"):
            stack.append(node)
    flush()
    return root


def _literal(text: str) -> str | list:
    """What stands for a text in a wrapper: itself, or the length and hash of a long one."""
    return text if len(text) <= 200 else [len(text), hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()]


def _item(node: list) -> list:
    """The wrapper of one page's tree, its repeats folded."""
    if node[0] == "#":
        return ["#", 0, 0, 1, len(node[1]), node[2], _literal(node[1]), []]
    return [node[0], 0, 0, 1, 0, 0, None, _folded([_item(x) for x in node[1]])]


def _shape(item: list) -> tuple:
    return (item[SIGN], tuple(x[SIGN] for x in item[ITEMS]))


_LEAVES = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 option blockquote pre #".split())


def _alike(a: list, b: list) -> bool:
    return a[SIGN] == b[SIGN] and (a[SIGN].split(".")[0] in _LEAVES or _shape(a) == _shape(b))


def _folded(items: list, same_page: bool = True) -> list:
    """Neighbours that are alike made one repeated item; those of a wrapper only if one of them repeats already."""
    out: list = []
    for x in items:
        if out and _alike(out[-1], x) and (same_page or out[-1][REPEATED] or x[REPEATED]):
            optional = out[-1][OPTIONAL] & x[OPTIONAL]
            out[-1] = merged(out[-1], x, same_page=True)
            out[-1][REPEATED], out[-1][OPTIONAL] = 1, optional
        else:
            out.append(x)
    return out


def _key(item: list, below: int) -> tuple:
    """What an item is aligned by: its sign, and the signs of what it holds."""
    return item[0], frozenset(x[0] for x in item[below])


def _fit(a: tuple, b: tuple) -> float:
    """How well two items fit each other: 0 if not at all, more the more they have in common below."""
    if a[0] != b[0]:
        return 0.0
    if not a[1] or not b[1]:
        return 1.0 if a[1] == b[1] else 0.25
    return len(a[1] & b[1]) / len(a[1] | b[1]) + 0.25


def _anchors(a: list[tuple], b: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of equal keys that occur once on both sides, as many as rise on both (by patience)."""
    once = lambda x: {k: i for i, k in enumerate(x) if counts[k] == 1}
    counts = Counter(a)
    left = once(a)
    counts = Counter(b)
    pairs = sorted((left[k], j) for k, j in once(b).items() if k in left)
    tops, top_at, back = [], [], []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k : k + 1], top_at[k : k + 1] = [j], [n]
        back.append(top_at[k - 1] if k else -1)
    out, n = [], top_at[-1] if top_at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _aligned(a: list[tuple], b: list[tuple]) -> list[tuple[int | None, int | None]]:
    """Places of two sequences of keys side by side, so that what fits most stands together.

    Sequences are first parted at anchors. What is between is aligned by a table of at most CELLS cells;
    beyond it, by equal keys in turn, which needs no table.
    """
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for x, y in [*(_anchors(a, b) if len(a) * len(b) > CELLS // 16 else []), (len(a), len(b))]:
        out += [(None if p is None else i + p, None if q is None else j + q) for p, q in _between(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def _between(a: list[tuple], b: list[tuple]) -> list[tuple[int | None, int | None]]:
    n, m = len(a), len(b)
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    if n * m > CELLS:
        places: dict[tuple, list[int]] = {}
        for k in range(m - 1, -1, -1):
            places.setdefault(b[k], []).append(k)
        for i in range(n):
            at = places.get(a[i], [])
            while at and at[-1] < j:
                at.pop()
            if at:
                out += [(None, k) for k in range(j, at[-1])] + [(i, at[-1])]
                j = at.pop() + 1
            else:
                out.append((i, None))
        return out + [(None, k) for k in range(j, m)]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, under = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            fit = _fit(a[i], b[j])
            row[j] = max(under[j], row[j + 1], under[j + 1] + fit if fit else 0.0)
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and (fit := _fit(a[i], b[j])) and best[i][j] == best[i + 1][j + 1] + fit:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def merged(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper of all that either of two wrappers of the same tag stands for."""
    x, y = a[ITEMS], b[ITEMS]
    keys = [_key(p, ITEMS) for p in x], [_key(q, ITEMS) for q in y]
    if keys[0] == keys[1]:
        items = [merged(p, q, same_page) for p, q in zip(x, y, strict=True)]
    else:
        items = []
        for i, j in _aligned(*keys):
            if i is not None and j is not None:
                items.append(merged(x[i], y[j], same_page))
            else:
                only = list(x[i] if j is None else y[j])
                only[OPTIONAL] = 1
                items.append(only)
        items = _folded(items, same_page)
    literal = a[LITERAL] if a[LITERAL] == b[LITERAL] else None
    pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    return [a[SIGN], a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED], pages, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], literal, items]


def _mass(item: list) -> tuple[int, int]:
    """Characters and those in links below an item, without what its tags and names rule out."""
    chars, linked = item[CHARS], item[LINKED]
    for x in item[ITEMS]:
        if not _ruled_out(x[SIGN], True):
            c, k = _mass(x)
            chars, linked = chars + c, linked + k
    return chars, linked


def _ruled_out(sign: str, inside: bool) -> bool:
    """Whether an element's tag or names make it no article text; inside one, headers are its own."""
    tag, _, names = sign.partition(".")
    if tag in _OUT or tag == "header" and not inside:
        return True
    return bool(names) and tag not in ("html", "body") and _OUT_NAME.search(_HEADER.sub("", names) if inside else names) is not None


def _spared(wrapper: list) -> list:
    """The wrapper with weak names taken off items that hold most of its text: these hold the page."""
    def raw(item):
        return item[CHARS] + sum(raw(x) for x in item[ITEMS] if x[SIGN].split(".")[0] not in _OUT)

    total = raw(wrapper)

    def spared(item):
        tag, _, names = item[SIGN].partition(".")
        out = list(item)
        if names and tag not in _OUT and _OUT_NAME.search(names) and 2 * raw(item) > total:
            left = ".".join(n for n in names.split(".") if not _WEAK_NAME.search(n))
            out[SIGN] = f"{tag}.{left}" if left else tag
        out[ITEMS] = [spared(x) if 2 * raw(x) > total else x for x in item[ITEMS]]
        return out

    return spared(wrapper)


def _text(item: list) -> int:
    """Characters below an item that speak for an article: those of slots, which differ between pages and are no lists of links."""
    if item[SIGN] == "#":
        constant = item[PAGES] >= ENOUGH and item[LITERAL] is not None
        return 0 if constant or 2 * item[LINKED] > item[CHARS] else item[CHARS]
    return 0 if item[SIGN].split(".")[0] in _OUT else sum(map(_text, item[ITEMS]))


def _main(wrapper: list) -> list:
    """The part of a host's wrapper that holds its text: down from the root as long as one part has most of it.

    Blocks of text are no parts, but pieces of one. A part that repeats is a list (of comments, say), and
    one that many pages lack is an extra: neither is a main part.
    """
    node, pages = wrapper, wrapper[PAGES]
    while True:
        parts = [x for x in node[ITEMS] if x[SIGN] != "#" and x[SIGN].split(".")[0] not in _LEAVES]
        whole = [x for x in parts if not x[REPEATED] and 2 * x[PAGES] > pages] or parts
        best = max(whole, key=_text, default=None)
        if best is None or _text(best) == 0 or _text(best) < MAIN * sum(_text(x) for x in node[ITEMS] if x in whole or x not in parts):
            return node
        node = best


def _elements(wrapper: list, tags: tuple[str, ...]) -> list:
    """Outermost elements of some tags, with text, that no frame's tag holds."""
    out = []

    def search(item):
        for x in item[ITEMS]:
            tag = x[SIGN].split(".")[0]
            if tag in tags:
                if _text(x):
                    out.append(x)
            elif tag not in _OUT:
                search(x)

    search(wrapper)
    return out


def _by_names(wrapper: list) -> list:
    """Of a wrapper without enough pages to compare: the part that its names hold to be the content, or none."""
    found: list[list] = []

    def search(item):
        for x in item[ITEMS]:
            if not _ruled_out(x[SIGN], False):
                tag, _, names = x[SIGN].partition(".")
                if names and tag not in ("html", "body") and _MAIN_NAME.search(names) and _mass(x)[0]:
                    found.append(x)
                search(x)

    search(wrapper)
    most = max((_mass(x)[0] for x in found), default=0)
    if found and most >= 0.5 * _mass(wrapper)[0]:
        return [min((x for x in found if _mass(x)[0] >= 0.8 * most), key=lambda x: _mass(x)[0])]
    return []


def judged(wrapper: list) -> list:
    """[sign, whether its text is the article's, items, whether it repeats] of each item of a wrapper.

    With pages enough, structure decides: the main part holds the article, and in it what is constant
    over all pages and lists of links are no text. An article or main element is believed where it
    has a quarter of that part's text, or holds it. Names decide only where there are too few pages.
    """
    enough = wrapper[PAGES] >= ENOUGH
    signs = wrapper
    wrapper = wrapper if enough else _spared(wrapper)
    articles, mains = _elements(wrapper, ("article",)), _elements(wrapper, ("main",))
    if mains and sum(map(_text, articles)) < 0.4 * max(map(_text, mains)):
        articles = [max(mains, key=_text)]
    articles = [x for x in articles if _text(x) >= 0.25 * max(map(_text, articles))]
    named: list = []
    if enough:
        part = _main(wrapper)
        tagged = bool(articles) and sum(map(_text, articles)) >= 0.25 * _text(part)
        chosen = articles if tagged else [part]
    else:
        tagged = bool(articles)
        named = [] if articles else _by_names(wrapper)
        chosen = articles or named
    own = {id(x) for x in chosen}

    def mark(item, sign, inside, out):
        tag = item[SIGN].split(".")[0]
        if item[SIGN]:
            out = out or (_ruled_out(item[SIGN], inside) if not enough else tag in _OUT or tag == "header" and not inside)
        inside = inside or id(item) in own
        if item[SIGN] == "#":
            if tagged or named:
                good = inside and not out
            else:  # texts that differ and are no lists of links
                constant = item[PAGES] >= ENOUGH and item[LITERAL] is not None
                good = inside and not out and not constant and 2 * item[LINKED] <= item[CHARS]
            return ["#", int(good), [], item[REPEATED]]
        return [sign[SIGN], 0, [mark(x, y, inside, out) for x, y in zip(item[ITEMS], sign[ITEMS], strict=True)], item[REPEATED]]

    return mark(wrapper, signs, not chosen, False)


def extracted(page: list, wrapper: list) -> str:
    """The texts of a page's tree at which its judged wrapper has the article."""
    out: list[str] = []

    def walk(nodes, items):
        # Runs of nodes that are alike stand for one repeated item, as in _folded().
        runs: list[list] = []
        for node in nodes:
            key = ("#", frozenset()) if node[0] == "#" else _key(node, 1)
            if runs and runs[-1][0][0] == key[0] and (key[0].split(".")[0] in _LEAVES or runs[-1][0] == key):
                runs[-1][1].append(node)
            else:
                runs.append([key, [node]])
        known = [_key(x, 2) for x in items]
        keys = [r[0] for r in runs]
        pairs = [(k, k) for k in range(len(keys))] if keys == known else [(i, j) for i, j in _aligned(keys, known) if i is not None]
        for i, j in pairs:
            if j is None:  # a repeated item may stand for several runs
                fits = [(_fit(keys[i], known[k]) + items[k][3], -k) for k in range(len(known)) if known[k][0] == keys[i][0]]
                if not fits:
                    continue  # cannot be: the wrapper stands for all pages of its host
                j = -max(fits)[1]
            for node in runs[i][1]:
                if node[0] != "#":
                    walk(node[1], items[j][2])
                elif items[j][1]:
                    out.append(node[1])

    walk(page[1], wrapper[2])
    return " ".join(out)


def host_of(url: str = "url"):
    """The host a url names, in lower case; of a null url the empty one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _merging(batches):
    """Wrappers merged over runs of equal host and salt."""
    now = wrapper = None
    for b in batches:
        for host, salt, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            new = json.loads(text)
            if (host, salt) == now:
                wrapper = merged(wrapper, new)
                continue
            if now is not None:
                yield pa.record_batch([pa.array([x], t) for x, t in zip((*now, json.dumps(wrapper)), (pa.string(), pa.int32(), pa.string()), strict=True)], ["host", "salt", "wrapper"])
            now, wrapper = (host, salt), new
    if now is not None:
        yield pa.record_batch([pa.array([x], t) for x, t in zip((*now, json.dumps(wrapper)), (pa.string(), pa.int32(), pa.string()), strict=True)], ["host", "salt", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, html) -> (host, wrapper): the judged wrapper of each host, as JSON."""

    def inferred(batches):
        for b in batches:
            by: dict[str, list] = {}
            n = 0
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                new = _item(read(page.as_py() or ""))
                by[host] = merged(by[host], new) if host in by else new
                n += 1
            yield pa.record_batch([pa.array(list(by), pa.string()), pa.array([json.dumps(w) for w in by.values()], pa.string())], ["host", "wrapper"])

    shape = "host string, salt int, wrapper string"
    parts = partitions(pages)
    salts = max(SALTS, min(volume(pages) // FILE_BYTES, 1 << 12))
    found = pages.select("host", F.col("html").cast("string")).mapInArrow(inferred, "host string, wrapper string")
    found = found.select("host", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).cast("int").alias("salt"), "wrapper")
    found = found.repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_merging, shape)
    found = found.withColumn("salt", F.lit(0)).repartition(parts, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_merging, shape)

    def final(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([json.dumps(judged(json.loads(w))) for w in b.column(1).to_pylist()], pa.string())], ["host", "wrapper"])

    return found.select("host", "wrapper").mapInArrow(final, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of().alias("host"))
    known = wrappers(rows.select("host", "html")).select(F.col("host").alias("_host"), "wrapper")
    joined = packed(rows, "html", "frame").join(known, F.col("host") == F.col("_host")).select("page_id", "url", "wrapper", "frame")

    def batches(parts):
        seen: dict[str, list] = {}
        for b in parts:
            wrapper = b.column(2).to_pylist()
            texts = []
            for first, last, raw in unpacked(b.column(3)):
                for w, page in zip(wrapper[first:last], raw, strict=True):
                    if w not in seen:
                        if len(seen) > 1000:
                            seen.clear()
                        seen[w] = json.loads(w)
                    texts.append(extracted(read(page.decode()), seen[w]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(batches, "page_id long, url string, text string")


def op9_wrappers(spark, sf_dir):
    """op9's digest over the whole pages table."""
    pages = table(spark, sf_dir, "pages")
    found = compact(extract(pages), pages)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
