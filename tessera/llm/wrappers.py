"""HTML extraction with wrappers: union-free regular expressions inferred from pages of one host.

A page's token stream (tags and text slots) becomes an expression: runs of
equal siblings and repeated groups collapse into ``(...)+``.  Expressions of
pages of the same host are aligned one after the other; a mismatch becomes an
optional part, a text that differs a slot, a text that never differs (compared
whole) stays a constant.  The result, the host's wrapper, says where the main text lies:
below its article (or main) elements, else in its content elements, else in
every slot that is not boilerplate.  Names of boilerplate do not hide an
element that is or holds the main text.  Pages are then read along the wrapper.
A constant is boilerplate from three different pages on (copies are one page),
unless a page has nothing else.

Each task folds the expressions of its pages into one wrapper per host, and
the partial wrappers are aligned again in two rounds, salted first, so that a
hot host costs no task more than a bounded share.  Wrappers, not pages, are
shuffled.  They are broadcast if their checked size is small; otherwise pages
join them on host and a salt.

Edge cases: NULL or empty html has no text; a url without a host shares the
wrapper of all such urls; elements nested deeper than ``DEPTH`` count as part
of the element at that depth; repeated rows are read each; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.urls import split_url

DEPTH = 40
SALTS = 32
HOSTS_HELD = 2_000          # wrappers a task folds before it passes them on
BROADCAST_BYTES = 16 << 20
CONSTANT_PAGES = 3          # different pages a text must be equal on to count as boilerplate
PLAIN_CHARS = 40            # of a text that stands for itself; a longer one goes by 128 bits of it

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu head".split())
CONTENT = ("article", "main")
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus"
    " footer header menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo"
    " related respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget widgets".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
WRAP_WORDS = frozenset("container layout outer wrap wrapper".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""[\s"'](?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_CLOSED_BY_BLOCK = frozenset(["p"])


def signature(tag: str, attributes: str) -> str:
    """Element name and its class, id and role words without digits."""
    words = {w for m in _NAMES.finditer(" " + attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower())}
    return ".".join([tag, *sorted(words - {""})]) if words else tag


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("open", signature), ("close", tag), ("void", tag) and ("text", raw) of a page; scripts and comments are gone.

    Inline elements are markup inside a text and give no token.
    """
    at = begin = 0
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            break
        if m.start() > begin:
            yield "text", page[begin:m.start()]
        closing, tag = (m[1], m[2]) if m[2] else (m[4], m[5])
        at = begin = m.end()
        if not tag:
            continue
        tag = tag.lower()
        rest = (m[3] if m[2] else m[6]) or ""
        if tag in RAW and not closing:
            if not rest.endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = begin = end.end() if end else n
        elif tag in INLINE:
            continue
        elif tag in VOID:
            yield "void", tag
        elif closing:
            yield "close", tag
        else:
            yield "open", signature(tag, rest)
    if begin < n:
        yield "text", page[begin:]


class Reader:
    """Walks a page's tokens with the stack of open elements."""

    def __init__(self):
        self.path: list[str] = []
        self.hidden = 0               # elements beyond DEPTH that are open

    def open(self, sig: str) -> list[str]:
        """Enter an element; the signatures that this closes."""
        closed = self.close("p") if self._open_p() else []
        tag = sig.split(".", 1)[0]
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            closed += self._close_sibling(tag)
        if len(self.path) >= DEPTH:
            self.hidden += 1
        else:
            self.path.append(sig)
        return closed

    def _open_p(self) -> bool:
        return bool(self.path) and self.path[-1].split(".", 1)[0] == "p"

    def _close_sibling(self, tag: str) -> list[str]:
        own = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
        if self.path and self.path[-1].split(".", 1)[0] in own:
            return [self.path.pop()]
        return []

    def close(self, tag: str) -> list[str]:
        """Leave the innermost open element of this name, with all inside; the signatures closed."""
        if self.hidden:
            self.hidden -= 1
            return []
        for i in range(len(self.path) - 1, -1, -1):
            if self.path[i].split(".", 1)[0] == tag:
                closed = self.path[i:][::-1]
                del self.path[i:]
                return closed
        return []


# ---- expressions: [signature, flag, children]; flag "" once, "?" optional, "+" repeated, "*" both.
# A text is ["#", flag, name]: a constant, or a slot if its name is None.

_FLAGS = {"": 0, "?": 1, "+": 2, "*": 3}
_NAMED = ["", "?", "+", "*"]


def _flag(*flags: str) -> str:
    both = 0
    for f in flags:
        both |= _FLAGS[f]
    return _NAMED[both]


def merge(a: list, b: list) -> list:
    """The expression that fits what ``a`` or ``b`` fits; of equal signature."""
    flag = _flag(a[1], b[1])
    if a[0] == "#":
        return ["#", flag, a[2] if a[2] == b[2] else None]
    return [a[0], flag, align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """Two sequences of expressions as one: common parts merged, the others optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    if n * m > 250_000:           # long irregular sequences: match in order, greedily
        places: dict[str, list[int]] = {}
        for j, y in enumerate(b):
            places.setdefault(y[0], []).append(j)
        pairs, low = [], 0
        for i, x in enumerate(a):
            j = next((j for j in places.get(x[0], ()) if j >= low), None)
            if j is not None and j - low < 50:
                pairs.append((i, j))
                low = j + 1
    else:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = (best[i + 1][j + 1] + 1 if a[i][0] == b[j][0]
                              else max(best[i + 1][j], best[i][j + 1]))
        pairs, i, j = [], 0, 0
        while i < n and j < m:
            if a[i][0] == b[j][0]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    out, i, j = [], 0, 0
    for x, y in [*pairs, (n, m)]:
        out += [[e[0], _flag(e[1], "?"), e[2]] for e in (*a[i:x], *b[j:y])]
        if x < n:
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def fold(children: list) -> list:
    """Runs of equal siblings, and of groups of up to four, as one repeated expression."""
    for size in (1, 2, 3, 4):
        out: list = []
        i = 0
        while i < len(children):
            group = children[i:i + size]
            names = [g[0] for g in group]
            k = i + size
            while len(group) == size and [g[0] for g in children[k:k + size]] == names:
                group = [merge(x, y) for x, y in zip(group, children[k:k + size])]
                k += size
            if k > i + size:
                if size == 1:
                    out.append([group[0][0], _flag(group[0][1], "+"), group[0][2]])
                else:
                    out.append(["(" + " ".join(names) + ")", "+", group])
                i = k
            else:
                out.append(children[i])
                i += 1
        children = out
    return children


def name_of(text: str) -> str:
    """What stands for a whole text without blanks at its ends: the text, or a blank and its hash."""
    return text if len(text) <= PLAIN_CHARS else " " + _digest(text)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def expression(page: str) -> list:
    """The page's own expression."""
    return expression_and_kind(page)[0]


def expression_and_kind(page: str) -> tuple[list, str]:
    """The page's own expression, and a hash of all its texts: pages of one kind are copies."""
    reader = Reader()
    levels: list[list] = [[]]
    names: list[str] = []

    def leave(sigs: list[str]) -> None:
        for sig in sigs:
            inner = fold(levels.pop())
            levels[-1].append([sig, "", inner])

    for kind, value in tokens(page):
        if kind == "text":
            text = " ".join(entities.unescape(value).split())
            if text:
                names.append(name_of(text))
                levels[-1].append(["#", "", names[-1]])
        elif kind == "open":
            leave(reader.open(value))
            if not reader.hidden:
                levels.append([])
        elif kind == "close":
            leave(reader.close(value))
    leave(reader.path[::-1])
    return ["", "", fold(levels[0])], _digest("\n".join(names))


# ---- what a wrapper says about the main text


def is_boilerplate(sig: str, inside: bool) -> bool:
    """Menus, notices and the like, by element name or the words of class, id and role."""
    tag = sig.split(".", 1)[0]
    if tag in BOILERPLATE or tag == "header" and not inside:
        return True
    return tag not in CONTENT and named_boilerplate(sig)


def named_boilerplate(sig: str) -> bool:
    tag, *words = sig.split(".")
    return tag not in ("html", "body") and bool(BOILER_WORDS.intersection(words))


def main_paths(wrapper: list, different: int) -> tuple[list[str], list[str], list[str]]:
    """Paths of the elements with the main text, of the texts that are equal on all pages of the host, and of the
    elements around the main text that are no boilerplate in spite of their class, id or role words.

    An element with such words hides its subtree unless it is the main text's element or holds it: an article or
    main element that no other stands clear of such words beside, and that is there once on every page (comments
    and related articles are not), a content element in a content wrap, or whatever is left if nothing stands clear.
    """
    clear: list[list[str]] = [[], [], []]        # article, main and content elements outside of such elements
    steady: list[list[tuple]] = [[], [], []]     # inside, once on every page: path and the elements that hide it
    hidden: list[list[tuple]] = [[], [], []]     # inside
    constants: list[str] = []
    texts = 0                                    # in the clear, not constant

    def walk(node: list, path: str, inside: bool, hiding: tuple[str, ...], once: bool, wraps: bool) -> None:
        nonlocal texts
        for child in node[2]:
            sig = child[0]
            if sig == "#":
                if child[2] is not None and child[1] == "" and different >= CONSTANT_PAGES:
                    if not hiding:
                        constants.append(f"{path}\n{child[2]}")
                else:
                    texts += not hiding
                continue
            here_once = once and child[1] == ""
            if sig.startswith("("):
                walk(child, path, inside, hiding, here_once, wraps)
                continue
            tag, *words = sig.split(".")
            if tag in BOILERPLATE or tag == "header" and not inside:
                continue
            here = f"{path}/{sig}"
            around = (*hiding, here) if named_boilerplate(sig) else hiding
            wrap = wraps and (around == hiding or tag in CONTENT or bool(
                WRAP_WORDS.intersection(words) and CONTENT_WORDS.intersection(words)))
            rank = (0 if tag == "article" else 1 if tag == "main" or "main" in words
                    else 2 if CONTENT_WORDS.intersection(words) else None)
            if rank is not None:
                if not around:
                    if not any(here.startswith(p + "/") for p in clear[rank]):
                        clear[rank].append(here)
                else:
                    # words alone name a menu's or a notice's content too
                    sure = tag in CONTENT or wrap and around == hiding
                    for found in (steady, hidden) if here_once and sure else (hidden,):
                        if not any(here.startswith(p + "/") for p, _ in found[rank]):
                            found[rank].append((here, around))
            walk(child, here, inside or tag == "article", around, here_once, wrap)

    walk(wrapper, "", False, (), True, True)
    for plain, others in zip(clear, steady):
        if plain:
            return plain, constants, []
        if others:
            return [p for p, _ in others], constants, sorted({x for _, around in others for x in around})
    if not texts:
        for others in hidden:
            if others:
                return [p for p, _ in others], constants, sorted({x for _, around in others for x in around})
    return [], constants, []


def extract(page: str, main: list[str], constants: frozenset[str], opened: frozenset[str] = frozenset()) -> str:
    """The main text of a page of a host whose wrapper has these paths."""
    blocks: list[str] = []
    spare: list[str] = []           # for pages without any of the wrapper's main elements
    equal: list[str] = []           # the same with the host's constant texts
    part: list[str] = []
    reader = Reader()
    states = [(False, False, "")]   # inside main, inside boilerplate, path
    wanted = frozenset(main)
    seen = False

    def flush() -> None:
        text = " ".join(entities.unescape("".join(part)).split())
        part.clear()
        inside, boiler, path = states[-1]
        if text and not boiler:
            if inside:
                blocks.append(text)
            elif not seen:
                equal.append(text)
                if f"{path}\n{name_of(text)}" not in constants:
                    spare.append(text)

    for kind, value in tokens(page):
        if kind == "text":
            part.append(value)
        elif kind == "void":
            if value == "hr":
                flush()
            elif value == "br":
                part.append(" ")
        else:
            flush()
            closed = reader.open(value) if kind == "open" else reader.close(value)
            for _ in closed:
                states.pop()
            if kind == "open" and len(states) <= len(reader.path):
                inside, boiler, path = states[-1]
                here = f"{path}/{value}"
                boiler = boiler or here not in opened and is_boilerplate(value, inside)
                inside = inside or here in wanted
                seen = seen or inside and not boiler
                states.append((inside, boiler, here))
    flush()
    return "\n".join(blocks if seen else spare or equal)


# ---- Spark


def _host(url):
    return split_url(url)[0]


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, kinds (of its different pages, ``CONSTANT_PAGES`` at most) and wrapper (JSON) per host, from all its
    pages."""
    def fold_rows(rows) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list[str], list]] = {}
        for host, kinds, wrapper in rows:
            if host in held:
                others, own = held[host]
                held[host] = (sorted({*others, *kinds})[:CONSTANT_PAGES], merge(own, wrapper))
            else:
                held[host] = (list(kinds), wrapper)
            if len(held) > HOSTS_HELD:
                yield packed(held)
                held.clear()
        if held:
            yield packed(held)

    def packed(held) -> pd.DataFrame:
        return pd.DataFrame([(h, k, json.dumps(w, ensure_ascii=False, separators=(",", ":")))
                             for h, (k, w) in held.items()], columns=["host", "kinds", "wrapper"])

    def of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fold_rows((h, [kind], own) for b in batches for h, x in zip(b["host"], b["html"])
                             for own, kind in [expression_and_kind(x)])

    def again(group: pd.DataFrame) -> pd.DataFrame:
        rows = ((h, k, json.loads(w)) for h, k, w in zip(group["host"], group["kinds"], group["wrapper"]))
        return pd.concat(list(fold_rows(rows)))

    schema = "host string, kinds array<string>, wrapper string"
    rows = pages.select(_host(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    partial = rows.where("html <> ''").mapInPandas(of_pages, schema)
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper", F.spark_partition_id()), F.lit(SALTS)))
    first = salted.groupBy("host", "salt").applyInPandas(lambda g: again(g), schema)
    return first.groupBy("host").applyInPandas(lambda g: again(g), schema)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per page."""
    @F.pandas_udf("main array<string>, constants array<string>, opened array<string>")
    def places(wrappers: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        found = [main_paths(json.loads(w), len(k)) for w, k in zip(wrappers, kinds)]
        return pd.DataFrame(found, columns=["main", "constants", "opened"])

    wrappers = infer(pages, url, html).withColumn("at", places("wrapper", "kinds"))
    wrappers = written(wrappers.select(F.col("host").alias("_host"), F.to_json("at").alias("_at")), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("_at") + F.octet_length("_host")), F.lit(0))).first()[0]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        _host(F.col(url)).alias("_host"))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(wrappers), "_host", "left")
    else:
        copies = wrappers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("_salt", salt).join(copies, ["_host", "_salt"], "left")

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, tuple[list, frozenset, frozenset]] = {}
        for htmls, ats in batches:
            out = []
            for page, at in zip(htmls, ats):
                if not page:
                    out.append("")
                    continue
                if at not in known:
                    if len(known) > HOSTS_HELD:
                        known.clear()
                    places = json.loads(at) if at else {}
                    known[at] = (places.get("main") or [], frozenset(places.get("constants") or ()),
                                 frozenset(places.get("opened") or ()))
                out.append(extract(page, *known[at]))
            yield pd.Series(out, dtype=object)

    return joined.select("page_id", "url", read("html", "_at").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
