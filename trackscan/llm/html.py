"""Main text of web pages by equivalence-class template deduction (operator 9).

Tokens are block elements, each with its whole path from the root, and text blocks with their element. The
occurrence vector of a token over the pages of its host is summed up in one number, the exclusive or over
pages of a hash of page content and count: equal vectors have equal sums and sums of parts combine, so no
host is gathered in one task. Frequent tokens of equal vectors below one place are an equivalence class,
which nests in the class of that place; the classes of a host are its template.

The template alone says what a page's text is. Elements that stand once on each page that has them part a
page into slots; elements that repeat are records of the slot around them. A text block that is frequent
itself is template text. The main slots are those below elements that the template marks as the article or,
without such marks, below the lowest element around every slot that holds a heading or running text that
varies. Slots whose element names one of the kinds that aren't main text (menu, advert, comments, ...) are
left out, unless they hold most of the host's text. What a page has in elements that the template doesn't
know belongs to the slot around them. Equal pages of a host count once, so copies of a page make no template.

Defined results: null and empty pages have empty text; a null or unparsable url is a host of its own; a host
of one or two pages has its elements as template and no template text; a page that holds none of its host's
main slots keeps all text outside the slots left out; equal pages and repeated rows get equal text; very long
pages are read whole; broken markup never fails; columns of any name beside url and html are kept; an empty
table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.llm.common import fresh, materialize

#: Pages that make a token frequent: so many (or all, where a host has fewer), and this share of the host's.
LEAST_PAGES, TAG_SUPPORT, TEXT_SUPPORT = 3, 0.05, 0.5
#: Distinct tokens that a task sums up before it sends them on.
HELD = 400_000

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead title tr ul""".split()
)
ENDS_P = BLOCK - {"body", "head", "html", "title", "caption", "option", "optgroup", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block elements that hold text rather than other blocks.
LEAVES = HEADINGS | frozenset("p li dt dd td th pre blockquote caption figcaption summary legend address center".split())
#: An open tag closes these open ones, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
#: Elements, and ARIA roles, that by the standard hold no main text.
OUT = frozenset(
    """nav footer aside form script style noscript template iframe button select textarea svg canvas object audio video dialog menu
    head title input option datalist search""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id of a template element that name a kind of slot without main text.
KINDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notices popup modal overlay paywall comment comments respond reply replies disqus
    sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar toolbar footer
    newsletter subscribe signup login signin searchform""".split()
)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME_PARTS = re.compile(r"[^a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none")


def _digest(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"), 9) >> 1


@lru_cache(1 << 16)
def _label(name: str, raw: str) -> str:
    """An element's name with what its attributes say: class, id, role, whether it is hidden."""
    found = name
    for key, value in ATTRIBUTE.findall(raw):
        key = key.lower()
        value = (value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value).strip().lower()
        if key in ("class", "id"):
            found += ("." if key == "class" else "#") + " ".join(value.split())
        elif key == "role" or (key == "itemprop" and value == "articlebody"):
            found += f"@{value}"
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
            found += "@hidden"
    return found


@lru_cache(1 << 16)
def _kind(label: str) -> tuple[bool, bool, bool]:
    """(no main text by the standard, holds the article, names a kind of slot without main text) of a label."""
    name = re.split("[.#@]", label, maxsplit=1)[0]
    said = set(re.findall(r"@([^.#@]*)", label))
    out = name in OUT or bool(said & ROLES) or ("hidden" in said and name not in ("html", "body"))
    names = [[w for w in NAME_PARTS.split(x) if w] for x in " ".join(re.findall(r"[.#]([^.#@]*)", label)).split()]
    names = [x for x in names if x]
    main = name in ("article", "main") or bool(said & {"main", "article", "articlebody"}) or any({"articlebody", "maincontent"} & set(x) for x in names)
    modified = {"has", "no", "with", "without", "content", "body"}
    named = name not in ("html", "body") and any((x[0] in KINDS or x[-1] in KINDS) and x[0] not in modified for x in names)
    return out, main, named and not main


class Page:
    """tokens, parents and labels of block elements (0 is the root), and blocks (element, text, link characters).

    White space inside a block is one space; blocks without text are left out. Elements that by the standard
    hold no main text are listed; what is in them is not.
    """

    __slots__ = ("tokens", "parents", "labels", "blocks")

    def __init__(self) -> None:
        self.tokens, self.parents, self.labels = [0], [-1], [""]
        self.blocks: list[tuple[int, str, int]] = []


_tokens: dict[tuple[int, str], int] = {}


def _token(parent: int, label: str) -> int:
    """The token of an element below that of its parent, so that it stands for the whole path."""
    found = _tokens.get((parent, label))
    if found is None:
        if len(_tokens) > 200_000:
            _tokens.clear()
        found = _tokens[parent, label] = _digest(str(parent), label)
    return found


def parse(page: str) -> Page:
    made = Page()
    tokens, parents, labels, blocks = made.tokens, made.parents, made.labels, made.blocks
    # open elements: name, block element around or at it, whether no main text, whether inside the article
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    held: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                blocks.append((stack[-1][1], text, min(linked, len(text))))
            held.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            links -= stack.pop()[0] == "a"

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        top = stack[-1]
        if name is None:
            text = m.group()
            if text[:2] in ("<!", "<?") or top[2]:
                continue
            held.append(text)
            if links:
                linked += len(text.strip())
            continue
        name = name.lower()
        block = name in BLOCK
        if block:
            flush()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                # an inline end tag doesn't reach beyond its block
                if not block and stack[i][0] in BLOCK:
                    break
            continue
        raw = m.group(3)
        if block:
            if name in ENDS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
            closes = CLOSES.get(name)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes[1]:
                        break
                    if stack[i][0] in closes[0]:
                        pop(i)
            top = stack[-1]
        if name in VOID or (raw.endswith("/") and not block):
            if name in ("br", "hr", "img", "input") and held:
                held.append(" ")
            continue
        if name in RAW:
            close = _closing(name).search(page, at)
            at = close.end() if close else end
            continue
        label = _label(name, raw) if raw else name
        out, main, _ = _kind(label)
        out = out or (name == "header" and not top[3])
        here = top[1]
        if block and not top[2]:
            here = len(tokens)
            tokens.append(_token(tokens[top[1]], label))
            parents.append(top[1])
            labels.append(label)
        stack.append((name, here, top[2] or out, top[3] or main))
        links += name == "a"
    flush()
    return made


@lru_cache(64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m.group(1).lower().removeprefix("www.") if m else f"\x00{url or ''}"


def _host(url: str) -> Column:
    def hosts(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    return F.pandas_udf(hosts, "string")(F.coalesce(F.col(url).cast("string"), F.lit("")))


def distinct_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """u and h, url and content, of each page, of equal pages of a host one; only such pages are dealt by content."""
    keyed = pages.select(F.col(url).cast("string").alias("u"), F.col(html).alias("h"), _host(url).alias("host"), F.xxhash64(F.coalesce(F.col(html), F.lit(""))).alias("digest"))
    several = materialize(keyed.groupBy("host", "digest").agg(F.count("*").alias("n")).where("n > 1").select("host", "digest"), "html-copies")
    copies = keyed.join(several, ["host", "digest"], "left_semi").groupBy("host", "digest").agg(F.first("u").alias("u"), F.first("h").alias("h"))
    return keyed.join(several, ["host", "digest"], "left_anti").select("u", "h").unionByName(copies.select("u", "h"))


#: Kinds of rows of `occurrences`.
PAGES, TAG, TEXT = 0, 1, 2
FIELDS = (("kind", "int"), ("parent", "bigint"), ("label", "string"), ("pages", "bigint"), ("total", "bigint"), ("vector", "bigint"), ("chars", "bigint"), ("links", "bigint"), ("heads", "bigint"))


def page_rows(page: str) -> dict[int, list]:
    """token: [kind, parent, label, 1, count, vector term, characters, link characters, headings] of one page.

    Characters, links and headings are those of whole elements, what they hold included.
    """
    made = parse(page)
    n = len(made.tokens)
    chars, links, heads = [0] * n, [0] * n, [0] * n
    found: dict[int, list] = {}
    for element, text, linked in made.blocks:
        chars[element] += len(text)
        links[element] += linked
        heads[element] += made.labels[element][:2] in HEADINGS
        token = _digest(str(made.tokens[element]), "", text)
        own = found.setdefault(token, [TEXT, made.tokens[element], "", 1, 0, 0, 0, 0, 0])
        own[4] += 1
        own[6] += len(text)
        own[7] += linked
    for i in range(n - 1, -1, -1):
        up = made.parents[i]
        if up >= 0:
            chars[up] += chars[i]
            links[up] += links[i]
            heads[up] += heads[i]
            own = found.setdefault(made.tokens[i], [TAG, made.tokens[up], made.labels[i], 1, 0, 0, 0, 0, 0])
            own[4] += 1
            own[6] += chars[i]
            own[7] += links[i]
            own[8] += heads[i]
    found[0] = [PAGES, 0, "", 1, 1, 0, chars[0], links[0], heads[0]]
    salt = _digest(page)
    for own in found.values():
        # exclusive or of such terms stands for the whole vector
        own[5] = xxhash.xxh64_intdigest(f"{salt}:{own[4]}") >> 1
    return found


def occurrences(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, token and FIELDS: what the tokens of each host add up to over its distinct pages.

    Tasks add up what they hold; what they send on is added up by an aggregate.
    """
    source = distinct_pages(pages, url, html)
    schema = "host string, token bigint, " + ", ".join(f"{name} {kind}" for name, kind in FIELDS)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*((h, t, *v) for (h, t), v in held.items())))
            kinds = [pa.string(), pa.int64(), *(arrow[kind] for _, kind in FIELDS)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "token", *(name for name, _ in FIELDS)])

        for batch in batches:
            for u, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(u)
                for token, row in page_rows(page or "").items():
                    own = held.setdefault((host, token), row)
                    if own is not row:
                        for i in (3, 4, 6, 7, 8):
                            own[i] += row[i]
                        own[5] ^= row[5]
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    sums = {name: F.first(name) for name in ("kind", "parent", "label")} | {"vector": F.bit_xor("vector")} | {name: F.sum(name) for name in ("pages", "total", "chars", "links", "heads")}
    return source.mapInArrow(work, schema).groupBy("host", "token").agg(*(sums[name].alias(name) for name, _ in FIELDS))


def frequent(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The rows of `occurrences` that are frequent on their host, with host_pages.

    An element is frequent with its support alone, so a host has at most 1 / TAG_SUPPORT times as many as a
    page of it has elements on average, and 1 / TEXT_SUPPORT as many texts.
    """
    # most text blocks stand on one page alone: they go before anything meets by host
    every = materialize(occurrences(pages, url, html).where((F.col("kind") != TEXT) | (F.col("pages") >= LEAST_PAGES)), "html-tokens")
    hosts = materialize(every.where(F.col("kind") == PAGES).select("host", F.col("pages").alias("host_pages")), "html-hosts")
    n, least = F.col("host_pages"), F.lit(LEAST_PAGES)
    support = F.when(F.col("kind") == TAG, F.greatest(F.least(least, n), F.ceil(n * TAG_SUPPORT))).otherwise(F.greatest(least, F.ceil(n * TEXT_SUPPORT)))
    return every.join(hosts, "host").where((F.col("kind") == PAGES) | (F.col("pages") >= support))


ROLE = "host string, class bigint, kind int, label string, token bigint, above bigint, pages bigint, total bigint, class_size int, parent bigint, role string"
#: Roles in a template: a main slot begins, a slot without main text begins, template text, neither.
ENTER, LEAVE, FIXED, INNER = "enter", "leave", "fixed", "inner"


def deduce(rows: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from its frequent tokens: class, parent class and role of each."""
    tags = {int(r.token): r for r in rows.itertuples(index=False) if r.kind == TAG}
    texts = [r for r in rows.itertuples(index=False) if r.kind == TEXT]
    host = next(iter(rows["host"]))
    root = next((r for r in rows.itertuples(index=False) if r.kind == PAGES), None)
    whole = int(root.chars) if root is not None else 0
    order: list[int] = []
    children: dict[int, list[int]] = {}
    for token, r in tags.items():
        children.setdefault(int(r.parent), []).append(token)
    todo = [0]
    while todo:
        at = todo.pop()
        below = sorted(children.get(at, ()))
        order += below
        todo += below
    # classes: equal vectors below one place, which is the nearest element around them of another vector
    place = {0: 0}
    for t in order:
        up = int(tags[t].parent)
        place[t] = place[up] if up and tags[up].vector == tags[t].vector else up
    members: dict[tuple[int, int], list[int]] = {}
    for t in order:
        members.setdefault((int(tags[t].vector), place[t]), []).append(t)
    text_class = {}
    for r in texts:
        up = int(r.parent)
        same = up in tags and tags[up].vector == r.vector
        key = (int(r.vector), place[up] if same else up)
        text_class[int(r.token)] = key
        members.setdefault(key, []).append(int(r.token))
    number = {key: min(own) for key, own in members.items()}
    class_of = {t: number[int(tags[t].vector), place[t]] for t in order}

    fixed: dict[int, int] = {}
    for r in texts:
        fixed[int(r.parent)] = fixed.get(int(r.parent), 0) + int(r.chars) - int(r.links)
    # slots: elements that stand once on every page that has them, all around them too; others are records in a slot
    single, slot, out = {0: True}, {0: 0}, {0: False}
    varied, heads = {0: whole - (int(root.links) if root is not None else 0)}, {0: int(root.heads) if root is not None else 0}
    inside_main = {0: False}
    for t in order:
        r = tags[t]
        up = int(r.parent)
        standard, main, named = _kind(r.label)
        name = re.split("[.#@]", r.label, maxsplit=1)[0]
        single[t] = single[up] and r.total == r.pages
        slot[t] = t if single[t] else slot[up]
        out[t] = out[up] or standard or (name == "header" and not inside_main[up]) or (named and int(r.chars) * 2 <= whole)
        inside_main[t] = inside_main[up] or main
        varied[t] = int(r.chars) - int(r.links)
        heads[t] = int(r.heads)
    marked = {t for t in order if _kind(tags[t].label)[1] and not out[t] and single[t]} or {t for t in order if _kind(tags[t].label)[1] and not out[t]}
    kept = {0: not marked}
    if marked:
        for t in order:
            kept[t] = (kept[int(tags[t].parent)] or t in marked) and not out[t]
    else:
        # a slot's own text: what its slots within don't hold, template text aside
        own, own_heads = {0: varied[0] - fixed.get(0, 0), **{t: 0 for t in order}}, {0: heads[0], **{t: 0 for t in order}}
        for t in order:
            if slot[t] == t:
                up = slot[int(tags[t].parent)]
                own[t] += varied[t]
                own_heads[t] += heads[t]
                own[up] -= varied[t]
                own_heads[up] -= heads[t]
            elif out[t] and not out[int(tags[t].parent)]:
                own[slot[t]] -= varied[t]
                own_heads[slot[t]] -= heads[t]
            if t in fixed:
                own[slot[t]] -= fixed[t]
        firm = [t for t in [0, *order] if slot.get(t) == t and not out[t] and (own[t] > 0 or own_heads[t] > 0)]

        def chain(t: int) -> list[int]:
            steps = []
            while t:
                steps.append(t)
                t = int(tags[t].parent)
            return [0, *reversed(steps)]

        def around(t: int) -> list[int]:
            steps = chain(t)
            while len(steps) > 1 and re.split("[.#@]", tags[steps[-1]].label, maxsplit=1)[0] in LEAVES:
                steps.pop()
            return steps

        ways = [around(t) for t in firm]
        common = 0
        if ways:
            first, last = min(ways), max(ways)
            same = next((i for i, (x, y) in enumerate(zip(first, last)) if x != y), min(len(first), len(last)))
            common = first[same - 1]
        kept = {0: common == 0}
        for t in order:
            kept[t] = (kept[int(tags[t].parent)] or t == common) and not out[t]
    made = []
    for t in order:
        r = tags[t]
        up = int(r.parent)
        role = ENTER if kept[t] and not kept[up] else LEAVE if out[t] and not out[up] else INNER
        key = (int(r.vector), place[t])
        made.append((host, number[key], TAG, r.label, t, up, r.pages, r.total, len(members[key]), class_of.get(place[t], 0), role))
    for r in texts:
        key = text_class[int(r.token)]
        made.append((host, number[key], TEXT, "", int(r.token), int(r.parent), r.pages, r.total, len(members[key]), class_of.get(key[1], 0), FIXED))
    if kept[0]:
        made.append((host, 0, PAGES, "", 0, 0, root.pages if root is not None else 0, root.pages if root is not None else 0, 1, 0, ENTER))
    return pd.DataFrame(made, columns=[c.split()[0] for c in ROLE.split(", ")])


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The templates of all hosts (ROLE): token and the one above it, its class, class size and parent class, and its role.

    A class is named by its least token. A host's frequent tokens, bounded by `frequent`, meet in one task.
    """
    return frequent(pages, url, html).groupBy("host").applyInPandas(deduce, ROLE)


def extract_page(page: str, enter: frozenset[int] | set[int], leave: frozenset[int] | set[int], fixed: frozenset[int] | set[int]) -> str:
    """The main text of one page by its host's template; 0 in `enter` is the root."""
    made = parse(page)
    main, rest = [0 in enter] * len(made.tokens), [True] * len(made.tokens)
    met = main[0]
    for i in range(1, len(made.tokens)):
        token, up = made.tokens[i], made.parents[i]
        gone = token in leave
        main[i] = (main[up] or token in enter) and not gone
        rest[i] = rest[up] and not gone
        met = met or token in enter
    keep = main if met else rest
    return "\n".join(text for element, text, _ in made.blocks if keep[element] and _digest(str(made.tokens[element]), "", text) not in fixed)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with `text`, the main text of each; a column of that name is replaced.

    Of a template only the tokens where roles begin and the template texts are joined, as lists of a host.
    """
    role = F.col("role")
    rows = templates(pages, url, html).where(role != INNER).groupBy("host").agg(*(F.collect_set(F.when(role == r, F.col("token"))).alias(r) for r in (ENTER, LEAVE, FIXED)))
    found = materialize(rows, "html-templates")
    host, own = fresh(pages, 2)
    packed = found.select(F.col("host").alias(host), F.struct(ENTER, LEAVE, FIXED).alias(own))
    joined = pages.withColumn(host, _host(url)).join(packed, host, "left")

    def run(page: pd.Series, enter: pd.Series, leave: pd.Series, fixed: pd.Series) -> pd.Series:
        sets = ([frozenset(() if x is None else np.asarray(x).tolist()) for x in c] for c in (enter, leave, fixed))
        return pd.Series([extract_page(p or "", *own) for p, own in zip(page, zip(*sets))], dtype=object)

    text = F.pandas_udf(run, "string")(F.col(html), *(F.col(own)[r] for r in (ENTER, LEAVE, FIXED)))
    return joined.withColumn("text", text).drop(host, own)


def query(pages: DataFrame) -> DataFrame:
    done = extract(pages.select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
