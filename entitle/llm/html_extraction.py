"""HTML extraction with a site style tree (operator 9)."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.shared import keep, small_batches, split_join, table

#: A branch found on fewer pages of a site says nothing; one of less importance is noise.
LEAST_PAGES, LEAST_IMPORTANCE = 8, 0.3
#: Noise branches (hash and host, under 100 bytes each) that are broadcast; more are joined by host.
BROADCAST_ROWS = 50_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|noscript|template|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|\b(hidden)\b""", re.I)
PART = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
#: A start tag ends an open element of these names.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
#: An end tag or a closing start tag reaches no further out than these.
SCOPES = frozenset("html body table ul ol dl article main section div form nav aside header footer".split())
DROPPED = frozenset("head nav footer aside form button select dialog object canvas menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: Words in a class or id that mark what is not the article.
MARKS = frozenset("ad ads adv advert advertisement adsense adsbygoogle banner sponsor sponsored promo promotion menu nav navbar "
                  "navigation breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social cookie "
                  "cookies consent gdpr notice newsletter subscribe subscription signup popup modal overlay footer "
                  "masthead skip pagination pager toolbar".split())
#: The same for what readers wrote, which never is wrapped around the article.
READERS = frozenset("comment comments commentlist disqus respond replies".split())


class Element(NamedTuple):
    """A start tag: number of the element around it (0 is the page), label of tag and classes, whether its kind marks it as
    no article, whether a layout word in its class or id does."""

    parent: int
    label: str
    kind: bool
    named: bool


class Page(NamedTuple):
    """All elements in page order, the text blocks as (element, text), and the elements that hold the article's anchor: the
    first article or main element, or the first h1 of a page without one."""

    elements: list[Element]
    blocks: list[tuple[int, str]]
    wrappers: set[int]

    def marked(self) -> list[bool]:
        """Elements that are not the article by tag or role, or by the words of their class or id, unless they are wrapped
        around the anchor; and all within."""
        out = [False]
        for k, e in enumerate(self.elements[1:], 1):
            out.append(out[e.parent] or e.kind or (e.named and k not in self.wrappers))
        return out

    def branches(self) -> list[int]:
        """The branch of each element: a hash of the labels from the page down to it."""
        out = [0]
        for e in self.elements[1:]:
            out.append(hash((out[e.parent], _label(e.label))))
        return out

    def texts(self, noise: frozenset[int] | set[int] = frozenset()) -> list[str]:
        """Blocks that are in no marked element and in no branch of ``noise``."""
        gone = self.marked()
        if noise:
            for k, branch in enumerate(self.branches()):
                gone[k] = gone[k] or gone[self.elements[k].parent] or branch in noise
        return [text for k, text in self.blocks if not gone[k]]


def parse(page: str) -> Page:
    """Elements and text blocks of a page. Open elements are kept on a stack: a p ends where a block begins, an end
    tag closes all within its element. Every step takes constant time but for what it closes, at any depth."""
    elements, blocks = [Element(0, "", False, False)], []
    stack: list[tuple[str, int, bool]] = []  # name, number, whether it or one around it is marked by its kind
    opened: dict[str, int] = {}
    anchor = heading = 0
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((stack[-1][1] if stack else 0, text))

    def close(name: str, through: bool) -> None:
        """Close the innermost open element of this name, unless it is outside the current scope (``through``: wherever)."""
        if not opened.get(name):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                for other, _, _ in stack[k:]:
                    opened[other] -= 1
                del stack[k:]
                return
            if stack[k][0] in SCOPES and not through:
                return

    for m in TOKEN.finditer(page):
        text = m.group("text")
        if text is not None:
            held.append(text)
            continue
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        flush()
        if m.group("end"):
            close(name, name in SCOPES)
            continue
        if name in VOID:
            continue
        for other in CLOSES.get(name, ()) + ("p",):
            close(other, False)
        rest = m.group("rest")
        if rest and rest.rstrip().endswith("/") and name not in SCOPES | {"p"}:
            continue
        label, marks, role, hidden = name, set(), "", False
        for kind, one, two, three, bare in ATTRIBUTE.findall(rest) if rest else ():
            value = (one or two or three).lower()
            if bare:
                hidden = True
            elif kind.lower() == "role":
                role = value
            else:
                marks.update(PART.findall(value))
                label += "." + value if kind.lower() == "class" else ""
        number, around = len(elements), stack[-1][2] if stack else False
        in_article = bool(opened.get("article") or opened.get("main"))
        nameable = name not in ("html", "body", "main")
        by_kind = (hidden or name in DROPPED or role in ROLES or (name == "header" and not in_article)
                   or (nameable and not marks.isdisjoint(READERS)))
        by_name = nameable and not marks.isdisjoint(MARKS)
        elements.append(Element(stack[-1][1] if stack else 0, label + ("!" if by_kind or by_name else ""), by_kind, by_name))
        stack.append((name, number, around or by_kind))
        opened[name] = opened.get(name, 0) + 1
        if not (around or by_kind or by_name):
            if not anchor and (name in ("article", "main") or role == "main"):
                anchor = number
            if not heading and name == "h1":
                heading = number
    flush()
    wrappers, at = set(), anchor or heading
    while at:
        wrappers.add(at)
        at = elements[at].parent
    return Page(elements, blocks, wrappers)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 12)
def _label(label: str) -> int:
    """``_hash`` of a label, which comes back on every page of its site."""
    return _hash(label)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z]+://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0]


BRANCHES = "host string, page_key long, branch long, above long, style long, content long"


def page_branches(page: Page) -> dict[int, tuple[int, int, int]]:
    """Of each branch that holds text: the branch around it, a hash of its children's labels (style) and one of all that
    is in it (content). Elements of one branch count together. Inner elements come first, since they have
    greater numbers than those around them."""
    branch = page.branches()
    style, content = [0] * len(branch), [0] * len(branch)
    for k, text in page.blocks:
        style[k], content[k] = hash((style[k], 1)), hash((content[k], _hash(text)))
    out: dict[int, tuple[int, int, int]] = {}
    for k in range(len(branch) - 1, 0, -1):
        up, label = page.elements[k].parent, page.elements[k].label
        if not content[k]:
            continue
        if label not in ("html", "body"):
            _, s, c = out.get(branch[k], (0, 0, 0))
            out[branch[k]] = branch[up], hash((s, style[k])), hash((c, content[k]))
        style[up], content[up] = hash((style[up], branch[k])), hash((content[up], branch[k], content[k]))
    return out


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each branch of a page: which children it has (style) and what text (content)."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for url, page in zip(batch.column(0), batch.column(1)):
            page = page.as_py() or ""
            found = page_branches(parse(page))
            columns[0] += [host_of(url.as_py())] * len(found)
            columns[1] += [_hash(page)] * len(found)
            columns[2] += found
            for k in range(3):
                columns[3 + k] += [v[k] for v in found.values()]
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         ["host", "page_key", "branch", "above", "style", "content"])


def noise_branches(pages: DataFrame) -> DataFrame:
    """(host, branch) of little importance: the site style tree, one row per outermost node that is noise.

    Nodes of a site's pages with one path of tags and classes are merged, those of marked elements too. Their importance is the
    greater of two entropies over the pages that have them, of styles and of contents, in units of the log of
    the number of pages: 0 if all pages show the same, 1 if all differ. Copies of a page count once.
    """
    rows = pages.select("url", "html").mapInArrow(_branches, BRANCHES).dropDuplicates(["host", "page_key", "branch"])
    rows = rows.withColumn("kind", F.explode(F.array(F.struct(F.lit(0).alias("of"), F.col("style").alias("value")),
                                                     F.struct(F.lit(1).alias("of"), F.col("content").alias("value")))))
    counts = rows.groupBy("host", "branch", "above", "kind").agg(F.count(F.lit(1)).alias("n"))
    m, s = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    entropies = counts.groupBy("host", "branch", "above", "kind.of").agg(m.alias("pages"), (1 - F.try_divide(s, m * F.log(m))).alias("entropy"))
    noise = keep(entropies.groupBy("host", "branch", "above").agg(F.max("entropy").alias("importance"), F.max("pages").alias("pages"))
                 .where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)))
    around = noise.select("host", F.col("branch").alias("above"))
    return noise.join(around, ["host", "above"], "left_anti").select("host", "branch")


def _extract(columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(parse(page.as_py() or "").texts(set(noise.as_py() or ())))
                     for page, noise in zip(batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())],
                                             [*batch.schema.names[2:], "text"])
    return run


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Branches that the site style tree finds of little importance (``noise_branches``) are removed from every page,
    within its article or main element too. What differs from page to page and still is not the article (adverts,
    reader comments), and the noise of sites with few pages, is known by tag, role or the words of its class or
    id, however long it is; a class or id says nothing where the element is wrapped around the article or main element (or, without one,
    the first h1). All other text stays. References are decoded, white space in a block is one space, blocks are lines.

    A null html gives an empty text, a null url belongs to a site of its own; repeated rows give repeated results;
    a very long page is handled in one task, a deeply nested one in linear time. An empty table gives no rows; other columns are not read. Sites
    are summed up by (site, branch, value) in the tasks, so a large site is no group.
    """
    noise = keep(noise_branches(small_batches(pages)))
    by_host = noise.groupBy("host").agg(F.collect_set("branch").alias("noise"))
    host = F.regexp_extract(F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), "^[a-z]+://", ""), "^[^/?#]*", 0)
    rows = pages.select("html", "page_id", "url", host.alias("host"))
    few = noise.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(by_host), "host", "left") if few else split_join(rows, by_host, ["host"], "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("page_id", "url").schema)
    return (rows.select("html", "noise", "page_id", "url").mapInArrow(_extract(2), f"{schema}, text string")
            .withColumn("n_chars", F.char_length("text").cast("long")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
