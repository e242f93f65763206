"""Main text of web pages by wrappers inferred per host: union-free regular expressions over token streams.

A page is read as a stream of tags and texts. Its structure, a symbol for each tag (with the classes that tell regions
apart) and one for text, is folded: a group that follows itself becomes a repeated group, inner groups first. The
folded structures of a host's pages are aligned one after the other into one expression: where they differ, what only
one has becomes an optional group, groups that begin alike are aligned inside, and texts are slots. Structures are made
distinct first (after folding a host has few), partial wrappers are made in slices of a host, and these are aligned
into the host's wrapper, so no task holds a host's pages.

Each text slot of the wrapper is judged once, by the region it is in. A page is matched with its host's wrapper, and
the texts that fell into content slots make its text. Where the library's matching takes too long, all ways through the
expression are followed side by side instead, which takes the one it would have taken, in bounded time. For a page whose
wrapper gives no result all the same, ``failure`` says why; its text is what the rule for slots makes of the page alone.

Defined results for odd input: null or empty html gives an empty text; a null or unreadable url is a host of its own;
unclosed, misnested and unknown tags are allowed; rows that repeat are extracted each; an empty table gives no rows;
other columns are not read. Nothing is cut from long pages.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import written

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "iframe", "template", "svg", "select", "object", "canvas", "math")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("head title nav aside footer form button menu dialog label fieldset".split())
CONTENT = ("article", "main")
#: Words in classes, ids and roles that name what surrounds an article.
AROUND = frozenset("ad ads adv advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus feedback footer gdpr header hidden masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promotions recommended related replies reply respond search share sharing sidebar signup site-footer site-header social sponsor sponsored subscribe subscription tags toolbar widget widgets complementary contentinfo alert".split())


def words_of(attributes: str) -> list[str]:
    """The words in class, id and role; a hidden element has the word hidden."""
    found = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() in ("hidden", "aria-hidden", "style"):
            if name.lower() == "hidden" or "true" in value and name.lower() == "aria-hidden" or "display:none" in value.replace(" ", ""):
                found.append("hidden")
        else:
            found += [w for x in value.split() for w in (x, *re.split(r"[-_]+", x))]
    return found


@lru_cache(65536)
def symbol(closing: str, name: str, attributes: str) -> str:
    """A tag as the wrapper sees it: its name, and whether its attributes name a region."""
    name = name.lower()
    if closing:
        return f"/{name}"
    words = words_of(attributes)
    if any(w in AROUND for w in words):
        return f"{name}!"
    return f"{name}*" if "main" in words or "articlebody" in words else name


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """Symbol and text: ``("#", text)`` for text that is not blank, ``(tag, "")`` for tags. What is between the tags of
    scripts, styles and the like is not read as markup, nor returned."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text.strip():
            yield "#", text
        if not m:
            return
        at = m.end()
        if m[2]:
            sym = symbol(m[1], m[2], m[3])
            name = sym.strip("/!*")
            if name in RAW and not m[1]:
                if not m[3].endswith("/"):
                    end = RAW[name].search(page, at)
                    at = end.end() if end else n
                continue
            if not (m[1] and name in VOID):
                yield sym, ""


class Region:
    """Where in the page a token stands; ``kept`` says whether text here is content."""

    def __init__(self, root: str | None) -> None:
        self.root, self.stack = root, []  # (name, whether dropped from here, whether content from here)

    def move(self, sym: str) -> None:
        name = sym.strip("/!*")
        if sym[0] == "/":
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == name:
                    del self.stack[i:]
                    break
            return
        if name in VOID:
            return
        if name == "p" or name in BLOCK:
            if self.stack and self.stack[-1][0] == "p":
                self.stack.pop()
        dropped, inside = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)
        if sym == self.root and not inside:
            dropped, inside = False, True
        elif sym.endswith("!") and name not in ("body", "html") or name in DROPPED or name == "header" and not inside:
            dropped = True
        self.stack.append((name, dropped, inside))

    @property
    def kept(self) -> bool:
        if not self.stack:
            return self.root is None
        return not self.stack[-1][1] and (self.stack[-1][2] or self.root is None)


def root_of(symbols: list[str]) -> str | None:
    """The tag that holds the article, if any does."""
    return next((s for name in CONTENT for s in symbols if s.rstrip("*") == name), None) or next((s for s in symbols if s.endswith("*") and s[0] != "/"), None)


# A structure is a list of items: a symbol, or [mark, items] with mark "+" for a repeated, "?" for an optional group.


def fold(symbols: list) -> list:
    """Groups that follow themselves become repeated groups, short ones first."""
    size = 1
    while size <= min(len(symbols) // 2, 24):
        out, i, changed = [], 0, False
        while i < len(symbols):
            group = symbols[i : i + size]
            j = i + size
            while symbols[j : j + size] == group:
                j += size
            if j > i + size and not (size == 1 and isinstance(group[0], list)):
                out.append(["+", group])
                i, changed = j, True
            elif out and out[-1] == ["+", group]:
                i, changed = i + size, True
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
        size = 1 if changed and size > 1 else size + 1
    return symbols


def key(item: str | list) -> str:
    while isinstance(item, list):
        item = item[1][0]
    return item


def items(item: str | list) -> list:
    return item[1] if isinstance(item, list) else [item]


def aligned(a: list, b: list) -> list:
    """One structure that has both."""
    if a == b:
        return a
    out, keys_a, keys_b = [], [key(x) for x in a], [key(x) for x in b]
    for op, i, j, k, m in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                if x == y:
                    out.append(x)
                else:
                    marks = {z[0] for z in (x, y) if isinstance(z, list)}
                    mark = "*" if marks == {"+", "?"} or "*" in marks else "".join(marks)
                    if isinstance(x, list) or isinstance(y, list):
                        body = aligned(items(x), items(y)) if isinstance(x, list) and isinstance(y, list) else None
                        if body is None:  # a group against the single tag that it begins with: the rest is optional
                            group = items(x) if isinstance(x, list) else items(y)
                            body = [group[0], *([["?", group[1:]]] if len(group) > 1 else [])]
                        out.append([mark or "+", body])
                    else:
                        out.append(x)
        else:
            for run in (a[i:j], b[k:m]):
                if run:
                    out.append(run[0] if len(run) == 1 and isinstance(run[0], list) and run[0][0] in "?*" else ["?", run])
    return out


def structure(page: str) -> list:
    return fold([s for s, _ in tokens(page)])


class Wrapper:
    """A host's expression, compiled over one character for each symbol, with a group for each content slot."""

    def __init__(self, expression: list) -> None:
        flat: list[str] = []
        self._flatten(expression, flat)
        self.code = {s: chr(0xE000 + i) for i, s in enumerate(dict.fromkeys(["#", *flat]))}
        self.root, self.region, self.groups = root_of(flat), None, 0
        self.region = Region(self.root)
        self.program: list[tuple] = []  # (symbol, whether its place is content) or (None, first choice, second choice)
        pattern = self._compiled(expression)
        try:
            self.pattern = regex.compile(pattern, regex.V0)
        except regex.error:  # too large for the library
            self.pattern = None

    def _flatten(self, expression: list, out: list[str]) -> None:
        for x in expression:
            if isinstance(x, list):
                self._flatten(x[1], out)
            else:
                out.append(x)

    def _compiled(self, expression: list) -> str:
        parts = []
        for x in expression:
            if isinstance(x, list):
                before, at = list(self.region.stack), len(self.program)
                if x[0] != "+":
                    self.program.append(())
                body = self._compiled(x[1])
                if x[0] == "+":
                    self.program.append((None, at, len(self.program) + 1))
                else:
                    if x[0] == "*":
                        self.program.append((None, at, at))
                    self.program[at] = (None, at + 1, len(self.program))
                # what a group opens and leaves open doesn't reach beyond it; what a repeated group closes is closed
                self.region.stack = self.region.stack[: len(before)] if x[0] == "+" else before
                parts.append(f"(?:{body}){x[0]}")
            elif x == "#":
                self.groups += self.region.kept
                self.program.append((x, self.region.kept))
                parts.append(f"({self.code['#']})" if self.region.kept else self.code["#"])
            else:
                self.region.move(x)
                self.program.append((x, False))
                parts.append(self.code[x])
        return "".join(parts)

    def content(self, symbols: list[str], seconds: float = 0.25) -> set[int] | None:
        """Places of the texts in content slots, or None where the page does not match."""
        if any(s not in self.code for s in symbols):
            return None
        if self.pattern is None:
            return self.content_by_steps(symbols)
        try:
            m = self.pattern.fullmatch("".join([self.code[s] for s in symbols]), timeout=seconds)
        except TimeoutError:
            return self.content_by_steps(symbols)
        return {a for g in range(1, self.groups + 1) for a, _ in m.spans(g)} if m else None

    def content_by_steps(self, symbols: list[str]) -> set[int] | None:
        """The same, in time of at most the product of the lengths of page and expression: of the ways that have come
        to the same place of the expression only the first in the library's order goes on."""
        program, end = self.program, len(self.program)

        def enter(at: int, kept: tuple | None, ways: list, seen: set[int]) -> None:
            todo = [at]
            while todo:
                at = todo.pop()
                if at in seen:
                    continue
                seen.add(at)
                if at < end and program[at][0] is None:
                    todo += [program[at][2], program[at][1]]
                else:
                    ways.append((at, kept))

        ways: list[tuple[int, tuple | None]] = []
        enter(0, None, ways, set())
        for i, s in enumerate(symbols):
            after, seen = [], set()
            for at, kept in ways:
                if at < end and program[at][0] == s:
                    enter(at + 1, (i, kept) if program[at][1] else kept, after, seen)
            ways = after
        for at, kept in ways:
            if at == end:
                found = set()
                while kept:
                    found.add(kept[0])
                    kept = kept[1]
                return found
        return None


@lru_cache(256)
def compiled(expression: str) -> Wrapper | None:
    """The wrapper of an expression; none where it is too deep."""
    try:
        return Wrapper(json.loads(expression))
    except RecursionError:
        return None


def by_rule(symbols: list[str]) -> set[int]:
    """Places of the texts that the rule for slots keeps on a page alone."""
    region, kept = Region(root_of(symbols)), set()
    for i, s in enumerate(symbols):
        if s == "#":
            if region.kept:
                kept.add(i)
        else:
            region.move(s)
    return kept


def extract(page: str, wrappers_: dict[str, str] | None = None) -> tuple[str, bool]:
    """The page's text, and whether a wrapper gave it."""
    text, failure = extracted(page, wrappers_)
    return text, failure is None


def extracted(page: str, wrappers_: dict[str, str] | None = None) -> tuple[str, str | None]:
    """The page's text, and why no wrapper gave it where none did."""
    stream = list(tokens(page))
    symbols = [s for s, _ in stream]
    expression = (wrappers_ or {}).get(root_of(symbols) or "")
    wrapper = compiled(expression) if expression else None
    kept, failure = wrapper.content(symbols) if wrapper else None, None
    if kept is None:
        failure = "no wrapper" if not expression else "wrapper too deep" if not wrapper else "no match"
        kept = by_rule(symbols)
    blocks, own = [], []
    for i, (s, text) in enumerate(stream):
        if s == "#":
            if i in kept:
                own.append(text)
        elif s.strip("/!*") in BLOCK:
            blocks.append("".join(own))
            own = []
    blocks.append("".join(own))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t), failure


def host(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, slices: int = 16) -> DataFrame:
    """``host, wrappers``: the inferred expressions of each host, as JSON, by the tag that holds the article: pages with
    an article and pages without are of different templates."""

    def structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str, str]] = set()
        for batch in batches:
            new = set()
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                symbols = [s for s, _ in tokens(page.as_py())]
                pair = h, root_of(symbols) or "", json.dumps(fold(symbols), separators=(",", ":"))
                if pair not in seen:
                    new.add(pair)
            seen = seen | new if len(seen) < 20_000 else new
            if new:
                a, b, c = zip(*sorted(new), strict=True)
                yield pa.RecordBatch.from_pydict({"host": pa.array(a, pa.string()), "root": pa.array(b, pa.string()), "structure": pa.array(c, pa.string())})

    def aligned_all(pdf: pd.DataFrame) -> str:
        out = None
        for s in sorted(pdf["structure"], key=lambda x: (-len(x), x)):
            out = json.loads(s) if out is None else aligned(out, json.loads(s))
        return json.dumps(out, separators=(",", ":"))

    def partial(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [k[0]], "root": [k[1]], "structure": [aligned_all(pdf)]})

    def whole(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [k[0]], "root": [k[1]], "wrapper": [aligned_all(pdf)]})

    found = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(structures, "host string, root string, structure string")
    found = found.distinct().withColumn("slice", F.pmod(F.xxhash64("structure"), F.lit(slices)))
    parts = found.groupBy("host", "root", "slice").applyInPandas(partial, "host string, root string, structure string")
    merged = parts.groupBy("host", "root").applyInPandas(whole, "host string, root string, wrapper string")
    return merged.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("root", "wrapper"))).alias("wrappers"))  # an entry for each tag that can hold an article


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, by_wrapper, failure`` for every row of ``pages`` (``page_id, url, html``); ``failure``
    is null where the wrapper gave the text, else why it did not."""
    inferred = written(wrappers(pages), "wrappers").select(F.col("host").alias("_host"), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    rows = rows.join(inferred, rows["host"] == inferred["_host"]).select("page_id", "url", "html", "wrappers")

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extracted(page.as_py(), dict(w)) for page, w in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            texts = [t for t, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([f is None for _, f in got], pa.bool_()), pa.array([f for _, f in got], pa.string())], names=["page_id", "url", "text", "n_chars", "by_wrapper", "failure"])

    return rows.mapInArrow(pull, "page_id long, url string, text string, n_chars long, by_wrapper boolean, failure string")
