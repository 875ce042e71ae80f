"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page's tokens are its tags and its runs of text, each with the path of containers it stands in (elements that hold other
blocks, with those words of class, id and role that SHARE of the host's pages give such an element). A token's occurrence vector says how often it occurs on each page of the host. Tokens with the
same vector are an equivalence class: what one piece of the host's template wrote. A class is frequent if it is on SHARE of the
host's pages, a run besides on RUN_PAGES pages. On each page a class is valid as far as its tokens come in the host's order
(that of their mean first places), all once and then again all; tokens out of order belong to the text. Containers nest by
their paths. Valid classes are the template; what lies between their tokens are slots.

Slots in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are boilerplate,
told by element or by the words of class, id and role (those of html and body say nothing; within article and main containers only
a whole class or role tells, or a class that begins with a word of CLEAR). If the template has article or main containers, the text in those is
the main text. If not, it is all other slots, without the runs of text that are tokens of valid classes; of the
slot with most text between the tokens of the class with most containers, and of those on no fewer pages, nothing is taken
out, so that passages which many pages share stay. A page without the main container of its host's template is read as if there were none.

Vectors are never built: a token's vector is known by the XOR of hashes of (page, count) and the number of pages, which is a
partial aggregate. A template has at most 1 / SHARE times as many tokens as a page. Templates are joined back to the pages by
host; Spark broadcasts them if their table is small, else a host with a third of all pages is a skewed key that adaptive
execution can split.

Blocks are what tags other than inline ones separate. Character references are decoded, white space in a block becomes one
blank, empty blocks are left out, blocks are joined by one newline.

Defined results: a null or empty page has the text "" and 0 characters; pages whose URL is null or has no host are one host
together; tags left open and pages cut off are read to their end; repeated pages are rows like others, but a
content that a host has several times counts as one page of its template; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tripweave.session import write_through

from .url_rules import url_parts

SHARE = 0.5
RUN_PAGES = 3

# Elements of HTML by their part in a page, and the words that mark boilerplate.
CONTAINERS = frozenset("html head body main article section div header footer nav aside form ul ol dl table figure fieldset details dialog menu center".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset("head header footer nav aside form menu dialog".split())
RAW = frozenset("script style noscript template iframe svg object select textarea button title canvas audio video".split())
MAIN = frozenset(("article", "main"))
PAGE = frozenset(("html", "body"))
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead "
    "notice cookie cookies consent popup modal overlay newsletter subscribe share sharing social related recommended comment comments disqus login signup "
    "search pagination pager toolbar widget contentinfo complementary".split()
)
#: Of these the words that begin no name of an author's own.
CLEAR = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner sidebar nav navbar menu cookie cookies newsletter comment comments disqus breadcrumb breadcrumbs".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)""", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_BRACKETS = re.compile(r"\[[^\]]*\]")
_CODED = {ord(c): f"%{ord(c):02X}" for c in "%/[]"}


def marks(attributes: str) -> tuple[str, ...]:
    """Class words, id and role of a tag as sorted "name=value"."""
    if "=" not in attributes:
        return ()
    found = set()
    for name, value in _MARK.findall(attributes):
        value = value.strip("\"'").lower()
        found |= {f"{name.lower()}={v}" for v in (value.split() if name.lower() == "class" else [value.strip()]) if v}
    return tuple(sorted(found))


def step_name(name: str, found: tuple[str, ...]) -> str:
    """A tag with its marks as one step of a path; signs that part steps and marks are written as %XX."""
    return name + "".join(f"[{m.translate(_CODED)}]" for m in found)


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """The page in order: ("open", name, marks), ("close", name, ()) and ("text", run, ()) with references still coded.
    What scripts, styles and other raw elements hold is left out; comments vanish without a break."""
    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            yield "text", page[at:], ()
            return
        if tag.start() > at:
            yield "text", page[at : tag.start()], ()
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            yield "close", name, ()
        elif name in RAW:
            attributes = tag[3] or tag[6] or ""
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            yield "open", name, ()
            yield "close", name, ()
        else:
            yield "open", name, marks(tag[3] or tag[6] or "")


class Path:
    """The stack of open containers. An end tag closes the innermost container of its name and all within, if there is one.
    Steps are compared by name and by the marks that are frequent on the host (name, mark); html and body, of which a page
    has one, by name alone. Boilerplate words are looked for in all marks of the page, but not in those of html and body."""

    def __init__(self, frequent: frozenset[tuple[str, str]]) -> None:
        self.frequent = frequent
        self.names: list[str] = []
        self.steps: list[str] = []  # paths with frequent marks
        self.bare: list[str] = []  # paths of names alone
        self.skips: list[bool] = []

    def open(self, name: str, found: tuple[str, ...]) -> None:
        kept = () if name in PAGE else tuple(m for m in found if (name, m) in self.frequent)
        self.names.append(name)
        self.steps.append(f"{self.text}/{step_name(name, kept)}")
        self.bare.append(f"{self.bare[-1] if self.bare else ''}/{name}")
        within = name in MAIN or not MAIN.isdisjoint(self.names[:-1])
        self.skips.append(self.skip or boilerplate(name, found, within))

    def close(self, name: str) -> None:
        if name in self.names:
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        self.steps.pop()
        self.bare.pop()
        self.skips.pop()
        return self.names.pop()

    @property
    def text(self) -> str:
        return self.steps[-1] if self.steps else ""

    @property
    def skip(self) -> bool:
        return bool(self.skips) and self.skips[-1]


def plain(run: str) -> str:
    return " ".join(html.unescape(run).split())


def page_marks(page: str) -> set[tuple[str, str]]:
    """The marks (name, mark) of the page's containers."""
    return {(value, m) for kind, value, found in tokens(page) if kind == "open" and value in CONTAINERS and value not in PAGE for m in found}


def walk(page: str, path: Path) -> Iterator[tuple[int, tuple[str, str, str]]]:
    """The page's tokens (path, kind, name) in order, each with its place; the kind is tag or run."""
    for at, (kind, value, mark) in enumerate(tokens(page)):
        if kind == "open":
            if value in CONTAINERS:
                path.open(value, mark)
                yield at, (path.text, "tag", value)
            else:
                yield at, (path.text, "tag", step_name(value, mark))
        elif kind == "close":
            yield at, (path.text, "tag", f"/{value}")
            if value in CONTAINERS:
                path.close(value)
        else:
            run = run_name(plain(value))
            if run:
                yield at, (path.text, "run", run)


def page_tokens(page: str, frequent: frozenset[tuple[str, str]]) -> dict[tuple[str, str, str], list[int]]:
    """How often each token occurs, and its first place."""
    found: dict[tuple[str, str, str], list[int]] = {}
    for at, token in walk(page, Path(frequent)):
        found.setdefault(token, [0, at])[0] += 1
    return found


def run_name(run: str) -> str:
    """A run of text as a token: itself, or its start and a hash if it is long."""
    return run if len(run) <= 200 else f"{run[:100]}\n{len(run)}\n{hashlib.md5(run.encode('utf-8', 'replace')).hexdigest()}"


def boilerplate(name: str, found: tuple[str, ...], within: bool = False) -> bool:
    """Whether a container is boilerplate by its element or by the words of its marks. Within an article or main container, where
    an author's own names stand too, only a whole class or role says so, or a class that begins with a word of CLEAR."""
    if name in SKIPPED or name in PAGE:
        return name in SKIPPED
    if within:
        values = [m.partition("=")[2] for m in found if not m.startswith("id=")]
        return any(v in BOILERPLATE or _WORD.findall(v)[:1] and _WORD.findall(v)[0] in CLEAR for v in values)
    return any(not BOILERPLATE.isdisjoint(_WORD.findall(m)) for m in found)


def bare(path: str) -> str:
    """A path without marks."""
    return _BRACKETS.sub("", path)


@dataclass
class Template:
    paths: frozenset[str]  # of containers
    mains: frozenset[str]  # those of main containers, by names alone
    ranks: dict[tuple[str, str, str], int]  # tokens in the order of their mean first places
    classes: dict[tuple[str, str, str], int]
    on_pages: dict[int, int]  # of classes


def deduce(found: list[dict]) -> Template:
    """The template of a host from its frequent tokens and their classes."""
    paths, runs = nest(found)
    order = sorted(found, key=lambda t: (t["place"], t["path"], t["kind"], t["name"]))
    of = {(t["path"], t["kind"], t["name"]): t["class"] for t in order if t["kind"] == "tag" or (t["path"], t["name"]) in runs}
    mains = frozenset(b for b in map(bare, paths) if not MAIN.isdisjoint(b.split("/")))
    return Template(paths, mains, {token: k for k, token in enumerate(of)}, of, {t["class"]: t["on_pages"] for t in found})


def container(token: tuple[str, str, str]) -> bool:
    return token[1] == "tag" and token[2].removeprefix("/") in CONTAINERS


def ordered(members: list[tuple[str, str, str]], places: dict[tuple[str, str, str], list[int]], ranks: dict[tuple[str, str, str], int]) -> list[tuple[str, str, str]]:
    """The tokens of a class that occur on the page in the host's order, all once and then again all: containers first, then
    each other token that fits between those before it. Tokens of a class occur on the same pages, so if one is before
    another on each of them, its mean place is too."""
    kept: list[tuple[int, list[int], tuple[str, str, str]]] = []
    for token in sorted(members, key=lambda t: (not container(t), ranks[t])):
        own, at = places[token], bisect(kept, ranks[token], key=lambda k: k[0])
        if kept:
            # before the first and after the last token comes the other end, one turn on
            before = kept[at - 1][1] if at else [-1, *kept[-1][1][:-1]]
            after = kept[at][1] if at < len(kept) else [*kept[0][1][1:], own[-1] + 1]
            if not len(before) == len(own) == len(after) or not all(b < o < a for b, o, a in zip(before, own, after)):
                continue
        kept.insert(at, (ranks[token], own, token))
    return [token for _, _, token in kept]


def written(page: str, template: Template, frequent: frozenset[tuple[str, str]]) -> set[int]:
    """The places of the runs that the template wrote: those of its classes as far as they are in order on this page. The
    class with most containers, and those on no fewer pages, part the page into slots; of the slot with most text (links and
    boilerplate not counted) nothing is taken, however many pages share it."""
    places: dict[tuple[str, str, str], list[int]] = {}
    texts: list[tuple[int, int]] = []  # places and lengths of runs that may be main text
    path, links = Path(frequent), 0
    for at, token in walk(page, path):
        name = token[2].partition("[")[0] if token[1] == "tag" else ""
        links = links + 1 if name == "a" else 0 if name == "/a" or container(token) else links
        if token[1] == "run" and not path.skip and not links:
            texts.append((at, int(token[2].split("\n")[1]) if "\n" in token[2] else len(token[2])))
        if token in template.classes:
            places.setdefault(token, []).append(at)
    members: dict[int, list[tuple[str, str, str]]] = {}
    for token in places:
        members.setdefault(template.classes[token], []).append(token)
    valid = {c: ordered(own, places, template.ranks) for c, own in members.items()}
    if not valid:
        return set()
    root = max(valid, key=lambda c: (sum(map(container, valid[c])), template.on_pages[c], c))
    frame = [token for c, own in valid.items() if template.on_pages[c] >= template.on_pages[root] for token in own]
    bounds = sorted(at for token in frame if token[1] == "run" or container(token) for at in places[token])
    taken, sizes = {at for token in frame for at in places[token]}, [0] * (len(bounds) + 1)
    for at, length in texts:
        if at not in taken:
            sizes[bisect(bounds, at)] += length
    main = sizes.index(max(sizes)) if any(sizes) else -1
    gone = {at for own in valid.values() for token in own if token[1] == "run" for at in places[token]}
    return {at for at in gone if at in taken or bisect(bounds, at) != main}


def extract(page: str, template: Template, frequent: frozenset[tuple[str, str]]) -> str:
    """Main text of a page under its host's template. Main containers are known again by the names on their path, whatever
    marks a page gives them."""
    blocks: list[tuple[bool, list[tuple[int, str]]]] = []  # in a main container, runs with their places
    path, inside, skip, new = Path(frequent), False, False, True
    for at, (kind, value, mark) in enumerate(tokens(page)):
        if kind == "text":
            if skip:
                continue
            if new:
                blocks.append((inside, []))
                new = False
            blocks[-1][1].append((at, value))
            continue
        if value in CONTAINERS:
            if kind == "open":
                path.open(value, mark)
            else:
                path.close(value)
            skip = path.skip
            inside = not template.mains.isdisjoint(path.bare)
        if value not in INLINE:
            new = True
    if any(in_main for in_main, _ in blocks):
        texts = [plain("".join(r for _, r in own)) for in_main, own in blocks if in_main]
    else:
        gone = written(page, template, frequent)
        texts = [plain("".join(r for at, r in own if at not in gone)) for _, own in blocks]
    return "\n".join(t for t in texts if t)


def distinct_contents(rows: DataFrame) -> DataFrame:
    """Host, number and html of one page of each content on a host. Hashes tell which contents a host has more than once
    (partial aggregates); only pages with one of those are left out, so that the pages themselves are not shuffled."""
    content = (F.xxhash64(F.coalesce("html", F.lit(""))), F.crc32(F.coalesce("html", F.lit(""))))
    numbered = rows.select("host", F.monotonically_increasing_id().alias("number"), "html", content[0].alias("hash"), content[1].alias("check"))
    counted = numbered.groupBy("host", "hash", "check").agg(F.min("number").alias("chosen"), F.count(F.lit(1)).alias("copies"))
    repeated = write_through(counted.where("copies > 1").drop("copies"))
    joined = numbered.join(repeated, ["host", "hash", "check"], "left")
    return joined.where(F.col("chosen").isNull() | (F.col("chosen") == F.col("number"))).select("host", "number", "html")


def frequent_marks(pages: DataFrame, *, share: float = SHARE) -> DataFrame:
    """For pages (host, html): host, and the marks of containers on share of its pages as an array of (name, mark)."""

    def run(batches):
        for batch in batches:
            rows = [(host, *m) for host, page in zip(*(c.to_pylist() for c in batch.columns)) for m in page_marks(page or "")]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "name", "mark"])

    found = pages.select("host", "html").mapInArrow(run, "host string, name string, mark string")
    counted = found.groupBy("host", "name", "mark").agg(F.count(F.lit(1)).alias("on_pages"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    kept = counted.join(sizes, "host").where(F.col("on_pages") >= share * F.col("pages"))
    return kept.groupBy("host").agg(F.collect_list(F.struct("name", "mark")).alias("marks"))


def mark_set(marks: list[dict] | None) -> frozenset[tuple[str, str]]:
    return frozenset((m["name"], m["mark"]) for m in marks or ())


def templates(pages: DataFrame, *, share: float = SHARE) -> DataFrame:
    """For pages (host, page number, html, frequent marks of the host): host, and its template as an array of (path, kind,
    name, class, pages, sum of the first places)."""

    def run(batches):
        for batch in batches:
            rows = []
            for host, number, page, marks in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(host, number, *token, *own) for token, own in page_tokens(page or "", mark_set(marks)).items()]
                if len(rows) > 20_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    occurrences = pages.select("host", "number", "html", "marks").mapInArrow(run, "host string, number bigint, path string, kind string, name string, n bigint, first bigint")
    vectors = occurrences.groupBy("host", "path", "kind", "name").agg(
        F.count(F.lit(1)).alias("on_pages"), F.bit_xor(F.xxhash64("number", "n")).alias("vector"), F.sum("first").alias("place")
    )
    sizes = write_through(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    frequent = vectors.join(sizes, "host").where(F.col("on_pages") >= share * F.col("pages"))
    frequent = frequent.where((F.col("kind") == "tag") | (F.col("on_pages") >= RUN_PAGES))
    return frequent.groupBy("host").agg(F.collect_list(F.struct("path", "kind", "name", F.xxhash64("on_pages", "vector").alias("class"), "on_pages", "place")).alias("template"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 7
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "number", "path", "kind", "name", "n", "first"])


def nest(template: list[dict]) -> tuple[frozenset[str], frozenset[tuple[str, str]]]:
    """The container paths and runs of the valid classes: those all of whose tokens stand in containers of the template.
    A container is one where its start tag is frequent and its parent is a container of the template."""
    opened: dict[str, set[int]] = {}
    for token in template:
        if token["kind"] == "tag" and token["path"].rpartition("/")[2].partition("[")[0] == token["name"]:
            opened.setdefault(token["path"], set()).add(token["class"])
    valid: set[str] = set()
    for path in sorted(opened, key=len):
        parent = _parent(path)
        if not parent or parent in valid:
            valid.add(path)
    broken = {t["class"] for t in template if t["path"] and t["path"] not in valid}
    runs = frozenset((t["path"], t["name"]) for t in template if t["kind"] == "run" and t["class"] not in broken)
    return frozenset(valid), runs


def _parent(path: str) -> str:
    """The path without its last container; marks may hold slashes, so cut before the last slash outside brackets."""
    depth = 0
    for at in range(len(path) - 1, -1, -1):
        depth += {"]": 1, "[": -1}.get(path[at], 0)
        if path[at] == "/" and depth <= 0:
            return path[:at]
    return ""


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns id_col, url_col, text and n_chars. pages must give the same rows in the same partitions whenever it is read,
    as a stored table does."""
    host, _ = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    once = distinct_contents(rows)
    marked = write_through(frequent_marks(once))
    found = write_through(templates(once.join(marked, "host", "left")).join(marked, "host", "left"))
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        known: dict[int, Template] = {}
        for batch in batches:
            texts = []
            for page, template, marks in zip(batch.column(2), batch.column(3), batch.column(4)):
                key, frequent = template.as_py() or [], mark_set(marks.as_py())
                mark = hash(tuple((t["path"], t["kind"], t["name"], t["class"], t["place"]) for t in key))
                if mark not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[mark] = deduce(key)
                texts.append(extract(page.as_py() or "", known[mark], frequent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    joined = rows.join(found, "host", "left").select("id", "url", "html", "template", "marks")
    out = joined.mapInArrow(run, f"id {id_type}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
