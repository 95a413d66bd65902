"""HTML extraction by a site style tree.

All pages of a host are merged into one tree. An element node is a path of tags with
class or id; it counts the pages that have it, its presentation styles (the sequence of
child elements it has on a page), its content features (the text of its own blocks and
its link targets) and its characters. With entropies to the base of the number of pages,

    presentation(E) = entropy of E's styles over the pages that have E
    content(E)      = 1 - mean entropy of the features in E and below, a feature seen on
                      c of m pages having entropy ln c / ln m
    importance(E)   = content(E) where E has one style, else
                      (1 - g**l) * presentation(E) + g**l * content(E), l = styles of E

so what a site repeats scores low and what differs from page to page scores high. All
elements with text are in the tree. A branch is removed from each page if neither it nor
any branch in it is as important as ``least``, unless it holds half of the site's text.

What an element says by tag, role or class (that it is the article, or a menu, header,
footer, sidebar, notice) is a prior: it moves the log-odds of importance by ``PRIOR`` for
this element and what is in it, and decides alone for nodes that fewer than
``min_pages`` pages have. So a branch that the site repeats goes from within an article,
and an element named like noise stays if it holds half of the site's text and differs
on nearly every page. Adverts, forms, scripts, links to other pages and reader comments
differ from page to page too, so for these the label decides alone. A site whose
pages are all the same is not judged.

Tags are read as the HTML standard's tokenizer does, in one pass; a quoted value that
never ends ends its tag at the next ``>``.

The counts are aggregated by Spark, combined before each shuffle, so a hot host costs
no task more than its share; paths deeper than ``depth`` are merged with their ancestor
(their text is kept). The verdicts are broadcast if their counted size allows, else
joined to the pages, hosts being salted.

Null or empty html gives an empty text; a host of few pages is read by its labels;
repeated pages count repeatedly; pages without a url form one host of their own; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytable.llm import storage
from keytable.llm.storage import materialize, small_batches

GAMMA, LEAST, DEPTH = 0.9, 0.95, 24
PRIOR = 4.3  # log-odds: an article goes below an importance of 0.2, a menu stays above 0.999
MIN_PAGES = 8  # a node seen on fewer pages says nothing about its site
MAIN = 0.5  # the share of a site's text that its main branch holds
SAME = 0.2  # a site of less importance consists of copies of one page
SALTS = 16

# Element names by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title select".split())
NOISE_TAGS = frozenset("head nav header footer aside form button dialog menu script style noscript template iframe object svg math textarea select title".split())
CONTENT_TAGS = frozenset("article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT_ROLES = frozenset("main article".split())
NOISE_WORDS = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice pagination popup promo promoted promotion related respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
# of these, what is not the page's own text though it differs from page to page
FOREIGN_TAGS = frozenset("head form button dialog script style noscript template iframe object svg math textarea select title".split())
FOREIGN_WORDS = frozenset("ad ads adv advert advertisement advertising comment comments consent cookie cookies disqus newsletter popup promo promoted related respond share sharing social sponsor sponsored subscribe subscription".split())
CONTENT_WORDS = frozenset("article articlebody content entry maincontent post story".split())


@dataclass(frozen=True)
class Labels:
    """What elements say they are: the prior of the tree."""

    noise_tags: frozenset[str] = NOISE_TAGS
    noise_roles: frozenset[str] = NOISE_ROLES
    noise_words: frozenset[str] = NOISE_WORDS
    foreign_tags: frozenset[str] = FOREIGN_TAGS
    foreign_words: frozenset[str] = FOREIGN_WORDS
    content_tags: frozenset[str] = CONTENT_TAGS
    content_roles: frozenset[str] = CONTENT_ROLES
    content_words: frozenset[str] = CONTENT_WORDS


LABELS = Labels()

CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("html body article section div td th table ul ol dl main aside nav blockquote".split())

ROOMS = frozenset(["article", "main", "body"])
IN_ROOM = frozenset("p b i em strong span a li".split())  # an end tag of these closes nothing outside of its room
SWALLOWS = frozenset("script style title textarea".split())  # without an end tag they last to the end

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}


def _words(value: str) -> list[str]:
    return [w.lower() for w in _SPLIT.split(value) if w] + [w for w in _SPLIT.split(value.lower()) if w]


class Element:
    """An open element: its path in the style tree, whether this is its own node, what it
    says it is, whether it stands in an article, and where on the stack the elements are
    that a new one may close."""

    __slots__ = ("children", "content", "noise", "own", "path", "protected", "room", "scope", "tag")

    def __init__(self, tag: str, path: str, own: bool, noise: bool, content: bool, protected: bool):
        self.tag, self.path, self.own, self.noise, self.content, self.protected, self.children = tag, path, own, noise, content, protected, []
        self.room, self.scope = -1, {}


def _kind(said: Labels, tag: str, role: str, labels: str, name_id: str, hidden: bool, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element says it is noise or the article, and its name in a path, whose
    first sign tells this too: + the article, - noise, ! noise whatever it holds."""
    words = set(_words(f"{labels} {name_id}")) if labels or name_id else set()
    noise = tag in said.noise_tags or role in said.noise_roles or not said.noise_words.isdisjoint(words) or hidden
    if noise and tag == "header" and inside and role not in said.noise_roles and said.noise_words.isdisjoint(words - {"header"}):
        noise = False  # an article's own heading
    if noise and tag in ("body", "html", "article", "main") and role not in said.noise_roles:
        noise = False
    content = tag in said.content_tags or role in said.content_roles or not said.content_words.isdisjoint(words)
    name = tag
    if labels or name_id:
        name += "." + ".".join(sorted(set(labels.split()))[:4]) + ("#" + name_id if name_id.isalpha() else "")
    foreign = noise and (hidden or tag in said.foreign_tags or not said.foreign_words.isdisjoint(words))
    # no name begins with a sign or holds a slash
    return noise, content and not noise, ("!" if foreign else "-" if noise else "+" if content else "") + name.replace("/", "|")


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], bool, int]:
    """The attributes of the tag whose name ends at an offset, whether it closes itself, and
    where it ends. ``last`` tells where the last of each quote stands."""
    found: dict[str, str] = {}
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= len(page):
            return found, False, at
        if page[at] == ">":
            return found, gap[0].endswith("/"), at + 1
        m = _ATTRIBUTE.match(page, at)
        at, value = m.end(), ""
        if m[2] is not None and at < len(page):
            quote = page[at]
            if quote in last:
                if at >= last[quote]:
                    end = page.find(">", at)
                    return found, False, end + 1 if end >= 0 else len(page)
                end = page.find(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            elif quote != ">":
                m2 = _UNQUOTED.match(page, at)
                value, at = m2[0], m2.end()
        found.setdefault(m[1].lower(), entities.unescape(value) if "&" in value else value)


def blocks(page: str, depth: int = DEPTH, labels: Labels = LABELS) -> Iterator[tuple[str, object]]:
    """Events of a page: ("open", element), ("close", element), ("text", string with its
    references decoded), ("break", None) where a block or line ends, ("link", target).
    The first to open and last to close is the page itself, of path ""."""
    stack: list[Element] = []
    places: dict[str, list[int]] = {}  # where on the stack the elements of a tag are
    endless: set[str] = set()  # raw elements that no end tag follows any more
    kinds: dict[tuple, tuple[bool, bool, str]] = {}
    last = {q: page.rfind(q) for q in "\"'"}
    at, n = 0, len(page)
    lone = Element("", "", True, False, False, False)
    yield "open", lone

    def close(down_to: int) -> Iterator[tuple[str, object]]:
        while len(stack) > down_to:
            element = stack.pop()
            places[element.tag].pop()
            yield "close", element

    while at < n:
        sign = page.find("<", at)
        if sign < 0:
            sign = n
        if sign > at:
            text = page[at:sign]
            yield "text", entities.unescape(text) if "&" in text else text
        if sign == n:
            break
        ends = page.startswith("/", sign + 1)
        name_at = _NAME.match(page, sign + 1 + ends)
        if name_at is None:  # a comment, a declaration, or just a sign
            if page.startswith("<!--", sign):
                stop = page.find("-->", sign + 2)
                at = stop + 3 if stop >= 0 else n
            elif ends or page.startswith(("!", "?"), sign + 1):
                stop = page.find(">", sign)
                at = stop + 1 if stop >= 0 else n
            else:
                yield "text", "<"
                at = sign + 1
            continue
        tag, at = name_at[0].lower(), name_at.end()
        if page.startswith(">", at):
            attributes, selfless, at = {}, False, at + 1
        else:
            attributes, selfless, at = _attributes(page, at, last)
        if ends:
            if (of_tag := places.get(tag)) and (tag not in IN_ROOM or of_tag[-1] > stack[-1].room):
                yield from close(of_tag[-1])
            if tag not in INLINE:
                yield "break", None
            continue
        if tag not in INLINE:
            if stack and tag in ENDS_P and "p" in stack[-1].scope:
                yield from close(stack[-1].scope["p"])
            if tag in CLOSES and tag != "p":
                while stack and (inner := max((stack[-1].scope.get(t, -1) for t in CLOSES[tag]))) >= 0:
                    yield from close(inner)
            yield "break", None
        if tag == "a" and attributes.get("href"):
            yield "link", attributes["href"]
        if tag in VOID or selfless and tag not in ENDS_P:
            continue
        above = stack[-1] if stack else lone
        key = (tag, attributes.get("role", "").lower(), attributes.get("class", ""), attributes.get("id", ""), "hidden" in attributes or attributes.get("aria-hidden") == "true", above.protected)
        if (kind := kinds.get(key)) is None:
            kind = kinds[key] = _kind(labels, *key)
        noise, content, name = kind
        if tag in INLINE and not noise:
            name = ""
        if name:
            above.children.append(name)
        own = bool(name) and above.path.count("/") < depth
        element = Element(tag, f"{above.path}/{name}" if own else above.path, own, noise, content, content or above.protected)
        if tag in RAW:
            stop = None if tag in endless else _RAW_END[tag].search(page, at)
            if stop is None:
                endless.add(tag)
            at = stop.end() if stop else n if tag in SWALLOWS else at
            yield "open", element
            yield "close", element
            continue
        element.room = len(stack) if tag in ROOMS else above.room
        element.scope = {} if tag in SCOPES else above.scope
        if tag in CLOSES:
            element.scope = {**element.scope, tag: len(stack)}
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
        yield "open", element
    yield from close(0)
    yield "close", lone


def _joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def page_nodes(page: str, depth: int = DEPTH, labels: Labels = LABELS) -> tuple[set, set, set, dict]:
    """What a page adds to its site's tree: (path, style), (path, feature) and (path, 0)
    of all nodes that can hold text, and the characters of their own text."""
    styles: set[tuple[str, int]] = set()
    features: set[tuple[str, int]] = set()
    chars: Counter = Counter()
    stack: list[Element] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            if block := _joined(text):
                features.add((stack[-1].path, hash64(block)))
                chars[stack[-1].path, 0] += len(block)
            text.clear()

    for event, value in blocks(page, depth, labels):
        if event == "text":
            text.append(value)
        elif event == "break":
            flush()
        elif event == "link":
            features.add((stack[-1].path, hash64("@" + value)))
        elif event == "open":
            if value.tag not in INLINE:
                flush()
            stack.append(value)
        else:
            if value.tag not in INLINE:
                flush()
            if len(stack) > 1:
                stack.pop()
            if value.own and value.tag not in RAW:
                styles.add((value.path, hash64("|".join(dict.fromkeys(value.children)))))
    flush()
    return styles, features, {(path, 0) for path, _ in styles}, chars


def hash64(text: str) -> int:
    """A stable 63-bit hash."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def page_text(page: str, removed: frozenset[str] | set[str] = frozenset(), kept: frozenset[str] | set[str] = frozenset(), depth: int = DEPTH, labels: Labels = LABELS) -> str:
    """The text of a page without removed branches and without noise that is not kept
    (paths of both), blocks joined by one space."""
    stack: list[tuple[Element, int]] = []
    out: list[str] = []
    part: list[str] = []
    skip = 0  # 1 in a removed branch, where an article is still looked for; 2 in noise

    def flush() -> None:
        if part:
            if block := _joined(part):
                out.append(block)
            part.clear()

    for event, value in blocks(page, depth, labels):
        if event == "text":
            if not skip:
                part.append(value)
        elif event == "break":
            flush()
        elif event == "open":
            stack.append((value, skip))
            if skip < 2:
                if value.noise:
                    skip = 0 if value.own and not skip and value.path in kept else 2
                elif value.own and value.path in removed:
                    skip = 1
                elif value.content:
                    skip = 0
        elif event == "close":
            if value.tag not in INLINE:
                flush()
            if stack and stack[-1][0] is value:
                skip = stack.pop()[1]
    flush()
    return " ".join(out)


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def node_counts(pages: DataFrame, depth: int = DEPTH, labels: Labels = LABELS) -> DataFrame:
    """(host, path, kind, key, pages): on how many pages of a host a node has a style
    (kind 0), has a feature (kind 1), or is at all (kind 2); and its characters (kind 3).
    Combined per task before the shuffle."""
    fields = "host string, path string, kind int, key long, pages long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = list(counts.items())
            columns = [[r[0][i] for r in rows] for i in range(4)] + [[r[1] for r in rows]]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=[f.split()[0] for f in fields.split(", ")])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    *sets, chars = page_nodes(page, depth, labels)
                    for kind, found in enumerate(sets):
                        for path, key in found:
                            counts[host, path, kind, key] += 1
                    for (path, key), n in chars.items():
                        counts[host, path, 3, key] += n
                if len(counts) > 200_000:
                    yield out()
        yield out()

    rows = pages.select(_host().alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, fields).groupBy("host", "path", "kind", "key").agg(F.sum("pages").alias("pages"))


def _branches(rows: DataFrame) -> DataFrame:
    """Each row of a node for the node itself and all branches that hold it."""
    split = F.split("path", "/")
    return rows.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(split)), lambda k: F.array_join(F.slice(split, 1, k), "/"))))


def importance(counts: DataFrame) -> DataFrame:
    """(host, path, pages, importance, features, chars) of every node of the sites' trees;
    features is null and importance 1 for nodes without content."""
    styles = counts.where("kind = 0").groupBy("host", "path").agg(F.sum("pages").alias("total"), F.sum(F.col("pages") * F.log("pages")).alias("plogp"), F.count("*").alias("l"))
    seen = counts.where("kind = 2").select("host", "path", F.col("pages").alias("m"))
    # a node that repeats on a page may have several styles there
    entropy = F.least(F.lit(1.0), (F.log("total") - F.col("plogp") / F.col("total")) / F.log("m"))
    nodes = styles.join(seen, ["host", "path"]).withColumn("presentation", F.when(F.col("m") > 1, entropy).otherwise(1.0))
    held = F.when(F.col("kind") == 1, 1)
    own = counts.where("kind in (1, 3)").groupBy("host", "path").agg(F.sum(held * F.log("pages")).alias("logs"), F.count(held).alias("features"), F.sum(F.when(F.col("kind") == 3, F.col("pages"))).alias("chars"))
    content = _branches(own).groupBy("host", "path").agg(F.sum("logs").alias("logs"), F.sum("features").alias("features"), F.sum("chars").alias("chars"))
    joined = nodes.join(content, ["host", "path"], "left")
    common = F.when(F.col("m") > 1, F.col("logs") / F.col("features") / F.log("m")).otherwise(0.0)
    differing = 1 - F.least(F.lit(1.0), common)
    weight = F.when(F.col("l") > 1, F.pow(F.lit(GAMMA), F.col("l"))).otherwise(1.0)
    value = F.when(F.col("m") == 1, 1.0).when(F.col("logs").isNull(), 1.0).otherwise((1 - weight) * F.col("presentation") + weight * differing)
    return joined.select("host", "path", F.col("m").alias("pages"), value.alias("importance"), "features", F.coalesce("chars", F.lit(0)).alias("chars"))


def verdicts(nodes: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, stays): the branches that the tree removes, and those that stay although
    they say they are noise."""
    signs = F.concat(F.lit("/"), F.col("path"))
    prior = F.when(signs.rlike("/[-!]"), -PRIOR).when(signs.contains("/+"), PRIOR).otherwise(0.0)
    sure = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("importance")))
    known = nodes.where((F.col("pages") >= min_pages) & F.col("features").isNotNull()).withColumn("odds", F.log(sure / (1 - sure)) + prior)
    best = _branches(known.select("host", "path", "odds")).groupBy("host", "path").agg(F.max("odds").alias("best"))
    sites = nodes.where("path = ''").where(F.col("importance") >= SAME).select("host", F.col("chars").alias("all_chars"))
    judged = known.join(best, ["host", "path"]).join(sites, "host")
    name = F.substring_index("path", "/", -1)
    high = F.col("best") >= float(_log_odds(least))
    main = F.col("chars") >= MAIN * F.col("all_chars")
    stays = F.when(~high & ~main, False).when(name.startswith("-") & high & main, True)
    return judged.select("host", "path", stays.alias("stays")).where(F.col("stays").isNotNull())


def _log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def extract(pages: DataFrame, *, least: float = LEAST, min_pages: int = MIN_PAGES, depth: int = DEPTH, labels: Labels = LABELS) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    counts = materialize(node_counts(pages, depth, labels), "nodes")
    found = materialize(verdicts(importance(counts), least, min_pages), "verdicts")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), _host().alias("host"))
    sites: dict[str, tuple[set, set]] = {}
    size = found.agg(F.sum(F.length("host") + F.length("path") + 200)).first()[0] or 0
    if size <= storage.BROADCAST_BYTES:
        for r in found.toLocalIterator():
            sites.setdefault(r["host"], (set(), set()))[r["stays"]].add(r["path"])
    else:  # a site's verdicts travel with its pages
        listed = found.groupBy("host").agg(F.collect_list(F.when(~F.col("stays"), F.col("path"))).alias("removed"), F.collect_list(F.when(F.col("stays"), F.col("path"))).alias("kept"))
        listed = listed.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(listed, ["host", "salt"], "left")
    shared = spark.sparkContext.broadcast(sites)
    fields = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], batch.num_rows
            joined = "removed" in batch.schema.names
            lists = [batch.column(c).to_pylist() for c in ("removed", "kept")] if joined else [[None] * n] * 2
            for page, host, gone, stay in zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), *lists, strict=True):
                removed, kept = (set(gone or ()), set(stay or ())) if joined else sites_of(host)
                texts.append(page_text(page, removed, kept, depth, labels) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    def sites_of(host: str) -> tuple:
        return shared.value.get(host, ((), ()))

    return rows.mapInArrow(run, fields)
