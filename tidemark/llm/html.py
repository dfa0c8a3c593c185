"""Main text of web pages as the maximum-scoring run of tokens.

A page is a run of words and tags. Words score positive and tags negative, with weights that labelled
pages teach: a page whose markup names its article says which words and tags stand inside. Counts of words
and tags, inside and outside, are summed over all labelled pages, one row for each known tag, so that the
weights do not depend on how pages are dealt. One linear scan finds the run with the largest sum, and its
blocks are the text.

Elements that are never article text are taken out before the scan, by their name, their role or one whole
name of their class or id: scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and
comments. Where that would take out every article of a page, elements that hold one stay.

Defined results: a null or empty page has an empty text; an element that is never closed ends where a
heading, a paragraph or the article begins; a page without words has an empty text; of runs with the same
sum the first one counts.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

#: Elements whose end breaks a block, elements without text of the article, and elements
#: that hold raw text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("head nav footer aside form button select option textarea input label template iframe object svg canvas noscript dialog menu".split())
RAW = frozenset("script style noscript template iframe textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that are counted by name; others, as of custom elements, are counted together.
KNOWN = BLOCKS | NEVER | RAW | VOID | frozenset("a abbr acronym audio b bdi bdo big blink cite code data datalist del dfn em figure font i ins kbd label main map mark marquee meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var video".split())
#: Class and id names of what is no article text, and what may stand before or behind them.
UNWANTED = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments respond replies disqus menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer copyright header masthead topbar toolbar tags skip search".split())
BEFORE = "site|page|main|global|top|bottom|left|right|post|article|entry|primary|secondary|user|reader|google|cookie|social|related"
BEHIND = "container|wrapper|wrap|box|area|section|block|list|links?|left|right|top|bottom|inner|content|slot|unit|form|bar|menu|banner|notice|buttons?|posts|articles|stories|widget|thread|\\d+"
NAMED = re.compile(rf"(?:(?:{BEFORE})[-_]+)*([a-z]+)(?:[-_]+(?:{BEHIND}))*")
CUSTOM = "custom"
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
ARTICLE = frozenset(("article", "main"))
RESUME = frozenset("article main h1 h2 p".split())

_tag = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_attribute = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Characters within which one expression matches a whole tag; longer tags are scanned in steps.
TAG_CHARS = 16_384
_tag_name = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_unquoted = re.compile(r"[^>\"']*+")
_read = re.compile(r"(?<![\w-])(?:class|id|role|aria-hidden|style|itemprop)\s*=\s*\Z", re.I)


def _long_tag(page: str, lt: int, failed: set[int]) -> tuple[str, str, str, int] | None:
    """(slash, name, attributes, end) of a tag of any length, or None if a quote or the tag stays open.

    Quoted values of attributes that nothing reads are left out, so that their words name no attribute.
    ``failed`` holds the opening quotes from which a scan of this page has failed, so that no part of a
    page is scanned again and again.
    """
    m = _tag_name.match(page, lt)
    if not m:
        return None
    at, seen, kept = m.end(), [], []
    while True:
        start, at = at, _unquoted.match(page, at).end()
        kept.append(page[start:at])
        if at == len(page) or at in failed:
            break
        if page[at] == ">":
            return m[1], m[2], "".join(kept), at + 1
        seen.append(at)
        end = page.find(page[at], at + 1)
        if end < 0:
            break
        kept.append(page[at : end + 1] if _read.search(kept[-1][-100:]) else page[at] * 2)
        at = end + 1
    failed.update(seen)
    return None


def tokens(page: str) -> list[tuple[str, str, str]]:
    """('text', '', characters), ('open', name, attributes) and ('close', name, '') in page order."""
    out, at, n, failed = [], 0, len(page), set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            out.append(("text", "", page[at:lt]))
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _tag.match(page, lt, min(n, lt + TAG_CHARS))
        tag = (m[1], m[2], m[3], m.end()) if m else _long_tag(page, lt, failed) if lt + TAG_CHARS < n else None
        if not tag:
            if not re.match(r"</?[A-Za-z]", page[lt : lt + 3]):
                out.append(("text", "", "<"))
                at = lt + 1
                continue
            end = page.find(">", lt)
            if end < 0:
                break
            name = re.match(r"</?([A-Za-z][^\s/>]*)", page[lt : min(end, lt + 100)])[1].lower()
            out.append(("close" if page[lt + 1] == "/" else "open", name, ""))
            at = end + 1
            continue
        name, at = tag[1].lower(), tag[3]
        if tag[0]:
            out.append(("close", name, ""))
            continue
        out.append(("open", name, tag[2]))
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
            if not end:
                if name in ("script", "style"):
                    break
                continue
            out.append(("text", "", page[at : end.start()]))
            at = end.start()
    return out


def named_unwanted(value: str) -> bool:
    """Whether one of the names in a class or id is that of something unwanted."""
    return any((m := NAMED.fullmatch(n)) is not None and m[1] in UNWANTED for n in value.split())


def unwanted(name: str, attributes: str) -> bool:
    if name in RAW or name in NEVER:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in _attribute.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id") and named_unwanted(value):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _holders(all_: list[tuple[str, str, str]]) -> set[int]:
    """Places of opening tags whose element is closed and holds an article, or is one itself."""
    out: set[int] = set()
    open_: dict[str, list[int]] = {}
    articles = [i for i, (kind, name, _) in enumerate(all_) if kind == "open" and name in ARTICLE]
    for i, (kind, name, _) in enumerate(all_):
        if kind == "open":
            open_.setdefault(name, []).append(i)
        elif kind == "close" and open_.get(name):
            start = open_[name].pop()
            at = bisect_left(articles, start)
            if at < len(articles) and articles[at] < i:
                out.add(start)
    return out


def wanted(page: str) -> list[tuple[str, str, str]]:
    """The tokens outside unwanted elements. A page whose articles all stand in such elements keeps the
    elements that hold them."""
    all_ = tokens(page)
    out = _outside(all_, frozenset())
    is_article = lambda x: x[0] == "open" and x[1] in ARTICLE
    if not any(map(is_article, out)) and any(map(is_article, all_)):
        return _outside(all_, _holders(all_))
    return out


def _outside(all_: list[tuple[str, str, str]], stay: set[int] | frozenset[int]) -> list[tuple[str, str, str]]:
    closes = Counter(name for kind, name, _ in all_ if kind == "close")
    out, skip, depth, inside = [], "", 0, 0
    for i, (kind, name, rest) in enumerate(all_):
        if kind == "close":
            closes[name] -= 1
        if skip:
            if kind == "open" and name == skip:
                depth += 1
            elif kind == "close" and name == skip:
                depth -= 1
                if not depth:
                    skip = ""
            elif kind == "open" and name in RESUME and closes[skip] <= 0:
                skip = ""
            if skip or kind == "close":
                continue
        if kind == "open" and i not in stay and name not in VOID and (unwanted(name, rest) or name == "header" and inside <= 0):
            skip, depth = name, 1
            continue
        if name in ARTICLE:
            inside += 1 if kind == "open" else -1
        out.append((kind, name, rest))
    return out


def counts(page: str) -> Counter:
    """Words by container and tags, inside and outside of the article that the markup names."""
    seen: Counter = Counter()
    rows = wanted(page)
    if not any(k == "open" and n in ARTICLE for k, n, _ in rows):
        return seen
    inside, box = 0, ""
    for kind, name, rest in rows:
        if kind == "text":
            seen["words", box, inside > 0] += len(rest.split())
        elif name in ARTICLE:
            inside += 1 if kind == "open" else -1
        else:
            seen["tag", name if name in KNOWN else CUSTOM, inside > 0] += 1
        if name in BLOCKS and name not in ARTICLE:
            box = name if kind == "open" else ""
    return seen


def weights_of(total: Counter) -> dict[str, dict[str, float]]:
    """Scores: clipped log ratios of inside to outside; tags always cost, words of a container may."""
    out: dict[str, dict[str, float]] = {"words": {}, "tag": {}}
    for what, name in {k[:2] for k in total}:
        ratio = math.log((total[what, name, True] + 1) / (total[what, name, False] + 1))
        out[what][name] = max(-2.0, min(2.0, ratio)) if what == "words" else max(-4.0, min(-0.05, ratio / 2 - 1))
    return out


def train(pages: list[str]) -> dict[str, dict[str, float]]:
    total: Counter = Counter()
    for p in pages:
        total.update(counts(p or ""))
    return weights_of(total)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last place of the run with the largest positive sum, the first of several; (0, -1) if none."""
    best, first, last, total, begin = 0.0, 0, -1, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, first, last = total, begin, i
    return first, last


def extract(page: str | None, weights: dict[str, dict[str, float]]) -> str:
    """The blocks of the best run, two line feeds apart."""
    if not page:
        return ""
    blocks: list[list[str]] = [[]]
    places, scores, box = [], [], ""
    words, tag = weights["words"], weights["tag"]
    for kind, name, rest in wanted(page):
        if kind == "text":
            text = entities.unescape(rest)
            n = len(text.split())
            blocks[-1].append(text)
            if n:
                places.append(len(blocks) - 1)
                scores.append(n * words.get(box, 1.0))
            continue
        if name == "br":
            blocks[-1].append(" ")
        if name in BLOCKS:
            if blocks[-1]:
                blocks.append([])
            if name not in ARTICLE:
                box = name if kind == "open" else ""
        places.append(len(blocks) - 1)
        scores.append(-0.05 if name in ARTICLE else tag.get(name if name in KNOWN else CUSTOM, -0.5))
    first, last = best_run(scores)
    if last < first:
        return ""
    chosen = blocks[places[first] : places[last] + 1]
    return "\n\n".join(t for b in chosen if (t := " ".join("".join(b).split())))


def learned(pages: DataFrame, html_col: str = "html") -> dict[str, dict[str, float]]:
    """Weights from all pages whose markup names an article; a task hands on one row a tag."""
    schema = pa.schema([("what", pa.string()), ("name", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])

    def count(batches):
        total: Counter = Counter()
        for b in slices(batches, "html"):
            for page in b.column("html").to_pylist():
                total.update(counts(page))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], schema.types[i]) for i in range(3)] + [pa.array(list(total.values()), pa.int64())], schema=schema)

    labelled = pages.select(pages[html_col].cast("string").alias("html")).where(F.col("html").rlike("(?i)<(article|main)\\b"))
    rows = labelled.mapInArrow(count, "what string, name string, inside boolean, n long").groupBy("what", "name", "inside").agg(F.sum("n").alias("n"))
    return weights_of(Counter({(r["what"], r["name"], r["inside"]): r["n"] for r in rows.collect()}))


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)
    weights = learned(pages, html_col)
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches):
        for b in slices(batches, "html"):
            texts = [extract(p, weights) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
