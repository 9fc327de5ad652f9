"""Main text of web pages as the maximum-scoring run of tokens.

A page is cut into tags and words. Words score by the block they stand in and
whether they are in a link, on pages whose markup names the main text
(``article``, ``main``) by whether they are inside it; tags score by their name.
A linear scan finds the contiguous run with the largest sum. All weights are log
odds learned from labelled pages: pages with just one ``article`` or ``main``
element, counted by Spark on a bounded sample of them. No boundary is fixed: the
sums alone say where the run begins and ends (words between two articles cost
little, so both stay unless much text lies between them).

Inside the run, elements that are no text of the article are left out by weight
too: menus, asides, forms and the like, and each class, id or role name, have the
log odds of the words under them, on top of a prior for names that say menu,
advert, sidebar, notice, comments and so on. An element whose weight is OTHER_AT or less is
left out, but never for its class, id or role if it holds an ``article`` or
``main`` element. Scripts, styles and the like are no text. Character references
are decoded, white space inside a block becomes one space, blocks are joined by
one line end in page order; nothing is shortened.

Work is linear in the length of a page, whatever its markup.

Defined results: a null or empty page, and one without words, has the empty
text; markup that is never closed ends with the page, or for a left-out element
(one whose start and end tags don't pair up) at the next heading, article or
footer; text is never cut whatever its length. Repeated rows give equal texts; an
empty table gives an empty table; other columns are kept, but for one with the
name of the new column, which is replaced.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.session import small_batches

#: Labelled pages that the fit reads at most.
MAX_LABELLED = 2_000
#: Largest log odds of any other token.
LIMIT = 4.0
#: Weights of a word (outside links) and of a tag or a word in a link whose class no labelled page has.
UNSEEN_WORD, UNSEEN_TAG = 1.0, -0.5
#: Classes of the words inside and outside the region that the markup of a page names, their weights
#: where no page is labelled, and the most that a word outside costs: text between articles is cheap.
INSIDE, OUTSIDE = "in", "out"
UNSEEN_INSIDE, LEAST_OUTSIDE = 1.0, -0.25
#: Weight at which an element is left out, the prior of names that say so, and words that a name needs to be learned.
OTHER_AT, OTHER_PRIOR, LEAST_WORDS = -1.0, -2.0, 50
#: Tags that stand in any text, and their weight where no labelled page has them.
TEXT_TAGS = frozenset(f"{e}{t}" for t in "p h1 h2 h3 h4 h5 h6 b i u em strong span br code small sub sup q cite blockquote pre li ul ol".split() for e in ("", "/"))
TEXT_TAG = -0.1

#: Fixed values of HTML: elements that start or end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Fixed values of HTML: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no text of the article, by prior.
LEFT_OUT = frozenset("head title nav footer aside form script style noscript template iframe object svg math canvas audio video button select textarea input menu dialog search".split())
#: Words of class, id or role that name something else than the article, by prior.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav menu navbar nav navigation breadcrumb breadcrumbs"
    " footer comment comments commentlist disqus replies cookie cookies consent gdpr banner notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended recommendations widget toolbar pagination pager complementary contentinfo".split()
)
#: Words that name something else only outside the article, and words beside them that name the article after all.
OUTER = frozenset("header masthead topbar copyright legal disclaimer".split())
OWN = frozenset("article post entry content story body main".split())
_STOPS = frozenset("h1 h2 h3 article main footer body html".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<own>(?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")
#: Elements that are left out even with an article inside.
_NEVER = LEFT_OUT - {"form"}

#: A token: kind ("w" text, "t" tag), class for the weights, text or tag name, and whether it is left out.
Token = tuple[str, str, str, bool]


def names_of(own: str) -> list[str]:
    """Class, id and role names in the attributes of a tag."""
    return [name for value in _NAMES.findall(own) for name in value.lower().strip("\"'").split()]


def _prior(name: str, inside: bool) -> float:
    parts = set(_PARTS.findall(name))
    return OTHER_PRIOR if parts & OTHER or (not inside and parts & OUTER and not parts & OWN) else 0.0


def _names_other(own: str, inside: bool, weights: dict[str, float]) -> bool:
    """Whether class, id or role names say that an element is no part of the article."""
    return any(_prior(name, inside) + weights.get(f".{name}", 0.0) <= OTHER_AT for name in names_of(own))


def _region_is_other(own: str) -> bool:
    """Whether an article or main element is named something else: by a whole name, or by the first word of one with no whole name beside it for the article."""
    names = set(names_of(own))
    if names & OTHER:
        return True
    first = {m[0] for name in names if (m := _PARTS.search(name))}
    return not names & OWN and bool(first & OTHER)


def _marks(page: str) -> tuple[list[re.Match], str]:
    """Matches of tags, comments and raw elements in order, and the text behind the last one.

    Nothing behind the last ``>`` can be a tag, so no search runs to the page's end in vain.
    """
    end = page.rfind(">") + 1
    found = list(_TOKEN.finditer(page, 0, end))
    rest = page[found[-1].end() if found else 0 :]
    if found and found[-1].end() == end and len(page) > end:
        last = found[-1][0]
        if (found[-1]["raw"] and not re.search(rf"</{found[-1]['raw']}\s*>$", last, re.I)) or (last.startswith("<!--") and not last.endswith("-->")):
            rest = ""  # a comment or raw element that is never closed
    return found, rest.partition("<!--")[0]


def _closings(found: list[re.Match]) -> tuple[dict[int, int], list[int]]:
    """The end tag (as a place in the page) of each element by its start tag's end, and the places of article and main start tags."""
    opened: dict[str, list[int]] = defaultdict(list)
    closed: dict[int, int] = {}
    regions: list[int] = []
    for m in found:
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if not m["end"]:
            opened[name].append(m.end())
            if name in ("article", "main"):
                regions.append(m.start())
        elif opened[name]:
            closed[opened[name].pop()] = m.start()
    return closed, regions


def tokens(page: str, weights: dict[str, float] | None = None) -> list[Token]:
    """Tags and texts of a page in order."""
    weights = weights or {}
    found, rest = _marks(page)
    closed, regions = _closings(found)
    out: list[Token] = []
    at = 0
    block, link = "", False
    skip, depth, close_at = "", 0, -1
    inside = 0
    for m in found:
        if m.start() > at:
            out.append(("w", f"w {block}{' a' if link else ''}", page[at : m.start()], bool(skip)))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        ends = m["end"] == "/"
        if skip and close_at < 0 and name in _STOPS and name != skip:
            skip = ""  # never closed: the element ends here
        if skip:
            if name == skip:
                depth += -1 if ends else 1
                if depth == 0:
                    skip = ""
                    out.append(("t", f"/{name}", name, True))
                    block = f"/{name}"
                    continue
        elif not ends and name not in VOID and name not in ("html", "body", "article", "main"):
            prior = OTHER_PRIOR if name in LEFT_OUT or (name == "header" and not inside) else 0.0
            other = prior + weights.get(f"<{name}", 0.0) <= OTHER_AT
            by_tag = other
            if not other and m["own"]:
                other = _names_other(m["own"], inside > 0, weights)
            if other:
                close_at = closed.get(m.end(), -1)
                spot = bisect_left(regions, at)
                holds = close_at >= 0 and spot < len(regions) and regions[spot] < close_at
                if not holds or (by_tag and (name in _NEVER or name == "header")):
                    skip, depth = name, 1
        elif not ends and name in ("article", "main") and m["own"] and _region_is_other(m["own"]):
            skip, depth = name, 1
            close_at = 0
        if name in ("article", "main"):
            inside = max(0, inside + (-1 if ends else 1)) if not skip else inside
        out.append(("t", ("/" if ends else "") + name, name, bool(skip)))
        if name == "a":
            link = not ends
        elif name in BLOCKS:
            block = ("/" if ends else "") + name
    if rest:
        out.append(("w", f"w {block}{' a' if link else ''}", rest, bool(skip)))
    return out


def named_words(page: str) -> list[tuple[str, int, bool]]:
    """For each element name (``<name``) and class, id or role name (``.name``): words under it, and whether they are in the page's region.

    Words under an element that is left out by prior count as outside.
    """
    found, rest = _marks(page)
    held: list[tuple[str, set[str], bool]] = []
    region = 0
    out: list[tuple[str, int, bool]] = []
    at = 0

    def count(text: str) -> None:
        n = len(text.split())
        if n:
            within = region > 0 and not any(other for _, _, other in held)
            out.extend((name, n, within) for name in set().union(*(names for _, names, _ in held)))

    for m in found:
        if m.start() > at:
            count(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in ("article", "main"):
            region = max(0, region + (-1 if m["end"] else 1))
        elif name in VOID or (name in TEXT_TAGS and not m["own"]):
            continue
        elif m["end"]:
            for k in range(len(held) - 1, max(-1, len(held) - 64), -1):
                if held[k][0] == name:
                    del held[k:]
                    break
        elif len(held) < 64:  # deeper elements have the names of those around them
            names = {f".{x}" for x in names_of(m["own"] or "")}
            other = name in LEFT_OUT or any(_prior(x[1:], region > 0) < 0 for x in names)
            if name in LEFT_OUT or name == "header":  # plain containers and links have no names of their own
                names.add(f"<{name}")
            held.append((name, names, other))
    count(rest)
    return out


def labelled_region(found: list[Token]) -> tuple[int, int] | None:
    """First and last token of the only article (else main) element, if there is just one."""
    for name in ("article", "main"):
        opens = [i for i, t in enumerate(found) if t[1] == name and not t[3]]
        ends = [i for i, t in enumerate(found) if t[1] == f"/{name}" and not t[3]]
        if len(opens) == 1 and len(ends) == 1 and opens[0] < ends[0]:
            return opens[0], ends[0]
    return None


def learn_weights(pages: DataFrame, html_col: str = "html", max_labelled: int = MAX_LABELLED) -> dict[str, float]:
    """Log odds of each class of tokens and of each name, from up to ``max_labelled`` labelled pages (by hash of the page).

    Counts are summed by Spark; names with fewer than LEAST_WORDS words are left
    to their priors, so the weights that reach the driver are bounded by the sample.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                count_page(page, *counts)
        names = sorted({*counts[0], *counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], ["class", "within", "without"])

    marked = pages.where(F.lower(F.col(html_col)).rlike("<(article|main)[\\s>]")).select(html_col, F.xxhash64(html_col).alias("h"))
    # the sample's hashes alone are brought together, the pages stay where they are
    last = marked.select("h").orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
    sample = marked.where(F.col("h") <= (last if last is not None else 0)).select(html_col)
    counts = sample.mapInArrow(run, "class string, within long, without long").groupBy("class").agg(F.sum("within").alias("i"), F.sum("without").alias("o"))
    rows = counts.where((F.col("i") + F.col("o") >= LEAST_WORDS) | ~F.substring("class", 1, 1).isin(".", "<")).collect()
    return weights_of({r["class"]: (r["i"], r["o"]) for r in rows})


def count_page(page: str, within: Counter, without: Counter) -> None:
    """Add the tokens and names of a labelled page, inside and outside its region."""
    found = tokens(page)
    region = labelled_region(found)
    if region is None:
        return
    for i, (kind, own, text, out) in enumerate(found):
        if out:  # never part of a run
            continue
        n = 1 if kind == "t" else len(text.split())
        is_in = region[0] <= i <= region[1]
        (within if is_in else without)[own] += n
        if kind == "w":
            (within if is_in else without)[INSIDE if is_in else OUTSIDE] += n
    for name, n, is_in in named_words(page):
        (within if is_in else without)[name] += n


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds with add-one smoothing, LIMIT at most."""
    tokens_in, tokens_out = 1, 1
    for k, (i, o) in counts.items():
        if k[0] not in ".<" and k not in (INSIDE, OUTSIDE):
            tokens_in, tokens_out = tokens_in + i, tokens_out + o
    # all words: those of left-out elements count outside
    words_in = max([tokens_in, *(i for k, (i, _) in counts.items() if k[0] in ".<")])
    words_out = max([tokens_out, *(o for k, (_, o) in counts.items() if k[0] in ".<")])
    out = {}
    for k, (i, o) in counts.items():
        whole_in, whole_out = (words_in, words_out) if k[0] in ".<" else (tokens_in, tokens_out)
        out[k] = max(-LIMIT, min(LIMIT, math.log((i + 1) / whole_in) - math.log((o + 1) / whole_out)))
    for k in out:
        if k[0] in ".<":
            continue
        if k.startswith("w "):
            # words of paragraphs are text wherever they stand
            out[k] = max(out[k], 0.25) if k.split()[1:] in (["p"], ["/p"], ["h1"], ["h2"], ["h3"], ["blockquote"], ["pre"], ["li"]) else out[k]
        elif k not in (INSIDE, OUTSIDE, "article", "main"):
            out[k] = min(out[k], -0.1)  # tags cost something even in text
    for k in ("article", "main"):  # they name text on pages of any kind
        out[k] = max(out.get(k, 0.0), UNSEEN_INSIDE)
    out[INSIDE] = max(out.get(INSIDE, 0.0), UNSEEN_INSIDE)
    out[OUTSIDE] = max(min(out.get(OUTSIDE, LEAST_OUTSIDE), -0.01), LEAST_OUTSIDE)
    return out


def token_weights(found: list[Token], weights: dict[str, float]) -> list[float]:
    """The weight of each token; left-out ones have none."""
    named = any(kind == "t" and own in ("article", "main") and not out for kind, own, _, out in found)
    opened: list[str] = []
    held = Counter()
    result = []
    for kind, own, text, out in found:
        if out:
            result.append(0.0)
        elif kind == "t":
            if text in ("article", "main"):
                if own == text:
                    opened.append(text)
                    held[text] += 1
                elif held[text]:
                    while True:  # an element ends those inside it that were never closed
                        held[last := opened.pop()] -= 1
                        if last == text:
                            break
                result.append(weights.get(own, 0.0) if own == text else 0.0)
            else:
                result.append(0.0 if named else weights.get(own, TEXT_TAG if own in TEXT_TAGS else UNSEEN_TAG))
        else:
            if named:
                weight = weights[INSIDE if opened else OUTSIDE]
            else:
                weight = weights.get(own, UNSEEN_TAG if own.endswith(" a") else UNSEEN_WORD)
            result.append(len(text.split()) * weight)
    return result


def best_run(values: list[float]) -> tuple[int, int]:
    """First token and end of the run with the largest sum, (0, 0) where no sum is positive; of equal sums the first, and of these the longest to the left."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, value in enumerate(values):
        total += value
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def blocks_text(found: list[Token]) -> str:
    """Blocks of the tokens that aren't left out, one to a line."""
    lines: list[str] = []
    held: list[str] = []

    def close() -> None:
        line = " ".join(html.unescape("".join(held)).split())
        if line:
            lines.append(line)
        held.clear()

    for kind, _, text, out in found:
        if kind == "t" and (text in BLOCKS):
            close()
        elif out:
            continue
        elif kind == "t":
            if text == "br":
                held.append(" ")
        else:
            held.append(text)
    close()
    return "\n".join(lines)


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = tokens(page, weights)
    first, end = best_run(token_weights(found, weights))
    return blocks_text(found[first:end])


def extract_main_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Add ``out_col``, the main text of each page (a column of that name is replaced). No shuffle."""
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def extract(found: pa.Array) -> pa.Array:
        return pa.array([main_text(p, weights) for i in range(0, len(found), 256) for p in found.slice(i, 256).to_pylist()], pa.string())

    return pages.withColumn(out_col, extract(F.col(html_col)))
