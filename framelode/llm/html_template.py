"""Main text of web pages by template deduction.

Tokens are element paths, and texts at their paths. Over all distinct pages of a host, tokens with equal vectors of
occurrences are an equivalence class; a vector is known by its hashes of page and count, combined bit by bit. The class
that occurs once in every page is the template's skeleton; the others, which occur on some pages or several times, are
nested in it. The text that follows a token of a class is a slot: slots that hold the same texts again and again, or links,
belong to the template, and a nested class of such slots goes as a whole. What the other slots hold is the pages' own.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Distinct pages of its host that a text recurs on, and a path is judged from, at least; share of recurring or linked
#: characters over which a slot or class belongs to the template; share of pages from which a text does so wherever it stands;
#: distinct pages from which the template may take something out of an article's place.
RECURS, MOSTLY, CONSTANT, SURE = 3, 0.5, 0.6, 8
#: Pages of a host that a task reads in a row, at least and as a share of all: larger hosts are split over tasks.
RUN, RUN_SHARE = 1000, 4096
#: Elements that end a block, that stand alone, that hold no readable text, that are closed by a following one.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "noembed", "noframes", "xmp")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
#: Elements, roles and words of class or id that mark what isn't the article.
ASIDE = frozenset("head nav footer aside form menu dialog button select fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended share sharing social cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond response responses discussion disqus footer masthead copyright disclaimer skip toolbar pagination pager feedback".split()
)
#: Cues that are common words too: they mark an element only if they name it, as the last word that isn't a plain one.
WEAK = frozenset("alert banner copyright disclaimer feedback login modal notice notices notification notifications overlay promotion recommended related reply respond response responses share shared sharing signup skip social subscription toolbar widget widgets".split())
PLAIN = frozenset("area bar block body bottom box button buttons center col column container content count counter feed form grid group header heading holder icon icons info inner item items label left link links list main media message messages panel popup post posts prompt right row section slot tab tabs text this title top unit us wrap wrapper zone".split())
ATTRIBUTES = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+""")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def hashed(*parts: str | int) -> int:
    """A long that stands for parts."""
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass
class Page:
    """Elements as parent, name, path (a long that stands for names and classes from the root on) and flag, and blocks as
    (element, text, characters in links) in the order of the page."""

    parents: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def path(self, element: int) -> int:
        return self.paths[element] if element >= 0 else 0


def cued(tokens: list[str], cues: frozenset) -> bool:
    """Whether one of the tokens holds a cue; of the weak ones only the word that names the element, so a share-price is no share."""
    for t in tokens:
        words = [w.lower() for w in WORDS.findall(t) if len(w) > 1 and not w.isdigit()]
        if any(w in cues and w not in WEAK for w in words):
            return True
        while len(words) > 1 and words[-1] in PLAIN:
            words.pop()
        if words and words[-1] in cues:
            return True
    return False


#: Marks of an article element that isn't the page's own.
OTHERS = frozenset("comment comments reply related sponsored advert ad".split())


def _flag(name: str, rest: str) -> tuple[str, int]:
    """The class as it stands in a path, and 1 if element, role or words of class and id mark it, 2 if it is the article's place."""
    found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
    label = f".{'.'.join(sorted(found['class'].split()))}" if found.get("class") else ""
    tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
    if name in ("article", "main") or found.get("role", "").lower() in ("main", "article"):
        return label, 1 if cued(tokens, OTHERS) else 2
    if name in ASIDE or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return label, 1
    return label, 3 if cued(tokens, CUES) else 4 if name == "header" or any("header" in WORDS.findall(t.lower()) for t in tokens) else 0


def parse(source: str) -> Page:
    """Elements and text blocks of a page, whatever its markup is like; scripts, styles and comments are left out.

    The work is in proportion to the page: what has no end (a quote, a comment, an element without text of its own) is
    searched for once. After a tag that doesn't end because of a quote, tags end at their first ">".
    """
    page = Page()
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    parts: list[str] = []
    linked, at, text_at = 0, 0, -1
    strict, endless = True, set()

    def flush() -> None:
        nonlocal parts, linked, text_at
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append((text_at, text, linked))
            parts, linked, text_at = [], 0, -1

    def say(raw: str) -> None:
        nonlocal linked, text_at
        if raw:
            said = html.unescape(raw) if "&" in raw else raw
            parts.append(said)
            if opened["a"]:
                linked += len(said)
            if text_at < 0 and not said.isspace():
                text_at = stack[-1][1] if stack else -1

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    def close(names: set[str], scopes: set[str] = frozenset()) -> None:
        """Close the innermost open element of these names, unless one of scopes is inside of it."""
        if any(opened[n] for n in names):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in scopes:
                    return
                if stack[depth][0] in names:
                    return pop_to(depth)

    def after(mark: str, begin: int) -> int:
        """Where the next mark ends, or -1."""
        found = -1 if mark in endless else source.find(mark, begin)
        if found < 0:
            endless.add(mark)
        return found + len(mark) if found >= 0 else -1

    end = len(source)
    while at < end:
        begin = source.find("<", at)
        if begin < 0:
            say(source[at:])
            break
        say(source[at:begin])
        m = NAME.match(source, begin + 1)
        if not m:
            if source.startswith("<!--", begin):
                at = after("-->", begin + 4)
                at = end if at < 0 else at
                continue
            stop = after("]]>", begin) if source.startswith("<![CDATA[", begin) else -1
            if stop < 0 and source[begin + 1 : begin + 2] in ("!", "?"):
                stop = after(">", begin)
            if stop < 0:
                say("<")
            at = stop if stop >= 0 else begin + 1
            continue
        stop = ATTRIBUTES.match(source, m.end()).end() if strict else -1
        if stop < 0 or source[stop : stop + 1] != ">":
            strict = False
            stop = after(">", m.end()) - 1
            if stop < 0:
                say("<")
                at = begin + 1
                continue
        at, name, rest = stop + 1, m[2].lower(), source[m.end() : stop]
        if m[1]:
            if name in BLOCKS:
                flush()
            close({name})
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            close({"p"})  # a block ends an open paragraph
        if name in CLOSES:
            close(CLOSES[name], SCOPES[name])
        if name in RAW:
            found = None if name in endless else re.compile(rf"</{name}\s*+>", re.IGNORECASE).search(source, at)
            if not found:
                endless.add(name)
            at = found.end() if found else (end if name in ("script", "style") else at)
            continue
        if name in VOID or rest.endswith("/") and name not in BLOCKS:
            continue
        label, flag = _flag(name, rest)
        parent = stack[-1][1] if stack else -1
        page.parents.append(parent)
        page.names.append(name)
        page.paths.append(hashed(page.path(parent), name + label))
        page.flags.append(flag)
        stack.append((name, len(page.parents) - 1))
        opened[name] += 1
    flush()
    return page


def judged(page: Page) -> list[int]:
    """For each element 1 if it or one above it is marked, 2 if it lies in the article's place, else 0.

    Words of class or id don't mark an element that holds an unmarked article's place, and a header inside it stays.
    """
    holds = [f == 2 for f in page.flags]
    for i in range(len(page.parents) - 1, -1, -1):
        if holds[i] and page.flags[i] != 1 and page.parents[i] >= 0:
            holds[page.parents[i]] = True
    out: list[int] = []
    for i, (parent, flag) in enumerate(zip(page.parents, page.flags, strict=True)):
        above = out[parent] if parent >= 0 else 0
        if above == 1 or flag == 1 or flag == 3 and not holds[i] and page.names[i] not in ("html", "body") or flag == 4 and above != 2 and not holds[i]:
            out.append(1)
        else:
            out.append(2 if above == 2 or flag == 2 else 0)
    return out


def tokens(page: Page) -> list[tuple[int, int | None, int, int, int]]:
    """(path, text or None, times, characters, linked ones) of the tokens of a page; path 0 stands for the page itself."""
    out = [(0, None, 1, 0, 0), *((path, None, n, 0, 0) for path, n in Counter(page.paths).items() if path)]
    texts: dict[tuple[int, int], list[int]] = {}
    for element, text, linked in page.blocks:
        own = texts.setdefault((page.path(element), hashed(text)), [0, 0, 0])
        own[0] += 1
        own[1] += len(text)
        own[2] += linked
    return out + [(*key, *own) for key, own in texts.items()]


def classes(rows: DataFrame) -> DataFrame:
    """rows (host, html) -> host (a long), path, text (null: the path itself), pages, most, vector, chars, linked.

    Tokens with equal vectors are one class: the vector combines hashes of page and count over the distinct pages. pages
    are the distinct pages that hold the token, and most is the largest count on one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = source.as_py() or ""
                key = xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass")) - (1 << 63)
                out += [(host, key, *t) for t in tokens(parse(source))]
                if len(out) > 50_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    names = ["host", "page", "path", "text", "times", "chars", "linked"]
    packed = lambda out: pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=names)
    seen = rows.select("host", "html").mapInArrow(run, ", ".join(f"{n} long" for n in names)).distinct()
    whole = lambda c: F.sum(c).alias(c)
    return seen.groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("pages"), F.max("times").alias("most"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), whole("chars"), whole("linked"))


def templates(rows: DataFrame) -> DataFrame:
    """rows (host, html) -> host, path, text, sure: what belongs to the template, a row each. Null text: the path's slot; else
    the text at the path. sure: in an article's place too.

    A path is judged from RECURS pages on, at every size of its host. Texts that don't recur are summed up by path before
    anything is written or meets the host's number of pages, so a host with very many pages is a few rows for each of its
    paths. An article's place is trusted as far as it goes: only a text that stands at its path on most of the host's pages
    (SURE at least), and slots that are mostly links which recur, are taken out of it; a passage that some pages share stays.
    """
    often, whole = F.col("pages") >= RECURS, F.col("text").isNull()
    few = classes(rows).select("host", "path", whole.alias("own"), F.when(often, F.col("text")).alias("text"), "pages", "most", "vector", "chars", "linked")
    few = few.groupBy("host", "path", "own", "text").agg(*[F.max(c).alias(c) for c in ("pages", "most", "vector")], *[F.sum(c).alias(c) for c in ("chars", "linked")])
    found = settle(few, "tokens")
    sizes = found.where("own and path = 0").select(F.col("host").alias("of"), F.col("pages").alias("total"))
    sized = lambda df: df.join(sizes, F.col("host") == F.col("of")).drop("of")
    sure = F.col("pages") >= SURE
    constants = sized(found.where("text is not null")).where(F.col("pages") >= CONSTANT * F.col("total")).select("host", "path", "text", sure.alias("sure"))
    amount = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    of_path = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    slots = found.where("path <> 0").groupBy("host", "path").agg(of_path("pages"), of_path("most"), of_path("vector"), amount("chars", "chars"), amount(F.when(F.col("text").isNotNull(), F.col("chars")), "recurring"), amount("linked", "linked"))
    slots = sized(slots.where(F.col("pages") >= RECURS))
    mostly = lambda chars, part: F.col(part) > MOSTLY * F.col(chars)
    # the skeleton's slots are judged one by one, those of a nested class together too
    nested = slots.where("pages < total or most > 1").groupBy("host", "vector").agg(F.sum("chars").alias("all"), F.sum("recurring").alias("of_it"))
    nested = nested.where(mostly("all", "of_it")).select(F.col("host").alias("at"), F.col("vector").alias("kind"))
    both = slots.join(nested, (F.col("host") == F.col("at")) & (F.col("vector") == F.col("kind")), "left")
    fixed = both.where(F.col("kind").isNotNull() | mostly("chars", "recurring") | mostly("chars", "linked"))
    fixed = fixed.select("host", "path", F.lit(None).cast("long").alias("text"), (sure & mostly("chars", "recurring") & mostly("chars", "linked")).alias("sure"))
    return fixed.unionByName(constants)


def content(page: Page, known: dict[tuple[int, int | None], bool]) -> str:
    """The page's text: the blocks in the article's place, if it has one, else those of all slots, without what the template
    has: known maps (path, text or None) to whether it goes from an article's place too.

    Elements, roles and words of class or id that mark what isn't the article are left out in either case.
    """
    marks = judged(page)
    mark = lambda element: marks[element] if element >= 0 else 0
    placed = [b for b in page.blocks if mark(b[0]) == 2]
    out = []
    for element, text, _ in placed or [b for b in page.blocks if mark(b[0]) == 0]:
        path = page.path(element)
        if known:
            ways = (known.get((path, None)), known.get((path, hashed(text))))
            if any(ways) if placed else ways != (None, None):
                continue
        out.append(text)
    return "\n".join(out)


def main_text(source: str | None) -> str:
    """Text of a page of which no other page of its host is known."""
    return content(parse(source or ""), {})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages (page_id, url, html).

    Null html is an empty page, whose text is empty; a null url is a host of its own; rows may repeat. The template of a
    host comes from all its distinct pages by partial aggregation, so results depend neither on how rows are dealt nor on
    copies. A task reads the rows of a host's template, then the host's pages one after the other; hosts of many pages are
    dealt over tasks, each of which gets the template, and at most RUN_SHARE hosts are that large. An empty table gives an
    empty one.
    """
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit("")))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    run_of = max(RUN, total // RUN_SHARE)
    large = F.broadcast(counts.where(F.col("n") > run_of).select("host", F.ceil(F.col("n") / run_of).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    kind = pages.schema["page_id"].dataType.simpleString()
    dealt = rows.join(large, "host", "left").select("host", F.pmod(F.xxhash64("html", "page_id"), parts).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("path"), F.lit(None).cast("long").alias("text"), F.lit(None).cast("boolean").alias("sure"), "page_id", "url", "html")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("page_id", kind), ("url", "string"), ("html", "string"))]
    known = templates(rows).join(large, "host", "left").select("host", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("kind"), "path", "text", "sure", *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                at, texts = [], []
                for i, (host, part, kind, path, text, sure) in enumerate(zip(*(some.column(k).to_pylist() for k in range(6)), strict=True)):
                    if (host, part) != now:
                        now, known = (host, part), {}
                    if kind == 0:
                        known[path, text] = sure
                    else:
                        at.append(i)
                        texts.append(content(parse(some.column(8)[i].as_py() or ""), known))
                if at:
                    taken = pa.array(at, type=pa.int64())
                    yield pa.RecordBatch.from_arrays([some.column(6).take(taken), some.column(7).take(taken), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ordered = known.unionByName(dealt).repartition("host", "part").sortWithinPartitions("host", "part", "kind")
    return ordered.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
