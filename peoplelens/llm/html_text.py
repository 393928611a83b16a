"""Main text of web pages by a site style tree.

Every page is read into its elements once. The pages of a host share one tree, whose nodes are paths of elements (tag, classes, id).
For each node the tree holds the number m of pages that have it, how often each style (sequence of child elements, runs
taken once) occurs, and on how many pages k each of its texts stands. With l styles of shares p_i, and g = ``DECAY``:

    presentation = -sum p_i log_m p_i         content = 1 - mean over the node's different texts of log_m k
    importance   = (1 - g^l) presentation + g^l content         (1 where m = 1)

The tree judges every node of at least ``MIN_PAGES`` pages, those inside an article element like any other. Nodes with an importance below
``THRESHOLD`` are removed from every page of the host, and so are the single texts (content nodes) that tell less than ``MIN_BITS``
apart, log2(m / k): a notice that most pages repeat among paragraphs of their own. Copies of a page count as one, so that an article stored
many times is not taken for such a notice.

Entropies cannot tell an advert or a comment whose words differ on every page from an article, so elements that announce what they are
(navigation, footer, form, advert, comment ...) are removed by tag or name. On nodes of fewer pages the tree says nothing: there, what stands
outside an article or main element goes if the page's running text inside it is at least as long.

Nodes are 64-bit hashes of their paths, so deep pages cost no more than their elements. Statistics are sums per host and node, taken on each task first: a
host with a third of all pages costs no task more than its nodes.

Defined cases: NULL or empty html gives the empty text; a NULL or odd URL counts as the host ''. Unclosed elements end with their parent
or with the page; a tag that the page's end cuts off is dropped. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peoplelens.llm.common import staged

DECAY = 0.9
THRESHOLD = 0.5
MIN_BITS = 1.0
MIN_PAGES = 8

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time "
    "tt u var wbr br".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset("nav footer aside form button select menu dialog input optgroup option".split())
#: Words that class, id or role use for parts that are not the article.
NOISE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies copyright disqus footer form gdpr login menu menubar modal nav navbar navigation newsletter notice "
    "notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split())
#: Elements whose names describe the page, and beginnings of names that describe a state.
WHOLE = frozenset(("html", "body", "article", "main"))
STATES = ("has-", "has_", "no-", "no_", "with-", "with_", "without-", "is-", "is_")
HEADER_WORDS = frozenset("header masthead topbar".split())
#: An opening tag on the left ends an open element on the right; the search stops at the elements of BARRIERS.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
BARRIERS = frozenset("ul ol dl table select article section main div body aside nav footer header form blockquote".split())

NORMAL, NOISE, ARTICLE = 0, 1, 2  # kinds of a text


def child(parent: int, key: str) -> int:
    """The node of an element below a node; the page itself is node 0."""
    return int.from_bytes(blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8, salt=parent.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def node(path: str) -> int:
    """The node of a path such as ``/ul/li.menu``."""
    at = 0
    for key in path.split("/")[1:]:
        at = child(at, key)
    return at


def read_page(html: str | None) -> tuple[list[str], list[int], list[int], list[int], list[int]]:
    """(texts, their nodes, their kinds, nodes with child elements, their styles) of one page.

    A text is a block: character references decoded, white space one space, trimmed, never empty. A style is the hash of the node's children.
    """
    import re
    from html import unescape

    texts: list[str] = []
    paths: list[int] = []
    kinds: list[int] = []
    styles: dict[int, dict[int, None]] = {}
    known: dict[tuple[int, str], int] = {}
    if not html:
        return texts, paths, kinds, [], []
    pieces = re.compile(
        r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?=[/a-zA-Z])[^>]*(?:>|\Z)",
        re.DOTALL)
    names = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
    # Of an open element: tag, node, noise, inside an article, inside a header of one, inside a heading, its block (place in the stack), children.
    stack: list[tuple[str, int, bool, bool, bool, bool, int, list[str]]] = [("", 0, False, False, False, False, 0, [])]
    opened = Counter()
    block: list[str] = []

    def flush() -> None:
        if block:
            text = " ".join(unescape("".join(block)).split())
            block.clear()
            if text:
                tag, path, noise, article, header, heading, _, _ = stack[stack[-1][6]]
                noise = noise or (header and not heading)
                texts.append(text)
                paths.append(path)
                kinds.append(NOISE if noise else ARTICLE + (tag in RUNNING) if article else NORMAL)

    def close(at: int) -> None:
        if any(s[0] not in INLINE for s in stack[at:]):
            flush()
        for tag, path, *_, children in reversed(stack[at:]):
            opened[tag] -= 1
            if children and tag not in INLINE:
                runs = " ".join(c for i, c in enumerate(children) if not i or c != children[i - 1])
                styles.setdefault(path, {})[child(0, runs)] = None
        del stack[at:]

    at, end, low = 0, len(html), html.lower()
    while at < end:
        m = pieces.search(html, at)
        if not m:
            block.append(html[at:])
            break
        if m.start() > at and (not stack[-1][2] or stack[stack[-1][6]][2]):  # else inside an inline element of noise
            block.append(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if not m[0].endswith(">"):
            break  # the page ends inside this tag
        if tag == "br":
            block.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in RAW and not m[0].endswith("/>"):
            ending = re.compile(rf"</{re.escape(tag)}[\s/>]").search(low, at)
            found = ending.start() if ending else -1
            if found < 0 and tag == "head":
                continue
            at = end if found < 0 else found
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            closes = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1) if opened["p"] or any(opened[c] for c in closes) else ():
                open_tag = stack[i][0]
                if open_tag == "p" or open_tag in closes:
                    close(i)
                    break
                if open_tag in BARRIERS and open_tag not in closes:
                    break
        words: set[str] = set()
        label = ""
        for name, a, b, c in names.findall(m[3]):
            value = (a or b or c).lower()
            if tag not in WHOLE:
                words.update(w for token in value.split() if not token.startswith(STATES) for w in re.findall(r"[a-z]+", token))
            if name.lower() != "role":
                label += "." + ".".join(sorted(re.sub(r"\d+", "#", value).split()))
        parent = stack[-1]
        key = tag + label
        article = parent[3] or tag in ("article", "main")
        head = tag == "header" or bool(words & HEADER_WORDS)
        noise = parent[2] or tag in NOISE_TAGS or bool(words & NOISE_WORDS) or head and not parent[3]
        block_at = parent[6] if tag in INLINE else len(stack)
        if tag not in INLINE:
            stack[parent[6]][7].append(key)
        if (parent[1], key) not in known:
            known[parent[1], key] = child(parent[1], key)
        stack.append((tag, parent[1] if tag in INLINE else known[parent[1], key], noise, article, parent[4] or head and parent[3],
                      parent[5] or tag in HEADINGS, block_at, []))
        opened[tag] += 1
    flush()
    close(1)
    nodes = [(path, style) for path, found in styles.items() for style in found]
    return texts, paths, kinds, [n[0] for n in nodes], [n[1] for n in nodes]


def read_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, host, texts, paths, kinds, nodes, styles, hashes, page, row) of each page: the hashes of its texts, what copies of a page
    share (its texts that are not noise by name, and their nodes), and a number of its own."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    lists = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ("texts", "paths", "kinds", "nodes", "styles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [read_page(h.as_py()) for h in part.column(3)]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(lists)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["page_id", "url", "host", *names])

    kind = dict(pages.dtypes)
    read = source.mapInArrow(run, f"page_id {kind[page_id]}, url {kind[url]}, host string, texts array<string>, paths array<long>, "
                                  "kinds array<int>, nodes array<long>, styles array<long>")
    own = F.transform(F.filter(F.arrays_zip("paths", "texts", "kinds"), lambda x: x.kinds != NOISE), lambda x: F.struct(x.paths, x.texts))
    return read.withColumns({"hashes": F.transform("texts", lambda t: F.xxhash64(t)), "page": F.xxhash64(own),
                             "row": F.monotonically_increasing_id()})


def different(parsed: DataFrame) -> DataFrame:
    """One row of each set of copies of a page on a host, without the texts. Only sets of several are written and joined."""
    copies = staged(parsed.groupBy("host", "page").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
                    .select("host", "page", "first"), "copies")
    return (parsed.select("host", "page", "row", "paths", "kinds", "nodes", "styles", "hashes").join(copies, ["host", "page"], "left")
            .filter("first IS NULL OR row = first"))


def _texts_of(pages: DataFrame) -> DataFrame:
    """(host, row, pos, path, t, kind): one row per text, the text as a hash."""
    x = F.posexplode(F.arrays_zip(F.col("paths").alias("path"), F.col("hashes").alias("t"), F.col("kinds").alias("kind")))
    return pages.select("host", "row", x).select("host", "row", "pos", "col.*")


def content(pages: DataFrame) -> DataFrame:
    """(host, path, t, k, told, outside): on how many of the different pages each text of each node stands, whether it is anywhere not noise by
    name, and whether it is anywhere outside an article then."""
    once = pages.withColumns({"x": F.array_distinct(F.arrays_zip(F.col("paths").alias("path"), F.col("hashes").alias("t"), F.col("kinds").alias("kind")))})
    return once.select("host", F.explode("x").alias("x")).groupBy("host", "x.path", "x.t").agg(
        F.count("*").alias("k"), F.max(F.col("x.kind") != NOISE).alias("told"), F.max(F.col("x.kind") == NORMAL).alias("outside"))


def importance(pages: DataFrame, per_text: DataFrame | None = None, decay: float = DECAY) -> DataFrame:
    """(host, path, pages, presentation, content, importance) of each node that holds text, over ``different`` pages."""
    per_text = content(pages) if per_text is None else per_text
    logs = per_text.groupBy("host", "path").agg(F.avg(F.log("k")).alias("mean_log"))
    held = pages.select("host", F.explode(F.array_distinct("paths")).alias("path")).groupBy("host", "path").agg(F.count("*").alias("pages"))
    per_style = (pages.select("host", F.explode(F.arrays_zip("nodes", "styles")).alias("x"))
                 .groupBy("host", F.col("x.nodes").alias("path"), "x.styles").agg(F.count("*").alias("n")))
    style = per_style.groupBy("host", "path").agg(
        F.count("*").alias("l"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("spread"))
    log_m = F.log("pages")
    many = F.col("pages") > 1
    shares = F.pow(F.lit(decay), F.coalesce("l", F.lit(0)))
    return (held.join(logs, ["host", "path"]).join(style, ["host", "path"], "left")
            .withColumn("content", F.when(many, 1 - F.col("mean_log") / log_m).otherwise(1.0))
            .withColumn("presentation", F.when(many, F.least(F.coalesce("spread", F.lit(0.0)) / log_m, F.lit(1.0))).otherwise(1.0))
            .select("host", "path", "pages", "presentation", "content",
                    F.when(many, (1 - shares) * F.col("presentation") + shares * F.col("content")).otherwise(1.0).alias("importance")))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD,
              min_bits: float = MIN_BITS, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_removed): blocks of the article in page order, joined by one space.

    The tree's verdicts on texts are written first, so that their measured size decides how they are joined; only texts that are removed,
    or that the tree cannot judge, meet the pages again.
    """
    parsed = staged(read_pages(pages, page_id, url, html), "parsed")
    once = different(parsed)
    per_text = staged(content(once), "content")
    nodes = staged(importance(once, per_text), "nodes")
    judged = F.col("pages") >= min_pages
    low = judged & ((F.col("importance") < threshold) | (F.log2(F.col("pages") / F.col("k")) < min_bits))
    verdicts = staged(per_text.filter("told").join(nodes, ["host", "path"])
                      .select("host", "path", "t", low.alias("low"), (~judged & F.col("outside")).alias("rare")).filter("low OR rare"), "verdicts")
    marks = (_texts_of(parsed).join(verdicts, ["host", "path", "t"])
             .filter(F.col("low") | (F.col("kind") == NORMAL))
             .groupBy("row").agg(F.collect_set(F.when(F.col("low"), F.col("pos"))).alias("low"),
                                 F.collect_set(F.when(F.col("rare"), F.col("pos"))).alias("rare")))
    marks = staged(marks, "marks")
    none = F.array().cast("array<int>")
    blocks = F.transform(F.arrays_zip("texts", "kinds"), lambda b, i: F.struct(
        b.texts.alias("text"),
        F.when((b.kinds == NOISE) | F.array_contains("low", i), NOISE).otherwise(b.kinds).alias("kind"), F.array_contains("rare", i).alias("rare")))
    length = lambda keep: F.aggregate(F.filter("blocks", keep), F.lit(0).cast("long"), lambda a, b: a + F.length(b.text))
    outside = lambda b: b.rare & (b.kind == NORMAL)
    kept = (parsed.select("row", "page_id", "url", "texts", "kinds").join(marks, "row", "left")
            .withColumns({"low": F.coalesce("low", none), "rare": F.coalesce("rare", none)})
            .select("page_id", "url", blocks.alias("blocks"))
            .withColumns({"inside": length(lambda b: b.kind > ARTICLE), "beside": length(outside)})
            .withColumn("article", (F.col("inside") > 0) & (F.col("inside") >= F.col("beside")))
            .withColumn("main", F.filter("blocks", lambda b: (b.kind != NOISE) & ~(F.col("article") & outside(b)))))
    text = F.array_join(F.transform("main", lambda b: b.text), " ")
    return kept.select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"),
                       (F.coalesce(F.size("blocks"), F.lit(0)) - F.coalesce(F.size("main"), F.lit(0))).alias("n_removed")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
