"""HTML extraction by line-block distribution.

Markup is stripped into lines, one per block element. A line's weight is the
length of its text outside links. Sums of weights over sliding windows of lines
cut the page into blocks: a block ends where the sum dives to zero, and it
surges if some sum in it reaches a share of the page's greatest. The lines of
blocks that surge are kept.

Elements and class names that stand for boilerplate only take a line out (its
weight is zero and it is never kept); they never choose what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, read_table

#: Elements whose text is never main text.
VOID_TEXT = "aside button canvas dialog figcaption footer form head header iframe label menu nav noscript object option script select style svg template textarea title"
#: Elements that break a line.
BLOCKS = "address article blockquote body br caption center dd details div dl dt fieldset figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead title tr ul"
#: Words that mark an element as no main text where a class, id or role consists of them alone.
MARKS = "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget"
#: Words that may stand beside a mark and say nothing of their own.
FILLERS = "area article articles bar block blocks body bottom box buttons center column container content entry first form global icons inner item items last left links list main media mobile outer page panel post posts primary reader right secondary section site slot text top user widgets wrap wrapper"
#: Elements that have no end tag, and elements whose content is text up to their end tag.
EMPTY = "area base br col embed hr img input link meta param source track wbr"
RAW = "iframe noembed noframes script style textarea title xmp"
#: What an element's start tag ends if it is the innermost open block; other blocks end a paragraph.
ENDS = {"li": "p li", "dt": "p dt dd", "dd": "p dt dd", "td": "p td th", "th": "p td th", "tr": "p td th tr", "option": "option"}
#: Share of the page's greatest sum that a block has to reach.
SURGE = 0.2


def tags(html: str) -> Iterator[tuple]:
    """Pieces of a page: ("text", text) or ("tag", name, closing, whether it closes itself, class, id and role).

    Follows the HTML tokenizer where it matters: quotes count after an equals
    sign only, comments and script-like elements reach to their end or the
    page's. Time is linear: no search for an end is repeated that failed once.
    """
    import re

    start = re.compile(r"[a-zA-Z][^\s/>]*")
    stop, bare, space = re.compile("[>=]"), re.compile(r"[^\s>]*"), re.compile(r"\s*")
    raw = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW.split()}
    ends = {c: html.rfind(c) for c in "\"'>"}
    begin, at, size = 0, 0, len(html)  # text from ``begin`` on is not yielded yet
    while at < size:
        lt = html.find("<", at)
        if lt < 0 or lt > ends[">"] and not html.startswith("<!--", lt):
            break  # no tag ends any more
        nxt = html[lt + 1 : lt + 3]
        if html.startswith("<!--", lt):
            if lt > begin:
                yield "text", html[begin:lt]
            end = html.find("-->", lt + 4)
            short = html[lt + 4 : lt + 6]
            begin = at = lt + 5 if short[:1] == ">" else lt + 6 if short == "->" else size if end < 0 else end + 3
            continue
        closing = nxt[:1] == "/"
        m = start.match(html, lt + 1 + closing)
        if not m and nxt[:1] not in ("!", "?") and not (closing and len(nxt) > 1):
            at = lt + 1  # a lone sign
            continue
        if lt > begin:
            yield "text", html[begin:lt]
        if not m:
            begin = at = html.find(">", lt) + 1
            continue
        name, p, marks = m[0].lower(), m.end(), []
        while True:
            hit = stop.search(html, p)
            if not hit:
                at = size
                break
            i = hit.start()
            if hit[0] == ">":
                at = i + 1
                break
            key = html[max(p, i - 40) : i].split()[-1:]
            v = space.match(html, i + 1).end()
            quote = html[v : v + 1]
            if quote in ("'", '"') and quote and v < ends[quote]:
                p = html.find(quote, v + 1) + 1
                value = html[v + 1 : p - 1]
            else:
                p = bare.match(html, v).end()
                value = html[v:p]
            if key and key[0].lower() in ("class", "id", "role"):
                marks.append(value)
        yield "tag", name, closing, html[at - 2 : at - 1] == "/", " ".join(marks).lower()
        if name in raw and not closing and at < size:
            end = raw[name].search(html, at)
            at = end.start() if end else size
        begin = at
    if begin < size:
        yield "text", html[begin:]


def marked(words: str, cache: dict) -> bool:
    """Whether one of some class names consists of MARKS, with FILLERS and numbers at most beside them."""
    import re

    if words not in cache:
        marks, fillers = set(MARKS.split()), set(FILLERS.split())
        names = ([p for p in re.split(r"[-_]+", w) if p] for w in words.split())
        cache[words] = any(any(p in marks for p in ps) and all(p in marks or p in fillers or p[:1].isdigit() for p in ps) for ps in names)
    return cache[words]


def page_lines(html: str) -> tuple[list[str], list[int], list[bool], bool]:
    """Lines of a page, their weights, whether they may be kept at all, and whether an article or main element chose them.

    Boilerplate lines have weight zero and are not kept. On pages with article
    elements (or a main element, where articles hold less than a quarter of its
    text) so are the lines outside them.
    """
    from html import unescape

    skip, blocks, empty, raw = set(VOID_TEXT.split()), set(BLOCKS.split()), set(EMPTY.split()), set(RAW.split())
    own = ("article", "main")
    solid = skip | blocks | set(own)
    ended = {n: set(v.split()) for n, v in ENDS.items()}
    headings = {f"h{i}" for i in range(1, 7)}
    cache: dict = {}
    lines: list[str] = []
    sizes: list[int] = []
    kinds: list[tuple[bool, bool, bool]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple] = []  # name, and what the state was outside
    walls: list[int] = []  # places of block elements in the stack
    open_: list[dict] = [{}]  # how often names are open, since the last article, main or body
    outer = dict.fromkeys(("article", "main", "body"), 0)
    state = (False, False, False, False)  # boilerplate, in an article, in main, in a link

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            lines.append(line)
            sizes.append(max(len(line) - linked, 0))
            kinds.append(state[:3])
            text.clear()
            linked = 0

    def pop() -> None:
        nonlocal state
        name, state, wall = stack.pop()
        if wall:
            walls.pop()
        if name in outer:
            open_.pop()
            outer[name] -= 1
        else:
            open_[-1][name] -= 1

    for kind, name, *rest in tags(html):
        if kind == "text":
            piece = unescape(name) if "&" in name else name
            text.append(piece)
            if state[3]:
                linked += len(" ".join(piece.split()))
            continue
        closing, alone, words = rest
        if closing:
            if name in solid:
                flush()
            if name in outer:
                if not outer[name]:
                    continue
            elif not open_[-1].get(name):
                continue
            while stack[-1][0] != name:
                flush()
                pop()
            pop()
            continue
        if name in ("html", "body", "main", "article"):
            hit = name == "article" and "comment" in words
        else:
            hit = name in skip or bool(words) and name not in headings and marked(words, cache)
        if name in solid or hit:
            flush()
        if name in blocks or name in own:
            while walls and stack[walls[-1]][0] in ended.get(name, {"p"}):
                for _ in range(len(stack) - walls[-1]):
                    pop()
        if name in empty or alone and name not in raw:
            continue
        if name == "body":
            stack.clear()
            walls.clear()
            open_[1:] = []
            open_[0].clear()
            outer = dict.fromkeys(outer, 0)
            state = (False, False, False, False)
        if name in outer:
            open_.append({})
            outer[name] += 1
        else:
            open_[-1][name] = open_[-1].get(name, 0) + 1
        wall = name in solid or hit
        if wall:
            walls.append(len(stack))
        stack.append((name, state, wall))
        hidden = state[0] or hit
        state = (hidden, state[1] or name == "article" and not hidden, state[2] or name == "main" and not hidden, state[3] or name == "a")
    flush()
    held = [sum(len(x) for x, k in zip(lines, kinds, strict=True) if not k[0] and k[i]) for i in (1, 2)]
    scope = 1 if held[0] and 4 * held[0] >= held[1] else 2 if held[1] else None
    may = [not k[0] and (scope is None or k[scope]) for k in kinds]
    return lines, [n if ok else 0 for n, ok in zip(sizes, may, strict=True)], may, scope is not None


def kept_lines(weights: list[int], window: int, surge: float) -> list[bool]:
    """Which lines stand in a block that surges.

    The sum at a line is over it and the ``window`` - 1 lines after it. A block
    ends where ``window`` lines in a row have no weight; fewer such lines belong
    to the block around them, or to the one they are next to at the page's ends.
    It surges if one of its sums is at least ``surge`` of the page's greatest.
    """
    n = len(weights)
    kept = [False] * n
    cuts, gap = [], 0
    for i in range(n + 1):
        if i < n and not weights[i]:
            gap += 1
            continue
        if gap >= window:
            cuts.append((i - gap, i))
        gap = 0
    blocks, at = [], 0
    for a, b in [*cuts, (n, n)]:
        if a > at:
            blocks.append((at, a))
        at = b
    tops = []
    for a, b in blocks:
        total = top = sum(weights[a : min(a + window, b)])
        for i in range(a + 1, b):
            total += (weights[i + window - 1] if i + window - 1 < b else 0) - weights[i - 1]
            top = max(top, total)
        tops.append(top)
    least = surge * max(tops, default=0)
    for (a, b), top in zip(blocks, tops, strict=True):
        if top and top >= least:
            kept[a:b] = [True] * (b - a)
    return kept


def main_text(html: str | None, window: int = 3, surge: float = SURGE) -> str:
    """The kept lines of a page, joined by one space.

    Inside an article every block of own text surges, however short: its author
    set it apart already, and short paragraphs belong to it. Lists of links, of
    ``window`` lines or more, have no weight and fall between blocks there too.
    A page whose lines are all links keeps its lines. Null or empty html gives
    an empty text. Time and memory are linear in the page, whatever its markup.
    """
    if not html:
        return ""
    lines, weights, may, scoped = page_lines(html)
    if not any(weights):
        weights = [len(x) if ok else 0 for x, ok in zip(lines, may, strict=True)]
    kept = kept_lines(weights, window, 0.0 if scoped else surge)
    return " ".join(x for x, k, ok in zip(lines, kept, may, strict=True) if k and ok and x)


def extract_text(pages: DataFrame, window: int = 3, surge: float = SURGE) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every row with ``html``.

    ``html`` is dropped, existing columns of the new names are replaced. Null
    and empty html give an empty text; rows are independent of each other, so
    repeated rows give repeated results and an empty table gives none. A page
    must fit one Arrow row (2 GB); a task holds one batch and one page's lines.
    """
    import pyarrow as pa

    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [main_text(x.as_py(), window, surge) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    bound_batches(pages.sparkSession)
    schema = pages.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return pages.select(*rest, "html").mapInArrow(batches, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
