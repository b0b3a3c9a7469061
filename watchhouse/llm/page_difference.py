"""Main text of web pages by structure and by differencing neighbouring pages of a host.

A page is read into text lines, one per block; parts that HTML or their class names mark as no article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) are passed over.  Pages are then range-sorted by (host, URL path)
and each is aligned, by longest common subsequence of lines, with the page of its host before or after it whose path is nearest
and whose lines are not just the same: shared lines are the site's and are deleted.  Neighbours in other partitions are found
through the first and last runs of equal pages of each partition, so the result does not depend on the partitions.  A line inside an explicit ``article`` or ``main`` element is the page's own by its author's
word and stays even where a neighbour has it too (copies of an article, quoted passages).

A null or empty page gives an empty text; a page of any size is read whole; pages with equal paths are ordered by id;
repeated pages are compared with the nearest other page; where a host has none, nothing is deleted; a null URL is a host of its own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchhouse.llm.common import partitions, stored

# fixed values: element names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
DROPPED = set("head nav header footer aside form button select input label menu dialog object canvas audio video".split()) | RAW
CONTENT = {"article", "main"}
# words of class, id and role values that mark a part as no article
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo|banner|cookies?|consent|notices?|gdpr|popup|modal|overlay|nav(?:bar|igation)?|menu|"
    r"breadcrumbs?|sidebar|side|widget|related|recommended|share|sharing|social|follow|newsletter|subscribe|signup|login|search|footer|header|masthead|"
    r"comments?|comment-list|replies|reply|disqus|pagination|pager|toolbar|copyright|complementary|contentinfo|alert)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_marked(name: str, attributes: str) -> bool:
    if not attributes or name in ("html", "body"):
        return False
    for key, *values in _MARK.findall(attributes):
        value = "".join(values)
        if key.lower() == "hidden" or (key.lower() != "aria-label" and MARKED.search(value)):
            return True
    return bool(_HIDDEN.search(attributes))


def page_lines(page: str) -> list[tuple[str, bool]]:
    """Block texts in page order, each with whether it lies in an article or main element.

    Where such elements hold half of the text or more, only the blocks within them are returned, otherwise all blocks alike.
    """
    lines: list[tuple[str, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, passed over, in content
    dropped = content = False
    at, end = 0, len(page)

    def close_block():
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                lines.append((line, content))
            text.clear()

    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            if not dropped:
                text.append(page[at:])
            break
        if found.start() > at and not dropped:
            text.append(page[at:found.start()])
        at = found.end()
        closing, name, attributes = found.group(1), found.group(2), found.group(3)
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in BLOCKS and not dropped:
                close_block()
            # a closing tag ends the innermost open element of its name and what is open inside; others are ignored
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    dropped, content = stack[-1][1:] if stack else (False, False)
                    break
            continue
        if name == "br":
            if not dropped:
                text.append(" ")
            continue
        if name in BLOCKS and not dropped:
            close_block()
        if name in RAW:
            over = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name == "p":  # a paragraph ends the one before it
            if stack and stack[-1][0] == "p":
                stack.pop()
                dropped, content = stack[-1][1:] if stack else (False, False)
        # header, label and the like inside an article are dropped too
        dropped = dropped or name in DROPPED or _is_marked(name, attributes)
        content = content or name in CONTENT
        stack.append((name, dropped, content))
    if not dropped:
        close_block()
    inside = [line for line in lines if line[1]]
    if inside and 2 * sum(len(x) for x, _ in inside) >= sum(len(x) for x, _ in lines):
        return inside
    return [(x, False) for x, _ in lines]  # a teaser of little text does not make the rest no article


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Indices of ``mine`` in a longest common subsequence with ``other`` (rows of bits, so long pages stay cheap)."""
    if not mine or not other:
        return set()
    places: dict[str, int] = {}
    for column, line in enumerate(other):
        places[line] = places.get(line, 0) | 1 << column
    full = (1 << len(other)) - 1
    row, rows = full, []
    for line in mine:
        match = places.get(line, 0)
        hit = row & match
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    # walk back: a zero bit marks a column where the common length grows
    found, column = set(), len(other) - 1
    for i in range(len(mine) - 1, -1, -1):
        above = rows[i - 1] if i else full
        while column >= 0 and (rows[i] >> column) & 1:
            column -= 1
        if column < 0:
            break
        if (above >> column) & 1:  # the length grows at this very line
            if other[column] == mine[i]:
                found.add(i)
                column -= 1
            else:
                while column >= 0 and other[column] != mine[i]:
                    column -= 1
                if column >= 0:
                    found.add(i)
                    column -= 1
    return found


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _own_text(lines: list[tuple[str, bool]], neighbours: list[list[tuple[str, bool]]]) -> str:
    """Lines of a page without the unprotected ones that it shares with its neighbour."""
    for other in neighbours:
        mine = [line for line, _ in lines]
        if all(protected for _, protected in lines) or mine == [line for line, _ in other]:
            continue
        gone = shared_lines(mine, [line for line, _ in other])
        lines = [x for i, x in enumerate(lines) if x[1] or i not in gone]
    return "\n".join(line for line, _ in lines)


_ROW = "url string, host string, path string, lines binary, protected array<boolean>"  # lines: compressed, joined by line feeds; null without any


def _runs(batches, columns, same="lines"):
    """Part, host, lines (or what stands for them) and members of neighbouring pages of a host that are equal in them."""
    run = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            page = dict(zip(columns, row))
            if run and (run["part"], run["host"], run[same]) == (page["part"], page["host"], page[same]):
                page[same] = run[same]  # held once
                run["members"].append(page)
            else:
                if run:
                    yield run
                run = {"part": page["part"], "host": page["host"], same: page[same], "members": [page]}
    if run:
        yield run


def _opened(batches):
    """Batches with their lines as text again, a few pages at a time."""
    for batch in batches:
        for start in range(0, len(batch), 256):
            some = batch.slice(start, 256)
            text = [zlib.decompress(x.as_buffer()).decode() if x.is_valid else "" for x in some.column("lines")]
            yield some.set_column(some.schema.get_field_index("lines"), "lines", pa.array(text, pa.string()))


def _edges(batches):
    """Of each partition the first two runs of its first host and the last two of its last, and whether it has that host only."""
    def emit(runs):
        sides = (("first", [r for r in runs[0] if r["host"] == runs[0][0]["host"]]), ("last", [r for r in runs[1][::-1] if r["host"] == runs[1][-1]["host"]]))
        rows = [(r["part"], side, nth, r["host"], r["members"][0 if side == "first" else -1]["_at"], runs[2], r["digest"])
                for side, some in sides for nth, r in enumerate(some)]
        names = ["part", "side", "nth", "host", "at", "single", "digest"]
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=pa.schema([
            ("part", pa.int64()), ("side", pa.string()), ("nth", pa.int32()), ("host", pa.string()), ("at", pa.int64()), ("single", pa.bool_()), ("digest", pa.string())]))

    first, last, single = [], [], True
    for run in _runs(batches, ["host", "digest", "part", "_at"], "digest"):
        if first and first[0]["part"] != run["part"]:
            yield emit((first, last, single))
            first, last, single = [], [], True
        run["members"] = [run["members"][0], run["members"][-1]]
        first = first + [run] if len(first) < 2 else first
        single = single and run["host"] == first[0]["host"]
        last = (last + [run])[-2:]
    if first:
        yield emit((first, last, single))


def _borrowed(edges: list) -> list[tuple[int, str, int, int]]:
    """(source part, side, nth, part): the nearest different run that a partition needs from those before and after it."""
    by, out = {}, []
    for e in edges:
        by.setdefault((e.part, e.side), []).append(e)
    parts = sorted({e.part for e in edges})
    for own, other, order in (("first", "last", parts), ("last", "first", parts[::-1])):
        # going along, the two nearest different runs of the host that reaches the edge
        near: list = []
        for part in order:
            mine = sorted(by[part, own], key=lambda e: e.nth)
            if near and near[0].host == mine[0].host:
                out += [(e.part, e.side, e.nth, part) for e in near if e.digest != mine[0].digest][:1]
            far = sorted(by[part, other], key=lambda e: e.nth)
            for e in near if far[0].single and near and near[0].host == far[0].host else []:
                if len(far) < 2 and e.digest not in [x.digest for x in far]:
                    far.append(e)
            near = far
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    address = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    bare = F.regexp_replace(address, r"[?#][\s\S]*$", "")
    keyed = pages.select(
        "page_id", "url", F.lower(F.regexp_extract(bare, r"^[^/]*", 0)).alias("host"), F.regexp_replace(bare, r"^[^/]*/?", "").alias("path"),
        F.coalesce("html", F.lit("")).alias("html"))
    kind = dict(pages.dtypes)["page_id"]

    def read(batches):
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                found = [page_lines(page.as_py()) for page in some.column("html")]
                texts = ["\n".join(x for x, _ in f).encode() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:4], pa.array([zlib.compress(x) if x else None for x in texts], pa.binary()), pa.array([[x for _, x in f] for f in found], pa.list_(pa.bool_())),
                     pa.array([hashlib.sha256(x).hexdigest() if x else None for x in texts], pa.string())],
                    ["page_id", "url", "host", "path", "lines", "protected", "digest"])

    parsed = keyed.mapInArrow(read, f"page_id {kind}, {_ROW}, digest string")
    order = ["host", "path", "page_id"]
    placed = stored(parsed.repartitionByRange(partitions(pages), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
                    .withColumn("part", F.shiftright("_at", 33)), "page-lines")
    # ranges of part numbers, so that a task gets one part
    in_order = lambda df: df.repartitionByRange(partitions(pages), "part").sortWithinPartitions("part", "side", "_at")
    # a page without lines is nobody's partner; the edges are found by digests, and only the lines of the few lent pages are read again
    full = in_order(placed.where("digest IS NOT NULL").select("host", "digest", "part", "_at", F.lit(1).alias("side")))
    edges = stored(full.mapInArrow(_edges, "part long, side string, nth int, host string, at long, single boolean, digest string"), "page-edges")
    picks = _borrowed(edges.collect())
    picked = pages.sparkSession.createDataFrame(picks, "part long, side string, nth int, _to long")
    lent = edges.join(picked, ["part", "side", "nth"]).select(F.col("at").alias("_at"), "_to", F.when(F.col("side") == "last", 0).otherwise(2).alias("side"))
    lent = placed.select("host", "path", "lines", "_at").join(F.broadcast(lent), "_at").select(  # at most four pages a part
        F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"), "host", "path", "lines", F.lit(None).cast("array<boolean>").alias("protected"),
        F.lit(None).cast("long").alias("_at"), F.col("_to").alias("part"), "side")
    aligned = in_order(placed.drop("digest").withColumn("side", F.when(F.col("lines").isNotNull(), 1).otherwise(3)).unionByName(lent))
    columns = ["page_id", "url", "host", "path", "lines", "protected", "part", "side"]

    def difference(batches):
        """A run is emitted when the run after it is known."""
        before = current = None
        for run in _runs(_opened(batches), columns):
            if current:
                yield from finish(before, current, run)
            before, current = current, run
        if current:
            yield from finish(before, current, None)

    def finish(before, run, after):
        # where lines are equal a lent run cannot stand beside this one, so every neighbour is a different page
        beside = [(n["lines"], n["members"][at]["path"]) for n, at in ((before, -1), (after, 0)) if n and n["lines"] and (n["part"], n["host"]) == (run["part"], run["host"])]
        own = [m for m in run["members"] if m["side"] in (1, 3)]
        rows, texts, lines = [], {}, run["lines"].split("\n") if run["lines"] else []
        for m in own:
            near = max(range(len(beside)), key=lambda i: _common(beside[i][1], m["path"]), default=None)  # the first of equally near ones
            key = near, tuple(m["protected"])
            if key not in texts:
                texts[key] = _own_text(list(zip(lines, m["protected"])), [] if near is None else [[(x, False) for x in beside[near][0].split("\n")]])
            rows.append((m["page_id"], m["url"], texts[key], len(texts[key])))
        for start in range(0, len(rows), 256):
            yield emit(rows[start:start + 256])

    number = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def emit(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], number), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
            ["page_id", "url", "text", "n_chars"])

    return aligned.select(*columns).mapInArrow(difference, f"page_id {kind}, url string, text string, n_chars long")
