"""Main text of web pages: page structure first, then suffix arrays of each host's remaining blocks."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty

# Element names with a meaning here (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg canvas object audio video annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd maction semantics".split()
)
#: Elements that never hold main text.
OUTSIDE = frozenset("nav footer aside form menu dialog button select head header".split())
#: Names that, as a whole class, id or role, mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs gdpr login masthead menu modal nav navbar navigation newsletter popup promo promoted "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Names that mark it outside of main elements, and as a role; within one they may also tell what a text is of.
TOPICS = frozenset("alert complementary consent contentinfo cookie cookies dialog disclaimer footer form header notice notices promotion related search share".split())
#: Names of readers' comments, which count as whole names.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Parts of a longer name by which it tells a state and isn't a mark.
STATES = frozenset("no non not without with has have is free enabled disabled closed open on off allowed".split())
#: Elements that readers fill in or press, and the share of an element's text in links from which it is a list of links.
CONTROLS, LINKED = frozenset("button input select textarea".split()), 0.5

#: Tokens from which a substring that repeats on another page counts, and pages up to which a host is one suffix array.
RUN, GROUP = 8, 256
#: Share of a block's tokens from which repeated runs make it boilerplate.
COVER = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][A-Za-z0-9:-]*)(?P<rest2>[^>]*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_PART = re.compile(r"[a-z]+")


@dataclass
class Page:
    """``blocks``: (text, inside, doubt) in page order: inside an article or main element, under a name that may be a mark and that the page alone doesn't settle."""

    blocks: list[tuple[str, bool, bool]] = field(default_factory=list)

    def settled(self, inside: bool) -> list[str]:
        """The blocks inside, or outside, main elements."""
        return [t for t, within, _ in self.blocks if within == inside]

    @property
    def main(self) -> list[str]:
        return self.settled(True)

    def competing(self) -> list[tuple[str, bool, bool]]:
        """(text, kept, judged): blocks that belong to the text unless they are repeats, if ``judged``; others are only there to be compared with.

        A page with a main element has it for its text and doubts some of its blocks at most; on others all blocks compete.
        """
        main = any(within for _, within, _ in self.blocks)
        return [(t, within or not main, doubt if within else not main) for t, within, doubt in self.blocks]


def _mark(name: str, rest: str) -> str:
    """What an element's attributes say of it: "out", "comments", "topic" (out but within main elements), "doubt", "doubt comments" or "".

    A name that is only in part a mark, or a topic within a main element, is in doubt. An article, main or body element is not judged by its names, but for an
    article whose class is that of a comment.
    """
    found = ""
    rank = {"": 0, "doubt": 1, "doubt comments": 2, "topic": 3, "out": 4, "comments": 5}
    for key, *values in _ATTRIBUTE.findall(rest):
        value, key = "".join(values).lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "out"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "out"
        if key not in ("class", "id", "role") or name in ("main", "body", "html"):
            continue
        tokens, says = set(value.split()), [""]
        if tokens & COMMENTS:
            says.append("comments")
        elif name != "article":
            if tokens & MARKS or key == "role" and tokens & TOPICS:
                says.append("out")
            if tokens & TOPICS:
                says.append("topic")
        for token in tokens if name != "article" else ():
            parts = set(_PART.findall(token))
            if not parts & STATES and token not in TOPICS:
                says += ["doubt comments"] * bool(parts & COMMENTS) + ["doubt"] * bool(parts & (MARKS | TOPICS))
        found = max(found, *says, key=rank.get)
    return found


class _Doubts:
    """Elements in doubt, and what their structure says when they end."""

    def __init__(self):
        self.text = self.linked = self.controls = self.comments = self.mains = 0
        self.open: list[tuple] = []
        self.ended: list[tuple[int, int, bool]] = []  # first and last block, whether the structure agrees with the name

    def start(self, at: int, kind: str, block: int) -> None:
        self.open.append((at, kind, block, self.text, self.linked, self.controls, self.comments, self.mains))

    def end(self, at: int, block: int) -> None:
        """Ends those from place ``at`` among the open elements on; one that holds a main element says nothing."""
        while self.open and self.open[-1][0] >= at:
            _, kind, first, text, linked, controls, comments, mains = self.open.pop()
            if mains == self.mains:
                text, linked = self.text - text, self.linked - linked
                agrees = linked > 0 and linked >= LINKED * text or self.controls > controls or kind == "doubt comments" and self.comments > comments
                self.ended.append((first, block, agrees))

    def of(self, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Which blocks some ended element holds, and which one that its structure agrees with."""
        held, agreed = np.zeros(blocks + 1, np.int64), np.zeros(blocks + 1, np.int64)
        for first, last, agrees in self.ended:
            for change in (held, agreed) if agrees else (held,):
                change[first] += 1
                change[last] -= 1
        return np.cumsum(held)[:blocks] > 0, np.cumsum(agreed)[:blocks] > 0


class _Open:
    """The elements that are open, with what is asked of them kept beside, so that no step looks through all of them."""

    def __init__(self):
        self.all: list[tuple[str, str, bool]] = []  # name, kind, whether it is no inline element
        self.named: dict[str, list[int]] = defaultdict(list)
        self.of_kind: dict[str, list[int]] = {k: [] for k in ("in", "out", "comments")}
        self.solid: list[int] = []

    def push(self, name: str, kind: str) -> None:
        at, solid = len(self.all), name not in INLINE
        self.all.append((name, kind, solid))
        self.named[name].append(at)
        if kind:
            self.of_kind[kind].append(at)
        if solid:
            self.solid.append(at)

    def close(self, index: int) -> None:
        while len(self.all) > index:
            name, kind, solid = self.all.pop()
            self.named[name].pop()
            if kind:
                self.of_kind[kind].pop()
            if solid:
                self.solid.pop()

    @property
    def dropped(self) -> bool:
        return bool(self.of_kind["out"] or self.of_kind["comments"])

    @property
    def inside(self) -> bool:
        return bool(self.of_kind["in"])


def parse(source: str) -> Page:
    """Blocks of text outside of what the page's structure marks as something else.

    Elements that are left open end with the element around them; an article or main element also ends marked ones
    that were left open before it, comments aside. Markup that is cut off at the page's end is dropped. Where a name leaves doubt, an element is
    dropped if its structure agrees: half of its text or more is links, it has controls, or one named for comments holds another.
    Time grows with the page's length, whatever is left open or closed twice, and however long a tag is.
    """
    found_blocks, text, at, end = [], [], 0, len(source)
    opened, doubts = _Open(), _Doubts()

    def flush() -> None:
        block = " ".join(html.unescape("".join(text)).split())
        if block:
            found_blocks.append((block, opened.inside))
        text.clear()

    def close(index: int) -> None:
        opened.close(index)
        doubts.end(index, len(found_blocks))

    while at < end:
        found = _TOKEN.search(source, at)
        stop = found.start() if found else end
        if not opened.dropped:
            text.append(source[at:stop])
            size = len(source[at:stop].strip())
            doubts.text += size
            doubts.linked += size * bool(opened.named.get("a"))
        if not found:
            break
        at = max(found.end(), stop + 1)
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            if not opened.dropped and found[0].startswith("<![CDATA["):
                text.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        rest = found["rest"] or found["rest2"] or ""
        if found["end"] or found["end2"]:
            if name not in INLINE and not opened.dropped:
                flush()
            places = opened.named.get(name)
            marked = [k[-1] for k in opened.of_kind.values() if k] + [x[0] for x in doubts.open[-1:]]
            if places and (name not in INLINE or not any(k > places[-1] for k in marked)):
                close(places[-1])
            continue
        doubts.controls += name in CONTROLS
        if name in RAW:
            if rest.rstrip().endswith("/") and name == "svg":
                continue
            done = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|$)", re.I).search(source, at)
            at = done.end() if done else end
            continue
        if name == "br":
            if not opened.dropped:
                text.append(" ")
            continue
        if name not in INLINE and not opened.dropped:
            flush()
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        kind = _mark(name, rest)
        if name in ("article", "main") and not kind and opened.of_kind["out"] and not opened.of_kind["comments"] and not opened.named.get(name):
            close(opened.of_kind["out"][0])
        if name == "p" and opened.solid and opened.all[opened.solid[-1]][0] == "p":  # a new paragraph ends an open one
            close(opened.solid[-1])
        doubts.comments += kind.endswith("comments")
        if name in ("html", "body"):
            kind = ""
        elif name in OUTSIDE and not (name == "header" and opened.inside):
            kind = "comments" if kind == "comments" else "out"
        elif not kind and name in ("article", "main"):
            kind = "in"
            doubts.mains += 1
        elif kind == "topic":
            kind = "doubt" if opened.inside else "out"
        if kind.startswith("doubt"):
            if name not in INLINE and not opened.dropped:
                doubts.start(len(opened.all), kind, len(found_blocks))
            kind = ""
        opened.push(name, kind)
    if not opened.dropped:
        flush()
    close(0)
    held, agreed = doubts.of(len(found_blocks))
    return Page([(t, inside, bool(doubt)) for (t, inside), doubt, drop in zip(found_blocks, held, agreed, strict=True) if not drop])


def repeated(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """Which tokens of each stream lie in a substring of ``run`` tokens or more that another stream has too.

    A suffix array of all streams end to end, each closed by a token of its own: prefix doubling ranks the suffixes by
    their first 1, 2, 4 .. tokens until the rank tells the first ``run`` apart. Suffixes of equal rank from two streams
    cover ``run`` tokens each; longer repeats are the unions of these.
    """
    ids: dict[str, int] = {}
    flat: list[int] = []
    for i, s in enumerate(streams):
        flat += [ids.setdefault(t, len(ids)) for t in s]
        flat.append(-1 - i)
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    rank = np.unique(np.array(flat, np.int64), return_inverse=True)[1].astype(np.int64) + 1
    n, depth = len(rank), 1
    while depth < run:
        ahead = min(depth, run - depth)
        later = np.zeros(n, np.int64)
        later[: n - ahead] = rank[ahead:]
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        depth += ahead
    order = np.argsort(rank, kind="stable")
    sorted_rank, sorted_owner = rank[order], owner[order]
    starts = np.flatnonzero(np.diff(sorted_rank, prepend=-1))
    shared = np.minimum.reduceat(sorted_owner, starts) != np.maximum.reduceat(sorted_owner, starts)
    begins = order[np.repeat(shared, np.diff(np.append(starts, n)))]
    change = np.zeros(n + run + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + run, -1)
    covered = np.cumsum(change)[:n] > 0
    cuts = np.cumsum([len(s) + 1 for s in streams])
    return [covered[end - len(s) - 1 : end - 1] for s, end in zip(streams, cuts, strict=True)]


#: A page's blocks as they compete: text, kept, judged.
Blocks = list[tuple[str, bool, bool]]


def uncovered(blocks: Blocks, cover: np.ndarray) -> list[str]:
    """The blocks of a page's text but for those in question of which repeated runs cover COVER or more of the tokens."""
    at, own = 0, []
    for block, kept, judged in blocks:
        size = len(block.split()) if judged or not kept else 0
        if kept and not (judged and cover[at : at + size].mean() >= COVER):
            own.append(block)
        at += size
    return own


def stream(blocks: Blocks) -> list[str]:
    """The tokens that are compared: of blocks in question, and of those that belong to no text."""
    return [t for block, kept, judged in blocks if judged or not kept for t in block.split()]


def strip_repeats(pages: list[Blocks]) -> list[list[str]]:
    """The text's blocks of each page but for those that runs repeated on other pages cover by COVER or more of their tokens."""
    covers = repeated([stream(blocks) for blocks in pages]) if pages else []
    return [uncovered(blocks, cover) for blocks, cover in zip(pages, covers, strict=True)]


def _unpacked(blocks: list[dict]) -> Blocks:
    return [(b["text"], b["kept"], b["judged"]) for b in blocks]


def sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes that come sorted by ``_host``, ``_run`` (their first RUN tokens), ``_row`` and ``_at``: those whose run two pages have.

    Neighbours are compared within a batch. Runs at a batch's ends may go on in another batch or task: all their suffixes come out, with host and run, ``_edge``.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        row, n = batch["_row"].to_numpy(), batch.num_rows
        change = np.zeros(n - 1, bool)
        for key in (batch["_host"], batch["_run"]):
            change |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(change) + 1)
        ends = np.append(starts[1:], n)
        edge, shared = np.zeros(len(starts), bool), row[starts] != row[ends - 1]
        edge[[0, -1]] = True
        kept, edge = np.flatnonzero(np.repeat(edge | shared, ends - starts)), np.repeat(edge, ends - starts)
        named = pa.array(kept, pa.int64(), mask=~edge[kept])  # without host and run inside the batch
        columns = [*(batch[c].take(named) for c in ("_host", "_run")), *(batch[c].take(pa.array(kept)) for c in ("_row", "_bare", "_at")), pa.array(edge[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["_host", "_run", "_at_row", "_at_bare", "_at", "_edge"])


def _strip_large(pages: DataFrame, shape: str) -> DataFrame:
    """``_id``, ``_url``, ``_text`` of the open ones of ``pages``, as strip_repeats has them over all pages of each host.

    The suffixes of all pages are sorted by host and their first RUN tokens, over tasks by ranges that may part even the suffixes of one run, and neighbours
    are compared: the suffix array of each host, as deep as repeats are asked for. Runs cut by the ends of batches, two a batch at most, are merged within tasks and joined back.
    """

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, row, bare, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = stream(_unpacked(blocks))
                n = max(0, len(tokens) - RUN + 1)
                runs = pa.array(["\n".join(tokens[j : j + RUN]) for j in range(n)], pa.string())
                columns = [pa.array([name] * n, pa.string()), runs, pa.array(np.full(n, row)), pa.array(np.full(n, bare)), pa.array(np.arange(n, dtype=np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["_host", "_run", "_row", "_bare", "_at"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for blocks, begins in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = _unpacked(blocks)
                cover = np.zeros(len(stream(own)), bool)
                for at in begins or []:
                    cover[at : at + RUN] = True
                texts.append("\n\n".join(uncovered(own, cover)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["_id", "_url", "_text"])

    keys = ["_host", "_run", "_row", "_at"]
    dealt = pages.select("_host", "_row", "_bare", "_blocks").mapInArrow(suffixes, "_host string, _run string, _row long, _bare boolean, _at int")
    found = durable(
        dealt.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .mapInArrow(sorted_repeats, "_host string, _run string, _at_row long, _at_bare boolean, _at int, _edge boolean")
    )
    edges = found.where("_edge")
    shared = (
        edges.groupBy("_host", "_run").agg(F.min("_at_row").alias("_first"), F.max("_at_row").alias("_last"))
        .where("_first <> _last").select("_host", "_run")
    )
    met = found.where("not _edge").unionByName(edges.join(shared, ["_host", "_run"]))
    begins = met.where("_at_bare").groupBy("_at_row").agg(F.collect_list("_at").alias("_begins"))
    joined = pages.where("_bare").join(begins, F.col("_row") == F.col("_at_row"), "left")
    return joined.select("_id", "_url", "_blocks", "_begins").mapInArrow(strip, f"{shape}, _text string")


def host(url: str | None) -> str:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", (url or "").strip().lower())
    return found[1].rpartition("@")[2] if found else ""


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: id, url, ``text`` (main text, blocks joined by an empty line) and ``n_chars``.

    Scripts, styles and other raw elements, comments of the source, and elements that by name, class, id or role are
    menus, headers, footers, sidebars, notices, adverts, forms or readers' comments give no text. A mark is a whole
    class. A name of which only a part is one, and within a main element also one that may tell a topic (cookies, related), leaves doubt: what it holds
    goes where the structure agrees (links, controls, comments within comments), or where runs of RUN tokens or more, repeated on another page of the host,
    cover half of a block or more. Articles and main elements are not judged by their classes. Where a page has one with text, its blocks are the main text. On other
    pages all blocks that are left compete: those that repeats cover by half or more are boilerplate,
    and the rest is the text. Character references are decoded; white space within a block becomes one space. A null
    page is empty and gives empty text; pages with a null or odd url share the host ''. Rows that repeat a page are
    pages of their own. A page of any length is read whole. An empty table gives an empty result. Other columns of ``df`` are not read.

    Pages are parsed once. Of hosts that have pages with blocks in question, these and the blocks outside main elements are
    compared: hosts of up to GROUP pages by one suffix array each, larger ones by suffixes sorted over tasks, so a host of any
    size is spread. Both find every repeat on the whole host and give the same text.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    pages = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), text_or_empty(html_col).alias("_html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [parse(x.as_py()) for x in part.column(2)]
                competing = [p.competing() for p in rows]
                texts = [None if any(judged for *_, judged in own) else "\n\n".join(t for t, kept, _ in own if kept) for own in competing]
                hosts = pa.array([host(u.as_py()) for u in part.column(1)], pa.string())
                compared = [[dict(zip(("text", "kept", "judged"), b, strict=True)) for b in own if text is None or not b[1]] for own, text in zip(competing, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), hosts, pa.array(compared, block)], ["_id", "_url", "_text", "_host", "_blocks"])

    block = pa.list_(pa.struct([("text", pa.string()), ("kept", pa.bool_()), ("judged", pa.bool_())]))
    shape = f"_id {kinds[id_col]}, _url {kinds[url_col]}"
    blocks = "_blocks array<struct<text: string, kept: boolean, judged: boolean>>"
    parsed = durable(pages.mapInArrow(read, f"{shape}, _text string, _host string, {blocks}"))
    direct = parsed.where(F.col("_text").isNotNull()).select("_id", "_url", "_text")
    in_question = F.col("_text").isNull()
    spread = parsed.where(in_question | (F.size("_blocks") > 0)).select("_id", "_url", "_host", in_question.alias("_bare"), "_blocks")
    hosts = (
        spread.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"), F.max("_bare").alias("_any")).where("_any")
        .select(F.col("_host").alias("_h"), (F.col("_n") > GROUP).alias("_large"))
    )
    open_hosts = durable(spread.join(hosts, F.col("_host") == F.col("_h")).withColumn("_row", F.monotonically_increasing_id()))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        kept = strip_repeats([_unpacked(own) for own in group["_blocks"]])
        out = group[["_id", "_url"]].assign(_text=["\n\n".join(k) for k in kept])
        return out[group["_bare"].to_numpy(bool)]

    small = open_hosts.where("not _large").select("_id", "_url", "_host", "_bare", "_blocks").groupBy("_host").applyInPandas(
        compare, f"{shape}, _text string"
    )
    others = small.unionByName(_strip_large(open_hosts.where("_large"), shape))
    return direct.unionByName(others).select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"),
        F.length("_text").cast("long").alias("n_chars"),
    )
