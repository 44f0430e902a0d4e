"""Main text of web pages by wrapper inference: union-free regular expressions over the pages of a host.

A page's token stream becomes a tree of elements whose leaves are text slots. A wrapper is a union-free expression over such
trees: an element holds a sequence of parts, each of which is there once, optional (?), repeated (+) or both (*). Pages of one
host are aligned with each other part by part: equal labels meet, what only one has becomes optional, neighbours of one label
become a repeated group, and texts become slots. Aligning two wrappers gives a wrapper, so a host's pages are folded in a tree
of small groups: distinct shapes first (counted with partial sums), then rounds of bounded groups until each host has one.

Slots carry a zone: within an article or main element; within what a page says isn't its text (navigation, adverts, notices,
comments and so on, by element, role or class); or neither. Then every page's texts are counted by the host's slots, once for
pages of equal text: how many characters, and how often the commonest text. A slot that holds one text on most pages is chrome,
and so is a repeated group of short texts or links; the others are text. The wrapper's main part is found from its root down:
an article or main part with at least half of the varying text or, where there is none, the least part that holds all varying
text that isn't in such groups. A page's text is what its alignment puts into the main part's slots, but for zones that
aren't text and, outside articles, for what is the same on most pages. Hosts of less than SAME_PAGES different pages tell
nothing: there, as on pages that have nothing in the main part, the page's own article or its neutral texts are read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, fresh, give_back, small, values, whole, written
from .language import host_of

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TELLING = re.compile(r"class|id|role|hidden", re.I)
# Elements, roles and class words, each in groups of one meaning.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset("html body head header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption address details summary br hr".split())
OUT = frozenset("head header footer nav aside form button select option dialog menu script style noscript template textarea title iframe svg".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
OUT_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices gdpr popup modal overlay comment comments reply replies respond share sharing social related recommended newsletter subscribe signup login search pagination pager".split())
# Words that name no content, so that a class of these and of OUT_WORDS is boilerplate as a whole.
BOX_WORDS = frozenset("slot box block container wrapper unit list section form area".split())
NOT_WORDS = frozenset("has with no without".split())
DEPTH = 120  # deeper elements are not nested in the tree; their texts hang on the element at this depth
ZONES = ("#m", "#o", "#x")  # in the article, neither, out
SAME_SHARE, SAME_PAGES = 0.5, 3
SHORT = 60  # characters of a list item or comment's text on average, at most
TEXTUAL = HEADINGS | frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption address a b i em strong span small sup sub code q cite label".split())
GROUP = 32


def _attributes(raw: str) -> dict[str, str]:
    """Values by name in lower case; of a repeated name the first counts. Empty if no name can be one that is looked at here."""
    out: dict[str, str] = {}
    if raw and _TELLING.search(raw):
        for m in _ATTRIBUTE.finditer(raw):
            out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _out(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element isn't the page's text. Inside an article only a role or a whole class says so; elsewhere also one part
    of a class or an id, but no heading's id, as those are often made of its text."""
    if tag in OUT:
        return True
    if tag in ("html", "body", "main", "article") or not attributes:
        return False
    if "hidden" in attributes or attributes.get("role", "").strip().lower() in OUT_ROLES:
        return True
    names = attributes.get("class", "").lower().split()
    if not inside and tag not in HEADINGS:
        names += attributes.get("id", "").lower().split()
    for name in names:
        parts = set(re.split(r"[-_]+", name))
        if parts & OUT_WORDS and not (parts - OUT_WORDS - BOX_WORDS if inside else parts & NOT_WORDS):
            return True
    return False


def _class(attributes: dict[str, str]) -> str:
    m = re.match(r"\s*([A-Za-z][\w-]*)", attributes.get("class", ""))
    return f".{re.sub(r'[0-9]+', '0', m[1].lower())}" if m else ""


def page_tree(page: str | None) -> tuple[list, list[tuple[list, int, str]]]:
    """The page as nested [label, children], and its texts as (leaf, block number, raw text) in page order."""
    root: list = ["", []]
    texts: list = []
    # open elements: tag, tree node, whether it or one above is out, whether it or one above is the article
    stack: list[tuple[str, list, bool, bool]] = [("", root, False, False)]
    block, at, skip = 0, 0, None
    page = page or ""

    def add(raw: str) -> None:
        if raw.strip():
            _, node, out, inside = stack[-1]
            label = "#x" if out else "#m" if inside else "#o"
            if not node[1] or node[1][-1][0] != label:
                node[1].append([label, []])
            texts.append((node[1][-1], block, raw))
        elif raw and texts and texts[-1][1] == block:
            texts.append((texts[-1][0], block, " "))

    for m in _TOKEN.finditer(page):
        if skip:
            if not (m[1] and m[2].lower() == skip):
                continue
            skip, at = None, m.start()
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            block += 1
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in BLOCK and tag != "br":
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ("p",))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK and stack[k][0] != "p":
                    break
        _, parent, out, inside = stack[-1]
        attributes = _attributes(m[3])
        node = [tag + _class(attributes), []]
        if len(stack) < DEPTH:
            parent[1].append(node)
        else:
            node = parent
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        stack.append((tag, node, out or _out(tag, attributes, inside), inside or tag in ("article", "main")))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            skip, at = (tag, len(page)) if end else (None, len(page))
            if not end:
                break
    if at < len(page) and not skip:
        add(page[at:])
    return root, texts


def shape(node: list) -> list:
    """A tree as a wrapper [label, sign, children]: neighbours of one label are one repeated part."""
    return [node[0], "", _grouped([shape(c) for c in node[1]])]


def _grouped(parts: list[list]) -> list[list]:
    out: list[list] = []
    for p in parts:
        if out and out[-1][0] == p[0]:
            same = p[0][0:1] == "#"
            out[-1] = [p[0], "" if same and not (out[-1][1] or p[1]) else _repeated(out[-1][1], p[1]), _aligned(out[-1][2], p[2])]
        else:
            out.append(p)
    return out


def _repeated(a: str, b: str) -> str:
    return "*" if a in ("?", "*") and b in ("?", "*") else "+"


def _either(a: str, b: str) -> str:
    """The sign of a part that is signed so in two wrappers."""
    return {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[bool({a, b} & {"?", "*"}), bool({a, b} & {"+", "*"})]


def _optional(p: list) -> list:
    return [p[0], {"": "?", "+": "*"}.get(p[1], p[1]), p[2]]


def _aligned(a: list[list], b: list[list]) -> list[list]:
    """Aligns two sequences of parts by a longest common subsequence of labels; the rest becomes optional."""
    n, m = len(a), len(b)
    if [x[0] for x in a] == [x[0] for x in b]:
        return [[x[0], _either(x[1], y[1]), _aligned(x[2], y[2])] for x, y in zip(a, b, strict=True)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append([a[i][0], _either(a[i][1], b[j][1]), _aligned(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return _grouped(out)


def align(a: list, b: list) -> list:
    """The wrapper of what either wrapper describes."""
    return [a[0], _either(a[1], b[1]), _aligned(a[2], b[2])]


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression's text, for people."""
    label, sign, parts = wrapper
    inside = "".join(map(expression, parts))
    text = label if label[:1] == "#" else f"<{label}>{inside}</{label.split('.')[0]}>" if label else inside
    return f"({text}){sign}" if sign else text


class Reader:
    """A host's wrapper with numbered parts."""

    def __init__(self, wrapper: list) -> None:
        self.slots: dict[int, str] = {}
        self._next = 0
        self.root = self._numbered(wrapper)

    def _numbered(self, w: list) -> tuple:
        number = self._next
        self._next += 1
        if w[0][:1] == "#":
            self.slots[number] = w[0]
        return w[0], number, [self._numbered(p) for p in w[2]], w[1] in ("+", "*")

    def read(self, tree: list) -> dict[int, int]:
        """The slot number of each text leaf, by the leaf's id; a tree that the wrapper describes gets a slot for every leaf.

        Each child takes the first part of its label, at or after its elder's, that holds its whole subtree; only repeated parts
        are taken twice. If there is any way to place all children, this finds one. Elements that no part holds have no slots.
        """
        placed: dict[tuple[int, int], list | None] = {}

        def place(part: tuple, node: list) -> list | None:
            """The part of each child, or None if they don't all have one."""
            key = part[1], id(node)
            if key not in placed:
                parts, k, out = part[2], 0, []
                for child in node[1]:
                    while k < len(parts) and (parts[k][0] != child[0] or child[1] and place(parts[k], child) is None):
                        k += 1
                    if k == len(parts):
                        out = None
                        break
                    out.append(parts[k])
                    k += not parts[k][3]
                placed[key] = out
            return placed[key]

        found: dict[int, int] = {}
        todo = [(self.root, tree)]
        while todo:
            part, node = todo.pop()
            for child, own in zip(node[1], place(part, node) or (), strict=False):
                if child[0][:1] == "#":
                    found[id(child)] = own[1]
                else:
                    todo.append((own, child))
        return found


def slots_between(shaped: list, reader: Reader) -> dict[int, int]:
    """The slot numbers of a page's own shape to those of its host's wrapper."""
    tree = _plain(shaped)
    met = reader.read(tree)
    return {number: met.get(leaf, -1) for number, leaf in _leaves(Reader(shaped).root, tree).items()}


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(" ".join(text.split()).encode("utf8", "replace"), digest_size=8).digest(), "big", signed=True)


def _shapes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("slot", pa.int32()), ("said", pa.int64()), ("chars", pa.int32())])
    for pages in batches:
        shapes, slots, said = [], [], []
        for page in values(pages):
            tree, texts = page_tree(page)
            own = shape(tree)
            shapes.append(json.dumps(own, separators=(",", ":"), ensure_ascii=False))
            numbers = Reader(own).read(tree)
            by: dict[int, list[str]] = {}
            for leaf, _, raw in texts:
                if leaf[0] != "#x":
                    by.setdefault(numbers.get(id(leaf), -1), []).append(raw)
            slots.append([{"slot": k, "said": _digest(" ".join(v)), "chars": sum(map(len, v))} for k, v in by.items()])
            said.append(_digest(" ".join(raw for leaf, _, raw in texts if leaf[0] != "#x")))
        yield pa.StructArray.from_arrays([pa.array(shapes, pa.string()), pa.array(slots, pa.list_(kind)), pa.array(said, pa.int64())], ["shape", "slots", "page"])
    give_back()


SHAPE = "struct<shape:string,slots:array<struct<slot:int,said:long,chars:int>>,page:long>"


def infer(shapes: DataFrame) -> DataFrame:
    """shapes: host, shape. host, wrapper: one for each host, folded in rounds of groups of about GROUP members."""
    left = written(shapes.select("host", F.col("shape").alias("wrapper")).distinct())

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own = sorted(rows["wrapper"])
        wrapper = json.loads(own[0])
        for other in own[1:]:
            wrapper = align(wrapper, json.loads(other))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper, separators=(",", ":"), ensure_ascii=False)]})

    while True:
        sizes = written(left.groupBy("host").agg(F.count("*").alias("n")))
        if sizes.where("n > 1").isEmpty():
            forget(sizes)
            return left
        groups = F.ceil(F.col("n") / GROUP)
        dealt = left.join(small(sizes), "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), groups))
        left = written(dealt.groupBy("host", "part").applyInPandas(fold, "host string, wrapper string").distinct())


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "main_text") -> DataFrame:
    """pages with `out`, the main text: blocks in page order, joined by a blank; empty if there is none.

    Null and empty pages have an empty text. Pages without a host share the host ''. Very long pages are read whole; elements below
    DEPTH hang on the one at DEPTH, texts and all. Repeated rows stay, with equal texts, and count once in what the host tells; a
    tie between texts of a slot goes to the greater digest. Other columns stay, also one of this name (the new one is then named
    fresh(pages, out)). An empty table gives an empty one.
    """
    bounded_batches(pages.sparkSession)
    out = fresh(pages, out)
    names = {k: fresh(pages, f"_page_{k}") for k in ("host", "wrapper", "drop", "own", "main")}
    rows = pages.withColumn(names["host"], host_of(F.col(url)))
    looked = rows.select(F.col(names["host"]).alias("host"), F.arrow_udf(_shapes, SHAPE)(F.col(html)).alias("s")).select("host", "s.*")
    kinds = written(looked.distinct())
    wrappers = written(infer(kinds.select("host", "shape")))
    facts = written(wrappers.join(_facts(kinds, wrappers), "host", "left"))
    forget(kinds, wrappers)
    joined = rows.join(small(facts.toDF(*(names[k] for k in ("own", "wrapper", "drop", "main")))), F.col(names["host"]) == F.col(names["own"]), "left")

    def read(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        readers: dict[tuple, HostReader] = {}
        for batch in batches:
            texts = []
            for page, wrapper, drop, main in zip(*map(values, batch), strict=True):
                key = (wrapper, tuple((x["slot"], x["said"]) for x in drop or ()), tuple(main or ()))
                if key not in readers:
                    if len(readers) > 1_000:
                        readers.clear()
                    readers[key] = HostReader(json.loads(wrapper), dict(key[1]), frozenset(key[2]))
                texts.append(readers[key].text(page))
            yield pa.array(texts, pa.string())
        readers.clear()
        give_back()

    return joined.withColumn(out, F.arrow_udf(read, "string")(F.col(html), *(F.col(names[k]) for k in ("wrapper", "drop", "main")))).select(*pages.columns, out)


def _facts(kinds: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, drop: the slots that hold one text on most of SAME_PAGES or more pages, and that text; main: the main part's slots.

    Pages of one host that have all their text in common are copies and count once. Sums by slot and text are partial first.
    """

    def slots(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[tuple, dict[int, int]] = {}
        for batch in rows:
            out = []
            for shaped, wrapper, own in zip(*map(values, batch), strict=True):
                if (shaped, wrapper) not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[shaped, wrapper] = slots_between(json.loads(shaped), Reader(json.loads(wrapper)))
                to = known[shaped, wrapper]
                out.append([{**x, "slot": to.get(x["slot"], -1)} for x in own])
            yield pa.array(out, pa.list_(pa.struct([("slot", pa.int32()), ("said", pa.int64()), ("chars", pa.int32())])))

    def choose(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in rows:
            yield pa.array([main_slots(json.loads(w), {x["slot"]: (x["pages"], x["same"], x["chars"]) for x in own}) for w, own in zip(*map(values, batch), strict=True)], pa.list_(pa.int32()))

    rows = kinds.where(F.size("slots") > 0).join(small(wrappers), "host")
    each = rows.select("host", "page", F.explode(F.arrow_udf(slots, "array<struct<slot:int,said:long,chars:int>>")("shape", "wrapper", "slots")).alias("x")).select("host", "page", "x.*").distinct()
    by_text = each.groupBy("host", "slot", "said").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    by_slot = by_text.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "said")).alias("most"), F.sum("chars").alias("chars")).where("slot >= 0")
    by_slot = by_slot.withColumn("same", (F.col("pages") >= SAME_PAGES) & (F.col("most.n") > SAME_SHARE * F.col("pages")))
    listed = by_slot.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "pages", "same", "chars", "most.said"))).alias("s"))
    told = listed.join(wrappers, "host").select("host", "s", F.arrow_udf(choose, "array<int>")("wrapper", "s").alias("main"))
    dropped = F.transform(F.filter("s", lambda x: x["same"]), lambda x: F.struct(x["slot"].alias("slot"), x["said"].alias("said")))
    return told.select("host", dropped.alias("drop"), "main")


def main_slots(wrapper: list, counts: dict[int, tuple[int, bool, int]]) -> list[int]:
    """The slots of the wrapper's main part; counts: by slot, the pages that have it, whether it holds one text on most, characters.

    Empty if the pages are too few or nothing varies, so that the wrapper doesn't tell.
    """
    if max((pages for pages, *_ in counts.values()), default=0) < SAME_PAGES:
        return []

    def sums(node: tuple) -> tuple[int, int, int]:
        """Varying characters, varying texts, and those characters that are within links."""
        label, number, parts, _ = node
        if label[:1] == "#":
            pages, same, chars = counts.get(number, (0, True, 0))
            return (0, 0, 0) if same or label == "#x" else (chars, pages, 0)
        chars, texts, links = (sum(x) for x in zip((0, 0, 0), *map(sums, parts), strict=True))
        return chars, texts, chars if label.split(".")[0] == "a" else links

    def below(node: tuple) -> Iterator[tuple]:
        yield node
        for part in node[2]:
            yield from below(part)

    def chrome(node: tuple) -> bool:
        """Nothing that varies, only links, or short texts in repeated parts."""
        chars, texts, links = sums(node)
        lists = any(n[3] or n[0].split(".")[0] in ("ul", "ol") for n in below(node) if n[0][:1] != "#")
        return not chars or links == chars or lists and chars < SHORT * texts

    root = Reader(wrapper).root
    total = sums(root)[0]
    articles = [n for n in below(root) if n[0].split(".")[0] in ("article", "main")]
    inner = {n[1] for m in articles for n in below(m)} - {m[1] for m in articles} | {n[1] for m in articles for part in m[2] for n in below(part)}
    articles = [n for n in articles if n[1] not in inner]
    if total and 2 * sum(sums(n)[0] for n in articles) >= total:
        chosen = articles
    elif total:
        node = root
        while inner := [n for n in node[2] if n[0][:1] != "#" and not chrome(n)]:
            own = [n for n in node[2] if n[0][:1] == "#" and sums(n)[0]]
            if len(inner) > 1 or own or inner[0][3] or inner[0][0].split(".")[0] in TEXTUAL:
                break
            node = inner[0]
        lists = {n[1] for part in node[2] if part[0][:1] != "#" and sums(part)[0] and chrome(part) for n in below(part)}
        return [n[1] for n in below(node) if n[0][:1] == "#" and n[0] != "#x" and n[1] not in lists]
    else:
        return []
    return [n[1] for part in chosen for n in below(part) if n[0] == "#m"]


def _plain(w: list) -> list:
    return [w[0], [_plain(p) for p in w[2]]]


def _leaves(numbered: tuple, tree: list) -> dict[int, int]:
    """Slot numbers of a shape to the ids of the same leaves of its plain tree."""
    out, todo = {}, [(numbered, tree)]
    while todo:
        (label, number, parts, _), node = todo.pop()
        if label[:1] == "#":
            out[number] = id(node)
        todo += zip(parts, node[1], strict=True)
    return out


class HostReader:
    """Reads pages by their host's wrapper; what is found for a page's shape is kept."""

    def __init__(self, wrapper: list, drop: dict[int, int], main: frozenset[int]) -> None:
        self.reader, self.drop, self.main = Reader(wrapper), drop, main
        self.known: dict[str, tuple[Reader, dict[int, int]]] = {}

    def _slots(self, tree: list) -> tuple[dict[int, int], dict[int, int]]:
        """Of each leaf the slot of the page's own shape, and of each of those the host's slot."""
        own = shape(tree)
        key = json.dumps(own, separators=(",", ":"), ensure_ascii=False)
        if key not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            self.known[key] = (Reader(own), slots_between(own, self.reader))
        return self.known[key][0].read(tree), self.known[key][1]

    def text(self, page: str | None) -> str:
        """What the host's main part holds or, if it holds nothing of this page, its article or else its neutral texts."""
        tree, texts = page_tree(page)
        said: dict[int, list[str]] = {}
        kept: set[int] = set()
        if self.main or self.drop:
            slots, to = self._slots(tree)
            for leaf, _, raw in texts:
                said.setdefault(slots.get(id(leaf), -1), []).append(raw)
            same = {slot for slot, raws in said.items() if self.drop.get(to.get(slot, -1)) == _digest(" ".join(raws))}
            kept = {id(leaf) for leaf, *_ in texts if to.get(slots.get(id(leaf), -1), -1) in self.main and (leaf[0] == "#m" or leaf[0] == "#o" and slots.get(id(leaf)) not in same)}
        if not any(id(leaf) in kept and raw.strip() for leaf, _, raw in texts):
            zone = "#m" if any(leaf[0] == "#m" and raw.strip() for leaf, _, raw in texts) else "#o"
            kept = {id(leaf) for leaf, *_ in texts if leaf[0] == zone and (zone == "#m" or not self.drop or slots.get(id(leaf)) not in same)}
        blocks: list[list[str]] = []
        last = None
        for leaf, block, raw in texts:
            if id(leaf) in kept:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(entities.unescape(raw))
        return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def page_digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), out="text").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
