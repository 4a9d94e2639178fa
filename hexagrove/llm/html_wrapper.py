"""HTML extraction by wrapper induction.

A host's pages fall into layouts: the boxes of the top two levels, without named parts. Every page is aligned
with its layout's reference page (the one nearest to a fixed size) by simple tree matching: the largest
order-keeping mapping of equal-tagged nodes. A reference node whose matches hold the same text on nearly all
pages is template, for all layouts of the host; the others are varying slots. Pages that mostly repeat the
reference in what varies are no evidence, so copies of an article never turn it into template. The content
root is the lowest node that holds all varying text of the layout. A page's text is then
the blocks under that root, without template nodes and without parts whose tag says what they are:
menus, headers, footers, asides, forms, scripts, styles. A class, id or role that names boilerplate (whole
names only) is evidence, not a verdict: such a part goes if it holds less than ``SMALL`` of the host's
varying text, constant text included as none. A part with the page's article, its main or, where the page has
neither outside it, most of its text is never left out for its name.

Votes are added up as patterns inside tasks before they are shuffled, so a host with a third of all pages
sends a few rows for each task. Paths hold classes without digits and no ids, which may differ on each page.
Reference pages and wrappers, one each for a layout, are broadcast only when their measured size allows, else
both sides are joined by host and layout.

Cases: pages of any depth are read; names below ``DEEP`` levels are no evidence; a null or empty page gives an empty text; unclosed, unknown and broken tags are read leniently; a
page without a host shares the empty host; a layout with fewer than three different pages learns
no template of its own; a page that lacks the content root falls back to its own article, main or body; equal pages each get a row; an
empty table gives an empty result; other columns pass through, a column named like the output is replaced.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexagrove.llm.common import sets_aside, settle, small_side

#: Tags and names below are fixed values of HTML and of this extractor.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object canvas xmp noframes".split())
OUT_TAGS = set("nav footer aside form button select option fieldset dialog menu head audio video map".split()) | RAW
OUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner sidebar widget cookie cookies consent gdpr notice notices alert menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager "
    "contentinfo complementary search form dialog".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"tr", "td", "th"}}
#: These and named parts may wrap a whole page; then they stay.
BOXES = {"div", "section", "article", "main"}
WRAPPERS = {"header", "form", "fieldset", "dialog"}
SMALL = 0.3
#: Levels that a path tells apart.
DEEP = 100
SCOPE = set("ul ol dl table article section div body html main".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


class Node:
    """A block element; inline elements leave only their text in ``parts``."""

    __slots__ = ("tag", "names", "label", "parts", "parent", "out", "hint", "children", "depth", "inside")

    def __init__(self, tag: str, names: str, parent: Node | None, label: str = ""):
        self.tag, self.names, self.parent, self.label = tag, names, parent, label
        self.parts: list[str | Node] = []
        self.children: list[Node] = []
        whole = set(names.split())
        self.depth = 0 if parent is None else parent.depth + 1
        within = parent is not None and parent.inside
        self.inside = within or tag in ("article", "main")
        fixed = tag in ("html", "body", "main")
        self.out = not fixed and (tag in OUT_TAGS or (not within and tag == "header") or "hidden" in whole)
        self.hint = self.depth <= DEEP and not fixed and (bool(OUT_NAMES.intersection(whole)) or (not within and "header" in whole))

    def path_under(self, path: str) -> str:
        """The path below a parent's path; nodes deeper than ``DEEP`` go by that of their ancestor there."""
        return path if self.depth > DEEP else f"{path}/{self.step()}"

    def step(self) -> str:
        """Tag and classes as part of a path; "!" marks a named part."""
        step = f"{self.tag}.{self.label}" if self.label else self.tag
        return step + "!" if self.hint else step


def parse(page: str) -> Node:
    root = node = Node("html", "", None)
    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            node.parts.append(page[at:])
            break
        if found.start() > at:
            node.parts.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag in INLINE:
            continue
        if found[1]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag in VOID:
            node.parts.append(" ")
            continue
        if tag == "html" or (tag == "body" and any(c.tag == "body" for c in root.children)):
            continue
        if tag in CLOSED_BY:
            up, closes = node, None
            while up is not None and up.tag not in SCOPE:
                closes = up if up.tag in CLOSED_BY[tag] else closes
                up = up.parent
            node = closes.parent if closes is not None and closes.parent is not None else node
        elif tag not in RAW:
            up = node
            while up is not None and up.tag not in SCOPE and up.tag != "p":
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                node = up.parent
        names = " ".join(m[1].lower() if m[2] is None or m[1].lower() == "hidden" else m[2].strip("\"'").lower() for m in NAMED.finditer(found[3])) if found[3] else ""
        label = " ".join(re.sub(r"\d+", "#", m[2].strip("\"'").lower().replace("/", "|").replace("!", "|")) for m in NAMED.finditer(found[3]) if m[2] and m[1].lower() == "class") if names else ""
        child = Node(tag, names, node, label)
        node.parts.append(child)
        node.children.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
        elif not found[3].endswith("/"):
            node = child
    spare(root)
    return root


def spare(root: Node) -> None:
    """Take marks back from nodes that hold the page's article or main, or, without one elsewhere, most of its text."""
    nodes, marked = [root], False
    for node in nodes:
        nodes += node.children
        marked |= node.hint or (node.out and node.tag not in RAW and node.tag != "head")
    if not marked:
        return
    held: dict[int, int] = {}
    for node in reversed(nodes):
        own = 0 if node.tag in RAW or node.tag == "head" else sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        held[id(node)] = own + sum(held[id(c)] for c in node.children)
    total = held[id(root)]
    article = max((n for n in nodes if n.tag in ("article", "main")), key=lambda n: held[id(n)], default=None)
    if article is not None and 4 * held[id(article)] < total:
        article = None
    up = article
    while up is not None:
        if up.tag not in RAW:
            up.out = up.hint = False
        up = up.parent
    if article is None:
        for node in nodes:
            if 2 * held[id(node)] > total and node.tag not in RAW and (node.tag not in OUT_TAGS or node.tag in WRAPPERS):
                node.out = node.hint = False


def clean(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((references.unescape(text) if "&" in text else text).split())


def own_blocks(node: Node) -> list[str | Node]:
    """A node's parts with neighbouring text joined and cleaned, empty text left out."""
    out: list[str | Node] = []
    run: list[str] = []
    for part in [*node.parts, node]:
        if isinstance(part, str):
            run.append(part)
            continue
        if run and (text := clean(run)):
            out.append(text)
        run = []
        if part is not node:
            out.append(part)
    return out


def own_text(node: Node) -> str:
    return clean([p if isinstance(p, str) else " " for p in node.parts])


def kept_nodes(root: Node) -> Iterator[tuple[Node, str]]:
    """Nodes that do not say they are boilerplate, with their paths."""
    stack = [(root, root.step())]
    while stack:
        node, path = stack.pop()
        if node.out:
            continue
        yield node, path
        stack += [(c, c.path_under(path)) for c in reversed(node.children)]


def layout_of(page: str) -> str:
    """A hash of the boxes on the top two levels, in any order and number; named parts come and go, so they don't count."""
    root = parse(page)
    top = next((c for c in root.children if c.tag == "body"), root)
    found = set()
    for a in top.children:
        if a.tag in BOXES and not a.out and not a.hint:
            found.add(a.step())
            if a.tag not in ("article", "main"):
                found.update(f"{a.step()}/{b.step()}" for b in a.children if b.tag in BOXES and not b.out and not b.hint)
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def tree_match(a: Node, b: Node, memo: dict[tuple[int, int], tuple[int, int, list]]) -> int:
    """The size of the largest order-keeping mapping. ``memo`` keeps for each pair of nodes with children
    its size, how many children match in pairs from the first on (no other mapping of leaves is larger), and
    the table of the rest. Children come before their parents, without recursion: pages may be deep."""

    def size(x: Node, y: Node) -> int:
        if x.tag != y.tag:
            return 0
        return memo[id(x), id(y)][0] if x.children and y.children else 1

    stack = [(a, b)] if a.tag == b.tag and a.children and b.children else []
    while stack:
        x, y = stack[-1]
        if (id(x), id(y)) in memo:
            stack.pop()
            continue
        inner, others = [c for c in x.children if c.children], [d for d in y.children if d.children]
        waiting = [(c, d) for c in inner for d in others if c.tag == d.tag and (id(c), id(d)) not in memo]
        if waiting:
            stack += waiting
            continue
        stack.pop()
        paired = 0
        for c, d in zip(x.children, y.children):
            if c.tag != d.tag or c.children or d.children:
                break
            paired += 1
        table = [[0] * (len(y.children) - paired + 1)]
        for c in x.children[paired:]:
            above, row = table[-1], [0]
            for j, d in enumerate(y.children[paired:]):
                best = above[j + 1] if above[j + 1] > row[j] else row[j]
                w = above[j] + size(c, d) if c.tag == d.tag else 0
                row.append(w if w > best else best)
            table.append(row)
        memo[id(x), id(y)] = (1 + paired + table[-1][-1], paired, table)
    return size(a, b)


def aligned(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The node pairs of the mapping, traced back through the tables."""
    memo: dict[tuple[int, int], tuple[int, int, list]] = {}
    tree_match(a, b, memo)
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if (id(x), id(y)) not in memo:
            continue
        _, paired, table = memo[id(x), id(y)]
        stack += zip(x.children[:paired], y.children[:paired])
        i, j = len(table) - 1, len(table[0]) - 1
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                stack.append((x.children[paired + i], y.children[paired + j]))
    return pairs


def slots_of(reference: Node) -> list[tuple[Node, str, str]]:
    """The reference's nodes with text, in page order: (node, path, text)."""
    return [(node, path, text) for node, path in kept_nodes(reference) if (text := own_text(node))]


def votes(reference: Node, slots: dict[int, tuple[int, str]], page: Node) -> tuple[str, Counter]:
    """A character for each slot of the reference (0 unmatched, 1 other text, 2 same text), and characters of text by path."""
    chars: Counter = Counter()
    for node, path in kept_nodes(page):
        if n := len(own_text(node)):
            chars[path] += n
    pattern = ["0"] * len(slots)
    for a, b in aligned(reference, page):
        if id(a) in slots and not b.out:
            k, text = slots[id(a)]
            pattern[k] = "2" if own_text(b) == text else "1"
    return "".join(pattern), chars


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[tuple, tuple] = {}
    patterns, chars = Counter(), Counter()

    def ballots() -> pd.DataFrame:
        rows = [(*key, True, n) for key, n in patterns.items()] + [(*key, False, n) for key, n in chars.items()]
        patterns.clear()
        chars.clear()
        return pd.DataFrame(rows, columns=["host", "__layout", "value", "is_pattern", "n"])

    for batch in batches:
        for host, layout, page, ref in zip(batch["host"], batch["__layout"], batch["html"], batch["reference"]):
            key = (host, layout)
            if key not in seen:
                if len(seen) > 500:
                    seen.clear()
                root = parse(ref)
                seen[key] = (root, {id(node): (k, text) for k, (node, _, text) in enumerate(slots_of(root))})
            pattern, lengths = votes(*seen[key], parse(page))
            patterns[(*key, pattern)] += 1
            for path, n in lengths.items():
                chars[(*key, path)] += n
        if len(patterns) + len(chars) > 100_000:
            yield ballots()
    yield ballots()


TEXTUAL = set("p h1 h2 h3 h4 h5 h6 ul ol li dl table blockquote pre".split())


def content_path(chars: dict[str, int]) -> str:
    """The lowest node that holds all varying text: descend while one child has all of it; stop at an article or main."""
    under: Counter = Counter()
    below: dict[str, set[str]] = defaultdict(set)
    for path, n in chars.items():
        steps = path.split("/")
        for k in range(len(steps)):
            under["/".join(steps[: k + 1])] += n
            if k:
                below["/".join(steps[:k])].add("/".join(steps[: k + 1]))
    here = "html"
    while True:
        best = max(below[here], key=lambda p: (under[p], p), default="")
        tag = best.rsplit("/", 1)[-1].split(".")[0].rstrip("!")
        if not best or under[best] < under[here] or tag in TEXTUAL:
            return here
        here = best
        if tag in ("article", "main"):
            return here


def induce(reference: str, constant: dict[int, int], chars: dict[str, int], share: float = 0.9) -> tuple[str, list[str], list[tuple[str, str]]]:
    """The wrapper of a layout: content root, named parts that stay, template texts by path. ``constant`` has
    the template slots with the number of pages of the same text."""
    slots = slots_of(parse(reference))
    template, fixed = set(), Counter()
    for k, same in constant.items():
        template.add(slots[k][1:])
        fixed[slots[k][1]] += same * len(slots[k][2])
    varying = {path: n - fixed[path] for path, n in chars.items() if n - fixed[path] > (1 - share) * n}
    under, total = Counter(), sum(varying.values())
    for path, n in varying.items():
        steps = path.split("/")
        for k, step in enumerate(steps):
            if step.endswith("!"):
                under["/".join(steps[: k + 1])] += n
    kept = sorted(path for path, n in under.items() if n >= SMALL * total)
    return content_path({path: n for path, n in varying.items() if not dropped(path, kept)}), kept, sorted(template)


def dropped(path: str, kept: list[str] | set[str]) -> bool:
    """Whether a path runs through a named part that is not among the kept ones."""
    if "!" not in path:
        return False
    steps = path.split("/")
    return any(step.endswith("!") and "/".join(steps[: k + 1]) not in kept for k, step in enumerate(steps))


def extract_text(page: str, wrapper: dict) -> str:
    root = parse(page)
    template = {tuple(t) for t in wrapper["template"]}
    kept = set(wrapper["kept"])
    nodes = [(n, p) for n, p in kept_nodes(root) if not dropped(p, kept)]
    tops = [(n, p) for n, p in nodes if n.depth <= DEEP and p == wrapper["root"]]
    if not tops:
        tops = [(n, p) for n, p in nodes if n.tag in ("article", "main")][:1] or [(n, p) for n, p in nodes if n.tag == "body"][:1] or [(root, "html")]
    out: list[str] = []
    for top, path in tops:
        stack: list[tuple[str | Node, str]] = [(top, path)]
        while stack:
            part, here = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif not part.out and not (part.hint and here not in kept):
                blocks = own_blocks(part)
                if template and (here, own_text(part)) in template:
                    blocks = [b for b in blocks if not isinstance(b, str)]
                stack += [(p, here if isinstance(p, str) else p.path_under(here)) for p in reversed(blocks)]
    return "\n".join(out)


@sets_aside
def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", out: str = "text", reference_chars: int = 2000, broadcast_bytes: int = 32 << 20, least_pages: int = 3, share: float = 0.9) -> DataFrame:
    """``pages`` with the main text of each page in ``out`` instead of the html."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in (html, out, "host")]
    rows = pages.select(*keep, host.alias("host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))

    @F.pandas_udf("string")
    def layout(htmls: pd.Series) -> pd.Series:
        return pd.Series([layout_of(h) for h in htmls], dtype=object)

    @F.pandas_udf("array<int>")
    def lengths(refs: pd.Series) -> pd.Series:
        return pd.Series([[len(text) for _, _, text in slots_of(parse(r))] for r in refs], dtype=object)

    group = ["host", "__layout"]
    rows = rows.withColumn("__layout", layout("html"))
    off = F.abs(F.log((F.length("html") + 1) / F.lit(float(reference_chars))))
    chosen = rows.groupBy(*group).agg(F.min_by("html", F.struct(off.alias("off"), F.col(key).alias("id"))).alias("reference"))
    chosen = settle(chosen.withColumn("lengths", lengths("reference")))
    size = chosen.agg(F.sum(F.length("reference")), F.count(F.lit(1))).first()
    layouts, fits = size[1], int((size[0] or 0) <= broadcast_bytes)
    small = small_side(chosen.drop("lengths"), layouts, layouts * fits)
    ballots = rows.select(*group, "html").join(small, group).mapInPandas(_vote, "host string, __layout string, value string, is_pattern boolean, n long")
    counts = settle(ballots.groupBy(*group, "value", "is_pattern").agg(F.sum("n").alias("n")))

    marks = counts.where("is_pattern").select(*group, "value", "n", F.posexplode(F.filter(F.split("value", ""), lambda c: c != "")).alias("slot", "mark")).where("mark <> '0'")
    marks = marks.withColumn("same", F.col("n") * (F.col("mark") == "2").cast("int"))
    tally = marks.groupBy(*group, "slot").agg(F.sum("n").alias("pages"), F.sum("same").alias("same_pages"))
    # What varies on the host weighs in whether a page repeats the reference; what never does says nothing.
    weighed = tally.join(chosen.drop("reference"), group).select(*group, "slot", "same_pages", (F.expr("lengths[slot]") * (1 - F.col("same_pages") / F.col("pages"))).alias("weight"))
    weighed = marks.join(weighed, [*group, "slot"])
    own = weighed.groupBy(*group, "value").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("mark") == "2", F.col("weight")).otherwise(0.0)).alias("again")).where("2 * again < all").select(*group, "value")
    constant = weighed.join(own, [*group, "value"], "left_semi").groupBy(*group, "slot").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.max("same_pages").alias("same_pages"))
    constant = constant.where((F.col("n") >= least_pages) & (F.col("same") >= share * F.col("n")))
    constant = constant.groupBy(*group).agg(F.collect_list(F.struct("slot", "same_pages")).alias("constant"))
    paths = counts.where(~F.col("is_pattern")).groupBy(*group).agg(F.collect_list(F.struct("value", "n")).alias("paths"))

    @F.pandas_udf("root string, kept array<string>, template array<struct<path: string, text: string>>")
    def wrap(refs: pd.Series, constants: pd.Series, lists: pd.Series) -> pd.DataFrame:
        found = []
        for ref, fixed, chars in zip(refs, constants, lists):
            root, kept, template = induce(ref, {v["slot"]: v["same_pages"] for v in (() if fixed is None else fixed)}, {v["value"]: v["n"] for v in (() if chars is None else chars)}, share)
            found.append((root, kept, [{"path": p, "text": t} for p, t in template]))
        return pd.DataFrame(found, columns=["root", "kept", "template"])

    # A layout whose pages hold no text has no ballots, but its pages have rows.
    made = settle(chosen.join(constant, group, "left").join(paths, group, "left").select(*group, wrap("reference", "constant", "paths").alias("w")))
    shared = made.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("w.template"))).alias("template"))
    whole = F.to_json(F.struct("w.root", "w.kept", F.transform("template", lambda t: F.array(t["path"], t["text"])).alias("template")))
    wrappers = settle(made.join(shared, "host").select(*group, whole.alias("wrapper")))

    @F.pandas_udf("string")
    def text_of(htmls: pd.Series, jsons: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}
        return pd.Series([extract_text(h, known.get(w) or known.setdefault(w, json.loads(w))) if h else "" for h, w in zip(htmls, jsons)], dtype=object)

    length = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    joined = rows.join(small_side(wrappers, layouts, layouts * int(length <= broadcast_bytes)), group)
    return joined.select(*keep, text_of("html", "wrapper").alias(out))
