"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the table that training sees, and composed pages beside them.
MOST_LABELLED, COMPOSED = 200, 400

# Element kinds of HTML.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends open elements of these kinds, up to the nearest container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select div article section aside nav main body form blockquote td th".split())
# Names by which pages mark their parts.
PAGE_PARTS = frozenset("nav header footer aside form button select option dialog menu fieldset legend search".split())
PART_NAMES = frozenset("ad advert advertisement alert banner breadcrumb byline comment consent cookie disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo related reply search share sharing sidebar signup skip social sponsor sponsored subscribe tag toolbar topbar widget".split())

#: What may stand in head; any other element, and text, ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements whose content is never page text: up to their closing tag, or the page's end.
RAW = frozenset("script style template iframe noembed noframes".split())
#: As before, but without a closing tag only what stands up to the next tag is theirs.
PLAIN = frozenset(("title", "textarea"))
CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | PLAIN}
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: An attribute: its name, and its value in quotes or up to white space or the tag's end.
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
NAMES = frozenset(("class", "id", "role"))
#: References by number that are too long to be read as one, and leading zeros.
ZEROS, TOO_LONG = re.compile(r"&#([xX]?)0++(?=[0-9a-fA-F])"), re.compile(r"&#(?:[0-9]{9,}+|[xX][0-9a-fA-F]{9,}+);?")
#: Elements inside this many others count as their siblings.
DEEPEST = 200
NAME_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: its text, the chain of elements around it (tag and names) and how much of it is linked."""

    text: str
    path: tuple[str, ...]
    linked: float


class Markup:
    """The tags and texts of a page in order, in one pass: time grows with the page's length, whatever stands in it.

    As in browsers, a quote inside an unquoted value or a name is a character like others, and ``<`` before anything
    but a letter, ``/``, ``!`` or ``?`` is text. A value whose quote never closes ends its tag at the next ``>``.
    """

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def _find(self, what: str, start: int) -> int:
        """``str.find`` that looks for what isn't there any more only once."""
        if what in self.missing:
            return -1
        at = self.page.find(what, start)
        if at < 0:
            self.missing.add(what)
        return at

    def _tag_end(self, start: int) -> tuple[int, str]:
        """Place behind a tag's ``>`` (-1 without one) and its class, id and role names; attributes begin at ``start``."""
        page = self.page
        end = self._find(">", start)
        if end < 0 or page.find("=", start, end) < 0:
            return end + 1 if end >= 0 else -1, ""
        names, at = [], start
        while True:
            m = ATTRIBUTE.match(page, at)
            if m is None:
                end = self._find(">", at)
                break
            quoted = m[4][:1] if m[4] else ""
            if quoted in ('"', "'") and self._find(quoted, m.start(4) + 1) < 0:
                end = self._find(">", m.start(4))
                break
            if m[1].lower() in NAMES:
                names += [x for x in m.groups()[1:] if x]
            at = m.end()
        return end + 1 if end >= 0 else -1, " ".join(names).lower()

    def pieces(self) -> Iterator[tuple[str | None, bool, str]]:
        """``(None, False, text)`` or ``(tag, whether it closes, names)``."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                yield None, False, page[at:lt]
            if lt == n:
                return
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = lt + 5 if page.startswith(">", lt + 4) else self._find("-->", lt + 4) + 3
                at = end if end > 2 else n
                continue
            closes = after == "/"
            m = TAG_NAME.match(page, lt + 1 + closes)
            if m is None:
                if closes or after in ("!", "?"):
                    at = self._find(">", lt) + 1 or n
                    continue
                yield None, False, "<"
                at = lt + 1
                continue
            tag = m[0].lower()
            end, names = self._tag_end(m.end())
            if end < 0:
                return
            at = end
            yield tag, closes, names
            if not closes and tag in CLOSERS:
                shut = None if f"</{tag}" in self.missing else CLOSERS[tag].search(page, at)
                if shut is not None:
                    at = shut.start()
                    continue
                self.missing.add(f"</{tag}")
                at = n if tag in RAW else self._find("<", at)
                if at < 0:
                    return


def plain_text(text: str) -> str:
    """Character references decoded."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = TOO_LONG.sub("\ufffd", ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order, without those that have no text.

    Inline elements and br don't end a block. Open elements end as their kind, their container or a closing tag
    of an outer element says, and head with the first thing that can't stand in it; scripts, styles, comments,
    templates, text fields and what stands in head are no text.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # element and its node
    nodes: dict[tuple[int, str], int] = {}
    chains: list[tuple[str, ...]] = [()]
    skipped: dict[str, int] = {}
    parts: list[str] = []
    link_parts: list[str] = []
    link = in_head = False

    def flush() -> None:
        if parts:
            text = " ".join(plain_text("".join(parts)).split())
            if text:
                linked = len(plain_text("".join(link_parts)).strip()) / len(text)
                out.append(Block(text, chains[stack[-1][1] if stack else 0], min(linked, 1.0)))
            parts.clear()
            link_parts.clear()

    def end_head() -> None:
        while stack and any(t == "head" for t, _ in stack):
            stack.pop()

    for tag, closes, more in Markup(page).pieces():
        if tag is None:
            if in_head:
                if more.isspace():
                    continue
                end_head()
                in_head = False
            parts.append(more)
            if link:
                link_parts.append(more)
            continue
        if in_head and (tag == "head" if closes else tag not in IN_HEAD):
            end_head()
            in_head = False
            if closes:
                continue
        if tag == "a":
            link = not closes
            continue
        if tag not in BLOCK:
            if tag in VOID:
                parts.append(" ")
            continue
        flush()
        link = False
        if closes:
            if skipped.get(tag):
                skipped[tag] -= 1
            elif any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                skipped.clear()
            continue
        if tag in VOID or tag in PLAIN:
            continue
        if tag == "body":
            while stack and stack[-1][0] != "html":
                stack.pop()
        elif tag not in CLOSES:
            while stack and (stack[-1][0] == "p" or (stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit())):
                stack.pop()
        else:
            shut = CLOSES[tag]
            i = len(stack) - 1
            while i >= 0 and stack[i][0] not in SCOPE - shut:
                if stack[i][0] in shut:
                    del stack[i:]
                i -= 1
        if tag == "head":
            in_head = True
        if len(stack) == DEEPEST:
            skipped[tag] = skipped.get(tag, 0) + 1
            continue
        element = f"{tag} {more}" if more else tag
        parent = stack[-1][1] if stack else 0
        node = nodes.get((parent, element))
        if node is None:
            node = nodes[parent, element] = len(chains)
            chains.append((*chains[parent], element))
        stack.append((tag, node))
    flush()
    return out


#: Names of parts that words may begin with, as in ``commentlist``.
STEMS = tuple(sorted(x for x in PART_NAMES if len(x) > 5))


def name_words(element: str) -> list[str]:
    """Words of an element's names, plural s aside, and names of parts that they begin with."""
    own = [w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in NAME_WORD.findall(element.partition(" ")[2])]
    return own + [x for w in own if w not in PART_NAMES for x in STEMS if w.startswith(x)]


def kinds(path: tuple[str, ...]) -> list[str]:
    """Tags of the elements around a block; a header inside an article is the article's, not the page's."""
    tags = [e.partition(" ")[0] for e in path]
    first = min((k for k, t in enumerate(tags) if t in ("article", "main")), default=len(tags))
    return [t if t != "header" or k < first else "headline" for k, t in enumerate(tags)]


def path_features(path: tuple[str, ...]) -> list[str]:
    """Tags and name words of all ancestors, and which is innermost."""
    tags = kinds(path)
    out = {f"in:{t}" for t in tags} | {f"name:{w}" for e in path for w in name_words(e)}
    return sorted(out | {f"at:{tags[-1]}" if tags else "at:"})


def text_features(block: Block) -> list[str]:
    n = len(block.text)
    out = [f"chars:{min(n.bit_length(), 10)}", f"linked:{int(block.linked * 3.99)}"]
    out.append("stop" if block.text[-1] in ".!?:;\"')»”…" else "no stop")
    if "©" in block.text:
        out.append("copyright")
    return out


@dataclass
class ChainModel:
    """Weights of features for (other, main), of the first label and of label pairs."""

    weights: dict[str, tuple[float, float]]
    start: tuple[float, float]
    pairs: tuple[tuple[float, float], tuple[float, float]]
    of_path: dict[tuple[str, ...], tuple[float, float]] = field(default_factory=dict)

    def emission(self, block: Block) -> tuple[float, float]:
        own = self.of_path.get(block.path)
        if own is None:
            if len(self.of_path) > 20_000:
                self.of_path.clear()
            found = [self.weights[f] for f in path_features(block.path) if f in self.weights]
            own = self.of_path[block.path] = (sum(x[0] for x in found), sum(x[1] for x in found))
        a, b = own
        for f in text_features(block):
            w = self.weights.get(f)
            if w:
                a, b = a + w[0], b + w[1]
        return a, b

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi; of equal paths the one that stays with ``other`` wins."""
        if not blocks:
            return []
        (s0, s1), ((p00, p01), (p10, p11)) = self.start, self.pairs
        e0, e1 = self.emission(blocks[0])
        a, b = s0 + e0, s1 + e1
        back = []
        for block in blocks[1:]:
            e0, e1 = self.emission(block)
            from0, from1 = b + p10 > a + p00, b + p11 > a + p01
            back.append((from0, from1))
            a, b = (b + p10 if from0 else a + p00) + e0, (b + p11 if from1 else a + p01) + e1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit_chain(pages: list[list[tuple[Block, int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 11) -> ChainModel:
    """Conditional likelihood by AdaGrad, a page a step: observed less expected feature counts by forward-backward."""
    index: dict[str, int] = {}
    data = []
    for page in pages:
        if page:
            feats = [np.array([index.setdefault(f, len(index)) for f in path_features(b.path) + text_features(b)]) for b, _ in page]
            data.append((feats, [y for _, y in page]))
    w, gw = np.zeros((len(index), 2)), np.full((len(index), 2), 1e-6)
    start, gs = np.zeros(2), np.full(2, 1e-6)
    pairs, gp = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for feats, labels in data:
            n = len(feats)
            e = np.array([w[f].sum(axis=0) for f in feats])
            fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
            fwd[0] = start + e[0]
            for i in range(1, n):
                fwd[i] = np.logaddexp(fwd[i - 1][0] + pairs[0], fwd[i - 1][1] + pairs[1]) + e[i]
            for i in range(n - 2, -1, -1):
                x = pairs + (e[i + 1] + bwd[i + 1])
                bwd[i] = np.logaddexp(x[:, 0], x[:, 1])
            total = np.logaddexp(*fwd[-1])
            node = np.exp(fwd + bwd - total)
            step_p = np.zeros((2, 2))
            for i in range(n - 1):
                step_p -= np.exp(fwd[i][:, None] + pairs + e[i + 1] + bwd[i + 1] - total)
                step_p[labels[i], labels[i + 1]] += 1
            given = np.zeros((n, 2))
            given[np.arange(n), labels] = 1
            diff = given - node
            at = np.concatenate(feats)
            grad = np.zeros_like(w)
            np.add.at(grad, at, np.repeat(diff, [len(f) for f in feats], axis=0))
            used = np.unique(at)
            g = grad[used] - decay * w[used]
            gw[used] += g * g
            w[used] += rate * g / np.sqrt(gw[used])
            gs += diff[0] ** 2
            start += rate * diff[0] / np.sqrt(gs)
            gp += step_p**2
            pairs += rate * step_p / np.sqrt(gp)
    return ChainModel({f: (float(w[i, 0]), float(w[i, 1])) for f, i in index.items()}, tuple(start.tolist()), tuple(map(tuple, pairs.tolist())))


def marked_labels(page: str) -> list[tuple[Block, int]]:
    """Blocks labelled by a page's own marking; empty where it doesn't mark its article.

    Main is what stands in article or main and in no part of the page that has another name.
    """
    found = blocks_of(page)
    if not any(e.partition(" ")[0] in ("article", "main") for b in found for e in b.path):
        return []
    out = []
    for b in found:
        tags = set(kinds(b.path))
        other = tags & PAGE_PARTS or any(w in PART_NAMES for e in b.path for w in name_words(e))
        out.append((b, int(bool(tags & {"article", "main"}) and not other)))
    return out


# How composed pages wrap their article and their other parts.
ARTICLE_WRAPS = ("<article>|</article>", "<main><article class='post'>|</article></main>", "<main>|</main>", "<div class='content'>|</div>", "<div id='main-content'><div class='article-body'>|</div></div>", "<section class='entry story'>|</section>", "<div class='page'><div class='post-text'>|</div></div>", "<table><tr><td class='body'>|</td></tr></table>", "<div>|</div>", "<div class='wrap'><div class='col'>|</div></div>")
TOP_PARTS = ("<nav><ul>{links}</ul></nav>", "<header><div class='logo'>{short}</div><ul class='menu'>{links}</ul></header>", "<div class='navbar'>{inline}</div>", "<div id='header'><p>{short}</p></div>", "<div class='masthead'><p>{text}</p></div>", "<div class='ad'>{text}</div>", "<div class='cookie-notice'><p>{text}</p></div>", "<div id='breadcrumb'>{inline}</div>", "<div class='banner promo'><p>{text}</p></div>", "<form class='search'><p>{short}</p><button>{word}</button></form>", "<header><h1>{short}</h1><p>{text}</p></header>", "<div class='alert'>{text}</div>", "<div class='advert sponsored'>{text}</div>")
INNER_PARTS = ("<div class='ad'>{text}</div>", "<aside><p>{text}</p></aside>", "<div class='share'>{inline}</div>", "<form><p>{text}</p><select><option>{word}</option></select></form>", "<div class='newsletter'><p>{text}</p></div>", "<aside class='advert'>{text}</aside>", "<div class='notice'>{text}</div>", "<nav class='toc'><ul>{links}</ul></nav>")
BOTTOM_PARTS = ("<footer>&copy; {short}</footer>", "<footer><p>{text}</p><ul>{links}</ul></footer>", "<aside class='sidebar'><h3>{short}</h3><ul>{links}</ul></aside>", "<div class='sidebar'><h3>{short}</h3><p>{text}</p></div>", "<section id='comments'><h2>{short}</h2><div class='comment'><p>{text}</p></div><div class='comment'><p>{text2}</p></div></section>", "<section class='comments'><article class='comment'><p>{text}</p></article><article class='comment'><p>{text2}</p></article></section>", "<div class='comments'><ul><li><p>{text}</p></li><li><p>{text2}</p></li></ul></div>", "<ol class='commentlist'><li><p>{text}</p></li><li><p>{text2}</p></li></ol>", "<div class='related'><ul>{links}</ul></div>", "<form><p>{short}</p><label>{word}</label><button>{word}</button></form>", "<div class='footer'><p>{text}</p></div>", "<dialog><p>{text}</p></dialog>", "<div class='cookie consent'><p>{text}</p><button>{word}</button></div>", "<div class='popup subscribe'><p>{text}</p></div>")


def composed_pages(texts: list[str], count: int, seed: int = 5) -> list[list[tuple[Block, int]]]:
    """Labelled pages put together from real paragraphs: the article in one of the wraps, other parts around and in it."""
    draw = random.Random(seed)
    texts = [t for t in texts if t] or ["Lorem ipsum dolor sit amet.", "Sed ut perspiciatis unde omnis."]

    def some(low: int, high: int) -> str:
        words = draw.choice(texts).split()
        i = draw.randrange(max(1, len(words) - low))
        return html.escape(" ".join(words[i : i + draw.randint(low, high)]) or "x")

    def part(kinds: tuple[str, ...]) -> str:
        link = lambda: f"<a href='#'>{some(1, 3)}</a>"
        n = draw.randint(3, 8)
        said = some(4, 30) + draw.choice((".", "", "!"))
        return draw.choice(kinds).format(links="".join(f"<li>{link()}</li>" for _ in range(n)), inline=draw.choice((" ", " | ", " &gt; ")).join(link() for _ in range(n)), short=some(1, 5), text=said, text2=some(5, 60) + ".", word=some(1, 1))

    out = []
    for _ in range(count):
        front, back = draw.choice(ARTICLE_WRAPS).split("|")
        chunks: list[tuple[str, int]] = [("<html><body>", 0)]
        chunks += [(part(TOP_PARTS), 0) for _ in range(draw.randint(0, 4))]
        chunks.append((front, 1))
        if draw.random() < 0.8:
            chunks.append((f"<h1>{some(3, 10)}</h1>", 1) if draw.random() < 0.7 or not re.match("<(article|main)", front) else (f"<header><h1>{some(3, 10)}</h1></header>", 1))
        for _ in range(draw.randint(1, 9)):
            body = some(3, 12) if draw.random() < 0.2 else some(10, 90)
            shape = draw.random()
            if shape < 0.1:
                chunks.append((f"<h2>{some(2, 8)}</h2>", 1))
            elif shape < 0.18:
                chunks.append(("<ul>" + "".join(f"<li>{some(3, 14)}</li>" for _ in range(draw.randint(2, 4))) + "</ul>", 1))
            elif shape < 0.24:
                chunks.append((f"<blockquote><p>{body}.</p></blockquote>", 1))
            else:
                chunks.append((f"<p>{'<b>' if draw.random() < 0.2 else ''}{body}.</p>", 1))
            if draw.random() < 0.12:
                chunks.append((part(INNER_PARTS), 0))
        chunks.append((back, 1))
        chunks += [(part(BOTTOM_PARTS), 0) for _ in range(draw.randint(0, 4))]
        page, spans = "", []
        for text, label in chunks:
            # Labels ride along as marks that no text has.
            page += re.sub(r">([^<]+)<", lambda m, y=label: f">{y}{m[1]}<" if m[1].strip() else m[0], text)
        for b in blocks_of(page):
            label = int(b.text[b.text.index("") + 1]) if "" in b.text else 0
            b.text = re.sub("[01]", "", b.text).strip()
            if b.text:
                spans.append((b, label))
        out.append(spans)
    return out


def train(pages: list[str], composed: int = COMPOSED) -> ChainModel:
    """From a bounded list of pages: those that mark their article, and pages composed of their paragraphs."""
    marked = [x for x in map(marked_labels, pages) if x]
    texts = [b.text for page in marked for b, y in page if y]
    return fit_chain(marked + composed_pages(texts, composed))


def extract(page: str | None, model: ChainModel) -> str:
    found = blocks_of(page or "")
    return "\n".join([b.text for b, y in zip(found, model.decode(found)) if y])


def labelled_sample(pages: DataFrame, most: int, id_col: str, html_col: str) -> list[str]:
    """At most ``most`` pages of different ids, the first by a hash of the id."""
    ids = [r[0] for r in pages.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(most).collect()]
    rows = pages.where(F.col(id_col).isin(ids)).groupBy(id_col).agg(F.min(html_col).alias("page")).collect() if ids else []
    return sorted(r["page"] for r in rows if r["page"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row; main blocks in page order, joined by a line end.

    Null, empty and text-less pages give the empty text. Repeated rows come back each; other columns are ignored;
    an empty table gives an empty result. The model is fitted on at most ``most_labelled`` pages of the table and a
    fixed number of composed ones, and broadcast; it has a weight a feature met in them.
    """
    model = train(labelled_sample(pages, most_labelled, id_col, html_col))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [extract(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
