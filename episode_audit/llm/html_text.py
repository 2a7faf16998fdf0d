"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: stretches of text between block-level tags,
each with its chain of open ancestors (tag, class and id words). Scripts,
styles, the head and comments have no blocks. Features of a block are its
ancestors' tags and name words, its own tag, and the text's length, share of
linked words, punctuation and a few signs. The field scores every block and
every pair of neighbours, and Viterbi finds the best labels of the whole page.
Blocks labelled as text are joined by line breaks, nothing of them is cut.

The field is trained in numpy (gradient of the log-likelihood by forward and
backward sums) on labelled pages: a bounded sample of pages (`SAMPLE`, those with
the lowest hash of their id) whose one `article` element tells the labels, and
pages composed from the sample's own sentences in `CONTAINERS` among `FURNITURE`
with the labels known by construction, so that it does not lean on one tag.

Null and empty pages and pages without text give an empty text. Unclosed and
stray tags are tolerated. With no page in the sample that has an article the
field is trained on composed pages alone, with stand-in sentences. Null ids,
repeated rows and columns of any other name are carried along.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted

SAMPLE, LONGEST = 300, 60_000
COMPOSED, EPOCHS, RATE, SHRINK = 400, 12, 0.3, 1e-4

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "title"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

CONTAINERS = (
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="post-content">{}</div>',
    '<div id="content">{}</div>', '<section class="article-body">{}</section>', '<div class="entry story">{}</div>',
    '<div class="main text"><div class="body">{}</div></div>', '<article class="post"><div class="entry-content">{}</div></article>',
    "{}", "<div>{}</div>", '<div id="page"><div>{}</div></div>',
)
PARAGRAPHS = (
    "<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</li><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>",
    "<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td><td>{}</td></tr></table>",
)
#: Page furniture by where it stands: before, inside and after the text. {} takes a sentence.
FURNITURE = (
    (
        '<header><div class="logo"><a href="/">{}</a></div></header>', '<nav><ul><li><a href="#">{}</a></li><li><a href="#">{}</a></li><li><a href="#">{}</a></li></ul></nav>',
        '<div class="menu"><a href="#">{}</a><div><a href="#">{}</a></div></div>', '<div class="cookie-notice"><p>{}</p><button>{}</button></div>',
        '<div class="ad">{}</div>', '<div class="banner notice">{}</div>', '<div class="breadcrumb"><a href="#">{}</a></div>', '<div role="alert" class="alert">{}</div>',
        '<div id="header"><h2><a href="/">{}</a></h2><p>{}</p></div>', '<form class="search"><label>{}</label><input name="q"><button>{}</button></form>',
        '<aside class="sidebar"><h3>{}</h3><p>{}</p><ul><li><a href="#">{}</a></li></ul></aside>', '<div id="consent"><p>{}</p></div>',
    ),
    (
        '<div class="ad advert">{}</div>', '<aside class="related"><h4>{}</h4><p>{}</p></aside>', '<div class="share"><a href="#">{}</a></div>',
        '<form class="newsletter"><p>{}</p><button>{}</button></form>', '<div class="promo sponsored"><p>{}</p></div>', '<div class="subscribe-box notice"><p>{}</p></div>',
        '<aside><p>{}</p></aside>', '<nav class="toc"><ul><li><a href="#">{}</a></li></ul></nav>', '<div class="advertisement"><p>{}</p></div>',
    ),
    (
        '<section class="comments"><h3>{}</h3><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>',
        '<div id="comments"><ol><li class="comment-body"><p>{}</p></li><li><p>{}</p></li></ol></div>', '<footer>&copy; {} &middot; {}</footer>',
        '<footer><p>{}</p><ul><li><a href="#">{}</a></li></ul></footer>', '<div class="footer">&copy; {}</div>', '<div class="sidebar widget"><h3>{}</h3><p>{}</p></div>',
        '<form action="/comment"><p>{}</p><textarea></textarea><button>{}</button></form>', '<div class="related-posts"><ul><li><a href="#">{}</a></li><li><a href="#">{}</a></li></ul></div>',
        '<div class="ads">{}</div>', '<aside id="right-column"><div><p>{}</p></div></aside>', '<section class="replies responses"><article class="comment"><p>{}</p></article></section>',
        '<div class="newsletter signup"><form><p>{}</p></form></div>', '<div class="legal disclaimer"><p>{}</p></div>',
    ),
)

#: References with more digits than any code point has; only leading zeros make one of them valid.
LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")
IN_HEAD = {"head", "html", "title", "meta", "link", "script", "style", "base", "noscript", "template"}


def short_reference(m: re.Match) -> str:
    digits = (m[1] or m[2]).lstrip("0") or "0"
    if len(digits) > 7:
        return "\ufffd"
    return f"&#{'' if m[1] else 'x'}{digits};"


Block = tuple[str, int, int, tuple]  # text, words, linked words, ancestors


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    path: tuple = ()
    text: list[str] = []
    linked, link_words, at, in_head = 0, 0, 0, False

    def close() -> None:
        nonlocal link_words
        if text:
            words = html.unescape(LONG_REFERENCE.sub(short_reference, "".join(text))).split()
            if words:
                out.append((" ".join(words), len(words), link_words, path))
            text.clear()
        link_words = 0

    def add(piece: str) -> None:
        nonlocal link_words
        if piece and not in_head:
            text.append(piece)
            if linked:
                link_words += len(piece.split())

    while True:
        m = TOKEN.search(page, at)
        add(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if in_head and not m[1] and tag not in IN_HEAD:
            in_head = False  # both head tags may be left out
        if tag == "br":
            text.append(" ")
            continue
        if m[1]:
            if tag == "head":
                in_head = False
            if tag == "a":
                linked = max(0, linked - 1)
            if tag in INLINE:
                continue
            if any(t == tag for t, _ in stack):
                close()
                while stack.pop()[0] != tag:
                    pass
                path = tuple(stack)
            elif tag == "p":
                close()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag == "a":
            linked += 1
        if tag in INLINE or (tag in VOID and tag != "hr"):
            continue
        if tag == "head":
            in_head = True
        if tag == "body":
            in_head = False
        close()
        linked = 0
        if tag == "hr":
            continue
        # a paragraph ends where any block begins; items end where a like one begins
        while stack and (stack[-1][0] == "p" or stack[-1][0] in SELF_CLOSING.get(tag, ())):
            stack.pop()
        names = " ".join(a or b or c for a, b, c in NAMES.findall(m[3])).lower() if m[3] else ""
        if not m[3].endswith("/"):
            stack.append((tag, names))
        path = tuple(stack)
    close()
    return out


def path_features(path: tuple) -> list[str]:
    out = set()
    for tag, names in path:
        if tag not in ("html", "body"):
            out.add(f"in {tag}")
        for word in WORDS.findall(names):
            out.add(f"name {word}")
            out.add(f"stem {word.rstrip('s')[:6]}")
    leaf = next((t for t, _ in reversed(path)), "none")
    out.add(f"leaf {leaf}")
    out.add(f"depth {min(len(path), 6)}")
    return sorted(out)


def text_features(block: Block) -> list[str]:
    text, words, linked, _ = block
    size = min(words.bit_length(), 7)
    share = min(4, 4 * linked // words)
    out = [f"words {size}", f"linked {share}", f"end {text[-1] in '.!?:…»”\"'}", f"words {size} linked {share}"]
    if "©" in text:
        out.append("copyright")
    if text.count(",") * 12 > words:
        out.append("commas")
    return out


class Field:
    """Weights of features for the label 'text' against 'furniture', and of neighbouring labels."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start
        self.known: dict[tuple, float] = {}

    def score(self, block: Block) -> float:
        path = block[3]
        if path not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[path] = sum(self.weights.get(f, 0.0) for f in path_features(path))
        return self.known[path] + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def label(self, page: list[Block]) -> list[int]:
        """The best labels of a page's blocks (Viterbi)."""
        if not page:
            return []
        m = self.moves.tolist()
        a, b = float(self.start[0]), float(self.start[1]) + self.score(page[0])
        back = []
        for block in page[1:]:
            s = self.score(block)
            to0, to1 = (a + m[0][0], b + m[1][0]), (a + m[0][1], b + m[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0), max(to1) + s
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page) if page else []
        return "\n".join(b[0] for b, is_text in zip(found, self.label(found), strict=True) if is_text)


def labelled(page: str) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page with one article, as its structure tells them."""
    if len(re.findall(r"<article[\s>]", page, re.I)) != 1:
        return None
    apart = {"nav", "aside", "footer", "form", "header"}
    found = blocks(page)
    return found, [int("article" in (tags := [t for t, _ in b[3]]) and not apart & set(tags)) for b in found]


def composed(sentences: list[str], short: list[str], rng: random.Random) -> tuple[list[Block], list[int]]:
    """A page built from sentences among furniture; a mark in front of each sentence tells its label."""

    def fill(form: str, mark: str) -> str:
        while "{}" in form:
            pick = rng.choice(short if rng.random() < 0.6 else sentences)
            form = form.replace("{}", mark + html.escape(pick), 1)
        return form

    inside = []
    if rng.random() < 0.8:
        inside.append(f"<h1>\x01{html.escape(rng.choice(short))}</h1>")
    for _ in range(rng.randint(1, 12)):
        form = rng.choice(PARAGRAPHS)
        while "{}" in form:
            likely = 0.0 if form.startswith("<h2>") else 0.85
            pick = rng.choice(sentences if rng.random() < likely else short)
            form = form.replace("{}", "\x01" + html.escape(pick), 1)
        inside.append(form)
        if rng.random() < 0.12:
            inside.append(fill(rng.choice(FURNITURE[1]), "\x02"))
    before = [fill(f, "\x02") for f in rng.sample(FURNITURE[0], rng.randint(0, 4))]
    after = [fill(f, "\x02") for f in rng.sample(FURNITURE[2], rng.randint(0, 4))]
    page = f"<html><body>{''.join(before)}{rng.choice(CONTAINERS).format(''.join(inside))}{''.join(after)}</body></html>"
    out, labels = [], []
    for text, words, linked, path in blocks(page):
        labels.append(int("\x01" in text))
        clean = " ".join(text.replace("\x01", "").replace("\x02", "").split())
        if not clean:
            labels.pop()
            continue
        out.append((clean, words, linked, path))
    return out, labels


def train(pages: list[tuple[list[Block], list[int]]], seed: int = 3) -> Field:
    """Fit the field by gradient steps on the log-likelihood of each page's labels."""
    index: dict[str, int] = {}
    data = []
    for found, labels in pages:
        if found:
            rows = [[index.setdefault(f, len(index)) for f in path_features(b[3]) + text_features(b)] for b in found]
            data.append((np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array(labels)))
    weights, seen = np.zeros(len(index)), np.full(len(index), 1e-2)
    moves, start = np.zeros((2, 2)), np.zeros(2)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            features, row, labels = data[k]
            n = len(labels)
            emit = np.zeros((n, 2))
            emit[:, 1] = np.bincount(row, weights[features], n)
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = start + emit[0]
            for i in range(1, n):
                forward[i] = np.logaddexp.reduce(forward[i - 1][:, None] + moves, axis=0) + emit[i]
            for i in range(n - 2, -1, -1):
                backward[i] = np.logaddexp.reduce(moves + emit[i + 1] + backward[i + 1], axis=1)
            total = np.logaddexp.reduce(forward[-1])
            belief = np.exp(forward + backward - total)
            pull = labels - belief[:, 1]
            gradient = np.bincount(features, pull[row], len(index)) - SHRINK * weights
            seen += gradient**2
            weights += RATE * gradient / np.sqrt(seen)
            for i in range(1, n):
                pair = np.exp(forward[i - 1][:, None] + moves + emit[i] + backward[i] - total)
                moves -= RATE * 0.02 * pair
                moves[labels[i - 1], labels[i]] += RATE * 0.02
            start -= RATE * 0.02 * belief[0]
            start[labels[0]] += RATE * 0.02
    return Field({f: float(weights[i]) for f, i in index.items()}, moves, start)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", seed: int = 3) -> Field:
    """A field trained on a bounded sample of the pages and on pages composed from it."""
    body = quoted(html_col)
    order = F.xxhash64(quoted(id_col).cast("string"))
    rows = pages.where(body.isNotNull() & (F.char_length(body) <= LONGEST)).orderBy(order, body).limit(SAMPLE).select(body.alias("h")).collect()
    known = [x for x in (labelled(r.h) for r in rows) if x and sum(x[1])]
    texts = [b[0] for found, labels in known for b, y in zip(found, labels, strict=True) if y]
    sentences = sorted({t for t in texts if len(t) > 60}) or ["Here stands a longer sentence, with a comma, that says what the article is about and ends."]
    short = sorted({" ".join(t.split()[: 1 + k % 9]) for k, t in enumerate(texts)}) or ["A short line", "Menu", "More here"]
    rng = random.Random(seed)
    return train(known + [composed(sentences, short, rng) for _ in range(COMPOSED)], seed)


def extract(pages: DataFrame, field: Field, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) and the main text."""
    keep = pages.columns if keep is None else keep
    (out,) = fresh(pages.select(*map(quoted, keep)), "main_text")
    (body,) = fresh(pages, "html_")
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, field.moves, field.start))
    source = pages.select(*map(quoted, keep), quoted(html_col).cast("string").alias(body))
    names = [*keep, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            texts = [own.text(page) for page in batch.column(batch.num_columns - 1).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)

    return source.mapInArrow(run, source.drop(body).schema.add(out, "string"))
