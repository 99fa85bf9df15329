"""Main text of web pages by a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has features of its
ancestors (tag names, words of class, id and role) and of its text (length, marks, links, position);
the chain has two labels, content and other. Weights are learned on labelled pages by gradient ascent
on the conditional log-likelihood (forward-backward over all pages at once) and decoded by Viterbi.
Scripts, styles, templates, titles and comments of the markup are no text and never become blocks.

The default labelled pages are generated: page templates filled with random words, in which every
block is known to be content or not. Any pages with known main text can be given instead.

Null and empty pages and pages without blocks give an empty text; markup of any quality is read as far
as it goes, unclosed tags included; repeated rows are extracted alike; columns other than page_id,
url and html are left out.
"""

from __future__ import annotations

import random
import re

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags whose content is no text, tags that don't end a block, tags without content.
SILENT = {"script", "style", "template", "noscript", "title", "svg", "iframe", "object", "textarea", "select"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Tags that stand in a head, block-level tags, and silent tags that the next block-level tag closes if nothing else does (True: may nest).
HEAD = {"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
         "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
LOOSE = {"noscript": False, "select": False, "object": True, "svg": True}
_LOOSE_TAGS = {t: re.compile(rf"<(/?){t}(?![a-z0-9-])", re.I) for t in LOOSE}
_WORDS = re.compile(r"[a-z]+")
_LINKED = 0.5


class _Blocks(HTMLParser):
    """Collects (text, ancestors, linked characters) of the leaf blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.lines = html, None
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[tuple[str, tuple[str, ...], int]] = []
        self.parts: list[str] = []
        self.linked, self.silent, self.in_link = 0, 0, 0
        self.unclosed: list[int] = []       # places in `open` of silent elements without an end tag

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, tuple(w for _, ws in self.open for w in ws), self.linked))
        self.parts, self.linked = [], 0

    def ends(self, tag) -> bool:
        """Whether the element that starts here has an end tag."""
        if self.lines is None:
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.html))]
        line, offset = self.getpos()
        depth = 0
        for m in _LOOSE_TAGS[tag].finditer(self.html, self.lines[line - 1] + offset + 1):
            if m.group(1) and not depth:
                return True
            if not m.group(1) and not LOOSE[tag]:
                return False
            depth += -1 if m.group(1) else 1
        return False

    def handle_starttag(self, tag, attrs):
        if self.open and self.open[-1][0] == "head" and tag not in HEAD:
            self.close("head")
        if tag in BLOCK and self.unclosed:
            self.cut(self.unclosed[0])
        if tag in INLINE:
            self.in_link += tag == "a"
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag == "body":
            self.close("head")
        if tag not in SILENT:
            self.flush()
            if tag in ("p", "li", "td", "tr", "option", "dd", "dt") and self.open and self.open[-1][0] == tag:
                self.open.pop()
        if tag in VOID:
            return
        words = ["<" + tag]
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label", "itemprop") and value:
                words += ["." + w for w in _WORDS.findall(value.lower())]
        if tag in LOOSE and not self.ends(tag):
            self.unclosed.append(len(self.open))
        self.open.append((tag, tuple(words)))
        self.silent += tag in SILENT

    def close(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.cut(k)
                return

    def cut(self, k):
        """Close everything from place k on."""
        for t, _ in self.open[k:]:
            self.silent -= t in SILENT
        del self.open[k:]
        while self.unclosed and self.unclosed[-1] >= k:
            self.unclosed.pop()

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT:       # <svg/> is complete
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in INLINE:
            self.in_link -= tag == "a" and self.in_link > 0
            return
        if tag not in SILENT and tag not in VOID:
            self.flush()
        if tag not in VOID:
            self.close(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    if not html:
        return []
    parser = _Blocks(html)
    parser.feed(html)
    HTMLParser.close(parser)
    parser.flush()
    return parser.blocks


def features_of(blocks) -> list[list[str]]:
    """Names of the features of each block."""
    out, n = [], len(blocks)
    for k, (text, above, linked) in enumerate(blocks):
        size, words = len(text), text.count(" ") + 1
        names = ["bias", f"size{min(size.bit_length(), 10)}", f"words{min(words.bit_length(), 8)}"]
        names += sorted(set(above))
        names += ["linked"] if linked > _LINKED * size else []
        names += ["sentence"] if text[-1] in ".!?…:;\"" and words > 3 else []
        names += ["rights"] if "©" in text or "rights reserved" in text.lower() else []
        names += ["commas"] if text.count(",") > 1 else []
        names += ["first"] if k == 0 else []
        names += ["last"] if k == n - 1 else []
        out.append(names)
    return out


def train(pages: list[list[tuple[list[str], int]]], epochs: int = 150, step: float = 0.3, penalty: float = 1e-3) -> dict:
    """Weights of (features, transitions) from pages of (feature names, label) blocks."""
    pages = [p for p in pages if p]
    names = sorted({f for p in pages for fs, _ in p for f in fs})
    at = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max((len(p) for p in pages), default=1)
    mask, gold = np.zeros((n, longest), dtype=bool), np.zeros((n, longest), dtype=int)
    rows, cols = [], []
    for i, p in enumerate(pages):
        for t, (fs, y) in enumerate(p):
            mask[i, t], gold[i, t] = True, y
            rows += [i * longest + t] * len(fs)
            cols += [at[f] for f in fs]
    x = np.zeros((n * longest, len(names)), dtype=np.float32)
    x[rows, cols] = 1
    w, trans = np.zeros((len(names), 2)), np.zeros((2, 2))
    sums, tsums = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    truth = np.zeros((n, longest, 2))
    truth[mask, gold[mask]] = 1
    both = mask[:, 1:] & mask[:, :-1]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    last = mask.sum(axis=1) - 1
    for _ in range(epochs):
        emit = (x @ w).reshape(n, longest, 2)
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = emit[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(mask[:, t, None], emit[:, t] + np.logaddexp.reduce(fwd[:, t - 1, :, None] + trans, axis=1), fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(trans + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2), 0)
        total = np.logaddexp.reduce(fwd[np.arange(n), last], axis=1)
        mean = np.exp(fwd + bwd - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(fwd[:, :-1, :, None] + trans + (emit + bwd)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        grad = x.T @ (truth - mean).reshape(-1, 2) / n - penalty * w
        tgrad = (pairs - pair.sum(axis=(0, 1))) / n - penalty * trans
        sums += grad * grad
        tsums += tgrad * tgrad
        w += step * grad / np.sqrt(sums)
        trans += step * tgrad / np.sqrt(tsums)
    return {"at": at, "w": w, "trans": trans}


def decode(features: list[list[str]], model: dict) -> list[int]:
    """Best labels by Viterbi; features that weren't seen in training weigh nothing."""
    at, trans = model["at"], model["trans"].tolist()
    w = model.setdefault("rows", {f: tuple(model["w"][i]) for f, i in at.items()})
    emit = []
    for names in features:
        a = b = 0.0
        for f in names:
            if f in w:
                a, b = a + w[f][0], b + w[f][1]
        emit.append((a, b))
    back, (s0, s1) = [], emit[0] if emit else (0, 0)
    for a, b in emit[1:]:
        p00, p10, p01, p11 = s0 + trans[0][0], s1 + trans[1][0], s0 + trans[0][1], s1 + trans[1][1]
        back.append((int(p10 > p00), int(p11 > p01)))
        s0, s1 = max(p00, p10) + a, max(p01, p11) + b
    labels = [int(s1 > s0)] if emit else []
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def label(html: str, content: list[str]) -> list[tuple[list[str], int]]:
    """Blocks of a labelled page: features and whether the block's text is one of the content's."""
    held, blocks = set(content), blocks_of(html)
    return [(fs, int(b[0] in held)) for fs, b in zip(features_of(blocks), blocks)]


def training_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Generated pages with the blocks of their main text."""
    draw = random.Random(seed)

    def words(lo, hi):
        return " ".join("".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(lo, hi)))

    def sentences(lo, hi):
        return " ".join(words(4, 14).capitalize() + draw.choice([".", ".", ".", "!", "?", ", " + words(2, 6) + "."]) for _ in range(draw.randint(lo, hi)))

    def some(*kinds):
        return draw.choice(kinds)

    out = []
    for _ in range(n):
        content: list[str] = []

        def add(text):
            content.append(text)
            return text

        def links(k):
            return "".join(f'<li><a href="/{i}">{words(1, 2)}</a></li>' for i in range(k))

        def other(kind):
            """A part of the page that is no main text."""
            if kind == "nav":
                return some(f"<nav><ul>{links(draw.randint(2, 9))}</ul></nav>", f'<div class="{some("menu", "navbar", "breadcrumb", "nav main")}"><ul>{links(draw.randint(2, 7))}</ul></div>')
            if kind == "ad":
                return f'<div class="{some("ad", "ads", "advert", "banner ad", "promo", "sponsored")}">{some(sentences(1, 2), words(2, 6))}</div>'
            if kind == "aside":
                return some(f"<aside><h3>{words(1, 3)}</h3><p>{sentences(1, 3)}</p></aside>", f'<div class="{some("sidebar", "side widget", "related")}"><h4>{words(1, 3)}</h4><ul>{links(4)}</ul><p>{sentences(1, 2)}</p></div>')
            if kind == "form":
                return f'<form><p>{sentences(1, 1)}</p><label>{words(1, 2)}</label><input name="q"><button>{words(1, 2)}</button></form>'
            if kind == "notice":
                return f'<div class="{some("cookie notice", "notice", "cookie-banner", "consent", "alert")}"><p>{sentences(1, 3)}</p></div>'
            if kind == "comments":
                return f'<{(t := some("section", "div"))} class="{some("comments", "comment-list", "comments reader")}"><h3>{words(1, 2)}</h3>' + "".join(
                    f'<{(c := some("div", "article", "li"))} class="comment"><p>{sentences(1, 4)}</p></{c}>' for _ in range(draw.randint(1, 5))) + f"</{t}>"
            if kind == "header":
                return f'<header><p>{words(1, 5)}</p>{some("", f"<p>{sentences(1, 2)}</p>")}</header>'
            return f'<footer>{some("<p>", "")}{some("&copy; " + words(1, 3) + " &middot; " + sentences(1, 2), sentences(1, 3))}</footer>'

        def paragraph():
            text = add(some(sentences(1, 6), sentences(1, 2), words(2, 8), sentences(4, 12)))
            tag = some("p", "p", "p", "p", "h2", "blockquote", "li", "pre", "td")
            inner = some(text, text, f"<b>{text}", text.replace(" ", " <i>", 1))
            return f"<{tag}>{inner}" + some(f"</{tag}>", f"</{tag}>", "<br>" if tag == "p" else f"</{tag}>")

        inside = "".join(paragraph() + (other(some("ad", "aside", "form", "notice")) if draw.random() < 0.08 else "") for _ in range(draw.randint(1, 14)))
        title = f"<h1>{add(words(2, 9).capitalize())}</h1>"
        tag = some("article", "article", "main", 'div class="content"', 'div id="article-body"', 'section class="post entry"')
        after = other("comments") if draw.random() < 0.35 else ""
        body = f"<{tag}>{title}{inside}" + (f"{after}</{tag.split()[0]}>" if draw.random() < 0.5 else f"</{tag.split()[0]}>{after}")
        before = "".join(other(k) for k in ("header", "nav", "ad", "notice", "form", "aside") if draw.random() < 0.45)
        behind = "".join(other(k) for k in ("aside", "ad", "form", "nav", "footer") if draw.random() < (0.8 if k == "footer" else 0.3))
        out.append((f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title></head><body>{before}{body}{behind}</body></html>", content))
    return out


def default_model() -> dict:
    return train([label(html, content) for html, content in training_pages()])


def main_text(html: str | None, model: dict) -> str:
    blocks = blocks_of(html)
    return " ".join(b[0] for b, y in zip(blocks, decode(features_of(blocks), model)) if y)


def _extract(sent):
    def run(batches):
        for batch in batches:
            model = dict(sent.value)
            for lo in range(0, batch.num_rows, 512):
                texts = [main_text(h, model) for h in batch.column("html").slice(lo, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, 512), batch.column("url").slice(lo, 512), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract(sent), "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))
