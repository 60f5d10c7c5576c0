"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is the chain of its leaf blocks. Each block is main text or not. Its features are the names
around it (ancestor tags, words of their class, id and role) and its text (length, share of
links, signs, known words), with the length and links of its neighbours. Two neighbours
hold together by weights that depend on whether they stand in one container, one in the other's, or apart. Weights maximise
the regularised likelihood of labelled pages; a page is decoded by Viterbi.

Labelled pages come from the table itself, no file of labels is needed. Of at most
``SAMPLE_PAGES`` pages, chosen by hash, those that name their article by an ``article`` or ``main``
element give blocks with labels. Each is used as it is and once more laid out by one of many
known layouts, with other names, sidebars, notices, forms and reader comments, so that a
page that names nothing is decoded by its text and its neighbours. The bound is on labelled
pages alone; every page is decoded whole.

A null page is empty and gives an empty text; so does one without main text. Repeated page_ids
are pages of their own, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from html import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddlework.llm.common import per_row
from heddlework.llm.leaf_blocks import Block, leaf_blocks

SAMPLE_PAGES = 300
"""Pages of the table that labels are taken from."""
LAYOUTS = 800
"""Layouts filled with their texts, in turn."""
MIN_PAGES = 3
"""Pages that must show a name for it to have a weight."""
PENALTY = 0.5
N_PAIRS = 12
"""Relations times pairs of labels."""
ROUNDS = 150
MARK = "data-main"

#: Words of what is no article, in the languages of the web's most common ones (fixed values).
PHRASES = re.compile(
    r"\b(?:cookies?|privacy|datenschutz|confidentialité|privacidad|subscribe|newsletter|abonnieren|abonnez|suscr[ií]\w*|comments?|kommentare?|"
    r"commentaires?|comentarios?|repl(?:y|ies)|antworten|répondre|responder|share|teilen|partager|compartir|log ?in|sign (?:in|up)|register|anmelden|"
    r"connexion|advert\w*|sponsored|anzeige|werbung|publicité|publicidad|related|more from|read (?:more|next|also)|menu|search|suche|recherche|buscar|"
    r"copyright|rights reserved|terms|impressum|contact|kontakt|about us|tags?|categor(?:y|ies)|archives?|posted by|likes?|follow us|home|accept|"
    r"skip to|breadcrumb|previous|next|page \d+|back to top|download|print|e-?mail|says|wrote)\b|©", re.I
)
END_OF_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


def _bucket(n: int) -> int:
    return n if n < 3 else 3 if n < 6 else 4 if n < 11 else 5 if n < 21 else 6 if n < 51 else 7


def _containers(blocks: list[Block]) -> dict[int, str]:
    """What stands in each container: words, the longest text and the share of links, in steps."""
    sums: dict[int, list[int]] = {-1: [0, 0, 0, 1]}
    for b in blocks:
        held, words = sums.setdefault(b.container, [0, 0, 0, 1]), b.text.count(" ") + 1
        held[0] += words
        held[1] = max(held[1], words)
        held[2] += b.linked
        held[3] += len(b.text)
    return {
        k: f"{min(total.bit_length(), 9)}-{min(most.bit_length(), 6)}-{4 * linked // chars}" for k, (total, most, linked, chars) in sums.items()
    }


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    shapes, held = [], _containers(blocks)
    for b in blocks:
        words = b.text.count(" ") + 1
        links = 0 if not b.linked else 3 if b.linked >= 0.9 * len(b.text) else 2 if 3 * b.linked > len(b.text) else 1
        shapes.append((_bucket(words), links))
    edge, out, heading = ("-", "-"), [], False
    for k, b in enumerate(blocks):
        words, links = shapes[k]
        before, after = shapes[k - 1] if k else edge, shapes[k + 1] if k + 1 < len(blocks) else edge
        end = bool(END_OF_SENTENCE.search(b.text[-8:]))
        said = words < 7 and bool(PHRASES.search(b.text))
        heading = heading or b.tag == "h1"
        found = [
            "bias", f"w{words}", f"l{links}", f"w{words}l{links}", f"o{b.tag}", f"o{b.tag}w{words}", f"e{end}w{words}", f"said{said}", f"said{said}l{links}",
            f"h{heading}", f"bw{before[0]}", f"bl{before[1]}", f"aw{after[0]}", f"al{after[1]}", f"b{before[1]}l{links}a{after[1]}",
            f"b{before[0]}w{words}a{after[0]}", f"commas{min(b.text.count(','), 3)}", f"signs{any(c in b.text for c in '|·»›•')}w{words}",
            f"digits{5 * sum(map(str.isdigit, b.text[:200])) > len(b.text[:200])}",
        ]
        found.append(f"c{held[b.container]}")
        found.append(f"u{held.get(b.outer, '-')}")
        found.extend(b.around)
        out.append(found)
    return out


def relation(b: Block, before: Block) -> int:
    """How two neighbours stand to each other: 1 in one container, 2 in one inside the other's, 0 apart."""
    if b.container == before.container:
        return 1
    nested = (b.outer == before.container and b.outer >= 0) or (before.outer == b.container and b.container >= 0)
    return 2 if nested else 0


class Model:
    """Weights of features for main text, and of pairs of labels by the relation of their blocks."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs.tolist()
        self.names = frozenset(n for n in weights)

    def main_blocks(self, html: str | None) -> list[Block]:
        blocks = leaf_blocks(html, self.names)
        return [b for b, label in zip(blocks, self.decode(blocks), strict=True) if label]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of a page."""
        if not blocks:
            return []
        get, back, a, b = self.weights.get, [], 0.0, 0.0
        for k, found in enumerate(features(blocks)):
            gain = sum([get(f, 0.0) for f in found])
            if k:
                (aa, ab), (ba, bb) = self.pairs[relation(blocks[k], blocks[k - 1])]
                from_a, from_b = b + ba > a + aa, b + bb >= a + ab
                a, b = (b + ba if from_a else a + aa), (b + bb if from_b else a + ab)
                back.append((from_a, from_b))
            b += gain
        label = int(b > a)
        labels = [label]
        for came in reversed(back):
            label = int(came[label])
            labels.append(label)
        return labels[::-1]


def fit(pages: list[list[Block]], penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Maximum a posteriori weights by gradient steps over all pages side by side."""
    pages = [p for p in pages if p]
    listed = [features(p) for p in pages]
    shown: dict[str, int] = {}
    for page in listed:
        for name in {f for found in page for f in found}:
            shown[name] = shown.get(name, 0) + 1
    place = {name: k for k, name in enumerate(sorted(n for n, c in shown.items() if c >= MIN_PAGES))}
    row, col, at = [], [], 0
    for page in listed:
        for found in page:
            known = [place[f] for f in found if f in place]
            row += [at] * len(known)
            col += known
            at += 1
    row, col = np.array(row, dtype=np.int64), np.array(col, dtype=np.int64)
    label = np.array([b.wanted for p in pages for b in p], dtype=np.int64)
    same = np.array([relation(b, p[k - 1]) if k else 0 for p in pages for k, b in enumerate(p)], dtype=np.int64)
    sizes = np.array([len(p) for p in pages])
    # Pages as rows of a table, the longest first, so that each step of the chain is a slice.
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    alive = [int((sizes > t).sum()) for t in range(sizes.max())]
    at_step = [start[:n] + t for t, n in enumerate(alive)]
    first = np.zeros(at, dtype=bool)
    first[start] = True
    later = np.flatnonzero(~first)
    seen_pairs = np.zeros((3, 2, 2))
    np.add.at(seen_pairs, (same[later], label[later - 1], label[later]), 1.0)
    seen = np.bincount(col, weights=label[row], minlength=len(place)).astype(float)

    theta = np.zeros(len(place) + N_PAIRS)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        weights, pairs = theta[:-N_PAIRS], theta[-N_PAIRS:].reshape(3, 2, 2)
        emit = np.zeros((at, 2))
        emit[:, 1] = np.bincount(row, weights=weights[col], minlength=at)
        ahead, behind = np.zeros((at, 2)), np.zeros((at, 2))
        ahead[at_step[0]] = emit[at_step[0]]
        for here in at_step[1:]:
            ahead[here] = emit[here] + _log_sum(ahead[here - 1][:, :, None] + pairs[same[here]])
        for here in at_step[:0:-1]:
            behind[here - 1] = _log_sum((pairs[same[here]] + (emit[here] + behind[here])[:, None, :]).transpose(0, 2, 1))
        total = _log_sum((ahead + behind)[:, :, None])[:, 0]
        likely = np.exp(ahead[:, 1] + behind[:, 1] - total)
        joint = ahead[later - 1][:, :, None] + pairs[same[later]] + (emit[later] + behind[later])[:, None, :]
        joint = np.exp(joint - total[later][:, None, None])
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, same[later], joint)
        step = np.concatenate([seen - np.bincount(col, weights=likely[row], minlength=len(place)), (seen_pairs - expected).ravel()])
        step -= penalty * theta
        mean = 0.9 * mean + 0.1 * step
        square = 0.99 * square + 0.01 * step * step
        theta = theta + 0.15 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-6)
    return Model(dict(zip(place, theta[:-N_PAIRS].tolist(), strict=True)), theta[-N_PAIRS:].reshape(3, 2, 2))


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the axis in the middle."""
    most = x.max(axis=1)
    return most + np.log(np.exp(x - most[:, None, :]).sum(axis=1))


# --- labelled pages ----------------------------------------------------------------

# How pages name their parts, and what the parts that are no article say.
MAIN_NAMES = ("content", "post", "entry content", "article body", "story", "main", "post body", "text", "single post", "page content", "")
SIDE_NAMES = ("sidebar", "widget", "side", "related", "rail", "secondary", "recommended", "most read", "")
AD_NAMES = ("ad", "ads", "advert", "banner", "promo", "sponsored", "adsbox", "")
NOTICE_NAMES = ("cookie notice", "consent", "notice", "gdpr", "alert", "popup", "overlay", "")
COMMENT_NAMES = ("comments", "comment list", "discussion", "respond", "replies", "disqus", "reader comments", "")
MENU_NAMES = ("menu", "nav", "navbar", "top bar", "navigation", "breadcrumb", "pagination", "links", "")
FOOT_NAMES = ("footer", "foot", "site info", "colophon", "copyright", "bottom", "")
HEAD_NAMES = ("header", "site header", "masthead", "branding", "top", "")
NOTICES = (
    "We use cookies to improve your experience. By using this site you accept our privacy policy.", "This site uses cookies. Accept all",
    "Diese Website verwendet Cookies. Mehr in der Datenschutzerklärung.", "Nous utilisons des cookies. Accepter", "Este sitio usa cookies. Aceptar",
    "You have read all of your free articles this month. Sign in or subscribe to continue.", "Please enable JavaScript to view this page.",
)
FORMS = ("Subscribe to our newsletter", "Your email address", "Sign up", "Search", "Leave a reply", "Name", "Log in", "Send", "Post comment", "Choose a language")
COMMENT_HEADS = ("Comments", "3 comments", "Kommentare", "Commentaires", "Comentarios", "Leave a reply", "What readers say", "Discussion")
SIDE_HEADS = ("Related", "Most read", "More from this section", "You may also like", "Latest news", "Tags", "Archive", "Follow us", "Sponsored")
FOOTS = ("© 2024 All rights reserved.", "Terms of use", "Privacy", "Contact", "About us", "Impressum", "Powered by", "Back to top")
MENUS = ("Home", "News", "Sports", "Culture", "About", "Contact", "Menu", "Login", "Search", "Archive", "Next", "Previous", "Skip to content")
SHARES = ("Share", "Tweet", "Print", "Email this", "Share on Facebook", "Like 12", "Posted by admin", "Read more")
#: Lines of articles that sound like what is no article.
LINES = ("All rights reserved.", "Licensed under CC BY 4.0.", "Comments are welcome.", "Read more in the next part.", "Contact: me@example.org", "Home again.", "Search for it.")
FILLER = (
    "The river rose again in the night and the lower fields were under water by the morning.", "Nobody in the village had expected it so early.",
    "Two bridges are closed, and trains stop at the last station before the valley, as the company said on Monday.", "It was quiet.",
    "Engineers from three towns have been at work on the dam since then; they hope to finish before the next rain.", "What comes after that?",
    "Die alte Brücke wird im Herbst neu gebaut, sagte die Stadt am Freitag.", "Les travaux commencent en mars, si le temps le permet.",
    "El puente viejo se cerrará durante dos semanas.", "In the end, a list of wishes was read out, and the meeting closed at ten.",
)


class _Layout:
    """One page, laid out at random from the texts of another; what is main text is marked."""

    def __init__(self, seed: int, title: str, paragraphs: list[str], short: list[str], other: list[str]):
        self.r = random.Random(seed)
        self.title, self.paragraphs, self.short, self.other = title, paragraphs, [*short, *MENUS], [*other, *FILLER]

    def name(self, names: tuple[str, ...]) -> str:
        words = self.r.choice(names)
        if not words or self.r.random() < 0.15:
            return ""
        joint = self.r.choice(("-", "_", " ", ""))
        return f' {self.r.choice(("class", "class", "id"))}="{words.replace(" ", joint)}"'

    def some(self, texts, least: int, most: int) -> list[str]:
        return [escape(self.r.choice(texts)) for _ in range(self.r.randint(least, most))]

    def box(self, tags: tuple[str, ...], names: tuple[str, ...], inside: str, mark: str = "") -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.name(names)}{mark}>{inside}</{tag}>"

    def links(self, least: int = 2, most: int = 9) -> str:
        words = [f'<a href="#">{t}</a>' for t in self.some(self.short, least, most)]
        kind = self.r.randrange(4)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{w}</li>" for w in words) + "</ul>"
        if kind == 1:
            return "".join(f"<li>{w}" for w in words)
        return self.r.choice((" | ", " &middot; ", " ", " &raquo; ")).join(words) if kind == 2 else "".join(f"<div>{w}</div>" for w in words)

    def menu(self) -> str:
        return self.box(("nav", "nav", "div", "div", "ul", "section"), MENU_NAMES, self.links())

    def header(self) -> str:
        parts = [f"<div>{t}</div>" for t in self.some((*self.short, "The Daily Page", "My blog"), 1, 2)]
        return self.box(("header", "div", "div"), HEAD_NAMES, "".join(parts) + (self.menu() if self.r.random() < 0.5 else ""))

    def notice(self) -> str:
        return self.box(("div", "div", "aside", "section", "dialog"), NOTICE_NAMES, f"<p>{self.r.choice(NOTICES)}</p><button>{self.r.choice(('Accept', 'OK', 'Close'))}</button>")

    def ad(self) -> str:
        text = self.r.choice(self.some(self.other, 1, 2) + ["Advertisement", "Sponsored"])
        inside = self.r.choice((text, f"<p>{text}</p>", f'<a href="#">{text}</a>', f"<span>{text}</span>"))
        return self.box(("div", "div", "aside", "section"), AD_NAMES[: -1 if self.r.random() < 0.8 else None], inside, f' {MARK}="0"')

    def form(self) -> str:
        fields = "".join(f"<label>{t}</label><input name=x>" for t in self.some(FORMS, 1, 3))
        return f'<form{self.name(NOTICE_NAMES)} {MARK}="0">{fields}<select><option>1<option>2</select><button>{self.r.choice(FORMS)}</button></form>'

    def side(self) -> str:
        head = self.r.choice(("h2", "h3", "h4", "div"))
        inside = f"<{head}>{self.r.choice(SIDE_HEADS)}</{head}>" + self.links()
        if self.r.random() < 0.5:
            inside += "".join(f'<p>{t} <a href="#">{self.r.choice(SHARES)}</a></p>' for t in self.some(self.other, 1, 3))
        return self.box(("aside", "div", "div", "section", "td"), SIDE_NAMES, inside, f' {MARK}="0"')

    def comments(self) -> str:
        head = self.r.choice(("h2", "h3", "div"))
        out = f"<{head}>{self.r.choice(COMMENT_HEADS)}</{head}>"
        for text in self.some(self.other, 1, 5):
            who = self.r.choice(("Anna says:", "reader22", "Tom wrote on May 3", "Guest"))
            out += self.box(("div", "li", "article", "p"), ("comment", "reply", "comment body", ""), f"<b>{who}</b><p>{text}</p>")
        if self.r.random() < 0.5:
            out += self.form()
        return self.box(("section", "div", "div", "ol"), COMMENT_NAMES[: -1 if self.r.random() < 0.8 else None], out, f' {MARK}="0"')

    def share(self) -> str:
        return self.box(("div", "ul", "p"), ("share", "social", "meta", "tags", "byline"), " ".join(f'<a href="#">{t}</a>' for t in self.some(SHARES, 1, 4)), f' {MARK}="0"')

    def article(self) -> str:
        r, texts = self.r, [escape(t) for t in self.paragraphs]
        way = r.randrange(6)
        parts = [f"<p>{t}</p>" if way < 3 else f"<p>{t}" if way == 3 else f"<div>{t}</div>" if way == 4 else f"<section><p>{t}</p></section>" for t in texts]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(parts))
            size = r.choice((15, 25, 60, 400))
            extra = [t[:size] for t in self.some(self.paragraphs + list(FILLER), 1, 5)]
            kind = r.randrange(5)
            new = (
                "<ul>" + "".join(f"<li>{t}</li>" for t in extra) + "</ul>" if kind == 0 else f"<blockquote><p>{extra[0]}</p></blockquote>" if kind == 1
                else f"<h2>{extra[0][:50]}</h2>" if kind == 2 else "<table><tr>" + "".join(f"<td>{t[:30]}</td>" for t in extra) + "</tr></table>" if kind == 3
                else f'<p>{extra[0]} <a href="#">{extra[-1][:20]}</a> {extra[-1]}</p>'
            )
            parts.insert(at, new)
        if r.random() < 0.4:
            parts.insert(r.randint(0, len(parts)), f"<p>{r.choice(LINES)}</p>")
        for thing in (self.ad, self.share, self.side, self.form):
            if r.random() < 0.2:
                parts.insert(r.randint(0, len(parts)), thing())
        title = f"<h1>{escape(self.title)}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        return self.box(("article", "main", "div", "div", "div", "section", "td"), MAIN_NAMES, title + "".join(parts), f' {MARK}="1"')

    def html(self) -> str:
        r = self.r
        top = [thing() for thing in (self.header, self.menu, self.notice, self.ad, self.side) if r.random() < 0.5]
        low = [thing() for thing in (self.comments, self.side, self.ad, self.form, self.menu, self.share, self.notice) if r.random() < 0.45]
        foot = self.box(("footer", "footer", "div"), FOOT_NAMES, " ".join(self.some(FOOTS, 1, 3) + ([self.links()] if r.random() < 0.3 else [])))
        body = "".join(top) + self.article()
        if r.random() < 0.5:
            body = self.box(("div", "div", "main"), ("wrapper", "container", "page", "site", ""), body + "".join(low))
        else:
            body += "".join(low)
        return f"<html><body>{body}{foot if r.random() < 0.85 else ''}</body></html>"


OUTSIDE = frozenset("<nav <aside <footer <form <dialog ad ads advert comments".split())


def labelled(html: str) -> list[Block] | None:
    """Blocks of a page that names its article, labelled by that; None for other pages."""
    blocks = leaf_blocks(html)
    if not any("<article" in b.around or "<main" in b.around for b in blocks):
        return None
    for b in blocks:
        b.wanted = ("<article" in b.around or "<main" in b.around) and OUTSIDE.isdisjoint(b.around)
    return blocks


def training_pages(htmls: list[str], layouts: int = LAYOUTS) -> list[list[Block]]:
    """Labelled blocks of pages and of layouts filled with their texts; fillers where there are none."""
    out, sources = [], []
    for html in htmls:
        blocks = labelled(html)
        if blocks:
            out.append(blocks)
            main = [b.text for b in blocks if b.wanted]
            rest = [b.text for b in blocks if not b.wanted]
            if main:
                sources.append((main[0][:120], main[1:41] or main, [t for t in rest if len(t) < 40], [t for t in main[1:] + rest if len(t) >= 20]))
    r, words = random.Random(0), " ".join(FILLER).split()
    for k in range(40):
        said = [" ".join(r.choices(words, k=r.choice((1, 2, 4, 8, 15, 30, 60)))).capitalize() + r.choice((".", ".", ".", "?", "")) for _ in range(r.randint(3, 12))]
        sources.append((said[0][:60], said[1:], [], []))
    for k in range(layouts):
        out.append(leaf_blocks(_Layout(k, *sources[k % len(sources)]).html(), mark=MARK))
    return out


def sample_pages(pages: DataFrame, at_most: int = SAMPLE_PAGES) -> list[str]:
    """Pages that name their article, by hash; the bound keeps what the driver fits on small."""
    named = pages.select("page_id", "html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = named.orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(at_most)
    return [r.html for r in chosen.select("html").toLocalIterator()]


def train(pages: DataFrame, at_most: int = SAMPLE_PAGES) -> Model:
    return fit(training_pages(sample_pages(pages, at_most)))


def extract_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars, one row for each page: its main blocks in order, joined by line ends."""

    def run(htmls):
        for html in htmls:
            text = "\n".join([b.text for b in model.main_blocks(html)])
            yield text, len(text)

    column = per_row(run, "text string, n_chars bigint")
    return pages.select("page_id", "url", column("html").alias("x")).select("page_id", "url", "x.*")
