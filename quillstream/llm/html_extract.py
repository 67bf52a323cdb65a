"""Main-text extraction from HTML by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its DOM leaf blocks (text between block-level boundaries).
Each block has features of its ancestors (tags, and words of their class, id and role), of its
own text (links, marks, words that notices and footers use), and of its place: how much of the
page's plain text stands in the same container, where in the page it stands, what stands before
and after it. The chain, trained on labelled pages, decodes by Viterbi which blocks are main
text. Tags end at the first ``>`` outside quotes of any length; one whose quotes never close, at
the first ``>``. The labelled pages are made here: layouts of many kinds filled with random words, whose
blocks carry their labels by construction. Half of them name their parts in words that tell
nothing, in other languages, or wrongly, or have no names at all, so that text and place count.

Defined results: a null or empty page, and a page without main text, give the empty text;
unclosed and stray tags are tolerated; repeated rows are extracted one by one; other columns
are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import crf
from .arrow_text import in_pieces

#: Labelled pages that the model learns from.
TRAIN_PAGES = 1500

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)|<[!?]", re.DOTALL)
_ATTRIBUTES = re.compile(r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+(?=>)")
_QUOTED = re.compile(r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)")
#: Elements without main text; those of the first kind hold no tags, so they end nowhere but at their own end tag.
RAW = frozenset("script style title textarea iframe".split())
DROPPED = RAW | frozenset("noscript template svg object select".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in sorted(DROPPED)}
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag of the same group closes when they are still open.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table article section div nav aside main body".split())

TAGS = "article main section div p h1 h2 h3 h4 h5 h6 li ul ol dl table td blockquote pre figure figcaption header footer nav aside form button fieldset dialog menu details summary address body".split()
#: Words of class, id and role attributes, by what they tell.
HINTS = {
    "advert": "ad ads advert advertisement advertising adsense adslot sponsor sponsored promo promotion banner affiliate",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar skip toc",
    "side": "sidebar side aside rail widget widgets related recommended more popular trending complementary",
    "foot": "footer foot colophon copyright legal bottom contentinfo",
    "head": "header masthead topbar top head site logo brand banner",
    "remark": "comment comments reply replies respond disqus discussion thread feedback responses reader",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog warning message paywall",
    "ask": "form newsletter subscribe signup login search input contact share social follow",
    "body": "article content post entry story body main text page prose copy maincontent",
}
_HINT = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
_TAG = {t: k for k, t in enumerate(TAGS)}
PATH = 2 * len(TAGS) + 2 * len(HINTS) + 6
#: Words that menus, notices and footers use, in the languages of the corpus.
CUES = frozenset((
    "home start news contact about privacy policy terms conditions imprint copyright rights reserved cookie cookies newsletter subscribe login register share sitemap rss search menu help jobs careers advertisement comments reply sign follow press faq "
    "startseite impressum datenschutz kontakt agb rechte vorbehalten anmelden abonnieren teilen suche hilfe anzeige kommentare antworten karriere presse "
    "accueil actualités mentions légales confidentialité droits réservés connexion abonner partager recherche aide publicité commentaires plan "
    "inicio noticias contacto aviso legal privacidad derechos reservados suscribir compartir buscar ayuda publicidad comentarios mapa"
).split())
_CLUTTER_TAGS = [_TAG[t] for t in ("header", "footer", "nav", "aside", "form", "button", "dialog", "menu")]
_BODY_TAGS = [_TAG[t] for t in ("article", "main")]
_CLUTTER_HINTS = [2 * len(TAGS) + k for k, h in enumerate(HINTS) if h != "body"]
_BODY_HINT = 2 * len(TAGS) + list(HINTS).index("body")
#: Features of a block's text and place; those of its place.
TEXT, PLACE = 31, 13


class Paths:
    """Ancestor chains, numbered as they occur, with their features."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str, str], int] = {}
        self.features = [np.zeros(PATH)]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        names = " ".join(sorted({w for m in _ATTRIBUTE.finditer(attributes) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()) if w in _HINT})) if "=" in attributes else ""
        key = (parent, tag, names)
        if (found := self.known.get(key)) is None:
            own = self.features[parent].copy()
            own[len(TAGS) : 2 * len(TAGS)] = 0  # the innermost tag
            own[2 * len(TAGS) + len(HINTS) :] = 0  # the innermost names
            if tag in _TAG:
                own[_TAG[tag]] = own[len(TAGS) + _TAG[tag]] = 1
            for w in names.split():
                own[2 * len(TAGS) + _HINT[w]] = own[2 * len(TAGS) + len(HINTS) + _HINT[w]] = 1
            clutter, body = own[_CLUTTER_TAGS].any() or own[_CLUTTER_HINTS].any(), own[_BODY_TAGS].any() or own[_BODY_HINT] > 0
            in_text = body and own[_TAG["header"]] > 0
            own[-6:] = clutter, body and not clutter, not body and not clutter, body and clutter, in_text, in_text and tag[0] == "h" and tag[1:].isdigit()
            found = self.known[key] = len(self.features)
            self.features.append(own)
        return found


class TagEnds:
    """Finds where tags end: at the first ``>`` outside quotes, or, with none, at the first at all.

    Time stays linear in the page: a search that fails is remembered with the quotes it
    passed, and a tag that begins outside of these would fail in the same way. There are three
    such searches at most, one for each state (plain, in either kind of quotes) at the end.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.failed: list[tuple[int, list[int], list[int]]] = []

    def __call__(self, at: int) -> int | None:
        """Place of the ``>`` of the tag whose attributes begin at ``at``."""
        if at > self.last:
            return None
        for begin, opens, closes in self.failed:
            if at >= begin:
                k = bisect_right(opens, at) - 1
                if k < 0 or closes[k] <= at:
                    return self.page.find(">", at)
        if m := _ATTRIBUTES.match(self.page, at):
            return m.end()
        spans = [q.span() for q in _QUOTED.finditer(self.page, at)]
        self.failed.append((at, [x for x, _ in spans], [y for _, y in spans]))
        return self.page.find(">", at)


def leaf_blocks(page: str, paths: Paths) -> list[tuple[int, str, float, tuple[int, int]]]:
    """(ancestor chain, text, share of the text in links, the two elements around its own) of each non-empty leaf block."""
    blocks: list[tuple[int, str, float, tuple[int, int]]] = []
    stack: list[tuple[str, int]] = []
    numbers = [0, 0, 0]  # of the open elements
    opened = 0
    open_tags: dict[str, int] = {}
    held: list[str] = []
    linked = 0
    in_link = False
    here = at = after = 0

    def flush() -> None:
        nonlocal linked
        if held:
            if text := " ".join("".join(held).split()):
                blocks.append((here, text, min(1.0, linked / len(text)), (numbers[-2], numbers[-3])))
            held.clear()
        linked = 0

    def close_to(tag: str) -> None:
        nonlocal here
        while stack:
            name, _ = stack.pop()
            numbers.pop()
            open_tags[name] -= 1
            if name == tag:
                break
        here = stack[-1][1] if stack else 0

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = page[at:end]
            if "&" in piece:
                piece = _html.unescape(piece)
            held.append(piece)
            if in_link:
                linked += len(piece)

    ends, missing = TagEnds(page), set()
    while m := _TOKEN.search(page, after):
        tag, closing = (m[2] or "").lower(), bool(m[1])
        if m[0].startswith("<!--"):
            close = m.end() - 1
        elif (close := ends(m.end()) if tag else page.find(">", m.end())) in (None, -1):
            break  # no tag ends any more
        text_until(m.start())
        at = after = close + 1
        if not tag:
            continue
        attributes = page[m.end() : close]
        if tag in DROPPED and not closing and tag not in missing and (tag in RAW or not attributes.endswith("/")):
            if end := _END[tag].search(page, at):
                at = after = end.end()
                continue
            if tag in RAW:
                at = len(page)
                break
            missing.add(tag)
        if tag == "option" and not closing:
            at = after = (page.find("<", at) + 1 or len(page) + 1) - 1
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            continue
        flush()
        if closing:
            if open_tags.get(tag):
                close_to(tag)
            continue
        if stack and stack[-1][0] == "p":
            close_to("p")
        for other in CLOSES.get(tag, ()):
            for name, _ in reversed(stack[-8:]):
                if name == other:
                    close_to(other)
                    break
                if name in SCOPES:
                    break
        in_link = False
        here = paths.child(here, tag, attributes)
        if attributes.endswith("/"):
            here = stack[-1][1] if stack else 0
            continue
        stack.append((tag, here))
        opened += 1
        numbers.append(opened)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    text_until(len(page))
    flush()
    return blocks


_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile("[0-9]")
_JOINTS = re.compile(r"[|·•›»/>—]")


def _cues(text: str) -> float:
    """Share of the words that are cues, in short texts."""
    if len(text) > 400:
        return 0.0
    words = _WORD.findall(text.lower())
    return sum(w in CUES for w in words) / len(words) if words else 0.0


def _places(blocks: list[tuple], paths: Paths) -> np.ndarray:
    """For each block of a page: how much plain text is around it, where it stands, and where the headings are."""
    mass, around, heading, count = {}, {}, {}, len(blocks)
    for k, (path, text, linked, (near, far)) in enumerate(blocks):
        plain = (text.count(" ") + 1) * (1 - linked)
        mass[near] = mass.get(near, 0) + plain
        around[far] = around.get(far, 0) + plain
        if paths.features[path][len(TAGS) + _TAG["h1"]]:
            heading.setdefault("first", k)
            heading["last"], heading[near] = k, k
    most, total, widest = max(mass.values(), default=0) or 1, sum(mass.values()) or 1, max(around.values(), default=0) or 1
    first, last = heading.get("first", -1), heading.get("last", count)
    rows = [(mass[near] / most, around[far] / widest, mass[near] / total, near in heading) for _, _, _, (near, far) in blocks]
    of_home, of_far, share, titled = np.array(rows, np.float32).reshape(-1, 4).T
    k, linked = np.arange(count), np.array([b[2] for b in blocks], np.float32)
    return np.stack([of_home, of_home == 1, of_far, share, k / max(1, count), (count - k) / max(1, count), k == 0, k == count - 1, titled, k < first, k >= last, (of_home == 1) & (linked < 0.5), of_home < 0.2], 1)


def _texts(blocks: list[tuple]) -> np.ndarray:
    """What the text of each block tells."""
    out = np.zeros((len(blocks), TEXT - PLACE), np.float32)
    for row, (_, text, linked, _) in zip(out, blocks, strict=True):
        n, words = len(text), text.count(" ") + 1
        cues, joints = _cues(text), len(_JOINTS.findall(text)) if n <= 400 else 0
        row[:] = (
            np.log1p(words), linked, linked > 0.5, text.count(",") / words, text.count(".") / words, text[-1] in ".!?…:;\"”", n / words / 10, "©" in text or "opyright" in text, words < 4, text[0].isupper(),
            cues, cues > 0.3, min(1.0, joints / words), joints > 1, linked > 0.5 and words < 6, "@" in text or "©" in text, words > 12 and linked < 0.3, _DIGIT.search(text, 0, 80) is not None,
        )
    return out


def feature_parts(blocks: list[tuple], paths: Paths, rows: int = 20_000) -> Iterator[np.ndarray]:
    """Features of the blocks of one page, at most ``rows`` at a time: ancestors, own text and place, and those before and after."""
    places = _places(blocks, paths) if blocks else None
    for a in range(0, len(blocks), rows):
        low, high = max(0, a - 1), min(len(blocks), a + rows + 1)
        own = np.concatenate([_texts(blocks[low:high]), places[low:high]], 1)
        own = np.pad(own, ((int(low == a), int(high <= a + rows)), (0, 0)))
        path = np.stack([paths.features[b[0]] for b in blocks[a : a + rows]])
        yield np.concatenate([path, own[1:-1], own[:-2], own[2:]], 1)


def block_features(blocks: list[tuple], paths: Paths) -> np.ndarray:
    return np.concatenate([np.zeros((0, PATH + 3 * TEXT)), *feature_parts(blocks, paths)])


# Labelled pages


def _words(rng: random.Random, low: int, high: int, start: bool = True) -> str:
    parts = ["the", "of", "an", "er", "la", "que", "sch", "ung", "ñor", "ció", "té", "ber", "ing", "re", "ou", "st", "ent", "ado", "ge", "eau"]
    out = []
    for k in range(rng.randint(low, high)):
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        out.append((w.capitalize() if start and k == 0 else w) + rng.choice(["", "", "", "", ",", ".", "&amp;", "###", "!"] if rng.random() < 0.3 else [""]))
    return " ".join(out)


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_words(rng, 2, 14) + "." for _ in range(rng.randint(low, high)))


def _links(rng: random.Random) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_words(rng, 1, 3, rng.random() < 0.6)}</a></li>' for k in range(rng.randint(2, 8))) + "</ul>"


#: How a page names its parts: by telling words, by words that tell nothing, in other languages, wrongly, not at all.
NAMING = ("told", "told", "told", "neutral", "foreign", "misleading", "bare")
_FOREIGN = {
    "advert": "werbung anzeige publicite anuncio", "menu": "menue leiste navigazione barra liens", "side": "seite rand colonne lateral", "foot": "fuss pied pie abschluss unten", "head": "kopf entete cabecera oben",
    "remark": "kommentare avis opiniones", "notice": "hinweis avertissement aviso", "ask": "formular anmeldung inscription", "body": "inhalt beitrag contenu texte articulo cuerpo haupt",
}


def _named(rng: random.Random, hint: str, tags: str, naming: str = "told") -> tuple[str, str]:
    tag = rng.choice(tags.split())
    if naming == "bare":
        return ("<div>", "</div>") if tag not in ("ul", "ol", "form", "p") else (f"<{tag}>", f"</{tag}>")
    if naming == "misleading":
        word = rng.choice(HINTS[rng.choice(list(HINTS))].split())
    else:
        word = rng.choice((HINTS if naming == "told" else _FOREIGN)[hint].split()) if naming != "neutral" else rng.choice(["c", "box", "wrap", "row", "grid", "inner", "block", "col", "x"]) + str(rng.randint(1, 99))
    word = rng.choice([word, f"site-{word}", f"{word}-box", f"{word}_inner", f"x {word}"]) if naming in ("told", "misleading") else word
    tag = tag if naming == "told" or tag in ("ul", "ol", "form", "p") else "div"
    return f'<{tag} {rng.choice(["class", "class", "id"])}="{word}">', f"</{tag}>"


def _cue_words(rng: random.Random, low: int, high: int) -> list[str]:
    words = rng.choices(sorted(CUES), k=rng.randint(low, high))
    return [w.capitalize() if rng.random() < 0.7 else w for w in words]


def _short_links(rng: random.Random) -> str:
    """Links without a list."""
    names = _cue_words(rng, 2, 7) if rng.random() < 0.6 else [_words(rng, 1, 2) for _ in range(rng.randint(2, 7))]
    return rng.choice([" | ", " · ", " ", " / ", " &raquo; ", "<br>"]).join(f'<a href="/{k}">{w}</a>' for k, w in enumerate(names))


def _legal(rng: random.Random) -> str:
    year, name = rng.randint(1998, 2030), _words(rng, 1, 3)
    return rng.choice([
        f"Copyright {year} {name}. All rights reserved.", f"&copy; {year} {name}", f"&copy; {name} {year}. Alle Rechte vorbehalten.", f"{name} &middot; Tous droits réservés {year}",
        " ".join(_cue_words(rng, 2, 6)), rng.choice([" | ", " · ", " "]).join(_cue_words(rng, 2, 5)), f"{name} {year}. Todos los derechos reservados", _short_links(rng),
    ])


def _plain_clutter(rng: random.Random, kind: str) -> str:
    """What is not main text, as its text shows where no name does."""
    opened, closed = rng.choice([("<div>", "</div>"), ("<div>", "</div>"), ("<p>", "</p>"), ("<div><div>", "</div></div>"), ("<section>", "</section>"), ("<td>", "</td>")])
    inner = {
        "menu": lambda: rng.choice([_links, _short_links])(rng),
        "head": lambda: rng.choice([f'<a href="/">{_words(rng, 1, 3)}</a>', _words(rng, 1, 3)]) + rng.choice(["", _short_links(rng)]),
        "foot": lambda: rng.choice([_legal(rng), f"<p>{_legal(rng)}</p>{_short_links(rng)}", f"<p>{_legal(rng)}</p><p>{_legal(rng)}</p>"]),
        "side": lambda: f"<h3>{_words(rng, 1, 3)}</h3>{_links(rng)}",
        "ask": lambda: f"<form><label>{_words(rng, 1, 3)}</label><input name=q><button>{_words(rng, 1, 2)}</button></form>",
        "notice": lambda: f"{_words(rng, 1, 4)} cookies {_words(rng, 1, 6, False)} <a href=/p>{rng.choice(_cue_words(rng, 1, 1))}</a>",
    }[kind]()
    return opened + inner + closed


def _clutter(rng: random.Random, kind: str, naming: str = "told") -> str:
    """One element of what is not main text."""
    inner = {
        "menu": lambda: rng.choice([_links, _links, _short_links])(rng),
        "advert": lambda: rng.choice([_sentences(rng, 1, 3), f"<p>{_sentences(rng, 1, 3)}</p>", f'<a href="#">{_words(rng, 2, 8)}</a>']),
        "side": lambda: f"<h3>{_words(rng, 1, 4)}</h3>" + rng.choice([_links(rng), f"<p>{_sentences(rng, 1, 3)}</p>"]),
        "foot": lambda: f"&copy; {_words(rng, 1, 3, False)} &middot; {_words(rng, 2, 9)}" if rng.random() < 0.4 else f"<p>{_sentences(rng, 1, 3)}</p>" + _links(rng) if rng.random() < 0.5 else _legal(rng),
        "head": lambda: rng.choice(["", f"<h1>{_words(rng, 1, 4)}</h1>", f"<p>{_words(rng, 2, 8)}</p>"]) + rng.choice(["", _links(rng)]) or "Site",
        "remark": lambda: f"<h2>{_words(rng, 1, 3)}</h2>" * (rng.random() < 0.5) + "".join(f"<{t}>{_sentences(rng, 1, 4)}</{t}>" for t in [rng.choice(["p", "div", "li"])] * rng.randint(1, 5)),
        "notice": lambda: rng.choice([_sentences(rng, 1, 3), f"<p>{_sentences(rng, 1, 2)}</p><button>{_words(rng, 1, 2)}</button>"]),
        "ask": lambda: f"<label>{_words(rng, 1, 4)}</label><input name=q><p>{_words(rng, 2, 10)}</p><button>{_words(rng, 1, 2)}</button>",
    }[kind]() or "Site"
    plain = {"menu": "nav", "side": "aside", "foot": "footer", "head": "header", "ask": "form", "notice": "dialog"}
    if kind in plain and rng.random() < 0.5:
        return f"<{plain[kind]}>{inner}</{plain[kind]}>"
    opened, closed = _named(rng, kind, {"menu": "div ul nav", "side": "div aside section", "foot": "div footer", "head": "div header", "ask": "form div section", "remark": "section div ol article"}.get(kind, "div section p aside"), naming)
    return opened + inner + closed


def _article(rng: random.Random, naming: str = "told") -> list[tuple[str, int]]:
    """Main text as chunks, with clutter inside it now and then."""
    title = f"<h1>{_words(rng, 1, 9)}{rng.choice(['', '.'])}</h1>"
    chunks = [(rng.choice([title, title, title, f"<header>{title}</header>"]), 1)] if rng.random() < 0.85 else []
    for _ in range(rng.randint(1, 14)):
        r, text = rng.random(), _sentences(rng, 1, 7)
        if r < 0.6:
            chunks.append((f"<p>{text}</p>", 1))
        elif r < 0.68:
            chunks.append((f"<p><b>{text}<br>", 1))
        elif r < 0.74:
            chunks.append((f"<h{rng.randint(2, 4)}>{_words(rng, 1, 6)}</h2>".replace("</h2>", ""), 1))
        elif r < 0.8:
            chunks.append(("<ul>" + "".join(f"<li>{_words(rng, 1, 9)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>", 1))
        elif r < 0.86:
            tag = rng.choice(["blockquote", "pre", "div", "section", "figcaption", "td"])
            chunks.append((f"<{tag}>{text}</{tag}>", 1))
        elif r < 0.92:
            chunks.append((f'<p>{text} <a href="/x">{_words(rng, 1, 4)}</a> {_words(rng, 1, 5)}</p>', 1))
        elif r < 0.95:
            chunks.append((f"<p>{_words(rng, 1, 2)}.</p>", 1))
        elif naming == "told":
            chunks.append((_clutter(rng, rng.choice(["advert", "side", "ask", "notice", "remark", "menu"])), 0))
        else:
            chunks.append((_plain_clutter(rng, rng.choice(["ask", "menu"])), 0))
    return chunks


def labelled_page(rng: random.Random) -> list[tuple[str, int]]:
    """A page as chunks of HTML with the label of the blocks that each holds."""
    naming = rng.choice(NAMING)
    told = naming == "told"

    def others(kinds: str) -> list[tuple[str, int]]:
        """Names that tell nothing go with parts whose text shows what they are."""
        chosen = [k for k in kinds.split() if rng.random() < 0.55]
        if told:
            return [(_clutter(rng, k), 0) for k in chosen]
        held = []
        for k in chosen:
            if k in ("menu", "head", "foot", "side", "ask", "notice"):
                opened, closed = _named(rng, k, "div section", naming)
                held.append((opened + _plain_clutter(rng, k) + closed if rng.random() < 0.6 else _plain_clutter(rng, k), 0))
        return held

    chunks = others("notice head menu advert")
    semantic = [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>")]
    plain = [("", ""), ("<div><div>", "</div></div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("<td>", "</td>")]
    opened, closed = rng.choice([*semantic, _named(rng, "body", "div section main article"), plain[0], plain[1]] if told else [*semantic[:2], *plain, *[_named(rng, "body", "div section", naming) for _ in range(3)]])
    bare = rng.random() < 0.08  # text without paragraphs of its own
    chunks += [(opened, 1), *([(f"<div>{_sentences(rng, 1, 6)}<br>{_sentences(rng, 1, 5)}</div>" if opened else f"{_sentences(rng, 1, 6)}<br>", 1)] if bare else _article(rng, naming)), (closed, 1)]
    if bare and not opened and rng.random() < 0.5:
        return chunks
    chunks += others("remark side ask advert foot")
    return [('<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var a="<p>";</script></head><body>', 0), *chunks, (rng.choice(["</body></html>", ""]), 0)]


#: Marks of the labels, in the private use area.
_MARK = ("\ue000", "\ue001")


def labelled_blocks(chunks: list[tuple[str, int]], paths: Paths) -> tuple[list, list[int]]:
    """The blocks of a labelled page and their labels, read off marks in the text."""
    marked = "".join(re.sub(r">([^<]*[^<\s][^<]*)", lambda m, k=k: f">{m[1]}{_MARK[k]}", ">" + c)[1:] if c else c for c, k in chunks)
    blocks, labels = [], []
    for path, text, linked, home in leaf_blocks(marked, paths):
        labels.append(int(text[-1] == _MARK[1]))
        blocks.append((path, re.sub(f"[{''.join(_MARK)}]", "", text).strip() or "x", linked, home))
    return blocks, labels


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 11) -> crf.Chain:
    rng, paths = random.Random(seed), Paths()
    x, y, lengths = [], [], []
    for _ in range(pages):
        blocks, labels = labelled_blocks(labelled_page(rng), paths)
        if blocks:
            x.append(block_features(blocks, paths))
            y += labels
            lengths.append(len(labels))
    return crf.fit(np.concatenate(x), np.array(y), np.array(lengths))


def extract_texts(pages: list[str | None], chain: crf.Chain, paths: Paths) -> list[str]:
    """The main text of each page."""
    found = [leaf_blocks(p or "", paths) for p in pages]
    lengths = np.array([len(b) for b in found], np.int64)
    if not lengths.sum():
        return [""] * len(pages)
    flat = [b for blocks in found for b in blocks]
    main = chain.decoded(np.concatenate([chain.odds(x) for blocks in found for x in feature_parts(blocks, paths)]), lengths)
    ends = np.cumsum(lengths)
    return [" ".join(flat[i][1] for i in range(e - n, e) if main[i]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def extract_main_text(pages: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    model = ship(pages.sparkSession).sparkContext.broadcast(chain or trained())
    pages = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths()
        for whole in batches:
            for batch in in_pieces(whole, "html", 4 << 20):
                if len(paths.features) > 50_000:
                    paths = Paths()
                texts = extract_texts(batch.column("html").to_pylist(), model.value, paths)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
