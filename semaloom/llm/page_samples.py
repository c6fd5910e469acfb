"""Made-up labelled pages for fitting the block classifier: invented words in the parts that pages have.

Every block of a page begins with a mark that says what it is; :func:`labelled` reads and removes it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Private code points that mark a block as content or boilerplate.
CONTENT, BOILER = "\ue000", "\ue001"
_SYLLABLES = "an ber co dra el fi gon ha in jor ka lo mi na or pre qui ra so ta un ver wi xe yo za der ing tion ment lich ble".split()
_PANEL = (
    "Home|About us|Contact|Privacy policy|Terms|Log in|Sign in|Subscribe|Search|Next|Previous|More|Share|Follow us|Newsletter|Help|Impressum|Datenschutz|Kontakt|Startseite|Accueil|Mentions légales"
).split("|")
_FOREIGN = "bereich1 kopfteil fusszeile x7 sec-b zone3 hoofdtekst inhalt corps bloque c12 region seitenleiste pied unten".split()
_NAMES = {
    "content": "content article-body post entry-content story main-content post-content tags-article text".split(),
    "nav": "nav main-nav menu navbar site-navigation breadcrumbs".split(),
    "header": "header site-header masthead topbar".split(),
    "footer": "footer site-footer footer-widgets copyright".split(),
    "aside": "sidebar sidebar-left widget popular rail".split(),
    "notice": "cookie-notice consent-banner alert newsletter-signup gdpr".split(),
    "ad": "ad ads ad-slot advert sponsored promo-box".split(),
    "comments": "comments comment-list discussion replies".split(),
    "form": "search-form login signup form".split(),
}
_TAGS = {"content": ("article", "main"), "nav": ("nav",), "header": ("header",), "footer": ("footer",), "aside": ("aside",), "form": ("form",)}


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3)))


def _sentence(rng: random.Random, least: int, most: int) -> str:
    words = [_word(rng) for _ in range(rng.randint(least, most))]
    return " ".join(w + ("," if rng.random() < 0.08 else "") for w in words).capitalize() + rng.choice("....!?")


def _prose(rng: random.Random, mark: str) -> str:
    text = " ".join(_sentence(rng, 4, 22) for _ in range(rng.randint(1, 6)))
    if rng.random() < 0.15:
        text += f' <a href="/x">{_word(rng)} {_word(rng)}</a>.'
    return f"<p>{mark}{text}</p>"


def _title(rng: random.Random, least: int = 1, most: int = 8) -> str:
    return " ".join(_word(rng) for _ in range(rng.randint(least, most))).capitalize()


def _rights(rng: random.Random) -> str:
    return rng.choice(["©", "Copyright", "Copyright ©"]) + f" 20{rng.randint(10, 26)} {_title(rng, 1, 3)}. " + rng.choice(["All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", ""])


def _links(rng: random.Random, n: int) -> str:
    label = lambda: rng.choice(_PANEL) if rng.random() < 0.6 else _title(rng, 1, 5)
    one = lambda: f'<li>{BOILER}<a href="/{_word(rng)}">{label()}</a></li>'
    return "<ul>" + "".join(one() for _ in range(n)) + "</ul>"


def _inside(rng: random.Random, part: str, told: bool) -> str:
    """What a part holds; boilerplate that reads like prose only where its container tells."""
    if told and part in ("header", "footer", "aside", "notice", "form") and rng.random() < 0.35:
        return "".join(_prose(rng, BOILER) for _ in range(rng.randint(1, 2)))
    if part == "content" and rng.random() < 0.25:  # a few short lines
        return "".join(f"<p>{CONTENT}{_title(rng, 1, 6)}{rng.choice(['', '.'])}</p>" for _ in range(rng.randint(1, 4)))
    if part == "content":
        out = [f"<h1>{CONTENT}{_title(rng)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.6:
                out.append(_prose(rng, CONTENT))
            elif kind < 0.72:
                out.append(f"<h2>{CONTENT}{_title(rng)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{CONTENT}{_title(rng, 1, 10)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<p>{CONTENT}{_title(rng, 1, 6)}{rng.choice(['', '.'])}</p>")
            else:
                out.append(f"<blockquote>{CONTENT}{_sentence(rng, 5, 20)}</blockquote>")
        return "".join(out)
    if part == "nav":
        return _links(rng, rng.randint(3, 10))
    if part == "header":
        return f"<h1>{BOILER}{_title(rng, 1, 3)}</h1><p>{BOILER}{_title(rng, 2, 7)}</p>" + (_links(rng, rng.randint(2, 5)) if rng.random() < 0.5 else "")
    if part == "footer":
        line = _rights(rng)
        return f"<p>{BOILER}{line}</p>" + (_links(rng, rng.randint(2, 6)) if rng.random() < 0.6 else "") + (f"<p>{BOILER}{_sentence(rng, 4, 12)}</p>" if rng.random() < 0.3 else "")
    if part == "aside":
        return f"<h3>{BOILER}{rng.choice(['Related', 'Popular', 'More', _title(rng, 1, 3)])}</h3>" + (_links(rng, rng.randint(2, 8)) if rng.random() < 0.7 else f"<p>{BOILER}{_sentence(rng, 6, 25)}</p>")
    if part == "notice":
        return f"<p>{BOILER}{rng.choice(['We use cookies. ', 'Subscribe to our newsletter. ', ''])}{_sentence(rng, 6, 25)}</p><button>{BOILER}{rng.choice(['Accept', 'OK', 'Subscribe'])}</button>"
    if part == "ad":
        return f"{BOILER}{_sentence(rng, 4, 16)}"
    if part == "comments":
        return f"<h3>{BOILER}Comments</h3>" + "".join(f"<p>{BOILER}{_title(rng, 1, 2)}</p>{_prose(rng, BOILER)}" for _ in range(rng.randint(1, 4)))
    return f"<label>{BOILER}{_title(rng, 1, 2)}</label><input><button>{BOILER}{rng.choice(_PANEL)}</button>"


def _part(rng: random.Random, part: str) -> str:
    way = rng.random()
    plain = part in ("ad", "comments", "notice")  # their texts look like prose: only names tell
    inside = _inside(rng, part, way < 0.6 or plain)
    if part == "content" and rng.random() < 0.15:
        return inside  # no container of its own
    if part in _TAGS and way < 0.35:
        tag = rng.choice(_TAGS[part])
        return f"<{tag}>{inside}</{tag}>"
    if way < 0.6 or plain:
        return f'<div class="{rng.choice(_NAMES[part])}">{inside}</div>'
    return f'<{rng.choice(["div", "section"])}{rng.choice(["", f" class={chr(34)}{rng.choice(_FOREIGN)}{chr(34)}"])}>{inside}</{"div"}>'


def pages(n: int, seed: int = 1) -> Iterator[str]:
    """``n`` pages with marked blocks."""
    rng = random.Random(seed)
    for _ in range(n):
        much = rng.choice([0.0, 0.2, 0.5, 0.6])
        before = [p for p in ("notice", "header", "nav", "form", "ad") if rng.random() < much]
        after = [p for p in ("ad", "comments", "aside", "form", "footer", "notice") if rng.random() < much]
        content = _part(rng, "content")
        if rng.random() < 0.4:  # an insert within the content
            at = content.find("</p>")
            if at > 0:
                content = content[: at + 4] + _part(rng, rng.choice(["ad", "aside", "form", "nav"])) + content[at + 4 :]
        body = "".join(_part(rng, p) for p in before) + content + "".join(_part(rng, p) for p in after)
        if rng.random() < 0.15:
            body += f"<p>{BOILER}{_rights(rng)}</p>"
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(["layout with-sidebar", "wrapper", "page", "search-engine-history", "x1"])}">{body}</div>'
        yield f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


def labelled(page: str) -> tuple[list, list[int]]:
    """The blocks of a marked page without their marks, and their labels."""
    from semaloom.llm.html_extract import blocks_of

    blocks, labels = [], []
    for b in blocks_of(page)[0]:
        if b.text[0] in (CONTENT, BOILER):
            labels.append(int(b.text[0] == CONTENT))
            rest = b.text.replace(CONTENT, "").replace(BOILER, "").strip()
            blocks.append(b._replace(text=rest or "-"))
    return blocks, labels
