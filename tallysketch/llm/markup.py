"""HTML pages as blocks of text, each with what the markup says about it."""

from __future__ import annotations

import html
import re
from functools import lru_cache

#: What the markup says of a block: the article, nothing, or that it belongs to the page around the article.
MAIN, SILENT, AROUND = "main", "silent", "around"
#: Roles of open elements beside these: text that is never shown, an article within the article's reach, a form.
_HIDDEN, _ARTICLE, _FORM = "hidden", "article", "form"

# Element names of the HTML standard, by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style template head title noscript svg math canvas audio video object iframe noembed noframes xmp".split())
CONTROLS = frozenset("button select textarea datalist option optgroup".split())
AROUND_TAGS = frozenset("nav aside footer menu dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
AROUND_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split()
)
# Words of class names and ids that mark what stands around an article; the first always do.
ALWAYS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus cookie cookies".split())
USUALLY = frozenset(
    "promo banner consent notice gdpr newsletter subscribe subscription signup paywall popup modal menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer masthead reply replies respond share sharing social related recommended login "
    "search pagination pager toolbar".split()
)
CONTENT = frozenset("content article post entry story main body text".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']++|"[^"]{0,65536}"|'[^']{0,65536}'|["'])*+""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(4096)
def _says(name: str, attributes: str) -> str | None:
    """What an element says by its name and attributes alone; None: nothing."""
    if name in HIDDEN:
        return _HIDDEN
    if name in CONTROLS or name in AROUND_TAGS:
        return AROUND
    found = {}
    for key, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), html.unescape("".join(values)))
    role = found.get("role", "").strip().lower()
    if name in ("article", "main") or role == "main" or found.get("itemprop", "").lower() == "articlebody":
        return _ARTICLE if name == "article" or role == "article" else MAIN
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return AROUND
    if "display:none" in re.sub(r"\s", "", found.get("style", "").lower()) or role in AROUND_ROLES:
        return AROUND
    words = {w.lower() for w in _WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    if name not in ("html", "body") and (words & ALWAYS or words & USUALLY and not words & CONTENT):
        return AROUND
    return _FORM if name == "form" else None


def _role(parent: str, name: str, attributes: str) -> str:
    """Role of an element within its parent's."""
    if parent in (_HIDDEN, AROUND):
        return parent
    said = _says(name, attributes)
    if said is None or said == _FORM and parent != SILENT:
        # A page's header stands around the article, an article's own header is part of it.
        return AROUND if name == "header" and parent not in (MAIN, _ARTICLE) else parent
    if said == MAIN and parent == _ARTICLE:
        return _ARTICLE
    if said == _ARTICLE and parent == _ARTICLE:
        return AROUND  # an article within an article is a comment on it
    return said


def blocks(page: str) -> list[tuple[str, str]]:
    """(what the markup says, text) of each block of text, in page order; white space is one space, no block is empty.

    Comments, declarations and hidden elements have no text. Character references are decoded. What is left open ends with
    its parent or the page; a tag or comment that never ends runs to the end of the page, as in browsers.
    """
    out: list[tuple[str, str]] = []
    names, roles, opened = [""], [SILENT], {}
    pieces: dict[str, list[str]] = {}

    def add(text: str) -> None:
        role = roles[-1]
        if role != _HIDDEN:
            role = MAIN if role == _ARTICLE else AROUND if role == _FORM else role
            pieces.setdefault(role, []).append(text)

    def close() -> None:
        for role, held in pieces.items():
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((role, text))
        pieces.clear()

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        ending = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + ending)
        if name is None:
            if not ending and page[begin + 1:begin + 2] not in ("!", "?"):
                add("<")
                at = begin + 1
            else:
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else size
            continue
        rest = _REST.match(page, name.end())
        at = rest.end() + 1
        tag = name.group().lower()
        if tag == "br":
            add(" ")
        elif tag not in INLINE:
            close()
        if ending:
            if opened.get(tag):
                while True:
                    last = names.pop()
                    roles.pop()
                    opened[last] -= 1
                    if last == tag:
                        break
        elif tag not in VOID and not (rest.group().endswith("/") and tag in ("svg", "math")):
            names.append(tag)
            roles.append(_role(roles[-1], tag, rest.group()))
            opened[tag] = opened.get(tag, 0) + 1
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                if end is None:
                    add(page[at:])
                    break
                add(page[at:end.start()])
                at = end.start()
    close()
    return out
