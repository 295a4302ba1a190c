"""Markdown of a page's main content, from its document tree.

One pass from the last element to the first, so nesting may be as deep as it likes: an element's text is made of its children's. Blocks are
set apart by empty lines, runs of blanks become one, characters that Markdown reads are escaped. Tables are written cell by cell. Inline
marks hug their text, and one that holds blocks is left out; an inline tag that isn't closed ends with its block.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .. import catalog
from .dom import VOID, Node

_SKIPPED = frozenset("script style nav footer header aside iframe noscript svg head title".split())
_BLOCKS = frozenset(
    "address article aside audio blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup " "hr html isindex li main menu nav noframes noscript ol output p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_READ = re.compile(r"[\\*_`\[\]]")
#: What means something at the start of a block only.
_START = re.compile(r"-|\+(?= )|=+|#{1,6}(?= )|~~~|>|\d+(?=\. )")
#: Stands for a line break until the text is whole.
_BREAK = "\x00"
_HELD = 100


def _plain(text: str) -> str:
    return _READ.sub(r"\\\g<0>", _BLANKS.sub(" ", text.replace(_BREAK, " ")))


def _run(parts: list[str]) -> str:
    """A line of inline text: no blank at its ends or around breaks."""
    text = re.sub(r" *\x00 *", _BREAK, re.sub(" +", " ", "".join(parts))).strip(f" {_BREAK}")
    found = _START.match(text)
    if not found:
        return text
    return f"{found[0]}\\{text[found.end() :]}" if found[0].isdigit() else f"\\{text}"


def _segments(node: Node, made: dict[int, tuple[bool, str]]) -> list[str]:
    """What the element holds: lines of inline text, and blocks."""
    out, run = [], []
    for child in node.children:
        if isinstance(child, str):
            run.append(_plain(child))
            continue
        block, text = made.pop(child.at, (False, ""))
        if not block:
            run.append(text)
            continue
        out += [x for x in (_run(run), text) if x]
        run = []
    return [x for x in (*out, _run(run)) if x]


def _hugging(mark: str, text: str) -> str:
    inner = text.strip(f" {_BREAK}")
    if not inner:
        return text
    a = text.index(inner)
    return f"{text[:a]}{mark}{inner}{mark}{text[a + len(inner) :]}"


def _link(node: Node, text: str) -> str:
    href, title = node.get("href"), node.get("title")
    if not href or not text.strip():
        return text
    a, b = ("<", ">") if " " in href else ("", "")
    return f"[{text}]({a}{href}{b}" + (f' "{title}")' if title else ")")


def _inline(node: Node, text: str) -> str:
    if node.tag in ("b", "strong"):
        return _hugging("**", text)
    if node.tag in ("i", "em"):
        return _hugging("*", text)
    if node.tag == "a":
        return _link(node, text)
    if node.tag == "code":
        raw = _BLANKS.sub(" ", node.text())
        tick = "``" if "`" in raw else "`"
        return f"{tick}{raw}{tick}" if raw.strip() else ""
    if node.tag == "img":
        return f"![{_BLANKS.sub(' ', node.get('alt'))}]({node.get('src')})" if node.get("src") else ""
    return _BREAK if node.tag == "br" else text


def _item(node: Node, parts: list[str], lists: set[int]) -> str:
    above = node.parent
    mark = "-   "
    if above is not None and above.tag == "ol":
        first = above.get("start")
        mark = f"{(int(first) if first.isdigit() else 1) + sum(n.tag == 'li' for n in above.elements[: node.place])}.  "
    text = ""
    for part in parts:
        text += ("" if not text else "\n" if part.startswith(("-   ", "1.  ")) and lists else "\n\n") + part
    return mark + text.replace("\n", "\n    ")


def _block(node: Node, parts: list[str], lists: set[int]) -> str:
    tag = node.tag
    text = "\n\n".join(parts)
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return "#" * int(tag[1]) + " " + re.sub(r"[\n\x00]+", " ", text) if text else ""
    if tag == "hr":
        return "* * *"
    if tag == "blockquote":
        return "\n".join(f"> {line}" if line else ">" for line in text.replace(_BREAK, "  \n").split("\n")) if text else ""
    if tag in ("ul", "ol"):
        return "\n".join(parts)
    if tag == "li":
        return _item(node, parts, lists)
    if tag == "pre" and node.elements and node.elements[0].tag == "code":
        language = re.search(r"language-(\S+)", node.elements[0].get("class"))
        return f"```{language[1] if language else ''}\n{node.elements[0].text().strip(chr(10))}\n```"
    return text


def of(node: Node) -> str:
    """Markdown of what an element holds."""
    made: dict[int, tuple[bool, str]] = {}
    within = [n for n in reversed(node.walk())]
    for n in within:
        if n.tag in _SKIPPED:
            for child in n.elements:
                made.pop(child.at, None)
            continue
        lists = {c.at for c in n.elements if c.tag in ("ul", "ol")}
        if n.tag in _BLOCKS:
            made[n.at] = (True, _block(n, _segments(n, made), lists))
        elif any(made.get(c.at, (False,))[0] for c in n.elements):
            made[n.at] = (True, "\n\n".join(_segments(n, made)))
        else:
            inner = "".join(_plain(c) if isinstance(c, str) else made.pop(c.at, (False, ""))[1] for c in n.children)
            made[n.at] = (False, _inline(n, inner))
    text = "\n\n".join(_segments(node, made)).replace(_BREAK, "  \n")
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _written(text: str) -> int:
    return len(text) + 4 * text.count("&") + 3 * (text.count("<") + text.count(">"))


def _held(node: Node) -> int:
    """Length of what the element holds, written as HTML, without what is skipped and blanks at its ends; counting stops once it is enough."""
    tags, cut = 0, 0
    told = "".join(c for c in node.children if isinstance(c, str))
    for n in node.walk():
        if n.at < cut:
            continue
        if n.tag in _SKIPPED:
            cut = n.end
            continue
        tags += (len(n.tag) + 2 if n.tag in VOID else 2 * len(n.tag) + 5) + sum(len(k) + _written(v) + 4 for k, v in n.attrs.items())
        told += "".join(c for c in n.children if isinstance(c, str))
        if tags + _written(told.strip()) > _HELD:
            break
    return tags + _written(told.strip())


def _fits(selector: str) -> Callable[[Node], bool]:
    if selector.startswith("."):
        return lambda n: selector[1:] in n.get("class").split()
    if selector.startswith("#"):
        return lambda n: n.get("id") == selector[1:]
    if selector.startswith("["):
        return lambda n: n.get("role") == "main"
    return lambda n: n.tag == selector


def of_page(root: Node) -> str:
    """Markdown of the first element that is thought to hold a page's content and holds enough, else of its body."""
    cut = root.under(lambda n: n.tag in _SKIPPED)
    for selector in catalog.CONTENT:
        fits = _fits(selector)
        found = root.first(lambda n: n.tag not in _SKIPPED and not cut[n.at] and fits(n))
        if found is not None and _held(found) > _HELD:
            return of(found)
    return of(root.first("body") or root)
