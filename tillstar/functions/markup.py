"""Blocks of a page, found in one pass over its tags.

The page is read as a stream of tags; each tag name has a stack of what is open,
and a closing tag ends the last open block of its name, so every tag is handled
once, at any nesting depth. An unclosed block reaches to the end of the page, a
closing tag without an open one is skipped. These are helpers of one page;
``operators/listings.py`` maps them over the pages.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

# what follows the last ">" can't hold a tag: each "[^>]*>" below finds its end
_TAG_RE = re.compile(r"<(/?)([a-z][\w:-]*)?([^>]*)>", re.I)
_CLASS_RE = re.compile(r"""(?<![\w-])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Block(NamedTuple):
    name: str       # tag name, lower case
    classes: str    # value of its class attribute, or ""
    start: int      # first place behind the opening tag
    end: int        # place of the closing tag


class Page(NamedTuple):
    blocks: list[Block]             # by start
    texts: list[tuple[int, str]]    # (place, text) of the texts between tags


def fold(page: str, names: Iterable[str]) -> Page:
    """The blocks of the tags ``names`` and all texts of a page."""
    names, reach = frozenset(names), page.rfind(">") + 1
    open_: dict[str, list[int]] = {n: [] for n in names}
    blocks, texts, at = [], [], 0
    for m in _TAG_RE.finditer(page, 0, reach):
        if m.start() > at:
            texts.append((at, page[at:m.start()]))
        at, name = m.end(), (m[2] or "").lower()
        if name not in names:
            continue
        if m[1]:
            if open_[name]:
                k = open_[name].pop()
                blocks[k] = blocks[k]._replace(end=m.start())
        else:
            c = _CLASS_RE.search(m[3])
            open_[name].append(len(blocks))
            blocks.append(Block(name, (c[1] or c[2] or c[3] or "") if c else "", m.end(), len(page)))
    if at < len(page):
        texts.append((at, page[at:]))
    return Page(blocks, texts)


def marked(page: Page, rules: Iterable[Callable[[Block], bool]], needed: Iterable[str] = ()) -> Iterator[Block]:
    """The blocks that satisfy the first rule that any block does; without one,
    the blocks that hold all ``needed`` texts."""
    for rule in rules:
        found = [b for b in page.blocks if rule(b)]
        if found:
            return iter(found)
    places = [[at for at, t in page.texts if n in _html.unescape(t)] for n in needed]

    def holds(b: Block, at: list[int]) -> bool:
        k = bisect_left(at, b.start)
        return k < len(at) and at[k] < b.end
    return (b for b in page.blocks if all(holds(b, at) for at in places))


def innermost(page: Page, label: re.Pattern) -> Block | None:
    """The last opened block around the first text that holds ``label``."""
    at = next((at for at, t in page.texts if label.search(_html.unescape(t))), None)
    if at is None:
        return None
    return max((b for b in page.blocks if b.start <= at < b.end), key=lambda b: b.start, default=None)
