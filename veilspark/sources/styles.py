"""What a page's own style sheets say about whether an element shows.

Rules of ``<style>`` elements are matched against elements as they open, and the cascade
(importance, inline before sheet, specificity, order) decides ``display``, ``visibility`` and
``opacity``. Selectors are compounds of tag, id, class, attribute and ``:not``, joined by
descendant and child combinators; a selector with anything else (states, siblings, pseudo
elements) matches nothing, and neither do rules inside conditions other than ``all`` and
``screen``. Linked sheets are not stored with a page and so not known.
"""

from __future__ import annotations

import re
from collections import defaultdict

PROPERTIES = ("display", "visibility", "opacity")
UNSTYLED = (None, None, None)

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_NAME = r"-?[A-Za-z_\u0080-￿][\w\u0080-￿-]*"
_SIMPLE = re.compile(
    rf"(?P<tag>\*|{_NAME})|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*)?\]"
    r"|:not\((?P<but>[^()]*)\)"
)
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility|opacity)\s*:\s*([^;!]+?)\s*(!\s*important)?\s*(?=;|$)", re.I)


class Compound:
    """One element's part of a selector."""

    def __init__(self, source: str):
        self.tag, self.id, self.classes, self.attrs, self.but = None, None, [], [], []
        self.weight = [0, 0, 0]
        at = 0
        while at < len(source):
            m = _SIMPLE.match(source, at)
            if m is None or (m["tag"] and at):
                raise ValueError(source)
            at = m.end()
            if m["tag"]:
                self.tag = None if m["tag"] == "*" else m["tag"].lower()
                self.weight[2] += self.tag is not None
            elif m["id"]:
                if self.id not in (None, m["id"]):
                    raise ValueError(source)  # no element has two ids
                self.id = m["id"]
                self.weight[0] += 1
            elif m["cls"]:
                self.classes.append(m["cls"])
                self.weight[1] += 1
            elif m["attr"]:
                value = m["val"]
                self.attrs.append((m["attr"].lower(), m["op"], value[1:-1] if value and value[0] in "\"'" else value))
                self.weight[1] += 1
            else:
                inner = Compound(m["but"].strip())
                self.but.append(inner)
                self.weight = [a + b for a, b in zip(self.weight, inner.weight)]

    def key(self) -> tuple[str, str]:
        """What an element must have to match: the rarest thing named."""
        if self.id is not None:
            return "#", self.id
        if self.classes:
            return ".", self.classes[0]
        return ("", self.tag) if self.tag else ("", "*")

    def fits(self, tag: str, attrs: dict[str, str], classes: frozenset[str]) -> bool:
        if (self.tag and self.tag != tag) or (self.id is not None and attrs.get("id") != self.id):
            return False
        if not all(c in classes for c in self.classes):
            return False
        return all(_has(attrs, *a) for a in self.attrs) and not any(b.fits(tag, attrs, classes) for b in self.but)


def _has(attrs: dict[str, str], name: str, op: str | None, want: str | None) -> bool:
    value = attrs.get(name)
    if value is None or op is None:
        return value is not None
    if op == "=":
        return value == want
    if op == "~=":
        return want in value.split()
    if op == "|=":
        return value == want or value.startswith(want + "-")
    if not want:
        return False
    return {"^=": value.startswith, "$=": value.endswith, "*=": value.__contains__}[op](want)


class Rule:
    def __init__(self, selector: str, declared: list[tuple[int, str, bool]], order: int):
        parts = re.split(r"\s*(>)\s*|\s+", selector.strip())
        self.child: list[bool] = []  # is compound i a child of the one before?
        self.compounds: list[Compound] = []
        near = False
        for part in filter(None, parts):
            if part == ">":
                near = True
                continue
            self.compounds.append(Compound(part))
            self.child.append(near)
            near = False
        if not self.compounds or near or self.child[0]:
            raise ValueError(selector)
        self.weight = tuple(map(sum, zip(*(c.weight for c in self.compounds))))
        self.declared, self.order = declared, order


def declarations(source: str) -> list[tuple[int, str, bool]]:
    """(property, value, important) of those that are known."""
    return [
        (PROPERTIES.index(name.lower()), value.strip().lower(), bool(important))
        for name, value, important in _DECLARATION.findall(source)
    ]


def _blocks(sheet: str):
    """(prelude, body) of each rule, those of conditions that hold included."""
    at = 0
    while (start := sheet.find("{", at)) >= 0:
        prelude = sheet[at:start].rsplit(";", 1)[-1].strip()
        depth, stop = 1, start + 1
        if not prelude.startswith("@"):
            stop = sheet.find("}", start)
            stop = len(sheet) if stop < 0 else stop + 1
            yield prelude, sheet[start + 1 : stop - 1 if sheet[stop - 1 : stop] == "}" else stop]
        else:
            while depth and stop < len(sheet):
                depth += {"{": 1, "}": -1}.get(sheet[stop], 0)
                stop += 1
            if prelude.lower().split() in (["@media", "all"], ["@media", "screen"]):
                yield from _blocks(sheet[start + 1 : stop - (depth == 0)])
        at = stop


class Sheet:
    """The rules of a page that touch a known property, by what the last compound needs."""

    def __init__(self, sources: list[str]):
        self.rules: dict[tuple[str, str], list[Rule]] = defaultdict(list)
        order = 0
        for source in sources:
            for prelude, body in _blocks(_COMMENT.sub(" ", source)):
                declared = declarations(body)
                if not declared:
                    continue
                for selector in prelude.split(","):
                    order += 1
                    try:
                        rule = Rule(selector, declared, order)
                    except ValueError:
                        continue
                    self.rules[rule.compounds[-1].key()].append(rule)


class Cascade:
    """Open elements of a page, and whether each shows."""

    def __init__(self, sheet: Sheet):
        self.sheet = sheet
        self.stack: list[tuple] = []  # tag, attrs, classes, display none, visibility
        # places in the stack by what a compound may need, so that no search walks all of it
        self.places: dict[tuple[str, str], list[int]] = defaultdict(list)

    def _keys(self, tag: str, attrs: dict[str, str], classes: frozenset[str]):
        yield "", "*"
        yield "", tag
        if "id" in attrs:
            yield "#", attrs["id"]
        for c in classes:
            yield ".", c

    def _above(self, rule: Rule, k: int, below: int) -> bool:
        """Do compounds 0..k of the rule fit open elements above place ``below``?"""
        if k < 0:
            return True
        near, compound = rule.child[k + 1], rule.compounds[k]
        for place in [below - 1] if near else reversed(self.places[compound.key()]):
            if 0 <= place < below and compound.fits(*self.stack[place][:3]) and self._above(rule, k - 1, place):
                return True
            # without child combinators further up the nearest place is as good as any
            if place < below and not any(rule.child[: k + 1]) and not near and compound.fits(*self.stack[place][:3]):
                return False
        return False

    def style(self, tag: str, attrs: dict[str, str], classes: frozenset[str]) -> list[str | None]:
        best: list[tuple | None] = [None, None, None]

        def offer(which: int, value: str, rank: tuple) -> None:
            if best[which] is None or rank >= best[which][0]:
                best[which] = rank, value

        if "hidden" in attrs:
            offer(0, "none", (False, -1))
        if self.sheet.rules:
            for key in self._keys(tag, attrs, classes):
                for rule in self.sheet.rules.get(key, ()):
                    if rule.compounds[-1].fits(tag, attrs, classes) and self._above(rule, len(rule.compounds) - 2, len(self.stack)):
                        for which, value, important in rule.declared:
                            offer(which, value, (important, 0, rule.weight, rule.order))
        if "style" in attrs:
            for i, (which, value, important) in enumerate(declarations(attrs["style"])):
                offer(which, value, (important, 1, i))
        return [b and b[1] for b in best]

    def open(self, tag: str, attrs: dict[str, str]) -> tuple[bool, bool]:
        """Push an element; (is it hidden, is the text right below it?)."""
        classes = frozenset(attrs["class"].split()) if "class" in attrs else frozenset()
        display, visibility, opacity = self.style(tag, attrs, classes) if attrs or self.sheet.rules else UNSTYLED
        above = self.stack[-1] if self.stack else (None, None, None, False, "visible")
        gone = above[3] or display == "none" or _zero(opacity) or attrs.get("aria-hidden") == "true"
        if visibility in (None, "inherit", "unset"):
            visibility = above[4]
        elif visibility in ("initial", "revert"):
            visibility = "visible"
        if self.sheet.rules:
            for key in self._keys(tag, attrs, classes):
                self.places[key].append(len(self.stack))
        self.stack.append((tag, attrs, classes, gone, visibility))
        unseen = visibility in ("hidden", "collapse")
        return gone or unseen or (tag == "input" and attrs.get("type", "").lower() == "hidden"), display == "none" or above[3]

    def close(self) -> None:
        tag, attrs, classes, *_ = self.stack.pop()
        if self.sheet.rules:
            for key in self._keys(tag, attrs, classes):
                self.places[key].pop()


def _zero(opacity: str | None) -> bool:
    try:
        return opacity is not None and float(opacity.rstrip("%")) <= 0
    except ValueError:
        return False
