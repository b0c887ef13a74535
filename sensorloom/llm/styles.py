"""Which elements a page's own style sheets show, and how: ``display``, ``visibility`` and ``white-space`` by the cascade.

Read are rules for screens: plain rules, and those within ``@media`` (with a wide window), ``@supports`` and ``@layer``; other at-rules
are skipped. Selectors may combine tags, classes, ids, attributes, places among siblings and ``:not()``, by descent, by child and by siblings before; rules
with other parts, such as ``:hover``, match nothing, as they depend on what a page does later.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Width of the window that media queries are asked for, in pixels.
WINDOW = 1280
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.IGNORECASE)
_PART = re.compile(r"\*|(?P<tag>[a-zA-Z][\w-]*)|\.(?P<cls>-?[_a-zA-Z\u0080-￿][\w-]*)|#(?P<id>[\w-]+)|\[\s*(?P<key>[\w-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]")
_PSEUDO = re.compile(r":(?P<name>[a-z-]+)(?:\((?P<of>[^()]*)\))?", re.IGNORECASE)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<step>[+-]?\d*)n\s*(?:(?P<sign>[+-])\s*(?P<more>\d+))?|(?P<one>[+-]?\d+))\s*", re.IGNORECASE)
_COMBINATOR = re.compile(r"\s*[>+~]\s*(?![^\[(]*[\])])|\s+(?![^\[(]*[\])])")
_WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)(px|em|rem)\s*\)")


def declarations(text: str) -> dict[str, tuple[str, bool]]:
    """What is read of a block or a style attribute: the value and whether it is important."""
    found: dict[str, tuple[str, bool]] = {}
    for m in _DECLARATION.finditer(text):
        name, important = m[1].lower(), m[3] is not None
        if important or not found.get(name, ("", False))[1]:
            found[name] = m[2].lower(), important
    return found


def on_screen(query: str) -> bool:
    """Whether a media query list holds for a screen of ``WINDOW`` pixels; unknown features don't."""
    return not query.strip() or any(map(_one_query, query.lower().split(",")))


def _one_query(query: str) -> bool:
    query = query.strip()
    negated = query.startswith("not ")
    parts = re.split(r"\s+and\s+", query.removeprefix("not ").removeprefix("only "))
    return negated != all(_holds(p.strip()) for p in parts)


def _holds(part: str) -> bool:
    if width := _WIDTH.fullmatch(part):
        pixels = float(width[2]) * (1 if width[3] == "px" else 16)
        return pixels <= WINDOW if width[1] == "min" else pixels >= WINDOW
    return part in ("all", "screen")


def rules(sheet: str) -> list[tuple[str, str]]:
    """Selector lists and their blocks, of the parts of a sheet that hold."""
    sheet, found, at = _COMMENT.sub(" ", sheet).replace("<!--", " ").replace("-->", " "), [], 0
    open_groups = 0
    while at < len(sheet):
        stop = re.compile(r"[{};]").search(sheet, at)
        if not stop:
            break
        head, at = sheet[at : stop.start()].strip(), stop.end()
        if stop[0] == "}":
            open_groups = max(0, open_groups - 1)
        elif stop[0] == "{":
            name = head.split(None, 1)[0].split("(")[0].lower() if head.startswith("@") else ""
            rest = head[len(name) :]
            if name in ("@media", "@supports", "@layer") and (on_screen(rest) if name == "@media" else not rest.strip().startswith("not")):
                open_groups += 1
                continue
            end = _block_end(sheet, at)
            if not name:
                found.append((head, sheet[at : end - 1]))
            at = end
    return found


def _block_end(sheet: str, at: int) -> int:
    """The place after the brace that closes the block that is open at ``at``."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(sheet, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(sheet) + 1


@dataclass(frozen=True)
class Compound:
    """One element's part of a selector."""

    tag: str = ""
    classes: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    attributes: tuple[tuple[str, str, str], ...] = ()
    places: tuple[tuple[int, int, bool], ...] = ()  # step, start and whether counted from the end: the element's place is start + k step
    others: tuple[Compound, ...] = ()  # of :not()

    def matches(self, node, above) -> bool:
        tag, attributes = node.tag, node.attributes
        if self.tag and self.tag != tag:
            return False
        if self.ids and any(attributes.get("id") != x for x in self.ids):
            return False
        if self.classes:
            own = attributes.get("class", "").split()
            if any(x not in own for x in self.classes):
                return False
        if not all(key in attributes and _fits(attributes[key], how, value) for key, how, value in self.attributes):
            return False
        for step, start, from_end in self.places:
            far = (above[0].last.number + 1 - node.number if from_end else node.number) - start
            if (far != 0) if not step else (far % step or far // step < 0):
                return False
        return not any(x.matches(node, above) for x in self.others)

    def weight(self) -> tuple[int, int, int]:
        own = len(self.ids), len(self.classes) + len(self.attributes) + len(self.places), int(bool(self.tag))
        return tuple(map(sum, zip(own, *(x.weight() for x in self.others), strict=True)))


def _place(text: str) -> tuple[int, int] | None:
    """Step and start of ``2n + 1``, ``odd``, ``3`` and the like."""
    m = _NTH.fullmatch(text)
    if not m:
        return None
    if m["word"]:
        return 2, int(m["word"].lower() == "odd")
    if m["one"]:
        return 0, int(m["one"])
    step = int(m["step"]) if m["step"] not in ("", "+", "-") else int(f"{m['step']}1")
    return step, int(f"{m['sign']}{m['more']}") if m["more"] else 0


def _structural(name: str, of: str | None) -> list[tuple[int, int, bool]] | None:
    if of is None:
        return {"first-child": [(0, 1, False)], "last-child": [(0, 1, True)], "only-child": [(0, 1, False), (0, 1, True)]}.get(name)
    place = _place(of) if name in ("nth-child", "nth-last-child") else None
    return [(*place, name == "nth-last-child")] if place else None


def _fits(own: str, how: str, value: str) -> bool:
    return {"": True, "=": own == value, "~=": value in own.split(), "|=": own == value or own.startswith(value + "-"), "^=": bool(value) and own.startswith(value), "$=": bool(value) and own.endswith(value), "*=": bool(value) and value in own}[how]


def compound(text: str) -> Compound | None:
    """None for what isn't read."""
    at, tag, classes, ids, attributes, places, others = 0, "", [], [], [], [], []
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            m = _PSEUDO.match(text, at)
            if not m:
                return None
            at, name = m.end(), m["name"].lower()
            if name == "not" and m["of"]:
                given = [compound(x.strip()) for x in m["of"].split(",")]
                if not all(given):
                    return None
                others += given
            elif (found := _structural(name, m["of"])) is not None:
                places += found
            else:
                return None
            continue
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
        elif m["cls"]:
            classes.append(m["cls"])
        elif m["id"]:
            ids.append(m["id"])
        elif m["key"]:
            attributes.append((m["key"].lower(), m["how"] or "", next((v for v in (m["a"], m["b"], m["c"]) if v is not None), "")))
    return Compound(tag, tuple(classes), tuple(ids), tuple(attributes), tuple(places), tuple(others)) if text else None


@dataclass
class Styles:
    """The rules of a page by what their last part asks for first: an id, a class, a tag, or nothing."""

    by_key: dict[tuple[str, str], list[tuple]] = field(default_factory=dict)

    @classmethod
    def of(cls, sheets: list[str]) -> Styles:
        out, order = cls(), 0
        for sheet in sheets:
            for selectors, block in rules(sheet):
                values = declarations(block)
                for selector in re.split(r",(?![^(]*\))", selectors) if values else ():
                    selector = selector.strip()
                    parts = [compound(p) for p in _COMBINATOR.split(selector)]
                    if parts and all(parts):
                        order += 1
                        how = [m[0].strip() for m in _COMBINATOR.finditer(selector)]
                        weight = (*map(sum, zip(*(p.weight() for p in parts), strict=True)), order)
                        last = parts[-1]
                        key = ("#", last.ids[0]) if last.ids else (".", last.classes[0]) if last.classes else ("", last.tag)
                        out.by_key.setdefault(key, []).append((weight, parts, how, values))
        return out

    def __call__(self, node, ancestors) -> dict[str, str]:
        """What rules and the style attribute give an element; ``ancestors``: nested pairs (node, its ancestors)."""
        best: dict[str, tuple] = {}
        tag, attributes = node.tag, node.attributes
        if self.by_key:
            keys = [("", tag), ("", "")]
            if attributes:
                keys += [("#", attributes["id"])] if "id" in attributes else []
                keys += [(".", c) for c in set(attributes["class"].split())] if "class" in attributes else []
            for key in keys:
                for weight, parts, how, values in self.by_key.get(key, ()):
                    if parts[-1].matches(node, ancestors) and (len(parts) == 1 or _under(parts, how, node, ancestors)):
                        for name, (value, important) in values.items():
                            if (rank := (important, False, weight)) > best.get(name, ((),))[0]:
                                best[name] = rank, value
        if "style" in attributes:
            for name, (value, important) in declarations(attributes["style"]).items():
                if (rank := (important, True, ())) > best.get(name, ((),))[0]:
                    best[name] = rank, value
        return {name: value for name, (_, value) in best.items()}


def _under(parts: list[Compound], how: list[str], node, ancestors) -> bool:
    """Whether the parts but the last match ancestors or siblings before, each as its combinator asks; no place is tried twice for a part."""
    states, seen = [(len(parts) - 2, node, ancestors)], set()
    while states:
        k, node, above = states.pop()
        if k < 0:
            return True
        beside = how[k] in ("+", "~")
        while (node := node.before) if beside else above:
            if not beside:
                node, above = above
            if (k, id(node)) in seen:
                break  # from here on all has been tried
            if how[k] in ("", "~"):
                seen.add((k, id(node)))
            if parts[k].matches(node, above):
                states.append((k - 1, node, above))
            if how[k] in (">", "+"):
                break
    return False
