"""Path globs as Java regular expressions: a glob is read into a tree once, on the driver, and the tree is written out.

``*`` and ``?`` stay within a folder, ``**`` as a whole part of a path crosses folders, ``[..]`` and ``[!..]`` are characters, ``{a,b}`` alternatives
(nested as they like), ``{a..c}`` the characters of a range, ``@( ?( *( +( !(`` extended groups of alternatives by ``|``, plain
parentheses too; a backslash takes the meaning from what follows. An ``!`` before all negates the glob. What isn't closed is
text. Files that begin with a dot are like others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Longer globs can't be compiled.
MOST = 65_536
_PLAIN = set(".+^$|(){}[]\\*?/-&~#")


@dataclass
class Node:
    """text, star, globstar, any, class (``text`` is what stands between the brackets), or alternatives after ``mark``."""

    kind: str
    text: str = ""
    mark: str = ""
    options: list[list[Node]] = field(default_factory=list)


class _Reader:
    def __init__(self, glob: str):
        self.glob, self.at = glob, 0

    def _closes(self, opening: str, closing: str) -> bool:
        """Whether the bracket at this place is closed somewhere."""
        depth, i = 0, self.at
        while i < len(self.glob):
            c = self.glob[i]
            if c == "\\":
                i += 1
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
                if depth == 0:
                    return True
            i += 1
        return False

    def sequence(self, ends: str) -> list[Node]:
        """Nodes up to one of the characters ``ends``, which is left to be read, or to the end."""
        nodes: list[Node] = []

        def text(c: str) -> None:
            if nodes and nodes[-1].kind == "text":
                nodes[-1].text += c
            else:
                nodes.append(Node("text", c))

        while self.at < len(self.glob) and self.glob[self.at] not in ends:
            c, rest = self.glob[self.at], self.glob[self.at + 1 :]
            if c == "\\" and rest:
                text(rest[0])
                self.at += 2
            elif c in "@?*+!" and rest.startswith("(") and self._group_closes(1):
                self.at += 2
                nodes.append(Node("group", mark=c, options=self._options("|", ")")))
            elif c == "(" and self._group_closes(0):
                self.at += 1
                nodes.append(Node("group", mark="@", options=self._options("|", ")")))
            elif c == "{" and self._closes("{", "}"):
                nodes += self._braces()
            elif c == "[" and (found := re.match(r"\[([!^]?\]?[^\]]*)\]", self.glob[self.at :])) and found[1] not in ("", "!", "^"):
                nodes.append(Node("class", found[1]))
                self.at += found.end()
            elif c == "*":
                run = re.match(r"\*+", self.glob[self.at :])[0]
                starts = self.at == 0 or self.glob[self.at - 1] in "/{,(|"
                nodes.append(Node("globstar" if len(run) > 1 and starts else "star"))
                self.at += len(run)
            elif c == "?":
                nodes.append(Node("any"))
                self.at += 1
            else:
                text(c)
                self.at += 1
        return nodes

    def _group_closes(self, ahead: int) -> bool:
        self.at += ahead
        closes = self._closes("(", ")")
        self.at -= ahead
        return closes

    def _options(self, between: str, end: str) -> list[list[Node]]:
        options = [self.sequence(between + end)]
        while self.at < len(self.glob) and self.glob[self.at] == between:
            self.at += 1
            options.append(self.sequence(between + end))
        self.at += 1
        return options

    def _braces(self) -> list[Node]:
        begin = self.at
        self.at += 1
        if ends := re.match(r"([^{},/\\]+?)\.\.([^{},/\\]+?)\}", self.glob[self.at :]):
            self.at += ends.end()
            low, high = sorted((ends[1], ends[2]))
            try:
                re.compile(f"[{low}-{high}]")
            except re.error:
                return [Node("text", f"{low}..{high}")]
            return [Node("class", f"{low}-{high}")]
        options = self._options(",", "}")
        if len(options) == 1:  # nothing to choose from: the braces are text
            return [Node("text", "{"), *options[0], Node("text", "}")] if self.glob[begin + 1 : self.at - 1] else [Node("text", "{}")]
        return [Node("group", mark="@", options=options)]


def _literal(text: str) -> str:
    return "".join("\\" + c if c in _PLAIN else c for c in text)


def _written(nodes: list[Node], rest: str = "") -> str:
    """The nodes as an expression; ``rest`` is what follows them, which a negated group has to look at."""
    out = rest
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        before = nodes[i - 1] if i else None
        if node.kind == "text":
            text = node.text
            if before is not None and before.kind == "globstar" and text.startswith("/"):
                text = text[1:]  # which the stars before it have taken
            if i + 1 < len(nodes) and nodes[i + 1].kind == "globstar" and text.endswith("/") and len(text) > 1 and i + 2 == len(nodes) and not rest:
                out = _literal(text[:-1]) + "(?:/.*)?"  # a/** is a itself, too
            else:
                out = _literal(text) + out
        elif node.kind == "star":
            out = "[^/]*" + out
        elif node.kind == "any":
            out = "[^/]" + out
        elif node.kind == "globstar":
            slash = i + 1 < len(nodes) and nodes[i + 1].kind == "text" and nodes[i + 1].text.startswith("/")
            out = ("(?:.*/)?" if slash else ".*") + out
        elif node.kind == "class":
            negated = node.text[0] in "!^"
            inside = re.sub(r"([\\\[&~])", r"\\\1", node.text[negated:])
            inside = "\\]" + inside[1:] if inside.startswith("]") else inside
            out = f"[^/{inside}]" + out if negated else f"[{inside}]" + out
        else:
            options = "|".join(_written(o) for o in node.options)
            if node.mark == "!":
                out = rf"(?:(?!(?:{options}){out}\z)[^/]*)" + out
            else:
                out = f"(?:{options})" + {"@": "", "?": "?", "*": "*", "+": "+"}[node.mark] + out
    return out


def glob_regex(glob: str) -> str:
    """The Java pattern of a whole path for ``glob``."""
    bare = glob[2:] if glob.startswith("./") else glob
    negated = 0
    while bare.startswith("!") and not bare.startswith("!("):
        bare, negated = bare[1:], negated + 1
    whole = _written(_Reader(bare).sequence(""))
    return rf"^(?!{whole}\z)(?s:.*)\z" if negated % 2 else rf"^(?:{whole})\z"
