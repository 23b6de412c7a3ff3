"""From ECMAScript regular expressions, phrases and globs to Java regular expressions.

The two dialects disagree on white space, word boundaries, the end of input and case folding; these are spelled out, so a
pattern finds the same in Spark as where it was written for.
"""

from __future__ import annotations

import os
import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

from sparkgauge.functions.globs import glob_regex

#: What ECMAScript counts as white space, as the inside of a Java character class.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: The class itself; what lies beyond Latin-1 is behind one range, so that most characters are settled by two tests.
WS = r"[\t-\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"
NOT_WS = f"[^{SPACE}]"
#: White space within a line, and what of it isn't one space already.
INNER = WS.replace(r"\t-\r ", r"\t\x0B-\r ")
INNER_WS = rf"(?: {INNER}|{INNER.replace('-\\r ', '-\\r')}){INNER}*+"
#: The same characters as a text.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_WORD = "A-Za-z0-9_"
_EDGE = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"
_NO_EDGE = f"(?:(?<![{_WORD}])(?![{_WORD}])|(?<=[{_WORD}])(?=[{_WORD}]))"
_META = set(".*+?^${}()|[]\\")


class PatternError(ValueError):
    """Not an ECMAScript pattern, or one that Java's engine has nothing for."""


_ANY = r"(?s:.)"
_SETS = {"d": "[0-9]", "D": "[^0-9]", "w": f"[{_WORD}]", "W": f"[^{_WORD}]", "s": f"[{SPACE}]", "S": NOT_WS}
_CONTROLS = {"v": r"\x0B", "t": r"\t", "n": r"\n", "r": r"\r", "f": r"\f", "0": r"\x00"}
#: Properties that Java knows by other names: with Is before them, and as short names of categories.
_BINARY = ("Alphabetic", "Ideographic", "Lowercase", "Uppercase", "White_Space", "Emoji", "Emoji_Presentation", "Emoji_Modifier", "Emoji_Modifier_Base", "Emoji_Component", "Extended_Pictographic")
_CATEGORIES = {
    "Letter": "L", "Lowercase_Letter": "Ll", "Uppercase_Letter": "Lu", "Titlecase_Letter": "Lt", "Mark": "M", "Number": "N", "Decimal_Number": "Nd", "Letter_Number": "Nl",
    "Punctuation": "P", "Dash_Punctuation": "Pd", "Symbol": "S", "Math_Symbol": "Sm", "Currency_Symbol": "Sc", "Separator": "Z", "Space_Separator": "Zs", "Other": "C", "Control": "Cc",
}


class _Pattern:
    """One walk over a pattern; every method reads what stands at ``at`` and returns it in Java's dialect."""

    def __init__(self, pattern: str, flags: str):
        self.pattern, self.flags, self.at = pattern, flags, 0
        named = re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?:\?<([^=!>]*)>)?(?!\?)", pattern, re.S)
        # Java's names are letters and digits: a group is called by its place among the named ones.
        self.names = {name: f"named{i}" for i, name in enumerate(m[1] for m in named if m[1] is not None)}

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.pattern[self.at - n : self.at]

    def whole(self) -> str:
        out = self.alternatives()
        if self.at < len(self.pattern):
            raise PatternError("a group is closed that was not opened")
        return out

    def alternatives(self) -> str:
        out, atom = [], False
        while self.at < len(self.pattern) and self.peek() != ")":
            c = self.peek()
            if bounds := re.compile(r"[*+?]|\{\d+(?:,\d*)?\}").match(self.pattern, self.at):
                if not atom:
                    raise PatternError("there is nothing to repeat")
                out.append(self.take(len(bounds[0])) + (self.take() if self.peek() == "?" else ""))
                atom = False
                continue
            atom = c not in "|^$"
            out.append(self.atom(c))
        return "".join(out)

    def atom(self, c: str) -> str:
        if c == "(":
            return self.group()
        if c == "[":
            return self.characters()
        if c == "\\":
            return self.escape()
        self.take()
        if c == "$":
            return r"(?=[\n\r\u2028\u2029]|\z)" if "m" in self.flags else r"\z"
        if c == "^":
            return r"(?<=[\n\r\u2028\u2029]|\A)" if "m" in self.flags else "^"
        if c == ".":
            return _ANY if "s" in self.flags else r"[^\n\r\u2028\u2029]"
        return "\\" + c if c in "{}]" else c

    def group(self) -> str:
        opening = re.compile(r"\((?:\?(?:[:=!]|<[=!]|<([A-Za-z_$][\w$]*)>))?(?!\?)").match(self.pattern, self.at)
        if not opening:
            raise PatternError("a group of no known kind")
        self.take(len(opening[0]))
        inside = self.alternatives()
        if self.peek() != ")":
            raise PatternError("a group is not closed")
        self.take()
        return (f"(?<{self.names[opening[1]]}>" if opening[1] else opening[0]) + inside + ")"

    def code_point(self) -> str | None:
        """An escape of one character by its number; None for other escapes."""
        if found := re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}").match(self.pattern, self.at) if "u" in self.flags else None:
            self.take(len(found[0]))
            return rf"\x{{{found[1]}}}"
        if found := re.compile(r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})").match(self.pattern, self.at):
            self.take(len(found[0]))
            return rf"\x{{{0x10000 + ((int(found[1], 16) - 0xD800) << 10) + int(found[2], 16) - 0xDC00:X}}}"
        if found := re.compile(r"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|c[A-Za-z])").match(self.pattern, self.at):
            return self.take(len(found[0]))
        return None

    def property(self) -> str | None:
        found = re.compile(r"\\([pP])\{(?:(\w+)=)?(\w+)\}").match(self.pattern, self.at) if "u" in self.flags else None
        if not found:
            return None
        self.take(len(found[0]))
        kind, name = found[2], _CATEGORIES.get(found[3], found[3])
        if kind in ("General_Category", "gc") or kind is None and len(name) <= 2:
            return rf"\{found[1]}{{{name}}}"
        if kind in ("Script", "sc", "Script_Extensions", "scx"):
            return rf"\{found[1]}{{script={name}}}"
        if kind is None and name in _BINARY:
            return rf"\{found[1]}{{Is{name}}}"
        raise PatternError(f"the property {name} is not known")

    def escape(self) -> str:
        if (known := self.code_point() or self.property()) is not None:
            return known
        if len(self.pattern) < self.at + 2:
            raise PatternError("a backslash at the end")
        e = self.take(2)[1]
        if e in "bB":
            return _EDGE if e == "b" else _NO_EDGE
        if e == "s":
            return WS
        if e in _SETS:
            return _SETS[e]
        if e == "k" and (found := re.compile(r"<([^>]*)>").match(self.pattern, self.at)) and self.names:
            if found[1] not in self.names:
                raise PatternError(f"there is no group {found[1]}")
            self.take(len(found[0]))
            return rf"\k<{self.names[found[1]]}>"
        if e.isdigit() and e != "0":
            digits = re.compile(r"\d*").match(self.pattern, self.at)[0]
            self.take(len(digits))
            return rf"(?:\{e}{digits})"
        return self.literal_escape(e)

    def literal_escape(self, e: str) -> str:
        if e in _CONTROLS:
            return _CONTROLS[e]
        if e.isalnum() and "u" in self.flags:
            raise PatternError(f"\\{e} has no meaning")
        return e if e.isalnum() or e in "_ " or ord(e) > 127 else "\\" + e

    def characters(self) -> str:
        """A class. Sets that are complements become classes of their own in it; a complement of such a class is a look-ahead, as engines
        disagree on what ^ takes in."""
        self.take()
        negated = self.peek() == "^"
        self.at += negated
        own, nested, after = [], [], False
        while self.peek() != "]":
            if self.at >= len(self.pattern):
                raise PatternError("a class is not closed")
            was, after = after, bool(re.compile(r"\\[dDsSwWpP]").match(self.pattern, self.at))
            if self.peek() != "\\":
                c = self.take()
                # next to a set a hyphen makes no range
                alone = c == "-" and (was or re.compile(r"\\[dDsSwWpP]").match(self.pattern, self.at))
                own.append("\\" + c if c in "[&^~" or alone else c)
                continue
            if (known := self.code_point() or self.property()) is not None:
                own.append(known)
                continue
            e = self.take(2)[1:]
            if not e:
                raise PatternError("a backslash at the end")
            if e == "s":
                own.append(SPACE)
            elif e in ("d", "w"):
                own.append(_SETS[e][1:-1])
            elif e in _SETS:
                nested.append(_SETS[e])
            else:
                own.append(r"\x08" if e == "b" else self.literal_escape(e))
        self.take()
        inside = "".join(own) + "".join(nested)
        if not inside:
            return _ANY if negated else "(?!)"
        if negated:
            return f"(?:(?![{inside}]){_ANY})" if nested else f"[^{inside}]"
        return f"[{inside}]"


def java_regex(pattern: str, flags: str = "") -> str:
    """The Java pattern for an ECMAScript ``pattern`` with ``flags`` (of which d, g and y don't matter here). Raises PatternError."""
    out = _Pattern(pattern, flags).whole()
    folds = "iu" if "u" in flags or not pattern.isascii() else "i"
    return (f"(?{folds})" if "i" in flags else "") + out


def escaped(text: str) -> str:
    return "".join("\\" + c if c in _META else c for c in text)


def phrase_regex(phrase: str) -> str:
    """A phrase in any case that no letter or hyphen touches; digits and other characters may."""
    return rf"(?iu)(?<![\p{{L}}-]){escaped(phrase.strip())}(?![\p{{L}}-])"


def phrases_regex(phrases: list[str]) -> str:
    """A place before which a character stands that is no letter or hyphen, and at which one of the phrases does, the longest as group 1;
    for a text in lower case that begins with a line break. Only the character before is taken, so that phrases may overlap."""

    def trie(words: list[str]) -> str:
        if len(words) == 1:
            return escaped(words[0])
        shared = os.path.commonprefix(words)
        rest: dict[str, list[str]] = {}
        for w in words:
            rest.setdefault(w[len(shared) : len(shared) + 1], []).append(w[len(shared) :])
        # a phrase that others begin with is tried after them
        return escaped(shared) + "(?:" + "|".join(trie(rest[c]) for c in sorted(rest, reverse=True)) + ")"

    return rf"[^\p{{L}}-](?=({trie(sorted(set(phrases)))})(?![\p{{L}}-]))"


def required_text(pattern: str, flags: str = "") -> str:
    """The longest text that stands in every match of an ECMAScript pattern; empty if none is evident. A text without it
    needn't be searched."""
    runs, run, depth = [], "", 0
    token = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?<?[:=!]?|[*+?]\??|\{\d+(?:,\d*)?\}\??|.", re.S)
    for m in token.finditer(pattern):
        c = m[0]
        if c == "|" and not depth:
            return ""
        repeated = c[0] in "*+?" or len(c) > 1 and c[0] == "{"
        plain = len(c) == 1 and c not in "|^$.()" or len(c) == 2 and c[0] == "\\" and not c[1].isalnum()
        if depth or c[0] == "(":
            depth += (c[0] == "(") - (c == ")")
        elif repeated:
            runs.append(run[:-1] if c[0] in "*?" or c.startswith("{0") else run)
            run = ""
            continue
        elif plain:
            run += c[-1]
            continue
        runs.append(run)
        run = ""
    runs.append(run)
    if "i" in flags:
        runs = [part for r in runs for part in re.split(r"[^\W\d_]+", r)]
    return max(runs, key=len, default="")


def required_texts(pattern: str, flags: str = "") -> tuple[str, ...]:
    """Texts in lower case, one of which stands in every match of an ECMAScript pattern read in lower case; none if no such texts
    are evident. Unlike required_text() it looks for letters in any case and into groups of plain texts."""
    if "i" in flags and ("u" in flags or not pattern.isascii()):
        return ()  # letters beyond ASCII fold to letters of it
    token = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?<?[:=!]?|[*+?]\??|\{\d+(?:,\d*)?\}\??|.", re.S)

    def plain(c: str) -> bool:
        return len(c) == 1 and c not in "|^$.()" or len(c) == 2 and c[0] == "\\" and not c[1].isalnum()

    tokens, at = [m[0] for m in token.finditer(pattern)], 0
    runs: list[tuple[str, ...]] = []
    run: tuple[str, ...] = ("",)

    def shortest(texts: tuple[str, ...]) -> int:
        return min(map(len, texts))

    def ended() -> None:
        nonlocal run
        runs.append(run)
        run = ("",)

    def group(begin: int) -> int:
        """The place after the group that begins there."""
        depth = 0
        for i in range(begin, len(tokens)):
            depth += (tokens[i][0] == "(") - (tokens[i] == ")")
            if not depth:
                return i + 1
        return len(tokens)

    while at < len(tokens):
        c = tokens[at]
        if c == "|":
            return ()
        end = group(at) if c[0] == "(" else at + 1
        after = tokens[end] if end < len(tokens) else ""
        repeated = after[:1] in ("*", "+", "?") or len(after) > 1 and after[0] == "{"
        if c == "(" and not repeated and "(" not in "".join(t[0] for t in tokens[at + 1 : end - 1]):
            options = [[]]
            for t in tokens[at + 1 : end - 1]:
                options[-1].append(t) if t != "|" else options.append([])
            whole = all(plain(t) and t[0] not in "*+?" and not (len(t) > 1 and t[0] == "{") for o in options for t in o)
            texts = tuple("".join(t[-1] for t in o) for o in options) if whole else tuple(required_text("".join(o)) for o in options)
            if whole:
                run = tuple(r + t for r in run for t in texts)
            else:
                ended()
                runs.append(texts)
        elif plain(c) and not repeated:
            run = tuple(r + c[-1] for r in run)
        elif plain(c) and (after[0] == "+" or re.match(r"\{[1-9]", after)):
            run = tuple(r + c[-1] for r in run)
            ended()
        else:
            ended()
        at = end + repeated
        if repeated:
            ended()
    ended()
    best = max((r for r in runs if len(r) <= 12), key=shortest, default=("",))
    return tuple(sorted({t.lower() for t in best})) if shortest(best) else ()


def required_tail(pattern: str, flags: str = "") -> str:
    """The pattern from the first place on where only a few characters fit (a character, or a short class without ranges), if an unbounded
    repetition or a group comes before it: what is cheap to search, and without a match leaves none to the whole. Empty if there is
    no such place, or if taking the front away could change what the rest means."""
    if re.search(r"\\[1-9k]|\(\?<[A-Za-z_$]", pattern):
        return ""
    token = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?<?[:=!]?|[*+?]\??|\{\d+(?:,\d*)?\}\??|.", re.S)
    tokens, depth, costly, found = list(token.finditer(pattern)), 0, False, ""
    for i, m in enumerate(tokens):
        c = m[0]
        if c == "|" and not depth:
            return ""
        if c[0] == "(":
            depth, costly = depth + 1, True
        elif c == ")":
            depth -= 1
        elif c[0] in "*+" or len(c) > 1 and c[0] == "{":
            costly = True
        elif not depth and costly and not found:
            few = c[0] == "[" and len(c) <= 6 and c[1] != "^" and "-" not in c and "\\" not in c or len(c) == 2 and c[0] == "\\" and not c[1].isalnum() or len(c) == 1 and c not in "^$.?" and not c.isalnum()
            optional = i + 1 < len(tokens) and (tokens[i + 1][0][0] in "*?" or tokens[i + 1][0].startswith("{0"))
            found = pattern[m.start() :] if few and not optional else ""
    return found


def problem_with(pattern: str, flags: str | None) -> str | None:
    """Why an ECMAScript pattern isn't valid; None if it is. Judged by what will run, the translation in Java's engine, where
    there is a session; without one by Python's engine, which has the same syntax but for what is rewritten here."""
    flags = flags or ""
    if set(flags) - set("dgimsuvy") or len(set(flags)) != len(flags):
        return f"Invalid flags supplied to RegExp constructor '{flags}'"
    try:
        java = java_regex(pattern, flags)
        if (context := SparkContext._active_spark_context) is not None:
            context._jvm.java.util.regex.Pattern.compile(java)
        else:  # Python has the same syntax but for what is rewritten here
            java = re.sub(r"\\k<(\w+)>", r"(?P=\1)", java)
            re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\x\{[^}]*\}", "a", re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", java)).replace(r"\z", r"\Z").replace(WS, r"\s"))
    except (PatternError, re.error, Py4JJavaError, IllegalArgumentException) as e:
        return f"Invalid regular expression: /{pattern}/: {' '.join(str(e).split())}"
    return None


__all__ = ["INNER", "INNER_WS", "NOT_WS", "SPACE", "SPACES", "WS", "PatternError", "escaped", "glob_regex", "java_regex", "phrase_regex", "phrases_regex", "problem_with", "required_tail", "required_text", "required_texts"]
