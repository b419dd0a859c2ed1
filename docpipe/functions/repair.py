"""A tolerant reader of JSON: what language models write, made the object that they meant.

An automaton with a stack of open objects and arrays goes over the text once. It mends: single, typographic and missing
quotes, bare keys and values, quotes inside strings, line ends inside strings, missing and doubled commas and colons,
comments, literals of other languages, closing brackets that are missing or wrong, ends that were cut off, and text around
the object. Looking ahead is bounded everywhere, so time grows with the text's length.
"""

from __future__ import annotations

import json
import re

#: Opening quotes and what may close them.
QUOTES = {'"': '"”', "'": "'’", "`": "`´", "“": '”"“', "‘": "’'‘", "„": '“”"', "«": "»"}
OPENERS = "".join(QUOTES)
BLANK = re.compile(r"(?:[\s﻿]+|//[^\n]*|#[^\n]*|/\*(?s:.*?)(?:\*/|\Z))*+")
SPACES = re.compile(r"[\s﻿]*+")
PLAIN = {opening: re.compile(rf"[^{closing}\\]*+") for opening, closing in QUOTES.items()}
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_QUOTED = r"""(?:"(?:[^"\\\n]|\\.){0,200}["”]|'(?:[^'\\\n]|\\.){0,200}['’]|`[^`\n]{0,200}`|[“„][^”"\n]{0,200}[”"]|‘[^’'\n]{0,200}[’'])"""
#: What stands ahead: a quoted or bare key and its colon; after a comma also a short key without one, or whatever else may follow.
KEY_AHEAD = re.compile(rf"""\s{{0,99}}(?:{_QUOTED}|[\w$-]{{1,99}})\s{{0,99}}:(?!//)""")
AFTER_COMMA = re.compile(rf"""{KEY_AHEAD.pattern}|\s{{0,99}}(?:["'][\w -]{{1,60}}["']\s{{0,9}}(?:["'{{\[0-9-]|true|false|null|\Z)|["'][^"'\n]{{0,99}}\Z|[,}}\]#]|/[/*]|\Z)""")
#: The rest of a number with a decimal comma.
DECIMALS = re.compile(r",[0-9]++(?=\s{0,99}(?:[,}\]\n]|\Z))")
BARE_KEY = re.compile(r"""[^:=,\n{}\[\]"“”]++""")
BARE_VALUE = re.compile(r"""(?:(?!\s{1,99}["'`“‘]?[\w$-]{1,99}["'`”’]?\s{0,99}:(?!//))(?!\s(?://|/\*|\#))[^,\n{}\[\]"“”])++""")
NOT_QUITE = re.compile(r",\s*\Z")
LITERALS = {"true": "true", "false": "false", "null": "null", "none": "null", "nil": "null", "undefined": "null", "nan": "null", "infinity": "null", "-infinity": "null"}
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
HEX = re.compile(r"[0-9a-fA-F]{4}")


class Open:
    """An open object or array: where its members begin in the output, which of them are gone, and its keys."""

    __slots__ = ("begin", "gone", "keys", "kind", "last", "lost", "starts", "state")

    def __init__(self, kind: str, begin: int, lost: bool):
        self.kind, self.begin, self.lost = kind, begin, lost  # lost: an opening bracket where a key should be
        self.starts: list[int] = []
        self.gone: set[int] = set()
        self.keys: dict[str, int] = {}
        self.last = ""
        self.state = "key" if kind == "{" else "value"


class Reader:
    """One pass over a text from an opening brace; `out` is the mended object in pieces."""

    def __init__(self, text: str, at: int):
        self.text, self.n, self.at = text, len(text), at
        self.out: list[str] = []
        self.stack: list[Open] = []
        self.count = {"{": 0, "[": 0}
        self.halves = False  # whether escapes of half characters may have been seen

    def joined(self, parts: list[str]) -> str:
        """The parts as one text, in which two halves of a character are one."""
        text = "".join(parts)
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if self.halves else text

    def read(self) -> str:
        self.push(False)
        while self.stack:
            self.at = BLANK.match(self.text, self.at).end()
            if self.at >= self.n:
                while self.stack:
                    self.pop()
                break
            self.step(self.text[self.at], self.stack[-1])
        return "".join(self.out)

    def push(self, lost: bool) -> None:
        kind = self.text[self.at]
        self.stack.append(Open(kind, len(self.out), lost))
        self.count[kind] += 1
        self.out.append(kind)
        self.at += 1

    def pop(self) -> None:
        held = self.stack.pop()
        self.count[held.kind] -= 1
        self.drop_key(held)
        if held.lost:
            del self.out[held.begin :]
            return
        alive = [start for i, start in enumerate(held.starts) if i not in held.gone]
        for start in alive[1:]:
            self.out[start] = ","
        self.out.append("}" if held.kind == "{" else "]")
        self.had_value()

    def close(self, sign: str) -> None:
        """Closes what the bracket closes, and all that was left open inside; a bracket that closes nothing is passed over."""
        kind = "{" if sign == "}" else "["
        self.at += 1
        if self.count[kind]:
            while self.stack:
                last = self.stack[-1].kind == kind
                self.pop()
                if last:
                    break

    def begin_member(self, held: Open) -> None:
        held.starts.append(len(self.out))
        self.out.append("")  # a comma, once it is known that a member stands before

    def drop_key(self, held: Open) -> None:
        """A key that no value followed."""
        if held.kind == "{" and held.state != "key":
            del self.out[held.starts.pop() :]
            held.state = "key"

    def had_value(self) -> None:
        if self.stack and self.stack[-1].kind == "{":
            self.stack[-1].state = "key"

    def name(self, held: Open, key: str) -> None:
        """Begins a member; of members with one key the last counts."""
        if key in held.keys:
            before = held.keys[key]
            begin, end = [*held.starts[before : before + 2], len(self.out)][:2]
            self.out[begin:end] = [""] * (end - begin)
            held.gone.add(before)
        held.keys[key], held.last = len(held.starts), key
        self.begin_member(held)
        self.out.append(json.dumps(key, ensure_ascii=False) + ":")
        held.state = "colon"

    def value(self, held: Open, text: str) -> None:
        if held.kind == "[":
            self.begin_member(held)
        self.out.append(text)
        self.had_value()

    def step(self, sign: str, held: Open) -> None:
        if sign in "}]":
            self.close(sign)
        elif sign == ",":
            self.at += 1
            self.forget(held)
        elif held.state == "key":
            self.key(sign, held)
        elif held.state == "colon":
            held.state = "value"
            if sign in ":=":
                self.at += 2 if self.text.startswith("=>", self.at) else 1
        elif sign in "{[":
            if held.kind == "[":
                self.begin_member(held)
            self.push(False)
        elif sign in OPENERS:
            self.quoted(held)
        elif sign == ":":
            self.at += 1
        else:
            self.bare(held)

    def quoted(self, held: Open) -> None:
        """A value in quotes; in an array that an object holds, one with a colon is that object's next key, and the array ends."""
        text = self.string(held.kind == "[")
        colon = held.kind == "[" and len(self.stack) > 1 and self.stack[-2].kind == "{" and self.text.startswith(":", SPACES.match(self.text, self.at).end())
        if colon:
            self.pop()
            self.name(self.stack[-1], text)
        else:
            self.value(held, json.dumps(text, ensure_ascii=False))

    def forget(self, held: Open) -> None:
        """As drop_key, where the object goes on: its key may come again."""
        if held.kind == "{" and held.state != "key":
            del held.keys[held.last]
            self.drop_key(held)

    def key(self, sign: str, held: Open) -> None:
        if sign in "{[":
            self.push(True)
        elif sign in OPENERS:
            self.name(held, self.quoted_key())
        else:
            found = BARE_KEY.match(self.text, self.at)
            self.at = found.end() if found else self.at + 1
            name = found[0].strip() if found else ""
            if name and self.text[self.at : self.at + 1] in (":", "="):
                self.name(held, name.rstrip("'`’"))

    def quoted_key(self) -> str:
        """A key ends at its first closing quote, or at a colon where that quote is missing."""
        opening, begin = self.text[self.at], self.at + 1
        parts, i = [], begin
        while True:
            found = PLAIN[opening].match(self.text, i)
            parts.append(found[0])
            i = found.end()
            if i >= self.n:
                break
            if self.text[i] == "\\":
                char, i = self.escape(i)
                parts.append(char)
                continue
            break
        name = self.joined(parts)
        follows = SPACES.match(self.text, i + 1).end() if i < self.n else self.n
        if not self.text.startswith(":", follows) and (colon := self.text.find(":", begin, i)) >= 0:
            self.at = colon
            return self.text[begin:colon]
        self.at = min(i + 1, self.n)
        return name

    def escape(self, i: int) -> tuple[str, int]:
        """The character that an escape stands for, and where it ends; unknown ones stand for themselves."""
        sign = self.text[i + 1 : i + 2]
        if sign == "u" and (found := HEX.match(self.text, i + 2)):
            self.halves |= found[0][:1] in "dD"
            return chr(int(found[0], 16)), i + 6
        return ESCAPES.get(sign, sign), i + 2

    def string(self, in_array: bool) -> str:
        """A value in quotes. A closing quote counts if what follows may follow a value; others belong to the text.

        Where a quote turns out to be the end of a key, this value's own closing quote was missing: it ends at the comma before.
        """
        text, opening = self.text, self.text[self.at]
        parts, i, cut = [], self.at + 1, None
        while True:
            found = PLAIN[opening].match(text, i)
            parts.append(found[0])
            i = found.end()
            if i >= self.n:
                break
            if text[i] == "\\":
                char, i = self.escape(i)
                parts.append(char)
                continue
            if self.ends(i + 1, in_array):
                i += 1
                break
            if cut and text.startswith(":", SPACES.match(text, i + 1).end()):
                parts, i = [*parts[: cut[0] - 1], NOT_QUITE.sub("", parts[cut[0] - 1])], cut[1]
                break
            if NOT_QUITE.search(found[0][-100:]):
                cut = (len(parts), i)
            parts.append(text[i])
            i += 1
        self.at = i
        return self.joined(parts)

    def ends(self, i: int, in_array: bool) -> bool:
        """Whether a value may end before place i."""
        at = SPACES.match(self.text, i).end()
        follows = self.text[at : at + 1]
        if follows == "" or follows in "}]" or self.text.startswith(("//", "/*"), at):
            return True
        if follows == ",":
            return in_array or bool(AFTER_COMMA.match(self.text, at + 1))
        if in_array:
            return follows in OPENERS or follows in "{[:"
        return bool(KEY_AHEAD.match(self.text, i))

    def bare(self, held: Open) -> None:
        found = BARE_VALUE.match(self.text, self.at)
        if not found:
            self.at += 1
            return
        self.at = found.end()
        word = found[0].strip()
        if self.text[self.at : self.at + 1] in ('"', "”") and self.ends(self.at + 1, held.kind == "["):
            self.at += 1  # an opening quote was missing
        if word.strip(".…") == "":
            self.forget(held)
        elif held.kind == "{" and word[-1:].isdigit() and (rest := DECIMALS.match(self.text, self.at)):
            self.at = rest.end()
            self.value(held, json.dumps(word + rest[0]))
        elif NUMBER.fullmatch(word):
            self.value(held, word)
        else:
            self.value(held, LITERALS.get(word.lower()) or json.dumps(word.strip("'`’"), ensure_ascii=False))


def repair_json(text: str | None) -> str | None:
    """The object that begins at the text's first opening brace, as valid JSON; None if there is no brace.

    What follows the object is left out. Of repeated keys the last counts. Keys without a value go.
    """
    at = (text or "").find("{")
    return None if at < 0 else Reader(text, at).read()
