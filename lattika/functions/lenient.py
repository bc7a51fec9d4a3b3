"""A JSON reader for what models write: quotes of any kind, bare keys, comments, missing or spare commas, ends that are cut off."""

from __future__ import annotations

import re

# Quotes and what closes them, words for constants, escapes of one letter.
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’"}
WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None, "undefined": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

_BLANK = re.compile(r"(?:\s+|/\*.*?(?:\*/|\Z)|//[^\n]*|\.\.\.)+", re.S)
_SPACE = re.compile(r"\s*")
_BARE = re.compile(r"[^\s,:{}\[\]\"'`“”‘’]+")
_WORD = re.compile(r"[^,:{}\[\]\n\"`“”]+")
_KEY = re.compile(r"[\w$-]+\s*:")
_NUMBER = re.compile(r"([+-]?)(\d*)(\.\d*)?(?:[eE]([+-]?\d*))?\Z")
_NOTHING = object()


def _number(word: str) -> int | float | None:
    """The number a word writes, ends that are cut off included; None for other words."""
    m = _NUMBER.match(word)
    if not m or not (m[2] or (m[3] or "")[1:] or (m[1] == "-" and not m[3])):
        return None
    whole = f"{'-' if m[1] == '-' else ''}{m[2] or '0'}"
    if m[3] is None and m[4] is None:
        return int(whole)
    return float(f"{whole}.{(m[3] or '.')[1:] or '0'}e{m[4] if (m[4] or '').strip('+-') else '0'}")


class Reader:
    """Reads one value with a stack of the containers that are open; no call depends on how deep they are."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _skip(self) -> str:
        """Past blanks and comments; the character there, empty at the end."""
        if m := _BLANK.match(self.text, self.at):
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def _closes(self, at: int) -> bool:
        """A quote at this place ends its text: what follows may stand between values, or begin one on a line of its own."""
        begin = at + 1
        after = _SPACE.match(self.text, begin).end()
        return self.text[after : after + 1] in ("", *",:}]\"'`+“‘/") or "\n" in self.text[begin:after] or (after > begin and _KEY.match(self.text, after) is not None)

    def _quoted(self) -> str:
        close, out = QUOTES[self.text[self.at]], []
        self.at += 1
        plain = re.compile(rf"[^\\{close}]+")
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == close:
                if self._closes(self.at):
                    self.at += 1
                    break
                out.append(c)
                self.at += 1
            elif c == "\\":
                self.at += 2
                e = self.text[self.at - 1 : self.at]
                if e == "u":
                    digits = re.match(r"[0-9a-fA-F]{4}", self.text[self.at : self.at + 4])
                    if digits:
                        self.at += 4
                        out.append(chr(int(digits[0], 16)))
                    else:
                        self.at = len(self.text) if len(self.text) - self.at < 4 else self.at  # cut off inside, or no escape
                else:
                    out.append(ESCAPES.get(e, e))
            else:
                m = plain.match(self.text, self.at)
                out.append(m[0])
                self.at = m.end()
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def _joined(self) -> str:
        """A quoted text, and those that are added to it with `+`."""
        out = self._quoted()
        while self._skip() == "+":
            mark, self.at = self.at, self.at + 1
            if self._skip() not in QUOTES or not self.text[self.at : self.at + 1]:
                self.at = mark + 1
                break
            out += self._quoted()
        return out

    def _scalar(self):
        word = _WORD.match(self.text, self.at)
        bare = word[0].split("//")[0].split("/*")[0].rstrip() if word else ""
        first = bare.split(None, 1)[0] if bare else ""
        number = _number(first)
        if first in WORDS or number is not None:  # what follows it without a comma is a value of its own
            self.at += len(first)
            return WORDS[first] if first in WORDS else number
        self.at += max(len(bare), 1)
        return bare if bare else _NOTHING

    def value(self):
        """The value at the present place, or a sentinel where there is none; containers are closed where the text ends."""
        root, stack, keys = _NOTHING, [], []

        def place(v, opens: bool = False) -> None:
            nonlocal root
            if not stack:
                root = v
            elif isinstance(stack[-1], list):
                stack[-1].append(v)
            else:
                stack[-1][keys[-1]] = v
                keys[-1] = _NOTHING
            if opens:
                stack.append(v)
                keys.append(_NOTHING)

        def close() -> None:
            if isinstance(stack[-1], dict) and keys[-1] is not _NOTHING:
                stack[-1][keys[-1]] = None
            stack.pop()
            keys.pop()

        while c := self._skip():
            if c in "}]":
                kind = dict if c == "}" else list
                if not any(isinstance(s, kind) for s in stack):
                    self.at += 1
                    continue
                while not isinstance(stack[-1], kind):
                    close()
                close()
                self.at += 1
            elif c in ",;":
                self.at += 1
                if stack and isinstance(stack[-1], dict) and keys[-1] is not _NOTHING:
                    place(None)
                continue
            elif stack and isinstance(stack[-1], dict) and keys[-1] is _NOTHING:
                if c in QUOTES:
                    keys[-1] = self._joined()
                elif m := _BARE.match(self.text, self.at):
                    keys[-1], self.at = m[0], m.end()
                else:
                    self.at += 1
                    continue
                if self._skip() == ":":
                    self.at += 1
                continue
            elif c == ":":
                self.at += 1
                continue
            elif c in "{[":
                self.at += 1
                place({} if c == "{" else [], True)
            elif c in QUOTES:
                place(self._joined())
            elif (v := self._scalar()) is not _NOTHING:
                place(v)
            if root is not _NOTHING and not stack:
                break
        while stack:
            close()
        return root


def read_object(text: str | None) -> dict | None:
    """The first JSON object in a text, read as its writer may have meant it; None where there is none."""
    begin = text.find("{") if text is not None else -1
    if begin < 0:
        return None
    reader = Reader(text)
    reader.at = begin
    return reader.value()


def checkpoint_part(text: str | None) -> str | None:
    """What a stream says after its last `<data-json>`, up to the end tag; the whole stream where it has none."""
    return None if text is None else text.rpartition("<data-json>")[2].partition("</data-json>")[0]
