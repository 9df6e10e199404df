"""Rule files read line by line, one pass a file, in Arrow batches.

A rule file is a mapping of indented lines.  ``Reader`` walks its lines once and
keeps where it is as a line number; a value is a text, a list or a mapping.
It follows what rule files are written in: bare and quoted keys and values,
values that go on in deeper lines, folded and literal blocks, dashed and
bracketed lists, braced mappings, comments, anchors, aliases and merged
mappings; type tags are passed over.  Only the top-level blocks that are asked
for are read, unless the file has anchors, which any block may hold.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa

#: the fields of a rule and of its parts
FIELDS = ("title", "level", "status", "tags", "logsource", "detection")
LOG_PARTS = ("category", "product", "service")

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"\s*|'(?:[^']|'')*'\s*|[^\s#\-\[\]{}&*!|>'"%@`?,:][^:#]*|[\-?][^\s:#][^:#]*|<<\s*):(?=\s|$)""")
_PROPERTY = re.compile(r"([&!])([^\s,\[\]{}]*)\s*")
_BLOCK = re.compile(r"[|>][+\-0-9]*\s*(#.*)?$")
_COMMENT = re.compile(r"(^|\s)#.*$")
_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|.)")
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", "b": "\b"}
_DEEPEST = 40


class Unreadable(ValueError):
    """A file whose brackets or quotes do not close, or that nests too deep."""


def _escaped(m: re.Match) -> str:
    x = m[1]
    return chr(int(x[1:], 16)) if len(x) > 1 else _CONTROL.get(x, x)


def unquoted(text: str) -> str:
    text = text.strip()
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    return _ESCAPE.sub(_escaped, text[1:-1]) if text[:1] == '"' else text


def _quoted_end(text: str, at: int) -> int:
    """The place behind the quote that closes the one at ``at``; -1 if none does."""
    quote, i = text[at], at + 1
    while i < len(text):
        if quote == '"' and text[i] == "\\":
            i += 2
        elif text[i] == quote:
            if quote == "'" and text[i + 1 : i + 2] == "'":
                i += 2
            else:
                return i + 1
        else:
            i += 1
    return -1


def _cut(text: str, parts: list[str]) -> int:
    """Cut a flow value into marks and texts; the place behind its last bracket, -1 if that is not there."""
    parts.clear()
    i, start, open_ = 0, 0, 0
    while i < len(text):
        ch, fresh = text[i], start == i or text[start:i].isspace()
        if ch in "'\"" and fresh:
            end = _quoted_end(text, i)
            if end < 0:
                return -1
            parts.append(text[i:end])
            i = start = end
        elif ch in "[]{}," or (ch == ":" and (text[i + 1 : i + 2] in ("", " ", "\t") or (fresh and parts and parts[-1][0] in "'\""))):
            if not fresh:
                parts.append(text[start:i].strip())
            parts.append(ch)
            open_ += (ch in "[{") - (ch in "]}")
            i += 1
            start = i
            if not open_:
                return i
        else:
            i += 1
            start = i if fresh and ch.isspace() else start
    return -1


def _merge(into: dict, value) -> None:
    """Merged mappings: the first that has a key gives its value."""
    for part in value if isinstance(value, list) else [value]:
        for k, v in part.items() if isinstance(part, dict) else ():
            into.setdefault(k, v)


class Reader:
    def __init__(self, content: str):
        self.lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.at = 0
        self.anchors: dict[str, object] = {}

    def _indent(self, i: int) -> int:
        line = self.lines[i]
        return len(line) - len(line.lstrip(" \t"))

    def _skip(self) -> bool:
        """Go to the next line that says something; whether there is one."""
        while self.at < len(self.lines):
            line = self.lines[self.at].strip()
            if line and line[0] != "#" and line not in ("---", "...") and not line.startswith("%"):
                return True
            self.at += 1
        return False

    # --- whole files ---

    def document(self, wanted) -> dict:
        """The wanted top-level fields; the first of a repeated one counts."""
        every = any("&" in line for line in self.lines)
        found: dict[str, object] = {}
        merged: dict[str, object] = {}
        while self._skip():
            line = self.lines[self.at]
            m = _KEY.match(line) if self._indent(self.at) == 0 else None
            if m is None:
                self.at += 1
                continue
            key = unquoted(m[1])
            if key == "<<":
                _merge(merged, self.value(line[m.end() :], 0, 0))
            elif every or (key in wanted and key not in found):
                value = self.value(line[m.end() :], 0, 0)
                found.setdefault(key, value)
            else:
                self.at += 1  # the lines below are deeper, or are passed over one by one
        return {**merged, **found}

    # --- values ---

    def value(self, rest: str, indent: int, depth: int):
        """What follows a key or a dash on the current line and on deeper lines; ``indent`` is that of the key."""
        if depth > _DEEPEST:
            raise Unreadable("depth")
        rest, name = rest.strip(), None
        while m := _PROPERTY.match(rest):
            name = m[2] if m[1] == "&" else name
            rest = rest[m.end() :]
        if _BLOCK.match(rest):
            value = self._block_text(indent)
        elif rest[:1] in ("[", "{"):
            value = self._flow(rest, depth)
        elif rest[:1] in ("'", '"'):
            value = self._quoted(rest)
        elif not _COMMENT.sub("", rest):
            value = self._below(indent, depth)
        elif rest[0] == "*" and (alias := _COMMENT.sub("", rest)[1:].strip()) in self.anchors:
            self.at += 1
            value = self.anchors[alias]
        else:
            value = self._plain(rest, indent)
        if name:
            self.anchors[name] = value
        return value

    def _below(self, indent: int, depth: int):
        """A list, a mapping or a text on the lines below."""
        self.at += 1
        if not self._skip():
            return ""
        deep, line = self._indent(self.at), self.lines[self.at].strip()
        dashed = line == "-" or line.startswith("- ")
        if deep < indent or (deep == indent and not dashed):
            return ""
        if dashed:
            return self._list(deep, depth)
        if _KEY.match(line):
            return self._mapping(deep, depth)
        return self._plain(line, indent)

    def _list(self, indent: int, depth: int) -> list:
        out = []
        while self._skip() and self._indent(self.at) == indent:
            line = self.lines[self.at]
            text = line[indent:]
            if not (text == "-" or text.startswith(("- ", "-\t"))):
                break
            body = text[1:].lstrip(" \t")
            inner = indent + len(text) - len(body)
            if _KEY.match(body):  # a mapping that begins on the dash's line
                self.lines[self.at] = " " * inner + body
                out.append(self._mapping(inner, depth + 1))
            else:
                out.append(self.value(body, indent, depth + 1))
        return out

    def _mapping(self, indent: int, depth: int) -> dict:
        out: dict[str, object] = {}
        merged: dict[str, object] = {}
        while self._skip() and self._indent(self.at) == indent:
            line = self.lines[self.at][indent:]
            m = _KEY.match(line)
            if m is None:
                if line.startswith("- ") or line == "-":
                    break
                self.at += 1
                continue
            key, value = unquoted(m[1]), self.value(line[m.end() :], indent, depth + 1)
            if key == "<<":
                _merge(merged, value)
            else:
                out.setdefault(key, value)
        # a line between two depths belongs to no mapping that is open
        while self._skip() and self._indent(self.at) > indent:
            self.at += 1
        return {**merged, **out}

    def _block_text(self, indent: int) -> str:
        self.at += 1
        words = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self._indent(self.at) > indent):
            words.append(self.lines[self.at].strip())
            self.at += 1
        return " ".join(w for w in words if w)

    def _plain(self, rest: str, indent: int) -> str:
        """A bare text, with the deeper lines it goes on in."""
        words = [_COMMENT.sub("", rest).strip()]
        ended = words[0] != rest.strip()  # nothing goes on behind a comment
        self.at += 1
        while not ended and self.at < len(self.lines) and self.lines[self.at].strip() and self._indent(self.at) > indent:
            line = self.lines[self.at].strip()
            if line[0] == "#":
                break
            words.append(_COMMENT.sub("", line).strip())
            self.at += 1
        return " ".join(words).strip()

    def _until(self, rest: str, end_of) -> str:
        """``rest`` with as many of the next lines as it takes to its end, which ``end_of`` tells (-1: not yet)."""
        first, taken = self.at, [rest]
        while (end := end_of(text := " ".join(taken))) < 0:
            more = self.lines[first + len(taken) : first + 2 * len(taken)]
            if not more:
                raise Unreadable("open")
            taken += [x.strip() if "'" in x or '"' in x else _COMMENT.sub("", x).strip() for x in more]
        ends = list(accumulate(len(x) + 1 for x in taken))
        self.at = first + bisect_left(ends, end) + 1
        return text[:end]

    def _quoted(self, rest: str) -> str:
        return unquoted(self._until(rest, lambda text: _quoted_end(text, 0)))

    def _flow(self, rest: str, depth: int):
        """A bracketed list or a braced mapping, over as many lines as it takes."""
        parts: list[str] = []
        self._until(rest, lambda text: _cut(text, parts))
        return self._node(parts, 0, depth)[0]

    def _node(self, parts: list[str], i: int, depth: int):
        """The value that begins with part i, and the part behind it."""
        if depth > _DEEPEST:
            raise Unreadable("depth")
        mark = parts[i]
        if mark not in ("[", "{"):
            while m := _PROPERTY.match(mark):
                mark = mark[m.end() :]
            return self.anchors.get(mark[1:], mark) if mark[:1] == "*" else unquoted(mark), i + 1
        out, i = ([] if mark == "[" else {}), i + 1
        while i < len(parts) and parts[i] not in ("]", "}"):
            if parts[i] in (",", ":"):
                i += 1
                continue
            item, i = self._node(parts, i, depth + 1)
            pair = i < len(parts) and parts[i] == ":"
            value = ""
            if pair:
                i += 1
                if i < len(parts) and parts[i] not in (",", "]", "}"):
                    value, i = self._node(parts, i, depth + 1)
            if isinstance(out, list):
                out.append({item: value} if pair and isinstance(item, str) else item)
            elif isinstance(item, str):
                out.setdefault(item, value)
        return out, i + 1


def _text(value) -> str:
    if isinstance(value, str):
        return value
    return " | ".join(filter(None, map(_text, value))) if isinstance(value, list) else ""


def read_rule(content: str | None) -> tuple:
    """title, level, status, tags, parts of the log source, condition and the reason why the file gives no rule."""
    try:
        found = Reader(content or "").document(FIELDS)
    except Unreadable:
        return "", "", "", [], [], "", "yaml"
    title, level, status = (_text(found.get(k, "")).strip() for k in FIELDS[:3])
    tags = found.get("tags", [])
    tags = [_text(t).strip() for t in (tags if isinstance(tags, list) else [tags])]
    log, detection = (x if isinstance(x := found.get(k), dict) else {} for k in ("logsource", "detection"))
    parts = [_text(v).strip() for k, v in log.items() if k in LOG_PARTS]
    return title, level, status, tags, parts, _text(detection.get("condition", "")), None if title else "title"


COLUMNS = "path string, title string, level string, status string, tags array<string>, parts array<string>, condition string, reason string"
_SCHEMA = pa.schema([(n, pa.list_(pa.string()) if n in ("tags", "parts") else pa.string()) for n in (c.split()[0] for c in COLUMNS.split(", "))])


def read_batches(batches):
    """Record batches of (path, content) to rows of ``COLUMNS``."""
    for batch in batches:
        read = zip(*[read_rule(x) for x in batch.column("content").to_pylist()]) if batch.num_rows else [[]] * 7
        columns = [batch.column("path"), *(list(x) for x in read)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
