"""Markdown notes to source-located passages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as in ``constants.SPACE_CLASS``: Python's own differs.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{SPACES}]"
ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
ITEM = re.compile(rf"({S}*)(?:[-*+] |[0-9]+[.)] )(.*)$")
CALLOUT = re.compile(rf"{S}*>{S}*\[![^\]]+\]")
QUOTE = re.compile(rf"{S}*>")
CELL = re.compile(rf"{S}*:?-{{3,}}:?{S}*")
ANCHOR = re.compile(r"(?:^|\s)\^([A-Za-z0-9-]+)\s*$")
ALONE = re.compile(r"\^([A-Za-z0-9-]+)\s*")
ANY_FENCE = re.compile(rf"{S}*(`{{3,}}|~{{3,}})")
SCHEMA = "id string, path string, line_start int, line_end int, text string, search_text string, render_text string, kind string, heading_path array<string>, parent_id string, section_id string"
OUTLINE = "id string, path string, line_start int, line_end int, own_after int, kind string, heading_path array<string>, parent_id string, section_id string"
#: Characters of texts that a task builds before it hands them on.
CHUNK = 4_000_000


@dataclass(frozen=True)
class Passage:
    id: str
    path: str
    line_start: int
    line_end: int
    text: str
    kind: str
    heading_path: tuple[str, ...] = ()
    section_id: str = ""
    parent_id: str | None = None
    render_text: str | None = None

def _blank(line: str) -> bool:
    return not line.strip(SPACES)


def _indent(space: str) -> int:
    return sum(4 if c == "\t" else 1 for c in space)


def _closes(line: str, opener: str, anywhere: bool) -> bool:
    m = re.fullmatch(rf"{S + '*' if anywhere else ' {0,3}'}({re.escape(opener[0])}+)[ \t]*", line)
    return bool(m) and len(m[1]) >= len(opener)


def _pipe(line: str) -> bool:
    return "|" in re.sub(r"\\.", "", line, flags=re.S)


def _delimiter(line: str) -> bool:
    cells = line.strip(SPACES).removeprefix("|").removesuffix("|").split("|")
    return len(cells) > 1 and all(CELL.fullmatch(c) for c in cells)


@dataclass(frozen=True)
class Unit:
    """A passage as an interval of its note's lines: ``first`` counts from 0, ``after`` is one
    past the last. Nested items are nested intervals, so a note's units are as small as its
    lines; their texts are cut from the lines when asked."""

    first: int
    after: int
    kind: str
    heading_path: tuple[str, ...]
    section: str
    parent: Unit | None = None


class _Note:
    """One pass over the lines; each ``_try`` method says where the element that starts at
    a line ends, or None. They are tried in order of precedence."""

    def __init__(self, path: str, source: str):
        self.path, self.lines = path, re.sub(r"\r\n?", "\n", source).split("\n")
        self.out: list[Unit] = []
        self.titles: dict[int, str] = {}
        self.headings: list[tuple[int, int, str]] = []  # line from 1, level, title
        self.section = f"{path}:0"

    def emit(self, first: int, after: int, kind: str, parent: Unit | None = None) -> Unit | None:
        if all(_blank(self.lines[k]) for k in range(first, after)):
            return None
        path = tuple(t for _, t in sorted(self.titles.items()) if t)
        unit = Unit(first, after, kind, path, self.section, parent)
        self.out.append(unit)
        return unit

    def id_of(self, u: Unit | None) -> str | None:
        return f"{self.path}:{u.first + 1}-{u.after}" if u else None

    def text(self, u: Unit) -> str:
        return "\n".join(self.lines[u.first : u.after])

    def shown(self, u: Unit) -> str | None:
        """Of a list item, its text below the first lines of the items that it is in."""
        if u.kind != "list":
            return None
        above, p = [], u.parent
        while p:
            above.append(self.lines[p.first])
            p = p.parent
        return "\n".join([*above[::-1], *self.lines[u.first : u.after]])

    def passage(self, u: Unit) -> Passage:
        return Passage(self.id_of(u), self.path, u.first + 1, u.after, self.text(u), u.kind, u.heading_path, u.section, self.id_of(u.parent), self.shown(u))

    def _heading(self, level: int, title: str, line: int) -> None:
        self.titles = {k: v for k, v in self.titles.items() if k < level} | {level: title.strip(SPACES)}
        self.headings.append((line + 1, level, title.strip(SPACES)))
        self.section = f"{self.path}:{line + 1}"

    def _try_front_matter(self, k: int) -> int | None:
        if k or self.lines[0] != "---":
            return None
        return next((i + 1 for i, line in enumerate(self.lines) if i and line in ("---", "...")), None)

    def _try_atx(self, k: int) -> int | None:
        m = ATX.match(self.lines[k])
        if m:
            self._heading(len(m[1]), re.sub(r"[ \t]+#+[ \t]*$", "", m[2]), k)
            return k + 1
        return None

    def _try_setext(self, k: int) -> int | None:
        m = UNDERLINE.match(self.lines[k + 1]) if k + 1 < len(self.lines) else None
        if m:
            self._heading(1 if m[1][0] == "=" else 2, self.lines[k], k)
            return k + 2
        return None

    def _try_fence(self, k: int) -> int | None:
        m = FENCE.match(self.lines[k])
        if not m:
            return None
        end = next((i + 1 for i in range(k + 1, len(self.lines)) if _closes(self.lines[i], m[1], False)), len(self.lines))
        self.emit(k, end, "fence")
        return end

    def _quoted(self, k: int, kind: str) -> int:
        """To the last quoted line; blank lines between quoted ones belong to it."""
        end = i = k + 1
        while i < len(self.lines) and (_blank(self.lines[i]) or QUOTE.match(self.lines[i])):
            i += 1
            if not _blank(self.lines[i - 1]):
                end = i
        self.emit(k, end, kind)
        return end

    def _try_callout(self, k: int) -> int | None:
        return self._quoted(k, "callout") if CALLOUT.match(self.lines[k]) else None

    def _try_table(self, k: int) -> int | None:
        lines = self.lines
        if not (k + 1 < len(lines) and _pipe(lines[k]) and _delimiter(lines[k + 1])):
            return None
        end = next((i for i in range(k + 2, len(lines)) if _blank(lines[i]) or not _pipe(lines[i])), len(lines))
        self.emit(k, end, "table")
        return end

    def _try_list(self, k: int) -> int | None:
        first = ITEM.match(self.lines[k])
        if not first:
            return None
        root, end, i = _indent(first[1]), k + 1, k + 1
        while i < len(self.lines):
            line = self.lines[i]
            item = ITEM.match(line)
            depth = _indent(re.match(rf"{S}*", line)[0])
            if not (_blank(line) or (_indent(item[1]) >= root if item else depth > root)):
                break
            i += 1
            if not _blank(line):
                end = i
        self._items(k, end)
        return end

    def _items(self, first: int, after: int) -> None:
        """A passage for each item with all below it; items in fences are no items."""
        items: list[tuple[int, int]] = []
        fence: str | None = None
        for i in range(first, after):
            if fence:
                fence = None if _closes(self.lines[i], fence, True) else fence
                continue
            m = ITEM.match(self.lines[i])
            if m:
                items.append((i, _indent(m[1])))
            opened = ANY_FENCE.match(m[2] if m else self.lines[i])
            fence = opened[1] if opened else None
        ends, waiting = [after] * len(items), []  # an item ends where the next that isn't below it starts
        for n, (at, depth) in enumerate(items):
            while waiting and items[waiting[-1]][1] >= depth:
                ends[waiting.pop()] = at
            waiting.append(n)
        open_items: list[tuple[int, Unit | None]] = []
        for (at, depth), end in zip(items, ends, strict=True):
            while end > at + 1 and _blank(self.lines[end - 1]):
                end -= 1
            while open_items and open_items[-1][0] >= depth:
                open_items.pop()
            open_items.append((depth, self.emit(at, end, "list", open_items[-1][1] if open_items else None)))

    def _try_quote(self, k: int) -> int | None:
        return self._quoted(k, "blockquote") if QUOTE.match(self.lines[k]) else None

    ORDER = (_try_front_matter, _try_atx, _try_setext, _try_fence, _try_callout, _try_table, _try_list, _try_quote)

    def read(self) -> list[Unit]:
        k, paragraph = 0, None
        starts = (ATX, FENCE, ITEM, QUOTE)
        while k < len(self.lines):
            line = self.lines[k]
            special = not _blank(line) and (
                k == 0 and line == "---" or any(p.match(line) for p in starts) or "|" in line or k + 1 < len(self.lines) and UNDERLINE.match(self.lines[k + 1])
            )
            if _blank(line) or special:
                before, end = (paragraph, k), None
                if special:
                    held = self.out, self.titles, self.section
                    self.out = []
                    end = next((e for t in self.ORDER if (e := t(self, k)) is not None), None)
                    made, self.out = self.out, held[0]
                    if end is not None and before[0] is not None:
                        now = self.titles, self.section
                        self.titles, self.section = held[1:]
                        self.emit(before[0], k, "paragraph")
                        self.titles, self.section = now
                    self.out += made
                elif paragraph is not None:
                    self.emit(paragraph, k, "paragraph")
                if _blank(line) or end is not None:
                    paragraph, k = None, end if end is not None else k + 1
                    continue
            paragraph = k if paragraph is None else paragraph
            k += 1
        if paragraph is not None:
            self.emit(paragraph, len(self.lines), "paragraph")
        return self.out


def parse_markdown(path: str, source: str) -> list[Passage]:
    """The passages of one note with their texts; nested items repeat what is in them."""
    note = _Note(path, source)
    return [note.passage(u) for u in note.read()]


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of any number of notes in frames of some ``CHUNK`` characters, so that nested texts
    never stand side by side and a small note costs no frame of its own."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > CHUNK:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    yield pd.DataFrame(held, columns=columns)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def outline_notes(notes: DataFrame) -> DataFrame:
    """All passages of notes (path, text) as intervals, without texts: as large as the notes'
    lines however deep their lists. ``own_after`` is the line before which what is an item's
    own ends (its first child, or its end); ``cut_texts`` gives the texts of those that are wanted."""

    def run(frames):
        for f in frames:
            for path, text in zip(f.path, f.text, strict=True):
                note = _Note(path, text or "")
                units = note.read()
                child = {id(u.parent): u.first for u in reversed(units) if u.parent}
                yield from ((note.id_of(u), path, u.first + 1, u.after, child.get(id(u), u.after), u.kind, list(u.heading_path), note.id_of(u.parent), u.section) for u in units)

    return notes.select("path", "text").mapInPandas(lambda frames: _frames(run(frames), _columns(OUTLINE)), OUTLINE)


def parse_notes(notes: DataFrame) -> DataFrame:
    """All passages of notes (path, text) with their texts, some megabytes at a time."""

    def run(frames):
        for f in frames:
            for path, text in zip(f.path, f.text, strict=True):
                note = _Note(path, text or "")
                made = map(note.passage, note.read())
                yield from ((p.id, p.path, p.line_start, p.line_end, p.text, p.text, p.render_text, p.kind, list(p.heading_path), p.parent_id, p.section_id) for p in made)

    return notes.select("path", "text").mapInPandas(lambda frames: _frames(run(frames), _columns(SCHEMA)), SCHEMA)


def cut_texts(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, text, render_text of the wanted passages (path, id), cut from their notes
    (path, text). A path or an id that there isn't gives no row; a repeated one gives one."""
    asked = wanted.groupBy("path").agg(F.collect_set("id").alias("ids"))

    def run(frames):
        for f in frames:
            for path, text, ids in zip(f.path, f.text, f.ids, strict=True):
                note, asked_for = _Note(path, text or ""), set(ids)
                yield from ((note.id_of(u), note.text(u), note.shown(u)) for u in note.read() if note.id_of(u) in asked_for)

    schema = "id string, text string, render_text string"
    return notes.select("path", "text").join(asked, "path").mapInPandas(lambda frames: _frames(run(frames), _columns(schema)), schema)


def _places(note: _Note, units: list[Unit]) -> Iterator[tuple[str, int, int]]:
    """What a link's fragment can point to, with its lines: headings with all below them, and
    block ids as ``^name``. A section ends where the next of its level or a higher one begins."""
    ends, waiting = [len(note.lines)] * len(note.headings), []
    for k, (line, level, _) in enumerate(note.headings):
        while waiting and note.headings[waiting[-1]][1] >= level:
            ends[waiting.pop()] = line - 1
        waiting.append(k)
    for (line, _, title), end in zip(note.headings, ends, strict=True):
        yield title, line, end
    before: Unit | None = None
    for u in units:
        alone = u.kind == "paragraph" and u.after == u.first + 1 and ALONE.fullmatch(note.lines[u.first])
        if alone and before:  # an id on a line of its own is that of what is above
            yield f"^{alone[1]}", before.first + 1, before.after
        else:
            before = u
            for k in range(u.first, u.first + 1 if u.kind == "list" else u.after):
                if m := ANCHOR.search(note.lines[k]):
                    yield f"^{m[1]}", u.first + 1, u.after


def note_places(notes: DataFrame) -> DataFrame:
    """path, fragment, line_start, line_end of every heading and block id of notes (path,
    text); the first of several equal ones counts."""

    def run(frames):
        for f in frames:
            for path, text in zip(f.path, f.text, strict=True):
                note = _Note(path, text or "")
                first: dict[str, tuple] = {}
                for fragment, start, end in _places(note, note.read()):
                    first.setdefault(fragment, (path, fragment, start, end))
                yield from first.values()

    schema = "path string, fragment string, line_start int, line_end int"
    return notes.select("path", "text").mapInPandas(lambda frames: _frames(run(frames), _columns(schema)), schema)
