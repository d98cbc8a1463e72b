"""Decomposition providers: functions from a text span to typed child spans, and the work queue that applies them.

A provider is ``(name, media types, function)``; the function gets bytes and yields (kind, start, end, media type).
Each provider sees each span once.  Built in are XML events, HTML elements, Python syntax trees, text segments and
chess game records.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import segments
from tesserae.operators.closure import checkpointed


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    media: str | None = None  # of the content, if another provider may take it


Provider = Callable[[bytes], Iterator[Span]]


def xml_events(data: bytes) -> Iterator[Span]:
    """Structural events with byte offsets; entities stay as they are spelled.  Malformed XML is an error."""
    out: list[tuple[str, int]] = []
    parser = expat.ParserCreate()
    note = lambda kind: lambda *_: out.append((kind, parser.CurrentByteIndex))
    parser.StartElementHandler, parser.EndElementHandler = note("start"), note("end")
    parser.CharacterDataHandler, parser.CommentHandler, parser.ProcessingInstructionHandler = note("text"), note("comment"), note("instruction")
    parser.StartCdataSectionHandler, parser.XmlDeclHandler = note("cdata"), note("declaration")
    parser.Parse(data, True)
    ends = [at for _, at in out[1:]] + [len(data)]
    for (kind, at), end in zip(out, ends, strict=True):
        yield Span(kind, at, end)


class _Elements(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[str, int]] = []
        self.lines = [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(text)
        self.close()

    def _note(self, kind: str) -> None:
        line, column = self.getpos()
        self.found.append((kind, self.lines[line - 1] + column))

    def handle_starttag(self, tag, attrs):
        self._note(f"<{tag}>")

    def handle_endtag(self, tag):
        self._note(f"</{tag}>")

    def handle_data(self, data):
        self._note("text")

    def handle_comment(self, data):
        self._note("comment")


def html_elements(data: bytes) -> Iterator[Span]:
    """Tags, texts and comments with character offsets as in the decoded text."""
    text = data.decode("utf-8", "replace")
    found = _Elements(text).found
    for (kind, at), end in zip(found, [x for _, x in found[1:]] + [len(text)], strict=True):
        yield Span(kind, at, end, "text/plain" if kind == "text" else None)


def python_syntax(data: bytes) -> Iterator[Span]:
    """Nodes of a Python syntax tree with byte offsets."""
    starts = [0]
    for line in data.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    for node in ast.walk(ast.parse(data)):
        if hasattr(node, "end_col_offset"):
            yield Span(type(node).__name__, starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset)


def text_segments(data: bytes) -> Iterator[Span]:
    """Words and sentences with byte offsets; each kind tiles the text."""
    text = data.decode("utf-8")
    for kind, found in (("sentence", segments.sentences), ("word", segments.words)):
        at = 0
        for part in found(text):
            size = len(part.encode())
            yield Span(kind, at, at + size)
            at += size


class GameError(ValueError):
    """A game record is truncated or misplaced."""


_GAME_TOKEN = re.compile(r"""\s+|;[^\n]*|^%[^\n]*|\{[^}]*\}|\[\s*\w+\s+"(?:[^"\\]|\\.)*"\s*\]|\(|\)|\$\d+|1-0|0-1|1/2-1/2|\*|\d+\.(?:\.\.)?|[A-Za-z][A-Za-z0-9+#=\-]*[!?]*""", re.M)
_GAME_KINDS = (("[", "tag"), ("{", "comment"), (";", "comment"), ("%", "escape"), ("(", "variation"), (")", "variation_end"), ("$", "glyph"))


def game_record(data: bytes) -> Iterator[Span]:
    """Tags, moves, comments, variations and results of chess games in PGN."""
    text = data.decode("utf-8")
    at, depth, offset = 0, 0, 0
    while at < len(text):
        m = _GAME_TOKEN.match(text, at)
        if not m:
            raise GameError(f"truncated or trailing text at {at}")
        token, size = m[0], len(m[0].encode())
        at = m.end()
        if not token.isspace():
            kind = next((k for p, k in _GAME_KINDS if token.startswith(p)), "result" if token in ("1-0", "0-1", "1/2-1/2", "*") else "number" if token[0].isdigit() else "move")
            depth += (kind == "variation") - (kind == "variation_end")
            if depth < 0:
                raise GameError("a variation ends that never began")
            yield Span(kind, offset, offset + size)
        offset += size
    if depth:
        raise GameError("a variation doesn't end")


#: name -> (media types it takes, function)
PROVIDERS: dict[str, tuple[frozenset[str], Provider]] = {
    "xml": (frozenset({"text/xml"}), xml_events),
    "html": (frozenset({"text/html"}), html_elements),
    "python": (frozenset({"text/x-python"}), python_syntax),
    "text": (frozenset({"text/plain"}), text_segments),
    "pgn": (frozenset({"application/x-chess-pgn"}), game_record),
}

_SPANS = "artifact string, provider string, parent bigint, kind string, start bigint, end bigint, media string, content binary"

#: Bytes of content whose spans a worker holds at once; a content of more is taken alone.
HELD = 500_000


def _apply(spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("artifact", pa.string()), ("provider", pa.string()), ("parent", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("media", pa.string()), ("content", pa.binary())])
        for batch in batches:
            columns, held = [[] for _ in schema], 0
            for at in range(batch.num_rows):  # row by row, so that a batch's contents never are Python objects all at once
                artifact, media, start, content = (batch.column(c)[at].as_py() for c in ("artifact", "media", "start", "content"))
                for name, (takes, provide) in PROVIDERS.items():
                    if media in takes:
                        text = (content or b"").decode("utf-8", "replace")
                        for s in provide(content or b""):
                            part = text[s.start : s.end].encode() if s.media else None
                            for column, value in zip(columns, (artifact, name, start, s.kind, s.start, s.end, s.media, part), strict=True):
                                column.append(value)
                held += len(content or b"")
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                    columns, held = [[] for _ in schema], 0
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spans.select("artifact", "media", "start", "content").mapInArrow(run, _SPANS)


def decompose(roots: DataFrame, rounds: int = 8) -> DataFrame:
    """Applies all providers to (artifact, media, content) and again to what they expose, until nothing new comes up."""
    open_ = roots.select("artifact", "media", F.lit(0).cast("bigint").alias("start"), "content")
    done = None
    for _ in range(rounds):
        found = checkpointed(_apply(open_))
        done = found if done is None else done.unionByName(found)
        open_ = found.filter("media is not null").select("artifact", "media", "start", "content")
        if open_.isEmpty():
            return done.drop("content", "media")
    raise RuntimeError("decomposition didn't end")


def inherited(groups: DataFrame, children: DataFrame, group: str, columns: list[str], code: str) -> DataFrame:
    """Children's attributes, a missing one taken from the group, ``#`` standing for the child's code in hex."""
    g = groups.select(F.col(group).alias("_g"), *[F.col(c).alias(f"_g_{c}") for c in columns])
    joined = children.join(g, F.col(group) == F.col("_g"), "left")
    return joined.select(code, group, *[F.replace(F.coalesce(c, f"_g_{c}"), F.lit("#"), F.lpad(F.hex(code), 4, "0")).alias(c) for c in columns])
