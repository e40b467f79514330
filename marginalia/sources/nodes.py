"""Markup as a node table: one row for each element, text, comment and instruction.

(doc_id, pre, post, depth, parent, path, tag, attrs, text, line, col, names): ``pre`` and
``post`` number nodes as they open and close, so that d is below a exactly if
``a.pre < d.pre and d.post < a.post``; ``path`` lists the numbers of the elements
around a node, outermost first, and ``names`` their tags. Text has the tag ``#text``. Name spaces
are dropped, attribute values squeezed and adjacent texts merged. A document
that does not parse gives one ``#error`` row with its message and position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "doc_id string, pre int, post int, depth int, parent int, path array<int>, tag string, attrs map<string,string>, text string, line int, col int, names array<string>"
_KINDS = pa.schema([("doc_id", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()), ("path", pa.list_(pa.int32())), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("names", pa.list_(pa.string()))])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


#: Rows that a Python worker holds before it hands them on, and characters of a document that it parses at a time.
HELD_ROWS, HELD_CHARS = 2_000, 1 << 18


class Builder:
    """Rows of one document from parser events."""

    def __init__(self, doc_id: str, position: Callable[[], tuple[int, int]]):
        self.doc_id, self.position = doc_id, position
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.path: list[int] = []
        self.names: list[str] = []
        self.clock = self.count = 0

    def node(self, tag: str, attrs: dict[str, str] | None = None, text: str | None = None) -> dict:
        line, col = self.position()
        self.count += 1
        row = {"doc_id": self.doc_id, "pre": self.count, "post": 0, "depth": len(self.open), "parent": self.path[-1] if self.path else None, "path": self.path, "tag": tag, "attrs": attrs or {}, "text": text, "line": line, "col": col, "names": self.names}
        self.rows.append(row)
        return row

    def settled(self) -> list[dict]:
        """Take the rows that no later event changes: those of open elements stay, and the last one, whose text may go on."""
        last = self.rows[-1:]
        out = [r for r in self.rows[:-1] if r["post"]]
        self.rows = [r for r in self.rows[:-1] if not r["post"]] + last
        return out

    def begin(self, tag: str, attrs: dict[str, str | None]) -> None:
        row = self.node(tag.rsplit(":", 1)[-1], {k.rsplit(":", 1)[-1]: " ".join((v or "").split()) for k, v in attrs.items() if not k.startswith("xmlns")})
        self.open.append(row)
        # what stands in one element shares its lists
        self.path, self.names = [*self.path, row["pre"]], [*self.names, row["tag"]]

    def leaf(self, tag: str, text: str) -> None:
        last = self.rows[-1] if self.rows else None
        if tag == "#text" and last and last["tag"] == "#text" and last["post"] == self.clock and last["parent"] == (self.path[-1] if self.path else None):
            last["text"] += text
            return
        self.clock += 1
        self.node(tag, text=text)["post"] = self.clock

    def end(self) -> None:
        self.clock += 1
        row = self.open.pop()
        row["post"], self.path, self.names = self.clock, row["path"], row["names"]


def pieces(data: bytes | str) -> Iterator[bytes | str]:
    """A long document in parts that end with a tag, or anywhere if none ends for long."""
    at, close = 0, ">" if isinstance(data, str) else b">"
    while len(data) - at > HELD_CHARS:
        end = data.rfind(close, at, at + HELD_CHARS) + 1
        end = end if end > at else at + HELD_CHARS
        yield data[at:end]
        at = end
    yield data[at:]


def parse_xml(doc_id: str, data: bytes | str | None) -> Iterator[Sequence[dict]]:
    """The rows of a document in parts; one #error row if it does not parse anywhere."""
    data = data or ""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    b = Builder(doc_id, lambda: (parser.CurrentLineNumber, parser.CurrentColumnNumber))
    parser.StartElementHandler = b.begin
    parser.EndElementHandler = lambda tag: b.end()
    parser.CharacterDataHandler = lambda text: b.leaf("#text", text)
    parser.CommentHandler = lambda text: b.leaf("#comment", text)
    parser.ProcessingInstructionHandler = lambda target, text: b.leaf("#instruction", f"{target} {text}".strip())
    long = len(data) > HELD_CHARS
    try:
        if long:  # its first rows leave before its end is read, so that it is tried without rows before
            expat.ParserCreate().Parse(data, True)
        else:
            parser.Parse(data, True)
    except expat.ExpatError as e:
        yield [{"doc_id": doc_id, "pre": 1, "post": 1, "depth": 0, "parent": None, "path": [], "tag": "#error", "attrs": {}, "text": expat.ErrorString(e.code), "line": e.lineno, "col": e.offset, "names": []}]
        return
    if long:
        for piece in pieces(data):
            parser.Parse(piece, False)
            yield b.settled()
        parser.Parse(data[:0], True)
    yield b.rows


class _Html(HTMLParser):
    """Tolerant: an end tag closes up to its element, or nothing."""

    def __init__(self, doc_id: str):
        super().__init__(convert_charrefs=True)
        self.b = Builder(doc_id, self.getpos)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.b.begin(tag, dict(attrs))
        if tag in _VOID:
            self.b.end()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.b.begin(tag, dict(attrs))
        self.b.end()

    def handle_endtag(self, tag: str) -> None:
        if any(x["tag"] == tag for x in self.b.open):
            while self.b.open[-1]["tag"] != tag:
                self.b.end()
            self.b.end()

    def handle_data(self, data: str) -> None:
        self.b.leaf("#text", data)

    def handle_comment(self, data: str) -> None:
        self.b.leaf("#comment", data)


def parse_html(doc_id: str, data: bytes | str | None) -> Iterator[Sequence[dict]]:
    parser = _Html(doc_id)
    parser.feed(data.decode("utf-8", "replace") if isinstance(data, bytes) else data or "")
    parser.close()
    while parser.b.open:
        parser.b.end()
    yield parser.b.rows


def _nodes(df: DataFrame, id_col: str, data_col: str, parse: Callable[[str, bytes | str | None], Iterator[Sequence[dict]]], tags: Sequence[str] | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            # one text at a time becomes a Python object
            for doc_id, data in zip(batch.column(0), batch.column(1), strict=True):
                for part in parse(doc_id.as_py(), data.as_py()):
                    for row in part if tags is None else (r for r in part if r["tag"] in tags):
                        rows.append(row)
                        if len(rows) >= HELD_ROWS:
                            yield packed(rows)
                            rows = []
            if rows:
                yield packed(rows)
            batch = doc_id = data = None  # freed before the next one is read

    def packed(rows: list[dict]) -> pa.RecordBatch:
        column = lambda f: [list(r["attrs"].items()) for r in rows] if f.name == "attrs" else [r[f.name] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(column(f), f.type) for f in _KINDS], schema=_KINDS)

    return df.select(F.col(id_col).cast("string"), F.col(data_col)).mapInArrow(run, NODES)


def xml_nodes(df: DataFrame, id_col: str, data_col: str, tags: Sequence[str] | None = None) -> DataFrame:
    """The node table of well-formed documents; an ``#error`` row for each other one. Only rows with one of the ``tags`` leave the parser, if these are given."""
    return _nodes(df, id_col, data_col, parse_xml, tags)


def html_nodes(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """The node table of web pages, well-formed or not."""
    return _nodes(df, id_col, data_col, parse_html)


def parse_failures(df: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(doc_id, line, col, message) of documents that do not parse."""
    return xml_nodes(df, id_col, data_col).where("tag = '#error'").select("doc_id", "line", "col", F.col("text").alias("message"))
