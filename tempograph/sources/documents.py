"""Documents of files: Word files and plain texts as text with the places of their character runs.

Files come through Spark's `binaryFile` source, so from any store. A Word file is a zip of XML; its paragraphs are the lines of the
text, and each run of characters keeps its place, its paragraph, its size in points and whether it is bold. Sizes that a run
doesn't state are its style's, of that what it is based on, and at last the document's. A plain text is one run.

A file that can't be read (no zip, no document in it, broken XML, over MAX_XML bytes when unpacked) is a row with an error and
without a text. Of files, .docx is read as Word, all others as UTF-8, of which bytes that aren't are replaced.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one part of a Word file when unpacked, at most; files that a task holds at once.
MAX_XML, AT_ONCE = 256_000_000, 16
RUN = "struct<start:int,end:int,paragraph:int,size:double,bold:boolean,style:string>"
SCHEMA = f"path string, kind string, text string, runs array<{RUN}>, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The size of a text that states none, in points.
PLAIN_SIZE = 10.0


class Unreadable(Exception):
    """A file that is no document."""


def _part(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        info = archive.getinfo(name)
    except KeyError:
        return None
    if info.file_size > MAX_XML:
        raise Unreadable(f"{name} is over {MAX_XML} bytes")
    return ElementTree.fromstring(archive.read(info))


def _value(props: ElementTree.Element | None, name: str) -> str | None:
    found = props.find(_W + name) if props is not None else None
    return None if found is None else found.get(_W + "val", "")


def _look(props: ElementTree.Element | None) -> dict:
    """size and bold, as far as properties of a run state them."""
    size, bold, out = _value(props, "sz"), _value(props, "b"), {}
    if size and size.isdigit():
        out["size"] = int(size) / 2
    if bold is not None:
        out["bold"] = bold not in ("0", "false", "off")
    return out


class _Styles:
    def __init__(self, root: ElementTree.Element | None) -> None:
        self.own, self.above, self.default = {}, {}, {"size": PLAIN_SIZE, "bold": False}
        for style in root.iter(_W + "style") if root is not None else ():
            name = style.get(_W + "styleId", "")
            self.own[name] = _look(style.find(_W + "rPr"))
            self.above[name] = _value(style, "basedOn")
        base = root.find(f"{_W}docDefaults/{_W}rPrDefault/{_W}rPr") if root is not None else None
        self.default |= _look(base)

    def look(self, name: str | None) -> dict:
        chain, seen = [], set()
        while name and name in self.own and name not in seen:
            seen.add(name)
            chain.append(self.own[name])
            name = self.above[name]
        out = dict(self.default)
        for own in reversed(chain):
            out |= own
        return out


def read_word(data: bytes) -> tuple[str, list[tuple]]:
    """The text of a Word file, and its runs (start, end, paragraph, size, bold, style of the paragraph)."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            root, styles = _part(archive, "word/document.xml"), _Styles(_part(archive, "word/styles.xml"))
    except (zipfile.BadZipFile, ElementTree.ParseError, OSError, RuntimeError, NotImplementedError, EOFError) as e:
        raise Unreadable(f"{type(e).__name__}: {e}") from e
    if root is None:
        raise Unreadable("no word/document.xml")
    parts, runs, at = [], [], 0
    for number, paragraph in enumerate(root.iter(_W + "p")):
        if number:
            parts.append("\n")
            at += 1
        style = _value(paragraph.find(_W + "pPr"), "pStyle")
        look = styles.look(style)
        for run in paragraph.iter(_W + "r"):
            said = []
            for x in run:
                if x.tag == _W + "t":
                    said.append(x.text or "")
                elif x.tag in (_W + "tab", _W + "br", _W + "cr"):
                    said.append("\t" if x.tag == _W + "tab" else "\n")
            if text := "".join(said):
                own = look | styles.look(_value(run.find(_W + "rPr"), "rStyle")) if _value(run.find(_W + "rPr"), "rStyle") else look
                own = own | _look(run.find(_W + "rPr"))
                runs.append((at, at + len(text), number, own["size"], own["bold"], style))
                parts.append(text)
                at += len(text)
    return "".join(parts), runs


def read_plain(data: bytes) -> tuple[str, list[tuple]]:
    text = data.decode("utf-8", "replace").removeprefix("﻿")
    return text, [(0, len(text), 0, PLAIN_SIZE, False, None)] if text else []


def parsed(files: DataFrame) -> DataFrame:
    """path, kind (word or plain), text, runs, error of files (path, content)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], SCHEMA).schema)
    names = ["start", "end", "paragraph", "size", "bold", "style"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                rows = []
                for path, data in zip(*(batch.column(i).slice(lo, AT_ONCE).to_pylist() for i in range(2))):
                    kind = "word" if (path or "").lower().endswith(".docx") else "plain"
                    row = {"path": path, "kind": kind, "text": None, "runs": None, "error": None}
                    try:
                        text, runs = (read_word if kind == "word" else read_plain)(data or b"")
                        row |= {"text": text, "runs": [dict(zip(names, r)) for r in runs]}
                    except Unreadable as e:
                        row["error"] = str(e)
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_documents(spark: SparkSession, folder: str, suffixes: str = "{docx,txt,md}") -> DataFrame:
    """The documents under a folder, by suffix."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffixes}").option("recursiveFileLookup", "true").load(folder))


def heading_spans(text: Column, runs: Column, larger: float = 1.25, most: int = 20) -> Column:
    """start, end, label of a document's titles in order, from its own text and runs: nothing of a document leaves its row."""
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)

    def paragraphs(ordered: Column) -> Column:
        """start, end, size, style, label of what runs of one paragraph tell together."""
        begins = F.transform(ordered, lambda r, i: F.when((i == 0) | (F.get(ordered, i - 1)["paragraph"] != r["paragraph"]), i))

        def one(at: Column, first: Column, k: Column) -> Column:
            start, last = F.get(ordered, first)["start"], F.get(ordered, F.coalesce(F.get(at, k + 1), F.size(ordered)) - 1)
            label = F.trim(F.substr(text, start + 1, last["end"] - start))
            return F.struct(start.alias("start"), last["end"].alias("end"), last["size"].alias("size"), F.get(ordered, first)["style"].alias("style"), label.alias("label"))

        return F.filter(let(F.array_compact(begins), lambda at: F.transform(at, lambda first, k: one(at, first, k))), lambda p: p["label"] != "")

    def headings(found: Column) -> Column:
        sizes = F.sort_array(F.transform(found, lambda p: p["size"]))
        headed = lambda p: F.coalesce(F.lower(p["style"]).startswith("heading") | (F.lower(p["style"]) == "title"), F.lit(False))
        fits = lambda middle: F.filter(found, lambda p: (F.length(p["label"]) <= most) & (headed(p) | (p["size"] >= larger * middle)))
        return let(F.get(sizes, F.floor(F.size(found) / 2).cast("int")), fits)

    ordered = F.array_sort(F.transform(runs, lambda r: F.struct(r["paragraph"].alias("paragraph"), r["start"].alias("start"), r["end"].alias("end"), r["size"].alias("size"), r["style"].alias("style"))))
    found = let(let(ordered, paragraphs), headings)
    return F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["label"].alias("label")))


def titles(documents: DataFrame, larger: float = 1.25, most: int = 20) -> DataFrame:
    """path, start, end, label: short paragraphs in a heading's style, or larger than the document's middle paragraph by a quarter."""
    return documents.select("path", F.explode(heading_spans(F.col("text"), F.col("runs"), larger, most)).alias("t")).select("path", "t.*")


def write_word(lines: list[tuple[str, float | None, bool, str | None]]) -> bytes:
    """A Word file of paragraphs (text, size, bold, style); a line end in a text is a break in its paragraph."""
    from xml.sax.saxutils import escape

    body = []
    for text, size, bold, style in lines:
        props = (f'<w:sz w:val="{round(size * 2)}"/>' if size else "") + ("<w:b/>" if bold else "")
        named = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        said = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in text.split("\n"))
        body.append(f"<w:p>{named}<w:r><w:rPr>{props}</w:rPr>{said}</w:r></w:p>")
    space = _W.strip("{}")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{space}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()
