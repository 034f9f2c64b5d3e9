"""Files: discovery, format dispatch and the chunkers that need a parser (CSV, XML, DOCX, PDF), run on the executors."""

from __future__ import annotations

import csv
import io
import os
import re
import subprocess
import sys
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import SPACE
from tidewell.operators import chunking
from tidewell.operators.chunking import MAX_CHUNK
from tidewell.sources.shared import stored

Chunk = tuple[str, str]  # section, text
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Extension -> format.
FORMATS = {".md": "markdown", ".markdown": "markdown", ".pdf": "pages", ".xml": "xml", ".csv": "csv", ".tsv": "csv", ".docx": "docx"}


def format_of(path: str, formats: dict[str, str] = FORMATS) -> str | None:
    return formats.get(os.path.splitext(path)[1].lower())


def with_format(files: DataFrame, formats: dict[str, str] = FORMATS) -> DataFrame:
    """Adds ext and format (null if none) to a DataFrame with path."""
    table = F.create_map(*[F.lit(x) for kv in formats.items() for x in kv])
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    return files.withColumn("ext", ext).withColumn("format", table[ext])


#: Folder entries that a task sends on at once.
_LISTED = 10_000
_LISTING = "path string, folder boolean, mtime long, error string"


def _entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(path, is a folder, mtime) of what a folder holds: of a local or mounted one, or of any store that Arrow opens (a URI). Links to
    files count as files; links to folders are left out, so that a walk ends."""
    if "://" in folder:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        prefix = folder.removesuffix(inner)
        for info in store.get_file_info(fs.FileSelector(inner)):
            yield prefix + info.path, info.type == fs.FileType.Directory, int(info.mtime_ns // 10**9) if info.mtime_ns else 0
        return
    with os.scandir(folder) as found:
        for e in found:
            if e.is_dir():
                if not e.is_symlink():
                    yield e.path, True, 0
            else:
                yield e.path, False, int(e.stat().st_mtime)


def _listed(folders: DataFrame, formats: dict[str, str]) -> DataFrame:
    """One step of the walk: the folders and files of a format directly below the given folders, listed on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for folder in batch["path"]:
                try:
                    for path, inner, mtime in _entries(folder):
                        if not os.path.basename(path).startswith(".") if inner else format_of(path, formats):
                            rows.append((path, inner, mtime, None))
                        if len(rows) >= _LISTED:
                            yield pd.DataFrame(rows, columns=["path", "folder", "mtime", "error"])
                            rows = []
                except OSError as e:
                    rows.append((folder, True, 0, str(e)))
        yield pd.DataFrame(rows, columns=["path", "folder", "mtime", "error"])

    return folders.select("path").mapInPandas(run, _LISTING)


def _stat(path: str) -> tuple[bool, int]:
    """(is a folder, mtime) of a root; OSError if there is none."""
    if "://" in path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return info.type == fs.FileType.Directory, int(info.mtime_ns // 10**9) if info.mtime_ns else 0
    found = os.stat(path)
    return os.path.isdir(path), int(found.st_mtime)


def clean(path: str) -> str:
    """A path without . and .. and repeated slashes; URIs only lose slashes at their end."""
    return path.rstrip("/") if "://" in path else os.path.normpath(path)


def discover(spark: SparkSession, roots: list[str], formats: dict[str, str] = FORMATS) -> DataFrame:
    """path, mtime of the files under the roots that have a format: hidden directories are skipped (hidden files are not),
    paths are cleaned and distinct. A root or folder that cannot be read is an error.

    A walk by levels: each round lists the folders of the last one on the executors, so the driver sees the roots and the number of
    folders a level only. Roots are local or mounted folders, or URIs of a store that Arrow opens.
    """
    files, folders = [], []
    for root in dict.fromkeys(map(clean, roots)):
        inner, mtime = _stat(root)
        name = os.path.basename(root)
        if not inner and format_of(root, formats):
            files.append((root, mtime))
        elif inner and (root == "." or not name.startswith(".")):
            folders.append((root,))
    found = spark.createDataFrame(files, "path string, mtime long")
    level, open_ = spark.createDataFrame(folders, "path string"), len(folders)
    while open_:
        # far more folders than cores are dealt out again each round, as one of them may hold most of the next
        level = level.repartition(min(open_, 4 * spark.sparkContext.defaultParallelism))
        step = stored(_listed(level, formats))
        failed = step.filter("error is not null").first()
        if failed:
            raise OSError(failed["error"])
        found = found.unionByName(step.filter("not folder").select("path", "mtime"))
        level = step.filter("folder").select("path")
        open_ = level.count()
    # roots may lie inside each other
    return found.groupBy("path").agg(F.max("mtime").alias("mtime"))


def hard_split(p: str) -> list[str]:
    return [p[i : i + MAX_CHUNK].strip(_SPACE) for i in range(0, len(p), MAX_CHUNK)]


def pack(text: str) -> list[str]:
    """The packing of operators.chunking.pack_paragraphs for the parsers that run in Python."""
    out: list[str] = []
    current: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if current:
            out.append("\n\n".join(current))
        current.clear()
        size = 0

    for p in (p.strip(_SPACE) for p in re.split(r"\n[\t\n\f\r ]*\n", text)):
        n = len(p.encode())
        if n > MAX_CHUNK:
            flush()
            out += hard_split(p)
        elif n:
            if current and size + 2 + n > MAX_CHUNK:
                flush()
            size += n + 2 * bool(current)
            current.append(p)
    flush()
    return out


def sniff_delimiter(head: str, ext: str) -> str:
    """The most frequent of , ; and tab in the first line (ties in that order); without any, that of the extension."""
    line = head.encode()[:4096].decode("utf-8", "ignore").split("\n", 1)[0]
    counts = {d: line.count(d) for d in (",", ";", "\t")}
    best = max(counts, key=counts.get)
    return best if counts[best] else ("\t" if ext.lower() == ".tsv" else ",")


def chunk_csv(content: bytes, ext: str) -> list[Chunk]:
    """Rows as `header: value` lines, packed to MAX_CHUNK characters; sections name the records, the header being 1."""
    csv.field_size_limit(sys.maxsize)  # a field may be of any length
    text = content.decode("utf-8", "replace")
    records = [r for r in csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text, ext)) if r]
    if not records:
        return []
    header, chunks = records[0], []
    held: list[tuple[int, str]] = []

    def flush(last: int) -> None:
        if held:
            first = held[0][0]
            section = f"rows {first}-{last}" if last > first else f"row {first}"
            chunks.extend((section, part) for part in pack("\n\n".join(row for _, row in held)))
            held.clear()

    line = 1
    for line, record in enumerate(records[1:], 2):  # noqa: B007
        named = ((header[i].strip(_SPACE) if i < len(header) else "") or f"col {i + 1}" for i in range(len(record)))
        row = "\n".join(f"{k}: {v.strip(_SPACE)}" for k, v in zip(named, record, strict=True) if v.strip(_SPACE))
        if not row:
            continue
        if held and sum(len(r) + 2 for _, r in held) + len(row) + 2 > MAX_CHUNK:
            flush(line - 1)
        held.append((line, row))
    flush(line)
    return chunks


class _Node:
    """An element. size is that of lines() joined, added up from the leaves, so that no subtree is rendered only to be measured."""

    def __init__(self, name: str, attributes: list[tuple[str, str]]):
        self.name, self.attributes, self.children, self.size = name, attributes, [], 0
        self.parts: list[str] = []

    def own(self, prefix: str = "", name: str = "") -> list[str]:
        """The node's attributes and text as lines."""
        text = "".join(self.parts).strip(_SPACE)
        return [f"{prefix}{k}: {v}" for k, v in self.attributes] + ([f"{name}: {text}" if name else text] if text else [])

    def lines(self) -> list[str]:
        out, todo = self.own(), self.children[::-1]
        while todo:
            node = todo.pop()
            out += node.own(node.name + " ", node.name)
            todo += node.children[::-1]
        return out

    def measure(self) -> None:
        """Sets size of the node and all below, each from its children; within: of the lines below an element, each with its break."""
        order, todo = [], [self]
        while todo:
            order.append(node := todo.pop())
            todo += node.children
        within: dict[int, int] = {}
        for node in reversed(order):
            below = sum(within.pop(id(c)) for c in node.children)
            node.size = max(sum(len(x) + 1 for x in node.own()) + below - 1, 0)
            within[id(node)] = sum(len(x) + 1 for x in node.own(node.name + " ", node.name)) + below


_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<![^>]*>|</(?P<end>[^\s>]*)[^>]*>|<(?P<start>[^\s/>!?]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)


def parse_xml(text: str) -> _Node:
    """A tolerant tree: an end tag closes the open element whatever its name; comments, instructions and directives go."""
    root = _Node("", [])
    open_nodes, at = [root], 0
    local = lambda name: name.rsplit(":", 1)[-1]
    for m in _MARKUP.finditer(text):
        open_nodes[-1].parts.append(unescape(text[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            open_nodes[-1].parts.append(m["cdata"])
        elif m["start"]:
            values = [(local(k), unescape(a or b or c)) for k, a, b, c in _ATTRIBUTE.findall(m["attrs"])]
            node = _Node(local(m["start"]), values)
            open_nodes[-1].children.append(node)
            if not m["empty"]:
                open_nodes.append(node)
        elif m["end"] is not None and len(open_nodes) > 1:
            open_nodes.pop()
    open_nodes[-1].parts.append(unescape(text[at:]))
    return root


def chunk_xml(content: bytes) -> list[Chunk]:
    """The largest subtrees of MAX_CHUNK characters at most; of larger ones the own lines, then the children."""
    chunks: list[Chunk] = []

    def emit(lines: list[str], section: str) -> None:
        text = "\n".join(lines)
        if text.strip(_SPACE):
            chunks.extend((section, part) for part in pack(text))

    root = parse_xml(content.decode("utf-8", "replace"))
    root.measure()
    todo = [(n, n.name) for n in root.children[::-1]]
    while todo:
        node, section = todo.pop()
        if not node.children or node.size <= MAX_CHUNK:
            emit(node.lines(), section)
        else:
            emit(node.own(), section)
            todo += [(c, f"{section} > {c.name}") for c in node.children[::-1]]
    return chunks


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def chunk_docx(content: bytes) -> list[Chunk]:
    """Paragraphs of the body under their Heading1 .. Heading6 trail; a file without a document part gives nothing."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" not in z.namelist():
            return []
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    chunks: list[Chunk] = []
    trail, held = [""] * 7, []

    def flush() -> None:
        text = "\n".join(held).strip(_SPACE)
        held.clear()
        if text:
            section = " > ".join(t for t in trail if t)
            chunks.extend((section, part) for part in pack(text))

    for p in body.findall(f"{_W}p") if body is not None else ():
        text = "".join(t.text or "" for r in p.findall(f"{_W}r") for t in r.findall(f"{_W}t"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.match("Heading([1-6])", style.get(f"{_W}val", "")) if style is not None else None
        if level:
            flush()
            n = int(level[1])
            trail[n:] = [text] + [""] * (6 - n)
        elif text:
            held.append(text)
    flush()
    return chunks


#: Fixed value: the extractor of the text layer of a PDF; it reads the file from its input and writes pages that end in form feeds.
PDF_COMMAND = ("pdftotext", "-enc", "UTF-8", "-", "-")


def pdf_text(content: bytes, command: tuple[str, ...] = PDF_COMMAND) -> str:
    """The pages of a PDF, separated by form feeds, from a program that every executor must have."""
    try:
        done = subprocess.run(command, input=content, capture_output=True, check=False)
    except FileNotFoundError as e:
        raise RuntimeError(f"{command[0]} not found: install Poppler on the executors") from e
    if done.returncode:
        raise RuntimeError(f"{command[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def extract_pages(files: DataFrame, command: tuple[str, ...] = PDF_COMMAND) -> DataFrame:
    """files: path, content (PDF) -> path, text (null if it fails), error (null, or why there is no text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                try:
                    rows.append((f.path, pdf_text(bytes(f.content), command), None))
                except Exception as e:  # noqa: BLE001 - one broken file must not end the run
                    rows.append((f.path, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


PARSERS: dict[str, Callable[[bytes, str], list[Chunk]]] = {"csv": chunk_csv, "xml": lambda b, _: chunk_xml(b), "docx": lambda b, _: chunk_docx(b)}

#: A markdown line longer than this fails its file.
MAX_LINE = 1 << 20
CHUNKS = "path string, section string, text string, ordinal int"


#: Files, and bytes of them, that a task turns into Python objects at once.
SLICE_ROWS = 64
SLICE_BYTES = 1 << 22


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, of SLICE_ROWS rows or about SLICE_BYTES: what parsers make of a part is freed before the next one."""
    for batch in batches:
        step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def chunk_parsed(files: DataFrame, parsers: dict[str, Callable[[bytes, str], list[Chunk]]] | None = None) -> DataFrame:
    """files: path, format, ext, content (binary) -> chunks plus error (null, or why the file gives none)."""
    table = PARSERS | (parsers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for part in slices(batches):
            rows = []
            for path, kind, ext, content in zip(*(part.column(c).to_pylist() for c in ("path", "format", "ext", "content")), strict=True):
                try:
                    rows += [(path, s, t, i, None) for i, (s, t) in enumerate(table[kind](bytes(content), ext))]
                except Exception as e:  # noqa: BLE001 - one broken file must not end the run
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "section", "text", "ordinal", "error"])

    return files.select("path", "format", "ext", "content").mapInArrow(run, CHUNKS + ", error string")


def _content(path: str) -> bytes:
    if "://" in path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def changed(files: DataFrame) -> DataFrame:
    """Of files (path, mtime), those whose time is another one by now, with that time; looked up on the executors. Files that are gone
    are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, mtime in zip(batch["path"], batch["mtime"], strict=True):
                try:
                    _, now = _stat(path)
                except OSError:
                    continue
                if now != mtime:
                    rows.append((path, now))
            yield pd.DataFrame(rows, columns=["path", "mtime"]).astype({"mtime": "int64"})

    return files.select("path", "mtime").mapInPandas(run, "path string, mtime long")


def sizes(files: DataFrame) -> DataFrame:
    """path, size (bytes; 0 if it cannot be told) of files (path), looked up on the executors."""

    def size(path: str) -> int:
        try:
            if "://" in path:
                from pyarrow import fs

                store, inner = fs.FileSystem.from_uri(path)
                return store.get_file_info(inner).size or 0
            return os.stat(path).st_size
        except OSError:
            return 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(size=[size(p) for p in batch["path"]])

    return files.select("path").mapInPandas(run, "path string, size long")


def read_files(paths: DataFrame) -> DataFrame:
    """path, .. -> also content: files are read on the executors, which see the same folders as the driver. A file that cannot
    be read has null content and an error."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content, error = [], []
            for p in batch["path"]:
                try:
                    content.append(_content(p))
                    error.append(None)
                except OSError as e:
                    content.append(None)
                    error.append(str(e))
            yield batch.assign(content=content, error=error)

    return paths.mapInPandas(run, ", ".join(columns) + ", content binary, error string")


def chunk_files(files: DataFrame, parsers: dict[str, Callable[[bytes, str], list[Chunk]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """files: path, content, and maybe error -> (chunks, failures). Broken files are listed and do not stop the others."""
    typed = with_format(files, FORMATS | {f".{k}": k for k in parsers or {}})
    if "error" not in typed.columns:
        typed = typed.withColumn("error", F.lit(None).cast("string"))
    text = F.decode("content", "UTF-8")
    long_line = F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) >= MAX_LINE)
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when((F.col("format") == "markdown") & long_line, F.lit("line too long"))
    typed = typed.withColumn("error", bad)
    good = typed.filter("error is null")
    is_pdf = (F.col("format") == "pages") & F.col("content").startswith(F.lit(b"%PDF"))
    plain = good.filter(~is_pdf).withColumn("text", text).select("path", "format", "text")
    pages = extract_pages(good.filter(is_pdf)).withColumns({"section": F.lit(None).cast("string"), "ordinal": F.lit(None).cast("int"), "pdf": F.lit(True)})
    parsed = chunk_parsed(good.filter(~F.col("format").isin("markdown", "pages")), parsers).withColumn("pdf", F.lit(False))
    # written, as chunks and failures both read it: each file is parsed once
    parsed = stored(parsed.unionByName(pages))
    pages, parsed = parsed.filter("pdf").select("path", "text", "error"), parsed.filter("not pdf").drop("pdf")
    chunks = (
        chunking.chunk_markdown(plain.filter("format = 'markdown'"))
        .unionByName(chunking.chunk_pages(plain.filter("format = 'pages'").select("path", "text").unionByName(pages.filter("error is null").drop("error"))))
        .unionByName(parsed.filter("error is null").drop("error"))
    )
    failures = typed.select("path", "error").unionByName(parsed.select("path", "error")).unionByName(pages.select("path", "error")).filter("error is not null")
    return chunks, failures


__all__ = ["FORMATS", "SPACE", "chunk_files", "discover", "read_files", "with_format"]
