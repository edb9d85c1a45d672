"""PDF texts in plain Python: objects, compressed streams, page order, text operators, character maps.

Reads what the text layer says, line by line; no layout analysis and no decryption. A page whose text layer
is too thin is marked, so that its image can be read elsewhere.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.sources.readers import files, needs_ocr

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|(?=\d+\s+\d+\s+obj\b)|\Z)", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(
    rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]<>()]+|[-+]?(?:\d+\.?\d*|\.\d+)|\[|\]|[A-Za-z'\"*][A-Za-z0-9'\"*]*",
    re.S
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _objects(data: bytes) -> dict[int, bytes]:
    """Every object's body by number, those in object streams included; later ones replace earlier ones."""
    found = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (inside := _unpacked(body)) is not None:
            first = re.search(rb"/First\s+(\d+)", body)
            start = int(first[1]) if first else 0
            numbers = [int(x) for x in inside[:start].split()]
            places = numbers[1::2] + [len(inside) - start]
            for i, n in enumerate(numbers[0::2]):
                found.setdefault(n, inside[start + places[i] : start + places[i + 1]])
    return found


def _unpacked(body: bytes) -> bytes | None:
    """The bytes of an object's stream; None without one or if its packing is not known."""
    m = _STREAM.search(body)
    if not m:
        return None
    if b"/FlateDecode" not in body[: m.start()]:
        return None if b"/Filter" in body[: m.start()] else m[1]
    d = zlib.decompressobj()
    try:
        return d.decompress(m[1]) + d.flush()
    except zlib.error:
        return None


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """The page objects in reading order: the tree from its root; without a root, by number."""
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    top = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
    out, seen, todo = [], set(), [int(top[1])] if top else []
    while todo:
        n = todo.pop()
        body = objects.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            todo += [int(k) for k in reversed(_REFERENCE.findall(kids[1]))]
        elif body:
            out.append(body)
    return out or [b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]


def _dictionary(body: bytes, name: bytes, objects: dict[int, bytes]) -> bytes:
    """What follows a name: the object it refers to, or the dictionary that stands there."""
    m = re.search(rb"/" + name + rb"\b\s*(?:(\d+)\s+\d+\s+R|<<)", body)
    if not m:
        return b""
    if m[1]:
        return objects.get(int(m[1]), b"")
    depth, at = 1, m.end()
    while depth and at < len(body):
        pair = body[at : at + 2]
        depth += (pair == b"<<") - (pair == b">>")
        at += 2 if pair in (b"<<", b">>") else 1
    return body[m.end() : at]


def _character_map(stream: bytes) -> tuple[int, dict[int, str]]:
    """Bytes to a code, and the text of each code, of a font's map to Unicode."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    table: dict[int, str] = {}
    width = 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            table[int(code, 16)] = text(to)
            width = max(width, len(code) // 2)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, z, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            width = max(width, len(a) // 2)
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", many)
            for i, code in enumerate(range(int(a, 16), min(int(z, 16), int(a, 16) + 65535) + 1)):
                if to:
                    first = text(to)
                    table[code] = first[:-1] + chr(ord(first[-1]) + i) if first else ""
                elif i < len(listed):
                    table[code] = text(listed[i])
    return width, table


def _literal(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def _shown(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The text that a page's operators show; a move to another line is a line break, a wide gap a blank."""
    out: list[str] = []
    stack: list[bytes] = []
    font: tuple[int, dict[int, str]] = (1, {})

    def show(raw: bytes) -> None:
        width, table = font
        if not table:
            out.append(raw.decode("cp1252", "replace"))
        else:
            out.extend(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(</[]+-.0123456789" and token not in (b"<<",):
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) >= 2:
            font = fonts.get(stack[-2][1:], (1, {}))
        elif token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in stack if token == b"TJ" else stack[-1:]:
                if x[:1] in b"(<":
                    show(_literal(x))
                elif token == b"TJ" and x[:1] not in b"[]/" and float(x) < -200:
                    out.append(" ")
        elif token in (b"T*", b"BT"):
            out.append("\n")
        elif token in (b"Td", b"TD") and len(stack) >= 2 and stack[-1][:1] not in b"(<[]/":
            out.append("\n" if float(stack[-1]) else " ")
        elif token == b"Tm":
            out.append("\n")
        stack = []
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def page_texts(data: bytes) -> list[str]:
    """The text of each page; an empty list for what is no PDF, empty texts for pages that cannot be read."""
    if b"%PDF-" not in data[:1024]:
        return []
    objects = _objects(data)
    out = []
    for page in _pages(objects):
        fonts = {}
        inherited, parent = page, page
        while b"/Resources" not in inherited and (up := re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", parent)):
            inherited = parent = objects.get(int(up[1]), b"")
            if not parent:
                break
        resources = _dictionary(inherited, b"Resources", objects)
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", _dictionary(resources, b"Font", objects)):
            link = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", objects.get(int(number), b""))
            stream = _unpacked(objects.get(int(link[1]), b"")) if link else None
            if stream:
                fonts[name] = _character_map(stream)
        m = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", page, re.S)
        numbers = [int(n) for n in _REFERENCE.findall((m[1] or m[2]))] if m else []
        content = b"\n".join(_unpacked(objects.get(n, b"")) or b"" for n in numbers)
        out.append(_shown(content, fonts))
    return out


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text, by_ocr) of PDF files: the text layer of each page, and whether it is too thin to serve."""

    def run(it):
        import pyarrow as pa

        for b in it:
            rows = [(i, n, t) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, t in enumerate(page_texts(data), 1)]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["doc_id", "page", "text"])

    found = files(spark, path).select("doc_id", "bytes").mapInArrow(run, "doc_id string, page int, text string")
    return found.withColumn("by_ocr", needs_ocr(F.col("text")))
