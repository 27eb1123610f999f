"""Text out of files: plain text, HTML, DOCX and PDF.

A file's bytes go to one function for its kind, on the executors, which gives its text in parts as it goes on: paragraphs of DOCX, pages of PDF, blocks of
HTML, a plain text as one. What can't be read is a row with an error, and no failed job. Files above ``MAX_SIZE`` are such rows too, and their bytes are not
read; nor does a part of a DOCX or PDF file unpack to more.

PDF: page contents in the order of the page tree, packed or not, with or without object streams; literal and hexadecimal strings, by the font's ToUnicode map or
else as Windows-1252. Not read are encrypted files, images, and fonts with an encoding of their own and no such map.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import shared

MAX_SIZE = 50 << 20
ROWS = "path string, size long, kind string, part int, text string, error string"
#: What HTML runs together, and a blank part consists of; other white space, such as a no-break space, is text.
_SPACE = " \t\n\r"
NO_TEXT = "ValueError: no text"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def plain(data: bytes) -> Iterator[str]:
    yield data.decode("utf-8-sig", "replace")


def docx(data: bytes) -> Iterator[str]:
    """Paragraphs, read from the archive as they are unpacked."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo("word/document.xml").file_size > MAX_SIZE:
            raise ValueError("unpacks to too much")
        with z.open("word/document.xml") as f:
            text: list[str] = []
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_WORD}t":
                    text.append(_HELD.sub(lambda m: chr(int(m[1], 16)), e.text or ""))
                elif e.tag in (f"{_WORD}tab", f"{_WORD}br", f"{_WORD}cr"):
                    text.append("\t" if e.tag.endswith("tab") else "\n")
                elif e.tag == f"{_WORD}p":
                    yield "".join(text)
                    text.clear()
                    e.clear()


#: A character that XML can't hold, as OOXML writes it; _x005F_ before such a one stands for its underscore.
_HELD = re.compile(r"_x(005F(?=_x[0-9A-F]{4}_)|00(?:0[0-8BCEF]|1[0-9A-F])|FFF[EF])_")
_UNHELD = re.compile(r"_(?=x(?:005F|00(?:0[0-8BCEF]|1[0-9A-F])|FFF[EF])_)|[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def xml_escaped(text: str) -> str:
    return _UNHELD.sub(lambda m: f"_x{ord(m[0]):04X}_", text)


class _Blocks(HTMLParser):
    INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.text: list[str] = []
        self.hidden = 0

    def ended(self) -> None:
        if block := re.sub(f"[{_SPACE}]+", " ", "".join(self.text)).strip(_SPACE):
            self.found.append(block)
        self.text.clear()

    def handle_starttag(self, tag, attrs) -> None:
        if tag not in self.INLINE:
            self.ended()
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag) -> None:
        if tag not in self.INLINE:
            self.ended()
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.text.append(data)


def markup(data: bytes) -> Iterator[str]:
    """Texts of the blocks, without scripts and styles."""
    p = _Blocks()
    p.feed(data.decode("utf-8-sig", "replace"))
    p.close()
    p.ended()
    yield from p.found


_OBJECT = re.compile(rb"(?<![0-9])([0-9]+)\s+[0-9]+\s+obj\b(.*?)(?:\bstream\r?\n|\bendobj\b)", re.DOTALL)
_LENGTH, _REF = re.compile(rb"/Length\s+([0-9]+)(?!\s+[0-9]+\s+R)"), re.compile(rb"([0-9]+)\s+[0-9]+\s+R\b")
_END = re.compile(rb"\s*endstream")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|[^\s<>\[\]()/]+|[\[\]]", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.DOTALL)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class _Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF")
        if re.search(rb"/Encrypt\s+[0-9]", data):
            raise ValueError("encrypted")
        self.objects: dict[int, tuple[bytes, bytes]] = {}  # number: dictionary, stream as it is
        self.maps: dict[int, tuple[int, _Codes]] = {}  # by the number of their stream: fonts' code maps, each read once
        at = 0
        while m := _OBJECT.search(data, at):
            at, body = m.end(), b""
            if not m[0].endswith(b"endobj"):
                n = _LENGTH.search(m[2])
                end = at + int(n[1]) if n and _END.match(data, at + int(n[1])) else data.find(b"endstream", at)
                if end < 0:
                    raise ValueError("a stream without an end")
                body, at = data[at:end], end
            self.objects[int(m[1])] = m[2], body
        for number in list(self.objects):
            head, _ = self.objects[number]
            if re.search(rb"/Type\s*/ObjStm\b", head):
                self._packed(head, self.stream(number))

    def _packed(self, head: bytes, body: bytes) -> None:
        first = int(re.search(rb"/First\s+([0-9]+)", head)[1])
        numbers = [int(x) for x in body[:first].split()]
        places = [*numbers[1::2], len(body) - first]
        for n, a, b in zip(numbers[::2], places, places[1:]):
            self.objects.setdefault(n, (body[first + a : first + b], b""))

    def stream(self, number: int) -> bytes:
        head, body = self.objects.get(number, (b"", b""))
        filters = re.search(rb"/Filter\s*(\[[^\]]*\]|/[A-Za-z0-9]+)", head)
        names = re.findall(rb"/([A-Za-z0-9]+)", filters[1]) if filters else []
        for name in names:
            if name != b"FlateDecode":
                raise ValueError(f"not read: {name.decode()}")
            d = zlib.decompressobj()
            body = d.decompress(body, MAX_SIZE)
            if d.unconsumed_tail:
                raise ValueError("unpacks to too much")
        return body

    def value(self, head: bytes, key: bytes) -> bytes:
        """What stands behind a key: a reference's object, a dictionary or an array."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", head)
        if not m:
            return b""
        if r := _REF.match(head, m.end()):
            return self.objects.get(int(r[1]), (b"", b""))[0]
        if head[m.end() : m.end() + 1] not in (b"<", b"["):
            return b""
        depth = 0
        for t in re.finditer(rb"<<|>>|\[|\]", head[m.end() :]):
            depth += 1 if t[0] in (b"<<", b"[") else -1
            if not depth:
                return head[m.end() : m.end() + t.end()]
        return b""

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """(page, its resources) in order."""
        roots = [h for h, _ in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", h)]
        todo = [(self.value(roots[-1], b"Pages"), b"", 0)] if roots else []
        while todo:
            head, above, depth = todo.pop()
            resources = self.value(head, b"Resources") or above
            if re.search(rb"/Type\s*/Page(?!s)", head):
                yield head, resources
            elif depth < 64:  # a tree, not a circle
                todo += [(self.objects.get(int(r), (b"", b""))[0], resources, depth + 1) for r in reversed(_REF.findall(self.value(head, b"Kids")))]

    def contents(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|[0-9]+\s+[0-9]+\s+R)", page)
        return b"\n".join(self.stream(int(r)) for r in _REF.findall(m[1])) if m else b""

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, _Codes] | None]:
        """Of each font: (bytes of a code, code to text), None without a map."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+([0-9]+)\s+[0-9]+\s+R", self.value(resources, b"Font")):
            m = re.search(rb"/ToUnicode\s+([0-9]+)", self.objects.get(int(number), (b"", b""))[0])
            if m and int(m[1]) not in self.maps:
                self.maps[int(m[1])] = _code_map(self.stream(int(m[1])))
            out[b"/" + name] = self.maps[int(m[1])] if m else None
        return out


def _utf16(h: bytes) -> str:
    return bytes.fromhex(h.decode()).decode("utf-16-be", "replace")


class _Codes(dict):
    """Code to text. Ranges, which may hold all codes there are, are looked into for the codes that are used; the last that has one counts."""

    def __init__(self, chars: dict[int, str], ranges: list[tuple[int, int, bytes]]):
        super().__init__()
        self.chars, self.ranges = chars, ranges[::-1]

    def __missing__(self, code: int) -> str:
        self[code] = text = self._found(code)
        return text

    def _found(self, code: int) -> str:
        for a, b, to in self.ranges:
            if a <= code <= min(b, 0xFFFF) and not 0xD800 <= (n := int(to, 16) + code - a) < 0xE000:
                return _utf16(b"%04X" % n) if len(to) <= 4 else _utf16(to)
        return self.chars.get(code, "")

    def half(self, code: int) -> str:
        """The half of a surrogate pair that a code stands for, if it does."""
        found = (n for a, b, to in self.ranges if a <= code <= min(b, 0xFFFF) and 0xD800 <= (n := int(to, 16) + code - a) < 0xE000)
        return next(map(chr, found), "")


def _code_map(body: bytes) -> tuple[int, _Codes]:
    width = max([len(h) // 2 for h in re.findall(rb"<([0-9A-Fa-f]+)>", b"".join(re.findall(rb"begincodespacerange(.*?)endcodespacerange", body, re.DOTALL)))] or [1])
    chars, ranges = {}, []
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.DOTALL):
        chars |= {int(a, 16): _utf16(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.DOTALL):
        ranges += [(int(a, 16), int(b, 16), to) for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)]
    return width, _Codes(chars, ranges)


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        h = b"".join(token[1:-1].split())
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    named = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else _NAMED.get(m[1], m[1])
    return _ESCAPE.sub(named, token[1:-1])


def pdf(data: bytes) -> Iterator[str]:
    """Texts of the pages, a line for each that the page begins."""
    d = _Pdf(data)
    for page, resources in d.pages():
        fonts, font, out, held = d.fonts(resources), None, [], []
        for m in _TOKEN.finditer(d.contents(page)):
            t = m[0]
            if t == b"Tf":
                font = fonts.get(next((x for x in held if x.startswith(b"/")), b""))
            elif t in (b"Tj", b"TJ", b"'", b'"'):
                if t in (b"'", b'"'):
                    out.append("\n")
                for s in (_string(x) for x in held if x[:1] in b"(<"):
                    if font:
                        width, codes = font
                        shown = "".join(codes[c] or codes.half(c) for c in (int.from_bytes(s[i : i + width]) for i in range(0, len(s), width)))
                        out.append(shown.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "ignore"))  # halves to pairs; none stays alone
                    else:
                        out.append(s.decode("cp1252", "replace"))
            elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                out.append("\n")
            if t[:1].isalpha() or t in (b"'", b'"'):
                held.clear()
            else:
                held.append(t)
        yield re.sub(r"\n+", "\n", "".join(out)).strip("\n")


KINDS: dict[str, Callable[[bytes], Iterator[str]]] = {"txt": plain, "md": plain, "html": markup, "htm": markup, "docx": docx, "pdf": pdf}


def extracted(spark: SparkSession, path: str, max_size: int = MAX_SIZE, kinds: dict[str, Callable[[bytes], Iterator[str]]] | None = None) -> DataFrame:
    """Rows (path, size, kind, part, text, error) of all files under ``path``: the parts of each that aren't blank, or one row with an error."""
    of = kinds or KINDS
    listing, opened = shared.listed(spark, path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in ROWS.split(", ")]
        kinds_ = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
        read, held, size = opened(), [], 0

        def given(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds_)], names=names)

        for b in batches:
            for p, n, k, root, at in zip(*(b.column(c).to_pylist() for c in ("path", "size", "kind", "root", "at"))):
                if n > max_size:  # its content isn't read
                    held.append((p, n, k, None, None, f"larger than {max_size} bytes"))
                    continue
                content, part = read(root, at), 0
                try:
                    if k not in of:
                        raise ValueError(f"unsupported kind: {k}")
                    for text in of[k](content):
                        if text.strip(_SPACE):
                            held.append((p, n, k, part, text, None))
                            part, size = part + 1, size + len(text)
                        if size > 1 << 22:  # a long file's parts go on as they come
                            yield given(held)
                            held, size = [], 0
                    if not part:
                        raise ValueError(NO_TEXT.removeprefix("ValueError: "))
                except Exception as e:  # noqa: BLE001  a bad file is a row
                    held.append((p, n, k, None, None, f"{type(e).__name__}: {e}"))
                if len(held) >= 1000:
                    yield given(held)
                    held, size = [], 0
        if held:
            yield given(held)

    return listing.select("path", "size", kind.alias("kind"), "root", "at").mapInArrow(rows, ROWS)


def texts(parts: DataFrame) -> DataFrame:
    """(path, size, kind, text, error) of each file: its parts in order, each with a blank line after it."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: F.concat(x["text"], F.lit("\n\n"))), "")  # of one file
    return parts.groupBy("path", "size", "kind").agg(F.when(F.max("error").isNull(), joined).alias("text"), F.max("error").alias("error"))
