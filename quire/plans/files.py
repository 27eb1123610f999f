"""Documents as files of the kinds that uploads have, made for queries and tests."""

from __future__ import annotations

import html
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources import shared, tables
from quire.sources.extract import xml_escaped


def docx(text: str) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{html.escape(xml_escaped(line), quote=False)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def page(text: str) -> bytes:
    return f"<html><head><style>p {{}}</style></head><body>{''.join(f'<p>{html.escape(line)}</p>' for line in text.split(chr(10)))}<script>var x = 1;</script></body></html>".encode()


def pdf(text: str, packed: bool = True, unicode: bool = True, lines_a_page: int = 40) -> bytes:
    """Text lines on pages; unicode: by codes with a map, else in Windows-1252."""
    lines = text.split("\n")
    pages = [lines[i : i + lines_a_page] for i in range(0, len(lines), lines_a_page)]

    def shown(line: str) -> bytes:
        if unicode:
            return b"<" + line.encode("utf-16-be", "replace").hex().encode() + b"> Tj T*"
        return b"(" + line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*"

    def stream(body: bytes) -> bytes:
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(z := zlib.compress(body)), z) if packed else b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)

    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>" if unicode else b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages)))), font, stream(cmap)]
    for i, p in enumerate(pages):
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * i), stream(b"BT /F1 12 Tf 14 TL 40 800 Td\n" + b"\n".join(map(shown, p)) + b"\nET")]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def plain(text: str) -> bytes:
    """A text that begins with a byte order mark gets one before it, which a reader takes for that of the file."""
    return text.encode("utf-8-sig" if text.startswith("\ufeff") else "utf-8")


MAKERS = {"txt": plain, "docx": docx, "html": page, "pdf": pdf}


#: Files in a folder, about.
FILES_A_FOLDER = 1000


def written(docs: DataFrame) -> str:
    """Writes documents (id, kind, text) as files id.kind in numbered folders, none of which holds many; the folder of these."""
    base = shared.new_path(docs.sparkSession, "uploads")
    folders = max(1, -(-docs.count() // FILES_A_FOLDER))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = shared.file_system(base)
        made = set()
        for b in batches:
            for i, kind, text, folder in zip(*(b.column(c).to_pylist() for c in ("id", "kind", "text", "folder"))):
                if folder not in made:
                    fs.create_dir(f"{top}/{folder}")
                    made.add(folder)
                with fs.open_output_stream(f"{top}/{folder}/{i}.{kind}") as f:
                    f.write(MAKERS[kind](text or ""))
            yield b.select(["id"])

    own = tables.spread(docs.select("id", "kind", "text")).withColumn("folder", F.pmod(F.xxhash64("id"), F.lit(folders)))
    own.mapInArrow(files, docs.select("id").schema).write.format("noop").mode("overwrite").save()
    shared.make_folder(docs.sparkSession, base)  # where there are no documents
    return base
