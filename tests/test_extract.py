"""Text out of generated files, and bad ones."""

import pytest

from quire.plans import files
from quire.sources import extract, shared, tables

TEXT = "Überschrift (one)\n\nA line with \\ and ) and é, ñ.\n" + "\n".join(f"line {i} of many" for i in range(100))


def lines(parts):
    return [x for p in parts for x in p.split("\n") if x.strip()]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("unicode", [True, False])
def test_pdf(packed, unicode):
    got = list(extract.pdf(files.pdf(TEXT + ("\n漢字 – ỡ" if unicode else ""), packed, unicode)))
    assert len(got) == 3 and lines(got) == [x for x in TEXT.split("\n") if x] + (["漢字 – ỡ"] if unicode else [])


def test_pdf_of_other_makers():
    body = b"BT /F2 9 Tf 1 0 0 1 50 700 Tm [(Hel) -20 (lo)] TJ 0 -12 Td (W\\157rld \\(x\\)) Tj (next) ' ET"
    data = b"%PDF-1.7\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]>>\nendobj\n3 0 obj\n<</Type/Page/Contents[4 0 R]/Resources<</Font<</F2 5 0 R>>>>>>\nendobj\n4 0 obj\n<</Length 6 0 R>>\nstream\n" + body + b"\nendstream\nendobj\n5 0 obj\n<</Type/Font>>\nendobj\n6 0 obj\n%d\nendobj\n" % len(body)
    assert list(extract.pdf(data)) == ["Hello\nWorld (x)\nnext"]


def test_docx_and_html():
    assert lines(extract.docx(files.docx(TEXT + "\n漢 <b> & x"))) == [x for x in TEXT.split("\n") if x] + ["漢 <b> & x"]
    assert list(extract.markup(files.page("a <b> &\n\nb  c"))) == ["a <b> &", "b c"]
    assert list(extract.markup(b"<p>One <b>bo</b>ld</p>text<div>two<br>three</div><script>no</script>")) == ["One bold", "text", "two", "three"]


def test_files(spark, tmp_path):
    good = {f"g.{k}": m("Some text.\nMore of it.") for k, m in files.MAKERS.items()}
    bad = {"bad.pdf": b"%PDF-1.4 nothing", "bad.docx": b"PK no archive", "x.exe": b"MZ", "empty.txt": b"  \n", "none.pdf": b"text", "locked.pdf": files.pdf("x").replace(b"trailer <<", b"trailer << /Encrypt 9 0 R")}
    for name, data in (good | bad | {"large.txt": b"x" * 5000}).items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in extract.texts(extract.extracted(spark, str(tmp_path), max_size=4000)).collect()}
    assert len(got) == len(good) + len(bad) + 1
    for name in good:
        assert got[name]["error"] is None and got[name]["text"].split() == ["Some", "text.", "More", "of", "it."]
    assert all(got[name]["text"] is None and got[name]["error"] for name in [*bad, "large.txt"])
    assert got["large.txt"]["error"] == "larger than 4000 bytes" and "unsupported kind: exe" in got["x.exe"]["error"]


def test_what_unpacks_to_too_much(monkeypatch):
    monkeypatch.setattr(extract, "MAX_SIZE", 1000)
    for make, read in ((files.docx, extract.docx), (files.pdf, extract.pdf)):
        with pytest.raises(ValueError, match="too much"):
            list(read(make("a" * 5000)))


def test_codes_of_a_map_are_looked_up_when_used():
    """A map of all codes is not written out for each page; characters' own entries stand where a range has none, the last range counts."""
    body = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <D800> <0041> <0005> <00420043> endbfchar 3 beginbfrange <0000> <FFFF> <0000> <0030> <0031> <0061> <0040> <0041> <D83DDE00> endbfrange"
    width, codes = extract._code_map(body)
    assert width == 2 and len(codes) == 0
    assert [codes[c] for c in (0x41, 0x30, 0x31, 0x35, 0xD800, 0xD801, 5)] == ["😀", "a", "b", "5", "A", "", "\x05"] and len(codes) == 7
    d = extract._Pdf(files.pdf("\n".join(f"line {i}" for i in range(400))))
    fonts = [d.fonts(resources)[b"/F1"] for _, resources in d.pages()]
    assert len(fonts) == 10 and all(f is fonts[0] for f in fonts)


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """At any depth, by a pattern or a file's own name; hidden ones are left out; tasks are by the number of files."""
    for n in range(60):
        folder = tmp_path / "top dir" / f"k={n % 5}" / ("deep" if n % 2 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{n} é.txt").write_text(f"text {n}")
    for name in (".hidden.txt", "_SUCCESS", "x._COPYING_"):
        (tmp_path / "top dir" / name).write_text("no")
    monkeypatch.setattr(shared, "FILES_A_TASK", 20)
    monkeypatch.setattr(shared, "FOLDERS_A_TASK", 2)
    listing, _ = shared.listed(spark, str(tmp_path / "top dir"))
    assert listing.rdd.getNumPartitions() == 3
    want = sorted((r["path"], r["length"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "top dir")).select("path", "length").collect())
    assert sorted((r["path"], r["size"]) for r in listing.collect()) == want and len(want) == 60
    assert sorted(r["text"] for r in tables.files(spark, str(tmp_path / "top dir")).collect()) == sorted(f"text {n}" for n in range(60))
    assert tables.files(spark, str(tmp_path / "top dir" / "k=[12]")).count() == 24
    assert [r["text"] for r in tables.files(spark, str(tmp_path / "top dir" / "k=0" / "0 é.txt")).collect()] == ["text 0"]
    with pytest.raises(FileNotFoundError):
        shared.listed(spark, str(tmp_path / "none"))


def test_written_files_are_spread_over_folders(spark, monkeypatch):
    monkeypatch.setattr(files, "FILES_A_FOLDER", 10)
    base = files.written(spark.range(100).selectExpr("id", "'txt' AS kind", "concat('t', id) AS text"))
    found = {r["path"].rsplit("/", 2)[1:][0] for r in tables.files(spark, base).collect()}
    assert found <= {str(i) for i in range(10)} and len(found) > 5 and tables.files(spark, base).count() == 100
    assert tables.files(spark, files.written(spark.range(0).selectExpr("id", "'txt' AS kind", "'t' AS text"))).count() == 0
