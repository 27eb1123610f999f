"""Text functions as column expressions: normalising, noise, headings, estimates, titles.

All are built-in functions; none leaves the JVM. Lengths count UTF-16 units, as token estimates do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.8

# Patterns that decide results.
MARKDOWN = r"^(#{1,4})\s+(.+)$"
LEGAL_VI = r"^(CHƯƠNG|Chương|PHẦN|Phần|BÀI|Bài|MỤC|Mục|ĐIỀU|Điều|TIẾT|Tiết|KHOẢN|Khoản|ĐIỂM|Điểm)\s+([\dIVXivxA-Za-z]+\.?)(.{0,160})$"
LEGAL_EN = r"^(ARTICLE|Article|SECTION|Section|CHAPTER|Chapter|CLAUSE|Clause|PART|Part|APPENDIX|Appendix)\s+([\dIVXivx]+\.?)(.{0,160})$"
NUMBERED = r"^(\d{1,2}(\.\d{1,2}){0,3})\.\s{1,4}(\S.{2,100})$"
CAPITALS = r"^[A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯ][A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯ\s\d\-/]{3,79}$"
FENCE, TABLE_ROW, TABLE_RULE = r"^```.*$", r"^\|.+\|\s*$", r"^[|\-:\s]{3,}$"
BULLET = r"^([\-*•]|\d+[.)]) .+"
LEVELS = {"chương": 1, "phần": 1, "bài": 1, "mục": 2, "điều": 2, "khoản": 3, "tiết": 3, "điểm": 4, "chapter": 1, "part": 1, "appendix": 1, "article": 2, "section": 2, "clause": 3}
CONNECTORS = (
    "và", "hoặc", "nhưng", "mà", "vì", "nên", "thì", "là", "của", "trong", "với", "để", "cho", "khi", "theo", "từ",
    "and", "or", "but", "which", "that", "who", "where", "when",
)
ANSWER_LABELS = ("Question:", "Constraint:", "Keyword search:", "Found in:")
DEFAULT_AUTHORITIES, ADMIN_AUTHORITIES = "document:create,document:read,document:update,document:delete", "system:admin,kb:manage,user:manage"
PAGE_NUMBER = r"^[-–—]?\s*\d{1,4}\s*[-–—]?$"
PAGE_LABEL = r"(?i)^(page|trang)\s+\d+.*$"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
INVISIBLE = "\ufeff\u200b\u200c\u200d\ufffd"
#: What ``normalize`` changes.
ARTEFACT = rf"[\r\t\u00a0{INVISIBLE}{CONTROLS[1:]}|\n{{4}}"


def whole(pattern: str) -> str:
    """The pattern for the whole line, to the last character."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return rf"{flags}\A(?:{pattern.removeprefix('(?i)').removeprefix('^').removesuffix('$')})\z"


def utf16_length(c: Column) -> Column:
    return (F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))).cast("int")


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space (a no-break space is none)."""
    return F.regexp_replace(c, r"\A\p{javaWhitespace}+|\p{javaWhitespace}+\z", "")


def trim_controls(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"\P{javaWhitespace}")


def not_blank_or(c: Column, other: Column) -> Column:
    return F.when(blank(c), other).otherwise(c)


def normalize(c: Column, tabs: bool = True) -> Column:
    """Encoding artefacts out, line ends and spaces made alike, at most two blank lines running."""
    out = c
    for x, by in ((INVISIBLE[0], ""), ("\r\n", "\n"), ("\r", "\n"), ("\u00a0", " "), *([("\t", " ")] if tabs else [])):
        out = F.replace(out, F.lit(x), F.lit(by))
    out = F.regexp_replace(F.regexp_replace(out, f"[{INVISIBLE[1:]}{CONTROLS[1:]}", ""), "\n{4,}", "\n\n\n")
    return F.when(c.rlike(ARTEFACT if tabs else ARTEFACT.replace(r"\t", "")), out).otherwise(c)  # most texts have none


def clean_text(c: Column) -> Column:
    """The standalone cleaner: keeps tabs, trims; "" for null and blank."""
    return F.when(blank(c), F.lit("")).otherwise(trim_controls(normalize(c, tabs=False)))


def is_noise(line: Column) -> Column:
    """Of a stripped line: a page number, a page label, or one or two characters."""
    return line.rlike(whole(PAGE_NUMBER)) | line.rlike(whole(PAGE_LABEL)) | ((line != "") & (F.length(line) < 3) & (utf16_length(line) < 3))


def starts_with_connector(line: Column) -> Column:
    return F.lower(F.substring(line, 1, 20)).rlike(rf"\A(?:{'|'.join(CONNECTORS)}) ")


def upper_each(c: Column) -> Column:
    """Upper case character by character, none becoming several: ß becomes ẞ, and what has no single upper case (ŉ, ﬁ) stays."""
    each = lambda x: F.when(x == "ß", F.lit("ẞ")).when(F.length(F.upper(x)) > 1, x).otherwise(F.upper(x))
    return F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(F.array_join(F.transform(F.split(c, ""), each), ""))


def heading(line: Column, units: Callable[[Column], Column] = utf16_length) -> Column:
    """struct(title, level) of a heading line, else null. Rules in order; the first that holds decides. units: what a line's length is."""
    out = lambda title, level: F.struct(title.alias("title"), level.cast("int").alias("level"))

    def legal(pattern: str) -> Column:
        word = F.lower(F.regexp_extract(line, pattern, 1))
        level = F.lit(2)
        for w, n in LEVELS.items():
            level = F.when(word == w, n).otherwise(level)
        return level

    rest = F.regexp_extract(line, NUMBERED, 3)
    dots = F.length(F.regexp_replace(F.regexp_extract(line, NUMBERED, 1), r"[^.]", ""))
    commas = F.length(F.regexp_replace(rest, "[^,]", ""))
    numbered = line.rlike(whole(NUMBERED)) & ~rest.endswith(".") & (commas <= 2)
    return (
        F.when(((line >= "a") & (line < "{")) | blank(line) | (units(line) > 200), F.lit(None))  # none begins with a to z
        .when(line.rlike(whole(MARKDOWN)), out(trim_controls(F.regexp_extract(line, MARKDOWN, 2)), F.length(F.regexp_extract(line, MARKDOWN, 1))))
        .when(line.rlike(whole(LEGAL_VI)), out(trim_controls(line), legal(LEGAL_VI)))
        .when(line.rlike(whole(LEGAL_EN)), out(trim_controls(line), legal(LEGAL_EN)))
        .when(numbered, out(trim_controls(line), F.least(dots + 1, F.lit(4))))
        .when(line.rlike(whole(CAPITALS)) & ~line.contains(",") & ~line.endswith("."), out(trim_controls(line), F.lit(1)))
    )


def is_heading(line: Column) -> Column:
    return heading(line).isNotNull()


def reconstruct(text: Column) -> Column:
    """Cleans a raw text and rejoins lines broken within a sentence.

    Noise lines go; more than two blank lines running don't stay; a line is joined to the raw next one unless
    it ends hard (mark, over 80 characters, heading, § or •) or the next doesn't go on in lower case or with a connector.
    """
    seen = F.transform(F.transform(F.split(normalize(text), "\n", -1), strip), lambda t: F.struct(t.alias("t"), is_heading(t).alias("head")))

    def emitted(x: Column, i: Column, lines: Column) -> Column:
        t, after = x["t"], F.get(lines, i + 1)
        hard = F.substring(t, -1, 1).isin(*".!?:;") | (F.length(t) > 80) | (utf16_length(t) > 80) | x["head"] | t.rlike(r"\A[§•]")
        goes_on = (after["t"] != "") & ~after["head"] & (after["t"].rlike(r"\A\p{javaLowerCase}") | starts_with_connector(after["t"]))
        end = F.when(~hard & F.coalesce(goes_on, F.lit(False)), " ").otherwise("\n")
        return F.struct(is_noise(t).alias("noise"), (t == "").alias("blank"), F.when(t == "", F.lit("\n")).otherwise(F.concat(t, end)).alias("out"))

    bind = lambda arr, f: F.get(F.transform(F.array(arr), f), F.lit(0))
    marked = bind(seen, lambda lines: F.filter(F.transform(lines, lambda x, i: emitted(x, i, lines)), lambda y: ~y["noise"]))
    third = lambda kept, i: (i >= 2) & F.coalesce(F.get(kept, i - 1)["blank"], F.lit(False)) & F.coalesce(F.get(kept, i - 2)["blank"], F.lit(False))
    joined = bind(marked, lambda kept: F.array_join(F.transform(F.filter(kept, lambda x, i: ~(x["blank"] & third(kept, i))), lambda x: x["out"]), ""))
    return F.when(blank(text), F.lit("")).otherwise(trim_controls(joined))


def tokens_by_ratio(c: Column, units: Callable[[Column], Column] = utf16_length) -> Column:
    """ceil(units / 3.8), at least 1; 0 for null and empty."""
    n = units(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.ceil(n / F.lit(CHARS_PER_TOKEN))).cast("int")


def tokens_by_quarter(c: Column, up: bool = True, units: Callable[[Column], Column] = utf16_length) -> Column:
    """A quarter of the units, rounded up or down, at least 1; 0 for null and empty."""
    n = units(c)
    quarter = F.ceil(n / F.lit(4.0)) if up else F.floor(n / F.lit(4.0))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), quarter)).cast("int")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def type_of_extension(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e == ".pdf", "pdf").when(e == ".docx", "docx").when(e == ".txt", "txt").otherwise("pdf")


def type_of_upload(mime: Column, name: Column) -> Column:
    """By MIME type, else by name, else pdf."""
    low = F.lower(name)
    ends = lambda *xs: F.coalesce(low.rlike(rf"(?:{'|'.join(xs)})\z"), F.lit(False))
    has = lambda x: F.coalesce(mime.contains(x), F.lit(False))
    return (
        F.when(has("pdf"), "pdf").when(has("word") | has("openxmlformats"), "docx").when(has("text"), "txt")
        .when(ends(r"\.pdf"), "pdf").when(ends(r"\.docx", r"\.doc"), "docx").when(ends(r"\.txt", r"\.md"), "txt").otherwise("pdf")
    )


def storage_key(user: Column, ext: Column) -> Column:
    """The name under which an upload's bytes are kept; new at each evaluation."""
    return F.concat(F.lit("doc_"), user, F.lit("_"), F.uuid(), ext)


def clean_answer(raw: Column) -> Column:
    """Without echoed prompt labels, each up to its line end."""
    for label in ANSWER_LABELS:
        raw = F.regexp_replace(raw, f"(?s){label}.*?\\n", "")
    return trim_controls(raw)


def clean_title(raw: Column) -> Column:
    """A generated title without JSON marks and labels; of "summary: x details: y" only x."""
    low = F.lower(raw)
    start, end = F.instr(low, "summary:") + 8, F.instr(low, "details:")
    end = F.when(end == 0, F.length(raw) + 1).otherwise(end)
    cut = F.when((F.instr(low, "summary:") > 0) & (end > start), F.substring(raw, start, F.greatest(end - start, F.lit(0)))).otherwise(raw)
    out = trim_controls(F.regexp_replace(cut, r'[{}"\[\]]|summary:|details:|sources:', ""))
    return F.when(out.endswith(","), trim_controls(F.regexp_replace(out, r",\z", ""))).otherwise(out)


def authorities(role: Column, roles: Column) -> Column:
    """Comma-joined authorities: four defaults, the cleaned roles, ROLE_ and what administrators have besides."""
    cleaned = F.translate(F.coalesce(roles, F.lit("")), '[]" ', "")
    own = F.coalesce(role, F.lit("WORKSPACE_MEMBER"))
    admin = own.isin("SUPER_ADMIN", "ADMIN") | cleaned.contains("ADMIN")
    return F.concat(
        F.lit(DEFAULT_AUTHORITIES), F.when(cleaned != "", F.concat(F.lit(","), cleaned)).otherwise(""),
        F.lit(",ROLE_"), own, F.when(admin, "," + ADMIN_AUTHORITIES).otherwise(""),
    )
