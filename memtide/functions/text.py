"""Titles and names: Shift-JIS subset, look-alikes, long names, globs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that look like ASCII ones.
LOOK_ALIKES = {
    "¢": "c", "´": "'", "×": "x", "÷": "/", "‐": "-", "―": "-", "‘": "'", "’": "'",
    "“": '"', "”": '"', "′": "'", "−": "-", "≪": "<<", "≫": ">>", "─": "-", "━": "-",
    "│": "|", "┃": "|", "┌": "+", "┏": "+", "┐": "+", "┓": "+", "└": "+", "┗": "+",
    "┘": "+", "┛": "+", "├": "+", "┝": "+", "┠": "+", "┣": "+", "┤": "+", "┥": "+",
    "┨": "+", "┫": "+", "┬": "+", "┯": "+", "┰": "+", "┳": "+", "┷": "+", "┸": "+",
    "┻": "+", "┼": "+", "┿": "+", "╂": "+", "╋": "+", "■": "#", "□": "#", "★": "*",
    "☆": "*", "、": ",", "。": ".", "〃": '"', "〇": "0", "〈": "<", "〉": ">", "《": "<<",
    "》": ">>", "「": "[", "」": "]", "『": "[", "』": "]", "【": "[", "】": "]", "〔": "[",
    "〕": "]", "〜": "~", "ー": "-",
}


def _double_bytes() -> dict[int, str]:
    """Two-byte characters of rows 0x81 to 0x84, from the standard codec; other rows are not decoded."""
    out = {}
    for lead in range(0x81, 0x85):
        for trail in range(0x40, 0xFD):
            try:
                c = bytes([lead, trail]).decode("shift_jis")
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out[lead << 8 | trail] = c
    return out


DOUBLE_BYTES = _double_bytes()
HALF_WIDTH = {b: chr(0xFF61 + b - 0xA1) for b in range(0xA1, 0xE0)}
#: Compatibility forms of everything that titles can hold.
NORMAL_FORMS = {c: n for c in sorted({*DOUBLE_BYTES.values(), *HALF_WIDTH.values()}) if (n := unicodedata.normalize("NFKC", c)) != c}
UNKNOWN = "�"


def decode_sjis(raw: bytes) -> str:
    """Up to the first NUL: ASCII, half-width katakana and the known two-byte rows; anything else is U+FFFD."""
    out, it = [], iter(raw)
    for b in it:
        if b == 0:
            break
        if b < 0x80:
            out.append(chr(b))
        elif b in HALF_WIDTH:
            out.append(HALF_WIDTH[b])
        elif 0x81 <= b <= 0x9F or 0xE0 <= b <= 0xFC:
            trail = next(it, None)
            out.append(UNKNOWN if trail is None else DOUBLE_BYTES.get(b << 8 | trail, UNKNOWN))
        else:
            out.append(UNKNOWN)
    return "".join(out)


def readable(text: str) -> str:
    """Normal forms, then look-alikes of what they give."""
    return "".join(LOOK_ALIKES.get(c, c) for t in text for c in NORMAL_FORMS.get(t, t))


def title_text(raw: bytes) -> str:
    return readable(decode_sjis(raw))


def readable_column(text: Column) -> Column:
    """``readable`` inside the JVM: two passes over characters through constant maps."""
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    through = lambda c, m: F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(pairs(m), x), x)), "")
    return through(through(text, NORMAL_FORMS), LOOK_ALIKES)


ILLEGAL = r'[/\\:*?"<>|]'


def long_name(directory: Column, title: Column) -> Column:
    """A host file name from a directory name and a title: illegal characters replaced, blanks squeezed, ends trimmed."""
    t = F.trim(F.regexp_replace(F.regexp_replace(title, ILLEGAL, "_"), r"\s+", " "))
    return F.when(t == "", directory).otherwise(F.concat(directory, F.lit(" "), t))


def glob_regex(pattern: str) -> str:
    """The pattern's last component as an anchored regular expression: * and ? only, letters as they are."""
    last = pattern.rpartition("/")[2]
    return "^(?s)" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_ " else "\\" + c for c in last) + "$"


def is_pattern(pattern: str) -> bool:
    return any(c in pattern.rpartition("/")[2] for c in "*?")


def thousands(kb: Column) -> Column:
    return F.format_number(kb, 0)


def latin1(raw: Column) -> Column:
    """A NUL-terminated field of bytes as text, one character a byte."""
    return F.substring_index(F.decode(raw, "ISO-8859-1"), "\u0000", 1)


def psx_title(head: Column) -> Column:
    """The title in a save's 128-byte head: bytes 4 to 67, up to a NUL."""
    return latin1(F.substring(head, 5, 64))


def file_type(path: Column) -> Column:
    """Container type by a file name's ending."""
    p = F.lower(path)
    return F.coalesce(*[F.when(p.endswith(f".{x}"), F.lit(x)) for x in ("psu", "max", "sps", "xps", "cbs")])


def sniff(head: Column) -> Column:
    """Container type by a file's first bytes (17 are needed): what has no magic is taken for a psu, under 16 bytes for nothing."""
    starts = lambda b: F.substring(head, 1, len(b)) == F.lit(bytearray(b))
    return (
        F.when(F.length(head) < 16, F.lit(None).cast("string"))
        .when(starts(b"CFU\0"), F.lit("cbs"))
        .when(starts(b"Ps2PowerSave"), F.lit("max"))
        .when(starts(b"nPort"), F.lit("npo"))
        .when(starts(b"\x0d\0\0\0SharkPortSave"), F.lit("sps"))
        .otherwise(F.lit("psu"))
    )
