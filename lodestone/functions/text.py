"""Text cleaning, sections and windows as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE = 1200
CHUNK_OVERLAP = 200
#: White space that trimming removes: the Unicode property, without the information separators.
SPACE = r"\t\n\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PLAIN_SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_HEADING = "\\n(?=[" + SPACE.replace(r"\n", "") + "]*#)"


def trim(text: Column) -> Column:
    """text without Unicode white space at both ends."""
    return F.btrim(text, F.lit(_PLAIN_SPACE))  # linear, which a pattern for the end isn't


def strip_front_matter(text: Column) -> Column:
    """text after the block between a first line --- and the next line ---, if it begins so."""
    close = F.locate("\n---\n", text, 5)
    return F.when(text.startswith("---\n") & (close > 0), F.substring(text, close + 5, F.length(text))).otherwise(text)


def normalize(text: Column) -> Column:
    """text with Unix line ends, trimmed."""
    return trim(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def clean(text: Column) -> Column:
    return normalize(strip_front_matter(text))


def sections(text: Column) -> Column:
    """array<string>: a line whose first visible character is # begins a new section; blank sections don't count."""
    return F.filter(F.transform(F.split(text, _HEADING, -1), trim), lambda s: s != "")


def window_bounds(size: int, overlap: int) -> tuple[int, int]:
    """The size and overlap that apply for what was asked for."""
    size = size if size > 0 else CHUNK_SIZE
    overlap = max(overlap, 0)
    return size, size // 2 if overlap >= size else overlap


def windows(section: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string>: overlapping windows of `size` code points over one section, trimmed, without blank ones."""
    size, overlap = window_bounds(size, overlap)
    step = size - overlap
    last = F.greatest(F.ceil((F.length(section) - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: trim(F.substring(section, k * step + 1, size))), lambda s: s != "")


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string>: the windows of all sections of a clean text, in order. No window spans two sections."""
    return F.flatten(F.transform(sections(text), lambda s: windows(s, size, overlap)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(page_id: Column, index: Column) -> Column:
    return F.format_string("%s:%06d", page_id, index)


def summarize(text: str, most: int) -> str:
    """One line of at most `most` bytes; what is longer ends in three dots."""
    raw = strip(text.replace("\n", " ")).encode()
    return raw.decode() if most <= 3 or len(raw) <= most else raw[: most - 3].decode(errors="replace") + "..."




def strip(text: str) -> str:
    return text.strip(_PLAIN_SPACE)
