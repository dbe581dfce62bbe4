"""Column expressions on recognised and edited text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Language aliases and the codes they mean.
ALIASES = {
    "en": "eng", "eng": "eng", "english": "eng", "fr": "fra", "fra": "fra", "fre": "fra", "french": "fra",
    "de": "deu", "deu": "deu", "ger": "deu", "german": "deu", "it": "ita", "ita": "ita", "italian": "ita",
    "ja": "jpn", "jpn": "jpn", "japanese": "jpn", "ko": "kor", "kor": "kor", "korean": "kor",
    "es": "spa", "spa": "spa", "spanish": "spa",
}
#: The symbols that Japanese text has in full width.
ASCII_SYMBOLS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
HALF_MARKS, FULL_MARKS = "｡､｢｣･", "。、「」・"
LONG_MARKS = "—―ｰ"
#: Recognised colour names.
COLOURS = {"black": "#000000", "red": "#FF0000", "orange": "#FF8000", "yellow": "#FFFF00", "green": "#00FF00", "cyan": "#00FFFF", "blue": "#0000FF", "magenta": "#FF00FF"}
STYLES = ("bold", "italic", "underline", "strikethrough", "superscript", "subscript")
#: Names of secret keys, with ``_`` for ``-``.
SECRET_KEYS = ("api_key", "apikey", "authorization", "x_api_key", "access_token", "refresh_token", "password", "cookie", "set_cookie")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c: str | Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def language_code(c: str | Column) -> Column:
    """The code of a language alias, null if it isn't supported."""
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.try_element_at(table, F.translate(trim_unicode(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: str | Column) -> Column:
    """Canonical composition of a column that isn't all ASCII; see ``with_nfc`` for tables."""
    return _compose(col(c))


def ellipsis(c: Column) -> Column:
    return F.regexp_replace(c, "(?:\\.|．){3,}|…+", "⋯")


def prolonged(c: Column) -> Column:
    return F.translate(c, LONG_MARKS, "ー" * len(LONG_MARKS))


def full_width(c: Column) -> Column:
    return F.translate(c, ASCII_SYMBOLS + HALF_MARKS, "".join(chr(ord(x) + 0xFEE0) for x in ASCII_SYMBOLS) + FULL_MARKS)


#: Rules after composition, in order.
JAPANESE = (("japanese-centered-ellipsis-v1", ellipsis), ("japanese-prolonged-sound-mark-v1", prolonged), ("japanese-fullwidth-symbol-v1", full_width))


def first_control(c: str | Column) -> Column:
    """``U+XXXX`` of the first control character, null without one."""
    found = F.regexp_extract(col(c), r"(\p{Cc})", 1)
    return F.when(col(c).rlike(r"\p{Cc}"), F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(found)), 4, "0")))


def json_body(c: str | Column) -> Column:
    """A model's answer without white space around it and without a code fence."""
    text = trim_unicode(c)
    rows = F.split(text, "\n")
    inside = F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1))
    closing = F.array_position(F.transform(inside, lambda r: trim_unicode(r)), "```")
    kept = F.when(closing > 0, F.slice(inside, F.lit(1), (closing - 1).cast("int"))).otherwise(inside)
    return F.when(text.startswith("```"), F.array_join(kept, "\n")).otherwise(text)


def ruby_position(mode: str | Column, value: str | Column) -> Column:
    key = F.concat_ws(":", col(mode), col(value))
    return F.when(key.isin("horizontal_tb:over", "vertical_rl:right"), "over").when(key.isin("horizontal_tb:under", "vertical_rl:left"), "under")


def colour_code(name: str | Column) -> Column:
    """struct(code, error): ``default`` is no colour; unknown names are errors."""
    n = col(name)
    table = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    code = F.try_element_at(table, n)
    error = F.when(n.isNull() | ((n != "default") & code.isNull()), F.concat(F.lit("unsupported recognized text color: "), F.coalesce(n, F.lit(""))))
    return F.struct(code.alias("code"), error.alias("error"))


def canonical_styles(styles: Column) -> Column:
    return F.array_intersect(F.array(*[F.lit(s) for s in STYLES]), F.coalesce(styles, F.array(F.lit(""))))


def canonical_colour(c: str | Column) -> Column:
    """Upper-cased ``#RRGGBB``; null for white and for what isn't a colour."""
    return F.when(col(c).rlike("^#[0-9a-fA-F]{6}$"), F.nullif(F.upper(col(c)), F.lit("#FFFFFF")))


def nth_occurrence(text: Column, needle: Column, n: Column) -> Column:
    """0-based code point offset of the n-th non-overlapping occurrence; null if there is none."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    before = F.slice(pieces, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))
    offset = F.aggregate(before, F.lit(0), lambda a, p: a + F.length(p)) + (n - 1) * F.length(needle)
    return F.when((needle != "") & (n >= 1) & (F.size(pieces) > n), offset.cast("bigint"))


def glyph_mismatch(lines: Column, expected: Column) -> Column:
    """struct(unit, expected, actual) of the first line whose length is off by more than one; null if lengths of the arrays differ or all fit."""
    units = F.zip_with(F.transform(lines, lambda t, i: F.struct((i + 1).alias("unit"), F.length(t).alias("actual"))), expected, lambda a, e: F.struct(a.unit.alias("unit"), e.alias("expected"), a.actual.alias("actual")))
    return F.when(F.size(lines) == F.size(expected), F.try_element_at(F.filter(units, lambda u: F.abs(u.expected - u.actual) > 1), F.lit(1)))


def timestamp_ms(text: str | Column) -> Column:
    """Milliseconds of ``H:MM:SS.mmm``; null for anything else."""
    pattern = r"^(\d+):([0-5]\d):([0-5]\d)\.(\d{3})$"
    part = lambda i: F.regexp_extract(trim_unicode(text), pattern, i).try_cast("bigint")
    return part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4)


def clock(ms: str | Column, mark: str) -> Column:
    """``HH:MM:SS`` and milliseconds after ``mark``."""
    m = col(ms).cast("bigint")
    whole = lambda c, n: F.floor(c / n).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", whole(m, 3600000), whole(m, 60000) % 60, whole(m, 1000) % 60, m % 1000)


def srt_timestamp(ms: str | Column) -> Column:
    return clock(ms, ",")


def format_timestamp(ms: str | Column) -> Column:
    return clock(ms, ".")


def srt_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def srt_fragment(text: Column, styles: Column) -> Column:
    """Escaped text in tags: underline innermost, bold outermost."""
    out = srt_escape(text)
    for style, tag in (("underline", "u"), ("italic", "i"), ("bold", "b")):
        out = F.when(F.array_contains(styles, style), F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    return out


def srt_line(line: Column) -> Column:
    """A line (struct text, spans) as SRT; ruby is reduced to its base."""
    parts = F.transform(line.spans, lambda s: srt_fragment(F.when(s.type == "ruby", s.base).otherwise(s.text), s.styles))
    return F.when(F.coalesce(F.size(line.spans), F.lit(0)) < 1, srt_escape(line.text)).otherwise(F.array_join(parts, ""))


def safe_stem(name: str | Column) -> Column:
    return F.regexp_replace(trim_unicode(name), r"[/\\:*?\"<>|]|\p{Cc}", "_")


def base_name(requested: Column, project: Column, language: Column) -> Column:
    own = F.nullif(safe_stem(requested), F.lit(""))
    return F.coalesce(own, F.concat(safe_stem(project), F.lit("."), F.coalesce(language, F.lit("und"))))


def unique_formats(formats: Column) -> Column:
    return F.array_distinct(formats)


def plain_text(blocks: Column) -> Column:
    """Lines joined by line breaks, blocks by an empty line."""
    return F.array_join(F.transform(blocks, lambda b: F.array_join(F.transform(b["lines"], lambda x: x.text), "\n")), "\n\n")


def document_shape(blocks: Column) -> Column:
    """struct(line_count, lines, position): position is that of the first block."""
    lines = F.flatten(F.transform(blocks, lambda b: b["lines"]))
    return F.struct(F.size(lines).alias("line_count"), F.transform(lines, lambda x: x.text).alias("lines"), F.try_element_at(blocks, F.lit(1)).position.alias("position"))


def redact_base64(text: str | Column) -> Column:
    """Data addresses become a marker with their estimated length; other text stays."""
    t = col(text)
    encoded = F.substring(t, F.instr(t, ";base64,") + 8, F.length(t))
    marker = F.to_json(F.struct(F.lit("base64_data").alias("redacted"), F.floor(F.octet_length(encoded) * 3 / 4).cast("bigint").alias("estimated_byte_length")))
    return F.when(t.startswith("data:") & t.contains(";base64,"), marker).otherwise(t)


def redact_secrets(text: str | Column, secrets: Sequence[str]) -> Column:
    """Every registered literal is replaced; the list is one of the driver's, a few entries long."""
    out = col(text)
    for s in secrets:
        if s:
            out = F.replace(out, F.lit(s), F.lit("[REDACTED]"))
    return out


def sanitize_url(url: str | Column) -> Column:
    return F.regexp_replace(col(url), r"(?s)[?#].*$", "")


def safe_headers(headers: Column, allowed: Sequence[str]) -> Column:
    return F.map_filter(headers, lambda k, _: F.lower(k).isin([a.lower() for a in allowed]))


def error_excerpt(body: str | Column) -> Column:
    return F.substring(col(body), 1, 1000)


def redact_flat_json(details: str | Column) -> Column:
    """Values of secret keys in JSON text without nesting below them, by expression only; see diagnostics.redact_details for any depth."""
    names = "|".join(k.replace("_", "[-_]") for k in SECRET_KEYS)
    return F.regexp_replace(col(details), f'(?i)("(?:{names})"\\s*:\\s*)("(?:[^"\\\\\\\\]|\\\\\\\\.)*"|[^,}}\\]\\s]+)', '$1"[REDACTED]"')
