"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas

#: White space as Python's str.isspace has it.
SPACE = "(?U)[\\s\\x1c-\\x1f]"
#: The ranges of Han characters.
HAN = "㐀-鿿豈-﫿"


def _chain(col: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, col)


def strip(col: Column) -> Column:
    """Without white space at the ends, whatever its kind."""
    return _chain(col, (f"^{SPACE}+|{SPACE}+$", ""))


def no_space(col: Column) -> Column:
    return _chain(col, (SPACE, ""))


def visible_chars(col: Column) -> Column:
    return F.length(no_space(col))


def replacement_chars(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit("�"), F.lit("")))


def strip_han_spaces(col: Column) -> Column:
    """Blanks and tabs between two Han characters removed."""
    return _chain(col, (f"(?<=[{HAN}])[ \\t]+(?=[{HAN}])", ""))


def is_plain_dollars(span: Column) -> Column:
    """Whether an inline $...$ span is money and not mathematics: no command, script or group, and not padded on both sides."""
    inner = F.substring(span, 2, F.length(span) - 2)
    padded = (F.length(inner) >= 2) & inner.rlike(f"^{SPACE}") & inner.rlike(f"{SPACE}$")
    return span.startswith("$") & ~span.startswith("$$") & ~span.rlike(r"[\\^_{}]") & ~padded


def normal_locale(col: Column) -> Column:
    """One of the locales: exact, or by case and underscore, or by language (Chinese by script or region), else the default."""
    c = strip(col)
    low = F.replace(F.lower(c), F.lit("_"), F.lit("-"))
    out = F.when(col.isNull() | (col == ""), "zh-TW")
    for x in schemas.LOCALES:
        out = out.when(low == x.lower(), x)
    return out.when(low.startswith("zh") & low.rlike("hans|cn|sg"), "zh-CN").when(low.startswith("zh"), "zh-TW").when(low.startswith("en"), "en").otherwise("zh-TW")


def strict_locale(col: Column) -> Column:
    return F.when(col.isin(*schemas.LOCALES), col).otherwise("zh-TW")


def cell_span(col: Column) -> Column:
    """A span attribute's leading digits as a number from 1 to 64; 1 without digits."""
    digits = F.regexp_extract(strip(F.coalesce(col, F.lit(""))), "^[0-9]+", 0)
    short = F.greatest(F.lit(1), F.least(F.lit(schemas.MAX_SPAN), F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", "")).try_cast("int")))
    return F.when(F.length(F.ltrim(digits, F.lit("0"))) > 2, schemas.MAX_SPAN).when(digits == "", 1).otherwise(F.coalesce(short, F.lit(1)))


#: The named entities that the pages use, the ampersand last.
ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def entities(col: Column) -> Column:
    """The named entities that the pages use, decoded; the ampersand last, so nothing is decoded twice. For every entity use markup.decode_entities."""
    for name, value in ENTITIES:
        col = F.replace(col, F.lit(name), F.lit(value))
    return col


def download_name(col: Column, longest: int = 200) -> Column:
    """A file name that is safe in a header: no control characters, quotes, separators or runs of blanks; at most so many code points."""
    out = _chain(F.replace(_chain(col, ("[\\x00-\\x1f\\x7f]", "")), F.lit('"'), F.lit("'")), (r"[\\/]", "_"), (f"(?U)[_\\s﻿]+", "_"), ("(?U)^[\\s﻿._]+|[\\s﻿._]+$", ""))
    out = F.when(F.length(out) > longest, _chain(F.substring(out, 1, longest), ("(?U)[\\s﻿._]+$", ""))).otherwise(out)
    return F.when(out == "", "download").otherwise(out)


def stem(col: Column) -> Column:
    return _chain(col, (r"\.[^.]+$", ""))


def size_label(col: Column) -> Column:
    kb, mb = col / 1024, col / (1024 * 1024)
    return F.when(col < 1024, F.concat(col.cast("string"), F.lit(" B"))).when(col < 1024 * 1024, F.concat(F.format_string("%.1f", kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


SKIP_REASONS = ("too_large", "invalid_pdf", "not_pdf", "encrypted_pdf", "empty_pdf", "unsupported", "too_many_files")


def skip_reason_key(col: Column) -> Column:
    code = F.split_part(col, F.lit(" "), F.lit(1))
    return F.when(code.isin(*SKIP_REASONS), F.concat(F.lit("skip_"), code)).otherwise("skip_unknown")


def fill(template: Column, **values: Column) -> Column:
    """A message template with {name} replaced; names without a value, or with a null one, stay."""
    for name, value in values.items():
        template = F.coalesce(F.replace(template, F.lit("{" + name + "}"), value.cast("string")), template)
    return template


def env_bool(col: Column, default: bool) -> Column:
    return F.when(col.isNull(), default).otherwise(F.lower(strip(col)).isin("1", "true", "yes", "on"))


def env_int(col: Column, default: int) -> Column:
    return F.coalesce(strip(col).try_cast("int"), F.lit(default))


def device(col: Column) -> Column:
    """A device setting in lower case: cpu for any CPU, gpu:0 where no card is named."""
    c = F.lower(strip(F.coalesce(col, F.lit(""))))
    return F.when(c.startswith("cpu"), "cpu").when(c.isin("", "auto", "gpu", "cuda"), "gpu:0").otherwise(c)


def heading_lines(col: Column) -> Column:
    """Markdown headings as an array of (level, text)."""
    lines = F.filter(F.split(col, "\n"), lambda x: x.rlike("^#{1,6}[ \\t]+\\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), strip(F.regexp_replace(x, "^#+", "")).alias("text")))


def fingerprint(col: Column) -> Column:
    return no_space(col)


def ascii_name(col: Column) -> Column:
    """The ASCII part of a sanitised name, its extension kept."""
    name = download_name(col)
    has = name.rlike(r"^.+\.[^.]*$")
    base, ext = F.when(has, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name), F.when(has, F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise("")
    base = F.regexp_replace(base, "[^\\x20-\\x7e]", "")
    return F.concat(F.when(base == "", "download").otherwise(base), F.regexp_replace(ext, "[^\\x20-\\x7e]", ""))


def content_disposition(col: Column) -> Column:
    """A header value with an ASCII name and the whole name in percent encoding (RFC 5987)."""
    whole = F.replace(F.replace(F.url_encode(download_name(col)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    whole = F.replace(F.replace(whole, F.lit("%7E"), F.lit("~")), F.lit("%21"), F.lit("!"))
    return F.concat(F.lit('attachment; filename="'), ascii_name(col), F.lit("\"; filename*=UTF-8''"), whole)
