"""Scalar column expressions on titles and text (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headline_engine import config as C

# Fixed values that must equal the reference's for right results:
# the JavaScript whitespace set removed by trim (White_Space without U+0085,
# plus U+FEFF), the CJK range kept by the title key, the key/token patterns.
JS_SPACE = r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"\x{4e00}-\x{9fa5}"
KEY_DROP = rf"[^{CJK}a-z0-9]"
TOKEN = rf"([{CJK}]|[a-z0-9]+)"
ASCII_LETTER = r"[a-zA-Z]"
NOT_EOL = r"[^\n\r\x{2028}\x{2029}]"
# The same whitespace set as literal characters, for the regex-free char-set trim.
JS_SPACE_CHARS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_title(col) -> Column:
    """Trim the JavaScript whitespace set from both ends (plain trim misses U+3000 etc.).
    btrim removes any character of the set, so no regex runs per line."""
    return F.btrim(_c(col), F.lit(JS_SPACE_CHARS))


def title_key(col) -> Column:
    """Lowercase, keep only CJK ideographs and [a-z0-9]."""
    return F.regexp_replace(F.lower(_c(col)), KEY_DROP, "")


def tokens(title_col, key_col=None, mode: str = "reference") -> Column:
    """Distinct CJK chars / [a-z0-9]+ runs.

    reference mode reads the key (no separators, so a Latin title is one token);
    word mode reads the lowercased title, so separators split words.
    """
    if mode == "reference":
        src = _c(key_col) if key_col is not None else title_key(title_col)
    elif mode == "word":
        src = F.lower(_c(title_col))
    elif mode == "char":
        # Distinct characters of the lowercased, trimmed title
        return F.array_distinct(F.split(clean_title(F.lower(_c(title_col))), ""))
    else:
        raise ValueError(f"unknown token mode {mode!r}")
    return F.array_distinct(F.regexp_extract_all(src, F.lit(TOKEN), 1))


def is_english(col) -> Column:
    """P20: no CJK ideograph and at least one ASCII letter."""
    c = _c(col)
    return (~c.rlike(f"[{CJK}]")) & c.rlike(ASCII_LETTER)


def text_hash(col) -> Column:
    """SHA-256 hex of the UTF-8 bytes."""
    return F.sha2(_c(col), 256)


def unwrap_quotes(col) -> Column:
    """Strip one pair of surrounding double quotes ('"' alone becomes '')."""
    c = _c(col)
    inner = c.substr(F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))
    return F.when(c.startswith('"') & c.endswith('"'), inner).otherwise(c)


def escape_html(col) -> Column:
    """& first, then < > " '."""
    c = _c(col).cast("string")
    for ch, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(ch), F.lit(ent))
    return c


def strip_markdown(col) -> Column:
    """Bold, italic, links, inline code, heading marks (anywhere), in that order."""
    c = _c(col)
    c = F.regexp_replace(c, rf"\*\*({NOT_EOL}*?)\*\*", "$1")
    c = F.regexp_replace(c, rf"\*({NOT_EOL}*?)\*", "$1")
    c = F.regexp_replace(c, rf"\[({NOT_EOL}*?)\]\({NOT_EOL}*?\)", "$1")
    c = F.regexp_replace(c, rf"`({NOT_EOL}*?)`", "$1")
    c = F.regexp_replace(c, rf"#{{1,6}}{JS_SPACE}", "")
    return c


def report_line(n_col, title_col, url_col, source_col) -> Column:
    """P28: 'n. [title](url) - source' when a url is present, else 'n. title - source'."""
    n = _c(n_col).cast("string")
    url = F.coalesce(_c(url_col), F.lit(""))
    return F.when(
        url != "",
        F.concat(n, F.lit(". ["), _c(title_col), F.lit("]("), url, F.lit(") - "), _c(source_col)),
    ).otherwise(F.concat(n, F.lit(". "), _c(title_col), F.lit(" - "), _c(source_col)))


def mode_label(col) -> Column:
    """Display text of a report mode, else the raw value."""
    m = F.create_map(*[x for k, v in C.MODE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[_c(col)], _c(col))


def ua_allowed(col) -> Column:
    """Deny empty/short agents, any deny word, or no allow word (case-insensitive)."""
    ua = F.lower(F.coalesce(_c(col), F.lit("")))
    deny = F.array(*[F.lit(w) for w in C.UA_DENY])
    allow = F.array(*[F.lit(w) for w in C.UA_ALLOW])
    return (
        (F.length(ua) >= 5)
        & ~F.exists(deny, lambda w: F.contains(ua, w))
        & F.exists(allow, lambda w: F.contains(ua, w))
    )


def rank_badge(col) -> Column:
    """P12: 'top' for rank <= 3, 'high' for <= 10, else ''."""
    c = _c(col)
    return F.when(c <= 3, "top").when(c <= 10, "high").otherwise("")


def heat_badge(col) -> Column:
    """P13: 'hot' for >= 20 items, 'warm' for >= 10, else ''."""
    c = _c(col)
    return F.when(c >= 20, "hot").when(c >= 10, "warm").otherwise("")
