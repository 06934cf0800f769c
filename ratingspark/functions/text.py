"""String column expressions (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score marker is a run of ASCII digits in double square brackets,
# and the default score when no marker is found is 3.
SCORE_PATTERN = r"\[\[([0-9]+)\]\]"
DEFAULT_SCORE = 3

# Word tokens: two or more letters, digits or underscores (Unicode aware), after lower-casing.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Fixed value: characters allowed in a file name stem; everything else becomes "_".
UNSAFE_NAME_CHARS = r"[^a-zA-Z0-9_\-]"

# Fixed value: prefix that marks a failed enrichment row.
ERROR_PREFIX = "ERROR: "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_score(text, default: int | None = DEFAULT_SCORE, strict: bool = False) -> Column:
    """First ``[[digits]]`` marker as INT; no range check.

    Missing marker, NULL input or a number too large for INT give ``default``
    (NULL when ``strict``).
    """
    raw = F.regexp_extract(_c(text), SCORE_PATTERN, 1)
    parsed = F.nullif(raw, F.lit("")).try_cast("int")
    if strict or default is None:
        return parsed
    return F.coalesce(parsed, F.lit(int(default)))


def clean_url(url, keep: str = "v") -> Column:
    """Keep only query parameter ``keep`` (all non-blank values, in order).

    Scheme is lower-cased; path, parameters and fragment stay; an empty query or
    fragment is dropped, as URL un-parsing does.
    """
    u = _c(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1))
    base = F.regexp_replace(F.regexp_extract(u, r"^([^?#]*)", 1), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    frag = F.regexp_extract(u, r"#(.*)$", 1)
    prefix = keep + "="
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda x: x.startswith(prefix) & (F.length(x) > len(prefix))), "&"
    )
    return F.concat(
        scheme,
        base,
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )


def absolute_link(suffix, prefix: str) -> Column:
    return F.concat(F.lit(prefix), _c(suffix))


def sanitize_name(name) -> Column:
    return F.regexp_replace(_c(name), UNSAFE_NAME_CHARS, "_")


# Hosts whose links are taken for videos.
VIDEO_HOSTS = ("youtube.com", "youtu.be")


def host_matches(url, hosts=VIDEO_HOSTS) -> Column:
    u = _c(url)
    cond = F.lit(False)
    for h in hosts:
        cond = cond | u.contains(h)
    return F.coalesce(cond, F.lit(False))


def title_has(title, keyword: str) -> Column:
    return F.coalesce(F.lower(_c(title)).contains(keyword.lower()), F.lit(False))


# Leading / trailing whitespace as Python's str.strip() sees it (ASCII controls and Unicode spaces).
WS_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip_ws(text) -> Column:
    return F.regexp_replace(_c(text), WS_EDGES, "")


def preview(text, n: int = 200) -> Column:
    """Stripped text, first ``n`` characters."""
    return F.substring(strip_ws(text), 1, n)


def tokens(text) -> Column:
    """Lower-cased word tokens of two or more word characters, in text order."""
    return tokens_of_lower(F.lower(_c(text)))


def tokens_of_lower(lower) -> Column:
    """:func:`tokens` of a text that is in lower case already."""
    return F.regexp_extract_all(_c(lower), F.lit(TOKEN_PATTERN), 0)


def token_bound(lower, place) -> Column:
    """How many characters of the lower-case text lie before the tokens that begin at its character ``place`` (1-based) or later.

    A token that the place cuts belongs where it begins, so the place moves to its end: the text falls into two parts there,
    whose tokens together are its tokens.
    """
    t, word = _c(lower), TOKEN_PATTERN.removesuffix("{2,}")
    at = F.greatest(_c(place), F.lit(1))
    rest = F.regexp_extract(F.substring(t, at, F.length(t)), f"^{word}+", 0)
    cut = F.substring(t, at - 1, F.lit(1)).rlike(f"^{word}$") & (at > 1)
    return at - 1 + F.when(cut, F.length(rest)).otherwise(0)


def token_range(text, start, end) -> list[Column]:
    """The tokens of ``text`` that begin at its characters ``start`` to ``end`` (1-based; ``end`` lies beyond the span):
    ``first_token`` (from 0) and ``n_tokens``. The tokens before each bound are counted: linear in the text, without a list of offsets.
    """
    t = F.lower(_c(text))

    def before(place: Column) -> Column:
        return F.size(tokens_of_lower(F.substring(t, F.lit(1), token_bound(t, place))))

    first = before(_c(start))
    return [first.alias("first_token"), F.greatest(before(_c(end)) - first, F.lit(0)).alias("n_tokens")]


def is_error(text) -> Column:
    return F.coalesce(_c(text).startswith(ERROR_PREFIX), F.lit(False))


def html_title(html) -> Column:
    return F.regexp_extract(_c(html), r"<title>(.*?)</title>", 1)
