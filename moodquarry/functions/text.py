"""Text expressions. Every function takes and returns a Column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits of the cleaning rules.
MAX_CLEAN_LENGTH = 5000
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_PATTERN = f"[{SPACES}]+"
WORD_PATTERN = f"[^{SPACES}]+"
URL_PATTERN = rf"http[^{SPACES}]+|www\.[^{SPACES}]+"
TAG_PATTERN = "<[^>]+>"
TOKEN_PUNCTUATION = "\"#$%&'()*+,-/:;<=>@[\\]^_`{|}~"  # all ASCII punctuation but ! ? .

# The characters of SPACES, for trimming.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# All of SPACES but blanks and line feeds; and a pattern that is searched faster, a set of single characters and one range, which none of them escapes.
RARE_SPACE = "[" + SPACES.replace(r"\t-\r", r"\t\x0b-\r").replace(r"\x1c-\x20", r"\x1c-\x1f") + "]"
MAY_BE_SPACE = r"[\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x{85}\x{a0}\x{1680}-\x{3000}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(_col(c), F.lit(SPACE_CHARS))


def _once(c: Column, then) -> Column:
    """`then` of a value that is found once, however often it is used."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def collapse_spaces(c: Column) -> Column:
    """One blank for each run of white space. Replacing characters one by one is slow, so only texts that need it get it."""
    rare = lambda t: F.when(F.rlike(t, F.lit(MAY_BE_SPACE)), F.rlike(t, F.lit(RARE_SPACE))).otherwise(False)
    plain = lambda t: F.when(rare(t), F.translate(t, SPACE_CHARS, " " * len(SPACE_CHARS))).otherwise(t)
    single = lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, F.lit("  +"), F.lit(" "))).otherwise(t)
    return _once(_once(F.replace(c, F.lit("\n"), F.lit(" ")), plain), single)


def _without(c: Column, url: str, tag: str) -> Column:
    """Replace URLs, then tags. A plain byte search spares most texts the patterns."""
    marked = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www.")) | F.contains(c, F.lit("<"))
    replaced = F.regexp_replace(c, F.lit(URL_PATTERN), F.lit(url))
    return F.when(marked, F.regexp_replace(replaced, F.lit(TAG_PATTERN), F.lit(tag))).otherwise(c)


def clean_text(c: Column | str, max_len: int | None = None) -> Column:
    """Drop URLs and tags, collapse white space, cut if `max_len` is given, trim; null becomes ''."""
    text = collapse_spaces(_without(F.coalesce(_col(c), F.lit("")), "", ""))
    return F.trim(F.substring(text, 1, max_len) if max_len else text)


def clean_text_keep_gap(c: Column | str) -> Column:
    """As `clean_text`, but a tag leaves a blank and nothing is cut."""
    return F.trim(collapse_spaces(_without(F.coalesce(_col(c), F.lit("")), "", " ")))


def clean_for_tokens(c: Column | str, lower: bool = True) -> Column:
    """Lower case, no URLs, tags or punctuation other than `! ? .`, single blanks."""
    text = F.coalesce(_col(c), F.lit(""))
    # The URL marker looks like a tag and goes with the tags, leaving a blank.
    text = _without(F.lower(text) if lower else text, "<URL>", " ")
    # A pattern of ASCII characters is faster than `translate`, which makes a string of each character.
    text = F.regexp_replace(text, F.lit("[" + "".join(f"\\{x}" for x in TOKEN_PUNCTUATION) + "]"), F.lit(" "))
    return F.trim(collapse_spaces(text))


def text_hash(c: Column | str, algo: str = "md5") -> Column:
    if algo == "md5":
        return F.md5(_col(c))
    if algo == "sha256":
        return F.sha2(_col(c), 256)
    raise ValueError(f"unknown hash {algo!r}")


def cache_key(c: Column | str, kind: str) -> Column:
    return F.concat(F.lit(f"sentiment:{kind}:"), F.md5(_col(c)))


def text_length(c: Column | str) -> Column:
    return F.length(_col(c))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(WORD_PATTERN))


def preview(c: Column | str, n: int) -> Column:
    text = _col(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def body_or_title(body: Column | str, title: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(body), F.lit("")), _col(title))


def article_text(title: Column | str, body: Column | str, n: int = 500) -> Column:
    return F.concat(_col(title), F.lit(" "), F.substring(_col(body), 1, n))
