"""Title and name functions for comparison. Nothing here rewrites stored text.

All are column expressions except NFC, script blocks and number phrases, which are Arrow-batched
pandas UDFs. Letters and digits mean Unicode Alphabetic and Number; lower case is Unicode's.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALNUM = r"\p{IsAlphabetic}\p{N}"
SPACES = r"(?U)\s+"

#: Words that mark a version of an album and of a track, names that say nothing, suffixes of formats.
ALBUM_QUALIFIERS = ["live", "remix", "remixed", "acoustic", "deluxe", "remaster", "remastered", "demo", "edit", "instrumental", "anniversary"]
TRACK_QUALIFIERS = ["live", "remix", "demo", "acoustic", "edit", "remaster", "remastered", "mix", "version", "instrumental", "radio", "extended"]
UNUSABLE = ["", "unknown album", "unknown artist", "unknown track"]
FORMAT_SUFFIXES = ["ep", "lp", "cd", "cd1", "cd 1", "cd2", "cd 2", "disc 1", "disc 2", "2cd", "2xcd"]
ONES = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]

#: ASCII punctuation and the blocks of punctuation that may stand for a title, as a regular expression's ranges.
PUNCTUATION = r"!-/:-@\[-`{-~‐-‧‰-⁞⸀-⹿、-〠〰︐-︟︰-﹏！-／：-＠［-｀｛-･"

#: Number words from zero to ninety-nine, by rule.
NUMBERS = {w: n for n, w in enumerate(ONES)} | {t: 20 + 10 * i for i, t in enumerate(TENS)} | {f"{t} {u}": 20 + 10 * i + n for i, t in enumerate(TENS) for n, u in enumerate(ONES[1:10], 1)}


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode normalization form C."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def collapse(x: Column) -> Column:
    """Trimmed, with each run of white space one space."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def normalize(x: Column) -> Column:
    """White space folded and lower case; punctuation stays."""
    return F.lower(collapse(x))


def title_typography(x: Column, composed: bool = True) -> Column:
    """NFC, typographic hyphens and apostrophes as ASCII. composed=False leaves out NFC for text known to be composed, and with it Python."""
    return F.translate(nfc(x) if composed else x, "‐‑‘’ʼ＇", "--''''")


def presentation_title(x: Column) -> Column:
    """Without one pair of brackets around the whole title, if there are none inside."""
    t = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    inner = F.coalesce(*[F.nullif(F.regexp_extract(t, rf"(?s)^{o}\s*([^\[\](){{}}]*[^\[\](){{}}\s])\s*{c}$", 1), F.lit("")) for o, c in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}"))])
    return F.coalesce(inner, t)


def normalize_album_title(x: Column, composed: bool = True) -> Column:
    return normalize(title_typography(presentation_title(x), composed))


name_key = normalize_album_title


def _words_only(x: Column, keep: str) -> Column:
    return F.trim(F.regexp_replace(x, f"[^{ALNUM}{keep}]+", " "))


def album_representation_title(x: Column, composed: bool = True) -> Column:
    """Lower-case words, with & and + kept."""
    return _words_only(F.lower(nfc(x) if composed else x), "&+")


def comparison_title(x: Column, composed: bool = True) -> Column:
    """Words of the normalized title; & between spaces reads and."""
    words = _words_only(normalize_album_title(presentation_title(x), composed), "&")
    return F.array_join(F.transform(F.split(words, " "), lambda w: F.when(w == "&", F.lit("and")).otherwise(w)), " ")


def punctuation_placeholder(x: Column) -> Column:
    """Not blank, and nothing but white space and punctuation of the listed blocks."""
    return x.rlike(rf"(?U)^[\s{PUNCTUATION}&&[^{ALNUM}]]*$") & x.rlike(r"(?U)\S")


def _short_long(a: Column, b: Column) -> tuple[Column, Column]:
    first = F.octet_length(a) < F.octet_length(b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def _n_alnum(x: Column) -> Column:
    return F.regexp_count(x, F.lit(f"[{ALNUM}]"))


def shared_title_span(left: Column, right: Column, composed: bool = True) -> Column:
    """The shorter normalized title where the longer one holds it between non-word characters, else null."""
    a, b = normalize_album_title(left, composed), normalize_album_title(right, composed)
    short, long = _short_long(a, b)
    quoted = F.concat(F.lit(r"\Q"), F.replace(short, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    found = F.regexp_like(long, F.concat(F.lit(rf"(?<![{ALNUM}\p{{M}}])"), quoted, F.lit(rf"(?![{ALNUM}\p{{M}}])")))
    return F.when((a != b) & (_n_alnum(short) >= 2) & found, short)


ALTERNATE = T.StructType([T.StructField("layout", T.StringType()), T.StructField("first", T.StringType()), T.StructField("second", T.StringType())])


def _alternate(title: str | None) -> tuple[str, str, str] | None:
    if title is None or any(c in title for c in "()[]"):
        return None
    for separator, layout in ((" - ", "spaced_hyphen"), (" – ", "spaced_en_dash"), (" — ", "spaced_em_dash")):
        parts = title.split(separator)
        if len(parts) > 1:
            return (layout, *parts) if len(parts) == 2 and all(any(c.isalnum() for c in p) for p in parts) else None
    kinds = []
    words = title.split()
    for word in words:
        latin = {bool(re.match(r"[A-Za-zÀ-ɏḀ-ỿ]", c)) for c in word if c.isalpha()}
        if len(latin) != 1:
            return None
        kinds.append(latin.pop())
    turns = [i for i in range(1, len(words)) if kinds[i] != kinds[i - 1]]
    return ("whitespace_blocks", " ".join(words[: turns[0]]), " ".join(words[turns[0] :])) if len(turns) == 1 else None


@F.pandas_udf(ALTERNATE)
def _alternates(titles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_alternate(t) or (None, None, None) for t in titles], columns=["layout", "first", "second"])


def alternate_title_components(x: Column, composed: bool = True) -> Column:
    """(layout, first, second) where a title reads as two representations, by a spaced dash or one change of script between words; null fields else."""
    return _alternates(normalize_album_title(x, composed))


def exact_alternate_component(left: Column, right: Column, composed: bool = True) -> Column:
    """True where one title is a whole component of the other."""
    a, b = normalize_album_title(left, composed), normalize_album_title(right, composed)
    part = lambda x, y: F.coalesce((x["first"] == y) | (x["second"] == y), F.lit(False))
    return (a != b) & (part(alternate_title_components(left, composed), b) | part(alternate_title_components(right, composed), a))


def arbitrary_title_fragment(left: Column, right: Column, composed: bool = True) -> Column:
    """One title holds the other, but neither as a component nor between word boundaries."""
    short, long = _short_long(normalize_album_title(left, composed), normalize_album_title(right, composed))
    return (short != long) & (short != "") & F.contains(long, short) & ~exact_alternate_component(left, right, composed) & shared_title_span(left, right, composed).isNull()


def usable(x: Column) -> Column:
    return ~normalize(x).isin(UNUSABLE)


def credit(names: Column) -> Column:
    """Names joined by commas, normalized; null if there are none or one is unusable."""
    return F.when((F.size(names) > 0) & F.forall(names, usable), normalize(F.array_join(names, ", ")))


def artist_album_title(title: Column, artist: Column) -> Column:
    """What follows "{artist} on " in a title, else null."""
    prefix = F.concat(F.trim(artist), F.lit(" on "))
    rest = F.substr(title, F.char_length(prefix) + 1)
    return F.when((normalize(F.left(title, F.char_length(prefix))) == normalize(prefix)) & (F.trim(rest) != ""), rest)


def artist_album_discovery_variant(artist: Column, title: Column) -> Column:
    base = F.regexp_replace(F.trim(title), "(?i) live$", "")
    good = base.rlike(r"^\p{IsAlphabetic}{4,40}$") & ~normalize(base).isin("live", "demo", "remaster", "acoustic") & (F.trim(artist) != "")
    return F.when(good, F.concat(F.trim(artist), F.lit(" on "), base, F.lit(" Live")))


def literal_search_component(title: Column) -> Column:
    """The run of ASCII with most letters and digits (three at least; the last of equals) in a title that also has other letters."""
    count = lambda s: F.regexp_count(s, F.lit("[A-Za-z0-9]"))
    runs = F.transform(F.split(title, r"[^\x00-\x7F]"), lambda s: F.regexp_replace(s, r"^[\s()\[\]/-]+|[\s()\[\]/-]+$", ""))
    ranked = F.transform(F.filter(runs, lambda s: count(s) >= 3), lambda s, i: F.struct(count(s).alias("n"), i.alias("i"), s.alias("s")))
    return F.when(title.rlike(r"[\p{IsAlphabetic}&&[^\x00-\x7F]]"), F.array_max(ranked)["s"])


def edit_close(left: Column, right: Column, limit: int, least: int) -> Column:
    a, b = normalize(left), normalize(right)
    return (F.char_length(a) >= least) & (F.char_length(b) >= least) & (F.levenshtein(a, b, limit) >= 0)


def album_qualifiers(x: Column) -> Column:
    words = F.filter(F.split(normalize(x), f"[^{ALNUM}]+"), lambda w: w != "")
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.filter(words, lambda w: w.isin(ALBUM_QUALIFIERS)))


def track_qualifiers(x: Column) -> Column:
    return F.filter(F.split(x, SPACES), lambda w: w.isin(TRACK_QUALIFIERS))


def close_album_title(left: Column, right: Column, composed: bool = True, limit: int = 1, least: int = 5) -> Column:
    return (album_qualifiers(left) == album_qualifiers(right)) & edit_close(normalize_album_title(left, composed), normalize_album_title(right, composed), limit, least)


def album_title_variants(x: Column, composed: bool = True) -> Column:
    """Titles without a trailing format, with the kind of release that they need: array of (title, requires_ep, requires_album)."""
    key = normalize_album_title(x, composed)

    def variant(suffix: str, ending: str) -> Column:
        base = F.trim(F.left(key, F.char_length(key) - len(ending)))
        return F.when(F.endswith(key, F.lit(ending)) & (base != "") & ~F.endswith(base, F.lit(" -")), F.struct(base.alias("title"), F.lit(suffix == "ep").alias("requires_ep"), F.lit(suffix == "lp").alias("requires_album")))

    return F.array_distinct(F.array_compact(F.array(*[variant(s, e) for s in FORMAT_SUFFIXES for e in (f" - {s}", f" ({s})", f" [{s}]", f" {s}")])))


def numeric_title(x: Column) -> Column:
    """A title that is a number word from zero to ninety-nine as digits; else normalized, with hyphens as spaces."""
    value = F.replace(normalize(x), F.lit("-"), F.lit(" "))
    words = F.create_map(*[F.lit(v) for w, n in NUMBERS.items() for v in (w, str(n))])
    return F.coalesce(words[collapse(value)], value)


def _number_phrase(value: str | None) -> str | None:
    if value is None:
        return None
    words, out, i = value.split(), [], 0
    while i < len(words):
        one, two = NUMBERS.get(words[i].lower()), NUMBERS.get(" ".join(words[i : i + 2]).lower()) if i + 1 < len(words) else None
        if two is not None:
            out.append(str(two))
            i += 2
            continue
        out.append(str(one) if one is not None and one >= 10 else words[i])
        i += 1
    return " ".join(out)


@F.pandas_udf(T.StringType())
def number_phrase(values: pd.Series) -> pd.Series:
    """Number words of ten and more in a phrase as digits; small ones keep their meaning."""
    return values.map(_number_phrase)


def numeric_equivalent(a: Column, b: Column) -> Column:
    return (numeric_title(a) == numeric_title(b)) | (number_phrase(a) == number_phrase(b))


def contextual_title_class(left: Column, right: Column) -> Column:
    """album_version, punctuation, token_boundary, article_in_program or tiny_typo, by the first that fits; else null. Callers must establish the context and give titles in NFC (select nfc() first), as lambdas can't hold it."""
    a, b = normalize_album_title(left, False), normalize_album_title(right, False)
    base = lambda s: F.regexp_replace(s, r" \(album version\)$| - album version$", "")
    undotted = lambda s: comparison_title(F.replace(s, F.lit("."), F.lit("")), False)
    x, y = comparison_title(left, False), comparison_title(right, False)
    compact = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    wide = lambda s: F.forall(F.split(s, " "), lambda w: F.char_length(w) >= 2)

    def article(long: Column, short: Column) -> Column:
        w, v = F.split(long, " "), F.split(short, " ")
        without = lambda i: F.concat(F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.greatest(F.size(w) - i - 1, F.lit(0))))
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1)))
        return (F.size(v) >= 6) & (F.size(w) == F.size(v) + 1) & F.exists(places, lambda i: (F.get(w, i) == "the") & (without(i) == v))

    mixed = lambda s: F.exists(F.split(s, SPACES), lambda w: w.rlike("[A-Za-z]") & w.rlike(r"[\p{IsAlphabetic}&&[^\x00-\x7F]]"))
    size = F.char_length(x)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(x, i, F.lit(1)) != F.substr(y, i, F.lit(1)))
    i, j = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    at = lambda s, k: F.substr(s, k, F.lit(1))
    swapped = (size >= 8) & (size == F.char_length(y)) & (F.size(differ) == 2) & (j == i + 1) & (at(x, i) == at(y, j)) & (at(x, j) == at(y, i))
    apostrophe = left.rlike("['’]") | right.rlike("['’]")
    fragment = arbitrary_title_fragment(left, right, False) & (mixed(left) | mixed(right))
    same_words = album_qualifiers(left) == album_qualifiers(right)
    return (
        F.when((a != b) & (base(a) == base(b)), "album_version")
        .when(~same_words, F.lit(None).cast("string"))
        .when((undotted(a) == undotted(b)) & (undotted(a) != ""), "punctuation")
        .when((x != y) & (compact(x) == compact(y)) & (F.char_length(compact(x)) >= 4) & wide(x) & wide(y), "token_boundary")
        .when(article(x, y) | article(y, x), "article_in_program")
        .when(apostrophe | fragment, F.lit(None).cast("string"))
        .when(edit_close(x, y, 1, 4) | swapped, "tiny_typo")
    )


def extended_title(local: Column, provider: Column) -> Column:
    """The provider's title is the local one and a bracketed addition."""
    a, b = normalize(local), normalize(provider)
    return F.startswith(b, F.concat(a, F.lit(" ("))) & F.endswith(b, F.lit(")"))


def search_tokens(x: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(x), f"[^{ALNUM}]+"), lambda w: w != "")


def query_tokens(text: str, most: int = 12) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w][:most]


def matches_all_prefixes(tokens: Column, query: list[str]) -> Column:
    """Every word of the query begins one of the tokens."""
    out = F.lit(bool(query))
    begins = lambda word: lambda t: F.startswith(t, F.lit(word))
    for word in query:
        out = out & F.exists(tokens, begins(word))
    return out


def score_tier(title: Column, text: str) -> Column:
    """0 the whole title, 1 its beginning, 2 some of its words."""
    wanted = text.strip().lower()
    return F.when(F.lower(title) == wanted, 0).when(F.startswith(F.lower(title), F.lit(wanted)), 1).otherwise(2)
