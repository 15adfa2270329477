"""Text column expressions: surface, tournament category, sets played, name normalisation.

All are Catalyst expressions (no Python UDF): they stay inside whole-stage codegen.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

# Transliterations that are not plain accent removal (ASCII spelling as used by
# common transliteration tables).
SPECIAL_TRANSLITERATIONS = [
    ("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Ø", "O"), ("ø", "o"), ("Œ", "OE"), ("œ", "oe"),
    ("Đ", "D"), ("đ", "d"), ("Ł", "L"), ("ł", "l"), ("Þ", "Th"), ("þ", "th"), ("Ð", "D"), ("ð", "d"),
]


def _accent_table() -> tuple[str, str]:
    """Rule: every Latin letter U+00C0–U+024F whose canonical decomposition starts with an
    ASCII letter maps to that letter (é → e, Ş → S, ǎ → a)."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = unicodedata.normalize("NFKD", ch)[:1]
        if base and base.isascii() and base.isalpha() and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, UNACCENTED = _accent_table()


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contains_any(s: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(w) for w in words])


def surface_of(name) -> Column:
    """Court surface from a tournament name (NULL → Unknown; explicit tags win; grass
    keywords before clay keywords; default Hard)."""
    s = F.lower(_c(name))
    expr = F.when(_c(name).isNull(), F.lit("Unknown"))
    for tag, surface in params.SURFACE_TAGS:
        expr = expr.when(s.contains(tag), F.lit(surface))
    expr = expr.when(_contains_any(s, params.GRASS_KEYWORDS), F.lit("Grass"))
    expr = expr.when(_contains_any(s, params.CLAY_KEYWORDS), F.lit("Clay"))
    return expr.otherwise(F.lit("Hard"))


def surface_of_market(name) -> Column:
    """Surface from a live market name: 'clay' / 'grass' substring, else Hard."""
    s = F.lower(F.coalesce(_c(name), F.lit("")))
    return F.when(s.contains("clay"), F.lit("Clay")).when(s.contains("grass"), F.lit("Grass")).otherwise(F.lit("Hard"))


def tournament_category(name) -> Column:
    """First keyword of the ordered category list found in the lower-cased name."""
    s = F.lower(F.coalesce(_c(name), F.lit("none")))
    expr = None
    for keyword, category in params.TOURNAMENT_CATEGORIES:
        cond = s.contains(keyword)
        expr = F.when(cond, F.lit(category)) if expr is None else expr.when(cond, F.lit(category))
    return expr.otherwise(F.lit(params.DEFAULT_CATEGORY))


def tokens(text) -> Column:
    """Whitespace tokens of a string (empty tokens removed)."""
    return F.filter(F.split(F.trim(_c(text)), r"\s+"), lambda x: x != "")


def sets_played(score) -> Column:
    """Number of whitespace tokens in a score string; NULL → 0."""
    return F.coalesce(F.size(tokens(score)), F.lit(0)).cast("int")


def strip_accents(name) -> Column:
    s = F.translate(_c(name), ACCENTED, UNACCENTED)
    for src, dst in SPECIAL_TRANSLITERATIONS:
        s = F.replace(s, F.lit(src), F.lit(dst))
    return s


def clean_name(name) -> Column:
    """Accents transliterated, hyphens → spaces, lower case; NULL → ''."""
    return F.coalesce(F.lower(F.replace(strip_accents(name), F.lit("-"), F.lit(" "))), F.lit(""))


def lastname(name) -> Column:
    """Last whitespace token, '' when there is none."""
    t = tokens(name)
    return F.when(F.size(t) > 0, F.element_at(t, -1)).otherwise(F.lit(""))


def initial_lastname(name) -> Column:
    """'Novak Djokovic' → 'N Djokovic' for exactly two tokens; anything else unchanged."""
    t = tokens(name)
    return F.when(F.size(t) == 2, F.concat(F.substring(F.element_at(t, 1), 1, 1), F.lit(" "), F.element_at(t, 2))) \
            .otherwise(_c(name))


def block_key(name) -> Column:
    """Upper-cased first letter of the last name ('' when no last name)."""
    return F.upper(F.substring(lastname(name), 1, 1))


def token_sorted(name) -> Column:
    return F.array_join(F.array_sort(tokens(name)), " ")


def edit_similarity(a, b) -> Column:
    """100 · (1 − levenshtein / longer length); NULL when both are empty."""
    la, lb = F.length(_c(a)), F.length(_c(b))
    m = F.greatest(la, lb)
    return F.when(m > 0, F.lit(100.0) * (F.lit(1.0) - F.levenshtein(_c(a), _c(b)) / m))


def name_similarity(a, b) -> Column:
    """Score 0..100: best of the plain and the token-sorted edit similarity (case-sensitive)."""
    return F.greatest(edit_similarity(a, b), edit_similarity(token_sorted(a), token_sorted(b)))


def hand_default(col) -> Column:
    """Missing handedness → 'U'."""
    return F.coalesce(_c(col), F.lit("U"))


def match_label(competition, event) -> Column:
    """'competition - event' with 'N/A' for missing parts."""
    return F.concat_ws(" - ", F.coalesce(_c(competition), F.lit("N/A")), F.coalesce(_c(event), F.lit("N/A")))


def day_floor_diff(later, earlier) -> Column:
    """Whole days between two instants (floor of the exact difference)."""
    return F.floor((F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(86_400_000_000)).cast("bigint")


def to_utc(col, tz: str | None = None) -> Column:
    """Attach UTC: a zone-less value is read in ``tz`` (default: already UTC) and converted."""
    c = _c(col).cast("timestamp")
    return F.to_utc_timestamp(c, tz) if tz else c
