"""Text normalisers as Column expressions, and the two similarity ratios that need Python."""

from __future__ import annotations

import html
import re
from html.entities import html5
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import clean, finite

# Surface spellings
SURFACES = {
    "native material": "Native",
    "native": "Native",
    "earth": "Native",
    "soil": "Native",
    "dirt": "Native",
    "imported compacted material": "Compacted gravel",
    "crushed aggregate or gravel": "Gravel",
    "imported loose material": "Gravel",
    "gravel": "Gravel",
    "asphalt": "Paved",
    "concrete": "Paved",
    "snow": "Snow",
}


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), key)


def title(text: Column) -> Column:
    """Upper case after every character that isn't a letter, lower case elsewhere."""
    marked = F.regexp_replace(F.lower(text), r"(\p{L}+)", "\u0001$1")
    return F.array_join(F.transform(F.split(marked, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def key_name(text: Column) -> Column:
    """A name as a join key: trimmed, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def surface(text: Column) -> Column:
    """Without its code prefix, spellings merged."""
    bare = F.trim(F.regexp_replace(clean(text), r"^[A-Z]{1,4}\s*-\s*", ""))
    bare = F.when(bare != "", bare)
    return F.coalesce(lookup(SURFACES, F.lower(bare)), title(bare))


def area(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(clean(text), r"^[A-Z]{2,4}\s*-\s*", ""))
    return F.when(bare != "", title(bare))


def grade(text: Column) -> Column:
    """struct(min_pct, max_pct, label) of "12-20%", or NULL."""
    low, high = (F.regexp_extract(text, r"(\d+)\s*-\s*(\d+)\s*%", i).try_cast("int") for i in (1, 2))
    small, large = F.least(low, high), F.greatest(low, high)
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(small.alias("min_pct"), large.alias("max_pct"), F.concat(small, F.lit("-"), large, F.lit("%")).alias("label")))


def trail_class(text: Column) -> Column:
    """1 to 5, or NULL."""
    number = finite(text).cast("int")
    return F.when(number.between(1, 5), number)


def season(text: Column) -> Column:
    """struct(label, months, year_round) of "MM/DD-MM/DD"; a window may wrap the new year."""
    part = lambda i: F.regexp_extract(clean(text), r"(\d{1,2})/(\d{1,2})\s*-\s*(\d{1,2})/(\d{1,2})", i).try_cast("int")
    sm, sd, em, ed = (part(i) for i in range(1, 5))
    months = F.when(sm <= em, F.sequence(sm, em)).otherwise(F.concat(F.sequence(sm, F.lit(12)), F.sequence(F.lit(1), em)))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    label = F.concat(two(sm), F.lit("/"), two(sd), F.lit("-"), two(em), F.lit("/"), two(ed))
    whole = (sm == 1) & (sd == 1) & (em == 12) & (ed == 31)
    return F.when(sm.between(1, 12) & em.between(1, 12), F.struct(label.alias("label"), months.alias("months"), whole.alias("year_round")))


def plain(source: Column, limit: int | None = None, open_entities: bool = True) -> Column:
    """Text of HTML: block tags become new lines, other tags go, entities are undone, blanks collapse.

    With ``open_entities=False`` an entity without its semicolon, as &amp at the end of a text that was cut, is left alone.
    """
    text = F.regexp_replace(source, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = F.when(F.contains(text, F.lit("&")), unescaped(F.when(F.contains(text, F.lit("&")), text), open_entities)).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    text = F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")
    return F.when(text != "", text if limit is None else F.substring(text, 1, limit))


def unescaped(text: Column, open_entities: bool = True) -> Column:
    """Text with HTML entities undone, of which there are over two thousand: in pandas. See plain for open_entities."""

    def closed(t: str) -> str:
        return re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], t)

    @F.pandas_udf("string")
    def undo(s: pd.Series) -> pd.Series:
        return s.map(html.unescape if open_entities else closed, na_action="ignore")

    return undo(text)


def opl_decoded(text: Column) -> Column:
    """Text of the OPL format, whose odd characters are written as %hex%."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.str.replace(r"%([0-9a-fA-F]+)%", lambda m: chr(int(m[1], 16)), regex=True)

    return decode(text)


def max_number(text: Column) -> Column:
    """The largest number in a text like "10 to 25 mph", or NULL."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double")))


# Words too common to be evidence of a place
PLACE_STOPWORDS = [
    "trail", "trails", "creek", "lake", "river", "fork", "canyon", "national",
    "forest", "park", "the", "of", "and", "north", "south", "east", "west",
    "upper", "lower", "big", "little", "mount", "mt",
]


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-case runs of letters and digits of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= least))


def place_tokens(*texts: Column) -> Column:
    return F.array_except(tokens(F.concat_ws(" ", *texts), 3), F.array(*[F.lit(w) for w in PLACE_STOPWORDS]))


# Hints in a photo's title, and what they add to its score
SCENERY = ["trail", "falls", "waterfall", "lake", "peak", "summit", "view", "vista", "valley", "canyon", "dome", "creek", "river", "meadow", "ridge", "pass", "panorama", "landscape", "overlook", "sunset", "sunrise", "mountain"]
ELSEWHERE = ["iss0", "iss ", "view of earth", "from space", "satellite", "landsat", "sentinel-", "aerial view", "from orbit", "space shuttle", "astronaut", "topographic map", "usgs map", "diagram", "logo", "coat of arms", "poster"]
INDOORS = ["dinner", "cooking", "breakfast", "lunch", "condo", "resort", "hotel", "motel", "wedding", "bedroom", "kitchen", "bathroom", "restaurant", "casino", "lobby", "interior", "room ", "buffet", "cocktail", "spa", "gondola ride", "ski lift", "parking garage", "storefront", "shopping", "airport", "conference"]
SPECIES = ["aceraceae", "pinus", "quercus", "abies", "juniperus", "arctostaphylos", "marmota", "sciurus", "spermophilus", "corvus", "insect", "fungi", "lichen", "flower", "botany", "herbarium", "specimen"]
CAMERA = ["dsc_", "dscn", "img_", "p10", "cimg", "_mg_", "dscf"]
HINTS = [(SCENERY, 2.0), (ELSEWHERE, -6.0), (INDOORS, -4.5), (SPECIES, -2.5), (CAMERA, -1.5)]


def photo_relevance(name: Column, place: Column) -> Column:
    """How likely a photo with this title shows the place with these tokens; 0 without a title."""
    low = F.lower(name)
    shared = F.size(F.array_intersect(tokens(low, 3), place))
    score = F.lit(1.0) + F.when(shared > 0, 4.0 + F.least(F.lit(2.0), shared - 1.0)).otherwise(0.0)
    for words, points in HINTS:
        score += F.when(low.rlike("|".join(words)), points).otherwise(0.0)
    bare = F.replace(F.regexp_replace(F.replace(low, F.lit("file:"), F.lit("")), r"\.[^.]*$", ""), F.lit(" "), F.lit(""))
    score += F.when(bare.rlike("^[0-9]+$"), -2.0).otherwise(0.0)
    return F.when(F.coalesce(name, F.lit("")) == "", 0.0).otherwise(score)


def open_licence(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike("^(cc0|cc by|cc-by|public domain|pd)")


# Ratios of matching text. Spark has levenshtein, a different measure, so these run in pandas.


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, on the bits of one number a row."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * LCS / total length; two empty texts are alike."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer of at most its length."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    n = len(short)
    return max(ratio(short, long_[max(0, i) : i + n]) for i in range(1 - n, len(long_)))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared words, shared and own words of a, shared and own words of b."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    return max([ratio(left, right)] + ([ratio(both, left), ratio(both, right)] if both else []))


def name_signal(query: str, name: Column, partial_only: bool = False) -> Column:
    """The larger of both ratios of a name with the query, Arrow batch by batch."""

    @F.pandas_udf("double")
    def signal(s: pd.Series) -> pd.Series:
        def one(t):
            return None if t is None else partial_ratio(query, t) if partial_only else max(token_set_ratio(query, t), partial_ratio(query, t))

        known = {t: one(t) for t in s.unique()}
        return s.map(known).astype("float64")

    return signal(name)


def _bag(query: str, text: Column) -> Column:
    """How many letters of the query the text can supply, each as often as it has it."""
    each = [F.least(F.lit(query.count(c)), F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) for c in sorted(set(query))]
    return sum(each, F.lit(0))


def _grams(query: str, text: Column) -> Column:
    """How many pairs of neighbouring letters of the query, at their places, the text has anywhere."""
    pairs = [query[i : i + 2] for i in range(len(query) - 1)]
    return sum((F.contains(text, F.lit(g)).cast("int") * pairs.count(g) for g in sorted(set(pairs))), F.lit(0))


def signal_bound(query: str, name: Column, partial_only: bool = False) -> Column:
    """At least name_signal(query, name), from letters and pairs of letters alone; no Python.

    A common subsequence of L letters needs L letters of both texts. It keeps a pair of
    neighbours of the query unless one of them is left out or the other text has a letter
    between them, so with C pairs in common 3 L <= C + 1 + the sum of both lengths. The ratio of
    the query with a stretch of the name is bounded for stretches of the query's length and
    for the shorter ones at each end of the name; that of the words for names without a word in common.
    """
    n, size = len(query), F.length(name)
    if n == 0:
        return F.lit(100.0)

    def most(letters: Column, pairs: Column, width: Column) -> Column:
        """200 L / (n + width) at its largest."""
        room = F.least(letters, width, F.lit(n), F.floor((pairs + n + 1 + width) / 3))
        return 200.0 * room / (width + n)

    letters, pairs = _bag(query, name), _grams(query, name)
    whole = most(letters, pairs, F.lit(n))
    for end in (F.left(name, F.lit(n - 1)), F.right(name, F.lit(n - 1))):
        own, near = _bag(query, end), _grams(query, end)
        for width in range(1, n):
            whole = F.greatest(whole, most(own, near, F.lit(width)))
    bound = F.when(size >= n, whole).otherwise(200.0 * F.least(letters, size) / (F.least(letters, size) + size))
    bound = F.when(size == 0, 0.0).otherwise(bound)
    if partial_only:
        return bound
    words = sorted(set(query.split()))
    joined = " ".join(words)
    theirs = F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    length = F.length(F.array_join(theirs, " "))
    inner = sum((_grams(w, name) for w in words), F.lit(0)) + 2 * joined.count(" ")
    apart = 200.0 * F.least(_bag(joined, name), F.lit(len(joined)), length, F.floor((inner + len(joined) + 1 + length) / 3)) / (length + len(joined))
    shares = F.arrays_overlap(theirs, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)
    return F.greatest(bound, F.when(shares, 100.0).otherwise(apart))
