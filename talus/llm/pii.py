"""PII: format-preserving Feistel pseudonyms, in SQL expressions only.

Validated values are permuted by a keyed Feistel network within their own format, so a
pseudonym is again valid (Luhn digit, octets, calendar, SSN ranges), two values never
share one, and equal values stay linked across documents:

card    13 to 19 digits with a right Luhn digit: the other digits are permuted, the
        Luhn digit is made anew; separators stay
ssn     area, group and serial in their assigned ranges
phone   ten national digits after an optional +1; punctuation and +1 stay
ip      four octets: 32 bits
date    yyyy-mm-dd, mm/dd/yyyy or dd.mm.yyyy from 1900 to 2099: a day of the same century
email   not a number: the whole address becomes a keyed hash at example.invalid

What looks alike but fails its validation stays as it is; where numbers of 13 digits and
more stand side by side, cards are looked for at their separators, from left to right, the
longest first. The halves of each network are
added modulo two factors whose product is exactly the size of the format, so no value has
to be walked back into it.

Defined results: a null text stays null with nothing replaced; an empty one stays empty;
repeated rows give repeated rows; all other columns pass through; an empty table gives an
empty result; a very long text is one row as any other, and no pattern recurses or goes
back along a run of numbers, dots, dashes or digits, so time is linear in its length. The key is a parameter, which
who holds can undo the permutations: the queries read it from the session's
``spark.talus.pii.key``, and only without that setting use a public one, for demonstration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

KEY_SETTING, DEMONSTRATION_KEY, ROUNDS = "spark.talus.pii.key", "demonstration", 8
_NUMBERS = 512  # of a run of numbers that are put together at a time
# No group is repeated but possessively: Java runs those as a loop, the others by a call each turn.
_LABEL = r"[A-Za-z0-9\-]++"
#: An address with all its host; what follows the last label of two letters or more goes back (_email).
EMAIL = (
    r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?=" + _LABEL + r"(?:\.(?![A-Za-z]{2})" + _LABEL + r")*+\.[A-Za-z]{2})" + _LABEL + r"(?:\." + _LABEL + r")*+"
)
_FROM, _TO = r"(?<![\p{L}\p{N}.+\-/])", r"(?![\p{L}\p{N}]|[.\-/][0-9])"
_TIME = r"(?=[Tt][0-9]|[Zz](?![\p{L}\p{N}]))"
KINDS = {
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "phone": r"(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}",
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}",
}
_OTHER = "(?:" + "|".join(KINDS[k] for k in ("ssn", "date", "ip", "phone")) + ")" + _TO
_CHAIN = r"[0-9]++(?:-(?!" + _OTHER + r")[0-9]++)*+" + _TO
#: Digits with single separators, up to where another kind of value starts. Numbers joined by
#: dashes end where a value may end or not at all, so none of a chain is ever given back.
RUN = r"(?=[0-9](?:[ \-]?[0-9]){12})" + _CHAIN + r"(?: (?!" + _OTHER + ")" + _CHAIN + ")*+"
ANY = "|".join(
    [
        EMAIL,
        _FROM + r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + _TIME,
        _FROM.replace("/", "") + KINDS["ip"] + _TO.replace("/", ""),  # in addresses of the web
        _FROM + "(?:" + "|".join(KINDS[k] for k in ("ssn", "date", "phone")) + "|" + RUN + ")" + _TO,
    ]
)


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(left: str, right: str, a: str, b: str, tweak: str, key: str, rounds: int) -> str:
    """SQL: a struct (l, r), the permutation of (left, right) in 0..a-1 by 0..b-1."""

    def added(to: str, other: str, size: str) -> str:
        # 60 bits of a keyed hash
        return f"pmod({to} + cast(conv(substring(sha2(concat_ws('|', {_text(key)}, {tweak}, i, {other}), 256), 1, 15), 16, 10) as bigint), {size})"

    return (
        f"aggregate(sequence(1, {rounds}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), "
        f"(s, i) -> if(i % 2 = 1, named_struct('l', {added('s.l', 's.r', a)}, 'r', s.r), named_struct('l', s.l, 'r', {added('s.r', 's.l', b)})))"
    )


def _bind(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum, the last digit counting once."""
    d = f"cast(substring({digits}, -k, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, k) -> t + if(k % 2 = 1, {d}, {d} * 2 - if({d} > 4, 9, 0)))"


def _refit(m: str, digits: str) -> str:
    """SQL: m with its digits, from left to right, replaced by those of digits."""
    return f"array_join(transform(sequence(1, length({m})), k -> if(substring({m}, k, 1) between '0' and '9', substring({digits}, length({_digits(f'substring({m}, 1, k)')}), 1), substring({m}, k, 1))), '')"


def _padded(n: str, width: str) -> str:
    return f"lpad(cast({n} as string), {width}, '0')"


def _halves(digits: str, kind: str, key: str, rounds: int) -> str:
    """SQL: digits permuted among all strings of digits of that length (2 to 36)."""
    half = f"cast(floor(length({digits}) / 2) as int)"
    size = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"  # noqa: E731  a power of ten
    net = _feistel(f"substring({digits}, 1, {half})", f"substring({digits}, {half} + 1)", size(half), size(f"length({digits}) - {half}"), f"concat('{kind}', length({digits}))", key, rounds)
    return _bind("f", net, f"concat({_padded('f.l', half)}, {_padded('f.r', f'length({digits}) - {half}')})")


def _card(key: str, rounds: int) -> str:
    """SQL: what stands for m, a card with its separators, whose digits are d."""
    made = _bind("c", _halves("substring(d, 1, length(d) - 1)", "card", key, rounds), f"""concat(c, cast(pmod(-{_luhn("concat(c, '0')")}, 10) as string))""")
    return f"if(length(m) = length(d), {made}, {_bind('x', made, _refit('m', 'x'))})"


def _cards(key: str, rounds: int) -> str:
    """SQL: a struct (t, n), the numbers m with n cards among them replaced."""
    part = "array_join(slice(p, i, j - i + 1), '')"
    valid = f"length(d) between 13 and 19 and {_luhn('d')} % 10 = 0"
    ends = f"filter(sequence(least(i + 18, size(p)), i, -1), j -> {_bind('d', _digits(part), valid)})"
    one = _bind("j", "e[0]", _bind("m", part, _bind("d", _digits("m"), f"named_struct('t', concat(s.t, {_card(key, rounds)}), 'n', s.n + 1, 'free', j + 1)")))
    plain = "named_struct('t', concat(s.t, p[i - 1]), 'n', s.n, 'free', i + 1)"
    step = f"if(i < s.free, s, {_bind('e', ends, f'if(size(e) > 0, {one}, {plain})')})"
    # strings grow within a block of numbers only; a block hands on what is free and its count
    block = f"aggregate(sequence(b, least(b + {_NUMBERS - 1}, size(p))), named_struct('t', '', 'n', u.n, 'free', u.free), (s, i) -> {step})"
    outer = _bind("o", block, "named_struct('ts', array_append(u.ts, o.t), 'n', o.n, 'free', o.free)")
    start = "named_struct('ts', cast(array() as array<string>), 'n', 0, 'free', 1)"
    folded = f"aggregate(sequence(1, size(p), {_NUMBERS}), {start}, (u, b) -> {outer}, u -> named_struct('t', array_join(u.ts, ''), 'n', u.n))"
    return _bind("p", "regexp_extract_all(m, '[^0-9]?[0-9]+', 0)", folded)


def _email(key: str) -> str:
    """SQL: what stands for m, an address and perhaps the rest of a longer host."""
    made = f"concat('u', substring(sha2(concat_ws('|', {_text(key)}, 'email', lower(g)), 256), 1, 16), '@example.invalid', substring(m, length(g) + 1))"
    return _bind("g", rf"regexp_extract(m, {_text('^[^@]*@.*[.][A-Za-z]{2,}')}, 0)", made)


def _phone(key: str, rounds: int) -> str:
    made = f"concat(substring(d, 1, length(d) - 10), {_halves('substring(d, -10)', 'phone', key, rounds)})"
    return _bind("d", _digits("m"), _bind("x", made, _refit("m", "x")))


def _ip(key: str, rounds: int) -> str:
    net = _feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "'ip'", key, rounds)
    dotted = _bind("f", net, "concat_ws('.', cast(f.l div 256 as string), cast(f.l % 256 as string), cast(f.r div 256 as string), cast(f.r % 256 as string))")
    return _bind("o", "transform(split(m, '[.]'), x -> cast(x as bigint))", f"if(array_max(o) < 256, {dotted}, m)")


def _ssn(key: str, rounds: int) -> str:
    net = _feistel("(o[0] - 1 - if(o[0] > 666, 1, 0)) * 99 + o[1] - 1", "o[2] - 1", "88902", "9999", "'ssn'", key, rounds)
    area = "f.l div 99 + 1 + if(f.l div 99 >= 665, 1, 0)"
    made = _bind("f", net, f"concat_ws('-', {_padded(area, '3')}, {_padded('f.l % 99 + 1', '2')}, {_padded('f.r + 1', '4')})")
    return _bind("o", "transform(split(m, '-'), x -> cast(x as bigint))", f"if(o[0] between 1 and 899 and o[0] <> 666 and o[1] > 0 and o[2] > 0, {made}, m)")


def _date(key: str, rounds: int) -> str:
    def moved(pattern: str) -> str:
        # 1900-1999 has 36524 = 92 * 397 days, 2000-2099 has 36525 = 75 * 487
        century = lambda since, a, b: _bind("n", f"datediff(t, date'{since}')", _bind("f", _feistel(f"n div {b}", f"n % {b}", str(a), str(b), f"'{since}'", key, rounds), f"date_add(date'{since}', cast(f.l * {b} + f.r as int))"))
        inside = f"if(t < date'2000-01-01', {century('1900-01-01', 92, 397)}, {century('2000-01-01', 75, 487)})"
        return _bind("t", f"to_date(try_to_timestamp(m, '{pattern}'))", f"if(t between date'1900-01-01' and date'2099-12-31', date_format({inside}, '{pattern}'), m)")

    return f"case when substring(m, 5, 1) = '-' then {moved('yyyy-MM-dd')} when substring(m, 3, 1) = '/' then {moved('MM/dd/yyyy')} else {moved('dd.MM.yyyy')} end"


def pseudonym(key: str, rounds: int = ROUNDS) -> str:
    """SQL: a struct (t, n), what stands for the match m and the number of values replaced."""
    made = {"ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone}
    cases = " ".join(f"when m rlike {_text('^' + KINDS[k] + '$')} then {made[k](key, rounds)}" for k in made)
    one = f"case when contains(m, '@') then {_email(key)} {cases} else m end"
    single = _bind("y", one, "named_struct('t', y, 'n', if(y <> m, 1, 0))")
    others = " or ".join(f"m rlike {_text('^' + KINDS[k] + '$')}" for k in made)
    return f"if(contains(m, '@') or {others}, {single}, {_cards(key, rounds)})"


def pseudonymised(docs: DataFrame, key: str, text: str = "text", rounds: int = ROUNDS, count: str = "n_replaced") -> DataFrame:
    """docs with ``text`` pseudonymised, and the number of replaced values as ``count``; no shuffle, no Python."""
    hits, new = unused(docs, "_hits"), unused(docs, "_new")
    out = docs.withColumn(hits, F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))))
    out = out.withColumn(new, F.expr(f"if(size({hits}) > 0, transform({hits}, m -> {pseudonym(key, rounds)}), null)"))
    joined = F.array_join(F.zip_with(F.split(F.col(text), ANY, -1), F.col(new), lambda a, b: F.concat(a, F.coalesce(b["t"], F.lit("")))), "")
    changed = F.aggregate(F.col(new), F.lit(0), lambda n, x: n + x["n"])
    out = out.withColumn(text, F.when(F.col(new).isNotNull(), joined).otherwise(F.col(text)))
    return out.withColumn(count, F.coalesce(F.when(F.col(new).isNotNull(), changed), F.lit(0)).cast("int")).drop(hits, new)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
