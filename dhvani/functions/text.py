"""Language-specific text normalisation as native column expressions.

``normalize_en``: whole-word integers become English words, everything but
ASCII letters, apostrophes and whitespace becomes a space, spaces collapse,
lower case.  Written as a token extraction (runs of letters, apostrophes and
whole-word numbers) so no step needs a look-around.

``normalize_hi``: bracketed spans removed, everything but Devanagari,
whitespace and danda deleted, danda runs merged, spaces collapsed.

``(?U)`` gives Java the Unicode meanings of ``\\d``, ``\\s``, ``\\b`` and
``\\w``; ``(?d)`` makes ``.`` stop only at ``\\n``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: English cardinal number words ----------------------------
ONES = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
        "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
        "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
# Scale words: the small ones, then Latin ones and tens, then the last.
SMALL_ILLIONS = ["m", "b", "tr", "quadr", "quint", "sext", "sept", "oct", "non"]
LATIN_ONES = ["", "un", "duo", "tre", "quattuor", "quin", "sex", "sept", "octo", "novem"]
LATIN_TENS = ["dec", "vigint", "trigint", "quadragint", "quinquagint", "sexagint", "septuagint", "octogint", "nonagint"]
LAST_ILLION = "cent"
# ---- end of fixed values -----------------------------------------------------

# 10^3k for k = 0, 1, ...: "", thousand, million ... nonillion, decillion, undecillion ... centillion (10^303).
SCALES = ["", "thousand"] + [w + "illion" for w in (*SMALL_ILLIONS, *(o + t for t in LATIN_TENS for o in LATIN_ONES), LAST_ILLION)]
MAX_DIGITS = 3 * len(SCALES)  # numbers of more digits (10^306 and over) have no words


def _decimal_digit_map() -> tuple[str, str]:
    """Every non-ASCII decimal digit (Unicode category Nd) and its ASCII digit."""
    src, dst = [], []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if unicodedata.category(ch) == "Nd":
            src.append(ch)
            dst.append(str(unicodedata.digit(ch)))
    return "".join(src), "".join(dst)


ND_SRC, ND_DST = _decimal_digit_map()


def _arr(words):
    return F.array(*[F.lit(w) for w in words])


def _below100(r: Column) -> Column:
    ones, tens = _arr(ONES), _arr(TENS)
    return F.when(r < 20, F.element_at(ones, r + 1)).otherwise(
        F.concat_ws(" ", F.element_at(tens, (r / 10).cast("int") + 1),
                    F.when(r % 10 > 0, F.element_at(ones, r % 10 + 1))))


def _group_words(g: Column) -> Column:
    """1..999 -> words, 'and' after 'hundred' when followed by tens/ones."""
    h, r = (g / 100).cast("int"), g % 100
    return F.concat_ws(" ",
                       F.when(h > 0, F.concat(F.element_at(_arr(ONES), h + 1), F.lit(" hundred"))),
                       F.when((h > 0) & (r > 0), F.lit("and")),
                       F.when(r > 0, _below100(r)))


def number_words(digits: Column) -> Column:
    """Decimal digit string (any script) -> English cardinal words.

    Leading zeros are ignored; 0 -> 'zero'; 'and' joins a final group below
    100 to a larger number.  Numbers of more than ``MAX_DIGITS`` digits come back
    as ASCII digits: the library that defines the words ends there too."""
    ascii_ = F.translate(digits, ND_SRC, ND_DST)
    p0 = F.regexp_replace(ascii_, r"^0+(?!$)", "")
    ng = F.ceil(F.length(p0) / 3).cast("int")
    padded = F.lpad(p0, ng * 3, "0")
    groups = F.transform(F.sequence(F.lit(1), ng), lambda j: F.struct(
        F.substring(padded, j * 3 - 2, 3).cast("int").alias("g"), (ng - j).alias("s")))
    scales = _arr(SCALES)
    parts = F.transform(F.filter(groups, lambda x: x["g"] > 0), lambda x: F.concat_ws(
        " ",
        F.when((x["s"] == 0) & (x["g"] < 100) & (ng > 1), F.lit("and")),
        _group_words(x["g"]),
        F.when(x["s"] > 0, F.element_at(scales, x["s"] + 1))))
    return (F.when(p0 == "0", F.lit("zero"))
            .when(F.length(p0) > MAX_DIGITS, p0)
            .otherwise(F.array_join(parts, " ")))


TOKEN_RE = r"(?U)(?:[a-zA-Z']|\b\d+\b)+"


def normalize_en(text: Column) -> Column:
    """English rules (see module doc).  Null in, null out."""
    t = F.replace(text, F.lit("​"), F.lit(" "))
    toks = F.regexp_extract_all(t, F.lit(TOKEN_RE), F.lit(0))

    def piece(p):
        w = number_words(p)
        return F.when(p.rlike(r"(?U)^\d+$"),
                      F.when(F.length(F.regexp_replace(F.translate(p, ND_SRC, ND_DST), r"^0+(?!$)", ""))
                             > MAX_DIGITS, F.lit(" ")).otherwise(w)).otherwise(p)

    words = F.transform(toks, lambda tok: F.array_join(F.transform(F.split(tok, "'"), piece), "'"))
    out = F.lower(F.array_join(words, " "))
    return F.trim(F.regexp_replace(out, " +", " "))


def normalize_hi(text: Column) -> Column:
    """Hindi (Devanagari) rules (see module doc).  Null in, null out."""
    t = F.replace(text, F.lit("​"), F.lit(" "))
    t = F.regexp_replace(t, r"(?d)\[.*?\]|\(.*?\)", "")
    t = F.regexp_replace(t, "(?U)[^ऀ-ॿ\\s।]", "")
    t = F.regexp_replace(t, "।+", "।")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.regexp_replace(t, "^ | $", "")


def normalize_by_lang(text: Column, lang: Column | str = "en") -> Column:
    """Hindi rules when ``lang`` starts with 'hi', English rules otherwise."""
    lg = F.lit(lang) if isinstance(lang, str) else lang
    return F.when(F.coalesce(lg.startswith("hi"), F.lit(False)), normalize_hi(text)).otherwise(normalize_en(text))


# The Unicode White_Space characters (what Java's (?U)\s matches).
WHITESPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
              "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def ustrip(text: Column) -> Column:
    """Strip Unicode whitespace at both ends (plain ``trim`` strips only
    U+0020); touches only the ends, no scan of the text."""
    return F.trim(text, F.lit(WHITESPACE))


def urstrip(text: Column) -> Column:
    """Strip Unicode whitespace at the end."""
    return F.rtrim(text, F.lit(WHITESPACE))


# ---- DuckDB forms (oracles) ---------------------------------------------------

def _sql_arr(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


# Java's Unicode \w and \s, written as RE2 classes.
SQL_W = r"\p{L}\p{Nl}\p{Nd}\p{M}\p{Pc}\x{200C}\x{200D}"
SQL_S = r"\t\n\x{0B}\f\r\x{85}\p{Z}"


def number_words_sql(p: str) -> str:
    """SQL expression: ASCII digit string ``p`` -> words (same rules, from the definition)."""
    p0 = f"(case when regexp_replace({p}, '^0+', '') = '' then '0' else regexp_replace({p}, '^0+', '') end)"
    ng = f"cast(ceil(len({p0}) / 3) as integer)"
    ones, tens = _sql_arr(ONES), _sql_arr(TENS)
    # Names in the order of their powers, put together by the database.
    scales = ("(['', 'thousand', 'million', 'billion', 'trillion', 'quadrillion', 'quintillion', 'sextillion', "
              "'septillion', 'octillion', 'nonillion'] || flatten([[u || t || 'illion' for u in ['', 'un', 'duo', 'tre', "
              "'quattuor', 'quin', 'sex', 'sept', 'octo', 'novem']] for t in ['dec', 'vigint', 'trigint', 'quadragint', "
              "'quinquagint', 'sexagint', 'septuagint', 'octogint', 'nonagint']]) || ['centillion'])")
    r = "(_q.g % 100)"
    below = (f"(case when {r} < 20 then {ones}[{r} + 1] else concat_ws(' ', {tens}[{r} // 10 + 1], "
             f"case when {r} % 10 > 0 then {ones}[{r} % 10 + 1] end) end)")
    grp = (f"concat_ws(' ', case when _q.s = 0 and _q.g < 100 and {ng} > 1 then 'and' end, "
           f"case when _q.g // 100 > 0 then {ones}[_q.g // 100 + 1] || ' hundred' end, "
           f"case when _q.g // 100 > 0 and _q.g % 100 > 0 then 'and' end, "
           f"case when {r} > 0 then {below} end, "
           f"case when _q.s > 0 then {scales}[_q.s + 1] end)")
    groups = (f"list_transform(range(1, {ng} + 1), lambda _j: {{'g': cast(substr(lpad({p0}, {ng} * 3, '0'), "
              f"cast(3 * _j - 2 as integer), 3) as integer), 's': cast({ng} - _j as integer)}})")
    body = f"array_to_string(list_transform(list_filter({groups}, lambda _q: _q.g > 0), lambda _q: {grp}), ' ')"
    return (f"(case when {p0} = '0' then 'zero' when len({p0}) > 306 then {p0} "
            f"else {body} end)")


def normalize_en_sql(x: str) -> str:
    """DuckDB: split into word runs and single other characters; a word run of
    digits becomes words, other word runs keep ASCII letters only; apostrophes
    stay, every other character is a space."""
    runs = f"regexp_extract_all(replace({x}, chr(8203), ' '), '[{SQL_W}]+|[^{SQL_W}]')"
    digits = f"translate(_w, '{ND_SRC}', '{ND_DST}')"
    conv = (f"case when regexp_matches(_w, '^\\p{{Nd}}+$') then "
            f"(case when len(regexp_replace({digits}, '^0+', '')) > 306 then ' ' "
            f"else {number_words_sql(digits)} end) "
            f"else regexp_replace(_w, '[^a-zA-Z'']', ' ', 'g') end")
    joined = f"array_to_string(list_transform({runs}, lambda _w: {conv}), '')"
    return f"trim(regexp_replace(lower({joined}), ' +', ' ', 'g'))"


def normalize_hi_sql(x: str) -> str:
    t = f"replace({x}, chr(8203), ' ')"
    t = f"regexp_replace({t}, '\\[.*?\\]|\\(.*?\\)', '', 'g')"
    t = f"regexp_replace({t}, '[^\\x{{0900}}-\\x{{097F}}{SQL_S}।]', '', 'g')"
    t = f"regexp_replace({t}, '।+', '।', 'g')"
    t = f"regexp_replace({t}, '[{SQL_S}]+', ' ', 'g')"
    return f"regexp_replace({t}, '^ | $', '', 'g')"
