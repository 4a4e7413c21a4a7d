"""Rounds and sums of money as texts state them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.refs import bound

#: Words of a round that was guessed or isn't known, and the patterns of rounds with a letter: the ones before a series, and the series. Fixed values.
GUESSED = "(?i)추정|명시.{0,6}없|미상|미공개|불명|unknown|undisclosed|n/?a$"
BEFORE = (r"(?i)^(?:series|시리즈)\s*(?:pre|프리)\s*-?\s*([a-h])\b(.*)$", r"(?i)^(?:pre|프리)\s*-?\s*(?:series|시리즈)?\s*([a-h])\b(.*)$")
LETTERED = (r"(?i)^(?:series|시리즈)\s*-?\s*([a-h])(?![a-z])(.*)$", r"(?i)^([a-h])\s*라운드(.*)$")
#: Other rounds, and what each is called. Fixed values.
NAMED = {
    r"(?i)^(?:pre\s*-?\s*seed|프리\s*시드)": "프리시드",
    r"(?i)^(?:seed|시드)(?:\s*(?:round|라운드|투자))?$": "시드",
    r"(?i)^(?:angel|엔젤)(?:\s*(?:round|라운드|투자))?$": "엔젤",
    r"(?i)^(?:pre\s*-?\s*ipo|프리\s*ipo)$": "프리 IPO",
    r"(?i)^(?:strategic\s+investment|전략적\s*투자)$": "전략적 투자",
    r"(?i)^(?:(?:전략적\s*)?업무\s*협약|양해\s*각서|mou)(?:\s*체결)?$": "MOU",
}
PARENTHESES = r"\s*[(\[（]([^)\]）]*)[)\]）]"
LONGEST = 40
#: Korean units, and the words for currencies after a figure, longer ones first; English units and the signs before a figure. Fixed values.
UNITS = {"조": 1e12, "억": 1e8, "만": 1e4}
SMALL = {"천": 1e3, "백": 1e2}
CURRENCIES = {
    "싱가포르달러": "SGD", "캐나다달러": "CAD", "홍콩달러": "HKD", "대만달러": "TWD", "호주달러": "AUD", "파운드": "GBP", "달러": "USD", "유로": "EUR", "위안": "CNY", "링깃": "MYR", "루피": "INR", "프랑": "CHF", "원": "KRW", "엔": "JPY",
}
ENGLISH = {"trillion": 1e12, "billion": 1e9, "bn": 1e9, "million": 1e6, "mn": 1e6}
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP"}
_PIECE = r"\d[\d,]*(?:\.\d+)?\s*[천백]?\s*[조억만]"
#: Deposits of subscribers aren't money that moved. Fixed value.
_DEPOSIT = r"(?!\s*(?:이상|가량|규모)?\s*의?\s*(?:청약\s*)?증거금)"


def _named(found: Column, values: dict, otherwise: Column) -> Column:
    for word, value in values.items():
        otherwise = F.when(found == word, F.lit(value)).otherwise(otherwise)
    return otherwise


def stage(raw: Column) -> Column:
    """One spelling of a round: "Series B", "시리즈B" and "B라운드" are "시리즈 B"; null for none, and for one that was guessed. Others stay, cut at LONGEST."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))

    def spelled(own: Column) -> Column:
        stripped = F.trim(F.regexp_replace(own, PARENTHESES, ""))
        bare = F.when(stripped != "", stripped).otherwise(own)
        out = F.substring(own, 1, LONGEST)
        for pattern, name in reversed(NAMED.items()):
            out = F.when(bare.rlike(pattern), F.lit(name)).otherwise(out)
        for head, patterns in (("시리즈 ", LETTERED), ("프리 시리즈 ", BEFORE)):
            for pattern in reversed(patterns):
                rest = F.trim(F.regexp_replace(F.regexp_extract(bare, pattern, 2), r"(?i)^\s*(?:round|라운드)", ""))
                tail = F.when((rest == "") | rest.rlike("^[-+0-9]"), rest).otherwise(F.concat(F.lit(" "), rest))
                out = F.when(bare.rlike(pattern), F.substring(F.concat(F.lit(head), F.upper(F.regexp_extract(bare, pattern, 1)), tail), 1, LONGEST)).otherwise(out)
        return F.when((own != "") & ~own.rlike(GUESSED), out)

    return bound(text, spelled)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).cast("double")


def stated(text: Column) -> Column:
    """The sums that a text states, each (value, currency), Korean ones first: "20조 8천억 원" is 2.08e13 KRW. The currency is null where it isn't said."""
    own = F.coalesce(text, F.lit(""))
    korean = rf"((?:{_PIECE}\s*)+)\s*({'|'.join(CURRENCIES)}){_DEPOSIT}"
    english = r"(?i)([$€£¥]?)\s*(\d[\d,]*(?:\.\d+)?)\s*(trillion|billion|million|bn|mn)\b"
    part = r"(\d[\d,]*(?:\.\d+)?)\s*([천백]?)\s*([조억만])"

    def value(figure: Column) -> Column:
        pieces = F.regexp_extract_all(figure, F.lit(f"({part})"), 1)
        each = F.transform(pieces, lambda p: _number(F.regexp_extract(p, part, 1)) * _named(F.regexp_extract(p, part, 2), SMALL, F.lit(1.0)) * _named(F.regexp_extract(p, part, 3), UNITS, F.lit(1.0)))
        return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)

    none = F.lit(None).cast("string")
    first = F.zip_with(F.regexp_extract_all(own, F.lit(korean), 1), F.regexp_extract_all(own, F.lit(korean), 2), lambda f, c: F.struct(value(f).alias("value"), _named(c, CURRENCIES, none).alias("currency")))
    figures = F.zip_with(F.regexp_extract_all(own, F.lit(english), 2), F.regexp_extract_all(own, F.lit(english), 3), lambda n, u: _number(n) * _named(F.lower(u), ENGLISH, F.lit(1.0)))
    second = F.zip_with(figures, F.regexp_extract_all(own, F.lit(english), 1), lambda v, c: F.struct(v.alias("value"), _named(c, SIGNS, none).alias("currency")))
    return F.concat(first, second)
