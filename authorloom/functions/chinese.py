"""Romanised Chinese names: predicates and key pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze, text, tokens

#: Surnames in pinyin known to both predicates.
SURNAMES = (
    "wang li zhang liu chen yang huang zhao wu zhou xu sun ma zhu hu guo he lin luo gao "
    "liang zheng xie song tang feng han deng cao peng zeng xiao tian dong pan yuan cai jiang du ye "
    "cheng wei su lu ding ren shen yao xue shi qian dai hou meng shao qiu bai yin chang "
    "lei tan fang wan jin zou jia yan hao long kong qin xia jing ning wen"
).split()
#: Those that only the wider predicate knows.
MORE_SURNAMES = "fu xi kang dou zhong gan ai lan ji fan yu liao cui gu mao gong xing mu xiang".split()


def _first_or_last(words: Column, names: list[str]) -> Column:
    known = lambda at: F.coalesce(F.try_element_at(words, F.lit(at)).isin(names), F.lit(False))
    return (F.size(words) > 0) & (known(1) | known(-1))


def is_romanized_chinese(c, strict: bool = False) -> Column:
    """First or last word is a surname; strict also needs a hyphen or two words of 2 to 8 letters."""
    words = tokens(F.regexp_replace(F.lower(text(c)), r"[,.\-'\"()]", " "))
    surname = _first_or_last(words, SURNAMES + MORE_SURNAMES)
    if not strict:
        return surname
    two = (F.size(words) == 2) & F.forall(words, lambda w: F.length(w).between(2, 8))
    return surname & (F.rlike(text(c), F.lit(r"(?U)\w+-\w+")) | two)


def is_chinese_name(c) -> Column:
    """The narrower predicate: only comma and stop part words."""
    return _first_or_last(tokens(F.regexp_replace(F.lower(text(c)), "[,.]", " ")), SURNAMES)


def dual_keys(raw, last="", first="") -> tuple[Column, Column]:
    """Keys for both orders of a name; from the raw name, the surname comes first."""
    w = tokens(raw)
    own_last, own_first = F.lower(squeeze(text(last))), F.lower(squeeze(text(first)))
    from_raw = (own_last == "") & (F.size(w) > 0)
    a = F.when(from_raw, F.lower(F.try_element_at(w, F.lit(1)))).otherwise(own_last)
    b = F.when(from_raw, F.coalesce(F.lower(F.try_element_at(w, F.lit(2))), F.lit(""))).otherwise(own_first)
    short = F.length(b) < 2
    one = F.when(b == "", F.concat(F.lit("cn:"), a)).otherwise(F.concat(F.lit("cn:"), a, F.lit("_"), F.left(b, F.lit(3))))
    two = F.when(b == "", one).when(short, F.concat(F.lit("cn:"), b, F.lit("_"), a)).otherwise(F.concat(F.lit("cn:"), b, F.lit("_"), F.left(a, F.lit(3))))
    return one, two
