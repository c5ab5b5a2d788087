"""Tokens, folding, stemming and containment of words."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Everything that is neither letter nor digit separates words.
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(col: Column | str, fold: bool = True) -> Column:
    """Words of a text, in lower case unless ``fold`` is off; NULL stays NULL. JVM only."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_remove(F.split(F.lower(c) if fold else c, SPLIT), "")


def contains_tokens(col: Column | str, words: str) -> Column:
    """True where a text holds every word of ``words``, with their case and unstemmed."""
    wanted = [w for w in re.split(r"[^\w]+|_", words) if w]
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), tokens(col, fold=False))) == 0


_VOWEL = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in _VOWEL and word[i - 1] in _VOWEL:
                return i + 1
        return len(word)

    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            return len(prefix), after(len(prefix))
    r1 = after(0)
    return r1, after(r1)


def _short_syllable(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWEL and word[1] not in _VOWEL
    return len(word) > 2 and word[-1] not in _VOWEL + "wxY" and word[-2] in _VOWEL and word[-3] not in _VOWEL


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of an English word by the published Porter2 algorithm; other than a-z passes unchanged."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    special = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    if word in special:
        return special[word]
    if word in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"):
        return word
    w = word.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    # past and gerund
    m = re.search(r"(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search(r"(ingly|edly|ing|ed)$", w)
        if m and re.search(r"[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short_syllable(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"

    def swap(w: str, table: list[tuple[str, str]], region: int, guard=None) -> str:
        for suffix, new in table:
            if w.endswith(suffix):
                at = len(w) - len(suffix)
                return w[:at] + new if at >= region and (guard is None or guard(suffix, w[:at])) else w
        return w

    def allowed(suffix: str, left: str) -> bool:
        return left.endswith("l") if suffix == "ogi" else left[-1:] in set("cdeghkmnrt") if suffix == "li" else True

    w = swap(w, [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")], r1, allowed)
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], r1)
    if w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    w = swap(w, [(s, "") for s in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")], r2, lambda s, left: s != "ion" or left[-1:] in ("s", "t"))
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def fold(word: str) -> str:
    """ASCII folding: accents are dropped."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(texts: pd.Series) -> pd.Series:
    """Folded, stemmed words of each text; NULL stays NULL."""
    word = re.compile(r"[^\W_]+")
    return texts.map(lambda t: None if t is None else [stem(fold(w)) for w in word.findall(t.lower())])
