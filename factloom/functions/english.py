"""English analysis of search texts: stop words go, the rest is stemmed (the public Porter2 algorithm)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public algorithm.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
#: A word: letters and digits, with one apostrophe within.
TOKEN = r"[\p{L}\p{N}]++(?:'[\p{L}\p{N}]++)?"

VOWELS = "aeiouy"
R1 = re.compile(r"^(?:gener|commun|arsen)|[aeiouy][^aeiouy]")
SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _region(word: str, start: int = 0) -> int:
    found = R1.search(word) if start == 0 else re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.lstrip("'"))
    r1 = _region(word)
    r2 = _region(word, r1) if r1 < len(word) else len(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _vowel(word[:-2]):
        word = word[:-1]
    if word in DONE:
        return word
    end = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    end = _ending(word, STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            word = before + STEP2[end]
    end = _ending(word, STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP3[end]
    end = _ending(word, STEP4)
    if end and len(word) - len(end) >= r2 and not (end == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not SHORT_END.search(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


@lru_cache(maxsize=1)
def stop_words() -> frozenset[str]:
    """Spark's own list for English; asked of the running session."""
    return frozenset(StopWordsRemover.loadDefaultStopWords("english"))


def terms(text: str) -> list[str]:
    """Stems of a text, in order, without stop words."""
    return [stem(w) for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?", text.lower()) if w not in stop_words()]


def content_words(low: Column) -> Column:
    """Words of a lower-cased text, in order, without stop words."""
    return F.filter(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(*sorted(stop_words())))


def candidate(stems_: list[str]) -> Callable[[Column], Column]:
    """Whether a word can have one of the stems: stemming changes no more than a stem's last letter, but for the special words."""
    heads = sorted({s[:-1] for s in stems_})
    special = [w for w, s in SPECIAL.items() if s in stems_]

    def near(word: Column) -> Column:
        out = word.isin(*special) if special else F.lit(False)
        for head in heads:
            out = out | word.startswith(head)
        return out

    return near


def stems(words: Column) -> Column:
    """array<string> of the words' stems."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if x is None else [stem(w) for w in x] for x in part], dtype=object)

    return run(words)
