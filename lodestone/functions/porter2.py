"""The Porter2 (English) stemmer, after its published description."""

from __future__ import annotations

import functools
import re

VOWELS = "aeiouy"
#: Fixed values of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
SAME_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str, start: int = 0) -> int:
    m = re.search(f"[{VOWELS}][^{VOWELS}]", word[start:])
    return start + m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    return bool(re.search(f"(?:^|[^{VOWELS}])[{VOWELS}][^{VOWELS}wxY]$", word)) if len(word) > 2 else bool(re.match(f"^[{VOWELS}][^{VOWELS}]$", word))


def _longest(word: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if word.endswith(e)), None)


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    if word in SAME:
        return word
    word = re.sub(f"(?<=[{VOWELS}])y", "Y", re.sub("^y", "Y", word.lstrip("'")))
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(word)
    r2 = _region(word, r1)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}].", word[:-1]):
        word = word[:-1]
    if word in SAME_AFTER_1A:
        return word
    # 1b
    if end := _longest(word, ("eedly", "eed")):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif (end := _longest(word, ("ingly", "edly", "ing", "ed"))) and re.search(f"[{VOWELS}]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # 2
    if end := _longest(word, (*STEP2, "ogi", "li")):
        if len(word) - len(end) >= r1:
            if end == "ogi":
                word = word[:-1] if word.endswith("logi") else word
            elif end == "li":
                word = word[:-2] if word[-3:-2] in set("cdeghkmnrt") else word
            else:
                word = word[: -len(end)] + STEP2[end]
    # 3
    if end := _longest(word, (*STEP3, "ative")):
        at = len(word) - len(end)
        if end == "ative":
            word = word[:at] if at >= r2 else word
        elif at >= r1:
            word = word[:at] + STEP3[end]
    # 4
    if end := _longest(word, (*STEP4, "ion")):
        at = len(word) - len(end)
        if at >= r2 and (end != "ion" or word[at - 1 : at] in ("s", "t")):
            word = word[:at]
    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
