"""Spanish stems by the published Snowball rules, on folded lower-case words (marks are gone before)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix lists of the algorithm, folded.
_PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
_PLAIN = "amientos imientos amiento imiento anzas anza icos icas ico ica ismos ismo ables able ibles ible istas ista osos osas oso osa".split()
_IC = "adoras adores aciones adora ador acion antes ante ancias ancia".split()
_Y = "yeron yendo yamos yais yan yen yas yes ya ye yo".split()
_SHORT = "emos eis en es".split()
_VERB = (
    "ariamos eriamos iriamos aramos asemos ieramos iesemos aremos eremos iremos abamos ariais eriais iriais arian arias erian erias irian irias "
    "areis ereis ireis ierais ieseis asteis isteis ieran iesen ieron iendo ieras ieses abais arais aseis iamos amos imos aran asen aron ando aras ases "
    "aria eria iria adas idas ados idos abas iais aban aren eren iren ado ido ada ida ara ase iera iese aste iste ar er ir as aba ad ed id ia io an iera ian ias ais is ara era ira are ere ire aran eran iran aras eras iras"
).split()
_VOWELS = "aeiou"


def _after(word: str, start: int) -> int:
    """End of the first non-vowel that follows a vowel from start on."""
    m = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(word, start)
    return m.end() if m else len(word)


def spanish_stem(word: str) -> str:
    if len(word) < 3 or not word.isalpha():
        return word
    r1 = _after(word, 0)
    r2 = _after(word, r1)
    if word[1] not in _VOWELS:
        m = re.compile(f"[{_VOWELS}]").search(word, 2)
        rv = m.end() if m else len(word)
    elif word[0] in _VOWELS:
        m = re.compile(f"[^{_VOWELS}]").search(word, 2)
        rv = m.end() if m else len(word)
    else:
        rv = 3
    w = word

    def ends(suffixes: list[str], region: int) -> str | None:
        found = [s for s in suffixes if w.endswith(s)]
        best = max(found, key=len, default=None)
        return best if best and len(w) - len(best) >= region else None

    if s := ends(_PRONOUNS, rv):
        stem = w[: -len(s)]
        if (stem.endswith(("iendo", "ando", "ar", "er", "ir")) and len(stem) - 2 >= rv) or stem.endswith("uyendo"):
            w = stem
    before = w

    def cut(s: str, region: int, more: tuple[str, ...] = ()) -> None:
        nonlocal w
        w = w[: -len(s)]
        for m in more:
            if w.endswith(m) and len(w) - len(m) >= region:
                w = w[: -len(m)]
                break

    if w.endswith("amente") and len(w) - 6 >= r1:
        cut("amente", r2, ("iv", "os", "ic", "ad"))
        if before[:-6].endswith("ativ") and len(w) - 2 >= r2:
            w = w[:-2]
    elif s := ends(_IC, r2):
        cut(s, r2, ("ic",))
    elif s := ends(["logias", "logia"], r2):
        w = w[: -len(s)] + "log"
    elif s := ends(["uciones", "ucion"], r2):
        w = w[: -len(s)] + "u"
    elif s := ends(["encias", "encia"], r2):
        w = w[: -len(s)] + "ente"
    elif s := ends(["mente"], r2):
        cut(s, r2, ("ante", "able", "ible"))
    elif s := ends(["idades", "idad"], r2):
        cut(s, r2, ("abil", "ic", "iv"))
    elif s := ends(["ivas", "ivos", "iva", "ivo"], r2):
        cut(s, r2, ("at",))
    elif s := ends(_PLAIN, r2):
        cut(s, r2)
    if w == before:
        if (s := ends(_Y, rv)) and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        elif (s := ends(_VERB + _SHORT, rv)) and s not in _SHORT:
            w = w[: -len(s)]
        elif s := ends(_SHORT, rv):
            w = w[: -len(s)]
            if w.endswith("gu"):
                w = w[:-1]
    if s := ends(["os", "a", "o", "i"], rv):
        w = w[: -len(s)]
    elif s := ends(["e"], rv):
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w


def stem(words: Column) -> Column:
    """Stems in Arrow batches; meant for a vocabulary, not for texts."""

    @F.arrow_udf("string")
    def run(column):
        import pyarrow as pa

        return pa.array([None if w is None else spanish_stem(w) for w in column.to_pylist()], pa.string())

    return run(words)
