"""Model identifiers in product titles, and title similarity: what regular columns can't express."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from itertools import zip_longest
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.text import DASHES, LOOK_ALIKES

#: Words that name an execution of a model, units that are never a suffix of one, and
#: nouns of accessories that stand before the model they fit.
QUALIFIERS = ("new", "pro", "plus", "max", "mini", "eco", "premium", "classic", "digital", "cnc")
UNITS = ("cm", "db", "g", "hz", "kg", "kw", "m", "min", "mm", "nm", "rpm", "w")
ACCESSORY_NOUNS = "адаптер блок вставка губка губки держатель контроллер кронштейн насадка опора патрон переходник подставка приспособление пульт ручка стол цанга цанги".split()
FITS = ("для", "к", "под")

#: The patterns of a title's words, and of a model written as letters, a gap and digits.
WORD = r"[a-zа-яё0-9]+(?:[-./×xх][a-zа-яё0-9]+)*"
SPACED = r"\b([a-zа-я]{1,12})[ -]+(\d{2,})(?:[ -]+([a-zа-я]{1,12}))?\b"

_LATIN = str.maketrans(LOOK_ALIKES[0] + "×", LOOK_ALIKES[1] + "x")
_HYPHEN = str.maketrans({c: "-" for c in DASHES})
_WORD, _SPACED = re.compile(WORD, re.I), re.compile(SPACED, re.I)
_CODED = re.compile(r"(?=.*[a-zа-я])(?=.*\d)")


def folded(text: str | None) -> str:
    text = unicodedata.normalize("NFKC", text or "").lower().replace("ё", "е").translate(_HYPHEN)
    return " ".join(text.split())


def packed(text: str) -> str:
    """The compact model form of any text."""
    return re.sub("[^a-zа-я0-9]", "", folded(text).translate(_LATIN))


class Word(NamedTuple):
    """A word of a title, where it begins, and its compact form; one with a letter and a digit is a code."""

    start: int
    text: str
    form: str

    @property
    def is_code(self) -> bool:
        return _CODED.match(self.form) is not None

    @property
    def is_family(self) -> bool:
        """Capitals that stand before a code and belong to it."""
        return re.fullmatch("[A-Z]{1,6}", self.text) is not None and self.form not in UNITS

    @property
    def as_suffix(self) -> str:
        """What it adds to a code before it, as the name of an execution or as one or two capitals."""
        low = folded(self.text)
        named = low in QUALIFIERS or (low not in UNITS and re.fullmatch("[A-Z]{1,2}", self.text))
        return packed(self.text) if named else ""


class Title:
    """A title's words, and the models that they spell."""

    def __init__(self, text: str | None):
        self.plain = unicodedata.normalize("NFKC", text or "")
        self.words = [Word(m.start(), m[0], packed(m[0])) for m in _WORD.finditer(self.plain.translate(_HYPHEN))]

    def codes(self) -> list[tuple[int, str]]:
        """Index of each code and its form with a suffix."""
        followed = zip_longest(self.words, self.words[1:])
        return [(k, word.form + (after.as_suffix if after else "")) for k, (word, after) in enumerate(followed) if word and word.is_code]

    @staticmethod
    def spaced(text: str) -> list[tuple[int, str]]:
        """Offset and form of models with a gap."""
        return [(m.start(), packed(m[1] + m[2]) + Word(0, m[3] or "", "").as_suffix) for m in _SPACED.finditer(text)]

    def models(self) -> list[str]:
        """All codes; models with a gap only where the title has no code."""
        return list(dict.fromkeys(form for _, form in self.codes() or self.spaced(folded(self.plain))))

    def placed(self) -> tuple[int, str]:
        """The title's own model and the index of its first word: of the codes, with their families, the one
        that begins first, else the first with a gap; (0, "") if there is none."""
        found = []
        for k, form in self.codes():
            if len(self.words[k].form) > 32:
                continue
            family = k > 0 and self.words[k - 1].is_family
            found.append((k - 1, self.words[k - 1].form + form) if family else (k, form))
        if found:
            return min(found, key=lambda x: x[0])
        return next(((sum(w.start < at for w in self.words), form) for at, form in self.spaced(self.plain)), (0, ""))

    def model(self) -> str:
        return self.placed()[1]

    def evidence(self) -> dict[str, str]:
        """The model's base and execution (longest word first), and whether the title only fits to it: then
        a noun of accessories and a later word of fitting stand before the model."""
        at, identity = self.placed()
        qualifier = max((q for q in sorted(QUALIFIERS, reverse=True) if identity.endswith(q) and identity != q), key=len, default="")
        head, marker, fits_later = "", "", False
        for word in self.words[:at] if at and identity.startswith(self.words[at].form) else ():
            low = folded(word.text)
            if low in ACCESSORY_NOUNS:
                head = head or low
            elif low in FITS:
                marker, fits_later = low, bool(head)
        ownership = "REFERENCE_COMPATIBILITY" if fits_later else "OWN_PRODUCT"
        return {"identity": identity, "base": identity.removesuffix(qualifier), "qualifier": qualifier, "ownership": ownership, "accessory_head": head, "marker": marker}


@F.pandas_udf(T.ArrayType(T.StringType()))
def model_tokens(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: Title(t).models())


@F.pandas_udf(T.StringType())
def extract_model(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: Title(t).model())


_EVIDENCE = ("identity", "base", "qualifier", "ownership", "accessory_head", "marker")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in _EVIDENCE]))
def model_evidence(titles: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([Title(t).evidence() for t in titles], columns=list(_EVIDENCE))


_FACTS = T.StructType([T.StructField(n, T.StringType()) for n in _EVIDENCE] + [T.StructField("models", T.ArrayType(T.StringType()))])


@F.pandas_udf(_FACTS)
def title_facts(titles: pd.Series) -> pd.DataFrame:
    """model_evidence and model_tokens of a title at once; identity is what extract_model gives."""
    read = [Title(t) for t in titles]
    return pd.DataFrame([{**x.evidence(), "models": x.models()} for x in read], columns=[*_EVIDENCE, "models"])


@F.pandas_udf(T.DoubleType())
def similarity(sources: pd.Series, candidates: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of (source, candidate), in that order; null is empty."""
    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(sources, candidates, strict=True)])
