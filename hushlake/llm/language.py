"""Language identification by words first, then ever shorter character n-grams.

Known words score by their log frequency in each language.  A word that was not learned is split into
character n-grams, the longest kind first; the first kind of which some are known decides.  A document's score
is the mean over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

#: Runs of letters (Python's word characters without digits and the underscore).
LETTERS = re.compile(r"[^\W\d_]+")
#: Bounds of what is learned: texts per language and their size, words per language, n-grams per language and length.
TEXTS, TEXT_BYTES, WORDS, GRAMS = 1500, 40_000, 40_000, 20_000
LONGEST = 5
#: Words and evidence: a document counts as at most so many independent words when its probability is formed.
EVIDENCE = 30
REMEMBERED = 300_000
UNKNOWN = "und"


class LanguageModel:
    """Log-frequency tables; picklable, and bounded by the constants above."""

    def __init__(self, sample: list[tuple[str, str]]):
        words: dict[str, Counter] = {}
        for text, lang in sample:
            words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        self.languages = sorted(words)
        self.words = self._table({lang: Counter({w: n for w, n in c.items() if n > 1}) for lang, c in words.items()}, WORDS)
        self.grams = {}
        for n in range(1, LONGEST + 1):
            counts = {lang: Counter() for lang in self.languages}
            for lang, c in words.items():
                for w, k in c.items():
                    for g in self._split(w, n):
                        counts[lang][g] += k
            self.grams[n] = self._table(counts, GRAMS)
        self._forget()

    def _forget(self) -> None:
        """Only the learned words have rows; others get one when they are first met."""
        self.rows = {w: i for i, w in enumerate(self.words)}
        self.table = np.zeros((len(self.rows) + REMEMBERED, len(self.languages)), dtype=np.float32)
        if self.words:
            self.table[: len(self.words)] = list(self.words.values())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    @staticmethod
    def _split(word: str, n: int) -> list[str]:
        padded = f"<{word}>"
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    def _table(self, counts: dict[str, Counter], most: int) -> dict[str, np.ndarray]:
        names = {w for lang in self.languages for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:most]}
        totals = {lang: sum(counts[lang].values()) + len(names) + 1 for lang in self.languages}
        return {w: np.array([math.log((counts[lang][w] + 0.5) / totals[lang]) for lang in self.languages], dtype=np.float32) for w in sorted(names)}

    def _row(self, word: str) -> int:
        """Row of a word that was not learned: the mean over its known n-grams of the longest kind that has any."""
        row = self.rows[word] = len(self.rows)
        for n in range(LONGEST, 0, -1):
            parts = [v for g in self._split(word, n) if (v := self.grams[n].get(g)) is not None]
            if parts:
                self.table[row] = sum(parts) / len(parts)
                break
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ``und`` and 0 for null, for texts without a letter, or if nothing was learned."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        words = Counter(LETTERS.findall(text.lower()))
        if not words:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        items = list(words.items())
        for at in range(0, len(items), REMEMBERED):
            part = items[at : at + REMEMBERED]
            if len(self.rows) + len(part) > len(self.table):
                self._forget()
            get = self.rows.get
            rows = [i if (i := get(w)) is not None else self._row(w) for w, _ in part]
            total += np.array([n for _, n in part], dtype=np.float32) @ self.table[rows]
        size = words.total()
        mean = total / size
        odds = np.exp((mean - mean.max()) * min(size, EVIDENCE))
        best = int(np.argmax(mean))
        return self.languages[best], float(odds[best] / odds.sum())


def fit_languages(docs: DataFrame, lang_col: str = "lang") -> LanguageModel:
    """Learns from about TEXTS texts per language, of at most TEXT_BYTES bytes each; rows without id, text or language don't count."""
    sample, _ = labelled_sample(docs, docs.select("doc_id", lang_col), lang_col, TEXTS, TEXT_BYTES)
    return LanguageModel(sample)


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``language`` of lang_pred and score.

    Whole texts are read.  Null, empty and letterless texts give ``und`` with score 0; ties go to the first
    language by name.  Repeated rows get equal results, all columns are kept, an empty table stays empty.
    A column that is called ``language`` already is replaced.
    """

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("language", language(F.col(text_col)))
