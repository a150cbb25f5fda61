"""Toxicity by a sparse logistic model with a counterfactual penalty.

Features of a text are its distinct words and the beginnings of 4 to 7 letters that they have, each counted
once per distinct word.  In every labelled text that names a group of people, the name is swapped for others of its list.
A labelled text that names none is learned from with a name put in, which is taken out again and swapped for the next of its list.
The squared change of the score's log-odds is added to the loss each time, so every text takes part.  Names of groups so
carry no weight of their own, and neutral mentions of a group don't score as toxic because toxic texts mention it
too.  An L1 term keeps the words that matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, trimmed

LETTERS = re.compile(r"[^\W\d_]+")
#: Names that are swapped within a list: English, German, French, Spanish.
IDENTITIES = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("schwul", "lesbisch", "heterosexuell", "bisexuell", "transgender", "queer"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "blinde", "gehörlose", "autisten"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"),
    ("femmes", "hommes", "filles", "garçons"),
    ("gay", "lesbienne", "hétérosexuel", "bisexuel", "transgenre", "queer"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "aveugles", "sourds", "autistes"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("gay", "lesbiana", "heterosexual", "bisexual", "transgénero", "queer"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("discapacitados", "ciegos", "sordos", "autistas"),
)
#: Rows that a table of names may have; it is read whole.
MOST_NAMES = 10_000
PREFIXES = (4, 5, 6, 7)
#: Bounds of the sample that is learned from, for each label value.
TEXTS, TEXT_BYTES = 2000, 40_000
#: Texts a feature must be in, and standard errors by which its share must differ between the label values.
LEAST, SCREEN = 3, 3.0
#: Strength of the L1 term and of the counterfactual penalty; steps.
L1, PENALTY, STEPS = 2e-3, 1.0, 300
#: Swapped versions of one text.
SWAPS = 3
REMEMBERED = 100_000


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def _bag(words: set[str]) -> Counter:
    return Counter(f for w in words for f in features(w))


def swapped(words: set[str], identities=IDENTITIES, most: int = SWAPS) -> list[set[str]]:
    """Versions of a text's words with one list's names exchanged in turn."""
    out = []
    for names in identities:
        if here := [i for i, n in enumerate(names) if n in words]:
            for k in range(1, min(most, len(names) - 1) + 1):
                out.append((words - set(names)) | {names[(i + k) % len(names)] for i in here})
    return out


def inserted(words: list[set[str]], identities=IDENTITIES) -> dict[int, tuple[str, str]]:
    """A name for each text that has none, in turn, and the next of its list."""
    names = [(g[k], g[(k + 1) % len(g)]) for g in identities for k in range(len(g))]
    known = {n for n, _ in names}
    bare = [i for i, w in enumerate(words) if names and known.isdisjoint(w)]
    return {i: names[k % len(names)] for k, i in enumerate(bare)}


class ToxicityModel:
    """``sizes`` says how many texts there are of each label value, if the sample has other shares."""

    def __init__(self, sample: list[tuple[str, int]], sizes: dict[int, int] | None = None, penalty: float = PENALTY, identities=IDENTITIES, l1: float = L1, steps: int = STEPS):
        words = [set(LETTERS.findall(t.lower())) for t, _ in sample]
        target = np.array([float(y) for _, y in sample])
        self.memory: dict[str, float] = {}
        self.weights: dict[str, float] = {}
        positive = float(target.sum())
        sizes = {v: (sizes or {}).get(v) or float((target == v).sum()) for v in (0, 1)}
        self.base = float(np.log((sizes[1] + 1) / (sizes[0] + 9)))
        if not 0 < positive < len(target):
            return
        bags = [_bag(w) for w in words]
        seen, bad = Counter(), Counter()
        for bag, y in zip(bags, target):
            seen.update(bag.keys())
            if y:
                bad.update(bag.keys())
        named = _bag({n for group in identities for n in group})
        clean = len(target) - positive

        def tells(f: str, n: int) -> bool:
            share = n / len(target)
            apart = bad[f] / positive - (n - bad[f]) / clean
            return apart * apart >= SCREEN**2 * share * (1 - share) * (1 / positive + 1 / clean) > 0

        vocab = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if f in named or (n >= LEAST and tells(f, n))))}
        vocab |= {f: i for i, f in enumerate(sorted(named - vocab.keys()), len(vocab))}
        rows, cols = self._index(bags, vocab)
        pairs = [(a, b) for w, bag in zip(words, bags) for s in swapped(w, identities) for a, b in [(bag, _bag(s))]]
        added = inserted(words, identities)
        pairs += [pair for a, b in added.values() for pair in ((Counter(), _bag({a})), (_bag({a}), _bag({b})))]
        told = self._index([_bag({added[i][0]}) if i in added else Counter() for i in range(len(bags))], vocab)
        plus, plus_cols = self._index([b - a for a, b in pairs], vocab)
        minus, minus_cols = self._index([a - b for a, b in pairs], vocab)
        w = self._fit(np.concatenate([rows, told[0]]), np.concatenate([cols, told[1]]), target, (plus, plus_cols, minus, minus_cols, len(pairs)), len(vocab), penalty, l1, steps)
        share = np.where(target > 0, sizes[1] / positive, sizes[0] / clean) / (sizes[0] + sizes[1])
        scale, self.base = self._calibrate(np.bincount(rows, w[cols], len(target)), target, share)
        self.weights = {f: float(scale * w[i]) for f, i in vocab.items() if w[i]}

    @staticmethod
    def _index(bags: list[Counter], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the counts, an entry for each count."""
        found = [[i for f, n in bag.items() if (i := vocab.get(f)) is not None for _ in range(n)] for bag in bags]
        rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
        return rows, np.fromiter((i for x in found for i in sorted(x)), dtype=np.int32, count=len(rows))

    def _fit(self, rows, cols, y, pairs, n_features, penalty, l1, steps):
        """Accelerated proximal gradient; label values weigh alike."""
        plus, plus_cols, minus, minus_cols, n_pairs = pairs
        weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        w = z = np.zeros(n_features)
        b = c = 0.0
        t = 1.0

        def pulled(v):
            """Gradient of the penalty: its value is the mean squared change times its strength."""
            change = np.bincount(plus, v[plus_cols], n_pairs) - np.bincount(minus, v[minus_cols], n_pairs)
            pull = 2 * penalty * change / max(n_pairs, 1)
            return np.bincount(plus_cols, pull[plus], n_features) - np.bincount(minus_cols, pull[minus], n_features)

        probe = np.full(n_features, n_features**-0.5)
        for _ in range(8):  # largest curvature of loss and penalty, by power iteration
            curve = np.bincount(cols, (weight * np.bincount(rows, probe[cols], len(y)))[rows], n_features) / 4 + pulled(probe)
            bend = float(np.linalg.norm(curve))
            probe = curve / max(bend, 1e-12)
        rate = 1 / (1.2 * bend + 0.25)
        for _ in range(steps):
            logit = np.bincount(rows, z[cols], len(y)) + c
            slope = weight * (1 / (1 + np.exp(-logit)) - y)
            grad = np.bincount(cols, slope[rows], n_features)
            if n_pairs and penalty:
                grad += pulled(z)
            new = z - rate * grad
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
            new_b = c - rate * slope.sum()
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            z, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
            w, b, t = new, new_b, t_new
        return w

    @staticmethod
    def _calibrate(sums: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, float]:
        """Scale and base by which the sums give probabilities at the true shares of the label values (Newton's method)."""
        x = np.stack([sums, np.ones_like(sums)], axis=1)
        at = np.array([1.0, 0.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            slope = x.T @ (share * (p - y)) + 1e-4 * at
            bend = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
            step = np.linalg.solve(bend, slope)
            at = at - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        return max(float(at[0]), 0.0), float(at[1])

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}

    def _weight(self, word: str) -> float:
        w = self.memory.get(word)
        if w is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            w = self.memory[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def score(self, text: str | None) -> float:
        words = set(LETTERS.findall(text.lower())) if text else ()
        total = self.base + sum(map(self._weight, words))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def name_lists(names: DataFrame) -> tuple[tuple[str, ...], ...]:
    """Lists of names from a table (list, name) of at most MOST_NAMES rows, in lower case; nulls are left out."""
    rows = names.select("list", F.lower("name").alias("name")).dropna().distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    lists: dict = {}
    for r in sorted(rows, key=str):
        lists.setdefault(r["list"], []).append(r["name"])
    return tuple(tuple(v) for v in lists.values())


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", names: DataFrame | None = None, **options) -> ToxicityModel:
    """Learns from about TEXTS labelled texts for each value, of at most TEXT_BYTES bytes each, whole; unlabelled rows don't count.

    ``names`` (list, name) takes the place of IDENTITIES.
    """
    if names is not None:
        options["identities"] = name_lists(names)
    sample, sizes = labelled_sample(docs, labels.select("doc_id", label_col), label_col, TEXTS, TEXT_BYTES)
    return ToxicityModel(sample, sizes, **options)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Probability from 0 to 1 that a text is toxic, over its whole length.

    Null and empty texts get the model's base rate.  If nothing was learned (no labels, or one value only) every text
    gets that rate.  Equal texts get equal scores.
    """

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    run = trimmed(scores)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return toxic(text)
