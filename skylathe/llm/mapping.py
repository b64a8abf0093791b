"""Free-entered values mapped to the closest entry of a reference list; values that mean none get 0.

1. The values of a field are deduplicated; only distinct ones are scored.
2. A value and the entries are normalised and cut into character n-grams, of the words and of their
   consonant skeletons (people abbreviate by dropping vowels). An inverted index of the entries' n-grams,
   weighted by inverse document frequency, gives the cosine with every entry that shares one; all entries
   above a fraction of the best cosine are candidates.
3. Candidates get a soft weighted cosine over words: words count as far as they match, by spelling distance or
   as an abbreviation. Codes (part numbers) are compared by spelling distance as a whole.
4. The best entry is accepted above a threshold and with a margin to the second.

A list of counted, bounded size goes to the workers as an index, so values are not shuffled once they are
distinct. A longer one stays a table: its n-grams and those of the values meet in an equi-join (without the most
common n-grams of a value, as far as they cannot decide), and only candidate pairs reach the comparison. Both
ways have the same candidates. Words that say nothing, marks and look-alike letters are the caller's to give
(``Rules``); none is built in.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..operators.skew import HEAVY_FLOOR, heavy_keys, skew_join
from ..session import cut

#: Most entries of a list whose index is sent to the workers (about 20 MB); a longer list is joined.
BLOCK = 50_000
#: Entries below this share of the best cosine, or below the least one, are no candidates. With 0 for both, all
#: entries that share an n-gram are compared.
CANDIDATE_SHARE = 0.5
CANDIDATE_LEAST = 0.1
#: Share of its score that an entry keeps when the value has nothing for one of its words.
PARTIAL = 0.8


@dataclass(frozen=True)
class Rules:
    """How values of a field are read and when an entry is accepted."""

    code: bool = False  #: a code compared as a whole, not a name of words
    threshold: float = 0.73
    margin: float = 0.01
    noise: frozenset[str] = frozenset()  #: words, in upper case, that do not say what something is
    edits: tuple[tuple[str, str], ...] = ()  #: patterns and what takes their place in values in upper case, in order
    alike: tuple[str, str] = ("", "")  #: letters of codes read as others, on both sides of a comparison


# ---- normal forms ------------------------------------------------------------------------------------

_INNER_SLASH = re.compile(r"(?<=[A-Z])/(?=[A-Z])")
_NOT_WORD = re.compile(r"[^A-Z0-9]+")
_VOWEL = re.compile(r"[AEIOU]")
_DOUBLE = re.compile(r"(.)\1+")


def _edited(value: str, rules: Rules) -> str:
    s = value.upper().strip()
    for pattern, new in rules.edits:
        s = re.sub(pattern, new, s)
    return s


def words_of(value: str, rules: Rules = Rules(), entry: bool = False) -> list[str]:
    """Words of a name; those of an entry all count."""
    words = _NOT_WORD.sub(" ", _INNER_SLASH.sub("", _edited(value, rules))).split()
    return words if entry else [w for w in words if w not in rules.noise] or words


def code_of(value: str, rules: Rules) -> str:
    return _NOT_WORD.sub("", _edited(value, rules)).translate(str.maketrans(*rules.alike))


def read(value: str, rules: Rules, entry: bool = False) -> list[str]:
    return [c] if rules.code and (c := code_of(value, rules)) else [] if rules.code else words_of(value, rules, entry)


def skeleton(word: str) -> str:
    return word[:1] + _DOUBLE.sub(r"\1", _VOWEL.sub("", word[1:]))


def _grams(text: str) -> Iterator[str]:
    padded = f"^{text}$"
    for n in (2, 3):
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def features(words: list[str], code: bool) -> Counter:
    out: Counter = Counter()
    for w in words:
        out.update(_grams(w))
        if not code:
            out.update("~" + g for g in _grams(skeleton(w)))
    return out


# ---- similarity --------------------------------------------------------------------------------------


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, change, swap of neighbours) from a to b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what both begin and end with needs no edit
    n, k = min(len(a), len(b)), 0
    while k < n and a[k] == b[k]:
        k += 1
    e = 0
    while e < n - k and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if not a or not b:
        return len(a) + len(b)
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        low = row[0]
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = before[j - 1] if x == y else 1 + min(before[j], row[j - 1], before[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row[j] = d
            low = min(low, d)
        if low > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


def _within(short: str, long: str) -> bool:
    rest = iter(long)
    return all(ch in rest for ch in short)


def word_match(typed: str, meant: str) -> float:
    """How far a typed word may stand for an entry's word, 0 to 1."""
    if typed == meant:
        return 1.0
    if typed in (meant + "S", meant + "ES"):
        return 0.98
    best = 0.0
    n = max(len(typed), len(meant))
    most = 1 if n <= 3 else 2 if n <= 7 else 3
    d = distance(typed, meant, most)
    if d <= most and d < len(meant) / 2 + 0.5:
        best = 1 - d / n
        if typed.endswith("S"):
            d = distance(typed[:-1], meant, most)
            best = max(best, 0.98 - d / n) if d <= most else best
    if typed[0] == meant[0]:
        bones = skeleton(meant)
        if skeleton(typed) == bones and len(typed) >= 3:
            best = max(best, 0.95)
        elif typed == bones:
            best = max(best, 0.8)
        elif len(typed) >= 3 and meant.startswith(typed):
            # of two words that begin so, the one it covers more of
            best = max(best, 0.86 + 0.1 * len(typed) / len(meant))
        elif 2 <= len(typed) < len(meant) and _within(typed, meant):
            # the more of the consonants it keeps the surer
            best = max(best, (0.78 if len(typed) > 2 else 0.6) + 0.12 * min(1.0, len(typed) / max(1, len(bones))))
        elif len(bones) >= 4 and not _VOWEL.search(typed[1:]) and distance(typed, bones, 1) <= 1:
            best = max(best, 0.8)
    return best


# ---- comparison with entries -------------------------------------------------------------------------


def word_weight(n: int, c: int) -> float:
    return 1 + 0.25 * math.log((1 + n) / (1 + c))


class Scorer:
    """Compares words with entries, given how often n-grams and words are in the list."""

    def __init__(self, rules: Rules, grams: dict[str, int], n: int, typical: float) -> None:
        self.rules, self.typical = rules, typical
        self.idf = {g: 1 + math.log((1 + n) / (1 + c)) for g, c in grams.items()}
        self.rare = 1 + math.log(1 + n)
        self.known: dict[tuple[str, str], float] = {}

    def vector(self, words: list[str]) -> dict[str, float]:
        """Weighted n-grams, of length 1."""
        v = {g: c * self.idf.get(g, self.rare) for g, c in features(words, self.rules.code).items()}
        norm = math.sqrt(sum(w * w for w in v.values())) or 1.0
        return {g: w / norm for g, w in v.items()}

    def match(self, typed: str, meant: str) -> float:
        key = (typed, meant)
        m = self.known.get(key)
        if m is None:
            if len(self.known) > 500_000:
                self.known.clear()
            m = self.known[key] = word_match(typed, meant)
        return m

    def soft(self, typed: list[str], meant: list[str], weights: list[float], letters: frozenset[str]) -> float:
        """Soft weighted cosine of the typed words and an entry's: each word is matched at most once."""
        pairs = sorted(((m, i, j) for i, t in enumerate(typed) for j, w in enumerate(meant) if (m := self.match(t, w)) > 0), reverse=True)
        used_t: dict[int, tuple[float, float]] = {}
        used_m = set()
        dot = 0.0
        for m, i, j in pairs:
            if i not in used_t and j not in used_m:
                used_t[i] = (m, weights[j])
                used_m.add(j)
                dot += m * weights[j] ** 2
        norm_m = sum(w * w for w in weights)
        norm_t = sum(used_t[i][1] ** 2 if i in used_t else (0.7 * self.typical) ** 2 for i in range(len(typed)))
        score = dot / math.sqrt(norm_m * norm_t) if dot else 0.0
        if len(used_m) < len(meant):  # a word of the entry has no counterpart: it may be any entry with the others
            score *= PARTIAL
        a, b = "".join(typed), "".join(meant)
        if len(b) >= 6:  # words run together or torn apart, slips in more than one word
            most = 3 if len(b) >= 12 else 2
            # an edit changes at most two members of the sets of characters
            d = distance(a, b, most) if score < 0.99 - 1e-9 and len(set(a) ^ letters) <= 2 * most else most + 1
            if d <= most:
                score = max(score, 0.99 - d / len(b))
        return score

    def score(self, typed: list[str], meant: list[str], weights: list[float], letters: frozenset[str], cosine: float) -> float:
        if self.rules.code:
            d = distance(typed[0], meant[0], 2)
            s = (1.0, 0.9, 0.75, 0.0)[d] if len(meant[0]) >= 6 else float(d == 0)
        else:
            s = self.soft(typed, meant, weights, letters)
        return s + 1e-4 * cosine  # ties of the exact comparison go by the cosine

    @staticmethod
    def two_best(scored: Iterable[tuple[int, float]]) -> tuple[int, float, float]:
        """Id and score of the best entry and the score of the next one; of equal ones the first in order."""
        first, second, at = 0.0, 0.0, 0
        for k, s in scored:
            if s > first:
                first, second, at = s, first, k
            elif s > second:
                second = s
        return at, first, second


class Index(Scorer):
    """A list of bounded size with its inverted index of n-grams."""

    def __init__(self, entries: list[tuple[int, str]], rules: Rules, share: float = CANDIDATE_SHARE, least: float = CANDIDATE_LEAST) -> None:
        self.share, self.least = share, least
        held = [(i, w) for i, x in entries if (w := read(x, rules, True))]
        self.ids, self.words = [i for i, _ in held], [w for _, w in held]
        df = Counter(w for ws in self.words for w in set(ws))
        weight = {w: word_weight(len(entries), c) for w, c in df.items()}
        super().__init__(rules, Counter(g for ws in self.words for g in features(ws, rules.code)), len(entries), float(np.mean(list(weight.values()))) if df else 1.0)
        self.weights = [[weight[w] for w in ws] for ws in self.words]
        self.letters = [frozenset("".join(ws)) for ws in self.words]
        postings: dict[str, list] = defaultdict(list)
        for k, ws in enumerate(self.words):
            for g, w in self.vector(ws).items():
                postings[g].append((k, w))
        self.postings = {g: (np.array([k for k, _ in p]), np.array([w for _, w in p])) for g, p in postings.items()}
        self.results: dict[tuple[str, ...], tuple[int, float, float]] = {}

    def cosines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries that share an n-gram, in order, and their cosines."""
        hits = [(p[0], w * p[1]) for g, w in self.vector(words).items() if (p := self.postings.get(g)) is not None]
        if not hits:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        sums = np.bincount(np.concatenate([h[0] for h in hits]), weights=np.concatenate([h[1] for h in hits]))
        at = np.nonzero(sums)[0]
        return at, sums[at]

    def best(self, value: str) -> tuple[int, float, float]:
        words = read(value, self.rules)
        if not words:
            return 0, 0.0, 0.0
        key = tuple(words)
        found = self.results.get(key)
        if found is None:
            if len(self.results) > 100_000:
                self.results.clear()
            at, cos = self.cosines(words)
            low = max(self.least, self.share * cos.max()) if len(cos) else 0.0
            found = self.results[key] = self.two_best((self.ids[k], self.score(words, self.words[k], self.weights[k], self.letters[k], c)) for k, c in zip(at.tolist(), cos.tolist()) if c >= low)
        return found


# ---- the operator ------------------------------------------------------------------------------------


SCORED = "value string, item_id bigint, first double, second double"


def _by_index(mine: DataFrame, index: Index) -> DataFrame:
    shipped = mine.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shipped.value
        for b in batches:
            found = [ix.best(v) for v in b["value"]]
            yield pd.DataFrame({"value": b["value"], "item_id": [f[0] for f in found], "first": [f[1] for f in found], "second": [f[2] for f in found]})

    return mine.select("value").mapInPandas(run, SCORED)


def _by_join(mine: DataFrame, own: DataFrame, rules: Rules, share: float, least: float) -> DataFrame:
    """As ``_by_index``, for a list of any length."""

    def entries_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [read(x, rules, True) for x in b["label"]]
            yield pd.DataFrame({"item_id": b["item_id"], "words": words, "grams": [list(features(w, rules.code)) for w in words]})

    entries = cut(own.mapInPandas(entries_of, "item_id bigint, words array<string>, grams array<string>"))
    n = entries.count()
    entries = entries.filter("size(words) > 0")
    # words are of 36 letters and digits, so there are no more than 2 * (38 ** 2 + 38 ** 3) n-grams, some 110,000
    grams = {r["g"]: r["n"] for r in entries.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    word = entries.select("item_id", F.posexplode("words").alias("k", "w"))
    weight = cut(word.select("item_id", "w").distinct().groupBy("w").agg((1 + 0.25 * F.log((1 + n) / (1 + F.count(F.lit(1))))).alias("weight")))
    typical = weight.agg(F.avg("weight")).first()[0] or 1.0
    weighed = word.join(weight, "w").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("k", "w", "weight"))).alias("e"))
    weighed = cut(weighed.select("item_id", F.transform("e", lambda e: e["w"]).alias("words"), F.transform("e", lambda e: e["weight"]).alias("weights")))
    shipped = mine.sparkSession.sparkContext.broadcast(Scorer(rules, grams, n, typical))
    slack = 0.9 * least

    def rows_of(column: str, name: str, dropped: float):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = shipped.value
            for b in batches:
                rows = []
                for key, x in zip(b[name], b[column]):
                    v = sorted(scorer.vector(read(x, rules) if column == "value" else list(x)).items(), key=lambda gw: (gw[1], gw[0]))
                    square, k = 0.0, 0
                    while k < len(v) and square + v[k][1] ** 2 <= dropped**2:
                        square, k = square + v[k][1] ** 2, k + 1
                    rows.extend((key, g, w) for g, w in v[k:])
                yield pd.DataFrame(rows, columns=[name, "g", "w"])

        return run

    values = mine.select("value").mapInPandas(rows_of("value", "value", slack), "value string, g string, w double")
    postings = weighed.select("item_id", "words").mapInPandas(rows_of("words", "item_id", 0.0), "item_id bigint, g string, w double").withColumnRenamed("w", "x")
    part = cut(values.join(postings, "g").groupBy("value", "item_id").agg(F.sum(F.col("w") * F.col("x")).alias("part")))
    top = part.groupBy("value").agg(F.max("part").alias("top"))
    near = part.join(top, "value").filter(F.col("part") + slack + 1e-9 >= F.greatest(F.lit(least), share * F.col("top"))).select("value", "item_id")
    pairs = near.join(weighed, "item_id").groupBy("value").agg(F.array_sort(F.collect_list(F.struct("item_id", "words", "weights"))).alias("c"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = shipped.value
        for b in batches:
            rows = []
            for value, c in zip(b["value"], b["c"]):
                words = read(value, rules)
                v = scorer.vector(words)
                held = []
                for e in c:
                    meant = list(e["words"])
                    u = scorer.vector(meant)
                    held.append((e["item_id"], meant, list(e["weights"]), sum(w * u.get(g, 0.0) for g, w in v.items())))
                low = max(least, share * max(h[3] for h in held))
                best = scorer.two_best((i, scorer.score(words, m, ws, frozenset("".join(m)), cos)) for i, m, ws, cos in held if cos >= low)
                rows.append((value, *best))
            yield pd.DataFrame(rows, columns=["value", "item_id", "first", "second"])

    found = pairs.mapInPandas(pick, SCORED)
    return mine.select("value").join(found, "value", "left").select("value", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("item_id", "bigint"), ("first", "double"), ("second", "double"))])


def map_values(values: DataFrame, lists: DataFrame, rules: dict[str, Rules], block: int = BLOCK, floor: int = HEAVY_FLOOR, share: float = CANDIDATE_SHARE, least: float = CANDIDATE_LEAST) -> DataFrame:
    """(field_name, row_id, item_id) of each non-blank value that is not literally an entry of its list.

    ``values``: field_name, row_id, value. ``lists``: item_id, list_name (a field's name), label. ``rules``
    has an entry for each field. Null, empty and white values are left out; a value that means no entry, or
    is as close to another one, gets item 0; so does every value if the list is empty. Repeated rows each
    get a row. A list of more than ``block`` entries is joined rather than sent to the workers, with the same result.
    """
    rows = values.select("field_name", "row_id", "value").filter(squeeze(F.col("value")) != "")
    exact = lists.select(F.col("list_name").alias("field_name"), F.col("label").alias("value")).distinct()
    counted = cut(rows.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n")).join(exact, ["field_name", "value"], "left_anti"))
    distinct = counted.select("field_name", "value")
    scored = None
    for name, rule in rules.items():
        own = lists.filter(F.col("list_name") == name).select("item_id", "label")
        # few bytes and much work: spread by what forms of one value share, so that a task scores them once
        spread = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        mine = distinct.filter(F.col("field_name") == name).select("value").repartition(spread, F.regexp_replace(F.upper("value"), "[^A-Z0-9]", ""))
        held = own.orderBy("item_id").limit(block + 1).collect()
        one = _by_index(mine, Index([tuple(r) for r in held], rule, share, least)) if len(held) <= block else _by_join(mine, own, rule, share, least)
        one = one.withColumn("field_name", F.lit(name))
        sure = (F.col("first") >= rule.threshold) & (F.col("first") - F.col("second") >= rule.margin)
        one = one.select("field_name", "value", F.when(sure, F.col("item_id")).otherwise(F.lit(0)).cast("bigint").alias("item_id"))
        scored = one if scored is None else scored.unionByName(one)
    hot = heavy_keys(counted, ["field_name", "value"], "n", floor=floor)
    mapped = cut(scored)
    return skew_join(rows, mapped, ["field_name", "value"], hot, "inner").select("field_name", "row_id", "item_id")
