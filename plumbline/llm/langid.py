"""Language identification by rank-order profiles (Cavnar and Trenkle, "N-gram-based text categorization", 1994).

A profile lists the most frequent n-grams (1 to 3 characters of lower-cased words, a word's ends counting as a character)
by falling count. A document's distance to a language sums, over the document's own top n-grams, how far each is out of
place in the language's list; an absent one costs the list's length."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, map_arrow

#: N-grams in a profile and of a document.
TOP = 400
UNKNOWN = "und"


#: Bits of a character in an n-gram's code: no letter has a greater code point.
BITS = 18


@cache
def _letters() -> np.ndarray:
    """Every code point's own id, 0 for what is no letter."""
    ids = np.zeros(0x110000, np.int64)
    for i in range(1 << BITS):
        if chr(i).isalpha():
            ids[i] = i
    return ids


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a whole text, repeats included: 2 bits for n, then BITS bits for each character."""
    if not text:
        return np.empty(0, np.int64)
    ids = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    ids = np.concatenate(([0], ids, [0]))
    ids = ids[np.r_[True, (ids[1:] | ids[:-1]) != 0]]  # one 0 between words
    if len(ids) < 3:
        return np.empty(0, np.int64)
    two = (ids[:-1] << BITS) | ids[1:]
    three = (two[:-1] << BITS) | ids[2:]
    three = three[ids[1:-1] != 0]
    n = 3 * BITS
    return np.concatenate((ids[ids != 0] | 1 << n, two | 2 << n, three | 3 << n))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, np.empty(0, np.int64)
    codes = np.sort(codes)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.diff(np.r_[starts, len(codes)])


def ranked(text: str | None, top: int) -> np.ndarray:
    """A text's most frequent n-grams, ties by code."""
    codes, counts = counted(ngrams(text))
    return codes[np.argsort(-counts, kind="stable")[:top]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> dict[str, np.ndarray]:
    """A profile for each language, from all rows whose text and lang are not null.

    Tasks count n-grams and Spark adds the counts up; only the top n-grams of each language come to the driver."""

    def make():
        def step(batch):
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            texts = texts.to_pylist()
            for name in sorted(set(langs)):
                sums: dict = {}
                held, size = [], 0
                rows = [t for t, x in zip(texts, langs, strict=True) if x == name]
                for i, t in enumerate(rows):
                    held.append(ngrams(t))
                    size += len(held[-1])
                    if size > 2_000_000 or i == len(rows) - 1:
                        codes, counts = counted(np.concatenate(held))
                        if sums:
                            both = np.concatenate((sums["c"], codes))
                            uniq, at = np.unique(both, return_inverse=True)
                            sums = {"c": uniq, "n": np.bincount(at, np.concatenate((sums["n"], counts))).astype(np.int64)}
                        else:
                            sums = {"c": codes, "n": counts}
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(sums["c"]), pa.string()), pa.array(sums["c"]), pa.array(sums["n"].astype(np.int64))], ["lang", "code", "n"])

        return step

    rows = docs.select(col(text).cast("string").alias("t"), col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    sums = map_arrow(rows, make, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    profiles: dict[str, list[int]] = {}
    for r in sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.code)
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


def predictor(profiles: dict[str, np.ndarray], top: int = TOP):
    """text -> (language, score): the score is the runner-up's distance over the sum of the two least distances."""
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.empty(0, np.int64)
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    for i, x in enumerate(langs):
        ranks[i, np.searchsorted(known, profiles[x])] = np.arange(len(profiles[x]))

    def predict(text: str | None) -> tuple[str, float]:
        own = ranked(text, top)
        if not len(own) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(known, own)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        theirs = ranks[:, at]
        away = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(own)))).sum(1)
        order = np.argsort(away, kind="stable")
        first, second = (int(away[order[0]]), int(away[order[1]])) if len(langs) > 1 else (int(away[0]), top * len(own))
        return langs[order[0]], (second / (first + second) if first + second else 0.5)

    return predict


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", top: int = TOP, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred string and score double, named as `out` says; the other columns pass through.

    `und` with score 0 for a null text or one without a letter, or if nothing was learnt. Ties go to the first language
    in alphabetical order. Columns of docs with these names are replaced; repeated rows stay; an empty table gives none."""
    rest = [c for c in docs.columns if c.lower() not in {x.lower() for x in out}]
    (plain,) = fresh(docs, "text_to_identify")
    schema = docs.select(*map(col, rest)).schema.add(out[0], "string").add(out[1], "double")
    source = docs.select(*map(col, rest), col(text).cast("string").alias(plain))

    def make():
        predict = predictor(profiles, top)

        def step(batch):
            found = [predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], schema.names)

        return step

    return map_arrow(source, make, schema)
