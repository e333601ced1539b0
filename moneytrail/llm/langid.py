"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram is bound by multiplying the vectors of its letters, each rotated by
its place; the n-grams of a text are bundled by adding them up, those of a language's texts likewise. The language of a
document is the one whose profile has the largest cosine with the document's bundle.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moneytrail.llm.helpers import hinted
from moneytrail.scratch import materialize_counted

DIMENSIONS = 1024
SEED = 7
#: The most labelled documents a language's profile is learnt from: those with the smallest hashes of their ids.
LEARN_ROWS = 500
#: Characters and documents bundled at once, n-grams bound at once, and documents compared with the profiles at once.
CHARS, DOCS, GRAMS, SLICE = 50_000, 64, 2048, 256
#: Length of a document's bundle when it is added to a profile.
UNIT = 2**20
UNKNOWN = "und"
#: Standard deviations of the cosine of random vectors, 1 / sqrt(dimensions), that a text must reach to be like a language,
#: if it has at least SURE different n-grams. Fewer give also clean texts low cosines: the bar falls with their square, to none below FEW.
NOISE, SURE, FEW = 4.5, 100, 20
_SPACE = 0


class Letters:
    """Random vectors of letters, made when a letter is first met; every process makes the same."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.places: dict[int, int] = {}
        self.vectors = np.empty((0, dimensions), dtype=np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of distinct codes, a row each."""
        new = [c for c in codes.tolist() if c not in self.places]
        if new:
            made = [np.random.default_rng((self.seed, c)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1 for c in new]
            for c in new:
                self.places[c] = len(self.places)
            self.vectors = np.concatenate([self.vectors, np.array(made, dtype=np.int8)])
        return self.vectors[[self.places[c] for c in codes.tolist()]]


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lowered letters of a text, runs of other characters as one 0, one 0 at either end; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    kinds, place = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)
    codes = np.where(letter[place], codes, _SPACE) if len(codes) else codes
    if not codes.any():
        return codes[:0]
    codes = np.concatenate(([_SPACE], codes, [_SPACE]))
    return codes[(codes != _SPACE) | np.append(True, codes[:-1] != _SPACE)]


def trigrams(codes: np.ndarray) -> np.ndarray:
    """Three consecutive codes as one number; code points have 21 bits."""
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


def bundles(texts: list[str], letters: Letters) -> np.ndarray:
    """Sum of the n-gram vectors of each text, a row per text. Texts are walked in stretches, so long ones need little memory."""
    out = np.zeros((len(texts), letters.dimensions))
    waiting, owners, size = [], [], 0
    for i, text in enumerate(texts):
        codes = letter_codes(text)
        for at in range(0, len(codes) - 2, CHARS):
            grams = trigrams(codes[at:at + CHARS + 2])
            waiting.append(grams)
            owners.append(i)
            size += len(grams)
            if size >= CHARS or len(waiting) >= DOCS:
                _bundle(waiting, owners, letters, out)
                waiting, owners, size = [], [], 0
    if waiting:
        _bundle(waiting, owners, letters, out)
    return out


def _bundle(waiting: list[np.ndarray], owners: list[int], letters: Letters, out: np.ndarray) -> None:
    place, grams = pd.factorize(np.concatenate(waiting))
    piece = np.repeat(np.arange(len(waiting)), [len(g) for g in waiting])
    counts = np.bincount(piece * len(grams) + place, minlength=len(waiting) * len(grams)).reshape(len(waiting), len(grams))
    mask = (1 << 21) - 1
    parts = []
    for back, shift in ((2, 42), (1, 21), (0, 0)):
        codes, at = np.unique((grams >> shift) & mask, return_inverse=True)
        parts.append((np.roll(letters.of(codes), back, axis=1), at))
    sums = np.zeros((len(waiting), letters.dimensions), dtype=np.float32)
    for at in range(0, len(grams), GRAMS):
        bound = np.ones((min(GRAMS, len(grams) - at), letters.dimensions), dtype=np.int8)
        for vectors, of in parts:
            bound *= vectors[of[at:at + GRAMS]]
        sums += counts[:, at:at + GRAMS].astype(np.float32) @ bound.astype(np.float32)
    np.add.at(out, owners, sums)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves no rest by 5. Documents without an id are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, rows: int = LEARN_ROWS) -> dict[str, np.ndarray]:
    """Profiles of the languages in ``lang``, of length one, from at most ``rows`` documents each that are not held out.

    Each document counts the same, however long. The driver holds one vector for each language, the model itself. Partial
    bundles of whole numbers are added up by Spark, so the order of adding doesn't matter.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    order = F.xxhash64("doc_id", F.lit(SEED))
    counts, languages = materialize_counted(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # rows whose hash is clearly not among the smallest are dropped before the sort, whatever the number of rows
    share = F.least(F.lit(1.0), F.lit(4.0 * rows) / F.col("n"))
    low = labelled.select("lang", "doc_id", order.alias("order")).join(hinted(counts, languages), "lang").where(
        F.col("order") <= share * 2.0**64 - 2.0**63
    )
    smallest = Window.partitionBy("lang").orderBy("order", "doc_id")
    chosen, most = materialize_counted(
        low.withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= rows).select("lang", "doc_id").distinct(),
        "labelled-sample",
    )
    sample = labelled.select("lang", "doc_id", "text").join(hinted(chosen, most), ["lang", "doc_id"])  # at most ``rows`` a language

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, sums = Letters(), {}
        for batch in batches:
            for lang, vector in zip(batch["lang"], bundles(batch["text"].to_list(), letters)):
                if vector.any():
                    sums[lang] = sums.get(lang, 0) + np.rint(vector * (UNIT / np.linalg.norm(vector))).astype(np.int64)
        for lang, vector in sums.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(len(vector)), "value": vector})

    added = sample.select("lang", "text").mapInPandas(add_up, "lang string, place int, value bigint")
    profiles: dict[str, np.ndarray] = {}
    for r in added.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect():
        profiles.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["place"]] = r["value"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(profiles.items()) if v.any()}


def distinct_grams(text: str) -> int:
    """Different n-grams of a text; of a long one those of its start, if they are SURE or more."""
    for part in (text[:4000], text) if len(text) > 4000 else (text,):
        codes = letter_codes(part)
        found = len(np.unique(trigrams(codes))) if len(codes) else 0
        if found >= SURE:
            break
    return found


def noise_bar(grams: int) -> float:
    """Cosine below which a text of so many different n-grams is like no language."""
    return 0.0 if grams < FEW else NOISE / DIMENSIONS**0.5 * min(1.0, grams / SURE) ** 2


def predicted(text: str | Column, profiles: dict[str, np.ndarray]) -> Column:
    """Struct of lang_pred, score (the cosine with the nearest profile but not below 0) and like (whether it reaches ``noise_bar``).

    ``und`` and 0 for a null text, one without a letter, or if nothing was learnt. Of equal cosines the first language by
    name wins.
    """
    names = np.array(list(profiles), dtype=object)
    matrix = np.array([profiles[n] for n in names]).T if len(names) else np.zeros((DIMENSIONS, 0))
    full_bar = noise_bar(SURE)

    @F.pandas_udf("lang_pred string, score double, like boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for texts in batches:
            texts = [t or "" for t in texts]
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            # a slice at a time, so that a batch needs no more memory than its texts
            for at in range(0, len(texts) if len(names) else 0, SLICE):
                rows = bundles(texts[at:at + SLICE], letters)
                norms = np.linalg.norm(rows, axis=1)
                known = np.flatnonzero(norms > 0)
                cosines = (rows[known] / norms[known, None]) @ matrix
                best = cosines.argmax(axis=1)
                lang[at + known] = names[best]
                score[at + known] = np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)
            like = [s >= full_bar or s >= noise_bar(distinct_grams(t)) for s, t in zip(score, texts)]
            yield pd.DataFrame({"lang_pred": lang, "score": score, "like": np.array(like, dtype=bool)})

    return nearest(text)


def identify(docs: DataFrame, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """Predicted language of every document: doc_id, held_out, lang_pred, score.

    ``docs`` has doc_id, text and lang; other columns are ignored. Learns from ``lang`` of documents not held out, predicts
    from the whole text alone. One row per input row; a null, empty or letterless text is ``und`` with score 0, as is any
    text if no document has a language. An empty table gives an empty result.
    """
    found = predicted("text", learn(docs, learn_rows))
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, least: float | None = None, learn_rows: int = LEARN_ROWS) -> DataFrame:
    """Rows, with all columns, whose text has a letter and a cosine with a language of at least ``least``, by default ``noise_bar``.

    A null, empty or letterless text goes, as does any text if no document has a language to learn from. Repeated rows are judged
    alike; a text of any length is judged whole. An empty table gives an empty result.
    """
    found = predicted("text", learn(docs, learn_rows))
    near = found["like"] if least is None else found["score"] >= least
    return docs.where((found["lang_pred"] != UNKNOWN) & near)
