"""Language identification in two steps: the family, then the language within the family.

A multinomial logistic regression tells the family. Within a family, a linear support vector
machine for each pair of its languages votes. All are trained by ``pyspark.ml`` on shares of
hashed character n-grams, and being linear, all score a text in one pass: the mean of the
weights found at its n-grams' places.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tokens import claim, slices
from tidemark.plans.staging import drop, staged

#: Families of languages by ISO 639-1 code. Others form a family of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
UNDETERMINED = "und"
#: Places that n-grams of up to ORDERS characters are hashed to.
PLACES, ORDERS = 1 << 15, 3
#: At most so many labelled documents of each language are learned from.
PER_LANGUAGE = 800
#: Iterations of each fit.
ROUNDS = 8
#: Characters scored at once.
SCORED_CHARS = 400_000
#: A longer text is scored in parts of so many characters that overlap, so that each of its
#: n-grams counts once.
PART_CHARS = 1_000_000


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members.split()), f"only {language}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The character itself if it is a letter, else a space, for the basic plane."""
    return np.array([c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)


def _characters(text: str) -> np.ndarray:
    """Lower-case letters with one space for what stands between them and at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    beyond = c >= 1 << 16
    c = np.where(beyond, c, _letters()[c & 0xFFFF])
    if beyond.any():
        c[np.isin(c, [x for x in np.unique(c[beyond]) if not chr(x).isalpha()])] = 32
    gap = c == 32
    gap[1:] &= gap[:-1].copy()
    gap[0] = False
    return c[~gap]


def _places(c: np.ndarray) -> list[np.ndarray]:
    """For each order, the places of the n-grams that begin at each character."""
    out, h = [], np.zeros(len(c), np.uint32)
    for k in range(ORDERS):
        h = h[: len(c) - k] * np.uint32(0x01000193) + c[k:] * np.uint32(0x9E3779B1) + np.uint32(k)
        mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        out.append((mixed >> np.uint32(17)).astype(np.int32))
    return out


def _shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at, shares = [], []
        for text in batch.column(1):
            where, n = np.unique(np.concatenate(_places(_characters(text.as_py()))), return_counts=True)
            at.append(where)
            shares.append(n / n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))], names=["lang", "at", "shares"])


@dataclass
class LanguageModel:
    """weights: a row for each place, a column for each family and then for each pair."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, scores: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores from 0 to 1: the family's probability times the chosen
        language's mean chance against the others. Ties go to the first in order."""
        n = len(self.families)
        e = np.exp(scores[:, :n] - scores[:, :n].max(axis=1, keepdims=True))
        family = e / e.sum(axis=1, keepdims=True)
        best, out, sure = family.argmax(axis=1), [], family.max(axis=1)
        chance = 1 / (1 + np.exp(-2 * np.clip(scores[:, n:], -30, 30)))
        column = {p: k for k, p in enumerate(self.pairs)}
        for row, f in enumerate(best):
            langs = self.members[self.families[f]]
            if len(langs) == 1:
                out.append(langs[0])
                continue
            won = dict.fromkeys(langs, 0.0)
            votes = dict.fromkeys(langs, 0)
            for a, b in combinations(langs, 2):
                p = chance[row, column[a, b]]
                won[a] += p
                won[b] += 1 - p
                votes[a if p >= 0.5 else b] += 1
            lang = max(langs, key=lambda x: (votes[x], won[x]))
            out.append(lang)
            sure[row] *= won[lang] / (len(langs) - 1)
        return out, sure


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """A model of ``labelled`` (doc_id, text, lang); None if no row can be learned from.

    Learns from at most ``per_language`` documents of each language, chosen by a hash of their
    ids, and from their whole texts.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    usable = labelled.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.where("lang is not null and text is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000))
    wanted = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000, int(1_200_000 * per_language / n) + 1))])
    likely = usable.withColumn("draw", draw).where(F.col("draw") < wanted[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    sample = likely.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text")
    rows = staged(sample.mapInArrow(_shares, "lang string, at array<int>, shares array<double>"), "languages", scratch := [])
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    vector = F.udf(lambda at, shares: Vectors.sparse(PLACES, at, shares), VectorUDT())
    data = rows.select("lang", vector("at", "shares").alias("features")).persist()

    families = sorted({family_of(x) for x in langs})
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    pairs = [p for f in families for p in combinations(members[f], 2)]
    weights, bias = np.zeros((PLACES, len(families) + len(pairs)), np.float32), np.zeros(len(families) + len(pairs))
    if len(families) > 1:
        index = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(families.index(family_of(lang))))])
        fit = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=ROUNDS, tol=1e-3).fit(data.withColumn("label", index[F.col("lang")]))
        weights[:, : len(families)] = fit.coefficientMatrix.toArray().T
        bias[: len(families)] = fit.interceptVector.toArray()
    for k, (a, b) in enumerate(pairs, len(families)):
        two = data.where(F.col("lang").isin(a, b)).withColumn("label", (F.col("lang") == a).cast("double"))
        fit = LinearSVC(regParam=1e-3, maxIter=ROUNDS, tol=1e-3).fit(two)
        weights[:, k], bias[k] = fit.coefficients.toArray(), fit.intercept
    data.unpersist()
    drop(labelled.sparkSession, scratch)
    return LanguageModel(families, members, pairs, weights, bias)


def _score(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        model: LanguageModel | None = shared.value
        for batch in slices(batches):
            langs, scores = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
            held: list[tuple[int, np.ndarray, int]] = []
            sums = np.zeros((batch.num_rows, model.weights.shape[1] if model else 0))
            sizes = np.zeros(batch.num_rows)

            def flush() -> None:
                if not held:
                    return
                c = np.concatenate([x for _, x, _ in held])
                rows, ends = [r for r, _, _ in held], np.cumsum([len(x) for _, x, _ in held])
                begins = ends - [len(x) for _, x, _ in held]
                for k, at in enumerate(_places(c)):
                    w = model.weights[at]
                    # Not counted: what would reach into the next text, and what the next part begins with.
                    cuts = [max(k, shared) for _, _, shared in held]
                    for end, cut in zip(ends, cuts, strict=True):
                        w[max(0, end - cut) : end] = 0
                    np.add.at(sums, rows, np.add.reduceat(w, begins, axis=0, dtype=np.float64))
                    np.add.at(sizes, rows, ends - begins - cuts)
                held.clear()

            size = 0
            for row, text in enumerate(batch.column("text")):
                c = _characters((text.as_py() or "") if model else "")
                if not (c != 32).any():
                    continue
                start, last = 0, False
                while not last:
                    last = len(c) - start <= PART_CHARS + ORDERS
                    part = c[start:] if last else c[start : start + PART_CHARS + ORDERS - 1]
                    held.append((row, part, 0 if last else ORDERS - 1))
                    start, size = start + PART_CHARS, size + len(part)
                    if size >= SCORED_CHARS:
                        flush()
                        size = 0
            flush()
            known = np.flatnonzero(sizes)
            if len(known):
                found, sure = model.decide(sums[known] / sizes[known, None] + model.bias)
                for row, lang, s in zip(known, found, sure, strict=True):
                    langs[row], scores[row] = lang, float(s)
            kept = [n for n in batch.schema.names if n not in ("lang_pred", "score")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether a document is never learned from; one without an id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def with_letters(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text has a letter, as :func:`identify` tells it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([any(map(str.isalpha, t.as_py() or "")) for t in batch.column("text")], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def identify(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Every row of ``documents`` with lang_pred and score by its whole text; columns of these
    names give way.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Rows that repeat an id are each predicted; no column but text enters a prediction. The
    model is broadcast: its size depends on the number of languages, never on the documents.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in documents.schema if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return documents.select(*[f.name for f in kept]).mapInArrow(_score(shared), schema)


def language_id(documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: :func:`train` on the documents that are not held
    out, then :func:`identify` all."""
    model = train(documents.where(~held_out()), per_language)
    return identify(documents.select(F.col("doc_id").cast("long"), "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
