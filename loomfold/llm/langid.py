"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to 3, blended) present in both, over the root of the
product of their numbers of distinct n-grams. Landmark texts of each language span the Nyström space: a text's features
are its kernel values with the landmarks times the inverse root of the landmarks' own kernel matrix. One ridge regression
for each language against the rest is solved on a bounded labelled sample; all of it folds into one matrix from kernel
values to scores. n-grams are hashed to 18 bits, and only those that a landmark has are kept, as no other can be shared
with one. A batch of texts is scored by two matrix products.

Decisions can't tell that a text is in no learned language, as they sum to about the same for every text. The share of a
text's n-grams, repeats counted, that some landmark has can: it is low for other scripts and for random letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, bounded_batches

CODE_BITS = 18
#: A text is in no learned language below this part of the share that all but 1 % of its language's labelled rows reach.
LEAST_PART = 0.85


class Spectrum:
    """Presence of hashed n-grams of the lower-cased text; runs of anything but letters are one space."""

    def __init__(self, orders: tuple[int, ...] = (1, 2, 3)):
        import numpy as np

        self.orders = orders
        self.letters = np.array([chr(c).isalpha() for c in range(1 << 16)])

    def codes(self, text: str):
        """Hashed n-grams with repeats, or None for a text without letters."""
        import numpy as np

        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = np.minimum(points, 0xFFFF)
        letter = self.letters[low]
        beyond = np.flatnonzero(points > 0xFFFF)
        if len(beyond):
            letter[beyond] = [chr(c).isalpha() for c in points[beyond]]
        if not letter.any():
            return None
        chars = np.where(letter, points, 32)
        chars = chars[letter | np.concatenate(([True], letter[:-1]))].astype(np.uint64)
        out = []
        for n in self.orders:
            if len(chars) >= n:
                h = np.full(len(chars) - n + 1, n, dtype=np.uint64)
                for i in range(n):
                    h = (h ^ chars[i : len(chars) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                out.append((h >> np.uint64(64 - CODE_BITS)).astype(np.int64))
        return np.concatenate(out)

    def presence(self, text: str):
        """A byte for each hashed n-gram, or None for a text without letters."""
        import numpy as np

        codes = self.codes(text)
        if codes is None:
            return None
        seen = np.zeros(1 << CODE_BITS, dtype=np.uint8)
        seen[codes] = 1
        return seen


def spectrum_of(text: str | None):
    """(distinct hashed n-grams, how often each comes) as 32-bit arrays, or None for a text without letters."""
    import numpy as np

    codes = Spectrum().codes(text or "")
    if codes is None:
        return None
    own, n = np.unique(codes, return_counts=True)
    return own.astype(np.int32), n.astype(np.int32)


class Landmarks:
    """Landmark texts as a matrix of the n-grams that any of them has."""

    def __init__(self, own: list):
        import numpy as np

        self.codes = np.unique(np.concatenate(own)).astype(np.int64) if own else np.zeros(0, np.int64)
        self.matrix = np.stack([self.scaled(c) for c in own], 1) if own else np.zeros((0, 0), np.float32)
        self.holders = np.bincount(np.concatenate(own), minlength=1 << CODE_BITS).astype(np.int32) if own else np.zeros(1 << CODE_BITS, np.int32)

    def scaled(self, own):
        """Presence of the kept n-grams over the root of all of the text's."""
        import numpy as np

        present = np.zeros(1 << CODE_BITS, dtype=np.float32)
        present[own] = 1
        return present[self.codes] / np.float32(np.sqrt(len(own)))

    def kernel(self, own):
        return self.scaled(own) @ self.matrix

    def share(self, own, n, is_landmark: bool) -> float:
        """The share of a text's n-grams, repeats counted, that a landmark has; a landmark is judged by the others."""
        return float(n[self.holders[own] > int(is_landmark)].sum() / n.sum())


class KernelModel:
    """Landmarks and the folded regression; ``langs`` is empty if nothing could be learned."""

    def __init__(self, langs: list[str], landmarks: Landmarks, rows: list[tuple[str, bool, object, float]], ridge: float = 1e-2):
        """``rows``: language, whether it is a landmark (those in the landmarks' order), kernel values, share of known n-grams."""
        import numpy as np

        self.langs, self.codes, self.landmarks, self.fold = langs, landmarks.codes, landmarks.matrix, np.zeros((0, 0))
        self.least: dict[str, float] = {}
        if not langs:
            return
        kernel = np.stack([r[2] for r in rows]).astype(np.float64)
        values, vectors = np.linalg.eigh(np.stack([r[2] for r in rows if r[1]]).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        features = kernel @ root
        wanted = np.array([[1.0 if r[0] == own else -1.0 for own in langs] for r in rows])
        inner = features.T @ features + ridge * len(rows) * np.eye(features.shape[1]) / 100
        self.fold = root @ np.linalg.solve(inner, features.T @ wanted)
        for lang in langs:
            self.least[lang] = LEAST_PART * float(np.quantile([r[3] for r in rows if r[0] == lang], 0.01))

    @classmethod
    def of_texts(cls, texts: list[str], langs: list[str], landmarks: int = 96) -> KernelModel:
        """The model of a list of texts, the first ones of each language being its landmarks."""
        rows = [(s, lang) for t, lang in zip(texts, langs, strict=True) if (s := spectrum_of(t)) is not None]
        names = sorted({lang for _, lang in rows})
        each, seen, marks = max(1, landmarks // max(1, len(names))), dict.fromkeys(names, 0), []
        for _, lang in rows:
            seen[lang] += 1
            marks.append(seen[lang] <= each)
        order = sorted(range(len(rows)), key=lambda i: (not marks[i], rows[i][1]))
        chosen = Landmarks([rows[i][0][0] for i in order if marks[i]])
        return cls(names, chosen, [(rows[i][1], marks[i], chosen.kernel(rows[i][0][0]), chosen.share(*rows[i][0], marks[i])) for i in order])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The best language and its score, (1 + decision value) / 2 kept within 0 and 1; ``und`` with 0 for a text without letters."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """As :meth:`predict`, and whether the share of the text's n-grams that landmarks have speaks for a learned language at all."""
        import numpy as np

        spectrum = Spectrum()
        names, scores, known = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        rows, sizes, where, shares = [], [], [], []
        held = np.zeros(1 << CODE_BITS, dtype=bool)
        held[self.codes] = True
        for i, t in enumerate(texts):
            if t and self.langs and (c := spectrum.codes(t)) is not None:
                p = np.zeros(1 << CODE_BITS, dtype=np.uint8)
                p[c] = 1
                rows.append(p[self.codes])
                sizes.append(np.count_nonzero(p))
                where.append(i)
                shares.append(float(np.count_nonzero(held[c]) / len(c)))
        if rows:
            kernel = np.stack(rows).astype(np.float32) @ self.landmarks / np.sqrt(np.array(sizes, dtype=np.float32))[:, None]
            decision = kernel.astype(np.float64) @ self.fold
            for i, best, value, share in zip(where, decision.argmax(1), decision.max(1), shares, strict=True):
                names[i], scores[i] = self.langs[best], round(float(min(1.0, max(0.0, (1 + value) / 2))), 6)
                known[i] = share >= self.least[names[i]]
        return names, scores, known


def held_out(doc_id: Column) -> Column:
    """Whether the row takes no part in learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spectra(batches):
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 16):
            part = b.slice(at, 16)
            found = [spectrum_of(t) for t in part.column(2).to_pylist()]
            own, n = ([None if s is None else s[k].tobytes() for s in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary()), pa.array(n, pa.binary())], names=["lang", "place", "own", "n"])


def _kernels(landmarks, each: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = landmarks.value
        for b in batches:
            values, shares = [], []
            for place, own, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                own, n = np.frombuffer(own, "<i4"), np.frombuffer(n, "<i4")
                values.append(known.kernel(own).astype("<f8").tobytes())
                shares.append(known.share(own, n, place <= each))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.binary()), pa.array(shares, pa.float64())], names=["lang", "place", "kernel", "share"])

    return run


def fit_languages(docs: DataFrame, per_language: int = 300, landmarks: int = 96, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> KernelModel:
    """Fit on at most ``per_language`` labelled rows of each language, lowest hash of the id first, then of the text.

    That sample is the only part of the corpus that learning sees; its texts are whole, whatever their length. Rows with a
    null id, text or language, and those without letters, don't teach; rows alike in id, language and text teach once.
    Executors turn the sample into n-grams and kernel values: the driver gets the n-grams of the landmarks (about
    ``landmarks`` rows of at most 2 ** 18 numbers) and a row of kernel values for each teaching row. An empty table, or one
    without labels, gives a model without languages.
    """
    import numpy as np

    spark = docs.sparkSession
    bounded_batches(spark)
    body = docs[text].cast("string")
    own = docs.select(docs[lang].cast("string").alias("lang"), F.xxhash64(docs[doc_id]).alias("h1"), F.xxhash64(body).alias("h2"), body.alias("body"), docs[doc_id].alias("id"))
    own = own.where("id is not null and lang is not null and body is not null").where(~held_out(F.col("id"))).where(F.col("body").rlike(r"\p{L}")).drop("id")
    # Spark keeps the first rows of each language in each partition before it exchanges them
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h1", "h2"))
    keys = own.select("lang", "h1", "h2").withColumn("k", first).where(F.col("k") <= per_language).drop("k").distinct()
    keys = keys.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h1", "h2")))
    with Scratch(spark) as scratch:
        keys = scratch.table(keys, "teaching-keys")  # per_language rows of each language at most
        chosen = own.join(F.broadcast(keys), ["lang", "h1", "h2"]).dropDuplicates(["lang", "h1", "h2"]).select("lang", "place", "body")
        spectra = scratch.table(chosen.mapInArrow(_spectra, "lang string, place int, own binary, n binary").where("own is not null"), "spectra")
        langs = sorted(r["lang"] for r in spectra.select("lang").distinct().collect())  # a row for each language
        each = max(1, landmarks // max(1, len(langs)))
        # a text may be left out here as well, so places are numbered again
        spectra = spectra.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
        marks = spectra.where(F.col("place") <= each).orderBy("lang", "place").select("own").collect()
        known = Landmarks([np.frombuffer(r["own"], "<i4") for r in marks])
        shared = spark.sparkContext.broadcast(known)
        rows = spectra.mapInArrow(_kernels(shared, each), "lang string, place int, kernel binary, share double").collect()
        shared.destroy()
    rows = sorted(rows, key=lambda r: (r["place"] > each, r["lang"], r["place"]))
    return KernelModel(langs, known, [(r["lang"], r["place"] <= each, np.frombuffer(r["kernel"], "<f8"), r["share"]) for r in rows])


def _predict(parameters):
    def run(batches):
        import pyarrow as pa

        m = KernelModel([], Landmarks([]), [])
        m.__dict__.update(parameters.value)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                names, scores, known = m.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], names=["rest", "lang_pred", "lang_score", "lang_known"])

    return run


def predict_languages(docs: DataFrame, model: KernelModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``rest`` (a struct of the carried columns, all by default), ``lang_pred``, ``lang_score`` and ``lang_known``.

    Null texts, empty ones and texts without letters are ``und`` with score 0 and not known, as is everything if no language
    was learned. ``lang_known`` is false as well for texts whose n-grams speak against all learned languages. Texts of any
    length are read whole. Of languages with equal decisions the first in order of name is taken. Rows that repeat are
    judged each, an empty table gives none, and further columns, whatever their names, are carried in ``rest`` only.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by landmarks and hashed n-grams
    own = docs.select(F.struct(*[docs[c] for c in carry or docs.columns]).alias("rest"), docs[text].cast("string").alias("body"))
    return own.mapInArrow(_predict(shared), f"rest {own.schema['rest'].dataType.simpleString()}, lang_pred string, lang_score double, lang_known boolean")


def op8_string_kernel(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict_languages(docs, fit_languages(docs), carry=["doc_id"])
    return out.select(F.col("rest.doc_id").alias("doc_id"), held_out(F.col("rest.doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
