"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; each of its bits is one binary classifier: naive Bayes over hashed n-grams, the languages
with the bit set against the others. A text's bit margins are decoded to the codeword of the least loss, each bit weighted
for each language by how often the classifier got it right on that language. Where two codewords are nearly as near, the
prediction is flagged as ambiguous. Only text and lang of the rows given for training are learnt from, at most
ROWS_PER_LANGUAGE rows a language; every whole text is predicted from its bytes alone.

Defined cases: a null text or one without a letter is `und` with score 0; without any training row every text is `und`; with
one language, every other text is that language with score 1; repeated rows are predicted one by one; a null doc_id is
neither held out nor learnt from; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, utf8

#: Bound of the training sample.
ROWS_PER_LANGUAGE = 1500
#: n-gram lengths, each with a table of its own.
GRAMS = (2, 3)
TABLE = 1 << 16
UNDETERMINED = "und"
#: Difference of scores below which the two best languages are not told apart.
AMBIGUOUS = 0.05
SHARPNESS = 4.0
_STEP = 1 << 19

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_cells(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each gram length, the cell of the gram that begins at each byte; len(GRAMS) * TABLE for those that cross a document's end."""
    folded = _FOLD[data].astype(np.uint32)
    out = []
    for k, n in enumerate(GRAMS):
        code = np.zeros(len(data), np.uint32)
        for j in range(n):
            code[: len(data) - j] = code[: len(data) - j] << np.uint32(8) | folded[j:]
        cell = code.astype(np.int64) if n == 2 else (code * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)
        cell += k * TABLE
        ends = offsets[1:]
        for j in range(1, n):
            late = ends - j
            late = late[(late >= 0)]
            cell[late] = len(GRAMS) * TABLE
        out.append(cell)
    return out


def _margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each document's grams, for each bit; 0 without grams. weights has a last row of zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, weights.shape[1]))
    for a, b in chunks(offsets, _STEP):
        part = offsets[a : b + 1] - offsets[a]
        some = np.flatnonzero(np.diff(part))
        if not len(some):
            continue
        for cell in gram_cells(data[offsets[a] : offsets[b]], part):
            out[a + some] += np.add.reduceat(weights[cell], part[some], axis=0)
    return out / np.maximum(1, len(GRAMS) * np.diff(offsets) - sum(n - 1 for n in GRAMS))[:, None]


def codewords(languages: int) -> np.ndarray:
    """A +1/-1 codeword for each language: every split for few of them, else random splits."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 6:
        splits = [c for size in range(1, languages // 2 + 1) for c in combinations(range(languages), size) if size * 2 < languages or 0 in c]
        code = -np.ones((languages, len(splits)), np.int8)
        for b, c in enumerate(splits):
            code[list(c), b] = 1
        return code
    bits = int(np.ceil(10 * np.log2(languages)))
    rng = np.random.default_rng(5)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        if (np.abs(code.sum(axis=0)) == languages).any():
            continue
        least = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(languages), 2))
        if least > apart:
            best, apart = code, least
    return best


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray):
        self.languages, self.code, self.weights = languages, code.astype(np.float64), weights
        self.trust = np.ones(code.shape) / code.shape[1]

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _margins(data, offsets, self.weights)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, whether ambiguous) by weighted logistic loss."""
        loss = (np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.code) * self.trust).sum(axis=2)
        odds = np.exp(SHARPNESS * (loss.min(axis=1, keepdims=True) - loss))
        share = odds / odds.sum(axis=1, keepdims=True)
        ranked = np.sort(share, axis=1)
        second = ranked[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return loss.argmin(axis=1), ranked[:, -1], ranked[:, -1] - second < AMBIGUOUS


def training_rows(docs: DataFrame, where) -> DataFrame:
    """doc_id, lang, text of at most ROWS_PER_LANGUAGE rows of each language, a fixed pseudo-random choice."""
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # About twice as many as wanted pass by place alone; only their ids are ranked.
    near = rows.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(place < F.lit(1 << 31) * ROWS_PER_LANGUAGE / F.col("count"))
    own = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = near.withColumn("n", F.row_number().over(own)).where(F.col("n") <= ROWS_PER_LANGUAGE).select("doc_id", "lang").distinct()
    return rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")


def train(rows: DataFrame) -> Model | None:
    """A model of the languages of rows (lang, text); None without any row."""
    rows = rows.select("lang", "text")
    size = len(GRAMS) * TABLE

    def count(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist())
            total = {lang: np.zeros(size + 1) for lang in np.unique(langs)}
            for k in np.flatnonzero(np.diff(offsets)):
                part = data[offsets[k] : offsets[k + 1]]
                cells = np.concatenate(gram_cells(part, np.array([0, len(part)])))
                n = np.bincount(cells, minlength=size + 1)
                total[langs[k]] += n / len(cells)
            for lang, sums in total.items():
                used = np.flatnonzero(sums[:size])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(sums[used])], ["lang", "gram", "n"])

    sums = rows.mapInArrow(count, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most size rows a language
    if not sums.num_rows:
        return None
    languages = sorted(set(sums["lang"].to_pylist()))
    share = np.zeros((len(languages), size))
    which = np.searchsorted(languages, sums["lang"].to_pylist())
    share[which, sums["gram"].to_numpy()] = sums["n"].to_numpy()
    share = (share + 0.5 / size) / (share.sum(axis=1, keepdims=True) + 0.5)
    code = codewords(len(languages))
    weights = np.zeros((size + 1, code.shape[1]), np.float32)
    for b in range(code.shape[1] if len(languages) > 1 else 0):
        weights[:size, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    model = Model(languages, code, weights)

    def judge(batches):
        for batch in batches:
            margin = model.margins(*utf8(batch.column("text")))
            which = np.searchsorted(languages, batch.column("lang").to_pylist())
            right = (margin * model.code[which] > 0).astype(np.int64)
            for k in np.unique(which):
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([int((which == k).sum())]), pa.array([right[which == k].sum(axis=0).tolist()], pa.list_(pa.int64()))], ["lang", "n", "right"])

    bits = code.shape[1]
    seen = rows.mapInArrow(judge, "lang int, n long, right array<long>").groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.col("right")[b]).alias(f"b{b}") for b in range(bits)]).collect()  # a row a language
    if len(languages) > 1:
        for r in seen:
            right = np.array([r[f"b{b}"] for b in range(bits)]) + 1e-3
            model.trust[r["lang"]] = right / right.sum()
    return model


def predict(docs: DataFrame, model: Model | None, new: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """docs with the predicted language, its score and whether it is ambiguous, in columns of the names given."""
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        letter = regex.compile(r"\p{L}").search
        m = held.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n = batch.num_rows
            ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[data] >= 97) & (_FOLD[data] < 128), dtype=np.int64)])
            known = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            for k in np.flatnonzero(~known & (np.diff(offsets) > 0)):
                known[k] = letter(data[offsets[k] : offsets[k + 1]].tobytes().decode()) is not None
            pred, score, doubt = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
            if m is not None and n:
                best, share, unsure = m.decode(m.margins(data, offsets))
                pred = np.where(known, np.array(m.languages, object)[best], UNDETERMINED)
                score, doubt = np.where(known, share, 0.0), known & unsure
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(doubt)], [*names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{new[0]}` string, `{new[1]}` double, `{new[2]}` boolean")


def held_out(doc_id):
    """Whether crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: learnt from the rows that are not held out, predicted for all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(training_rows(rows, ~held_out(F.col("doc_id"))))
    out = predict(rows.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
