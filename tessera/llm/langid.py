"""Language identification: the family first, then one-versus-one linear support vector machines within it.

All models are linear in the relative frequencies of hashed byte trigrams of the lower-cased text, so a
text's margin is the mean of its trigrams' weights. They are fitted on all labelled texts: these are counted
once, and each step of the descent sums gradients over all counts. Every text is read whole, in training and
in prediction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, shared_dir

#: Families of language codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["ar", "he", "mt"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
BITS = 12
#: ASCII other than letters, and all controls, count as spaces.
_CLEAN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def trigram_codes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def cleaned(text: str | None) -> bytes:
    """Lower-cased UTF-8 between single spaces; empty if the text is null or has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_CLEAN).split()) + b" "


class Model:
    """Margins of a text for each family against the others and for each pair of languages of a family: weights and bias, a row each."""

    def __init__(self, langs: list[str], weights: np.ndarray | None = None, bias: np.ndarray | None = None) -> None:
        self.langs = sorted(langs)
        self.families = sorted({family(x) for x in self.langs})
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if family(a) == family(b)]
        self.weights = np.zeros((0, 1 << BITS), np.float32) if weights is None else weights
        self.bias = np.zeros(0) if bias is None else bias

    def sides(self) -> np.ndarray:
        """For each task and language 1, -1 or, where the task doesn't concern it, 0."""
        own = [[1 if family(x) == f else -1 for x in self.langs] for f in self.families] if len(self.families) > 1 else []
        own += [[1 if x == a else -1 if x == b else 0 for x in self.langs] for a, b in self.pairs]
        return np.array(own, np.float32).reshape(len(own), len(self.langs))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [cleaned(t) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        sized = [c for c in clean if c]
        margins = np.zeros((0, len(self.bias)))
        if sized:
            codes = trigram_codes(b"".join(sized))
            ends = np.cumsum([len(c) for c in sized])
            starts = np.concatenate(([0], ends[:-1]))
            margins = np.empty((len(sized), len(self.bias)))
            for m, w in enumerate(self.weights):
                sums = np.concatenate(([0.0], np.cumsum(w[codes], dtype=np.float64)))
                margins[:, m] = (sums[ends - 2] - sums[starts]) / (ends - 2 - starts) + self.bias[m]
        langs, scores, rows = [], [], iter(margins)
        for c in clean:
            lang, margin = self._decide(next(rows)) if c else ("und", None)
            langs.append(lang)
            scores.append(0.0 if margin is None else float(1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))))
        return langs, scores

    def _decide(self, margins: np.ndarray) -> tuple[str, float]:
        n = len(self.families) if len(self.families) > 1 else 0
        best = int(np.argmax(margins[:n])) if n else 0
        least = margins[best] - max(np.delete(margins[:n], best)) if n else np.inf
        own = [x for x in self.langs if family(x) == self.families[best]]
        of = {x: [] for x in own}
        for (a, b), m in zip(self.pairs, margins[n:], strict=True):
            if a in of:
                of[a].append(m)
                of[b].append(-m)
        lang = max(own, key=lambda x: (sum(m > 0 for m in of[x]), sum(of[x])))
        return lang, float(min([least, *of[lang]]))


def _frequencies(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The languages and trigrams' relative frequencies of the texts of each row."""
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        langs, sizes, uses, at, counts = (np.frombuffer(x, t) for x, t in zip(row, (np.int32, np.int64, np.int32, np.uint16, np.int32), strict=True))
        x = np.zeros((len(langs), 1 << BITS), np.float32)
        x[np.repeat(np.arange(len(langs)), uses), at] = counts / np.repeat(sizes, uses)
        yield langs, x


def _summed(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], size: int, groups: int = 16) -> np.ndarray:
    """What add(total, langs, frequencies) adds up to over all rows: a total a task, then a few groups of tasks; the driver gets one total a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            for langs, x in _frequencies(batch):
                add(total, langs, x)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], ["task", "total"])

    def join(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda r: r["task"])
        return pa.table({"task": pa.array([got[0]["task"]]), "total": pa.array([sum(np.frombuffer(r["total"]) for r in got).tobytes()], pa.binary())})

    totals = rows.mapInArrow(run, "task long, total binary").groupBy(F.col("task") % groups).applyInArrow(join, "task long, total binary").collect()
    return sum((np.frombuffer(r["total"]) for r in sorted(totals, key=lambda r: r["task"])), np.zeros(size))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, penalty: float = 1e-4, rounds: int = 150, least_gain: float = 1e-3) -> Model:
    """Fits on every labelled text of the folds that aren't held out: support vector machines with squared hinge loss, classes weighted alike, all at once by accelerated gradient steps.

    Each round reads the texts' trigram counts, which are written once to the shared folder. Rounds end when one lowers the
    mean loss by less than least_gain of that of zero weights. The driver gets sums (32 kB a task or language, 16 times a round at
    most), the weights and the list of languages, which are few.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    taught = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
    counts = {r[0]: r[1] for r in taught.groupBy(lang_col).count().collect()}
    model = Model(list(counts))
    sides, dims = model.sides(), 1 << BITS
    tasks, number = len(sides), {x: k for k, x in enumerate(model.langs)}
    if not tasks:
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                clean = [cleaned(t) for t in batch.column(1).to_pylist()]
                found = [np.bincount(trigram_codes(c), minlength=dims) if len(c) > 2 else np.zeros(dims, np.int64) for c in clean]
                places = [np.flatnonzero(f) for f in found]
                columns = [[number[x] for x in batch.column(0).to_pylist()], [max(1, len(c) - 2) for c in clean], [len(p) for p in places], np.concatenate(places), np.concatenate([f[p] for f, p in zip(found, places, strict=True)])]
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(x, t).tobytes()], pa.binary()) for x, t in zip(columns, (np.int32, np.int64, np.int32, np.uint16, np.int32), strict=True)], ["langs", "sizes", "uses", "at", "counts"])

    folder = f"{shared_dir(spark).rstrip('/')}/trigrams-{uuid.uuid4().hex}"
    schema = "langs binary, sizes binary, uses binary, at binary, counts binary"
    taught.select(lang_col, text_col).mapInArrow(count, schema).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(schema).parquet(folder)

    def moments(total: np.ndarray, langs: np.ndarray, x: np.ndarray) -> None:
        own = np.eye(len(number), dtype=np.float32)[langs].T
        total += np.stack((own @ x, own @ (x * x))).ravel()

    first, second = _summed(rows, moments, 2 * len(number) * dims).reshape(2, len(number), dims)
    n = np.array([counts[x] for x in model.langs], np.float64)
    mean = first.sum(0) / n.sum()
    scale = 1 / (np.sqrt(np.maximum(0, second.sum(0) / n.sum() - mean * mean)) + 1e-4)
    squares = second @ (scale * scale)
    norm = max(1e-9, float(np.sqrt(squares.sum() / n.sum())))
    weight = np.where(sides > 0, 0.5 / np.maximum(1, (n * (sides > 0)).sum(1, keepdims=True)), 0.5 / np.maximum(1, (n * (sides < 0)).sum(1, keepdims=True))) * (sides != 0)
    step = 1 / (2 * (weight * (squares / norm**2 + n)).sum(1) + penalty)
    w = v = np.zeros((tasks, dims + 1))
    before = 1.0
    for k in range(rounds):
        at, offset = np.ascontiguousarray((v[:, :-1] * scale / norm).T, np.float32), v[:, -1].astype(np.float32)

        def gradients(total: np.ndarray, langs: np.ndarray, x: np.ndarray, at: np.ndarray = at, offset: np.ndarray = offset) -> None:
            y = sides.T[langs]
            slack = np.maximum(0, 1 - y * (x @ at + offset))
            pull = (weight.T[langs] * slack).astype(np.float32)
            total[-1] += (pull * slack).sum() / tasks
            pull *= y
            total[:-1] += np.vstack((x.T @ pull, pull.sum(0))).ravel()

        total = _summed(rows, gradients, (dims + 1) * tasks + 1)
        pulls = total[:-1].reshape(dims + 1, tasks).T * np.append(scale / norm, 1.0)
        new = v - step[:, None] * (penalty * v - 2 * pulls)
        w, v = new, new + (k / (k + 3)) * (new - w)
        if k and before - total[-1] < least_gain:
            break
        before = total[-1]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return Model(model.langs, (w[:, :-1] * scale / norm).astype(np.float32), w[:, -1])


def fold(id_col: str, folds: int = 5):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row for each input row: id_col, held_out, lang_pred, score (the logistic of twice the least margin on the way to the language).

    und with score 0 where the text is null or has no letter. A null id is in no fold: held_out is false.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                langs, scores = model.predict(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(fold(id_col, folds) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"{id_col} long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **names: str) -> DataFrame:
    """Fits on docs and predicts every row of docs; empty tables give no rows, and where nothing is labelled all are und."""
    return predict(docs, fit(docs, **names), **{k: v for k, v in names.items() if k != "lang_col"})


def keep_identified(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that language ID rejects: no letter, or a score below least_score. lang becomes the prediction, with the columns in their order."""
    model = fit(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                names = batch.schema.names
                langs, scores = model.predict(batch.column(names.index(text_col)).to_pylist())
                batch = batch.set_column(names.index(lang_col), pa.field(lang_col, pa.string()), pa.array(langs, pa.string()))
                yield batch.filter(pa.array([x != "und" and s >= least_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
