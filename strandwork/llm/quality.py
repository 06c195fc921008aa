"""Quality scores by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm import fit
from strandwork.llm.common import fraction, slices, stored, texts_of

#: Trusted positives, and unlabelled texts, that the fit takes at most: those of the least hash.
SAMPLE = 20_000

_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" ", "line": b"\n\r", "stop": b".?!", "comma": b",;:", "mark": b"!", "symbol": b"#$%&*+=@^~\\_", "bar": b"|", "bracket": b"()[]{}<>", "quote": b"\"'`", "dash": b"-/"}
FEATURES = [*_CLASSES, "wide", "runs", "size", "words", "word_size", "word_spread", "distinct", "follows", "end_symbol", "end_mark", "all_upper", "line_words", "line_spread", "line_distinct", "top_word", "capital", "one_letter", "number", "web", "pairs"]


def features(text: str) -> list[float]:
    """Shares of character classes, and shape and repetition of words and lines; the whole text counts."""
    raw = text.encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [counts[list(c)].sum() / n for c in _CLASSES.values()]
    bytes_ = np.frombuffer(raw, np.uint8)
    same = float((bytes_[1:] == bytes_[:-1]).mean()) if n > 1 else 0.0
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lowered = text.lower().split()
    tally: dict[str, int] = {}
    for w in lowered:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    per_line = np.array([x.count(" ") + 1 for x in lines] or [0], np.float64)
    last = [w[-1] for w in words]
    return [
        *shares, counts[128:].sum() / n, same, np.log1p(n) / 10, np.log1p(len(words)) / 10, sizes.mean() / 10, sizes.std() / 10, len(tally) / m ** 0.8, sum(map(str.__eq__, lowered, lowered[1:])) / m,
        sum(c in "#$%&*" for c in last) / m, sum(c in "!|" for c in last) / m, sum(map(str.isupper, words)) / m, np.log1p(per_line.mean()) / 5, per_line.std() / (1 + per_line.mean()), len(set(lines)) / max(1, len(lines)),
        max(tally.values(), default=0) / m, sum(w[0].isupper() for w in words) / m, float((sizes == 1).mean()), sum(map(str.isdigit, words)) / m, (text.count("http") + text.count("@") + text.count("www.")) / m, len({*zip(lowered, lowered[1:], strict=False)}) / m,
    ]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in texts_of(batch)], np.float64).reshape(batch.num_rows, len(FEATURES))


def _least(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """The ids of the least hashes, `most` of them at most: a bounded sample that no order decides."""
    n = ids.count()
    if n <= most:
        return ids
    # twice the share that is wanted, so that the sort that ends it holds few rows
    return ids.filter(fraction("doc_id", seed) < 2 * most / n).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """A model from trusted positives and unlabelled texts.

    The positives are documents with label 1, the unlabelled texts come from all documents given, whatever their
    labels; labels of 0 are never used. Both are samples of at most `sample` ids, decided from the ids, and their texts are read
    once. A first network tells positives from unlabelled texts; its scores of the half that it has not seen give the class prior
    (fit.class_prior), with which the non-negative risk is then minimised. Null labels and texts without a label count as
    unlabelled only, null texts as empty, repeated label rows once. Without any label 1 the model gives 0.5 for every text.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trusted = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    ids = base.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    chosen = _least(ids.join(trusted, "doc_id", "left_semi"), sample, 5).withColumn("trusted", F.lit(1)).unionByName(_least(ids, sample, 6).withColumn("trusted", F.lit(0)))
    # at most two times `sample` ids go to all tasks
    roles = stored(chosen.groupBy("doc_id").agg(F.max("trusted").alias("trusted"), (F.min("trusted") == 0).alias("unlabelled")), "roles", 2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(_rows(batch).ravel()), len(FEATURES)).cast(pa.list_(pa.float64())), *batch.select(["trusted", "unlabelled"]).columns], ["x", "trusted", "unlabelled"])

    found = base.join(F.broadcast(roles), "doc_id").select("text", "trusted", "unlabelled").mapInArrow(run, "x array<double>, trusted int, unlabelled boolean").toPandas()
    if not found["trusted"].any():
        return {"flat": 0.5}
    x = np.stack(found["x"].to_numpy())
    # no order of the rows matters
    order = np.lexsort(x.T)
    x, mine, others = x[order], found["trusted"].to_numpy()[order] == 1, found["unlabelled"].to_numpy(bool)[order]
    positive, unlabelled = x[mine], x[others] if others.any() else x
    centre, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    scale = lambda v: np.clip((v - centre) / spread, -6, 6)
    positive, unlabelled = scale(positive), scale(unlabelled)
    prior = 0.5
    if min(len(positive), len(unlabelled)) >= 20:
        # a risk with the prior 1/2 and no part held at zero is that of telling the two samples apart
        first, _ = fit.nonnegative_pu(positive[::2], unlabelled[::2], 0.5, steps=600, apart=True)
        prior = fit.class_prior(fit.network(first, positive[1::2]), fit.network(first, unlabelled[1::2]))
    weights, risk = fit.nonnegative_pu(positive, unlabelled, prior)
    return {"weights": weights, "centre": centre, "spread": spread, "prior": prior, "risk": risk}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: positive likelier) of every row; null texts count as empty, equal texts score alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            if "flat" in model:
                found = np.full(batch.num_rows, model["flat"])
            else:
                found = fit.sigmoid(fit.network(model["weights"], np.clip((_rows(batch) - model["centre"]) / model["spread"], -6, 6)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(found, 9))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
