"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a fixed lexicon of insults and of a lexicon learned from the training texts
(words and word beginnings that mark toxic ones), also after undoing common obfuscations; the nearness of
second-person pronouns; rates of capitals, punctuation and obfuscated words. Trees are fitted by Spark ML
on FIT_SHARE of the training sample, and an isotonic regression on the rest turns their margin into a
probability; a part that lacks a class gives way to the whole sample. Labels are read from training
rows alone; ids, languages and sources are no features.

Defined results: a null or empty text has all features 0 and gets a score like any other. Documents
whose label is null or missing train nothing; of several labels of an id the largest counts. Scoring is
within a row. Without a training row of either class every score is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import ready_python, scratch, text_of

#: At most about so many labelled documents are drawn for training, by a hash of their ids.
TRAIN_ROWS = 20_000
#: Of the training sample; the rest calibrates.
FIT_PERCENT = 75
#: Words and word beginnings in the learned lexicon, at most.
LEXICON = 4_000
#: Toxic documents that a learned entry stands in, at least; and their share of the toxic ones, in per cent.
SUPPORT = 4
SUPPORT_PERCENT = 1
PREFIXES = (4, 5, 6)
NEAR = 6
THRESHOLD = 0.7

#: Insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool jerk "
    "imbecile creep liar vermin filth hate kill ugly retard bastard shut "
    "dumm dummkopf arschloch abschaum hässlich wertlos erbärmlich versager "
    "imbécile crétin salaud ordure minable stupide nul dégoûtant "
    "idiota imbécil estúpido basura inútil asqueroso patético tonto".split()
)
#: Second-person pronouns.
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
#: Characters that stand for letters.
LEET = str.maketrans("0134578@$!+", "oieastbasit")

FEATURES = [
    "log_words", "fixed_density", "fixed_count", "learned_density", "learned_count", "learned_max", "learned_mean",
    "prefix_density", "prefix_max", "near_second", "second_density", "capital_share", "capital_words", "bangs", "punctuation",
    "obfuscated", "hidden_count", "stretched",
]


#: Stripped from the ends of words.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’„«»…–—¡¿"
THRICE = re.compile(r"(.)\1\1+")

#: Per code point below 0x250: letter, upper case, other than letter, digit or white space; the rest counts as letters.
_KNOWN = [chr(c) for c in range(0x250)]
CLASSES = np.array([[c.isalpha(), c.isupper(), not (c.isalnum() or c.isspace())] for c in _KNOWN] + [[True, False, False]], np.float64)


def normal(word: str) -> str:
    """Lower case, without punctuation at the ends."""
    return word.lower().strip(EDGES)


def plain(word: str) -> str:
    """Without common obfuscations: look-alikes, characters put between letters, letters said three times or more."""
    if not word.isalpha():
        word = "".join(c for c in word.translate(LEET) if c.isalpha())
    return THRICE.sub(r"\1\1", word)


def entries(word: str) -> list[str]:
    """What the learned lexicon may hold of a word: itself, and its beginnings (with a hyphen)."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)] if word else []


class _Codes(dict):
    """token -> row of a table of what is known of it; emptied between texts when full, which changes no result.

    Columns: insult, learned odds, odds of a beginning, second person, capitals only, obfuscated, hidden insult, stretched.
    """

    MOST = 400_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.table = lexicon, np.zeros((4096, 8), np.float32)

    def __missing__(self, token: str) -> int:
        k, get = len(self), self.lexicon.get
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        word = normal(token)
        alone = word.isalpha()
        bare = word if alone and not THRICE.search(word) else plain(word)
        known = get(word, 0.0)
        begins = max(get(word[:n] + "-", 0.0) if len(word) > n else 0.0 for n in PREFIXES)
        hidden = bare != word and (bare in INSULTS or bare in self.lexicon)
        if hidden:
            known = known or get(bare, 0.0)
        odd = not alone and any(c.isalpha() for c in word) and not word.replace("-", "").replace("'", "").replace("’", "").isalpha()
        row = (word in INSULTS or (hidden and bare in INSULTS), known, begins, word in SECOND, len(word) > 1 and token.isupper(), odd, hidden, alone and bare != word)
        if any(row):
            self.table[k] = row
        self[token] = k
        return k


def features_of(text: str, codes: _Codes) -> list[float]:
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    at = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
    table = codes.table[at].astype(np.float64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, upper, other = np.bincount(np.minimum(points, 0x250), minlength=0x251) @ CLASSES
    n = len(tokens)
    total = table.sum(axis=0)
    learned, begins = table[:, 1], table[:, 2]
    hit = (table[:, 0] > 0) | (learned > 0) | (begins > 0)
    second = np.flatnonzero(table[:, 3])
    near = 0
    if len(second) and hit.any():
        places = np.flatnonzero(hit)
        k = np.searchsorted(second, places)
        gap = np.minimum(np.abs(places - second[np.minimum(k, len(second) - 1)]), np.abs(places - second[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR).sum())
    count = int((learned > 0).sum())
    return [
        np.log1p(n), total[0] / n, total[0], total[1] / n, count, learned.max(), total[1] / max(1, count),
        (begins > 0).sum() / n, begins.max(), near, total[3] / n, upper / max(1, letters), total[4] / n, text.count("!") / n,
        other / len(points), total[5] / n, total[6], total[7] / n,
    ]


@dataclass
class Model:
    """Lexicon (bounded by LEXICON), trees and calibration; trees are None where a class had no training row."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None


def _features(text: Column, lexicon: dict[str, float]) -> Column:
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        codes, rows = _Codes(lexicon), []
        for t in texts.to_pylist():
            if len(codes) >= codes.MOST:
                codes = _Codes(lexicon)
            rows.append(features_of(t, codes))
        return pa.array(rows, pa.list_(pa.float64()))

    return of(text)


def _margin(scored: DataFrame) -> DataFrame:
    return scored.withColumn("margin", vector_to_array("rawPrediction")[1])


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts, with their log odds; (text, y) rows."""

    @F.arrow_udf("array<string>")
    def marks(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({e for w in set(t.split()) for e in entries(normal(w))}) for t in texts.to_pylist()], pa.list_(pa.string()))

    train = train.dropDuplicates(["text"])  # copies of a text are one witness; a sample of bounded size
    n = train.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    support = max(SUPPORT, n[0] * SUPPORT_PERCENT // 100)
    odds = F.log((F.col("hit") + 0.5) / (n[0] + 1) / ((F.col("miss") + 0.5) / (n[1] + 1)))
    counts = (
        train.select("y", F.explode(marks("text")).alias("entry"))
        .groupBy("entry").agg(F.sum("y").alias("hit"), F.sum(1 - F.col("y")).alias("miss"))
        .filter(F.col("hit") >= support)
        .withColumn("odds", odds)
        .filter("odds > 2 AND hit > 12 * miss")
    )
    best = counts.orderBy(F.desc(F.col("odds") * F.log1p("hit")), "entry").limit(LEXICON)
    return {r["entry"]: r["odds"] for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from labels (id, label 0/1); give it the training rows alone."""
    ready_python(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = min(1.0, TRAIN_ROWS / max(1, sum(counts.values())))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    drawn = known.filter(place < int(share * 1_000_000))
    if share < 1:  # a class too rare to be drawn is drawn by its own count
        for y in counts.keys() - {r["y"] for r in drawn.select("y").distinct().collect()}:
            drawn = drawn.unionByName(known.filter((F.col("y") == y) & (place < int(min(1.0, TRAIN_ROWS / counts[y]) * 1_000_000))))
    part = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(100)) < FIT_PERCENT
    # a table of TRAIN_ROWS small rows, or few more
    train = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text}`")).alias("text")).join(F.broadcast(drawn), "id")
    train = scratch(train.select("text", "y", part.alias("fits")), "train")
    kinds = {(r["fits"], r["y"]) for r in train.select("fits", "y").distinct().collect()}
    if len({y for _, y in kinds}) < 2:
        return Model({}, None, None)
    # a part that lacks a class gives way to all training rows
    fitting, calibrating = (part if {(fits, 0), (fits, 1)} <= kinds else "true" for fits, part in ((True, "fits"), (False, "NOT fits")))
    lexicon = learn_lexicon(train.filter(fitting))
    # a sample of bounded size: a few partitions do for the many short jobs of the fit
    table = scratch(train.select("y", "fits", _features(F.col("text"), lexicon).alias("f")).coalesce(4), "features")
    table = table.select(F.col("y").cast("double").alias("y"), "fits", array_to_vector("f").alias("features")).coalesce(4)
    trees = GBTClassifier(labelCol="y", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, seed=1, maxMemoryInMB=64).fit(table.filter(fitting))
    rest = _margin(trees.transform(table.filter(calibrating)))
    line = IsotonicRegression(labelCol="y", featuresCol="margin").fit(rest.select("y", "margin"))
    return Model(lexicon, trees, line)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(r, score): r has docs' columns; score is the calibrated probability of toxicity."""
    ready_python(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")
    if model.trees is None:
        return docs.select(row, F.lit(0.0).alias("score"))
    rows = docs.select(row, array_to_vector(_features(text_of(F.col(f"`{text}`")), model.lexicon)).alias("features"))
    out = model.calibration.setPredictionCol("calibrated").transform(_margin(model.trees.transform(rows)))
    # where the calibration is level, the margin still ranks
    smooth = 0.98 * F.col("calibrated") + 0.02 / (1 + F.exp(-2 * F.col("margin")))
    return out.select("r", F.least(F.greatest(smooth, F.lit(0.0)), F.lit(1.0)).alias("score"))


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may train: rows whose crc32 of the id as text leaves another remainder by 3 than 1."""
    return labels.filter(~held_out(F.col(id_col)))


def held_out(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score `threshold` or more."""
    good = score(docs, fit(docs, training_rows(labels, id_col), id_col, text), text).filter(F.col("score") < threshold)
    return good.select(*[F.col("r")[c].alias(c) for c in docs.columns])
