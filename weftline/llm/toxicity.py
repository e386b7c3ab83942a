"""Toxicity score from a small convolutional text classifier, trained in numpy inside Spark tasks on all labelled rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, python_ready, stored, whole_text

BUCKETS, WIDTH, SIZES, FILTERS, PREFIX = 1 << 15, 16, (1, 2, 3), 16, 5
WORD = re.compile(r"\w+")
#: Texts that a task fits on in a round, and rounds; between rounds the weights of all tasks are averaged.
SHARD, ROUNDS = 4800, 4
#: Weights that travel together to be averaged, and levels that log odds are counted in when they are scaled.
BLOCK, LEVELS, HIGHEST = 1 << 14, 50, 40
#: Scores tried as a language's threshold.
GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def word_rows(word: str) -> tuple[int, int]:
    """Embedding rows of a word: one for the whole word, one for its beginning."""
    return crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1, crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1


class Convolution:
    """Hashed word embeddings, filters of several widths, max pooling over the text, and a logistic output.

    Row 0 of the embedding stands for padding and stays zero. A text shorter than the widest filter is padded, so
    the empty text has a score too: that of the padding alone.
    """

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32), "out": np.zeros(FILTERS * len(SIZES), np.float32), "bias": np.zeros(1, np.float32)}
        self.p["E"][0] = 0
        for s in SIZES:
            self.p[f"W{s}"] = r.normal(0, 0.3, (s, WIDTH, FILTERS)).astype(np.float32)
            self.p[f"b{s}"] = np.zeros(FILTERS, np.float32)
        self.known: dict[str, tuple[int, int]] = {}

    def rows(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
        out = []
        for w in WORD.findall(text.lower()):
            r = known.get(w)
            if r is None:
                r = known[w] = word_rows(w)
            out.append(r)
        pad = max(0, max(SIZES) - len(out))
        return np.array(out + [(0, 0)] * pad, np.int32).reshape(-1, 2)

    def pooled(self, rows: np.ndarray, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter to a text, given by the rows of its words, and the place where it stands; read in blocks of ``step`` words."""
        best, place = np.full(FILTERS * len(SIZES), -np.inf, np.float32), np.zeros(FILTERS * len(SIZES), np.int64)
        for at in range(0, len(rows) - min(SIZES) + 1, step):
            x = self.p["E"][rows[at:at + step + max(SIZES) - 1]].sum(1).T.copy()
            for i, s in enumerate(SIZES):
                n, own = min(step, x.shape[1] - s + 1), slice(i * FILTERS, (i + 1) * FILTERS)
                if n > 0:
                    z = sum(self.p[f"W{s}"][j].T @ x[:, j:j + n] for j in range(s))
                    top = z.argmax(1)
                    value = z[np.arange(FILTERS), top] + self.p[f"b{s}"]
                    place[own] = np.where(value > best[own], top + at, place[own])
                    best[own] = np.maximum(best[own], value)
        return np.maximum(best, 0), place

    def scorer(self, words: int = 1 << 18, step: int = 2048):
        """The logit of a text, for a model that no longer changes: keeps the embeddings of up to ``words`` words.

        Texts are read in blocks of ``step`` words that overlap by the reach of the widest filter.
        """
        taps = [(i, j) for i, s in enumerate(SIZES) for j in range(s)]
        wide = np.concatenate([self.p[f"W{SIZES[i]}"][j] for i, j in taps], axis=1).T.copy()
        shift = np.concatenate([self.p[f"b{s}"] for s in SIZES])
        table, number = np.zeros((words + 1, WIDTH), np.float32), {}
        reach, rows = max(SIZES) - 1, self.p["E"]

        def index(found: list[str]) -> np.ndarray:
            if len(number) + len(found) > words:
                number.clear()
            for w in found:
                if w not in number:
                    number[w] = len(number) + 1
                    table[len(number)] = rows[word_rows(w)[0]] + rows[word_rows(w)[1]]
            return np.fromiter(map(number.__getitem__, found), np.int64, len(found))

        def logit(text: str) -> float:
            found, best = WORD.findall(text.lower()), np.full(FILTERS * len(SIZES), -np.inf, np.float32)
            for at in range(0, max(1, len(found)), step):
                own = index(found[at:at + step + reach])
                if at == 0 and len(own) <= reach:
                    own = np.pad(own, (0, reach + 1 - len(own)))
                z = wide @ table[own].T
                for i, s in enumerate(SIZES):
                    n = len(own) - s + 1
                    if n > 0:
                        part = slice(i * FILTERS, (i + 1) * FILTERS)
                        tap = [z[k * FILTERS:(k + 1) * FILTERS, j:j + n] for k, (f, j) in enumerate(taps) if f == i]
                        best[part] = np.maximum(best[part], (tap[0] if s == 1 else sum(tap[1:], tap[0])).max(1))
            return float(np.maximum(best + shift, 0) @ self.p["out"] + self.p["bias"][0])

        return logit

    def begin(self, seen: np.ndarray, neg: int, pos: int) -> None:
        """The first dimension of an embedding starts at the smoothed log odds of its word, so that few labels suffice.

        ``seen`` holds the number of texts with each row, of ``neg`` clean and ``pos`` toxic ones.
        """
        self.p["E"][:, 0] = 0.5 * np.log((seen[1] + 1) / (pos + 2) / ((seen[0] + neg / pos) / (neg + 2 * neg / pos)))
        self.p["E"][0] = 0

    def learn(self, texts: list[str], labels: np.ndarray, seed: int, steps: int = SHARD // 32, batch: int = 32, rate: float = 0.01) -> None:
        """Steps of Adam on the logistic loss: ``steps``, and more if that does not read every text.

        Only the places that win the pooling pass gradients on.
        """
        r, docs = np.random.default_rng(seed), [self.rows(t) for t in texts]
        steps = max(steps, -(-len(docs) // batch))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = np.concatenate([r.permutation(len(docs)) for _ in range(-(-steps * batch // len(docs)))])
        for t in range(1, steps + 1):
            some = order[(t - 1) * batch:t * batch]
            g = {k: np.zeros_like(x) for k, x in self.p.items()}
            for d in some:
                rows = docs[d]
                h, place = self.pooled(rows)
                keep = r.random(len(h)) > 0.2
                z = (h * keep) @ self.p["out"] / 0.8 + self.p["bias"][0]
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[d]) / len(some)
                g["bias"] += e
                g["out"] += e * h * keep / 0.8
                back = e * self.p["out"] * keep / 0.8 * (h > 0)
                for i, s in enumerate(SIZES):
                    own = slice(i * FILTERS, (i + 1) * FILTERS)
                    b, p = back[own], place[own]
                    g[f"b{s}"] += b
                    for j in range(s):
                        x = self.p["E"][rows[p + j]].sum(1)
                        g[f"W{s}"][j] += (x * b[:, None]).T
                        np.add.at(g["E"], rows[p + j], ((self.p[f"W{s}"][j] * b).T)[:, None, :])
            g["E"][0] = 0
            for k in self.p:
                g[k] += 1e-5 * self.p[k]
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
            self.p["E"][0] = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at:at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size


def platt(z: np.ndarray, truth: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Slope and shift that turn ``z`` into log odds, and the loss then; a row stands for ``n`` texts."""
    pos, neg = n[truth == 1].sum(), n[truth == 0].sum()
    target = np.where(truth == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, c = np.stack([z, np.ones_like(z)], 1), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        c -= np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (n * (q - target)) + 1e-3 * c)
    c[0] = max(0.0, c[0])
    return float(c[0]), float(c[1]), float((n * np.logaddexp(0, np.where(truth == 1, -1, 1) * (x @ c))).sum() / n.sum())


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, lang, toxic, apart, draw): every labelled text of the training fold; a fifth of the ids is set ``apart`` for checks.

    Rows whose crc32(doc_id as text) mod 4 is 2 are held out and never read here. Rows alike in doc_id and text count once. ``draw``
    is a hash of both.
    """
    def fold(prefix: str):
        return F.crc32(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).cast("binary"))

    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("") % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = docs.where(F.col("doc_id").isNotNull() & (fold("") % 4 != 2)).select("doc_id", whole_text().alias("text"), F.col("lang").alias("lang")).join(usable, "doc_id")
    one = found.groupBy("doc_id", "toxic", F.xxhash64("doc_id", "text").alias("draw")).agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    return one.select("text", "lang", "toxic", (fold("check") % 5 == 0).alias("apart"), "draw")


def word_counts(rows: DataFrame) -> np.ndarray:
    """Number of texts of each class (first axis) with each embedding row; each task sums its own texts first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, seen = Convolution(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"]):
                seen[int(y), np.unique(tool.rows(text))] += 1
        toxic, bucket = np.nonzero(seen)
        yield pd.DataFrame({"toxic": toxic, "bucket": bucket, "n": seen[toxic, bucket]})

    found = rows.select("text", "toxic").mapInPandas(count, "toxic int, bucket int, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((2, BUCKETS))
    seen[found["toxic"].to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
    return seen


def averaged(parts: DataFrame) -> np.ndarray:
    """Weights of all tasks (shard, block, n, part), averaged by their texts; one set of weights comes to the driver."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n, total = 0, 0.0
        for k, part in zip(pdf["n"], pdf["part"]):
            n, total = n + k, total + k * np.frombuffer(part, np.float32).astype(float)
        return pd.DataFrame({"shard": pdf["shard"][:1] // 64, "block": pdf["block"][:1], "n": [n], "part": [(total / n).astype(np.float32).tobytes()]})

    shape = "shard long, block int, n long, part binary"
    some = parts.groupBy("block", F.floor(F.col("shard") / 64)).applyInPandas(mean, shape)
    whole = some.withColumn("shard", F.lit(0).cast("long")).groupBy("block").applyInPandas(mean, shape).orderBy("block").collect()
    return np.concatenate([np.frombuffer(r["part"], np.float32) for r in whole])


def learned(rows: DataFrame, neg: int, pos: int) -> list[dict[str, np.ndarray]]:
    """The weights after each round, fitted on all ``rows`` (``neg`` clean and ``pos`` toxic ones).

    Rows are dealt into shards of about ``SHARD * ROUNDS``. In a round each shard goes on by itself from the common weights, with
    its texts of that round; then all are averaged. A row takes part in at least one round, in small tables in every one.
    """
    context = rows.sparkSession.sparkContext
    model, out = Convolution(), []
    model.begin(word_counts(rows), neg, pos)
    shards = max(1, (neg + pos) // (SHARD * ROUNDS))
    turns = min(ROUNDS, max(1, -(-SHARD * ROUNDS // (neg + pos))))
    dealt = rows.select("text", "toxic", "draw", F.pmod(F.col("draw"), F.lit(shards)).alias("shard"), F.pmod(F.shiftright("draw", 32), F.lit(ROUNDS)).alias("turn"))
    for t in range(ROUNDS):
        weights = context.broadcast(model.p)

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            own = Convolution()
            own.p = {k: x.copy() for k, x in weights.value.items()}
            pdf = pdf.sort_values("draw", kind="stable")
            own.learn(pdf["text"].tolist(), pdf["toxic"].to_numpy(np.float32), t)
            flat = own.flat()
            blocks = range(0, len(flat), BLOCK)
            return pd.DataFrame({"shard": pdf["shard"].iloc[0], "block": range(len(blocks)), "n": len(pdf), "part": [flat[b:b + BLOCK].tobytes() for b in blocks]})

        part = dealt.where(F.pmod(F.col("turn") + t, F.lit(ROUNDS)) < turns).groupBy("shard").applyInPandas(work, "shard long, block int, n long, part binary")
        flat = averaged(part)
        if len(flat):
            model.load(flat)
        out.append(dict(model.p))
    return out


def thresholds(scored: DataFrame, default: float = 0.3) -> dict[str, float]:
    """For each language with toxic texts the ``score`` that best separates them (F1), shrunk to ``default`` by the number of texts."""
    y = F.col("toxic")
    found = scored.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"), *[f for i, c in enumerate(GRID) for f in (
            F.sum((F.col("score") >= c).cast("int")).alias(f"all{i}"), F.sum(F.when(F.col("score") >= c, y).otherwise(0)).alias(f"hit{i}"))]).where("pos > 0")
    out = {}
    for r in found.collect():
        f1 = np.array([2 * r[f"hit{i}"] / max(1, r[f"all{i}"] + r["pos"]) for i in range(len(GRID))])
        best = np.array(GRID)[f1 >= f1.max() - 1e-9].mean()
        out[r["lang"]] = float((best * r["n"] + default * 50) / (r["n"] + 50))
    return out


def chosen(rows: DataFrame, rounds: list[dict[str, np.ndarray]]) -> tuple[Convolution, dict[str, float]]:
    """Of the ``rounds`` the weights that are best on ``rows``, scaled to them, and the thresholds by language.

    Every row is scored by all of them in one pass. Their log odds are counted in steps of 1 / ``LEVELS``, so what the driver scales by
    is bounded; the thresholds count the scores themselves.
    """
    given = rows.sparkSession.sparkContext.broadcast(rounds)
    names = [f"z{i}" for i in range(len(rounds))]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logits = []
        for p in given.value:
            own = Convolution()
            own.p = p
            logits.append(own.scorer(1 << 16))
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "toxic": batch["toxic"], **{n: [f(t) for t in batch["text"]] for n, f in zip(names, logits)}})

    z = stored(rows.select("text", "lang", "toxic").mapInPandas(score, "lang string, toxic int, " + ", ".join(f"{n} double" for n in names)))
    level = lambda n: F.round(F.greatest(F.lit(-HIGHEST), F.least(F.lit(HIGHEST), F.col(n))) * LEVELS)
    counts = z.select("toxic", F.posexplode(F.array(*[level(n) for n in names])).alias("round", "level")).groupBy("round", "toxic", "level").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = counts.sort_values(["round", "toxic", "level"])
    fits = [platt(c["level"].to_numpy(float) / LEVELS, c["toxic"].to_numpy(), c["n"].to_numpy(float)) for _, c in counts.groupby("round", sort=True)]
    best = min(range(len(fits)), key=lambda i: fits[i][2])
    slope, move, _ = fits[best]
    model = Convolution()
    model.p = rounds[best] | {"out": rounds[best]["out"] * np.float32(slope), "bias": rounds[best]["bias"] * np.float32(slope) + np.float32(move)}
    cuts = thresholds(z.select("lang", "toxic", (1 / (1 + F.exp(-(F.col(names[best]) * slope + move)))).alias("score")))
    discard(z)
    return model, cuts


def train(docs: DataFrame, labels: DataFrame) -> tuple[Convolution, dict[str, float]]:
    """The model and its thresholds by language, from all labelled texts of the training fold.

    Four fifths of them fit the weights; the rest choose the round to stop at, scale the score and set the thresholds. Without both
    classes in both parts every text scores alike, near the commoner label.
    """
    rows = stored(training_rows(docs, labels))
    n = {(r["apart"], r["toxic"]): r["n"] for r in rows.groupBy("apart", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if all(n.get((part, y)) for part in (True, False) for y in (0, 1)):
        found = chosen(rows.where("apart"), learned(rows.where("not apart"), n[False, 0], n[False, 1]))
    else:
        toxic = sum(k for (_, y), k in n.items() if y)
        found = Convolution(), {}
        found[0].p["bias"] += np.float32(3 if toxic > sum(n.values()) - toxic else -3)
    discard(rows)
    return found


def toxicity(docs: DataFrame, labels: DataFrame, score: str = "score", flag: str = "toxic_by_language") -> DataFrame:
    """Every row with ``score`` (0 to 1, from the whole text alone) and ``flag`` (score at least its language's threshold).

    Languages without training rows use 0.3. Null texts count as empty and have a score; labels that are null, repeated or
    other than 0 and 1 are ignored or merged (1 wins); repeated rows score alike; an empty table stays empty; extra columns
    pass through and columns of the two names are replaced.
    """
    spark = docs.sparkSession
    python_ready(spark)
    model, cuts = train(docs, labels)
    weights = spark.sparkContext.broadcast(model.p)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Convolution()
        own.p = weights.value
        logit = own.scorer()
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip([logit(t) for t in texts], -30, 30))), dtype="float64")

    kept = [f"`{c}`" for c in docs.columns if c not in (score, flag)]
    cut = F.coalesce(*[F.when(F.col("lang") == name, F.lit(c)) for name, c in cuts.items()], F.lit(0.3))
    return docs.select(*kept, scored(whole_text()).alias(score)).withColumn(flag, F.col(score) >= cut)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs.select("doc_id", "text", "lang"), labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "toxic_by_language")
