"""Toxicity by noisy-channel deobfuscation.

The channel writes letters as digits and signs, puts blanks and other separators between them, and
repeats them.  Spans that look like it become lattices: for each run of equal characters the letters
that may be meant, once or twice, and for each separator nothing or a blank.  A Viterbi search under a
character trigram model of the whole corpus picks the likeliest spelling, of spans of any length in time
that is linear in it; spaced-out spans are then split into words that the training texts have.  A logistic
model over words and word beginnings scores the restored text.  Its features are all those whose
frequency differs between the classes, by a likelihood-ratio test and by the ratio itself, in either direction.

Null and empty texts have no features and score what the model gives to a text without any.  Very long texts are scored
whole.  Repeated rows score alike.  Rows without a label, and labels without a row, only leave the
training set.  With no labels of both kinds the score is the share of toxic labels (0 if there are none).
An empty table gives no rows.  Other columns are kept where the caller keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm.common import checkpoint, small_batches

#: Symbols of the language model: 0 anything else, 1-26 a-z, 27 digits, 28-63 other letters by code.
SYMBOLS = 64
#: Labelled rows that the classifier is fitted on, at most; they are those of least hash.
TRAIN_ROWS = 20_000
#: Least likelihood ratio (2 log) of a feature between the classes.
GAIN = 12.0
#: Least ratio of its two rates (log), in either direction: words that are merely a little more common in one class say more about length and language.
LEAN = 1.0

#: Signs and the letters that they stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Log-probabilities of the channel: a sign for a letter, a sign for itself, a repeated letter kept twice or once.
SIGN, LITERAL, TWICE, ONCE = math.log(0.2), math.log(0.02), math.log(0.4), math.log(0.6)
#: A plain double letter that is meant once, where letters aren't doubled throughout.
RARE = -6.0
#: A blank between letters that all have separators between them, and at separators that stand out.
BLANK, JOINED = math.log(0.2), -4.0

SEPARATORS = " ._*-"
#: Single characters of a spaced-out span at least, separators between two of them at most, and pairs of a doubled one.
SINGLES, APART, PAIRS = 4, 3, 3
#: Positions after which what all paths agree on is put out.
SETTLE = 1024
WORD = re.compile(r"[^\W\d_]+")


def symbol_table() -> np.ndarray:
    """Symbols of the code points up to 0x24F; letters beyond go by the same rule."""
    table = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c).lower()
        if len(ch) == 1 and ch.isalpha():
            table[c] = ord(ch) - 96 if "a" <= ch <= "z" else 28 + ord(ch) % 36
        elif ch.isdigit():
            table[c] = 27
    return table


TABLE = symbol_table()
#: Kinds of characters: bits 1 letter, 2 sign, 4 separator, 8 digit.
KINDS = np.array([bool(chr(c).isalpha()) + 2 * (chr(c) in SIGNS) + 4 * (chr(c) in SEPARATORS) + 8 * chr(c).isdigit() for c in range(0x250)], np.uint8)
KINDS[0x24F] = 1  # and all beyond


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str) -> np.ndarray:
    points = code_points(text)
    out = TABLE[np.minimum(points, 0x24F)]
    far = points > 0x24F
    if far.any():
        out = out.copy()
        out[far] = 28 + points[far] % 36
    return out


def trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): character trigrams of all texts, each between two blanks; at most 64^3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                s = symbols("  " + "  ".join(t or "" for t in b.column(0).slice(at, 200).to_pylist()) + "  ").astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], ["code", "n"])

    return docs.select(F.col(text_col)).mapInArrow(run, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: pd.DataFrame) -> np.ndarray:
    """Log-probabilities of the third symbol after two, interpolated with shorter contexts."""
    n = np.zeros(SYMBOLS**3)
    n[counts["code"].to_numpy()] = counts["n"].to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = n.sum(axis=0), n.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (n + 20 * p2) / (n.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


def suspects(text: str) -> list[tuple[int, int]]:
    """Spans (start, end) that may be disguised words, in order and apart.

    Spaced out: SINGLES or more single characters with up to APART separators between them, half of them letters.
    A word of letters, signs and inner separators counts if it has a sign before a letter (inside it, or in
    front: @, $), a letter three times in a row, PAIRS double letters in a row, or a separator between letters
    (a hyphen only next to a piece of two letters at most).
    """
    points = code_points(text)
    n = len(points)
    if n < 3:
        return []
    kind = KINDS[np.minimum(points, 0x24F)]
    run, letter, apart = (kind & 3) > 0, (kind & 1) > 0, (kind & 4) > 0
    found = spaced(run, letter, apart, (kind & 9) > 0)
    twin = letter[:-1] & (points[:-1] == points[1:])
    at = [np.flatnonzero(twin[:-1] & twin[1:]), np.flatnonzero(((kind[:-1] & 2) > 0) & letter[1:])]
    if n >= 2 * PAIRS:
        pair = twin.copy()
        pair[1:] &= ~twin[:-1]
        pair[:-1] &= ~twin[1:]
        m = len(pair) - 2 * (PAIRS - 1)
        doubled = pair[:m].copy()
        for k in range(1, PAIRS):
            doubled &= pair[2 * k : 2 * k + m]
        at.append(np.flatnonzero(doubled))
    inner = letter[:-2] & apart[1:-1] & (points[1:-1] != 32) & letter[2:]
    at.append(np.flatnonzero(inner) + 1)
    out, til, left = [], 0, iter([*found, (n + 1, n + 1)])
    gap = next(left)
    inside = np.zeros(n, bool)
    inside[1:-1] = inner
    for i in np.unique(np.concatenate(at)).tolist() + [n]:
        while gap[0] <= i and gap[0] <= n:
            if gap[0] >= til:
                out.append(gap)
                til = gap[1]
            gap = next(left)
        if i < til or i >= n:
            continue
        a = b = i
        while a > til and (run[a - 1] or inside[a - 1]):
            a -= 1
        while b < min(n, gap[0]) and (run[b] or inside[b]):
            b += 1
        while b > a and kind[b - 1] == 2 and text[b - 1] not in "@$":
            b -= 1
        while a < b and kind[a] == 2 and text[a] not in "@$":
            a += 1
        if b - a < 3 or (i < b and inside[i] and text[i] == "-" and not short_piece(text[a:b])):
            continue
        out.append((a, b))
        til = b
    return out


def short_piece(word: str) -> bool:
    return any(len(p) <= 2 for p in word.split("-"))


def spaced(run: np.ndarray, letter: np.ndarray, apart: np.ndarray, word: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of single characters with a few separators between them."""
    single = run.copy()
    single[1:] &= ~word[:-1]
    single[:-1] &= ~word[1:]
    at = np.flatnonzero(single)
    if len(at) < SINGLES:
        return []
    between = np.diff(at) - 1
    separators = np.concatenate([[0], np.cumsum(apart)])
    linked = (between >= 1) & (between <= APART) & (separators[at[1:]] - separators[at[:-1] + 1] == between)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(np.int8), [0]])))
    letters = np.concatenate([[0], np.cumsum(letter[at])])
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        n = letters[b + 1] - letters[a]
        if b - a + 1 >= SINGLES and 2 * n >= b - a + 1:
            out.append((int(at[a]), int(at[b]) + 1))
    return out


class Restorer:
    """Viterbi decoding of suspect spans.  words: log-probabilities of known words, to split what was spaced out."""

    def __init__(self, model: np.ndarray, words: dict[str, float] | None = None, memory: int = 100_000) -> None:
        self.model = model.tolist()
        self.words, self.memory = words or {}, memory
        self.known: dict[str, str] = {}

    def choices(self, span: str) -> Iterator[list[tuple[str, float]]]:
        """The lattice: for each run of equal characters what it may stand for, and for separators nothing or a blank, with log-probabilities."""
        text = span.lower()
        pieces = [(m.group(1), m.group(2)) for m in re.finditer(r"([^ ._*\-])([ ._*\-]*)", text)]
        gaps = Counter(g for _, g in pieces[:-1] if g)
        usual = gaps.most_common(1)[0][0] if gaps else ""
        out_spaced = bool(gaps) and sum(gaps.values()) == len(pieces) - 1
        runs: list[list] = []
        for ch, gap in pieces:
            if runs and runs[-1][0] == ch and runs[-1][2] in ("", usual):
                runs[-1][1] += 1
                runs[-1][2] = gap
            else:
                runs.append([ch, 1, gap])
        doubled = sum(1 for r in runs if r[1] == 2) >= max(PAIRS, 0.8 * len(runs))
        for k, (ch, n, gap) in enumerate(runs):
            meant = [(m, SIGN) for m in SIGNS.get(ch, "")] + ([(ch, LITERAL if ch in SIGNS else 0.0)])
            if n == 1:
                yield meant
            else:
                once = ONCE if n > 2 or doubled else RARE if ch.isalpha() else RARE / 2
                yield [(m, p + once) for m, p in meant] + [(m + m, 2 * p + (TWICE if n > 2 or doubled else 0.0)) for m, p in meant]
            if k + 1 < len(runs) and gap:
                if not out_spaced:
                    yield [("", 0.0), (" ", 0.0)]
                elif gap == usual:
                    yield [("", 0.0), (" ", BLANK)]
                else:
                    yield [(" ", 0.0), ("", JOINED)]
        yield [(" ", 0.0)]

    def decode(self, span: str) -> str:
        """The likeliest spelling of the span, as words between blanks."""
        codes: dict[str, list[int]] = {}
        states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}  # two symbols -> score, (what is put, what is before)
        done: list[str] = []
        model = self.model
        for k, options in enumerate(self.choices(span), 1):
            new: dict[tuple[int, int], tuple] = {}
            for (a, b), (score, path) in states.items():
                for put, cost in options:
                    x, y, total = a, b, score + cost
                    if put not in codes:
                        codes[put] = symbols(put).tolist()
                    for s in codes[put]:
                        total += model[x][y][s]
                        x, y = y, s
                    old = new.get((x, y))
                    if old is None or total > old[0]:
                        new[x, y] = (total, (put, path))
            states = settled(new, done) if k % SETTLE == 0 else new
        best = max(states.items(), key=lambda e: (e[1][0], e[0]))[1][1]
        return "".join([*done, *spelled(best)]).strip()

    def split(self, decoded: str) -> str:
        """The spelling cut into the likeliest words, where the training texts have words; a blank of the decoding is a hint."""
        if not self.words:
            return decoded
        hints, text = set(), ""
        for w in decoded.split():
            text += w
            hints.add(len(text))
        least = min(self.words.values())
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = []
            for start in range(max(0, end - 24), end):
                w = text[start:end]
                p = self.words.get(w)
                options.append((best[start][0] + (least - 3.0 * len(w) if p is None else p), -start))
            score, start = max(options)
            best.append((score + (2.0 if end in hints else 0.0), -start))
        out, end = [], len(text)
        while end:
            start = best[end][1]
            out.append(text[start:end])
            end = start
        return " ".join(reversed(out))

    def spelling(self, span: str) -> str:
        if span in self.known:
            return self.known[span]
        out = self.decode(span)
        if len(span) >= 2 * SINGLES - 1 and not re.search(r"[^ ._*\-]{2}", span):
            out = self.split(out)
        if len(span) <= 64:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[span] = out
        return out

    def restore(self, text: str) -> str:
        out, til = [], 0
        for a, b in suspects(text):
            out += [text[til:a], self.spelling(text[a:b])]
            til = b
        return "".join([*out, text[til:]]) if til else text


def spelled(path: tuple | None) -> list[str]:
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return out[::-1]


def settled(states: dict, done: list[str]) -> dict:
    """What all paths have in common goes to done; the paths keep the rest.  So a very long span takes bounded memory."""
    trails = []
    for _, path in states.values():
        trail = []
        while path is not None:
            trail.append(path)
            path = path[1]
        trails.append(trail[::-1])
    common = 0
    while all(common < len(t) for t in trails) and len({id(t[common]) for t in trails}) == 1:
        common += 1
    done += [p[0] for p in trails[0][:common]]
    out = {}
    for (key, (score, _)), trail in zip(states.items(), trails, strict=True):
        path = None
        for p in trail[common:]:
            path = (p[0], path)
        out[key] = (score, path)
    return out


def features(restored: str) -> set[str]:
    """Words in lower case, and beginnings of 4 to 6 letters, marked by a hyphen."""
    words = set(WORD.findall(restored.lower()))
    return words | {w[:n] + "-" for w in words for n in (4, 5, 6) if len(w) >= n}


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def training_sample(labels: DataFrame, rows: int, id_col: str, label_col: str) -> DataFrame:
    """At most rows labelled ids (id, y) outside the held-out third: those of least hash."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    own = own.groupBy(F.col(id_col).alias("train_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    return own.orderBy(F.xxhash64("train_id"), "train_id").limit(rows)


def fit_weights(rows: list[list[int]], n: np.ndarray, y: np.ndarray, width: int, ridge: float = 0.02, rounds: int = 200) -> np.ndarray:
    """Logistic regression on rows of feature numbers, each n times, by limited-memory quasi-Newton steps; the intercept (last) without ridge."""
    cols = np.fromiter((c for r in rows for c in r), np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    total = n.sum()

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(of, w[cols], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        e = n * (p - y)
        g = np.append(np.bincount(cols, e[of], width), e.sum())
        g[:-1] += ridge * w[:-1]
        cost = (n * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w[:-1] ** 2).sum()
        return cost, g

    w = np.zeros(width + 1)
    share = min(max(float((n * y).sum() / total), 1e-9), 1 - 1e-9)
    w[-1] = math.log(share / (1 - share))
    cost, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, t in reversed(steps):
            alpha = s @ d / (s @ t)
            alphas.append(alpha)
            d = d - alpha * t
        if steps:
            s, t = steps[-1]
            d = d * ((s @ t) / (t @ t))
        else:
            d = d / max(1.0, np.abs(d).max())
        for (s, t), alpha in zip(steps, reversed(alphas), strict=True):
            d = d + s * (alpha - (t @ d) / (s @ t))
        size = 1.0
        while size > 1e-10:
            now, g2 = loss(w + size * d)
            if now <= cost + 1e-4 * size * (g @ d):
                break
            size /= 2
        else:
            break
        s, t = size * d, g2 - g
        w, better, cost, g = w + s, cost - now, now, g2
        if s @ t > 1e-12:
            steps = [*steps[-9:], (s, t)]
        if better < 1e-9 * max(1.0, abs(cost)):
            break
    return w


class Model:
    """The language model, the words that the bounded sample of training texts has often, and the classifier."""

    def __init__(self, lm: np.ndarray, words: dict[str, float], weights: dict[str, float], base: float) -> None:
        self.lm, self.words, self.weights, self.base = lm, words, weights, base

    def score(self, restored: str) -> float:
        hit = features(restored) & self.weights.keys()
        z = self.base + sum(self.weights[f] for f in sorted(hit))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn the language model from all texts and the classifier from a bounded sample of labelled rows."""
    spark = docs.sparkSession
    small_batches(spark)
    lm = language_model(trigrams(docs, text_col).toPandas())
    sample = training_sample(labels, rows, id_col, label_col)
    # At most TRAIN_ROWS small rows, so the texts stay where they are.
    rowed = docs.select(F.col(id_col).alias("train_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "train_id")
    sent = spark.sparkContext.broadcast(lm)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found, n = Restorer(sent.value), [Counter(), Counter()], [0, 0]
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                n[y > 0] += 1
                found[y > 0].update(features(restorer.restore(text)))
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array([*names, ""]), pa.array([*(found[0][f] for f in names), n[0]], pa.int64()), pa.array([*(found[1][f] for f in names), n[1]], pa.int64())], ["feature", "clean", "toxic"])

    counts = rowed.select("text", "y").mapInArrow(count, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = checkpoint(counts)
    n = counts.where("feature = ''").first()
    clean, toxic = (n["clean"], n["toxic"]) if n else (0, 0)
    # Words of the training texts, but for the rare ones, as a unigram model.
    often = max(2, (clean + toxic) // 2000)
    found = [(r["feature"], r["n"]) for r in counts.where("feature <> '' and not endswith(feature, '-')").select("feature", (F.col("clean") + F.col("toxic")).alias("n")).where(F.col("n") >= often).collect()]
    mass = math.log(sum(k for _, k in found) or 1)
    words = {w: math.log(k) - mass for w, k in found}
    if not clean or not toxic:
        base = math.log((toxic + 1e-9) / (clean + 1e-9)) if clean + toxic else -30.0
        return Model(lm, words, {}, base)
    # The likelihood ratio of the feature's two rates against one.
    part = lambda k, m, of: F.when(k > 0, k * F.log(k * F.lit(float(clean + toxic)) / (m * F.lit(float(of))))).otherwise(0.0)
    have = F.col("toxic") + F.col("clean")
    gain = 2 * (part(F.col("toxic"), have, toxic) + part(F.col("clean"), have, clean) + part(toxic - F.col("toxic"), clean + toxic - have, toxic) + part(clean - F.col("clean"), clean + toxic - have, clean))
    lean = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    names = sorted(r["feature"] for r in counts.where("feature <> ''").where((gain >= GAIN) & (F.abs(lean) >= LEAN)).select("feature").collect())
    at = {f: i for i, f in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value, words)
        for b in batches:
            hits = [sorted(at[f] for f in features(restorer.restore(t)) & at.keys()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(hits, pa.list_(pa.int32()))], ["y", "hits"])

    seen = rowed.select("text", "y").mapInArrow(encode, "y int, hits array<int>").groupBy("y", "hits").agg(F.count(F.lit(1)).alias("n")).toPandas()
    seen = seen.assign(key=[tuple(int(x) for x in h) for h in seen["hits"]]).sort_values(["key", "y"])
    y = (seen["y"] > 0).to_numpy(float)
    # Both classes weigh the same, so that one clear word outweighs their shares.
    w = fit_weights([list(h) for h in seen["key"]], seen["n"].to_numpy(float) * np.where(y > 0, clean / toxic, 1.0), y, len(names))
    return Model(lm, words, dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with toxic_score and toxic_predicted."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        restorer = Restorer(m.lm, m.words)
        for s in texts:
            yield pd.Series([m.score(restorer.restore(t or "")) for t in s], dtype="float64")

    out = docs.withColumn("toxic_score", run(F.col(text_col)))
    return out.withColumn("toxic_predicted", (F.col("toxic_score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; learns only from labels that aren't held out."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(slim, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")))
    scored = score(slim, model, threshold)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
