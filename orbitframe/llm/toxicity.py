"""Operator 3: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of the word plus the sum of the embeddings of its byte 5-grams (with its borders),
so unseen forms of a known stem still count. The network reads windows of ``WINDOW`` words, each overlapping the next
by half, over the whole text; attention pools the states of a window, and a text scores as its worst window.
Training knows labels of whole texts only: each round picks the window that now scores highest in every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm import text as T

WINDOW, STRIDE, GRAM = 16, 8, 5
LONGEST = 1 << 17
WIDTH, HIDDEN, VOCABULARY, SUPPORT = 6, 8, 3000, 5
_EDGE = np.array([not (c >= 0x80 or chr(c).isalnum()) for c in range(256)])
_PLAIN = np.where(T.SPACE, 32, T.LOWER).astype(np.uint8)


class Words:
    """The distinct words of some whole texts: hashes of their cores (outer punctuation off) and of their grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _PLAIN[data]
        starts, ends, self.first = T.words(data, offsets)
        core = ~_EDGE[data]
        if len(data):
            place = np.arange(len(data), dtype=np.int32)
            ahead = np.minimum.accumulate(np.where(core, place, np.int32(len(data)))[::-1])[::-1]
            behind = np.maximum.accumulate(np.where(core, place, np.int32(-1)))
            left, right = np.minimum(ahead[starts], ends), np.maximum(behind[ends - 1] + 1, starts)
            bare = left >= right
            starts, ends = np.where(bare, starts, left), np.where(bare, ends, right)
        hashes = T.span_hashes(data, starts, ends)
        self.hashes, sample, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        # grams of one occurrence of each word, framed by blanks
        size = ends[sample] - starts[sample]
        begin = np.cumsum(size + 2) - (size + 2)
        framed = np.full(int((size + 2).sum()), 32, np.uint8)
        span = lambda s, n: np.arange(n.sum()) + np.repeat(s - (np.cumsum(n) - n), n)
        framed[span(begin + 1, size)] = data[span(starts[sample], size)]
        count = np.maximum(size + 3 - GRAM, 0)
        self.gram_word = np.repeat(np.arange(len(size)), count)
        grams = T.gram_hashes(framed, GRAM)
        self.grams = grams[span(begin, count)] if len(grams) else np.empty(0, np.uint64)


def windows(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index by window and place, -1 for padding; text by window). Every text has a window, an empty text an empty one."""
    count = np.diff(first)
    number = np.maximum(1, -(-np.maximum(count - (WINDOW - STRIDE), 0) // STRIDE))
    owner = np.repeat(np.arange(len(count)), number)
    start = first[:-1][owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number))
    place = start[:, None] + np.arange(WINDOW)
    inside = place < first[1:][owner][:, None]
    return np.where(inside, at[np.where(inside, place, 0)] if len(at) else -1, -1), owner


def _lookup(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each hash in a table, 0 for unknown ones; known is sorted."""
    i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[i] == hashes, i + 1, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Embeddings, one gated recurrent layer in either direction, attention pooling, a logistic output."""

    def __init__(self, words: np.ndarray, word_odds: np.ndarray, grams: np.ndarray, gram_odds: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.words, self.grams = words, grams
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        p = {"word": normal(len(words) + 1, WIDTH) * 0.1, "gram": normal(len(grams) + 1, WIDTH) * 0.1}
        p["word"][1:, 0], p["gram"][1:, 0] = word_odds, gram_odds
        p["word"][0] = p["gram"][0] = 0
        for d in "fb":
            p |= {f"x{d}": normal(2 * WIDTH, 3 * HIDDEN), f"h{d}": normal(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"u": normal(2 * HIDDEN, HIDDEN), "v": normal(HIDDEN), "o": normal(2 * HIDDEN), "bias": np.array([-1], np.float32)}
        self.p = p

    def embed(self, w: Words) -> tuple[np.ndarray, tuple]:
        word, gram = _lookup(self.words, w.hashes), _lookup(self.grams, w.grams)
        hit = gram > 0
        gram, owner = gram[hit], w.gram_word[hit]
        sums = np.stack([np.bincount(owner, self.p["gram"][gram, k], minlength=len(word)) for k in range(WIDTH)], 1)
        return np.concatenate([self.p["word"][word], sums], 1).astype(np.float32), (word, gram, owner)

    def run(self, inputs: np.ndarray, index: np.ndarray, back: bool = False):
        """Logits of windows of rows of ``inputs`` (-1: padding); with ``back``, also a function from their gradient to those of parameters."""
        p, mask = self.p, (index >= 0)
        padded = np.concatenate([inputs, np.zeros((1, inputs.shape[1]), np.float32)])
        states, trace = [], []
        for d in "fb":
            projected = padded @ p[f"x{d}"] + p[f"c{d}"]
            h, out, steps = np.zeros((len(index), HIDDEN), np.float32), [None] * WINDOW, []
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                x, m = projected[index[:, t]], mask[:, t, None]
                g = h @ p[f"h{d}"]
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                new = np.where(m, n + z * (h - n), h)
                if back:
                    steps.append((t, h, z, r, n, g[:, 2 * HIDDEN :], m))
                h = out[t] = new
            states.append(np.stack(out, 1))
            trace.append(steps)
        s = np.concatenate(states, 2)
        a = np.tanh(s @ p["u"])
        score = np.where(mask, a @ p["v"], -1e9)
        score -= score.max(1, keepdims=True)
        weight = np.exp(score)
        weight = (weight / weight.sum(1, keepdims=True)).astype(np.float32)
        context = np.einsum("bt,bth->bh", weight, s)
        logit = context @ p["o"] + p["bias"][0]
        if not back:
            return logit

        def gradient(dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
            g = {k: np.zeros_like(x) for k, x in p.items() if k not in ("word", "gram")}
            g["o"], g["bias"] = context.T @ dlogit, np.array([dlogit.sum()], np.float32)
            dcontext = dlogit[:, None] * p["o"]
            dweight = np.einsum("bh,bth->bt", dcontext, s)
            dscore = weight * (dweight - (weight * dweight).sum(1, keepdims=True))
            da = dscore[:, :, None] * p["v"] * (1 - a * a)
            g["v"], g["u"] = np.einsum("bt,bth->h", dscore, a), np.einsum("bth,btk->hk", s, da)
            ds = weight[:, :, None] * dcontext[:, None, :] + da @ p["u"].T
            dinput = np.zeros_like(padded)
            for k, d in enumerate("fb"):
                dh = np.zeros((len(index), HIDDEN), np.float32)
                for t, before, z, r, n, gn, m in reversed(trace[k]):
                    dh = dh + ds[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                    dnew = np.where(m, dh, 0)
                    dn = dnew * (1 - z) * (1 - n * n)
                    dz, dr = dnew * (before - n) * z * (1 - z), dn * gn * r * (1 - r)
                    dx = np.concatenate([dz, dr, dn], 1)
                    dg = np.concatenate([dz, dr, dn * r], 1)
                    rows = index[:, t]
                    g[f"x{d}"] += padded[rows].T @ dx
                    g[f"c{d}"] += dx.sum(0)
                    g[f"h{d}"] += before.T @ dg
                    np.add.at(dinput, rows, dx @ p[f"x{d}"].T)
                    dh = np.where(m, dnew * z, dh) + dg @ p[f"h{d}"].T
            return g, dinput[:-1]

        return logit, gradient

    def score(self, w: Words) -> np.ndarray:
        """A score from 0 to 1 for every text."""
        inputs, _ = self.embed(w)
        index, owner = windows(w.first, w.at)
        logit = np.concatenate([self.run(inputs, index[i : i + 8192]) for i in range(0, len(index), 8192)]) if len(index) else np.empty(0)
        return 1 / (1 + np.exp(-np.maximum.reduceat(logit, T.runs(owner)).astype(float))) if len(owner) else np.empty(0)


def _informative(keys: np.ndarray, text: np.ndarray, toxic: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, scaled log odds) of the features whose presence tells most about the labels."""
    order = np.lexsort((text, keys))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    keys, text = keys[new], text[new]
    at = T.runs(keys)
    if not len(at):
        return np.zeros(1, np.uint64), np.zeros(1, np.float32)
    hits = np.add.reduceat(toxic[text].astype(float), at)
    seen = np.diff(np.append(at, len(keys)))
    yes, no = toxic.sum(), (~toxic).sum()
    a, b = (hits + 0.5) / (yes + 1), (seen - hits + 0.5) / (no + 1)
    gain = (hits / max(yes, 1) - (seen - hits) / max(no, 1)) ** 2 / (seen + 1)
    gain[seen < min(SUPPORT, 1 + toxic.sum() // 8)] = -1
    top = np.argsort(-gain, kind="stable")[:most]
    top = top[gain[top] > 0]
    if not len(top):
        return np.zeros(1, np.uint64), np.zeros(1, np.float32)
    top = top[np.argsort(keys[at][top])]
    return keys[at][top], (np.clip(np.log(a / b), -4, 4)[top] / 4).astype(np.float32)


def train(texts: list[str | None], toxic: list[int], rounds: int = 10, seed: int = 0) -> Network:
    """Fit a network to labelled whole texts; without any text, or any of one class, it keeps its prior."""
    toxic = np.array(toxic, bool)
    order = np.random.default_rng(seed).permutation(len(texts))
    texts, toxic = pa.array([texts[i] for i in order], pa.string()), toxic[order]
    data, offsets = T.raw(texts)
    w = Words(data, offsets)
    text_of = np.repeat(np.arange(len(texts)), np.diff(w.first))
    pair = np.unique(w.at.astype(np.int64) * max(len(texts), 1) + text_of)  # word and text
    word, text_of = pair // max(len(texts), 1), pair % max(len(texts), 1)
    words, word_odds = _informative(w.hashes[word], text_of, toxic, VOCABULARY)
    gram_at, grams_of = np.searchsorted(w.gram_word, word), np.bincount(w.gram_word, minlength=len(w.hashes))[word]
    spans = np.arange(grams_of.sum()) + np.repeat(gram_at - (np.cumsum(grams_of) - grams_of), grams_of)
    grams, gram_odds = _informative(w.grams[spans], np.repeat(text_of, grams_of), toxic, VOCABULARY)
    del pair, word, text_of, spans
    net = Network(words, word_odds, grams, gram_odds, seed)
    if toxic.all() or not toxic.any():
        net.p["bias"][0] = 2 if len(toxic) and toxic.all() else -2
        return net
    index, owner = windows(w.first, w.at)
    first = T.runs(owner)
    moments, step, rng = {}, 0, np.random.default_rng(seed)
    rounds = max(rounds, -(-120 // max(1, len(texts) // 128)))  # few texts are gone over more often
    for r in range(rounds):
        inputs, used = net.embed(w)
        if r == 0:
            signal = np.append(inputs[:, 0] + inputs[:, WIDTH], 0)
            logit = signal[index].max(1)
        else:
            logit = np.concatenate([net.run(inputs, index[i : i + 8192]) for i in range(0, len(index), 8192)])
        best = np.maximum.reduceat(logit, first)[owner] == logit
        at = np.flatnonzero(best)
        worst = at[T.runs(owner[at])]  # one window a text
        extra = rng.integers(0, len(index), len(texts) // 2)
        extra = extra[~toxic[owner[extra]]]
        for part in np.array_split(rng.permutation(np.concatenate([worst, extra])), max(1, len(worst) // 128)):
            y = toxic[owner[part]].astype(np.float32)
            local, at = np.unique(index[part], return_inverse=True)
            at = at.reshape(index[part].shape)
            if local[0] == -1:
                local, at = local[1:], at - 1
            inputs, used = _embed_some(net, w, local)
            logit, gradient = net.run(inputs, at, back=True)
            g, dinput = gradient(((_sigmoid(logit) - y) / len(part)).astype(np.float32))
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(g["word"], used[0], dinput[:, :WIDTH])
            np.add.at(g["gram"], used[1], dinput[used[2], WIDTH:])
            step += 1
            for k, x in g.items():
                m, v = moments.setdefault(k, (np.zeros_like(x), np.zeros_like(x)))
                m += 0.1 * (x - m)
                v += 0.01 * (x * x - v)
                net.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            net.p["word"][0] = net.p["gram"][0] = 0
    return net


def _embed_some(net: Network, w: Words, some: np.ndarray) -> tuple[np.ndarray, tuple]:
    part = Words.__new__(Words)
    part.hashes = w.hashes[some]
    low, high = np.searchsorted(w.gram_word, some), np.searchsorted(w.gram_word, some, "right")
    count = high - low
    part.grams = w.grams[np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)]
    part.gram_word = np.repeat(np.arange(len(some)), count)
    return net.embed(part)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return (F.crc32(F.col(id_col).cast("string")) % folds == fold) & F.col(id_col).isNotNull()


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = 600, clean: int = 1200, longest: int = LONGEST) -> list:
    """At most so many labelled texts of either class outside the held-out fold, in the order of a hash of their ids.

    Texts over ``longest`` bytes are scored like all others, but not learned from, which bounds what the driver gets.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    picked = [known.where(F.col("_toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(most) for kind, most in ((1, toxic), (0, clean))]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most toxic + clean rows
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    return texts.join(chosen, "_id").orderBy("_id").select("text", "_toxic").limit(2 * (toxic + clean)).collect()


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Network:
    rows = training_sample(docs, labels)
    net = train([r[0] for r in rows], [r[1] for r in rows])
    del rows
    T.release_memory()  # the driver goes on to other stages
    return net


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and ``toxicity_score`` (0 to 1) of every whole text.

    Null, empty and wordless texts score as one empty window, that is by the network's prior; repeated rows score
    alike; an empty table gives an empty result. A column already named toxicity_score is replaced. Map-only.
    """
    T.small_batches(docs)
    docs = docs.drop("toxicity_score")
    model = docs.sparkSession.sparkContext.broadcast(net)  # under 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.release_memory()
        for batch in batches:
            for i, j, data, offsets in T.slices(batch.column(text_col), 1 << 19):
                score = model.value.score(Words(data, offsets))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(score, pa.float64())], [*batch.schema.names, "toxicity_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("toxicity_score", DoubleType())]))
