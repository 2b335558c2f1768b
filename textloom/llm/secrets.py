"""Secret scans: pattern findings plus a character convolutional network over every candidate in its context.

Base findings come from three patterns. Candidates are the base findings and, where none overlaps, every run of SHORTEST or
more token characters that holds a digit or an inner capital or is of at least LONG characters (without full stops at its end). The
network (embedded characters, one convolution, maximum and mean over the whole span and its context, logistic output;
numpy) is trained on all documents. Positive are base findings, half of them with what stands around them hidden so that
a keyword does not decide, and a drawn key of several alphabets and lengths put in place of a word of each document.
Negative are other candidates and words, and mail addresses, numbers, dates and identifiers made from words. As an
unlabelled candidate may be a secret, those that a first network takes for one are left out for the second one. Examples are
dealt to shards by hash; each learns from its own, and after each round the weights are averaged, so the number of shards
follows the number of documents and not the cluster. A fifth of the documents is held out: scores are calibrated on all
of it by a logistic fit over logits counted in steps of 1 / STEPS, and the threshold is the highest step that keeps RECALL
of its findings. Candidates above it are added.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import drop_shuffles, materialise, release, slices, table, tidy

#: Fixed values of the base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
SHORTEST, LONG, RECALL, STEPS = 8, 16, 0.98, 1024
#: Documents of a shard, shards at most, rounds of an epoch if there are several, examples of a step of learning, words that names are made of.
SHARD, SHARDS, ROUNDS, STEP, NAMES = 16_000, 64, 4, 128, 8
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
_SHAPED = re.compile(r"[0-9]|[a-z][A-Z]").search
_WORD = re.compile(r"[A-Za-z0-9+/_.=-]{5,}")
_KEY = re.compile(r"(?ai)password|passwd|secret|token|api_?key").search
LEFT, RIGHT, WIDTH, KERNEL, FILTERS, EMBED = 16, 8, 64, 5, 24, 8
PLACES = WIDTH - KERNEL + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if _KEY(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def other_runs(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the candidates that overlap no base finding; base sorted by start."""
    out, i, reach = [], 0, 0
    for m in _RUN.finditer(text):
        run = m[0].rstrip(".")
        if len(run) < SHORTEST or not (len(run) >= LONG or _SHAPED(run)):
            continue
        start, end = m.start(), m.start() + len(run)
        while i < len(base) and base[i][0] < end:  # reach: how far findings go that begin before this run ends
            reach, i = max(reach, base[i][2]), i + 1
        if reach <= start:
            out.append((start, 3, end))
    return out


def window(text: str, start: int, end: int, body: str | None = None) -> bytes:
    """The span (or `body` in its place) with LEFT and RIGHT characters around it, as segments of WIDTH codes that overlap by KERNEL - 1.

    0 pads, 1 stands for non-ASCII, 128 marks the span. Every KERNEL neighbours stand together in a segment, however long the span."""
    code = lambda s: bytes(c if 1 < (c := ord(x)) < 127 else 1 for x in s)
    whole = code(text[max(0, start - LEFT) : start]).rjust(LEFT, b"\0") + bytes(c | 128 for c in code(text[start:end] if body is None else body)) + code(text[end : end + RIGHT])
    return b"".join(whole[i : i + WIDTH].ljust(WIDTH, b"\0") for i in range(0, max(1, len(whole) - KERNEL + 1), PLACES))


def bare(w: bytes) -> bytes:
    """A window of which only the span can be seen."""
    return bytes(c if c > 128 else 0 for c in w)


def _scan(batches):
    for batch in batches:
        for i in range(0, len(batch), 256):
            rows = []
            for t in batch.column(1).slice(i, 256).to_pylist():
                t = t or ""
                found = base_spans(t)
                found = sorted(found + other_runs(t, found))
                m = _WORD.search(t, len(t) // 2)
                word = (window(t, m.start(), m.end()), [m[0], *(x[0] for k in range(1, NAMES) if (x := _WORD.search(t, len(t) * k // NAMES)))]) if m and all(e <= m.start() or s >= m.end() for s, _, e in found) else (None, None)
                rows.append(([s for s, _, _ in found], [k for _, k, _ in found], [e for _, _, e in found], [window(t, s, e) for s, _, e in found], *word))
            ints = pa.list_(pa.int64())
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (ints, ints, ints, pa.list_(pa.binary()), pa.binary(), pa.list_(pa.string())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), *cols], names=["doc_id", "starts", "kinds", "ends", "windows", "word", "said"])


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: parallel arrays starts, kinds, ends (code points), windows of all candidates, and the window of one plain word, with that and other words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, starts array<long>, kinds array<long>, ends array<long>, windows array<binary>, word binary, said array<string>")


_ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "-_"]


def drawn_key(rng: np.random.Generator) -> str:
    """A random key: an alphabet, a length, sometimes a prefix, padding or dashes."""
    letters, n = _ALPHABETS[rng.integers(len(_ALPHABETS))], int(rng.integers(SHORTEST + 2, 65))
    key = "".join(letters[i] for i in rng.integers(0, len(letters), n))
    style = rng.random()
    if style < 0.1:
        key = "-".join(key[i : i + 8] for i in range(0, n, 8))
    elif style < 0.2:
        key = ["sk_live_", "ghp_", "xoxb-", "key-", "pk."][rng.integers(5)] + key
    return key + "=" * int(rng.integers(1, 3)) if style > 0.93 else key


def drawn_other(rng: np.random.Generator, words: list[str]) -> str:
    """What looks like a token and is no secret: mail addresses, hosts, numbers, dates, paths, names made of words."""
    w = lambda: words[rng.integers(len(words))].strip(".=-_/+").lower() or "x"
    n = lambda a, b: str(rng.integers(a, b))
    kinds = [
        lambda: f"{w()}.{w()}{n(1, 99)}.example.com", lambda: ".".join(n(0, 256) for _ in range(4)), lambda: "".join(n(0, 10) for _ in range(rng.integers(8, 20))),
        lambda: f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 32)}", lambda: f"{n(100, 999)}-{n(100, 999)}-{n(1000, 9999)}", lambda: f"{w()}_{w()}{n(1, 1000)}", lambda: w() + w().capitalize() + w().capitalize(),
        lambda: f"/{w()}/{w()}/{w()}{n(1, 99)}.html", lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}-{w()}", lambda: f"{w()}-{w()}-{w()}", lambda: w() + w() + w(), lambda: f"{w().upper()}_{w().upper()}_{n(1, 99)}", lambda: f"{w()}={w()}{n(1, 999)}",
    ]
    return kinds[rng.integers(len(kinds))]()


class Network:
    """scores() of windows; threshold, trained, how many examples were seen in all epochs, and on what was held out: recall and the share of negatives that would be added."""

    def __init__(self, found: list[bytes] = [], other: list[bytes] = [], held_found: list[bytes] = [], held_other: list[bytes] = [], epochs: int = 6, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.weights = {"embed": rng.normal(0, 0.5, (256, EMBED)), "conv": rng.normal(0, 0.2, (KERNEL * EMBED, FILTERS)), "shift": np.zeros(FILTERS), "out": rng.normal(0, 0.2, 2 * FILTERS), "bias": np.zeros(1)}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        self.steps, self.seen, self.a, self.b, self.threshold, self.recall, self.false_share, self.trained = 0, 0, 1.0, 0.0, 1.1, 0.0, 0.0, False
        if not (found and other):
            return
        x, y = [*found, *other], np.array([True] * len(found) + [False] * len(other))
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), STEP):
                part = order[k : k + STEP]
                self.step([x[i] for i in part], y[part], balance(len(found), len(other)), epoch / epochs)
        if not (held_found and held_other):
            held_found, held_other = found, other
        z = self.logits([*held_found, *held_other])
        self.settle(z, np.ones(len(z)), np.array([1.0] * len(held_found) + [0.0] * len(held_other)))

    def step(self, windows: list[bytes], y: np.ndarray, shares: tuple[float, float], done: float) -> None:
        """One step of Adam; shares: the weights of a positive and of a negative example, done: the part of the learning that is over."""
        rate, self.steps = 0.01 * (1 - done) + 0.0005, self.steps + 1
        for name, g in self._gradients(windows, y.astype(float), np.where(y, *shares)).items():
            self.first[name] = 0.9 * self.first[name] + 0.1 * g
            self.second[name] = 0.999 * self.second[name] + 0.001 * g * g
            self.weights[name] -= rate * (self.first[name] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[name] / (1 - 0.999**self.steps)) + 1e-8)

    def settle(self, z: np.ndarray, n: np.ndarray, y: np.ndarray) -> None:
        """Calibration and threshold from held-out logits z that occur n times each."""
        for _ in range(200):
            g = 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -50, 50))) - y
            self.a, self.b = self.a - 0.05 * np.average(g * z, weights=n), self.b - 0.05 * np.average(g, weights=n)
        p, held = self._scaled(z), y == 1
        order = np.argsort(p[held])
        self.threshold = float(p[held][order][np.searchsorted(np.cumsum(n[held][order]), math.floor((1 - RECALL) * (n[held].sum() - 1)), "right")])
        self.recall, self.false_share = (float(np.average(p[x] >= self.threshold, weights=n[x])) for x in (held, ~held))
        self.trained = True

    def state(self) -> bytes:
        """Weights and what Adam remembers, as floats."""
        return np.concatenate([x[k].ravel() for x in (self.weights, self.first, self.second) for k in self.weights]).tobytes()

    def take(self, state: np.ndarray, steps: int) -> None:
        at, self.steps = 0, steps
        for x in (self.weights, self.first, self.second):
            for k in self.weights:
                x[k], at = state[at : at + x[k].size].reshape(x[k].shape).copy(), at + x[k].size

    def _scaled(self, z):
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -50, 50)))

    def _forward(self, windows: list[bytes]):
        counts = np.array([len(w) // WIDTH for w in windows])
        x = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH).astype(np.int64)
        e, starts = self.weights["embed"][x], np.cumsum(counts) - counts
        cols = np.concatenate([e[:, k : PLACES + k] for k in range(KERNEL)], 2)
        r = np.maximum(cols @ self.weights["conv"] + self.weights["shift"], 0)
        mean = np.add.reduceat(r.sum(1), starts) / (counts * PLACES)[:, None]
        return x, counts, starts, cols, r, np.concatenate([np.maximum.reduceat(r.max(1), starts), mean], 1)

    def _gradients(self, windows: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        x, counts, _, cols, r, features = self._forward(windows)
        w = self.weights
        g = weight * (1 / (1 + np.exp(-np.clip(features @ w["out"] + w["bias"], -50, 50))) - y) / len(y)
        back, who = g[:, None] * w["out"], np.repeat(np.arange(len(y)), counts)
        to_r = np.repeat((back[:, FILTERS:] / (counts * PLACES)[:, None])[who, None], PLACES, 1)
        at = r.argmax(1)  # of each segment; only the greatest of a window counts
        top = np.take_along_axis(r, at[:, None], 1)[:, 0]
        np.put_along_axis(to_r, at[:, None], np.take_along_axis(to_r, at[:, None], 1) + (back[who, :FILTERS] * (top == features[who, :FILTERS]))[:, None], 1)
        to_h = (to_r * (r > 0)).reshape(-1, FILTERS)
        to_cols, to_e = (to_h @ w["conv"].T).reshape(len(x), PLACES, -1), np.zeros((len(x), WIDTH, EMBED))
        for k in range(KERNEL):
            to_e[:, k : PLACES + k] += to_cols[:, :, k * EMBED : (k + 1) * EMBED]
        embed = np.zeros((256, EMBED))
        np.add.at(embed, x.ravel(), to_e.reshape(-1, EMBED))
        return {"embed": embed, "conv": cols.reshape(-1, KERNEL * EMBED).T @ to_h, "shift": to_h.sum(0), "out": features.T @ g, "bias": g.sum(keepdims=True)}

    def logits(self, windows: list[bytes]) -> np.ndarray:
        out, sizes = [], np.array([len(w) for w in windows], np.int64)
        for a, b in slices(sizes, 256 * WIDTH):
            out.append(self._forward(windows[a:b])[5] @ self.weights["out"] + self.weights["bias"])
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, windows: list[bytes]) -> np.ndarray:
        return self._scaled(self.logits(windows))


def balance(found: int, other: int) -> tuple[float, float]:
    """Weights of positive and negative examples that give both kinds the same sum."""
    return 0.5 * (found + other) / max(1, found), 0.5 * (found + other) / max(1, other)


def _examples(batches):
    """Of rows (h, kinds, windows, word, said) all examples."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            keys, held, yes, out = [], [], [], []
            for h, kinds, windows, word, said in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns), strict=True):
                rng = np.random.default_rng([h & (1 << 63) - 1, len(kinds)])
                own = [(k < 3, bare(w) if k < 3 and rng.random() < 0.5 else w) for k, w in zip(kinds, windows, strict=True)]
                if word:
                    left, right = (bytes(c for c in part if 0 < c < 128).decode("ascii") for part in (word[:LEFT], word[LEFT:WIDTH]))
                    text = left + said[0] + right
                    made = ((True, drawn_key(rng)), (False, drawn_other(rng, said)))
                    own += [(False, word), *((y, window(text, len(left), len(left) + len(said[0]), m)) for y, m in made)]
                keys += rng.integers(0, 1 << 62, len(own)).tolist()
                held += [h % 5 == 0] * len(own)
                yes += [y for y, _ in own]
                out += [w for _, w in own]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.bool_()), pa.array(yes, pa.bool_()), pa.array(out, pa.binary())], names=["key", "held", "yes", "window"])


def _learned(batches, net: Network, shares: tuple[float, float], done: float):
    """What the network has become after all examples (yes, window), in turn."""
    windows, y, n = [], [], 0

    def step(windows, y):
        for k in range(0, len(y), STEP):
            some = windows[k : k + STEP]
            for a, b in slices(np.array([len(w) for w in some]), 1024 * WIDTH):  # long ones by themselves
                net.step(some[a:b], np.array(y[k + a : k + b]), shares, done)

    for batch in batches:
        y += batch.column(0).to_pylist()
        windows += batch.column(1).to_pylist()
        n += len(batch)
        whole = len(y) // STEP * STEP
        step(windows[:whole], y[:whole])
        windows, y = windows[whole:], y[whole:]
    step(windows, y)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([net.steps], pa.int64()), pa.array([net.state()], pa.binary())], names=["n", "steps", "state"])


def _fit(examples: DataFrame, shards: int, epochs: int) -> Network:
    """A network from all examples(key, held, yes, window): of each round the mean of what the shards have learned; settled on what is held out."""
    net, sc = Network(), examples.sparkSession.sparkContext
    numbers = {(r["held"], r["yes"]): r["n"] for r in examples.groupBy("held", "yes").agg(F.count(F.lit(1)).alias("n")).collect()}
    learned = all(numbers.get((False, y)) for y in (True, False))
    if not learned:
        return net
    shares, rounds = balance(numbers[False, True], numbers[False, False]), ROUNDS if shards > 1 else 1
    for k in range(epochs * rounds):
        now, done = sc.broadcast(net), k // rounds / epochs if shards == 1 else k / (epochs * rounds)
        part = examples.filter(~F.col("held") & (F.col("key") % rounds == k % rounds))
        part = part.withColumn("order", F.xxhash64("key", F.lit(k // rounds))).repartition(shards, "key").sortWithinPartitions("order", "window").select("yes", "window")
        states = part.mapInArrow(lambda it, now=now, done=done: tidy(_learned(it, now.value, shares, done)), "n long, steps long, state binary").collect()
        if states:
            net.take(np.average([np.frombuffer(r["state"]) for r in states], axis=0, weights=[r["n"] for r in states]), max(r["steps"] for r in states))
            net.seen += sum(r["n"] for r in states)
        now.destroy()
        drop_shuffles(examples.sparkSession)
    now = sc.broadcast(net)

    def told(batches):
        for batch in batches:
            z = np.clip(now.value.logits(batch.column(1).to_pylist()), -50, 50)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.floor(z * STEPS).astype(np.int64))], names=["yes", "z"])

    held = examples.filter("held") if all(numbers.get((True, y)) for y in (True, False)) else examples
    rows = held.select("yes", "window").mapInArrow(lambda it: tidy(told(it)), "yes boolean, z long").groupBy("yes", "z").agg(F.count(F.lit(1)).alias("n")).orderBy("yes", "z").collect()  # 200 * STEPS at most
    net.settle(*(np.array([r[c] for r in rows], float) / d for c, d in (("z", STEPS), ("n", 1), ("yes", 1))))
    return net


def train(found: DataFrame) -> Network:
    """A network from all candidates of all documents; without base findings there is nothing to learn from."""
    if not found.filter(F.exists("kinds", lambda k: k < 3)).take(1):
        return Network()
    docs = found.count()
    shards = min(SHARDS, math.ceil(docs / SHARD))
    rows = found.select(F.xxhash64("doc_id").alias("h"), "kinds", "windows", "word", "said")
    examples = materialise(rows.mapInArrow(lambda it: tidy(_examples(it)), "key long, held boolean, yes boolean, window binary"), "examples")
    epochs = lambda most: min(most, math.ceil(most * SHARD / docs))
    first = found.sparkSession.sparkContext.broadcast(_fit(examples, shards, epochs(2)))

    def clear(batches):
        for batch in batches:
            keep = np.array(batch.column(2).to_pylist(), bool)
            other = np.flatnonzero(~keep)
            keep[other] = first.value.scores([batch.column(3)[int(i)].as_py() for i in other]) < 0.9
            yield batch.filter(pa.array(keep))

    cleared = materialise(examples.mapInArrow(lambda it: tidy(clear(it)), examples.schema), "clear-examples")
    release(examples)
    net = _fit(cleared, shards, epochs(6))
    release(cleared)
    return net


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, kinds, starts, ends, scores (arrays, by start, then kind); base findings and what the network adds.

    docs(doc_id, text); a null text is empty, rows that repeat stay, extra columns are ignored, an empty table gives no
    rows. Without base findings there is nothing to learn from and nothing is added.
    """
    found = materialise(candidates(docs), "candidates")
    sent = found.sparkSession.sparkContext.broadcast(train(found))

    def run(batches):
        net = sent.value
        for batch in batches:
            out = []
            lists = [batch.column(i).to_pylist() for i in (1, 2, 3, 4)]
            p = net.scores([w for ws in lists[3] for w in ws]).tolist()
            at = 0
            for starts, kinds, ends, ws in zip(*lists, strict=True):
                mine = [x for x in zip(starts, kinds, ends, p[at : at + len(ws)], strict=True) if x[1] < 3 or (net.trained and x[3] >= net.threshold)]
                at += len(ws)
                out.append([list(x) for x in zip(*mine, strict=True)] or [[], [], [], []])
            cols = [pa.array([r[i] for r in out], pa.list_(pa.float64() if i == 3 else pa.int64())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "starts", "kinds", "ends", "scores"])

    return found.select("doc_id", "starts", "kinds", "ends", "windows").mapInArrow(run, "doc_id long, starts array<long>, kinds array<long>, ends array<long>, scores array<double>")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan_secrets(table(spark, sf_dir, "documents"))
    name = F.array(*map(F.lit, KINDS))
    listed = F.arrays_zip("kinds", "starts", "ends")
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(name, x["kinds"].cast("int")), x["starts"].cast("string"), x["ends"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    return spans.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(said(F.filter(listed, lambda x: x["kinds"] < 3)).cast("binary"), 256).alias("base_sha256"), said(listed).alias("spans"))
