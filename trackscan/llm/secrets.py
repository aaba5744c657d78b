"""Secret scans: three rules, and a character convolutional network over every candidate.

A candidate is a run of characters that secrets are made of, with a digit in it or long; the
network reads it with its surroundings. It is trained on labelled findings: what the rules find in
all texts, candidates that they leave alone, and drawn variants of both. Its scores are calibrated
on findings that it was not trained on. On a third part, the threshold of each class of candidates
is set: as high as a required recall allows, and from there half-way down to the next harmless one.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.llm.common import saved, ship

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

RUN = "A-Za-z0-9+/_=-"
LONG_RUN = re.compile(f"[{RUN}]{{20,}}")
DIGITS = re.compile("[0-9]+")
AFTER = re.compile(f"[{RUN}]*")
LEAST_RUN = 12

#: Drawn findings of either label, and what all found ones of a label weigh at most.
DRAWN = 1_500
#: Different findings that a shard trains on in a round.
SHARD_ROWS = 4_096
#: Weights are added up as whole numbers of this part.
FIXED = 1 << 32
RECALL, SEED = 0.98, 7
#: Share of drawn secrets, and one less the share of harmless values, that a key name introduces.
BEHIND_NAME = 0.7
#: What drawn words are made of.
FILLER = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an"
    " they which one you were all her she there would their we him been has when who will no more if out"
    " so up said what its about than into them can only other time new some could these two may first"
    " then do any like my now over such our me even most made after also did many before must well back"
)
STARTS = ("b", "c", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "tr", "th", "sh", "")
VOWELS, CLOSES = ("a", "e", "i", "o", "u", "y", "ea", "ou"), ("", "", "n", "r", "s", "t", "l", "nd", "x")
LEFT, RIGHT = 32, 64
CHARS = string.ascii_letters + string.digits + "+/_.=-\"':;,@#()[]{}<>&? \n"
_CODES = {c: i + 2 for i, c in enumerate(CHARS)}  # 0: beyond the text, 1: any other
WIDTH, CHANNELS, FILTERS, HIDDEN = 5, 8, 16, 16
EPOCHS, BATCH, RATE = 8, 64, 4e-3
LEAST_FINDINGS = 20

Span = tuple[str, int, int]


def rule_spans(text: str) -> list[Span]:
    """(kind, start, end) of the three rules, leftmost and not overlapping within a kind."""
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [
            ("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE
        ]
    if "AKIA" in text:
        spans += [
            ("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS
        ]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(spans)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every maximal run that holds a digit, or is of 20 characters or more."""
    found = {m.span() for m in LONG_RUN.finditer(text)}
    past = 0
    for m in DIGITS.finditer(text):
        if m.start() < past:
            continue
        a = m.start()
        while a > past and text[a - 1] in _RUN_CHARS:
            a -= 1
        past = AFTER.match(text, m.end()).end()
        if past - a >= LEAST_RUN:
            found.add((a, past))
    return sorted(found)


_RUN_CHARS = frozenset(string.ascii_letters + string.digits + "+/_=-")


def shape(value: str) -> str:
    """The class of candidates that has a threshold of its own."""
    return "hex" if re.fullmatch("[0-9a-fA-F]+", value) else "other"


def windows(text: str, start: int, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and the inside mask, for each RIGHT characters of the candidate."""
    out = []
    for a in range(start, end, RIGHT):
        codes = np.zeros(LEFT + RIGHT, np.uint8)
        left, right = text[max(0, a - LEFT) : a], text[a : a + RIGHT]
        codes[LEFT - len(left) : LEFT] = [_CODES.get(c, 1) for c in left]
        codes[LEFT : LEFT + len(right)] = [_CODES.get(c, 1) for c in right]
        inside = np.zeros(LEFT + RIGHT, bool)
        inside[max(0, LEFT - (a - start)) : LEFT + min(RIGHT, end - a)] = True
        out.append((codes, inside))
    return out


class Network:
    """Embedding, one convolution, pooling inside and outside the candidate, two dense layers."""

    NAMES = ("embed", "conv", "conv_b", "dense", "dense_b", "out", "out_b")

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def drawn(*shape: int) -> np.ndarray:
            return rng.normal(0, np.sqrt(2 / shape[0]), shape)

        return cls(
            {
                "embed": rng.normal(0, 0.5, (len(CHARS) + 2, CHANNELS)),
                "conv": drawn(WIDTH * (CHANNELS + 1), FILTERS),
                "conv_b": np.zeros(FILTERS),
                "dense": drawn(3 * FILTERS, HIDDEN),
                "dense_b": np.zeros(HIDDEN),
                "out": drawn(HIDDEN, 1),
                "out_b": np.zeros(1),
            }
        )

    def forward(self, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, dict]:
        w, n = self.w, len(codes)
        x = np.concatenate([w["embed"][codes], inside[:, :, None]], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)
        flat = view.transpose(0, 1, 3, 2).reshape(n, view.shape[1], -1)
        h = np.maximum(flat @ w["conv"] + w["conv_b"], 0)
        mid = inside[:, WIDTH // 2 : WIDTH // 2 + h.shape[1], None]
        within, beyond = h * mid, h * ~mid
        size = np.maximum(mid.sum(axis=1), 1)
        i, o = within.argmax(axis=1), beyond.argmax(axis=1)
        pooled = np.concatenate(
            [within.max(axis=1), within.sum(axis=1) / size, beyond.max(axis=1)], axis=1
        )
        d = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        z = (d @ w["out"] + w["out_b"])[:, 0]
        return z, {"flat": flat, "h": h, "mid": mid, "size": size, "i": i, "o": o, "p": pooled, "d": d}

    def gradient(self, codes: np.ndarray, inside: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        z, k = self.forward(codes, inside)
        w, n = self.w, len(codes)
        share = weight / weight.sum()
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share)[:, None]
        g = {"out": k["d"].T @ dz, "out_b": dz.sum(axis=0)}
        dd = (dz @ w["out"].T) * (k["d"] > 0)
        g |= {"dense": k["p"].T @ dd, "dense_b": dd.sum(axis=0)}
        dp = dd @ w["dense"].T
        dh = k["mid"] * (dp[:, None, FILTERS : 2 * FILTERS] / k["size"][:, None, :])
        row, col = np.arange(n)[:, None], np.arange(FILTERS)[None]
        np.add.at(dh, (row, k["i"], col), dp[:, :FILTERS])
        np.add.at(dh, (row, k["o"], col), dp[:, 2 * FILTERS :])
        dh *= k["h"] > 0
        g |= {
            "conv": np.tensordot(k["flat"], dh, axes=([0, 1], [0, 1])),
            "conv_b": dh.sum(axis=(0, 1)),
        }
        df = (dh @ w["conv"].T).reshape(n, dh.shape[1], WIDTH, CHANNELS + 1)
        de = np.zeros_like(w["embed"])
        for j in range(WIDTH):
            np.add.at(de, codes[:, j : j + dh.shape[1]], df[:, :, j, :CHANNELS])
        return g | {"embed": de}

    def train(self, codes, inside, y, rng: np.random.Generator, weight=None, epochs: int = EPOCHS) -> None:
        weight = np.ones(len(y)) if weight is None else weight
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(y), BATCH):
                b = order[a : a + BATCH]
                step += 1
                for k, g in self.gradient(codes[b], inside[b], y[b], weight[b]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    fast = m[k] / (1 - 0.9**step)
                    self.w[k] = self.w[k] - RATE * fast / (
                        np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8
                    )


@dataclass(frozen=True)
class Model:
    weights: dict[str, np.ndarray]
    slope: float
    offset: float
    thresholds: dict[str, float]


def scores(model: Model, found: list[tuple[str, int, int]]) -> np.ndarray:
    """Calibrated scores of (text, start, end); a long candidate has its highest window's."""
    z = _outputs(Network(model.weights), [windows(*x) for x in found])
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -30, 30)))


def spans(text: str, model: Model) -> list[Span]:
    """The rules' spans, and those candidates apart from them that the network takes for secrets."""
    base = rule_spans(text)
    others = apart(candidates(text), base)
    score = scores(model, [(text, a, b) for a, b in others])
    more = [
        ("network", a, b)
        for (a, b), p in zip(others, score, strict=True)
        if p >= model.thresholds[shape(text[a:b])]
    ]
    return ordered(base + more)


def apart(found: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """The candidates that no span overlaps. Both are in order of their starts and go once."""
    out, at, end = [], 0, 0
    for a, b in found:
        while at < len(spans) and spans[at][1] < b:
            end = max(end, spans[at][2])
            at += 1
        if end <= a:
            out.append((a, b))
    return out


def redacted(text: str, found: list[Span], mark: str = "[SECRET]") -> str:
    """text with every span, or union of overlapping spans, replaced by mark."""
    out, past = [], 0
    for _, a, b in found:
        if a >= past:
            out += [text[past:a], mark]
        past = max(past, b)
    return "".join([*out, text[past:]])


def drawn_findings(
    rng: np.random.Generator, contexts: list[str], n: int
) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): n secrets and n harmless values.

    Either stands behind a key name or not, among words of contexts in any order: what surrounds a
    value only shifts the odds, the value itself decides.
    """
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits

    def of(chars: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(chars), int(rng.integers(low, high + 1))))

    def one(options):
        return options[int(rng.integers(len(options)))]

    secret = (
        lambda: of(hexes, 16, 64),
        lambda: of(mixed, 16, 48),
        lambda: of(mixed + "+/", 24, 60) + one(["", "=", "=="]),
        lambda: one(["AKIA", "ASIA"]) + of(string.ascii_uppercase + string.digits, 16, 16),
        lambda: of(mixed + "_-", 20, 40),
    )
    names = ("pwd", "passphrase", "auth", "bearer", "private_key", "client_secret", "access_key",
             "credential", "secret_key", "key", "authorization", "password", "token", "apikey")
    between = ("=", ": ", " = ", ' = "', '="', "='", ":", " is ", " ")
    words = [w for c in contexts for w in c.split() if w.isalpha()] or ["word"]

    def word() -> str:
        """One of the contexts, or one that can be read out."""
        if rng.random() < 0.3:
            return one(words)
        syllables = (one(STARTS) + one(VOWELS) + one(CLOSES) for _ in range(int(rng.integers(1, 4))))
        return "".join(syllables)

    harmless = (
        lambda: ".".join(str(int(rng.integers(256))) for _ in range(4)),
        lambda: f"{int(rng.integers(200, 999))}-{int(rng.integers(200, 999))}-{int(rng.integers(1000, 9999))}",
        lambda: of("0123456789", 12, 19),
        lambda: f"{int(rng.integers(1990, 2030))}-{int(rng.integers(10, 13))}-{int(rng.integers(10, 29))}T{int(rng.integers(10, 24))}",
        lambda: word() + "-" + word() + "-" + of("0123456789", 1, 4),
        lambda: word() + "_" + word() + "_" + word(),
        lambda: word() + "/" + word() + "/" + of("0123456789", 1, 6),
        lambda: (word() + word() + word() + word())[:40],
        lambda: word() + one("-_") + word() + one("-_") + word(),
        lambda: "v" + "_".join(of("0123456789", 1, 3) for _ in range(4)),
    )
    found = []
    for label, kinds in ((1, secret), (0, harmless)):
        for _ in range(n):
            before, after = (" ".join(word() for _ in range(int(rng.integers(0, 9)))) for _ in range(2))
            value = one(kinds)()
            if rng.random() < (BEHIND_NAME if label else 1 - BEHIND_NAME):
                before += " " + one(names) + one(between)
            else:
                before += one([" ", " ", "\n", ", ", " id=", " page=", ": "])
            text = before + value + one([" ", '" ', ". ", "\n", ", "]) + after
            found.append((text, len(before), len(before) + len(value), label))
    return found


def fit(docs: DataFrame, recall: float = RECALL, seed: int = SEED) -> Model:
    """Train on the findings in all texts, and on drawn ones of a fixed number.

    Equal findings become one row with their number. Weighed by it, all of a label count as much as
    DRAWN ones at most, so that drawn and common ones are in balance at any size. By a hash, six of ten
    findings train the network, two calibrate it and two set the thresholds. Training goes in rounds
    over shards of about SHARD_ROWS findings, each with all drawn ones; a round starts from the mean of
    the shards' weights. The driver gets weights, and counts by output rounded to 0.01.
    """
    spark = docs.sparkSession
    ship(spark)
    found = saved(_findings(docs), "findings")
    of_ten = F.pmod(F.xxhash64("codes", "inside"), F.lit(10))
    found = found.withColumn("split", F.when(of_ten < 6, 0).when(of_ten < 8, 1).otherwise(2))
    counts = found.groupBy("label").agg(F.sum("n").alias("n")).collect()
    share = {r["label"]: min(1.0, DRAWN / r["n"]) for r in counts}
    rng = np.random.default_rng(seed)
    drawn = drawn_findings(rng, [FILLER], DRAWN)
    drawn = [drawn[i] for i in rng.permutation(len(drawn))]
    cut, last = len(drawn) * 6 // 10, len(drawn) * 8 // 10
    net = _trained(found.filter("split = 0"), share, drawn[:cut], rng, seed)
    # (output, label, class, split, weight) of drawn findings, and of all others by equal outputs
    plain = _outputs(net, [windows(t, x, y) for t, x, y, _ in drawn[cut:]])
    judged = [
        (z, d[3], shape(d[0][d[1] : d[2]]), 1 if cut + i < last else 2, 1.0)
        for i, (d, z) in enumerate(zip(drawn[cut:], plain, strict=True))
    ]
    for r in sorted(_judged(found.filter("split > 0"), net).collect()):
        weight = r["n"] * share[r["label"]]
        judged.append((r["z"] / 100, r["label"], r["class"], r["split"], weight))
    z, truth, kinds, split, weight = (np.array(x) for x in zip(*judged, strict=True))
    one, two = split == 1, split == 2
    slope, offset = calibrated(z[one], truth[one].astype(float), weight[one])
    odds = slope * z[two] + offset
    thresholds = thresholds_of(odds, truth[two], kinds[two], weight[two], recall)
    return Model(net.w, slope, offset, thresholds)


def _findings(docs: DataFrame) -> DataFrame:
    """Rows (codes, inside, label, class, n): all windows of a finding, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["codes", "inside", "label", "class"]
        kinds = [pa.binary(), pa.binary(), pa.int32(), pa.string()]
        for batch in batches:
            out = []
            for value in batch.column(0):
                text = value.as_py()
                base = rule_spans(text)
                own = [(a, b, 1) for _, a, b in base]
                own += [(a, b, 0) for a, b in apart(candidates(text), base)]
                for a, b, label in own:
                    codes, inside = zip(*windows(text, a, b), strict=True)
                    out.append((b"".join(c.tobytes() for c in codes), b"".join(i.tobytes() for i in inside), label, shape(text[a:b])))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch(arrays, names)

    texts = docs.select(F.col("text").cast("string")).filter("text IS NOT NULL")
    rows = texts.mapInArrow(run, "codes binary, inside binary, label int, class string")
    return rows.groupBy("codes", "inside", "label", "class").agg(F.count("*").alias("n"))


def _unpacked(codes: list[bytes], inside: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = LEFT + RIGHT
    return (
        np.frombuffer(b"".join(codes), np.uint8).reshape(-1, width),
        np.frombuffer(b"".join(inside), bool).reshape(-1, width),
    )


def _trained(
    found: DataFrame, share: dict[int, float], drawn: list, rng: np.random.Generator, seed: int
) -> Network:
    """A network trained on all found rows, in EPOCHS rounds of one pass, and on the drawn ones."""
    spark = found.sparkSession
    shards = max(1, -(-found.count() // SHARD_ROWS))
    codes, inside = (np.stack(x) for x in zip(*(windows(t, a, b)[0] for t, a, b, _ in drawn), strict=True))
    labels = np.array([d[3] for d in drawn], float)
    width = LEFT + RIGHT
    rows = found.select(
        F.pmod(F.xxhash64("codes", "label"), F.lit(shards)).alias("shard"),
        *[F.substring(c, 1, width).alias(c) for c in ("codes", "inside")],
        F.col("label"),
        F.col("n"),
    )
    # a shard without findings has the drawn ones
    empty = spark.range(shards).select(
        F.col("id").alias("shard"), F.expr("X''").alias("codes"), F.expr("X''").alias("inside"),
        F.lit(0).alias("label"), F.lit(0).cast("long").alias("n"),
    )
    dealt = saved(rows.unionByName(empty), "shards")
    def step(held: dict[str, np.ndarray], turn: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            columns = (table.column(c).to_pylist() for c in ("codes", "inside", "label", "n"))
            some = sorted(r for r in zip(*columns, strict=True) if r[3])
            own, mask = _unpacked([r[0] for r in some], [r[1] for r in some])
            y = np.concatenate([labels, [float(r[2]) for r in some]])
            weight = np.concatenate([np.ones(len(labels)), [r[3] * share[r[2]] * shards for r in some]])
            mine = Network(dict(held))
            order = np.random.default_rng([seed, turn, key[0].as_py()])
            mine.train(np.concatenate([codes, own]), np.concatenate([inside, mask]), y, order, weight, 1)
            flat = np.concatenate([mine.w[k].ravel() for k in Network.NAMES])
            fixed = np.rint(flat * FIXED).astype(np.int64)  # sums in any order agree
            return pa.table({"at": np.arange(len(flat), dtype=np.int32), "value": fixed})

        return run

    net = Network.fresh(rng)
    ends = np.cumsum([net.w[k].size for k in Network.NAMES])[:-1]
    for turn in range(EPOCHS):
        held = net.w
        # by a number, which is not cut down for being few bytes: a shard is seconds of work
        spread = dealt.repartition(min(shards, 10_000), "shard")
        stepped = spread.groupBy("shard").applyInArrow(step(held, turn), "at int, value long")
        total = stepped.groupBy("at").agg(F.sum("value").alias("value")).collect()
        flat = np.array([v for _, v in sorted(tuple(r) for r in total)]) / FIXED / shards
        parts = np.split(flat, ends)
        net = Network({k: v.reshape(held[k].shape) for k, v in zip(Network.NAMES, parts, strict=True)})
    return net


def _outputs(net: Network, parts: list[list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """The network's highest output over the windows of each finding."""
    flat = [w for p in parts for w in p]
    if not flat:
        return np.zeros(0)
    z = np.concatenate(
        [
            net.forward(
                np.stack([c for c, _ in flat[i : i + 512]]),
                np.stack([m for _, m in flat[i : i + 512]]),
            )[0]
            for i in range(0, len(flat), 512)
        ]
    )
    first = np.cumsum([0, *(len(p) for p in parts)])[:-1]
    return np.maximum.reduceat(z, first)


def _judged(found: DataFrame, net: Network) -> DataFrame:
    """Rows (z, label, class, split, n): findings by the hundredths of their outputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            z = _outputs(net, [list(zip(*_unpacked([c], [i]), strict=True)) for c, i in pairs])
            rounded = np.rint(100 * np.clip(z, -30, 30)).astype(np.int32)
            yield pa.record_batch([pa.array(rounded), *batch.columns[2:]], ["z", *batch.schema.names[2:]])

    rows = found.select("codes", "inside", "label", "class", "split", "n")
    keys = "z int, label int, class string, split int"
    judged = rows.mapInArrow(run, f"{keys}, n long")
    return judged.groupBy("z", "label", "class", "split").agg(F.sum("n").alias("n"))


def thresholds_of(
    odds: np.ndarray, truth: np.ndarray, kinds: np.ndarray, weight: np.ndarray, recall: float
) -> dict[str, float]:
    """Of each class: as high as recall allows, and from there half-way down to the next harmless."""
    out = {}
    for kind in ("hex", "other"):
        mine = kinds == kind
        if weight[mine & (truth == 1)].sum() < LEAST_FINDINGS:
            mine = np.ones(len(mine), bool)
        secret = mine & (truth == 1)
        order = np.argsort(odds[secret], kind="stable")
        passed = np.cumsum(weight[secret][order])
        high = odds[secret][order][np.searchsorted(passed, (1 - recall) * passed[-1], "right")]
        below = odds[mine & (truth == 0)]
        low = below[below < high].max(initial=min(high, 0.0) - 1.0)
        out[kind] = float(1 / (1 + np.exp(-(high + low) / 2)))
    return out


def train(
    found: list[tuple[str, int, int, int]], recall: float = RECALL, seed: int = SEED
) -> Model:
    """The same on one machine, from labelled findings (text, start, end, label); -1 is plain context."""
    rng = np.random.default_rng(seed)
    contexts = [t[:LEFT] for t, _, _, label in found if label < 1] or ["some text here"]
    labelled = [x for x in found if x[3] >= 0]
    for label in (0, 1):  # a drawn share of either, so that one common finding isn't all
        own = [x for x in labelled if x[3] == label]
        if len(own) > DRAWN:
            keep = set(rng.choice(len(own), DRAWN, replace=False).tolist())
            labelled = [x for x in labelled if x[3] != label]
            labelled += [x for i, x in enumerate(own) if i in keep]
    labelled += drawn_findings(rng, contexts, DRAWN)
    order = rng.permutation(len(labelled))
    labelled = [labelled[i] for i in order]
    cut, last = len(labelled) * 6 // 10, len(labelled) * 8 // 10
    first = [windows(t, a, b)[0] for t, a, b, _ in labelled[:cut]]
    y = np.array([x[3] for x in labelled[:cut]], float)
    net = Network.fresh(rng)
    net.train(np.stack([c for c, _ in first]), np.stack([m for _, m in first]), y, rng)
    plain = scores(Model(net.w, 1.0, 0.0, {}), [x[:3] for x in labelled[cut:last]])
    truth = np.array([x[3] for x in labelled[cut:last]], float)
    slope, offset = calibrated(np.log(plain / (1 - plain)), truth)
    rest = [x[:3] for x in labelled[last:]]
    truth = np.array([x[3] for x in labelled[last:]], float)
    score = scores(Model(net.w, slope, offset, {}), rest)
    odds = np.log(score / (1 - score))
    shapes = np.array([shape(t[a:b]) for t, a, b in rest])
    thresholds = thresholds_of(odds, truth, shapes, np.ones(len(truth)), recall)
    return Model(net.w, slope, offset, thresholds)


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve from the network's outputs to shares of secrets."""
    a, w = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])
    share = np.ones(len(z)) if weight is None else weight
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a * (share * p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, a.T @ (share * (p - y)) + 0.1 * (w - [1, 0])), -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, n_network, base_sha256, spans), one for each row.

    A null text counts as empty; rows without findings stay, with zeros and an empty string.
    Positions are code points, ends exclusive. Other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                found = spans(text.as_py() or "", model)
                said = [f"{k}:{a}:{b}" for k, a, b in found]
                base = ",".join(s for s, f in zip(said, found, strict=True) if f[0] != "network")
                count = [sum(f[0] == k for f in found) for k in KINDS]
                out.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([batch.column(0), *arrays], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_network long"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema + ", base_sha256 string, spans string")


def without_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every found secret in text replaced by a mark; null texts stay null."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(at))
            new = [None if t is None else redacted(t, spans(t, model)) for t in texts]
            yield batch.set_column(at, "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
