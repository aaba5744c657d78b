"""The whole pipeline against plain Python over the same rows."""

import re
import zlib
from collections import Counter, defaultdict

import cases
import corpus_pipeline
import numpy as np
import xxhash
from test_text_ops import library, plain_fingerprint

from trackscan.llm import mixing, quality, secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = []
    for i in range(260):
        if i % 5 == 0:
            text = "WIN!! " + cases.prose(i, 50).upper().replace(" ", "!! ")
        elif i % 11 == 0:
            text = cases.prose(3, 90) + " " + cases.prose(i, 1)  # copies but for the last word
        elif i % 13 == 0:
            text = cases.prose(7, 40)
        else:
            text = cases.prose(i, 20 + i)
        if i % 17 == 0:
            text += f" password=hunter{i}hunter token: '{'ab12' * 8}'"
        out.append((i, text, "en", (None, "a", "b", "c")[i % 4], len(text)))
    return [*out, (300, None, None, "a", None), (301, "", "en", "b", 0), (None, cases.prose(400, 60), "en", "c", 1)]


def test_pipeline(spark, tmp_path):
    docs, labels = rows(), [(i, int(i % 5 > 0), 0) for i in range(260)]
    frame = spark.createDataFrame(docs, COLUMNS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # quality
    model = quality.fit(frame, known)
    measure = quality.Measure(model.good, model.bad)
    kept = []
    for row in docs:
        x = (np.array(measure(row[1] or "")) - model.means) / np.array(model.scales)
        z = x @ np.array(model.weights[:-1]) + model.weights[-1]
        if 1 / (1 + np.exp(-z)) >= 0.3:
            kept.append(row)
    assert {r[0] for r in kept} >= {i for i, q, _ in labels if q} and len(kept) < 230
    # near duplicates
    prints = [plain_fingerprint(r[1]) for r in kept]
    single = []
    for i, row in enumerate(kept):
        group, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [j for j, f in enumerate(prints) if (f ^ prints[x]).bit_count() <= 4]
        first = min((kept[j][0] is None, kept[j][0] or 0, j) for j in group)
        if first[2] == i:
            single.append(row)
    assert len(single) < len(kept)
    # secrets
    net = secrets.fit(spark.createDataFrame(single, COLUMNS))
    clean = [(k, None if t is None else secrets.redacted(t, secrets.spans(t, net)), s) for k, t, _, s, _ in single]
    assert not any("password=" in (t or "") for _, t, _ in clean)
    # mixing
    streams = defaultdict(list)
    for k, t, s in clean:
        data = b"" if k is None else k.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(mixing.SEED.to_bytes(4, "little"), 42)
        place = seed if k is None else xxhash.xxh64_intdigest(data, seed)
        place = place if t is None else xxhash.xxh64_intdigest(t.encode(), place)
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        part = place >> 54  # then by signed hash within a part
        streams[s].append((part, place - (1 << 64) if place >> 63 else place, k, t, size))
    total = sum(x[4] for own in streams.values() for x in own)
    order = sorted(streams, key=lambda s: (s is None, s))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    sizes = {s: sum(x[4] for x in own) for s, own in streams.items()}
    target, free, rest = {}, set(sizes), 1.5 * total
    while True:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(target[s] for s in over)
        free -= over
    taken = []
    for s, own in streams.items():
        goal, at = int(target[s] + 0.5), 0
        for _ in range(3):
            for _, _, k, t, size in sorted(own, key=lambda x: x[:2]):
                left = max(0, min(goal - at, size))
                if left * 2 > size:
                    taken.append((k, t))
                at += size
    # packing
    encode, want = library(corpus_pipeline.VOCABULARY), Counter()
    for k, t in taken:
        ids = np.array([*encode(t), 0], "<u4")
        for piece, a in enumerate(range(0, len(ids), 2048)):
            own = ids[a : a + 2048]
            want[k, piece, a, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    filled = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
