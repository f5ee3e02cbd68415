"""The corpus operators against brute force, on small tables with nulls, empty and repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import decontamination, line_dedup, media_columns, mixing, sharding, simhash, suffix_dedup, token_counts, toxicity, url_filters
from quiver.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, id bigint, a string, first int"
WORDS = "the of and model data river stone house seven green light under over table winter summer maker engine".split()


def table(spark, rows):
    """Rows (id, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "src0", None, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    shared = [line(30) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "é ñ 漢字 😀"), (None, line(20))]
    for i in range(7, n):
        t = "\n".join([line(rng.randint(3, 40)), rng.choice(shared), line(rng.randint(0, 10))])
        rows.append((i, t))
    rows += [(n, rows[20][1]), (n + 1, rows[20][1] + " end"), (n + 2, "x" * 700), (n + 2, "x" * 700)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus())


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def test_token_counts(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = [(100, "a<|endoftext|>b  c\n\n d's 12½ ² \x1c x"), (101, "𝒜 ꟎ Ⅰ don't  stop"), (102, "q" * 5000)]
    t = Tokenizer.from_file(path)
    got = Counter(map(tuple, token_counts.token_counts(docs.union(table(spark, extra)), path, limit=20).collect()))
    want = Counter()
    for i, s in corpus() + extra:
        n = len(t.encode(s or "", add_special_tokens=False).ids)
        want[(i, len((s or "").encode()), n, n > 20)] += 1
    assert got == want
    assert token_counts.token_counts(nothing, path).count() == 0


def test_token_counts_blocks_and_buckets(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    frequencies = [Counter({"a": 1, " é": 70_000}), Counter(), Counter({"a": 2, "b": 1})]
    back = Counter()
    for bucket, data in token_counts.packed(frequencies, 3):
        words, widths, places, counts = token_counts.unpacked(data)
        assert {token_counts.bucket_of(w, 3) for w in words} == {bucket}
        back.update(dict(zip(zip(np.repeat(words, widths).tolist(), places.tolist()), counts.tolist())))
    assert back == {(b"a", 0): 1, (" é".encode(), 0): 70_000, (b"a", 2): 2, (b"b", 2): 1}
    assert list(token_counts.packed([Counter()], 3)) == []
    monkeypatch.setattr(token_counts, "BUCKET_BYTES", 500)
    rows = [(i, " the " * (i % 7) + f"word{i % 13} é½ {'long ' * (400 * (i % 50 == 0))}") for i in range(120)] + [(5, " the "), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        found = token_counts.token_counts(docs, path)
        got = Counter((r.doc_id, r.n_tokens) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    t = Tokenizer.from_file(path)
    assert got == Counter((i, len(t.encode(s or "", add_special_tokens=False).ids)) for i, s in rows)


def test_differencing_beats_greedy():
    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 1000) for _ in range(300)), reverse=True)
    place = sharding.difference(sizes, 7)
    sums = np.bincount(place, weights=sizes, minlength=7)
    greedy = np.zeros(7)
    for s in sizes:
        greedy[greedy.argmin()] += s
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= greedy.max() - greedy.min()
    assert sharding.difference([], 3).shape == (0,) and sharding.difference([5], 3).tolist() == [0]


def test_sharding(docs, nothing):
    rows = sharding.shard_documents(docs, shards=5).collect()
    assert len(rows) == len(corpus())
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    for r in rows:
        of_text[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_shards_are_balanced(spark):
    """Sums of the shards against the least that is possible: near equal where texts are many, and no worse than the largest group else."""
    rng = random.Random(9)
    texts = ["x" * rng.randint(1, 3000) + str(i) for i in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[7]) for i in range(40)]
    sums = Counter()
    for r in sharding.shard_documents(table(spark, rows), shards=8).collect():
        sums[r.shard] += r.size
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 16
    sums = Counter()
    for r in sharding.shard_documents(table(spark, [*rows[:50], (9000, "long" * 100_000)]), shards=8).collect():
        sums[r.shard] += r.size
    assert max(sums.values()) == 400_016


def test_mixing(spark, nothing):
    rng = random.Random(4)
    rows = [(i, rng.choice(["s1", "s2", "s3", None]), rng.choice(["en", "de"]), rng.randint(0, 50)) for i in range(400)] + [(None, "s1", "en", 5), (7, "s1", "en", 5), (7, "s1", "en", 5)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokens bigint").withColumn("mix_key", F.lit(1))
    levels = {"language": F.col("lang"), "source": F.col("source")}
    weights = {"language": {"en": 1, "de": 9}, "source": {"s1": 5}}
    got = mixing.mix(d, levels, weights, F.col("tokens"), share=0.9, max_epochs=2, seed=3).collect()
    total = sum(r[3] for r in rows)
    have = defaultdict(int)
    for _, s, lang, n in rows:
        have[lang, s or ""] += n
    budget = fill({k: have_ for k, have_ in have.items()}, weights, min(total * 900 // 1000, 2 * total))
    taken, members = defaultdict(int), defaultdict(list)
    for r in got:
        taken[r.mix_language, r.mix_source] += r.mix_tokens
        members[r.mix_language, r.mix_source, r.mix_epoch].append(r.doc_id)
    for leaf, b in budget.items():
        assert b - 51 < taken[leaf] <= b, leaf
    for (lang, s, e), ids in members.items():
        own = sorted(((hashlib.md5(f"3:{e}:{'null' if i is None else i}".encode()).hexdigest(), n, i) for i, so, la, n in rows if (la, so or "") == (lang, s)), key=lambda x: x[:2])
        assert Counter(ids) == Counter(i for _, _, i in own[: len(ids)])  # a prefix of the seeded order
    assert mixing.mix(nothing, levels, weights, F.lit(1)).count() == 0


def fill(have, weights, budget):
    """Shares of the leaves, level by level, by repeated water filling."""

    def split(parent, children):
        left, given, open_ = parent, {}, dict(children)
        while open_:
            w = sum(x[1] for x in open_.values())
            full = {k: c for k, (c, x) in open_.items() if c * w <= left * x}
            if not full:
                return given | {k: left * x // w for k, (c, x) in open_.items()}
            given |= full
            left -= sum(full.values())
            for k in full:
                del open_[k]
        return given

    langs = {}
    for (lang, _), n in have.items():
        langs[lang] = langs.get(lang, 0) + 2 * n
    top = split(budget, {k: (c, weights["language"].get(k, 1)) for k, c in langs.items()})
    out = {}
    for lang, b in top.items():
        own = {s: (2 * n, weights["source"].get(s, 1)) for (la, s), n in have.items() if la == lang}
        out |= {(lang, s): x for s, x in split(b, own).items()}
    return out


def test_media_tables():
    # Values of the G.711 standard: the ends and the middle of both curves.
    assert media_columns.MULAW_TABLE[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert media_columns.ALAW_TABLE[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def test_adpcm_against_one_by_one():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(36 * 5 + 7))

    def plain(block):
        value, index = int.from_bytes(block[:2], "little", signed=True), min(max(block[2] - 256 if block[2] > 255 else block[2], 0), 88)
        out = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media_columns.STEPS[index])
                move = step >> 3
                move += step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
                value = min(max(value - move if code & 8 else value + move, -32768), 32767)
                index = min(max(index + int(media_columns.MOVES[code & 7]), 0), 88)
                out.append(value)
        return out

    want = [x for k in range(5) for x in plain(data[36 * k : 36 * k + 36])]
    assert media_columns.adpcm_decode(data).tolist() == want
    assert media_columns.adpcm_shapes([data, b"", data[:36]])[1].startswith("0/0/0")


def test_features_against_one_by_one(spark):
    """Shapes, CRCs and PCM of a recording, sample by sample in plain Python."""
    import struct

    rng = random.Random(6)
    payload = bytes(rng.randrange(256) for _ in range(1152))

    def law(code, kind):
        if kind == "mulaw":
            code = ~code & 0xFF
            size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
            return -size if code & 0x80 else size
        code ^= 0x55
        exponent, size = code >> 4 & 7, (code & 15) << 4
        size = size + 8 if exponent == 0 else (size + 264) << (exponent - 1)
        return size if code & 0x80 else -size

    def plain(x, zero=False):
        # Sign changes go by the sign bit of the code, which zero has too.
        return f"{int((sum(v * v for v in x) / len(x)) ** 0.5)}/{max(abs(v) for v in x)}"

    ((feature, pcm),) = media_columns.features([media_columns.encode_wav(payload, media_columns.MULAW)])
    found = dict(p.split("=") for p in feature.split(";"))
    for kind in ("mulaw", "alaw"):
        changes = sum((a ^ b) >> 7 for a, b in itertools.pairwise(payload))
        assert found[kind] == f"{plain([law(c, kind) for c in payload])}/{changes}"
    samples = [law(c, "mulaw") for c in payload]
    up = []
    for a, b in zip(samples, samples[1:] + samples[-1:], strict=True):
        up += [a, (a + b) // 2]
    data = struct.pack(f"<{len(up)}h", *up)
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data))
    assert pcm == head + data and found["pcm"] == f"{len(pcm)},{zlib.crc32(pcm)}"


def test_media(docs, nothing):
    rows = media_columns.telephony(docs).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        tag, rate, data = media_columns.read_wav(r.media)
        assert (tag, rate) == (media_columns.MULAW, 8000) and len(data) == r.payload_bytes and len(data) % 576 == 0 and len(data) > 0
        assert hashlib.sha256(data).hexdigest() == r.payload_sha256 and zlib.crc32(data[-32:]) == r.tail_crc32
        assert len(r.media) == r.media_bytes and hashlib.sha256(r.media).hexdigest() == r.media_sha256
        tag, rate, pcm = media_columns.read_wav(r.pcm)
        assert (tag, rate, len(pcm)) == (media_columns.PCM, 16000, 4 * len(data))
        assert by.setdefault(r.payload_sha256, r.feature) == r.feature
    texts = Counter(len((t or "").encode()) for _, t in corpus())
    assert Counter(r.n_bytes for r in rows) == texts
    assert media_columns.telephony(nothing).count() == 0


def restorer():
    import pandas as pd

    text = " ".join(["you are an idiot and a moron loser", "stupid trash clown", "worthless pathetic people", "disgusting scum", "the house is over there and they have seen the river"] * 50)
    s = toxicity.symbols(f"  {text}  ").astype(np.int64)
    codes, n = np.unique((s[:-2] * 64 + s[1:-1]) * 64 + s[2:], return_counts=True)
    words = Counter(text.split())
    return toxicity.Restorer(toxicity.language_model(pd.DataFrame({"code": codes, "n": n})), {w: float(np.log(k / words.total())) for w, k in words.items()})


def test_deobfuscation():
    r = restorer()
    spaced_out = "y o u a r e a n i d i o t a n d a m o r o n l o s e r"
    same = ["(clown)", "a b c", "", "1 2 3 4 5 6", "well-known house", "3.14"]
    for written, meant in [(x, x) for x in same] + [
        ("1d10t", "idiot"), ("i d i o t!", "idiot!"), ("m.0.r.o.n", "moron"), ("l00ser", "loser"), ("idiooooot", "idiot"), ("$tup1d", "stupid"), ("i  d  i  o  t", "idiot"), ("id.iot", "idiot"), ("id-iot", "idiot"), ("i-d-i-o-t", "idiot"),
        ("iiddiioott", "idiot"), ("w0rthle$$", "worthless"), (spaced_out, "you are an idiot and a moron loser"), (f"so {spaced_out}, he", "so you are an idiot and a moron loser, he"), ("y o u  a r e  s t u p 1 d", "you are stupid"), ("y.o.u a.r.e a.n i.d.i.o.t", "you are an idiot"),
    ]:
        assert r.restore(written) == meant, written
    assert r.restore("z" * 100_000) == "z"
    long = " ".join("youareanidiot" * 900)
    assert r.restore(long) == " ".join(["you are an idiot"] * 900)  # over 10,000 letters, one span


def test_deobfuscation_against_enumeration():
    rng = random.Random(4)
    r = restorer()
    for _ in range(60):
        span = "".join(rng.choice(["i", "d", "1", "0", "o", "t", "t", "e", "3", "$", " ", " ", "."]) for _ in range(rng.randint(3, 9))).strip(" .") or "a"
        best, scores = None, {}
        for way in itertools.product(*r.choices(span)):
            text, total, x, y = "".join(p for p, _ in way), sum(c for _, c in way), 0, 0
            for c in toxicity.symbols(text).tolist():
                total += r.model[x][y][c]
                x, y = y, c
            scores[text.strip()] = max(scores.get(text.strip(), -1e9), total)
            best = max(best if best is not None else -1e9, total)
        assert scores[r.decode(span)] == pytest.approx(best), span
    settle, toxicity.SETTLE = toxicity.SETTLE, 3
    try:
        assert [restorer().decode(s) for s in ("y0u are 1d10t", "i d i o t a n d")] == [r.decode(s) for s in ("y0u are 1d10t", "i d i o t a n d")]
    finally:
        toxicity.SETTLE = settle


def test_logistic_regression():
    """Against plain gradient descent on dense rows."""
    rng = np.random.default_rng(5)
    rows = [sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for _ in range(300)]
    x = np.zeros((300, 13))
    for i, h in enumerate(rows):
        x[i, h] = 1
    x[:, 12] = 1
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, :3].sum(axis=1) * 2 - 1.5)))).astype(float)
    w = np.zeros(13)
    for _ in range(20_000):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y)
        g[:12] += 0.5 * w[:12]
        w -= 0.01 * g
    assert np.allclose(toxicity.fit_weights(rows, np.ones(300), y, 12, ridge=0.5), w, atol=1e-3)


def test_toxicity(spark, nothing):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        bad = rng.random() < 0.2
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 40))]
        if bad:
            w = rng.choice(["wretch", "vermin", "dolt"])
            words.insert(rng.randrange(len(words)), rng.choice([w, w, w.replace("e", "3"), " ".join(w), w[0] + w[1:].replace("o", "0")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1))
    rows += [(5000, None), (5001, ""), (5002, "Ω" * 3000), (5003, " ".join(rng.choice(WORDS) for _ in range(50)) + " " + " ".join("the vermin and the wretch over there under the table".replace(" ", "")) + " " + "water " * 30_000)]
    d = table(spark, rows)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (9999, None, 1)], "doc_id bigint, toxic int, text int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert len(got) == len(rows)
    test = [(got[i].predicted, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert sum(p and not y for p, y in test) == 0 and sum(y and not p for p, y in test) <= 0.05 * len(test)
    assert got[5003].predicted == 1  # spaced out and long, in a very long text
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert toxicity.toxicity(nothing, lab).count() == 0
    assert {r.predicted for r in toxicity.toxicity(d.limit(5), lab.limit(0)).collect()} == {0}


def test_decontamination(spark, docs, nothing):
    items = [(1, "If Alice has 12 apples and buys 7 kg of pears then how many fruits does Alice carry home today"), (2, None), (3, ""), (4, "short one"), (1, "another item that begins like this and ends with twelve more plain words in a row")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))
    rows = [
        (1, "Before. If Bob has 55 apples and buys 3 lb of pears then how many fruits does Bob carry home today. After"),
        (2, "if alice has 12 apples and buys 7 kg of pears then how many fruits does alice carry home today"),
        (3, "If Bob has 55 apples and buys 3 lb of pears then how many fruits does Carol carry home today"),
        (4, "has 12 apples and some other text that is not in there"), (5, "Short one here"), (6, None), (7, ""),
    ]
    got = {r.doc_id: r for r in decontamination.leaks(table(spark, rows), bench).collect()}
    assert [i for i in got if got[i].leaked] == [1, 2, 5]
    assert got[1].items == [1] and got[5].items == [4]
    assert got[3].n_templates == 1 and not got[3].leaked  # the same name stands for two names
    assert decontamination.leaks(nothing, bench).count() == 0
    assert not any(r.leaked for r in decontamination.leaks(docs, bench.limit(0)).collect())


def test_url_filters(spark):
    schema = "pattern string, day int, action string, category string, seq int"
    log = [("bad.org", 10, "add", "x", 1), ("bad.org", 20, "remove", "x", 2), ("bad.org", 90, "add", "x", 3), ("sub.bad.org", 15, "add", "y", 1), ("bad.org", 10, "add", "x", 1), (None, 3, "add", "z", 1), ("c.d", None, "add", "z", 1), ("0.0.1", 1, "add", "z", 1), ("same.day", 5, "remove", "z", 2), ("same.day", 5, "add", "z", 1)]
    entries = spark.createDataFrame(log, schema).withColumn("host", F.lit(1))
    rows = [(1, "http://BAD.org/x", 9), (2, "https://u@a.sub.bad.org:80/", 15), (3, "http://bad.org", 20), (4, "http://www.bad.org./?q", 400), (5, None, 12), (6, "no url", 12), (7, "http://bad.org", None), (8, "http://notbad.org", 12), (9, "http://sub.bad.org", 30), (9, "http://sub.bad.org", 30), (10, "http://bad.org", 2_000_000_000), (11, "http://[::1]:8/", 50), (12, "http://127.0.0.1/", 50), (13, "http://same.day/", 50), (14, "http://" + "a." * 300 + "bad.org/" + "q" * 100_000, 95), (15, "", 3)]
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetch_day int").withColumn("pattern", F.lit(1)).withColumn("level", F.lit("x"))
    found = url_filters.filter_urls(captures, entries).collect()
    got = Counter((r.page_id, r.blocked, r.pattern, r.n_matches) for r in found)
    free = [(i, False, None, 0) for i in (1, 3, 5, 6, 7, 8, 11, 12, 13, 15)]
    assert got == Counter([*free, (2, True, "sub.bad.org", 2), (4, True, "bad.org", 1), (9, True, "sub.bad.org", 1), (9, True, "sub.bad.org", 1), (10, True, "bad.org", 1), (14, True, "bad.org", 1)])
    assert {r.page_id: r.host for r in found}[11] == "[::1]"
    assert url_filters.filter_urls(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filters.filter_urls(captures, entries.limit(0).drop("seq")).collect())


def test_url_lists_against_replay(spark):
    """Random logs of several lists, replayed entry by entry for each capture."""
    rng = random.Random(12)
    names = ["a.b", "x.a.b", "y.x.a.b", "c.d", "e.c.d"]
    log = [(rng.choice(names), rng.choice([rng.randint(0, 60), rng.randint(0, 40_000), 1_000_000 + rng.randint(-2, 2), -rng.randint(1, 9000)]), rng.choice(["add", "add", "remove"]), rng.choice("pq"), i) for i in range(120)]
    asked = [(i, "http://" + rng.choice([*names, "z.y.x.a.b", "b", "q.b"]), rng.choice([e[1] for e in log]) + rng.randint(-2, 2)) for i in range(200)]
    got = {r.page_id: (r.n_matches, r.pattern, r.category) for r in url_filters.filter_urls(spark.createDataFrame(asked, "page_id int, url string, fetch_day int"), spark.createDataFrame(log, "pattern string, day int, action string, category string, seq int")).collect()}
    for i, url, day in asked:
        host, on = url[7:], {}
        for pattern, d, action, category, _ in sorted(log, key=lambda e: (e[1], e[4])):
            if d <= day and (host == pattern or host.endswith("." + pattern)):
                on[pattern, category] = action == "add"
        active = [(len(p), p, c) for (p, c), yes in on.items() if yes]
        assert got[i] == (len(active), *(max(active)[1:] if active else (None, None)))


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(spark, nothing):
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.choice([0, 1, 5, 16, 17, 18, 47, 48, 49, 96, 97, 150]))) for _ in range(25)]
    rows = [(0, None), (1, ""), (None, "a line of no document at all")]
    for i in range(2, 60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(pool)
            k = rng.randrange(len(s) + 1)
            s = rng.choice([s, s[:k] + "c" + s[k + 1 :], s[:k] + s[k + 1 :], s[:k] + "d" + s[k:], s])
            lines.append(s)
        rows.append((i, "\n".join(lines)))
    rows.append((rows[10][0], rows[10][1]))
    rows += [(100, "n" * 60_000 + "\n" + "m" * 20), (101, "n" * 30_000 + "x" + "n" * 30_000)]
    got = Counter(map(tuple, line_dedup.dedup_lines(table(spark, rows)).collect()))
    first = {}
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        for k, s in enumerate([] if t is None else t.split("\n")):
            if s:
                first.setdefault(s, (i, k))
    order = lambda p: (-1 if p[0] is None else p[0], p[1])
    gone = {s for s in first if any(near(s, o) and order(first[o]) < order(first[s]) for o in first if o != s and len(o) >= 16) and len(s) >= 16}
    want = Counter()
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        again = [s != "" and first[s] != (i, k) for k, s in enumerate(lines)]
        close = [s in gone and not a for s, a in zip(lines, again, strict=True)]
        left = "\n".join(s for s, a, c in zip(lines, again, close, strict=True) if not a and not c)
        want[(i, len(lines), sum(again), sum(close), None if t is None else left)] += 1
    assert sum(r[3] for r in want) > 5
    assert got == want
    assert line_dedup.dedup_lines(nothing).count() == 0


def brute_strings(rows, length):
    seen, out = {}, Counter()
    order = sorted(((-1 if i is None else i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    for i, b in order:
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            seen[k] = min(seen.get(k, (i, s)), (i, s))
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] < (-1 if i is None else i, s):
                cover[s : s + length] = True
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[(i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("most", "length", "kmer"), [(5000, 100, 36), (2, 40, 12)])
def test_suffix_dedup(spark, nothing, monkeypatch, most, length, kmer):
    monkeypatch.setattr(suffix_dedup, "MOST_UNITS", most)
    rows = corpus(9, 50) + [(90, "ab" * 300), (91, "ba" * 300 + "c"), (92, "a" * 99), (93, "é" * 120)]
    got = suffix_dedup.dedup_strings(table(spark, rows), length=length, kmer=kmer)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_strings(rows, length)
    assert suffix_dedup.dedup_strings(nothing).count() == 0


def test_units_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    _, first, last = suffix_dedup.units(text)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert starts.tolist() == list(range(3000 - 99))


def brute_fingerprint(text):
    import re

    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, nothing):
    rows = corpus()
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 2:
            parent[find(j)] = find(i)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    want = Counter((doc, f"{fp[i]:016x}", min(least[find(i)], default=None)) for i, (doc, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("segments", [8, 11, 16])
def test_links(spark, segments):
    rng = random.Random(segments)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1, 3]
    all_ = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            all_.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {frozenset((signed(a), signed(b))) for a, b in itertools.combinations(all_, 2) if (a ^ b).bit_count() <= 2}
    d = spark.createDataFrame([(signed(x),) for x in all_], "fp bigint")
    found = [frozenset((r.u, r.v)) for r in simhash.links(d, len(all_), segments=segments).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 5 + 100 * k) for k in range(2, 6)] + [(7, 7)]
    got = {(r.v, r.root) for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {(i, 0) for i in range(31)} | {(x, 100) for x in (100, 205, 305, 405, 505)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
