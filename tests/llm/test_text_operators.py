"""The text operators on small fixtures: brute force, odd rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import _bytes as B
from strandline.llm import chat_format, decontaminate, language, mixing, neardup, quality, suffix_dedup, toxicity, vectors, warc
from strandline.llm._spark import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, key int, node int, n int, s string, k1 int"


def docs(spark, texts, ids=None, langs=None, sources=None):
    """documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, (langs or itertools.repeat("en")), "src", 0, 9, "h", 9, 9, 9, "s", 9) for i, t in zip(ids, texts, strict=True)]
    rows = [(r[0], r[1], langs[k] if langs else "en", sources[k] if sources else "src", *r[4:]) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, DOC)


def saved(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ODD = [None, "", " \n\t", "x", "ab cd", "é" * 300, "\x00\x01 \x7f", LONG, LONG, "a" * 5000, "😀 👍 " * 50]


# bytes


def twist(k):
    """A string of 2**k letters that collides with the one of swapped letters under every polynomial hash of 64 bits, from k = 10 on."""
    t = "a"
    for _ in range(k):
        t += t.translate({97: 98, 98: 97})
    return t


def test_hashes_of_long_words_do_not_collide_by_construction():
    for k in (3, 8, 10, 12):
        a, b = (x.encode() for x in (twist(k), twist(k).translate({97: 98, 98: 97})))
        buf = np.frombuffer(a + b" " + b + b" " + a, np.uint8)
        h = B.span_hashes(buf, *B.spans(buf, B.NOT_SPACE))
        assert h[0] == h[2] != h[1]
    text = np.frombuffer(random.Random(3).randbytes(2000), np.uint8)
    starts = np.arange(0, 1400)
    for size in (1, 7, 8, 9, 64, 511, 512, 513, 600):
        h = B.span_hashes(text, starts, starts + size)
        seen = {}
        for s, x in zip(starts.tolist(), h.tolist(), strict=True):
            assert seen.setdefault(x, text[s : s + size].tobytes()) == text[s : s + size].tobytes()


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["Ab cd", None, "", "  x ", "éa" * 3, "q"]
    got = []
    for i, j, buf, own in B.chunks(pa.array(texts), 8):
        a, b = B.spans(buf, B.NOT_SPACE)
        got += [bytes(buf[x:y]) for x, y in zip(a, b, strict=True)]
        assert B.per_row(a, own).sum() == len(a)
    assert got == [w.encode() for t in texts if t for w in t.split()]
    one = np.frombuffer(b"the cat the catt", np.uint8)
    h = B.span_hashes(one, *B.spans(one, B.NOT_SPACE))
    assert h[0] == h[2] and len(set(h.tolist())) == 3


def test_shingles_of_short_sequences():
    w = np.arange(7, dtype=np.uint64)
    h, n = B.shingles(w, np.array([0, 1, 2, 4]), 3)
    assert n.tolist() == [0, 1, 1, 2] and len(set(h.tolist())) == 4


# 1, 4, 9


def test_language(spark, tmp_path):
    rng = random.Random(1)
    make = lambda syl: " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(60))
    kinds = {"aa": ["th", "er", "on", "an"], "bb": ["ch", "eu", "ß", "ung"], "cc": ["ño", "ez", "que", "ía"]}
    texts, langs = zip(*[(make(s), k) for k, s in kinds.items() for _ in range(40)], strict=True)
    texts, langs = [*texts, *ODD, "123 .", "Q"], [*langs, *[None] * (len(ODD) + 2)]
    d = saved(spark, tmp_path, documents=docs(spark, texts, langs=langs))
    out = {r["doc_id"]: r for r in language.op1_language(spark, d).collect()}
    assert len(out) == len(texts)
    right = [out[k]["lang_pred"] == langs[k] for k in range(120) if out[k]["held_out"]]
    assert np.mean(right) > 0.95
    for k, t in enumerate(texts):
        assert 0 <= out[k]["score"] <= 1 and out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert (out[k]["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t))


def test_bundle_is_the_sum_of_bound_vectors():
    import pyarrow as pa

    texts = ["Ab, a", "", "é1é", "a" * 40]
    got = np.concatenate([x for _, _, x in language.bundles(pa.array(texts))])
    for t, v in zip(texts, got, strict=True):
        c = [0, *itertools.chain.from_iterable([*map(ord, w), 0] for w in re.findall(r"[^\W\d_]+", t.lower()))]
        want = np.zeros(language.DIM)
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            if y:
                e = language.letter_vectors(np.array([x, y, z]))
                want += np.roll(e[0], 2) * np.roll(e[1], 1) * e[2]
        assert np.array_equal(v, want)


def test_prediction_is_the_nearest_prototype(spark):
    """Prototypes and cosines in plain numpy, from bundles of whole texts."""
    import pyarrow as pa

    rng = random.Random(14)
    make = lambda syl, n: " ".join("".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(n))
    kinds = {"aa": ["th", "er", "on", "an"], "bb": ["ch", "on", "ß", "ung"], "cc": ["ño", "er", "que", "ía"]}
    texts, langs = zip(*[(make(s, rng.randint(1, 30)), k) for k, s in kinds.items() for _ in range(30)], strict=True)
    whole = lambda ts: np.concatenate([x for _, _, x in language.bundles(pa.array(ts))]).astype(float)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    d = docs(spark, texts, langs=list(langs))
    names, prototypes = language.learn(d, sample=10**6)
    want = {k: unit(sum(unit(whole([t]))[0] for t, g in zip(texts, langs, strict=True) if g == k)) for k in kinds}
    assert names == sorted(kinds) and np.allclose(prototypes, [want[k] for k in names], atol=1e-6)
    asked = [*texts, make(kinds["aa"], 5), "12", make(kinds["cc"], 3000)]
    out = language.identify(docs(spark, asked).withColumn("held_out", F.lit(True)), names, prototypes).collect()
    for r in out:
        v = whole([asked[r["doc_id"]]])[0]
        cosine = {k: float(unit(v) @ want[k]) for k in names}
        if not v.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert cosine[r["lang_pred"]] == pytest.approx(max(cosine.values()), abs=1e-5) and r["score"] == pytest.approx(max(max(cosine.values()), 0), abs=1e-5)


def test_toxicity_features_and_ratios_by_hand():
    """Hashed n-grams of whole texts in plain Python, and the ratios from their counts."""
    import pyarrow as pa

    texts = ["Ab, cd!", "", "ab cd", "x", "Éé9é ß", "abcdefgh " * 3, None, "the end of the end", "a" * 50]
    full = 2**64 - 1

    def grams(t):
        c, out = [0], set()
        for x in (t or "").lower():
            x = ord(x) if x.isalpha() else 0
            if x or c[-1]:
                c.append(x)
        c, one = [*c, 0], []
        for x in c:
            h = (x * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & full
            one.append(h ^ (h >> 29))
        for n in toxicity.GRAMS:
            for k in range(len(one) - n + 1):
                h = one[k]
                for j in range(1, n):
                    h = (h * 0xBF58476D1CE4E5B9 + one[k + j]) & full
                out.add(((h ^ (h >> 32)) * 0x94D049BB133111EB & full) >> (64 - toxicity.BITS))
        return out

    got = {k: f for k, f in toxicity.features(pa.array(texts, pa.string()))}
    for k, t in enumerate(texts):
        assert len(got[k]) == len(set(got[k].tolist())) and set(got[k].tolist()) == grams(t), t
    rows = [(got[k], k % 2) for k in range(len(texts))] * 2
    ratio = toxicity.log_ratios(rows)
    size = 1 << toxicity.BITS
    totals = [sum(len(g) for g, y in rows if y == label) + toxicity.SMOOTH * size for label in (0, 1)]
    for f in sorted({int(x) for g, _ in rows for x in g})[::7]:
        n = [sum(f in g for g, y in rows if y == label) for label in (0, 1)]
        want = np.log((n[1] + toxicity.SMOOTH) / totals[1]) - np.log((n[0] + toxicity.SMOOTH) / totals[0]) if sum(n) >= toxicity.LEAST_TEXTS else 0
        assert ratio[f] == pytest.approx(want)
    # the score is the curve of the weights' sum over a text's features
    model = toxicity.fit([(g, y) for g, y in rows if len(g)], 0.4)
    margin = np.array([model.weight[g].sum() for g, _ in rows])
    assert model.probability(margin) == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))))


def test_statistics_by_hand():
    import pyarrow as pa

    texts = ["The cat. The CAT sat, 42 times!\n\nthe cat\nthe cat\n", "\n", "", None, "one", "é$ é$ é$\n x", "AB CD ab\tEF.", "\n\nx", "word " * 500 + "\nend"]
    got = dict(zip(quality.NAMES, quality.statistics(pa.array(texts, pa.string())).T, strict=True))
    for k in range(len(texts)):  # whatever stands beside a text in its batch
        alone = quality.statistics(pa.array([texts[k]], pa.string()))[0]
        assert alone == pytest.approx([got[n][k] for n in quality.NAMES], abs=1e-6)
    for k, t in enumerate(texts):
        b = (t or "").encode()
        n, w, lines = max(len(b), 1), [x.encode() for x in (t or "").split()], b.split(b"\n")
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
        size, many = [len(x) for x in w], max(len(w), 1)
        share = lambda chars: sum(c in chars for c in b) / n
        letters, upper = set(quality.LETTER.nonzero()[0].tolist()), set(range(65, 91))
        count = lambda xs: max(map(xs.count, xs), default=0)
        full = [x for x in lines if x]
        pairs = list(zip(low, low[1:], strict=False))
        want = {
            "bytes": np.log1p(len(b)), "words": np.log1p(len(w)), "lines": np.log1p(len(lines)), "word length": sum(size) / many, "word length deviation": np.std(size) if size else 0, "longest word": np.log1p(max(size, default=0)),
            "line words": len(w) / len(lines), "line bytes deviation": np.log1p(np.std([len(x) for x in lines])), "upper": share(upper), "digits": share(b"0123456789"), "letters": share(letters), "punctuation": share(b".,;:?"), "stops": share(b".!?"),
            "symbols": share(quality.SYMBOLS), "high bytes": share(range(128, 256)), "odd symbols": share(b"#$%&*<>=@\\^_`{|}~[]"), "spaces": sum(c in b" \t\n\v\f\r" for c in b) / n,
            "words without letter": sum(not letters & set(x) for x in w) / many, "words with odd symbol": sum(bool(set(x) & set(b"#$%&*<>=@\\^_`{|}~[]")) for x in w) / many, "words ending in punctuation": sum(x[-1] in b".,;:?" for x in w) / many,
            "upper words": sum(sum(c in upper for c in x) > 1 and sum(c in upper for c in x) == sum(c in letters for c in x) for x in w) / many, "short words": sum(s <= 2 for s in size) / many, "distinct words": len(set(low)) / many,
            "adjacent equal words": sum(x == y for x, y in pairs) / many, "distinct word pairs": len(set(pairs)) / max(len(w) - 1, 1), "distinct lines": len(set(full)) / max(len(full), 1), "empty lines": (len(lines) - len(full)) / len(lines),
            "most frequent word": count(low) / many, "stops a word": sum(c in b".!?" for c in b) / many, "equal neighbour bytes": sum(x == y for x, y in zip(b, b[1:], strict=False)) / n,
        }
        for name, v in want.items():
            assert got[name][k] == pytest.approx(v, abs=2e-6, rel=1e-5), (name, t)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 80))) for _ in range(400)]
    bad = [k % 4 == 0 for k in range(400)]
    texts = [f"{t} you Zzorg {t[:20]}" if b else t for t, b in zip(texts, bad, strict=True)] + ODD
    labels = _labels(spark, [(k, 1, int(b)) for k, b in enumerate(bad)] + [(None, 1, 1), (3, 1, None), (5, 1, 7), (6, None, 0)])
    d = saved(spark, tmp_path, documents=docs(spark, texts), labels=labels)
    out = {r["doc_id"]: r for r in toxicity.op4_toxicity(spark, d).collect()}
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert np.mean([out[k]["predicted"] == bad[k] for k in range(400) if out[k]["held_out"]]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items())


def test_quality(spark, tmp_path):
    rng = random.Random(3)
    good = lambda: ". ".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(9)) for _ in range(6))
    junk = lambda: " ".join([rng.choice(["buy", "###", "!!!"])] * rng.randint(30, 60))
    texts = [junk() if k % 3 == 0 else good() for k in range(300)] + ODD
    d = saved(spark, tmp_path, documents=docs(spark, texts), labels=_labels(spark, [(k, int(k % 3 != 0), 0) for k in range(300)]))
    out = {r["doc_id"]: r for r in quality.op9_quality(spark, d).collect()}
    assert len(out) == len(texts) and all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in out.items())
    assert all(out[k]["predicted"] == int(k % 3 != 0) for k in range(300))


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    trees = quality.fit(x, ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float), 0.5)
    for row, p in zip(x[:20], trees.probability(x[:20]), strict=True):
        total = trees.bias
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += v[k - len(f)]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))
    assert np.mean((trees.probability(x) > 0.5) == ((x[:, 1] > 0) ^ (x[:, 3] > 0.5))) > 0.95


@pytest.mark.parametrize("rows", [[], [(0, 1, 1), (1, 1, 1)]])
def test_without_labels_or_with_one(spark, tmp_path, rows):
    d = saved(spark, tmp_path, documents=docs(spark, ["a b", None]), labels=_labels(spark, rows))
    for f in (toxicity.op4_toxicity, quality.op9_quality):
        assert len(f(spark, d).collect()) == 2


# 2


def test_mixture(spark, tmp_path):
    rng = random.Random(5)
    n = 400
    sources = [rng.choice(["a", "a", "a", "b", "c", None, "d"]) for _ in range(n)]
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    texts[:3] = [None, "", LONG]
    ids = [*range(n - 4), 7, 7, None, None]
    d = saved(spark, tmp_path, documents=docs(spark, texts, ids, sources=sources))
    out = [r.asDict() for r in mixing.op2_mix_sources(spark, d).collect()]
    assert len(out) == n and out and sorted(map(str, out)) == sorted(str(r.asDict()) for r in mixing.op2_mix_sources(spark, d).collect())
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, budget = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # the excess goes round until no target is above twice its source
        level = (budget - sum(target.values())) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    got = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        got.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert {k for k in got} == {(sizes[s], round(target[s], 6)) for s in order}
    for (size, t), taken in got.items():
        largest = max((r["size"] for r in out if r["source_size"] == size), default=0)
        assert abs(sum(taken) - t) <= 2 * largest


# 3


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 400_000
    html = ["<a>" * 60, "<a>" * 60, None, "", "x", "x", "tail\r\n\r\nWARC/1.0\r\n", big, "<a>" * 60, "\x00\x1f\x8b" * 50]
    rows = [(k, f"http://h/{k}\r\nX: y" if k != 4 else None, h, "extra") for k, h in enumerate(html)] + [(None, "u", "<a>" * 60, ""), (0, "again", "<a>" * 60, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    scratch = Scratch(spark)
    path, index = warc.write_archives(pages.drop("payload_digest"), scratch, file_bytes=4 << 14)  # four small records, or one larger
    found = sorted(((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in index.collect()))
    assert len(found) == len(rows)
    assert {r["page_id"]: r["payload_digest"] for r in index.collect() if r["page_id"] is not None} == {k: hashlib.sha256((h or "").encode()).hexdigest() for k, h in enumerate(html)}
    kinds = [(r["page_id"], r["record_type"], r["refers_to"]) for r in index.collect()]
    assert (1, "revisit", 0) in kinds and (8, "revisit", 0) in kinds and (None, "revisit", 0) in kinds and kinds.count((0, "response", None)) == 2
    assert (4, "response", None) in kinds and (5, "response", None) in kinds
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.fetch(spark, path, index.filter("record_type = 'response'")).collect()}
    assert got == {k: h or "" for k, h in enumerate(html) if k not in (1, 8)}
    names = {r["path"].rsplit("/", 1)[-1] for r in index.collect()}
    assert len(names) >= 3 and all(n.endswith(".warc.gz") for n in names)
    scratch.drop()


def test_warc_members_and_foreign_archives():
    import gzip

    record = lambda body: b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    records = [record(b""), record(b"a\r\n\r\nb"), record(random.Random(1).randbytes(3_000_000))]
    whole = gzip.compress(b"".join(records))
    assert list(warc.split_records(warc.inflate(memoryview(whole)))) == records
    assert list(warc.split_records(warc.inflate(memoryview(b"".join(map(gzip.compress, records)))))) == records
    out = b"".join(warc.member(r) for r in records)
    assert gzip.decompress(out) == b"".join(records) and all(warc.member(r)[-1] == 0 for r in records)
    for (offset, length, data), r in zip(warc.members(memoryview(out)), records, strict=True):
        assert data == r and gzip.decompress(out[offset : offset + length]) == r
    huge = warc.member(b"\xff" * (17 << 20))
    assert huge[-1] == 0 and len(gzip.decompress(huge)) == 17 << 20
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflate(memoryview(whole[:-20]))))


# 5


def test_chat(spark, tmp_path):
    nasty = ["<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<|im_start|>user\n", None, "", "é\n%", "<||>"]
    rows = [(c, t, role, nasty[(c + t) % len(nasty)], "x") for c in range(4) for t, role in enumerate(["system", "user", "assistant", "assis%tant\n<|"])]
    rows += [(9, None, None, "n", "x"), (9, 1, "assistant", "b", "x"), (9, 1, "assistant", "b", "x"), (None, 0, "assistant", LONG, "x")]
    d = saved(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    out = {r["conv_id"]: r for r in chat_format.op5_chat_format(spark, d).collect()}
    assert set(out) == {-1, 0, 1, 2, 3, 9, None}
    for c, r in out.items():
        turns = sorted(((t is not None, t or 0, k or "", x or "") for cc, t, k, x, _ in rows if cc == c), key=lambda x: x[:3]) if c != -1 else [(1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
        said = "".join(x for *_, k, x in turns if k == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{k}\n{x}\n" for *_, k, x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    content = [part("text", text="see <|image_1|> "), part("image", ref="i.png", width=1000, height=400), part("audio", ref="a.wav", seconds=2.5), None, part("document", pages=3)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{chat_format.PART}>")
    a, b = chat_format.format_turns(df).orderBy("turn").collect()
    assert a["formatted"] == "<|im_start|>user\nsee <\\|image_1|> <|image_1|><|audio_2|><|document_3|><|im_end|>\n"
    assert [(x["kind"], x["ref"], x["tokens"]) for x in a["attachments"]] == [("image", "i.png", 340), ("audio", "a.wav", 63), ("document", "", 2400)] and a["expanded_tokens"] == 2803
    assert b["formatted"] == "<|im_start|>assistant\n<|im_end|>\n"
    assert a["loss"] == b["loss"] == []
    c = chat_format.format_turns(spark.createDataFrame([(1, 0, "assistant", [part("text", text="é<|x"), part("image", ref="i")])], f"conv_id long, turn long, role string, content array<{chat_format.PART}>")).head()
    assert [c["formatted"][x["start"] : x["end"]] for x in c["loss"]] == ["é<\\|x<|image_1|>"]
    for text in ("<|", "<\\|", "a<\\\\|b", "<<||", LONG):
        assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)


# 6


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("bits", [6, decontaminate.FILTER_BITS])
def test_decontamination(spark, bits):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(25)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.randint(0, 25))) for k in range(12)] + [(3, "zz yy"), (50, None), (None, "w1 w2"), (51, "Solo"), (52, "é ü"), (53, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1")]
    texts = [say(rng.randint(0, 60)) for _ in range(60)] + [f"{say(4)}, {t.upper()} - {say(3)}" for _, t in items[:12]] + ["w1 " * 40, "x SOLO y", "É Ü é ü", *ODD]
    d, b = docs(spark, [*texts, texts[60]], [*range(len(texts)), 60]), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_contamination(d, b, Scratch(spark), bits=bits).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        w, hit, ids = words(texts[r["doc_id"]]), set(), set()
        for i, t in items:
            v = words(t)
            if i is None or not v:
                continue
            m = min(10, len(v))
            for g in {tuple(v[k : k + m]) for k in range(len(v) - m + 1)}:
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) == g:
                        hit |= set(range(k, k + m))
                        ids.add(str(i))
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(ids)), r
        assert {k for x in r["runs"] for k in range(x["start"], x["end"])} == hit
    assert decontaminate.find_contamination(d, b.limit(0), Scratch(spark)).filter("n_hit > 0").count() == 0


def test_decontamination_by_a_large_benchmark(spark):
    """Thousands of windows that share their words, most of them in no document; words of equal polynomial hashes are told apart."""
    rng = random.Random(17)
    vocab = [f"v{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(30))) for k in range(800)]
    even = twist(11)
    items.append((900, even))
    texts = [" ".join([*rng.choices(vocab, k=8), *items[k][1].split()[5:18], "end"]) for k in range(0, 800, 40)] + [" ".join(rng.choices(vocab, k=3000)), even.translate({97: 98, 98: 97}), even]
    out = {r["doc_id"]: r for r in decontaminate.find_contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark)).collect()}
    where = {}
    for i, t in items:
        v = t.split()
        for k in range(max(len(v) - 9, 1)):
            where.setdefault(tuple(v[k : k + 10]), set()).add(str(i))
    for d, t in enumerate(texts):
        w, hit, ids = t.split(), set(), set()
        for n in (10, 1):
            for k in range(len(w) - n + 1):
                if (found := where.get(tuple(w[k : k + n]))) and (n == 10 or len(w) < 10):
                    hit |= set(range(k, k + n))
                    ids |= found
        assert (out[d]["n_hit"], out[d]["item_ids"]) == (len(hit), sorted(ids)), d
    assert out[len(texts) - 2]["n_hit"] == 0 and out[len(texts) - 1]["n_hit"] == 1


# 7


def removed(texts, length):
    """doc -> flags by the definition; texts in order of id."""
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        flag = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                flag[k : k + length] = True
            seen.add(w)
        out[i] = (b, flag)
    return out


@pytest.mark.parametrize(("hot", "crowd"), [(4096, 4096), (2, 4096), (4096, 1), (2, 3)])
def test_repeated_passages(spark, hot, crowd):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(150, 600))) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = rng.choice(base)
        a = rng.randrange(len(t))
        u = rng.choice(base)
        texts.append(rng.choice([t, t[:a] + "X" + t[a:], t[a:] + u[: rng.randint(0, 300)], u + u, t[a : a + 130] + "|" + u]))
    texts += [*ODD[:7], "a" * 700, "ab" * 200, "a" * 99, "a" * 100, LONG[:3000], LONG[:3000] + "!"]
    d = docs(spark, [*texts, texts[5]], [*range(len(texts)), 5])
    scratch = Scratch(spark)
    t, base_rows = suffix_dedup.with_keys(d, scratch)
    spans = suffix_dedup.find_spans(t, scratch, shard=4000, hot=hot, crowd=crowd)
    out = suffix_dedup.digests(t, base_rows, spans, scratch).collect()
    assert len(out) == len(texts) + 1
    want = removed(list(enumerate(texts)), 100)
    for r in out:
        b, flag = want[r["doc_id"]]
        kept = np.frombuffer(b, np.uint8)[~flag].tobytes()
        runs = int((np.diff(np.concatenate(([0], flag.astype(int)))) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(flag.sum()), runs, hashlib.sha256(kept).hexdigest()), r["doc_id"]
    left = {r["doc_id"]: r for r in suffix_dedup.without_repeats(d, suffix_dedup.repeat_marks(base_rows, spans)).collect()}
    for i, (b, flag) in want.items():
        kept = np.frombuffer(b, np.uint8)[~flag].tobytes()
        if not flag.any():
            assert left[i]["text"] == texts[i]
        elif i in left:
            runs = int((np.diff(np.concatenate(([0], flag.astype(int)))) == 1).sum())
            assert "�" not in left[i]["text"] and left[i]["n_chars"] == len(left[i]["text"])
            assert len(kept) <= len(left[i]["text"].encode()) <= len(kept) + 6 * runs
        else:
            assert not kept.decode("utf-8", "ignore").strip()
    scratch.drop()


def test_passages_with_null_and_repeated_ids(spark):
    rng = random.Random(1)
    x, y = ("".join(rng.choice("abc") for _ in range(200)) for _ in range(2))
    scratch = Scratch(spark)
    t, base = suffix_dedup.with_keys(docs(spark, [x, x, x + y, y], [None, 4, 5, None]), scratch)
    out = suffix_dedup.digests(t, base, suffix_dedup.find_spans(t, scratch), scratch).collect()
    assert sorted((r["doc_id"] or 9, r["n_bytes"], r["n_removed"]) for r in out) == [(4, 200, 0), (5, 400, 200), (9, 200, 200), (9, 200, 200)]
    t, base = suffix_dedup.with_keys(docs(spark, [x, x + y], [None, 5]), scratch)
    assert sorted((r["doc_id"] or 9, r["n_removed"]) for r in suffix_dedup.digests(t, base, suffix_dedup.find_spans(t, scratch), scratch).collect()) == [(5, 0), (9, 200)]
    t, base = suffix_dedup.with_keys(docs(spark, [x, None, x], [4, 7, None]), scratch)
    assert sorted((r["doc_id"] or 9, r["n_removed"]) for r in suffix_dedup.digests(t, base, suffix_dedup.find_spans(t, scratch), scratch).collect()) == [(4, 0), (7, 0), (9, 200)]
    scratch = Scratch(spark)
    t, base = suffix_dedup.with_keys(docs(spark, [x, x + y, y, x, None, None], [None, 2, 2, 1, None, 3]), scratch)
    spans = suffix_dedup.find_spans(t, scratch)
    out = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.digests(t, base, spans, scratch).collect()}
    assert out[1, 200] == 0 and out[None, 200] == 200 and out[None, 0] == 0 and out[3, 0] == 0
    assert {out[2, 400], out[2, 200]} in ({400, 0}, {200, 200})


def test_passages_of_an_id_with_a_text_and_a_copy(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abc") for _ in range(200)) for _ in range(2))
    scratch = Scratch(spark)
    t, base = suffix_dedup.with_keys(docs(spark, [b, a + a, b, "xyz" + a], [3, 5, 5, 8]), scratch)
    out = suffix_dedup.digests(t, base, suffix_dedup.find_spans(t, scratch), scratch).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in out) == [(3, 200, 0), (5, 200, 200), (5, 400, 200), (8, 203, 200)]


def test_run_length_index():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(40)] + [b"\xff" * 12, b"", b"\x00\x00"]
    x = suffix_dedup.RunLengthIndex(strings)
    suffixes = [(strings[k][p:], k) for k in range(len(strings)) for p in range(len(strings[k]) + 1)]
    place = {(k, p): int(x.offsets[k]) + p for k in range(len(strings)) for p in range(len(strings[k]) + 1)}
    order = sorted(range(len(suffixes)), key=lambda i: ([*suffixes[i][0]], suffixes[i][1]))
    at = [place[suffixes[i][1], len(strings[suffixes[i][1]]) - len(suffixes[i][0])] for i in order]
    common = lambda a, b: next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    above, before, below, after = x.statistics()
    for r, i in enumerate(order):
        assert before[at[r]] == (common(suffixes[order[r - 1]][0], suffixes[i][0]) if r else 0)
        assert after[at[r]] == (common(suffixes[order[r + 1]][0], suffixes[i][0]) if r + 1 < len(order) else 0)
        assert not before[at[r]] or above[at[r]] == at[r - 1]
        assert not after[at[r]] or below[at[r]] == at[r + 1]
    # the transform, run by run
    bwt = [0 if len(strings[suffixes[i][1]]) == len(suffixes[i][0]) else strings[suffixes[i][1]][-len(suffixes[i][0]) - 1] + 1 for i in order]
    heads = dict(zip(x.heads[1].tolist(), x.heads[0].tolist(), strict=True))
    now = None
    for r, symbol in enumerate(bwt):
        now = heads.get(r, now)
        assert now == symbol
    assert len(heads) == 1 + sum(a != b or b == 0 for a, b in itertools.pairwise(bwt))


def test_index_of_copies_is_as_large_as_its_runs():
    rng = random.Random(10)
    one = bytes(rng.choice(b"abcd") for _ in range(2000))
    few, many = suffix_dedup.RunLengthIndex([one] * 2), suffix_dedup.RunLengthIndex([one] * 60)
    kept = lambda x: sum(a.nbytes for a in (*x.heads, *x.first, *x.last))
    assert kept(many) < 1.2 * kept(few) + 60 * 200 and kept(many) < 60 * len(one) * 8 / 2
    assert not hasattr(many, "suffixes")
    assert many.repeats(100).tolist() == [int(many.offsets[k]) + p for k in range(1, 60) for p in range(len(one) - 99)]


# 8


def test_nearest(spark, tmp_path):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(700, 24)).astype(np.float32)
    v[300:420] = v[300]  # many of one vector
    rows = [(k, [float(a) for a in x], 0, "c") for k, x in enumerate(v)]
    rows += [(1000, None, 0, ""), (1100, [0.0] * 24, 0, ""), (1200, [1.0] * 23, 0, ""), (1300, [float("nan")] * 24, 0, ""), (1400, [None] * 24, 0, ""), (1500, [float("inf")] * 24, 0, ""), (5, [float(a) for a in v[5]], 0, ""), (1600, [], 0, "")]
    d = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string"))
    out = vectors.op8_nearest(spark, d).collect()
    hits = total = 0
    every = [*enumerate(v), (5, v[5])]
    for q in range(0, 700, 100):
        best = sorted((float(np.sqrt(((v[q].astype(float) - x.astype(float)) ** 2).sum())), k) for k, x in every if k != q)[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11))
        assert all(s == pytest.approx(np.linalg.norm(v[q].astype(float) - v[i].astype(float)), abs=1e-12) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in best})
        total += 10
    assert len(out) == total and hits / total >= 0.95


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0])], "vec_id long, vector array<float>")
    scratch = Scratch(spark)
    index = vectors.build(df, scratch, vector="vector")
    assert [tuple(r) for r in vectors.search(index, df.filter("vec_id = 0"), scratch).collect()] == [(0, 1, 1, 1.0)]
    assert vectors.build(df.limit(0), scratch, vector="vector") is None


def test_nearest_among_vectors_of_two_dimensions(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(k, [float(x) for x in rng.normal(size=8 if k % 3 else 70)]) for k in range(600)]
    d = saved(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = vectors.op8_nearest(spark, d).collect()
    assert len(out) == 60
    for q in range(0, 600, 100):
        a = np.array(rows[q][1], np.float32).astype(float)
        want = sorted((float(np.linalg.norm(a - np.array(x, np.float32))), k) for k, x in rows if k != q and len(x) == len(a))[:10]
        got = sorted((r["rank"], r["vec_id"]) for r in out if r["query_id"] == q)
        assert len({k for _, k in got} & {k for _, k in want}) >= 9


def test_estimates_are_bounded():
    rng = np.random.default_rng(13)
    for dim in (20, 64, 130):
        x = rng.normal(size=(500, dim)).astype(np.float32) + 0.3
        mean = x.astype(float).mean(0)
        c = x.astype(float) - mean
        length = np.sqrt((c * c).sum(1))
        unit = (c / length[:, None]) @ vectors.rotation(dim)
        asked = vectors.Asked(np.arange(40), x[:40], mean)
        middle, slack = asked.bounds(vectors.packed(unit >= 0), length, np.abs(unit).sum(1) / np.sqrt(dim), 3.0)
        true = ((x[:40, None, :].astype(float) - x[None, :, :]) ** 2).sum(2)
        off = np.abs(middle - true)
        assert np.mean(off <= slack) > 0.99 and abs(float((middle - true)[:, 40:].mean())) < 0.02 * true.mean()


# 10


def sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set())
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(8):
        base = [rng.choice(vocab) for _ in range(rng.randint(8, 150))]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t).upper() if rng.random() < 0.2 else "  ".join(t))
    texts += [*ODD, "x y", "X  y", "x"]
    texts.append(texts[0])
    d = docs(spark, texts)
    out = {r["doc_id"]: r for r in neardup.near_duplicates(d, Scratch(spark), size=size, block=8).collect()}
    s, root = sets(texts, size), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(out) == len(texts)
    assert [(out[k]["n_shingles"], out[k]["component_id"]) for k in range(len(texts))] == [(len(s[k]), find(k)) for k in range(len(texts))]


def test_near_duplicates_of_centres_with_many_members(spark, monkeypatch):
    """The set of a centre goes out in copies, and the exact pass in small blocks; long words of equal polynomial hashes are not linked."""
    monkeypatch.setattr(neardup, "FAN", 3)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(40)] + [twist(11), twist(11).translate({97: 98, 98: 97}), twist(11)]
    out = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, texts), Scratch(spark), size=2, block=4).collect()}
    assert out == {**dict.fromkeys(range(40), 0), 40: 40, 41: 41, 42: 40}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    t = " ".join(f"w{k}" for k in range(50))
    out = [(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, [t, t, "a b c", t, None], [4, None, 4, 7, None]), Scratch(spark)).collect()]
    assert sorted(out, key=str) == sorted([(4, 4), (None, None), (4, 4), (7, 4), (None, None)], key=str)


def test_near_duplicates_of_an_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, [a, b, a + " more", b, b + " on", c, None, None, a], [5, 5, 7, 3, 9, 9, 9, None, None]), Scratch(spark)).collect()]
    want = [(5, 46, 5), (5, 46, 3), (7, 47, 5), (3, 46, 3), (9, 47, 3), (9, 46, 9), (9, 0, 9), (None, 0, None), (None, 46, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    # both texts are the smallest of their sets
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, [a, b, a + " more", b + " on"], [5, 5, 7, 9]), Scratch(spark)).collect()}
    assert got == {(5, 5), (7, 5), (9, 5)}
    found = neardup.near_duplicates(docs(spark, [a, b, c, c + " on", b], [5, 5, 6, 5, 4]), Scratch(spark)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(4, 4), (5, 4), (5, 5), (5, 5), (6, 5)]


# all


def test_scratch_tables_go_on_errors(spark):
    from pathlib import Path

    from strandline.llm._spark import shared_folder

    with pytest.raises(ZeroDivisionError), Scratch(spark) as scratch:
        scratch.table(spark.range(3), "numbers")
        folder = Path(scratch.path.removeprefix("file:"))
        assert folder.exists()
        1 / 0  # noqa: B018
    assert not folder.exists()
    with Scratch(spark, spark.range(3)) as scratch:
        kept = scratch.keep(scratch.table(spark.range(50).repartition(40), "numbers"))
    assert kept.count() == 50 and not Path(scratch.path.removeprefix("file:")).exists()
    assert kept.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and shared_folder(spark)


def test_empty_tables(spark, tmp_path):
    d = saved(
        spark, tmp_path, documents=docs(spark, []), labels=_labels(spark, []), benchmark=spark.createDataFrame([], "item_id long, text string"), pages=spark.createDataFrame([], "page_id long, url string, html string"),
        embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
    )
    from strandline.llm.registry import QUERIES

    for name, f in QUERIES.items():
        assert f(spark, d).count() == (name == "op5_chat_format"), name
