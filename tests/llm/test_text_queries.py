import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import same
from pyspark.sql import functions as F
from test_text_operators import removed, sets, words

import corpus_pipeline
from strandline.llm import quality
from strandline.llm.mixing import OP2_SQL
from strandline.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small), duck.execute(ORACLE_SQL[name]), close=False)


def test_pipeline(spark, small, tmp_path):
    """Each stage's decisions against its operator on the stage's own input, and the whole run."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if name != "mixture":
            assert new.columns == corpus_pipeline.COLUMNS and new.dtypes == docs.select(*corpus_pipeline.COLUMNS).dtypes
        ids = {r[0] for r in new.select("doc_id").collect()}
        assert ids <= kept.get("last", ids)
        kept["last"], kept[name], docs = ids, new, new
    assert kept["near_dedup"].count() < kept["quality"].count()
    assert kept["passage_dedup"].filter(F.length("text") != F.col("n_chars")).count() == 0
    texts = [r[0] for r in kept["passage_dedup"].select("text").collect()]
    assert all("�" not in t for t in texts)
    whole = {tuple(r) for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {tuple(r) for r in kept["mixture"].collect()}


def test_pipeline_with_odd_rows(spark, tmp_path):
    texts = [None, "", "x", "a " * 300, "a " * 300, "good words stand here in a line and say something new about rivers", None]
    rows = [(k if k < 6 else None, t, "en", "s", len(t or ""), "clash") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def _stage_input(spark, tmp_path, rows, labels, benchmark):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def _kept(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def test_stages_decide_by_row(spark, tmp_path):
    """Null and repeated ids: each row stays or goes by its own text."""
    good = " ".join(f"River {k} runs past the old mill, and the town sleeps." for k in range(12))
    bad = "$$ @@ ## buy buy buy buy %% ^^ " * 12
    item = " ".join(f"bench{k}" for k in range(12))
    labels = [(100 + k, k % 2, 0) for k in range(60)]
    learnt = [(100 + k, (good if k % 2 else bad) + str(k), "en", "l", 0) for k in range(60)]
    one, two = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [
        (None, bad, "en", "a", 0), (None, good, "en", "b", 0), (1, bad, "en", "c", 0), (1, good, "en", "d", 0), (None, f"so {item} end", "en", "e", 0), (2, f"so {item} end", "en", "f", 0), (2, good, "en", "g", 0),
        (3, one, "en", "i", 0), (3, one, "en", "h", 0), (3, two, "en", "j", 0), (None, one + " x", "en", "k", 0), (4, two, "en", "m", 0), (None, "p q r", "en", "n", 0), (None, "p q r", "en", "o", 0),
        (5, "", "en", "p", 0), (5, "", "en", "q", 0), (5, None, "en", "r", 0), (None, None, "en", "s", 0), (None, None, "en", "t", 0),
    ]
    d = _stage_input(spark, tmp_path, learnt + rows, labels, [(1, item)])
    odd = {r[3] for r in rows}
    left = {x[2] for x in _kept(corpus_pipeline.quality(spark, d, str(tmp_path)))} & odd
    assert {"b", "d", "g"} <= left and not {"a", "c"} & left
    left = {x[2] for x in _kept(corpus_pipeline.decontaminate(spark, d, str(tmp_path)))} & odd
    assert left == odd - {"e", "f"}
    only = d.filter("source <> 'l'")
    # a and c, b and d and g, e and f, h and i and k, j and m, n and o; the rows of 5 without words
    want = [r for r in rows if r[3] in set("cdfhjnprst")]
    assert _kept(corpus_pipeline.near_dedup(spark, only, str(tmp_path))) == sorted(((r[0], r[1], r[3]) for r in want), key=str)


def _brute_quality(rows, labels):
    """Statistics and trees in this process."""
    x = quality.statistics(pa.array([r["text"] for r in rows], pa.string()))
    known = {r["doc_id"]: r["quality"] for r in labels if r["quality"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    learnt = sorted((r["doc_id"], known[r["doc_id"]], k) for k, r in enumerate(rows) if r["doc_id"] in known)
    model = quality.fit(x[[k for *_, k in learnt]], np.array([y for _, y, _ in learnt], float), float(np.mean(list(known.values()))))
    return {r["doc_id"] for r, p in zip(rows, model.probability(x), strict=True) if p >= corpus_pipeline.LEAST_QUALITY}


def _brute_near_dedup(rows):
    s, ids = sets([r["text"] for r in rows], 5), [r["doc_id"] for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and min(len(s[a]), len(s[b])) * 100 >= 80 * max(len(s[a]), len(s[b])) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                if x != y:
                    x, y = (x, y) if ids[x] < ids[y] else (y, x)
                    root[y] = x
    return {ids[k] for k in range(len(rows)) if find(k) == k}


def _brute_passages(rows):
    out = {}
    for i, (b, flag) in removed(sorted((r["doc_id"], r["text"]) for r in rows), 100).items():
        text, at, kept = b.decode(), 0, []
        for c in text:
            n = len(c.encode())
            if not flag[at : at + n].all():
                kept.append(c)
            at += n
        if not flag.any() or "".join(kept).strip():
            out[i] = "".join(kept)
    return out


def _brute_decontaminate(rows, items):
    windows = {tuple(w[k : k + 10]) for r in items for w in [words(r["text"])] if w for k in range(max(len(w) - 9, 1))}
    lengths = {len(x) for x in windows}
    return {r["doc_id"] for r in rows for w in [words(r["text"])] if not any(tuple(w[k : k + n]) in windows for n in lengths for k in range(len(w) - n + 1))}


def test_stages_against_brute_force(spark, small, tmp_path):
    import duckdb

    docs = spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels, items = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("labels", "benchmark"))
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = {r["doc_id"]: r for r in out.collect()}
        before = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality":
            assert set(got) == _brute_quality(rows, labels)
        elif name == "near_dedup":
            assert set(got) == _brute_near_dedup(rows)
        elif name == "passage_dedup":
            assert {k: r["text"] for k, r in got.items()} == _brute_passages(rows)
        elif name == "decontaminate":
            assert set(got) == _brute_decontaminate(rows, items)
        else:
            docs.write.parquet(str(tmp_path / "input"))
            c = duckdb.connect()
            c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/input/*.parquet'")
            taken = {r[0]: r[1] for r in c.execute(f"SELECT doc_id, taken FROM ({OP2_SQL})").fetchall()}
            assert {k: r["taken"] for k, r in got.items()} == {k: v for k, v in taken.items() if v > 0}
        if name != "passage_dedup":
            assert all(r["text"] == before[k] for k, r in got.items())
        assert len(got) == out.count() and set(got) <= set(before)
        docs = out


def test_nothing_contaminated_or_rejected_survives(spark, tmp_path):
    """The whole run over null and repeated ids."""
    good = lambda n: " ".join(f"River {n} {k} runs past the old mill number {n * k}, and the town of {n} sleeps." for k in range(12))
    bad = "$$ @@ ## buy buy buy buy %% ^^ " * 12
    item = " ".join(f"bench{k}" for k in range(12))
    rows = [(100 + k, (good(k) if k % 2 else f"{bad} {k}"), "en", "l", 0) for k in range(60)]
    rows += [(i, t, "en", s, 0) for i in (None, 7, 7) for s, t in (("bad", bad), ("dirty", f"{good(91)} {item} {good(92)}"), ("fine", good(93 + (i or 0))))]
    d = str(tmp_path)
    _stage_input(spark, tmp_path, rows, [(100 + k, k % 2, 0) for k in range(60)], [(1, item)])
    out = corpus_pipeline.run(spark, d).collect()
    assert all("bench3" not in r["text"] and "$$ @@" not in r["text"] for r in out)
    assert {r["source"] for r in out} == {"l", "fine"} and sum(r["taken"] for r in out) > 0
    assert set(out[0].asDict()) == {"doc_id", "source", "size", "source_size", "target", "taken", "text", "lang", "n_chars"}
