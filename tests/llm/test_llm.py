"""The operators against brute force, round trips and held-out labels, on small fixtures with every awkward row."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from quern.llm import bpe, components, huffman, line_dedup, packing, quality_model, quality_rules, setjoin, simhash, tiff, url_filter, warc
from quern.llm.queries import ORACLE, QUERIES, URL_RULES, vocabulary
from quern.llm.tokens import JsonTokenizer

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "one", "Hello, world!\nsame line", "a  b\n\n c\t\x1c", "日本語 テキスト é́ ſ İ", "x" * 70000, "The quick brown fox. " * 300, "Hello, world!\nsame line", " ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", t) for i, t in enumerate(TEXTS)] + [(None, "null id", "c", ""), (3, TEXTS[3], "c", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, Text string, ids string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(spark, name):
    own = JsonTokenizer(vocabulary(name))
    assert own.fast is not None
    marks = [a + m + b for m in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext") for a in ("", "x ", "é\n") for b in ("", "y", " <|endoftext|>")]
    texts = TEXTS[:6] + TEXTS[7:] + marks + ["a" * k for k in range(1, 40)] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode([t or "" for t in texts])] == library(name, texts)


def test_packing(docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs, path, length=16).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for k, parts in seqs.items():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
        assert sum(r.length for r in parts) == 16 or k == max(seqs)
    want = {i: [*ids, 0] for i, ids in enumerate(library("byte_bpe_50k.json", TEXTS))}
    for i in set(want) - {3}:
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in parts), "<u4").tolist() == want[i]
        assert {r.doc_tokens for r in parts} == {len(want[i])}
    assert packing.pack(empty, path).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (2, None, None), (3, "http://c", ""), (4, "http://d\r\nX: y", "x" * 300000), (None, "http://e", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.archive(pages, path)
    got = {r.record_id: r for r in spark.read.format("warc").option("verify", "true").load(path).collect() if r.record_id}
    assert got["urn:page:1"].record_type == "revisit" and got["urn:page:1"].refers_to == "urn:page:5" and got["urn:page:1"].payload_bytes == 4
    assert bytes(got["urn:page:4"].payload) == b"x" * 300000 and got["urn:page:2"].refers_to == "urn:page:3"
    some = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'")
    assert some.count() == 2 and some.filter("payload is not null").count() == 0
    plain = b"".join(warc.record({"payload": p, "record_type": "response", "record_id": f"urn:{i}", "refers_to": None}) for i, p in enumerate([b"q", b"", b"z" * 200000]))
    for name, data in (("p.warc", plain), ("g.warc.gz", __import__("gzip").compress(plain[: len(plain)]))):
        (tmp_path / name).write_bytes(data)
    members = b"".join(__import__("gzip").compress(plain[i:j]) for i, j in ((0, 500), (500, 900), (900, len(plain))))
    (tmp_path / "m.warc.gz").write_bytes(members)  # members that end within records
    (tmp_path / "long.warc").write_bytes(plain.replace(b"WARC/1.1\r\n", b"WARC/1.1\r\nX-Long: " + b"h" * (3 << 20) + b"\r\n"))
    for name in ("p.warc", "g.warc.gz", "m.warc.gz", "long.warc"):
        load = spark.read.format("warc").load(str(tmp_path / name))
        assert [bytes(r.payload) for r in load.collect()] == [b"q", b"", b"z" * 200000], name
        assert [r.payload_bytes for r in load.filter("record_id = 'urn:2'").collect()] == [200000], name
    assert spark.read.format("warc").option("payload", "false").load(str(tmp_path / "g.warc.gz")).filter("payload is null").count() == 3
    (tmp_path / "cut.warc.gz").write_bytes(__import__("gzip").compress(plain[:-1000]))
    with pytest.raises(Exception, match="ends early"):
        spark.read.format("warc").load(str(tmp_path / "cut.warc.gz")).collect()
    twice = spark.createDataFrame([(1, "u", "p", "x"), (1, "u", "p", "y"), (0, "u", "p", "z")], "page_id long, url string, html string, HTML string")
    warc.archive(twice, str(tmp_path / "twice"))  # a name that clashes by case; rows that repeat the largest id
    assert sorted(r.record_type for r in spark.read.format("warc").load(str(tmp_path / "twice")).collect()) == ["response", "response", "revisit"]
    warc.archive(pages.filter("page_id < 0"), str(tmp_path / "none"))
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0


def test_bpe_equals_tiktoken(docs, empty):
    import tiktoken

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.decode(bpe.encode(docs, path), path).collect():
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert bpe.encode(empty, path).count() == 0


def brute_classes(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


@pytest.mark.parametrize("heavy", [512, 2])
def test_simhash(spark, heavy):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_duplicates(d, heavy=heavy).collect()
    fps = [np.uint64(r.fp & (2**64 - 1)) for r in got]
    assert brute_classes(fps, [r.doc_id for r in got]) == {r.doc_id: r.component_id for r in got}


def test_simhash_links_all_within_two_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (60, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for heavy in (512, 8):
        comp = {r.node: r.component for r in components.components(simhash.links(df, heavy=heavy)).collect()}
        want = brute_classes([np.uint64(x) for x in fps], list(range(len(fps))))
        assert all((comp.get(fps[i], fps[i]) == comp.get(fps[j], fps[j])) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_components(spark):
    """Paths, cycles, loops and repeats, in one task and in rounds."""
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (700, 2))] + [(k, k + 1) for k in range(2000, 2100)] + [(7, 7), (2050, 2000)]
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        least[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "u long, v long")
    for bound in (0, 1 << 18):
        assert {r.node: r.component for r in components.components(df, one_task=bound).collect()} == {x: find(x) for x in linked}


def test_thresholds_sum(spark):
    plan = simhash.Plan([list(range(0, 21)), list(range(21, 42)), list(range(42, 64))], [[np.ones(1 << 10), np.ones(1 << 11)], [np.ones(1 << 10), np.ones(1 << 11)], [np.ones(1 << 11)] * 2], 1000, 2)
    t = plan.thresholds(np.arange(50, dtype=np.uint64))
    assert (t.sum(axis=1) == 0).all() and (t >= -1).all()


def test_simhash_edges(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    blank = [r for r in got if r.doc_id in (0, 1, 9)]
    assert all(r.fp == 0 and r.component_id == 0 for r in blank) and len(got) == docs.count()
    assert simhash.near_duplicates(empty).count() == 0
    words = [f"word{i}" for i in range(200)]
    near = docs.sparkSession.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:100], "other", *words[101:]])), (3, " ".join(f"w{i}" for i in range(200))), (4, " ".join(words)), (None, "x")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.drop_near_copies(near).collect()) == ["1", "3", "None"]


def test_huffman(docs, empty):
    got = sorted(huffman.write_read(docs, vocabulary("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted([*range(len(TEXTS)), 3])
    ids = library("word_bpe_49k.json", TEXTS)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == [*ids[r.doc_id], 1]
    assert huffman.write_read(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_huffman_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 3000):
        counts = (rng.pareto(0.5, n) * 10).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts, 13)
        assert n < 2 or abs(sum(2.0 ** -int(x) for x in lengths) - 1) < 1e-12
        ids = rng.integers(0, n, 70000) if n else np.empty(0, dtype=np.int64)
        payload, begins = huffman.pack_bits(huffman.canonical(lengths)[ids], lengths[ids].astype(np.int64))
        assert not n or (huffman.Decoder(lengths, 13).ids(payload, begins[:: huffman.STEP], len(ids)) == ids).all()


def lines_brute(rows, min_docs, min_chars):
    keys = {}
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for d, t in rows:
        for line in {norm(x) for x in (t or "").split("\n")}:
            if len(line) >= min_chars:
                keys.setdefault(line, []).append(d)
    common = {k: max(v) for k, v in keys.items() if len(v) >= min_docs}
    return {d: "\n".join(x for x in (t or "").split("\n") if norm(x) not in common or common[norm(x)] == d) for d, t in rows}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup_and_its_reversal(spark, limit):
    rows = [(i, "\n".join([f"own line of {i}", " Shared É line", "shared é LINE".replace("LINE", "line"), f"common {i % 3} text"])) for i in range(20)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.LineIndex(spark, 5, 8, shards=4, broadcast_bytes=limit)
    first = docs.filter("doc_id < 10 or doc_id > 80")
    want = lines_brute([r for r in rows if r[0] < 10 or r[0] > 80], 5, 8)
    assert {r.doc_id: r.text for r in index.insert(first).apply(first).collect()} == want
    assert {r.doc_id: r.text for r in index.insert(docs.filter("doc_id between 10 and 20")).apply(docs).collect()} == lines_brute(rows, 5, 8)
    index.delete(docs.filter("doc_id between 10 and 20").select("doc_id"))
    assert {r.doc_id: r.text for r in index.apply(first).collect()} == want
    assert line_dedup.dedup(docs.filter("doc_id < 0")).count() == 0


def test_line_dedup_edges(spark):
    shared = "a line that is long enough to be looked at, shared"
    rows = [(i, f"{shared}\nown {i}", "x", 7) for i in range(6)] + [(None, f"{shared}\nnull", "x", 7), (None, f"{shared}\nnull too", "x", 7), (5, f"{shared}\nfive again", "x", 7), (50, "y" * 200_000 + "\n" + shared, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Text string, N_LINES long").repartition(3)
    want = sorted(t if i == 50 else t.split("\n")[1] for i, t, _, _ in rows)
    for limit in (64 << 20, 0):
        kept = line_dedup.dedup(docs, broadcast_bytes=limit)
        assert kept.columns == ["doc_id", "text", "Text", "n_lines", "n_dropped"]
        assert sorted(r[1] for r in kept.collect()) == want
    index = line_dedup.LineIndex(spark, 5, 40).insert(docs, keep_references=False)
    with pytest.raises(ValueError):
        index.insert(docs)
    with pytest.raises(ValueError):
        index.delete(docs.select("doc_id"))


def test_line_filters_grow_by_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    docs = spark.createDataFrame([(d, "\n".join(f"line {i} of all" for i in range(40 * (1 + d % 2)))) for d in range(6)], "doc_id long, text string")
    index = line_dedup.LineIndex(spark, 3, 4, shards=2).insert(docs.filter("doc_id < 4"))
    first = index.shards
    index.insert(docs.filter("doc_id >= 4"))
    assert first >= 8 and index.shards > first
    assert {r.doc_id: r.text for r in index.apply(docs).collect()} == lines_brute([(r.doc_id, r.text) for r in docs.collect()], 3, 4)


def test_url_filter(spark):
    urls = ["http://www.EXAMPLE.com/en/75?x", "https://a.example.com/en/2", "ftp://net/de/1", "http://x.example.net/de/80", "http://example.org/es/", "nothing", None, "http://h?q/a", "http://com/en"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES, url_filter.train([], [])).collect()}
    assert [got[i].rule for i in range(9)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None]
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[0].host, got[0].path, got[7].host, got[7].path, got[6].host) == ("www.example.com", "/en/75", "h", "", "")
    rng = np.random.default_rng(0)
    made = [f"http://{'b4d' * 3 if bad else 'good'}{rng.integers(9)}.com/{'1' * int(rng.integers(5, 9)) if bad else 'page'}" for bad in rng.integers(0, 2, 400)]
    y = [int("b4d" in u) for u in made]
    model = url_filter.train(made[:300], y[:300])
    assert ((model.score(url_filter.features(made[300:], model.suffixes)) > 0.5) == np.array(y[300:], bool)).mean() > 0.95


def test_quality_model(spark):
    out = QUERIES["op8_quality_fm"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() >= 0.95
    x = quality_model.text_features("a b a", [])
    m = quality_model.Machine(0.1, np.random.default_rng(0).normal(size=quality_model.DIM + len(quality_model.STATS)), np.random.default_rng(1).normal(size=(quality_model.DIM + len(quality_model.STATS), 4)))
    i, v = np.concatenate([x[0], quality_model.DIM + np.arange(len(x[2]))]), np.concatenate([x[1], x[2]])
    pairs = sum((m.v[i[a]] @ m.v[i[b]]) * v[a] * v[b] for a in range(len(i)) for b in range(a))
    assert abs(m.score(*x) - 1 / (1 + np.exp(-(0.1 + m.w[i] @ v + pairs)))) < 1e-9


def test_quality_model_edges(docs, empty):
    m = quality_model.fit([], np.empty(0))
    assert quality_model.score(docs, m).filter("score between 0 and 1").count() == docs.count()
    assert quality_model.score(empty, m).count() == 0


def test_quality_sample_counts_repeated_ids_once(spark, monkeypatch):
    """Rows that repeat a doc_id don't make the sample larger, and don't change what is learnt; nor does the number of features scored at once."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sizes, fit = [], quality_model.fit
    monkeypatch.setattr(quality_model, "fit", lambda rows, labels, **options: sizes.append((len(rows), len(labels), {a.dtype.itemsize for a, _, _ in rows})) or fit(rows, labels, **options))
    many = docs.unionByName(docs).unionByName(docs)
    once, again = quality_model.train(docs, labels, rows=50), quality_model.train(many, labels, rows=50)
    assert sizes == [(50, 50, {2})] * 2
    assert once.w0 == again.w0 and (once.w == again.w).all() and (once.v == again.v).all()
    rows = [quality_model.text_features(t or "", []) for t in TEXTS]
    want = once.scores(rows)
    monkeypatch.setattr(quality_model, "SCORE_ENTRIES", 40)
    assert (once.scores(rows) == want).all() and len(want) == len(TEXTS)


def test_quality_keeps_by_position(spark, docs, empty):
    """Columns that clash by case, null and repeated rows, empty tables: rows come back as they were."""
    m = quality_model.fit([], np.empty(0))
    assert quality_model.keep(docs, m).columns == docs.columns and quality_model.keep(docs, m).count() == docs.count() and quality_model.keep(empty, m).count() == 0
    good = "A plain sentence of some ordinary words, written by hand and kept apart from others. " * 1
    text = " ".join(f"{good}It is number {k} of its kind and says so." for k in range(6))
    some = spark.createDataFrame([(1, text, "x", "y"), (1, text, "x", "y"), (None, text, "x", "y"), (2, None, "x", "y"), (3, "", "x", "y")], "doc_id long, text string, TEXT string, ids string")
    kept = quality_rules.keep(some)
    assert kept.columns == some.columns and quality_rules.keep(some.limit(0)).count() == 0
    judged = [r.kept for r in quality_rules.judge(some)[0].collect()]
    assert kept.count() == sum(judged) and {r[1] for r in kept.collect()} <= {text}


LONG_TEXTS = """
import sys
import numpy as np
from pyspark.sql import SparkSession
from quern.llm import quality_model
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
kept = quality_model.keep(spark.read.parquet(sys.argv[1]), quality_model.fit([], np.empty(0)))
print("kept", kept.selectExpr("count(*) AS n", "sum(length(text)) AS chars").first())
"""


def test_long_texts_of_one_row_group_are_read_in_small_batches(tmp_path):
    """600 texts of 400 000 characters, one row group, with a heap that holds them in no array: the reader's batches have no bound in bytes."""
    import os
    import subprocess
    import sys

    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = [f"{i:04d} " + "lorem ip. " * 39999 + "12345" for i in range(600)]
    pq.write_table(pa.table({"doc_id": pa.array(range(600), pa.int64()), "text": texts}), tmp_path / "t.parquet", use_dictionary=False)
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", LONG_TEXTS, str(tmp_path / "t.parquet")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "kept Row(n=600, chars=240000000)" in out.stdout, out.stderr[-3000:]


def measures_brute(t):
    t = t or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    seen, marks, places = {}, set(), {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in places.values():
        if len(at) > 1:
            marks.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in t.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    del seen
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marks), n < 20 or 100 * len(marks) > 30 * n


def test_quality_rules(spark, docs, empty):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df, text in ((docs.filter("doc_id <> 3"), dict(enumerate(TEXTS))), (whole, {r.doc_id: r.text for r in whole.collect()})):
        got, model = quality_rules.judge(df)
        for r in got.collect():
            if r.doc_id is not None:
                assert tuple(r[m] for m in quality_rules.MEASURES) == measures_brute(text[r.doc_id])
                z = np.prod([model.rates[k][1][r[f"q_v_{k}"]] / model.rates[k][0][r[f"q_v_{k}"]] for k in quality_rules.RULES]) * model.share / (1 - model.share)
                assert abs(r.posterior - z / (1 + z)) < 1e-6 and r.kept == (not r.base_failed and r.posterior >= 0.5)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = got.join(labels, "doc_id").toPandas()
    assert (both.kept | both.base_failed)[both.quality == 1].mean() > 0.98 and both.kept[both.quality == 0].mean() < 0.1
    assert quality_rules.judge(empty)[0].count() == 0


@pytest.mark.parametrize("how", [1, 5, 8, 32773])
def test_tiff(how):
    rng = np.random.default_rng(how)
    images = [rng.integers(0, 5, (70, 50), dtype=np.uint8), rng.integers(0, 65535, (33, 20, 3)).astype(np.uint16), rng.integers(0, 256, (300, 90), dtype=np.uint8)]
    for predictor in (1, 2):
        for tile in (None, (16, 32)):
            for order in "<>":
                got = list(tiff.Tiff(tiff.write(images, compression=how, predictor=predictor, tile=tile, order=order)).pages())
                assert all((p.pixels.reshape(i.shape) == i).all() for p, i in zip(got, images, strict=True))


def test_tiff_tables(spark, docs, empty):
    rows = QUERIES["op10_tiff"](spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        data = text[r.doc_id].encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert tiff.pages(tiff.encode_texts(docs)).filter("error is null").count() == docs.count()
    assert tiff.encode_texts(empty).count() == 0
    bad = spark.createDataFrame([(1, None), (2, b"II*\0\xff\xff\xff\x00"), (3, b"nope")], "doc_id long, media binary")
    assert tiff.pages(bad).filter("page is null and error is not null").count() == 3


def test_tiff_faults_are_rows(spark):
    """Headers that ask for nothing or too much, strips that are missing or broken; sound pages around them are read."""
    page = np.arange(600, dtype=np.uint8).reshape(20, 30)
    good = tiff.write([page] * 3)

    def changed(tag, value, which=1, data=good):
        data, at = bytearray(data), int.from_bytes(data[4:8], "little")
        for _ in range(which):
            n = int.from_bytes(data[at : at + 2], "little")
            at = int.from_bytes(data[at + 2 + 12 * n : at + 6 + 12 * n], "little")
        n = int.from_bytes(data[at : at + 2], "little")
        for i in range(n):
            place = at + 2 + 12 * i
            if int.from_bytes(data[place : place + 2], "little") == tag:
                data[place + 8 : place + 12] = value.to_bytes(4, "little")
        return bytes(data)

    asked = [(tiff.WIDTH, 0), (tiff.HEIGHT, 0), (tiff.SAMPLES, 0), (tiff.WIDTH, 1 << 20), (tiff.HEIGHT, 1 << 31), (tiff.COMPRESSION, 7), (tiff.PREDICTOR, 3), (tiff.STRIP_OFFSETS, 1 << 30), (tiff.STRIP_BYTES, 3), (tiff.BITS, 1), (tiff.ROWS_PER_STRIP, 1), (tiff.PLANAR, 9)]
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    rows = [(i, changed(t, v)) for i, (t, v) in enumerate(asked)] + [(100, bytes(loop)), (101, changed(tiff.TILE_WIDTH, 0, 0, tiff.write([page], tile=(16, 16))))]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    got = {}
    for r in tiff.pages(df).collect():
        got.setdefault(r.doc_id, {})[r.page] = r.error
    for i in range(len(asked)):
        assert got[i][0] is None and got[i][1] and got[i][2] is None, asked[i]
    assert got[100][0] is None and "loop" in got[100][None] and got[101][0]


def test_tiff_of_many_pages(spark):
    """More pages than a 16-bit number counts."""
    df = spark.createDataFrame([(1, tiff.write([np.zeros((1, 1), np.uint8)] * 66_000, compression=1))], "doc_id long, media binary")
    assert tiff.pages(df).filter("error is null").count() == 66_000


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine, other = QUERIES[name](spark, SF).toArrow(), con.sql(ORACLE[name]).to_arrow_table()
    names = sorted(mine.column_names)
    assert names == sorted(other.column_names)
    key = lambda t: sorted(tuple(map(str, r)) for r in zip(*[t.column(n).to_pylist() for n in names], strict=True))
    assert key(mine) == key(other)


def test_pipeline(spark):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "line_dedup", "simhash_near_dedup", "packing"]
    text = {r.doc_id: r.text for r in docs.collect()}

    def step(name):
        out = stages[name](spark, docs, SF).cache()
        assert out.columns == names
        return out, {r.doc_id: r.text for r in out.collect()}

    judged, model = quality_rules.judge(docs)
    docs, kept = step("quality_rules")
    want = set()
    for r in judged.collect():
        z = np.prod([model.rates[k][1][r[f"q_v_{k}"]] / model.rates[k][0][r[f"q_v_{k}"]] for k in quality_rules.RULES]) * model.share / (1 - model.share)
        if not measures_brute(text[r.doc_id])[-1] and z / (1 + z) >= 0.5:
            want.add(r.doc_id)
    assert set(kept) == want and all(text[d] == t for d, t in kept.items())

    machine = corpus_pipeline.quality_machine(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    docs, scored = step("quality_classifier")
    assert set(scored) == {d for d, t in kept.items() if machine.score(*quality_model.text_features(t, [])) >= 0.3}

    docs, lines = step("line_dedup")
    assert lines == lines_brute(sorted(scored.items()), 5, 40) and all(r.n_chars == len(r.text) for r in docs.collect())

    docs, single = step("simhash_near_dedup")
    assert set(single) == set(lines) - dropped_brute(sorted(lines.items()))

    pieces = stages["packing"](spark, docs, SF).collect()
    ids = {d: [*x, 0] for d, x in zip(single, library("byte_bpe_50k.json", list(single.values())), strict=True)}
    by_doc, seqs = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for k, parts in seqs.items():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and (sum(n for _, n in parts) == 1024 or k == max(seqs))


def test_pipeline_edges(spark, docs, empty):
    """Nulls, repeated rows, clashing names, other columns, no rows: no stage fails, and the columns stay."""
    import corpus_pipeline

    for some in (docs, empty):
        at = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == some.columns, name
            at = spark.createDataFrame(at.collect(), at.schema) if name == "line_dedup" else at
        corpus_pipeline.pack(spark, at, SF).collect()
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).collect()


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def dropped_brute(rows):
    """Of (id, text): the ids that are not the least of their class, by all pairs' Jaccard similarity."""
    sets, least = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and (a := find(i)) != (b := find(j)):
                least[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) != i}


def test_near_copies_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert {r.doc_id for r in simhash.near_copies(docs).collect() if not r.keep} == dropped_brute([(r.doc_id, r.text) for r in docs.collect()])


def family(rng, base, n, edits, name):
    """Copies of a text with some words changed."""
    out = []
    for i in range(n):
        text = base.copy()
        for p in rng.choice(len(base), edits, replace=False):
            text[p] = f"{name}n{i}p{p}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("options", [{}, {"direct": 0}, {"block": 4}])
def test_near_copies_of_families(spark, options):
    """Edited copies with and without the text they come from, passages that many texts share, copies of parts, in any order."""
    rng = np.random.default_rng(5)
    texts = []
    for k, (edits, whole) in enumerate([(2, True), (2, False), (1, False), (3, True), (4, False)]):
        base = [f"b{k}w{i}" for i in range(120)]
        texts += family(rng, base, 14, edits, f"f{k}") + [" ".join(base)] * whole + [" ".join(base[: 90 + 5 * i]) for i in range(5)]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join([*(f"o{i}x{j}" for j in range(i % 30)), *passage]) for i in range(60)]
    texts += ["", " ", "A b", "a B", "a b c d e", "a b c d e f", "same same same same same same same"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.near_copies(docs, **options).collect() if not r.keep} == dropped_brute(rows)


def test_near_copies_sharing_a_passage_cost_no_pairs(spark):
    """4000 texts of 60 words and a passage of 200 that all share: their own words come first, so no bucket holds two of them."""
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, " ".join(f"o{i}x{j}" for j in range(60)) + " " + passage) for i in range(4000)]
    flat = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = setjoin.prefixes(flat, words=5, similarity=0.8, total=4000 * 256)
    assert found.groupBy("t").count().filter("count > 1").count() == 0
    assert simhash.near_copies(flat).filter("not keep").count() == 0


def test_near_copies_edges(spark, docs, empty):
    got = {r.doc_id: r.keep for r in simhash.near_copies(docs).collect()}
    assert got == {i: i not in (1, 8, 9) for i in range(len(TEXTS))}
    assert simhash.near_copies(empty).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.collect()) == sorted([*(str(i) for i, k in got.items() if k), "3", "None"])


def test_near_copies_try_every_member_of_a_class(spark):
    """Each last text has one member of a class of 41 at 0.818, all others of it at 0.778."""
    rng, rows = np.random.default_rng(1), []
    for k in range(6):
        words = [f"f{k}w{i}" for i in range(404)]
        places = rng.permutation(np.arange(4, 400, 6)).tolist()
        for i in range(42):
            changed = places[:8] if i == 41 else [] if i == 20 else rng.choice(places[8:], 2, replace=False)
            text = words.copy()
            for p in changed:
                text[p] = f"f{k}n{i}p{p}"
            rows.append((k * 100 + i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.near_copies(docs).collect() if r.keep} == {k * 100 for k in range(6)}


def test_near_copies_of_short_texts(spark):
    """4 of 5 shingles in common: a text and the same with one more word; all are found."""
    rows = [(2 * i + j, " ".join(f"t{i}w{k}" for k in range(8 + j))) for i in range(300) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in simhash.near_copies(docs).collect() if not r.keep} == {2 * i + 1 for i in range(300)}


def test_url_filter_edges(spark):
    rows = [(1, "http://example.com/en/1", "x"), (1, "http://example.com/en/1", "x"), (None, None, "x"), (2, "http://h/" + "a" * 100_000, "x"), (3, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, URL string")
    shares = url_filter.suffix_shares(pages)
    assert shares == {"com": 0.4, "": 0.4, "h": 0.2} and url_filter.suffix_shares(pages.limit(0)) == {}
    model = url_filter.train(*url_filter.labelled_by_rules(pages, URL_RULES), shares)
    got = url_filter.judge(pages, URL_RULES, model).collect()
    assert len(got) == 5 and sum(r.rule == "com/en/" for r in got) == 2 and {len(r.path) for r in got if r.page_id == 2} == {100_001}
    assert url_filter.judge(pages.limit(0), URL_RULES, model).count() == 0 and url_filter.labelled_by_rules(pages.limit(0), URL_RULES) == ([], [])


def test_url_filter_over_whole_table(spark):
    """Host, path and rule by plain search through all rules; verdicts of the trees on URLs they weren't trained on."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").repartition(4)

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        ends = [rest.index(c) for c in "/?#" if c in rest]
        host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
        path = tail.split("?")[0].split("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return host, path, max(fits, key=lambda r: len(r.text), default=None)

    rows = QUERIES["op7_url_filter"](spark, "/root/testdata/sf0.1").collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text) and r.verdict == (rule.verdict if rule else "block" if r.score >= 0.5 else "allow")
    labelled = sorted((u, int(brute(u)[2].verdict == "block")) for u in set(urls.values()) if brute(u)[2])
    train, held = labelled[::2], labelled[1::2]
    model = url_filter.train([u for u, _ in train], [y for _, y in train])
    score, y = model.score(url_filter.features([u for u, _ in held], model.suffixes)), np.array([y for _, y in held])
    rank = np.argsort(np.argsort(score)) + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    print(f"AUC of the trees on {len(y)} held-out URLs: {auc:.4f}, balanced accuracy {((score >= 0.5)[y == 1].mean() + (score < 0.5)[y == 0].mean()) / 2:.4f}")
    assert auc >= 0.75  # the rules look at path numbers, which the features do not


def test_url_sample_holds_distinct_urls(spark):
    """Each URL 30 times: a sample of 40 holds 40 different ones."""
    rows = [(f"http://example.{'com/en' if i % 2 else 'net/de'}/{i}",) for i in range(100)] * 30
    pages = spark.createDataFrame(rows, "url string").repartition(3)
    urls, labels = url_filter.labelled_by_rules(pages, URL_RULES, rows=40)
    assert len(urls) == len(labels) == len(set(urls)) == 40
    every, _ = url_filter.labelled_by_rules(pages, URL_RULES)
    assert urls == every[:40]
