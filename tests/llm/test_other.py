"""Quality, extraction, media, mixing, search."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import html_extract, media, mixing, quality, vector_search
from loomlog.llm.queries import OP9_SQL, OP10_SQL

# -- quality


def test_em_finds_the_reliable():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    vote = lambda right: np.where(rng.random(4000) < right, np.where(truth, 1, -1), np.where(truth, -1, 1)) * (rng.random(4000) < 0.8)
    votes = np.column_stack([vote(0.95), vote(0.9), vote(0.85), vote(0.55)])
    for silent in (True, False):
        p, accuracy, prior = quality.expectation_maximisation(votes, silent)
        assert ((p > 0.5) == truth).mean() > 0.93 and abs(prior - 0.2) < 0.05
        assert accuracy[0] > accuracy[3]
    # labellers that agree overrule a fifth of wrong votes by the last one, whoever that is
    given = np.where(truth, 1, -1) * np.where(rng.random(4000) < 0.8, 1, -1)
    p, accuracy, _ = quality.expectation_maximisation(np.column_stack([vote(0.97), vote(0.97), vote(0.97), given]))
    wrong = (given == 1) != truth
    assert ((p > 0.5) == truth)[wrong].mean() > 0.85 and abs(accuracy[3] - 0.8) < 0.03


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs.where("doc_id < 6000"), labels


def test_held_out_accuracy(corpus):
    """Fits on half of the labels, measures on the other."""
    docs, labels = corpus
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"), sample_rows=3000)
    held = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    bad = (held["quality"] == 0) | (held["toxic"] == 1)
    caught, clean = (~held["keep"])[bad].mean(), held["keep"][~bad].mean()
    assert len(held) > 500 and caught > 0.9 and clean > 0.97, (caught, clean)


def test_wrong_annotations_are_overruled(corpus, monkeypatch):
    """One annotation in twenty says the opposite: the posteriors that train the junk scorer correct nearly all of them.
    (Heuristics for toxicity only ever vote for it, so there annotations stand.)"""
    docs, labels = corpus
    flip = F.xxhash64("doc_id") % 20 == 0
    wrong = labels.select("doc_id", F.when(flip, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), F.when(flip, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    seen, model = [], quality.expectation_maximisation
    monkeypatch.setattr(quality, "expectation_maximisation", lambda votes, *how: seen.append((votes, model(votes, *how))) or seen[-1][1])
    right, noisy = quality.fit(docs, labels, sample_rows=3000), quality.fit(docs, wrong, sample_rows=3000)
    assert right.junk[0].any() and noisy.junk[0].any()
    (true, _), (given, (p, accuracy, _)) = seen[0], seen[2]
    changed = true[:, -1] * given[:, -1] < 0
    assert changed.sum() > 20 and ((p > 0.5) == (true[:, -1] == 1))[changed].mean() > 0.8 and 0.9 < accuracy[-1] < 0.98


def test_quality_edges(spark, corpus):
    rows = [(None, "fine words"), (1, None), (1, None), (2, ""), (3, "x " * 20000)]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id long, text string, keep int, junk_score double")
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(not r["keep"] for r in got if r["doc_id"] in (1, 2))
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == 5
    assert quality.filtered(docs, labels).columns == docs.columns


# -- html


PAGE = "<html><head><title>t</title><script>if (a<b) {{}}</script></head><body><nav><ul>{menu}</ul></nav>{extra}<article><h1>{h}</h1>{body}</article><footer>f</footer></body></html>"


def page(i, paragraphs, extra="", menu=3):
    return PAGE.format(menu="".join(f"<li><a href='/{i}{k}'>m{k}</a></li>" for k in range(menu)), h=f"Title {i} &amp; more", body="".join(f"<p>{p}</p>" for p in paragraphs), extra=extra)


def test_extraction(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        own = [f"text {i} {k}   <b>bold</b>\n&lt;x&gt;" for k in range(rng.randint(1, 6))]
        rows.append((i, f"http://h{i % 3}.org/p{i}", page(i, own, rng.choice(["", "<div class='ad'>buy</div>", "<aside><p>side</p></aside>"]), rng.randint(1, 5)), "c"))
        want[i] = "\n".join([f"Title {i} & more", *(f"text {i} {k} bold <x>" for k in range(len(own)))])
    rows += [(90, None, None, "c"), (91, "nonsense", "", "c"), (92, "http://h0.org/", "<p>open <i>text<div class=comments>no</div><p>more", "c"), (93, "http://h0.org/", "plain", "c"), (93, "http://h0.org/", "plain", "c")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 45 and {i: by[i]["text"] for i in want} == want and all(by[i]["by_wrapper"] for i in want)
    assert by[90]["text"] == "" and by[90]["n_chars"] == 0 and by[91]["text"] == "" and by[92]["text"] == "open text\nmore" and by[93]["text"] == "plain"


def test_folding_and_alignment():
    assert html_extract.fold(list("apqpqpqb")) == ["a", ["+", ["p", "q"]], "b"]
    assert html_extract.fold(list("rppprpp")) == [["+", ["r", ["+", ["p"]]]]]
    w = html_extract.aligned(["a", "b", "c"], ["a", "c"])
    assert w == ["a", ["?", ["b"]], "c"]
    many = html_extract.aligned(html_extract.fold(["a", "#", "/a"] * 3), ["a", "#", "/a"])
    wrapper = html_extract.Wrapper(many)
    assert all(wrapper.content(["a", "#", "/a"] * n) is not None for n in (1, 2, 5))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<main><p>a</p><form><p>f</p></form></main><p>out</p>", "a"), ("<article><header><h1>T</h1></header>x<section class='comments-list'><article>c</article></section></article>", "T\nx"),
        ("<article>a<!-- <p>b</p> -->c&nbsp;&eacute;</article>", "ac é"), ("<article><p>1 > 0<p title='a>b'>z</article>", "1 > 0\nz"), ("<div hidden>h</div><p>v", "v"), ("<style>p{}</style><noscript>n</noscript>t", "t"),
    ],
)
def test_rules(source, text):
    assert html_extract.extract(source, None)[0] == text


# -- media


def test_a_failure_is_told_and_time_decides_nothing():
    expression = [["+", [["?", ["p", "#", "/p"]], ["*", ["div", "#", "/div"]]]], ["?", ["nav", "#", "/nav"]], ["+", ["p", ["?", ["#"]], "/p"]]]
    wrapper, rng = html_extract.Wrapper(expression), random.Random(3)
    matched = 0
    for _ in range(300):
        symbols = [s for _ in range(rng.randint(0, 7)) for s in rng.choice((["p", "#", "/p"], ["p", "/p"], ["div", "#", "/div"], ["nav", "#", "/nav"]))]
        want = wrapper.content(symbols, 60)
        assert wrapper.content_by_steps(symbols) == want
        matched += want is not None
    assert 20 < matched < 280
    hard = html_extract.Wrapper([["+", [["+", ["p"]], ["?", ["p"]]]], "#"])  # a backtracking matcher has no end with it
    assert hard.content(["p"] * 60 + ["#"]) == {60} and hard.content(["p"] * 60) is None
    page = "<p>one</p><div>two</div>"
    assert html_extract.extracted(page)[1] == "no wrapper"
    assert html_extract.extracted(page, {"": json.dumps(["p", "#", "/p"])}) == ("one\ntwo", "no match")
    assert html_extract.extracted(page, {"": json.dumps(html_extract.structure(page))}) == ("one\ntwo", None)


def test_media(spark, tmp_path):
    rows = [(1, "é" * 400), (2, ""), (None, None), (3, "x" * 576), (3, "x" * 576), (4, "y" * 100_000)]
    docs = spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary")
    got = media.round_trip(docs).collect()
    assert len(got) == 6
    for r in got:
        text = next((t for k, t in rows if k == r["doc_id"]), None) or ""
        payload = media.padded(text.encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest()
    assert media.round_trip(docs.limit(0)).count() == 0
    media.write(docs, uri := f"file://{tmp_path}/arc")
    small = media.read(spark, uri, range_bytes=100, batch_bytes=1)
    assert small.rdd.getNumPartitions() > 4 and small.count() == 6 and small.select("media").distinct().count() == 4


def test_damage_is_seen(spark, tmp_path):
    media.write(spark.createDataFrame([(i, "z" * 2000) for i in range(3)], "doc_id long, text string").coalesce(1), f"file://{tmp_path}/arc")
    archive = next((tmp_path / "arc").glob("*.arc"))
    raw = bytearray(archive.read_bytes())
    raw[media.MEMBER.size + 5] ^= 1
    archive.write_bytes(raw)
    reader = media.ArchiveReader(f"file://{tmp_path}/arc", 1 << 20, 1 << 20)
    reader.TRIES = 2
    with pytest.raises(OSError, match="damaged member"):
        list(reader.read(reader.partitions()[0]))


def test_a_member_is_tried_again(spark, tmp_path, monkeypatch):
    media.write(spark.createDataFrame([(i, str(i)) for i in range(5)], "doc_id long, text string").coalesce(1), f"file://{tmp_path}/arc")
    reader, failed, real = media.ArchiveReader(f"file://{tmp_path}/arc", 1 << 20, 1 << 20), [], media.ArchiveReader.member

    def flaky(f, offset):
        if offset not in failed:
            failed.append(offset)
            raise OSError("lost")
        return real(f, offset)

    monkeypatch.setattr(media.ArchiveReader, "member", staticmethod(flaky))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 5 and len(failed) == 5


# -- mixing


def duck(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.sql(sql).df()


def test_mixing_against_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, "a b", None, None, 0), (5, None, None, "src1", 0), (5, "", None, "zero", 0), (7, "x " * 3000, None, None, 0), (7, "x " * 3000, None, None, 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("size", F.lit("clash"))
    got = mixing.digest(docs).toPandas()
    want = duck(OP9_SQL, documents=docs.drop("size").toArrow())
    key = ["doc_id", "size", "taken"]
    rows = [df[[*key, "source_size"]].fillna(-1).astype("int64").sort_values([*key, "source_size"]).values.tolist() for df in (got, want)]
    assert rows[0] == rows[1]
    assert np.allclose(got.groupby("source_size")["target"].first(), want.groupby("source_size")["target"].first())
    by = got.groupby(["source_size", "target"])["taken"].sum().reset_index()
    assert (got["taken"] <= 3 * got["size"]).all() and abs(by["taken"].sum() / by["target"].sum() - 1) < 0.05
    assert mixing.digest(docs.limit(0)).count() == 0
    assert mixing.digest(docs).toPandas().equals(got)


def test_water_filling(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 100), (None, 50), ("d", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = ["a", "b", "c", "d", None]
    weight, size = {s: i % 3 + 1 for i, s in enumerate(order)}, dict(sizes)
    capped = set()
    while True:  # reshare until none is above
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        want = {s: 3.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and want[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx(want)


def test_curriculum_positions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = mixing.training_order(mixing.plan(docs)).toPandas()
    assert order["position"].is_monotonic_increasing and order["position"].between(0, 1).all()
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(order)


# -- search


def test_search_against_sql(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(40)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [1.0] * 5), (450, [0.5] * 5)]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<float>, rank int")
    ids = frame.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    for block in (16, 4096):
        got = vector_search.top_k(ids, ids.where("id % 50 = 0"), block_rows=block).toPandas()
        want = duck(OP10_SQL, embeddings=frame.toPandas())
        key = ["query_id", "rank", "vec_id", "score"]
        assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()
    assert vector_search.top_k(ids.limit(0), ids.limit(0)).count() == 0


def test_queries_are_not_sent_to_every_block(spark, monkeypatch):
    """Query blocks go to as many parts as there are candidates for each query, not to each candidate block, and are
    never broadcast; chunks, ties, repeated ids and scores beyond whole doubles change nothing."""
    rng = np.random.default_rng(5)
    vectors = [(i % 1900, np.round(rng.normal(size=4), 1).astype(float).tolist()) for i in range(2000)]
    vectors += [(3000 + i, [0.5] * 4) for i in range(60)] + [(4000 + i, [float(rng.integers(-(2**20), 2**20))] * 4) for i in range(50)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    ids = frame.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    want = duck(OP10_SQL, embeddings=frame.toPandas())
    key = ["query_id", "rank", "vec_id", "score"]
    plans = []
    for held in (1, 1 << 26):
        monkeypatch.setattr(vector_search, "HELD", held)
        monkeypatch.setattr(vector_search, "MERGED", 50)
        out = vector_search.top_k(ids, ids.where("id % 50 = 0"), block_rows=16)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        got = out.toPandas()
        assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()
    assert not any("Join" in p for p in plans)
    one = vector_search.Best(np.array([7]), np.array([[2.0**40, 1.0]]), 2)
    x = np.array([[2.0**40, 3.0], [2.0**40, 5.0], [-(2.0**40), 1.0], [2.0**40, 3.0]])
    import pandas as pd

    row = vector_search.pack(pd.DataFrame({"id": [1, 2, 3, 0], "vector": list(x)}), 1.0)
    shaped = lambda k, kind=np.float64: np.frombuffer(row[k], kind)
    one.meet(shaped("ids", np.int64), x, shaped("cells", np.uint8).reshape(-1, 2), shaped("least"), shaped("width"))
    assert one.score.tolist() == [2**63 - 1] * 2 and one.id.tolist() == [0, 1]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    import pandas as pd

    x = rng.normal(size=(200, 16)) * 50
    row = vector_search.pack(pd.DataFrame({"id": range(200), "vector": list(x)}), 256.0)
    shaped = lambda k, kind=np.float64: np.frombuffer(row[k], kind).reshape(-1, 16)
    vectors, cells, least, width = shaped("vectors"), shaped("cells", np.uint8), shaped("least")[0], shaped("width")[0]
    low = least + cells * width
    assert (vectors >= low).all() and (vectors <= low + width - 1).all()
