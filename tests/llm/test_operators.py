"""Each operator against plain Python, held-out labels or an exact round trip."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from globeframe.llm import chat_format, decontaminate, html_extract, labelled_pages, language_id, packing, token_counts, topk_search, toxicity
from globeframe.llm._store import Scratch, table

from . import brute

TABLES, MORE, MOST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "", " ", "\n\n\t ", "ÀÉ 漢字 \U0001f600 é", "don't I'LL we've", "1234567 89", "a" * 3000, "\x00\x01 �", "<|startoftext|> <|endoftex"]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers(spark):
    t, encode = tokenizer(), packing.encoder()
    draw = random.Random(3)
    alphabet = "abcXYZ 019 \n\t'.,-_é漢́\U0001f600<|>"
    texts = ODD + ["".join(draw.choices(alphabet, k=draw.randrange(80))) for _ in range(500)]
    texts += [r.text or "" for r in table(spark, TABLES, "documents").collect()]
    for text in texts:
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids


def test_packing_pieces(spark):
    t, draw = tokenizer(), random.Random(4)
    texts = {k: x for k, x in enumerate(ODD + [None])}
    texts |= {100 + k: " ".join(draw.choices(["alpha", "beta", "gamma"], k=draw.randrange(1, 1500))) for k in range(150)}
    texts[400] = " ".join(draw.choices(["delta", "eps"], k=9000))
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want, total = set(), 0
    for doc, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            want.add((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
        assert sum(n for _, n in parts) <= 2048
    assert len(places) <= -(-total // 2048) * 1.03 + 1


def test_token_rollup(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, deleted boolean"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    batches = [
        [(1, "a", "en", "v", 10, False), (2, "a", None, "v", 5, False), (None, "a", "en", "v", 7, False), (None, "a", "en", "v", 7, False), (3, "b", "en", "v", 1, False), (3, "b", "en", "v", 4, False)],
        [(1, "b", "en", "v", 11, False), (2, "a", None, "v", 5, True), (9, "a", "en", "v", 3, True), (None, "a", "en", "v", 1, True)],
        [(2, "a", "de", "v", 6, False), (1, "b", "en", "w", 2, False)],
    ]
    want = [
        {("a", "en", "v"): (3, 24), ("a", None, "v"): (1, 5), ("b", "en", "v"): (1, 4)},
        {("a", "en", "v"): (2, 14), ("b", "en", "v"): (2, 15)},
        {("a", "en", "v"): (2, 14), ("b", "en", "v"): (2, 15), ("a", "de", "v"): (1, 6), ("b", "en", "w"): (1, 2)},
    ]
    totals = lambda r: {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert totals(rollup) == {}
    for k, rows in enumerate(batches):
        for _ in range(2):  # a batch committed again changes nothing
            rollup.commit(k, frame(rows))
            assert totals(rollup) == want[k]
        if k == 1:
            rollup.compact(1)
    again = token_counts.Rollup(spark, rollup.root)  # a new driver
    assert again.batches() == [0, 1, 2] and totals(again) == want[2]
    again.commit(3, frame([]))
    assert totals(again) == want[2]


def test_token_counts_query(spark):
    t = tokenizer()
    docs = {r.doc_id: r for r in table(spark, TABLES, "documents").collect()}
    labels = table(spark, TABLES, "labels").collect()
    toxic, poor = ({r.doc_id for r in labels if ok(r)} for ok in (lambda r: r.toxic == 1, lambda r: r.quality == 0))
    want = {}
    for doc, r in docs.items():
        if doc in toxic:
            continue
        text = r.text or ""
        if doc in poor:
            text = " ".join(x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", text) if x)
        for version, n in (("byte_bpe_50k", len(t.encode(text, add_special_tokens=False).ids)), ("words_1", len(brute.words(text)))):
            k = (r.source, r.lang, version)
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_counts.op3_token_counts(spark, TABLES).collect()}
    assert got == want


def test_chat_round_trip(spark):
    draw, t = random.Random(6), chat_format.Template()
    parts = [*t.controls(), "\\", "\\\\", "<", "s>", "[", "INST]", "|", "> ", " ", "x", "é", "\n", "<s", "</s", "<<SYS>", "[ANS"]
    roles = ["system", "user", "assistant", "tool", "", "a|", "<s>", None]
    chats = {c: [(draw.choice(roles), draw.choice([None, "".join(draw.choices(parts, k=draw.randrange(9)))])) for _ in range(draw.randrange(1, 6))] for c in range(200)}
    rows = [(c, k, role, text) for c, turns in chats.items() for k, (role, text) in enumerate(turns)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = out.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()
    assert len(out) == len(chats)
    for r in out:
        turns = [(a or "", b or "") for a, b in chats[r.conv_id]]
        assert [(x.role, x.text) for x in r.turns] == turns
        assert len([s for s in r.segments if s.loss]) == sum(a == "assistant" for a, _ in turns)
        state = ""
        for a, _ in turns:
            state = a if state is not None and (state, a) in t.transitions else None
        assert r.valid == (state in t.final)


def test_html_on_held_out_pages():
    field = html_extract.default_field()
    hit = wrong = missed = 0
    for page, labels in labelled_pages.draw(150, seed=77):
        blocks = html_extract.leaves(page, field.known)
        if len(blocks) != len(labels):
            continue
        for b, y, guess in zip(blocks, labels, field.decode(html_extract.features(blocks))):
            hit += y and guess
            wrong += guess and not y
            missed += y and not guess
    assert 2 * hit / (2 * hit + wrong + missed) > 0.97


def test_html_is_linear_in_nesting():
    field = html_extract.default_field()
    for page in ("<div>x" * 20000, "".join(f"<div class=c{k}>x" for k in range(20000)), "<!" * 50000, "<b> </b>" * 20000, "<p><b>x" * 10000 + "</q>" * 10000):
        start = time.perf_counter()
        html_extract.main_text(page, field)
        assert time.perf_counter() - start < 10


def test_html_small_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>Plain text that is an article on its own, with a few words."), (4, "u", "<script>x()</script><!-- open"), (4, "u", "&lt;b&gt; &amp; caf&eacute;")]
    out = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 5
    assert [r.text for r in out[:2]] == ["", ""] and all(r.n_chars == len(r.text) for r in out)
    assert "<p>" not in out[2].text and "x()" not in out[3].text


def test_toxicity_on_held_out_labels(spark):
    # Some labels are noise, and half of the smaller tables' rows are few to learn from.
    docs, labels = table(spark, MOST, "documents"), table(spark, MOST, "labels")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = toxicity.train(docs, labels.filter(part == 0))
    out = toxicity.scored(docs, model).join(labels.filter(part == 1), "doc_id").select("toxic", "rejected", "grade", "severity").collect()
    assert len(out) > 100
    assert sum(r.rejected == (r.toxic == 1) for r in out) >= 0.97 * len(out)
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in out)
    assert min(r.severity for r in out if r.rejected) >= 0.5


def test_language_on_held_out_documents(spark):
    out = language_id.op7_language_id(spark, MORE).join(table(spark, MORE, "documents").select("doc_id", "lang", "text"), "doc_id")
    rows = out.filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_language_mixture(spark):
    docs = table(spark, MORE, "documents").filter("lang IS NOT NULL")
    model = language_id.train(docs)
    by = {}
    for r in docs.select("lang", "text").collect():
        if r.text and len(r.text) > 2000:
            by.setdefault(r.lang, r.text[:2000])
    (a, x), (b, y), *_ = sorted(by.items())
    row = language_id.predicted(spark.createDataFrame([(1, f"{x} {y}")], "doc_id long, text string"), model).first()
    assert row.proportions[a] > 0.3 and row.proportions[b] > 0.3


def test_short_and_long_items(spark):
    items = {1: "two words", 2: "Alone!", 3: "the quick brown fox jumps over the lazy dog", 4: "", 5: None, 6: "two words", 7: "one two three four five"}
    texts = {
        1: "here are Two, words inside a longer document of many words",
        2: "two and words",
        3: "alone",
        4: "left alone in a long document that has more than five words",
        5: "prefix the quick brown fox jumps over the lazy cat suffix",
        6: "prefix the quick brown fox jumps over the lazy dog suffix",
        7: None,
        8: "",
        9: "one two three four",
        10: "zero one two three four five six",
    }
    frame = lambda d, k: spark.createDataFrame(list(d.items()), f"{k} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(texts, "doc_id"), frame(items, "item_id")).collect()}
    assert got == brute.held(texts, items)
    assert {(1, 1), (1, 6), (4, 2), (6, 3)} <= got and (5, 3) in got
    kept = {r.doc_id for r in decontaminate.clean(frame(texts, "doc_id"), frame(items, "item_id")).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def knn_brute(data, queries, k):
    out = set()
    for q, v in queries:
        best = sorted((-sum(a * b for a, b in zip(v, x)), i) for i, x in data if i != q)[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


def test_top_k_with_odd_vectors(spark):
    draw = random.Random(8)
    rows = [(k, [draw.randrange(-50, 50) / 64 for _ in range(4)]) for k in range(60)]
    usable = [*rows, (7, [0.5, 0.5, 0.5, 0.5]), (7, [0.9, 0.9, 0.9, 0.9]), (20, rows[20][1])]
    odd = [(70, [1.0, 2.0, 3.0]), (71, None), (72, [1.0, None, 1.0, 1.0]), (73, [float("nan"), 1.0, 1.0, 1.0]), (74, [float("inf"), 1.0, 1.0, 1.0]), (75, []), (-3, [9.0] * 9), (None, [1.0, 1.0, 1.0, 1.0])]
    data = topk_search.quantised(spark.createDataFrame(usable + odd, "vec_id long, embedding array<double>"))
    got = topk_search.knn_join(data, data.filter("vec_id % 10 = 0"), 5)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in usable]
    want = knn_brute(whole, [r for r in whole if r[0] % 10 == 0 and r[0] != 20] + [whole[20]], 5)
    found = [tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()]
    assert {r for r in found if r[0] != 20} == {r for r in want if r[0] != 20}
    assert topk_search.knn_join(data.limit(0), data.limit(0), 5).count() == 0
    few = data.filter("vec_id IN (10, 11, 12)")
    assert few.count() == 3 and topk_search.knn_join(few, few.filter("vec_id = 10"), 5).count() == 2


def test_bounds_prune_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 8
    rows = [(k, (centres[k % 20] + rng.normal(size=8) * 0.05).tolist()) for k in range(4000)]
    data = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).cache()
    queries = data.filter("vec_id % 50 = 0")
    got = topk_search.knn_join(data, queries, 5, n_pivots=64, block=10)
    # Every group is needed by few of the eight blocks.
    sent = topk_search.routes(data, queries, 5, n_pivots=64, block=10)
    assert sent["rows_sent"] < 0.5 * sent["blocks"] * 4000
    whole = [(i, np.floor(256 * np.array(v)).astype(int).tolist()) for i, v in rows]
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == knn_brute(whole, [r for r in whole if r[0] % 50 == 0], 5)


def test_pipeline_stages(spark):
    docs, benchmark = table(spark, TABLES, "documents"), table(spark, TABLES, "benchmark")
    stages, scratch, kept = dict(corpus_pipeline.STAGES), Scratch(spark, "test"), {}
    assert list(stages) == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = scratch.save(stage(spark, now, TABLES))
        assert now.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in now.collect()}
        assert len(kept[name]) == now.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in table(spark, TABLES, "labels").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in table(spark, TABLES, "labels").filter("toxic = 0").collect()}
    assert len(toxic & set(kept["toxicity"])) <= 0.05 * len(toxic) and len(clean & set(kept["toxicity"])) >= 0.98 * len(clean)
    near = brute.components(kept["toxicity"], 5)
    assert kept["near_duplicates"] == {d: texts[d] for d in near if near[d] == d}
    want = {}
    for doc, (raw, gone) in brute.cut(kept["near_duplicates"]).items():
        want[doc] = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
    assert {d: t or "" for d, t in kept["suffix_dedup"].items()} == want
    items = {r.item_id: r.text for r in benchmark.collect()}
    bad = {d for d, _ in brute.held(kept["suffix_dedup"], items)}
    assert kept["decontamination"] == {d: t for d, t in kept["suffix_dedup"].items() if d not in bad}
    packed = stages["packing"](spark, now, TABLES).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])


CLASHES = ["batch", "_batch", "__batch", "nth", "_nth", "__nth", "hash", "doc", "key", "root", "a", "b"]


@pytest.fixture(scope="module")
def messy(spark):
    """Documents with nulls everywhere, repeats, a long text and columns of clashing names."""
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (2, ""), (None, None), (None, "no id " * 30), (3, " \t\n"), (4, "long word " * 60000), (5, "ONE two three four five six"), (6, "x")]
    extra = ", ".join(f"{c} long" for c in CLASHES)
    data = [(*r, None, None, None, {"k": "v"}, *[k] * len(CLASHES)) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, props map<string,string>, {extra}")


@pytest.mark.parametrize("empty", [False, True])
def test_messy_tables(spark, messy, empty):
    from globeframe.llm import near_duplicates, suffix_dedup

    docs = messy.limit(0) if empty else messy
    n = docs.count()
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (5, 0, None), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, "x"), (3, ""), (4, "x")], "item_id long, text string")
    assert packing.pack(docs).select("doc_id").distinct().count() == (0 if empty else 7)
    assert suffix_dedup.digests(docs).count() == n
    cut = suffix_dedup.deduplicated(docs)
    assert cut.count() == n and sorted(cut.columns) == sorted(docs.columns)
    assert [f.dataType for f in cut.schema] == [f.dataType for f in docs.schema]
    assert near_duplicates.near_duplicates(docs, 4).count() == n
    once = near_duplicates.deduplicated(docs, 4)
    assert once.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in once.collect()) == ([] if empty else [0, 0, 1, 2, 3, 4, 6])
    model = toxicity.train(docs, labels)
    assert toxicity.scored(docs, model).count() == n
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert language_id.predicted(docs, language_id.train(docs)).filter("lang_pred = 'und'").count() == n
    found = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == (set() if empty else {(6, 4)})
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items).count() == (0 if empty else n - 1)
    counts = token_counts.counted(docs, ("words_1",))
    assert counts.count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "hash", "key")
    assert html_extract.extracted(pages).count() == n
    chats = docs.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", "key", "root")
    assert chat_format.format_chats(chats).count() == (0 if empty else 7)
