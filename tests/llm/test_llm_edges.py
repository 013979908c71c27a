"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import bpe, components, exact_dedup, jaccard, langid, mixing, quality, repeats, sharding, suffix, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, _text string"
FEW = "doc_id long, text string, source string, kept string"


def docs(spark, rows, schema=FEW):
    return spark.createDataFrame([(*row, *[None] * (len(schema.split(",")) - len(row))) for row in rows], schema)


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Suffix arrays and repeats --------------------------------------------------------------------


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(rng.choice([b"ab", b"abc\0", b"a"])) for _ in range(rng.randint(0, 60)))
        text = np.frombuffer(data, np.uint8)
        order, rank = suffix.suffix_array(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = suffix.common_prefixes(text, order, rank, 7)
        for slot in range(1, len(data)):
            a, b = data[order[slot - 1] :], data[order[slot] :]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert shared[slot] == min(n, 7)


def brute(texts, length):
    from test_llm_queries import covered

    return [bytes(b for b, f in zip(t, flags) if not f) for t, flags in zip(texts, covered(texts, length))]


def test_repeats_of_all_kinds(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts += [texts[0], f"{word()} {passage} {word()}", f"{passage}{texts[1]}", "ab " * 200, passage[:100], "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, passage)]
    got = repeats.cut_repeats(docs(spark, rows), length=64).collect()
    raw = [(t or "").encode() for _, t in rows]
    want = sorted(zip([(i is None, i) for i, _ in rows], map(len, raw), brute(raw, 64)))
    assert sorted(((r.doc_id is None, r.doc_id), r.n_bytes, bytes(r.kept)) for r in got) == want


def test_an_anchor_that_spans_shards(spark, monkeypatch):
    """Many contexts of one line: shards of a few hundred bytes must give what one shard gives."""
    rng = random.Random(1)
    line = "the same line in every document, long enough for an anchor of its own"
    texts = ["".join(rng.choice("xyz") for _ in range(30)) + line + rng.choice(["p", "q"]) * 5 for _ in range(40)]
    rows = []
    offsets = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    for document, anchor, mark, place, n in repeats.pieces(offsets, data, 40):
        rows += [(int(d), 0, int(a), False, int(p), texts[d].encode()[p : p + k + 39]) for d, a, p, k in zip(document, anchor, place, n)]
    rows.sort(key=lambda r: (r[2], r[0], r[4]))
    whole = sorted(repeats.judge_stream(iter(rows), 40))
    monkeypatch.setattr(repeats, "SHARD", 400)
    assert sorted(repeats.judge_stream(iter(rows), 40)) == whole and whole


def test_a_crowded_anchor_is_dealt_over_tasks(spark, monkeypatch):
    """Many contexts of one line, some of them shared: dealt by salts the result is the same, and no anchor is left whole."""
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "CROWD", 8)
    settled, settle = {}, repeats.settle
    monkeypatch.setattr(repeats, "settle", lambda df, name: settled.setdefault(name, settle(df, name)))
    rng = random.Random(9)
    line = "One line of a licence, which is the same line in every document."
    around = lambda: "".join(rng.choice("xyz ") for _ in range(rng.randint(20, 60)))
    ends = [around() for _ in range(6)]
    texts = [around() + line + (rng.choice(ends) if i % 3 else around()) for i in range(300)]
    texts += [texts[0], texts[1][:90], ""]
    got = repeats.cut_repeats(docs(spark, list(enumerate(texts))).repartition(4), length=64).collect()
    raw = [t.encode() for t in texts]
    assert [bytes(r.kept) for r in sorted(got, key=lambda r: r.doc_id)] == brute(raw, 64)
    pieces = settled["pieces"].where("_first AND _several").groupBy("_anchor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_deal").alias("units"))
    crowded = pieces.orderBy(F.desc("n")).first()
    assert crowded.n > 100 and crowded.units > 20
    assert "judged" in settled


def test_repeats_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 300)
    text = bytes(random.Random(2).choice(b"abcd") for _ in range(900))
    data = np.frombuffer(text + text[100:700], np.uint8)
    found = sum(int(n.sum()) for *_, n in repeats.pieces(np.array([0, 900, 1500]), data, 64))
    assert found == (900 - 63) + (600 - 63)


# Sharding, exact dedup, mixing ----------------------------------------------------------------


def test_sharding_of_repeated_rows(spark):
    rows = [(1, "a")] * 50 + [(None, None)] * 3 + [(i, "x") for i in range(100, 140)]
    got = sharding.scatter(docs(spark, rows), "doc_id", 4, seed=3, bucket_rows=5).collect()
    assert len(got) == len(rows)
    for shard in range(4):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    with pytest.raises(ValueError):
        sharding.scatter(docs(spark, [(1, "a")]).withColumnRenamed("kept", "slot"))
    assert sharding.scatter(docs(spark, []), "doc_id").count() == 0


def test_written_shards_hold_all_records(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(100)]
    sharding.write_shards(docs(spark, rows), str(tmp_path / "out"), shards=3, bucket_rows=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in back.collect()) == sorted(t for _, t in rows)


def test_buckets_are_cut_by_bytes(spark):
    rows = [(0, i % 2, i, 1, 30_000 if i % 10 < 2 else 10) for i in range(200)]
    placed = spark.createDataFrame(rows, "shard int, _bucket long, _h long, _copy long, _size long")
    parts = sharding.cut_buckets(placed, 50_000).groupBy("_bucket", "_part")
    held = parts.agg(F.sum("_size").alias("n"), F.max_by("_size", "_h").alias("last")).collect()
    assert sum(r.n for r in held) == sum(r[-1] for r in rows) and max(r.n - r["last"] for r in held) <= 50_000


def test_long_and_repeated_records_are_dealt_whole(spark):
    rows = [(i, "x" * (20_000 if i % 10 == 0 else 10)) for i in range(200)] + [(1000, "hot" * 500)] * 300
    got = sharding.scatter(docs(spark, rows), shards=2, seed=1, bucket_bytes=30_000).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    for shard in range(2):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))


def test_the_sharding_query_writes_whole_documents(spark, tmp_path, monkeypatch):
    from flowsentry.llm import catalog, common

    monkeypatch.setattr(common, "folder", lambda spark, name: str(tmp_path / name))
    catalog.op2_sharding(spark, "/root/testdata/sf0.001")
    written = spark.read.parquet(str(tmp_path / "shards"))
    given = common.read(spark, "/root/testdata/sf0.001", "documents")
    assert pairs(written, *given.columns) == pairs(given, *given.columns)


def test_exact_dedup_edges(spark, monkeypatch):
    rows = [(1, "a"), (5, "a"), (5, "a"), (2, None), (9, ""), (None, "a"), (4, "b"), (None, "c")]
    got = exact_dedup.groups(docs(spark, rows))
    assert pairs(got.where("kept"), "doc_id", "keep_id", "group_size") == sorted(
        [(5, 5, 4), (9, 9, 2), (4, 4, 1), (None, None, 1)], key=repr
    )
    assert exact_dedup.groups(docs(spark, [])).count() == 0
    kept = exact_dedup.keep_one(docs(spark, rows), keep="smallest")
    assert kept.columns == ["doc_id", "text", "source", "kept"]
    assert pairs(kept, "doc_id") == sorted([(1,), (2,), (4,), (None,)], key=repr)


def test_a_hot_text_is_salted(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup.groups(many)
    hot = got.where("group_size = 1500")
    assert hot.count() == 1500 and hot.where("kept").collect()[0].doc_id == 2998
    assert hot.select("keep_id").distinct().count() == 1 and got.where("kept").count() == 1501


def test_mixing_follows_the_weights(spark):
    rows = [(i, "x" * 99, "a") for i in range(4000)] + [(i, "x" * 99, "b") for i in range(4000, 5000)]
    got = mixing.mix(docs(spark, rows), {"a": 1.0, "b": 3.0}, epochs=1.0)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["b"] / 3750 - 1) < 0.08 and abs(counts["a"] / 1250 - 1) < 0.12
    copies = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("_mix_copy").alias("m"))
    assert copies.where("n <> m").count() == 0


def test_mixing_edges(spark):
    rows = [(1, None, None), (2, "", "s"), (None, "abc", "s"), (None, "abc", "s")]
    got = mixing.mix(docs(spark, rows), epochs=50.0)
    assert got.columns == ["doc_id", "text", "source", "kept", "_mix_copy", "_mix_order"]
    assert {r.source for r in got.collect()} == {None, "s"}
    assert mixing.mix(docs(spark, [])).count() == 0


# N-gram Jaccard -------------------------------------------------------------------------------


def test_jaccard_groups_of_near_copies(spark):
    """Stars, chains and unrelated documents that share a passage, against all pairs."""
    from test_llm_queries import linked, shingles

    rng = random.Random(11)
    word = lambda: "w" + str(rng.randint(0, 10**6))
    base = [word() for _ in range(90)]
    texts = [" ".join(base)]
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(90)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(60)]
    for _ in range(12):
        chain[rng.randrange(60)] = word()
        texts.append(" ".join(chain))
    passage = " ".join(word() for _ in range(30))
    texts += [f"{passage} {' '.join(word() for _ in range(40))}" for _ in range(150)]
    texts += ["a b c", "A B c", "a b", "", " \t\n", texts[3], texts[3].upper()]
    rng.shuffle(texts)
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    sets = {i: shingles(t) for i, t in rows}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), root) for i, root in linked(sets).items()}


def test_jaccard_edges(spark):
    same = "one two three four five six"
    rows = [(1, same), (1, "quite another text of more than five words"), (7, same), (None, same), (None, None), (3, None)]
    got = jaccard.similar(docs(spark, rows))
    assert pairs(got, "doc_id", "n_shingles", "component_id") == sorted(
        [(1, 2, 1), (1, 4, 1), (7, 2, 1), (None, 2, None), (None, 0, None), (3, 0, 3)], key=repr
    )
    assert jaccard.similar(docs(spark, [])).count() == 0


def test_jaccard_cells_have_a_partner_by_place(spark):
    """Pairs of sets share a passage; only the cells in whose first place enough could be shared stay, and no linked pair loses all."""
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randint(0, 10**6))
    texts = []
    for k in range(40):
        shared = [word() for _ in range(rng.choice((25, 60, 190)))]
        texts += [" ".join(shared + [word() for _ in range(10 + k % 7)]) for _ in range(2)]
    rows = list(enumerate(texts, 1))
    use = np.zeros(1 << jaccard.RANGE_BITS, np.int64)
    own, places = {}, {}
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        own[i] = next(jaccard.sets(np.array([0, len(data)]), data))
        for at, cell in enumerate(jaccard.cells_of(own[i], use).view(np.int64)):
            places.setdefault(int(cell), []).append((i, len(own[i]), at))
    node = {i: jaccard.fingerprint(x) for i, x in own.items()}
    of_size, exact = set(), set()
    for cell, both in places.items():
        if len(both) == 2:
            (a, n, i), (b, m, j) = both
            if 4 * m <= 5 * n and 4 * n <= 5 * m:
                of_size |= {(cell, node[a]), (cell, node[b])}
            if 9 * min(n - i, m - j) >= 4 * (n + m):
                exact |= {(cell, node[a]), (cell, node[b])}
    documents = spark.createDataFrame(rows, "_id long, _text string")
    got = {tuple(r) for r in jaccard._cells(documents, use).collect()}
    assert exact <= got <= of_size and len(got) <= len(exact) + 0.05 * len(of_size) < 0.7 * len(of_size)
    linked = [(a, a + 1) for a in range(1, 80, 2) if jaccard.enough(jaccard.overlap(own[a], own[a + 1]), len(own[a]), len(own[a + 1]))]
    cells = {i: {c for c, x in got if x == node[i]} for i in own}
    assert len(linked) > 5 and all(cells[a] & cells[b] for a, b in linked)


def test_jaccard_points_travel_packed():
    rng = np.random.default_rng(3)
    for n in (1, 200, 4000, 70_000):
        counts = jaccard.point(rng.integers(0, 1 << 64, n, dtype=np.uint64), jaccard.FINE)
        raw = jaccard._packed(counts, n)
        assert (jaccard._counts(raw, n) == counts).all() and (n < 4000 or len(raw) < 0.5 * counts.astype(jaccard._kind(n)).nbytes)


def test_jaccard_bounds_its_batches(spark):
    """The session's batches are short in bytes, not in rows only, until the next query prepares it."""
    import pyarrow as pa

    from flowsentry.session import prepare

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    jaccard.similar(docs(spark, [(1, "a few words")])).count()
    long = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert 0 < max(r.size for r in long.mapInArrow(sizes, "size long").collect()) < 12 << 20
    prepare(spark)
    assert max(r.size for r in long.mapInArrow(sizes, "size long").collect()) > 12 << 20


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, 101), (101, 102), (100, 102)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 100: 100, 101: 100, 102: 100}


# Tokens, languages, quality -------------------------------------------------------------------


def test_bpe_edges(spark):
    rows = [(1, None), (2, ""), (3, "  a\n\n b "), (4, "a" * 50_000), (4, "é  x\U0001f600"), (5, "word " * 3)]
    got = bpe.round_trip(docs(spark, rows)).collect()
    assert [bytes(r.decoded).decode() for r in got] == [t or "" for _, t in rows]
    two = bpe.decode(bpe.encode(docs(spark, rows))).collect()
    assert [bytes(r.token_ids) for r in two] == [bytes(r.token_ids) for r in got]
    assert bpe.encode(docs(spark, [])).count() == 0


def test_bpe_backtracks_like_the_merges(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    rng = random.Random(4)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 290:
            made = b"".join(rng.choice([t for t in ranks if set(t) <= set(b"abc")]) for _ in range(2))
            if len(made) <= 9:
                ranks.setdefault(made, len(ranks))
        lines = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
        own = bpe.Vocabulary(lines, r"\w+")
        other = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
        reachable = {t for t, r in ranks.items() if len(t) == 1 or own.left_of[r] != r}
        if len(reachable) < len(ranks):
            continue  # not the result of merges
        for _ in range(200):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
            assert own.encode_piece(text) == other.encode_ordinary(text)


def test_langid_edges(spark):
    rows = [(i, f"the cat sat on mat {i}", "en") for i in range(80)] + [(i, f"der hund liegt unter {i}", "de") for i in range(80, 160)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_score_ string")
    model = langid.fit(table)
    asked = [(1, None), (2, ""), (3, "123 !?"), (4, "the mat the cat"), (5, "unter der hund"), (5, "unter der hund"), (6, "the cat " * 300_000)]
    got = langid.predict(docs(spark, asked), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de", "de", "en"]
    assert [r.lang_score for r in got[:3]] == [0.0] * 3 and got[4].lang_score == got[5].lang_score
    assert langid.predict(docs(spark, []), model).count() == 0
    with pytest.raises(ValueError):
        langid.fit(table.where("false"))


def test_the_language_sample_draws_different_texts(spark):
    few = [(f"un texte {i}", "fr") for i in range(3) for _ in range(400)]
    many = [(f"text {i}", "en") for i in range(900)] + [("hot", "en")] * 900
    table = spark.createDataFrame(few + many, "text string, lang string")
    got = langid._sample(table, "text", "lang", 50, 100).collect()
    assert sorted(r.text for r in got if r.lang == "fr") == [f"un texte {i}" for i in range(3)]
    assert len({r.text for r in got if r.lang == "en"}) == len([r for r in got if r.lang == "en"]) == 50


def test_langid_without_labelled_rows(spark, tmp_path):
    import corpus_pipeline
    from flowsentry.llm import catalog

    table = docs(spark, [(1, "abc"), (2, "12")], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    table.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    got = catalog.op9_langid(spark, str(tmp_path / "some"))
    assert pairs(got, "doc_id", "lang_pred", "score") == [(1, "und", 0.0), (2, "und", 0.0)]
    assert catalog.op9_langid(spark, str(tmp_path / "none")).count() == 0
    assert [r.doc_id for r in corpus_pipeline.keep_known_languages(spark, table, "").collect()] == [1]
    assert corpus_pipeline.keep_known_languages(spark, table.where("false"), "").count() == 0


def test_ngrams_of_long_texts_are_counted_once(monkeypatch):
    text = "ab cd " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "STRETCH", 17)
    assert (langid.counts(text) == whole).all()


def test_quality_edges(spark):
    good = [(i, f"A plain sentence number {i} of some length. And then one more.") for i in range(60)]
    bad = [(i, f"BUY | BUY | BUY | {i} |") for i in range(60, 120)]
    stats = quality.with_statistics(docs(spark, good + bad))
    model = quality.fit(stats.withColumn("label", (F.col("doc_id") < 60).cast("int")))
    asked = [(1, None), (2, ""), (3, "x" * 200_000), (4, good[0][1]), (4, good[0][1]), (5, bad[0][1])]
    got = quality.score(quality.with_statistics(docs(spark, asked)), model).collect()
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert got[3].score == got[4].score > 0.5 > got[5].score
    assert quality.score(quality.with_statistics(docs(spark, [])), model).count() == 0
    with pytest.raises(ValueError):
        quality.fit(stats.withColumn("label", F.lit(1)))


# Top-k ----------------------------------------------------------------------------------------


def test_topk_edges(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6).round(2).tolist()) for i in range(0, 400)]
    vectors += [(50, None), (1, [1.0, None]), (2, [float("nan")]), (3, [float("inf")]), (None, [1.0]), (400, [9.0]), (401, [9.0]), (401, [9.0]), (450, [])]
    table = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, score string")
    got = topk.search(table, F.col("vec_id") % 50 == 0, 5)
    usable = [(i, np.floor(256 * np.array(v, float))) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for a, (query, q) in enumerate(usable):
        if query % 50 == 0:
            scored = []
            for b, (other, v) in enumerate(usable):
                n = min(len(q), len(v))
                if a != b:
                    scored.append((-int(q[:n] @ v[:n]), other))
            want += [(query, rank + 1, other, -s) for rank, (s, other) in enumerate(sorted(scored)[:5])]
    assert pairs(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.search(table.where("false"), F.lit(True)).count() == 0


def test_impact_index_prunes_only_what_it_can_prove():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.standard_t(2, size=(2000, 16)) * 50)
    queries = np.floor(rng.standard_t(2, size=(20, 16)) * 50)
    own = np.zeros((20, 2000), bool)
    members = topk.ImpactIndex(vectors).possible(queries, own, 5)
    exact = queries @ vectors.T
    fifth = np.sort(exact, axis=1)[:, -5]
    assert (members | (exact < fifth[:, None])).all() and members.mean() < 0.5


# WARC -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    long = "p" * 300 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "u5", long), (2, "u\r\n2", long), (9, None, long), (1, "u1", "short"), (3, "u3", "short"), (4, "u4", None), (2, "again", long), (None, "n", long)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int")
    warc.write_archives(warc.planned(pages), str(tmp_path / "w"), records=3, compression=compression)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and {r.kind for r in got} == {"record"}
    held = [r for r in got if r.record_type == "response"]
    assert sorted(bytes(r.payload).decode() for r in held) == sorted([long, "short", "short", ""])
    revisits = [r for r in got if r.record_type == "revisit"]
    assert {r.refers_to for r in revisits} == {"<urn:page:2>"} and len(revisits) == 4
    assert all(bytes(r.payload) == b"" for r in revisits)
    warc.write_archives(warc.planned(pages.where("false")), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).where("kind = 'record'").count() == 0


def record(number, payload):
    import hashlib

    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n"
    return head % (number, hashlib.sha256(payload).hexdigest().encode(), len(block)) + block + b"\r\n\r\n"


def names(found):
    return [r.headers["warc-record-id"] if r.kind == "record" else (r.offset, r.length) for r in found]


def test_salvage_of_damaged_archives():
    a, b, c = record(1, b"first"), record(2, b"second payload"), record(3, b"third")
    assert names(warc.salvage(a + b + c)) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    broken = b.replace(b"second", b"sEcond")
    assert names(warc.salvage(a + broken + c)) == ["<urn:page:1>", (len(a), len(b)), "<urn:page:3>"]
    assert names(warc.salvage(a + b[:-20] + c)) == ["<urn:page:1>", (len(a), len(b) - 20), "<urn:page:3>"]
    assert names(warc.salvage(b"junk" + c)) == [(0, 4), "<urn:page:3>"]
    assert names(warc.salvage(a + b"tail")) == ["<urn:page:1>", (len(a), 4)]
    assert names(warc.salvage(b"")) == []
    zipped = [gzip.compress(x) for x in (a, b, c)]
    assert names(warc.salvage(b"".join(zipped))) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    hurt = zipped[1][:30] + b"\xff\xff" + zipped[1][32:]
    assert names(warc.salvage(zipped[0] + hurt + zipped[2])) == ["<urn:page:1>", (len(zipped[0]), len(hurt)), "<urn:page:3>"]
    assert names(warc.salvage(zipped[0] + zipped[1][:40])) == ["<urn:page:1>", (len(zipped[0]), 40)]
    whole = gzip.compress(a + b + c)
    assert names(warc.salvage(whole)) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    crc = whole[:-8] + b"\0\0\0\0" + whole[-4:]
    assert names(warc.salvage(crc)) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>", (0, len(whole))]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_of_a_very_long_url(spark, tmp_path, compression):
    url = "data:text/html;base64," + "A" * 200_000
    pages = spark.createDataFrame([(1, url, "p" * 200), (2, "u", "p" * 200)], "page_id long, url string, html string")
    warc.write_archives(warc.planned(pages), str(tmp_path / "w"), compression=compression)
    got = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got["<urn:page:1>"].uri == url and got["<urn:page:2>"].refers_to == "<urn:page:1>" and len(got) == 2


def test_salvage_of_a_damaged_archive_of_the_writer(spark, tmp_path):
    """One overwritten block costs the records in it, none of those behind."""
    rng = random.Random(3)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdefgh ") for _ in range(3_000))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.planned(pages).coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    whole = [r for r in warc.salvage(data) if r.kind == "record"]
    assert len(whole) == 40 and len({r.offset for r in whole}) == 40 and gzip.decompress(data).count(b"WARC/1.1\r\n") == 40
    at = whole[10].offset + 300
    hurt = data[:at] + b"\xff" * 500 + data[at + 500 :]
    left = [r for r in warc.salvage(hurt) if r.kind == "record"]
    assert [r.payload for r in left] == [r.payload for i, r in enumerate(whole) if i != 10]


def test_members_of_any_length_end_in_a_zero():
    for size in (0, 1, 1 << 24, (1 << 24) + 5):
        made = warc._zip(b"x" * size)
        assert made.endswith(b"\0") and gzip.decompress(made) == b"x" * size


def test_salvage_looks_for_both_kinds_of_restart():
    a, b = record(1, b"first"), record(2, b"second payload")
    packed = record(3, gzip.compress(b"an archived file", mtime=0))
    hurt = b"xARC" + a[4:]
    assert names(warc.salvage(hurt + packed + b)) == [(0, len(a)), "<urn:page:3>", "<urn:page:2>"]
    broken = packed.replace(b"WARC-Type: response", b"WARC-Type- response")
    assert names(warc.salvage(a + broken + b)) == ["<urn:page:1>", (len(a), len(broken)), "<urn:page:2>"]
    members = gzip.compress(b) + gzip.compress(packed)
    assert names(warc.salvage(a + members)) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    assert names(warc.salvage(a + hurt + members)) == ["<urn:page:1>", (len(a), len(a)), "<urn:page:2>", "<urn:page:3>"]
    stored = gzip.compress(a + b, 0)
    cut = stored[:-8] + b"\0" * 8
    assert names(warc.salvage(cut + packed)) == ["<urn:page:1>", "<urn:page:2>", (0, len(cut)), "<urn:page:3>"]


# Edges found later ----------------------------------------------------------------------------


def test_weights_of_zero_give_no_copies(spark):
    rows = docs(spark, [(1, "a", "x"), (2, "b", "y"), (3, "c", None)])
    assert mixing.mix(rows, weights={"x": 0.0, "y": 0.0}).count() == 0
    kept = mixing.mix(rows, weights={"x": 0.0, "y": 1.0}, epochs=20).select("doc_id").distinct()
    assert [r.doc_id for r in kept.collect()] == [2]


def test_topk_of_huge_components(spark):
    rows = [(0, [1.7e308, 1.0]), (1, [-1.7e308, 2.0]), (50, [1e306, 0.0]), (51, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id") % 50 == 0).collect()
    top = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    most = (1 << 63) - 1
    assert top[0, 1] == (50, most) and top[0, 3] == (1, -most - 1) and len(got) == 6


def test_quality_without_labels(spark):
    rows = quality.with_statistics(docs(spark, [(1, "some words here"), (2, ""), (3, None)]))
    labelled = rows.withColumn("label", F.lit(1))
    for fitted, share in ((labelled.limit(0), 0.5), (labelled, 1.0)):
        got = quality.score(rows, quality.fit(fitted)).collect()
        assert len(got) == 3 and all(abs(r.score - share) < 1e-9 for r in got)
    assert quality.score(rows.limit(0), quality.fit(labelled.limit(0))).count() == 0


def test_langid_query_learns_every_language(spark, tmp_path):
    """More languages than the operator's default: the query learns all of them."""
    from flowsentry.llm import catalog

    letters = [chr(0x4E00 + 7 * k) for k in range(110)]
    rows = [(k * 20 + i, letters[k] * 6 + " " + letters[k] * (2 + i % 3), f"l{k:03}") for k in range(110) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.op9_langid(spark, str(tmp_path)).collect()
    right = sum(r.lang_pred == f"l{r.doc_id // 20:03}" for r in got)
    assert len(got) == len(rows) and len({r.lang_pred for r in got}) >= 105 and right > 0.9 * len(rows)


def test_discriminant_against_plain_formulas(spark):
    """Shrunk covariances, log densities and scores written out row by row."""
    rng = np.random.default_rng(4)
    d = len(quality.STATISTICS)
    x = rng.normal(size=(60, d)) + np.repeat([[0.0], [0.7]], 30, axis=0)
    y = [0] * 30 + [1] * 30
    df = spark.createDataFrame([(i, r.tolist(), k) for i, (r, k) in enumerate(zip(x, y))], "doc_id long, stats array<double>, label int")
    got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, shrink=0.1, pooled=0.2)).collect()}
    spreads = [np.cov(x[30 * k : 30 * k + 30].T, bias=True) for k in (0, 1)]
    common = (spreads[0] + spreads[1]) / 2
    logs = []
    for k in (0, 1):
        mixed = 0.8 * spreads[k] + 0.2 * common
        s = 0.9 * mixed + 0.1 * np.diag(np.diag(mixed)) + 1e-4 * np.eye(d)
        z = x - x[30 * k : 30 * k + 30].mean(axis=0)
        logs.append(np.log(0.5) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    assert np.allclose([got[i] for i in range(60)], np.clip(want, 1e-12, 1 - 1e-12), atol=1e-8)
