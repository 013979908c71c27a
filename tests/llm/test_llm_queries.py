"""The package's queries against SQL, or against a brute-force version where SQL cannot express them."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import compare
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowsentry.llm import catalog, common
from flowsentry.llm.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in common.read(spark, SF_DIR, "documents").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare.difference(catalog.QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


def covered(texts, length):
    """For each text which bytes a string covers that starts anywhere else."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        flags = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        yield flags


def test_suffix_dedup(spark, documents):
    texts = {doc: text.encode() for doc, text in documents.items()}
    got = {r.doc_id: r for r in catalog.op1_suffix_dedup(spark, SF_DIR).collect()}
    assert len(got) == len(texts)
    for (doc, text), flags in zip(texts.items(), covered(list(texts.values()), 200)):
        kept = bytes(b for b, f in zip(text, flags) if not f)
        spans = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
        row = got[doc]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(text), sum(flags), spans)
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_sharding(spark, documents):
    rows = catalog.op2_sharding(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    slots = defaultdict(list)
    for r in rows:
        text = documents[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.shard in range(8) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked(sets):
    """The smallest id reachable from each, over all pairs."""
    least = {doc: doc for doc in sets}

    def root(doc):
        while least[doc] != doc:
            doc = least[doc]
        return doc

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {doc: root(doc) for doc in sets}


def test_ngram_jaccard(spark, documents):
    sets = {doc: shingles(text) for doc, text in documents.items()}
    groups = linked(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in catalog.op4_ngram_jaccard(spark, SF_DIR).collect()}
    assert got == {doc: (len(sets[doc]), groups[doc]) for doc in sets}


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, documents, encoding):
    for r in catalog.op7_byte_bpe(spark, SF_DIR).collect():
        ids = encoding.encode_ordinary(documents[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = catalog.op8_quality(spark, sf_dir)
    labels = common.read(spark, sf_dir, "labels").where("quality IS NOT NULL")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert len(rows) > 500 and right > 0.97


def test_langid_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    held = catalog.op9_langid(spark, sf_dir).where("held_out")
    known = common.read(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang")
    rows = held.join(known, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert len(rows) > 1000 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_pipeline(spark, encoding):
    """Each stage against a plain version over what the stage before kept."""
    docs = common.read(spark, SF_DIR, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, common.settle(stage(spark, docs, SF_DIR), name))
        docs = seen[name][1]
    before, after = seen["language_id"]
    assert set(after.columns) == set(before.columns)
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert len(gone) < 0.05 * before.count()

    before, after = seen["exact_dedup"]
    best = {}
    for r in before.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in after.collect())

    before, after = seen["near_duplicates"]
    groups = linked({r.doc_id: shingles(r.text) for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, g in groups.items() if d == g)

    before, after = seen["mixing"]
    sizes = Counter()
    for r in before.collect():
        sizes[r.source] += len(r.text.encode()) + 1
    total = sum(len(r.text.encode()) + 1 for r in after.collect())
    assert 0.7 < total / sum(sizes.values()) < 1.3
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}

    before, after = seen["byte_bpe"]
    texts = Counter((r.doc_id, r.text) for r in before.collect())
    ids = Counter()
    for r in after.collect():
        assert r.round_trip
        ids[r.doc_id, encoding.decode(list(memoryview(bytes(r.token_ids)).cast("I")))] += 1
    assert ids == texts


def test_language_id_keeps_clean_documents(spark):
    """Every document with a letter stays: labelled clean ones, rare languages, texts between two languages."""
    docs = common.read(spark, SF_DIR, "documents")
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, SF_DIR).collect()}
    clean = docs.join(common.read(spark, SF_DIR, "labels").where("quality = 1"), "doc_id").collect()
    assert clean and {r.doc_id for r in clean} <= kept
    assert {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} == kept
    mine = [(k * 10 + i, f"{chr(0x4E00 + k)}{chr(0x5000 + k)} {i}", f"l{k:03}", "s", 5) for k in range(110) for i in range(4)]
    mine += [(9000 + i, "".join(chr(0x4E00 + k + i) for k in range(3)), None, "s", 3) for i in range(20)] + [(9999, "12 !", None, "s", 4)]
    got = corpus_pipeline.keep_known_languages(spark, spark.createDataFrame(mine, docs.select(*corpus_pipeline.COLUMNS).schema), SF_DIR)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in mine[:-1])


def test_run_applies_the_stages_in_order(spark, monkeypatch):
    calls = []
    stages = [(name, lambda spark, docs, sf_dir, name=name: calls.append(name) or docs.limit(5)) for name, _ in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, SF_DIR).count() == 5
    assert calls == ["language_id", "exact_dedup", "near_duplicates", "mixing", "byte_bpe"]


def test_language_id_names_what_had_no_language(spark):
    docs = common.read(spark, "/root/testdata/sf0.1", "documents")  # enough rows to learn from
    kept = corpus_pipeline.keep_known_languages(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))), SF_DIR)
    both = kept.select("doc_id", F.col("lang").alias("named")).join(docs.where("lang IS NOT NULL"), "doc_id").collect()
    odd = [r.named == r.lang for r in both if r.doc_id % 2]
    assert all(r.named == r.lang for r in both if r.doc_id % 2 == 0) and sum(odd) / len(odd) > 0.9


def test_pipeline_edges(spark):
    """Nulls, repeated ids, extra columns and an empty table go through every stage."""
    text = "a few words that make a text of its own, number "
    rows = [(i, text + "x" * i, "en", "s", 5, "extra") for i in range(1, 9)]
    rows += [(None, "without an id this text stays", None, None, None, "extra"), (3, "the same id with another text", "en", "s", 5, "extra")]
    rows += [(20, None, "en", "s", 0, "extra"), (21, "", None, "s", 0, "extra"), (22, "12 34", "en", "s", 5, "extra"), (23, rows[0][1], "en", "t", 5, "extra")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _node string"
    docs, seen = spark.createDataFrame(rows, schema), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, SF_DIR), name)
        seen[name] = docs
        assert name == "byte_bpe" or docs.columns == corpus_pipeline.COLUMNS
    ids = {name: sorted((r.doc_id is None, r.doc_id) for r in df.select("doc_id").collect()) for name, df in seen.items()}
    first = sorted([(False, i) for i in [*range(1, 9), 3, 23]] + [(True, None)])
    assert ids["language_id"] == first
    assert ids["exact_dedup"] == [x for x in first if x != (False, 1)]  # 23 has the text of 1
    assert set(ids["near_duplicates"]) <= set(ids["exact_dedup"]) and (True, None) in ids["near_duplicates"]
    assert set(ids["byte_bpe"]) <= set(ids["near_duplicates"])
    assert all(r.round_trip for r in seen["byte_bpe"].collect())
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = common.settle(stage(spark, empty, SF_DIR), "empty")
        assert empty.count() == 0
