"""Every registered query on a written table with awkward rows, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import byte_cnn, queries
from tessera.llm.tokens import default_path
from tests.llm.helpers import SCHEMA, SPACE, fixture_rows, prose, shingles, words
from tests.llm.test_native import _base
from tests.llm.test_python_ops import _classes, _strings


def _rows():
    rng = random.Random(11)
    rows = fixture_rows() + [(700, "end <|endoftext|> start\n<|startoftext|>", "en", "src0", 1)]
    sentences = [prose(rng, rng.randint(4, 12)) for _ in range(3000)]
    long_ = " ".join(rng.choice(sentences) for _ in range(26000))
    assert len(long_) > 1_000_000
    return rows + [(701, long_, "en", "src1", 1)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows = _rows()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nothing")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_queries_take_empty_tables(spark, nothing):
    for name, run in queries.queries().items():
        assert run(spark, nothing).count() == 0, name


def test_op1_is_the_stated_order(spark, corpus):
    folder, rows = corpus
    out = queries.op1_stratified_shards(spark, folder).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    # the same order in plain Python: seeded MD5 within the source, then the fraction of the source's size
    strata = defaultdict(list)
    for i, t, _, source, _ in rows:
        key = str(i) if i is not None else "text:" + (t or "")
        strata["n" if source is None else "s" + source].append((hashlib.md5(f"17:{key}".encode()).hexdigest(), i))
    order = []
    for stratum, held in strata.items():
        for rank, (_, i) in enumerate(sorted(held, key=lambda x: (x[0], x[1] is not None, x[1] or 0))):
            order.append(((rank + 0.5) / len(held), stratum, rank, i))
    order = [x[3] for x in sorted(order, key=lambda x: x[:3])]
    wide, small = len(order) % 24, len(order) // 24
    got = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == order
    assert Counter(r.shard for r in got) == Counter({s: small + (s < wide) for s in range(24)})


def test_op2_base_columns(spark, corpus):
    folder, rows = corpus
    out = queries.op2_ngram_likelihood(spark, folder).collect()
    want = Counter()
    for i, t, *_ in rows:
        n, chars, symbols, lines, repeated = _base(t)
        want[i, n, chars, symbols, lines, repeated, n < 50 or 100 * repeated > 50 * n] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)


@pytest.mark.parametrize("name, file, end", [("op4", "byte_bpe_50k.json", 0), ("op8", "word_bpe_49k.json", 1)])
def test_ids_are_the_librarys(spark, corpus, name, file, end):
    folder, rows = corpus
    library = Tokenizer.from_file(default_path(file))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [end] for _, t, *_ in rows]
    if name == "op8":
        out = queries.op8_simple8b_files(spark, folder).orderBy("start").collect()
        got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out)
        assert got == Counter((r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids, strict=True))
        assert [r.start for r in out] == (np.cumsum([r.n_tokens for r in out]) - [r.n_tokens for r in out]).tolist()
        named = [r.doc_id for r in out if r.doc_id is not None]
        assert named == sorted(named)
        return
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op4_concat_and_cut(spark, folder).collect():
        pieces[r.sequence_id * 1024 + r.offset - r.start].append((r.start, r.length, r.ids_crc32, r.doc_id, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    wanted = Counter()
    for r, x in zip(rows, ids, strict=True):
        wanted[r[0], len(x)] += 1
    by_size = defaultdict(list)
    for r, x in zip(rows, ids, strict=True):
        by_size[r[0], len(x)].append(np.array(x, "<u4"))
    seen = Counter()
    for held in pieces.values():
        held.sort()
        key = held[0][3], held[0][4]
        assert sum(p[1] for p in held) == key[1] and [p[0] for p in held] == (np.cumsum([p[1] for p in held]) - [p[1] for p in held]).tolist()
        assert any(all(zlib.crc32(x[a : a + n].tobytes()) == crc for a, n, crc, *_ in held) for x in by_size[key])
        seen[key] += 1
    assert seen == wanted
    for k, held in sequences.items():
        ends = [a + n for a, n in sorted(held)]
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1]] and (ends[-1] == 1024 or k == max(sequences))


def test_op5_scores_every_row(spark, corpus):
    folder, rows = corpus
    out = queries.op5_byte_cnn(spark, folder).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    empty = {r.score for r in out if r.doc_id in {i for i, t, *_ in rows if not t}}
    assert len(empty) == 1


def test_network_by_plain_loops():
    rng = np.random.default_rng(4)
    weights = byte_cnn.new_weights()
    weights["filter_bias"] += 0.01
    texts = [b"", b"a", bytes(rng.integers(32, 127, 700, dtype=np.uint8)), bytes(rng.integers(32, 255, 90_000, dtype=np.uint8))]
    for text, got in zip(texts, byte_cnn.score_texts(weights, texts), strict=True):
        places = max(1, -(-len(text) // byte_cnn.STEP))
        blocks = -(-places // byte_cnn.BLOCK)
        padded = text + bytes(blocks * byte_cnn.BLOCK * byte_cnn.STEP + byte_cnn.WIDTH - len(text))
        response = np.stack([byte_cnn._TABLE[list(padded[p * byte_cnn.STEP : p * byte_cnn.STEP + byte_cnn.WIDTH])].ravel() @ weights["filters"] for p in range(blocks * byte_cnn.BLOCK)])
        most = response.reshape(blocks, byte_cnn.BLOCK, -1).max(axis=1)
        chunks = [most[min(k, blocks - 1) : min(k + byte_cnn.CHUNK, blocks)].max(axis=0) for k in range(0, max(1, blocks - 1), byte_cnn.CHUNK - 1)]
        pooled = np.maximum(np.array(chunks) + weights["filter_bias"], 0)
        joined = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0), [np.log1p(len(text)) / 10, min(len(text), 500) / 500]])
        hidden = np.maximum(joined @ weights["hidden"] + weights["hidden_bias"], 0)
        assert got == pytest.approx(1 / (1 + np.exp(-float((hidden @ weights["out"] + weights["out_bias"])[0]))), abs=1e-4)


def test_op6_against_all_strings(spark, corpus):
    folder, rows = corpus
    out = queries.op6_suffix_dedup(spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == _strings(rows)


def test_op9_and_op10_classes(spark, corpus):
    folder, rows = corpus
    name, links, _ = _classes(rows)
    out = queries.op9_lsh_forest_join(spark, folder).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == Counter((r[0], name[i], links[i]) for i, r in enumerate(rows))
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for text, held in groups.items():
        best = min(held)
        for k, row in enumerate(sorted(held)):
            want[row[3], best[3], len(held), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries.op10_bloom_exact_dedup(spark, folder).collect())
    assert got == want


def _families(rng, n_families, length, edits, copies):
    """Passages and copies with changed words, each in a document of its own surroundings."""
    rows, passages = [], []
    for _ in range(n_families):
        whole = prose(rng, length).split()
        for k in range(copies + 1):
            mine = list(whole)
            for at in rng.sample(range(length), edits if k else 0):
                mine[at] = prose(rng, 1) + "q"
            passages.append(mine)
            rows.append((len(rows), " ".join(prose(rng, rng.randint(20, 60)).split() + mine + prose(rng, rng.randint(20, 60)).split()), "en", "s", 0))
    return rows, passages


@pytest.mark.parametrize("length, edits", [(60, 1), (90, 2), (200, 4), (400, 8)])
def test_op7_finds_edited_passages(spark, tmp_path, length, edits):
    """Of the pairs of one family at the threshold, nine in ten at least share a class, and most families are whole."""
    rng = random.Random(length)
    rows, passages = _families(rng, 12, length, edits, 6)
    sentence = prose(rng, 30)  # a frequent phrase of its own that makes no passage
    rows += [(len(rows) + k, f"{prose(rng, 60)} {sentence} {prose(rng, 60)}", "en", "s", 0) for k in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_compact_windows(spark, str(tmp_path)).collect()
    class_of = {r.doc_id: r.class_id for r in out}
    sets = [shingles(" ".join(p)) for p in passages]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = sum(i in class_of and class_of[i] == class_of.get(j) for i, j in pairs)
    assert len(pairs) > 20 and found >= 0.9 * len(pairs), (found, len(pairs))
    assert not any(i >= len(passages) for i in class_of)
    by_id = {r[0]: words(r[1]) for r in rows}
    for r in out:
        a, b = by_id[r.doc_id][r.start_word : r.start_word + r.n_words], by_id[r.partner_id][r.partner_start : r.partner_start + r.partner_words]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert min(len(a), len(b)) >= 50 and r.jaccard == pytest.approx(len(x & y) / len(x | y)) and r.jaccard >= 0.8 - 1e-9
