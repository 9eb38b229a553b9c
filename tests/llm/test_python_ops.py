"""Packing, token files, classifier, near-duplicates, passages and byte strings against brute force."""

import zlib
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import byte_cnn, compact_windows, induced_sort, lsh_forest, suffix_dedup, token_files
from tessera.llm.packing import packed_pieces
from tessera.llm.tokens import Encoder, default_path
from tests.llm.helpers import empty, fixture_rows, frame, shingles, words

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


@pytest.fixture(scope="module")
def libraries():
    found = {}
    for name, spaces in KINDS:
        found[name] = Tokenizer.from_file(default_path(name)), Encoder(default_path(name), spaces)
    return found


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBé ́\n\t'st1!<|>_ ßİ漢")), max_size=30))
def test_cached_tokens_are_the_librarys(libraries, text):
    for library, own in libraries.values():
        assert np.frombuffer(own.encode([text])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def _ids(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def test_packing_covers_every_id_once(spark, libraries):
    rows = fixture_rows()
    docs = frame(spark, rows).withColumn("length", F.lit("old"))
    out = packed_pieces(docs, 256).collect()
    library = libraries["byte_bpe_50k.json"][0]
    want = Counter()
    for r in rows:
        want[tuple(_ids(library, r[1], 0))] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.piece_ids, "<u2")
        assert r.length == len(ids) and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.sequence_id * 256 + r.offset - r.piece_start].append((r.piece_start, ids.tolist(), r.doc_tokens))
    sizes = []
    for s in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[s]):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(sequences) == list(range(len(sizes))) and all(n == 256 for n in sizes[:-1])
    got = Counter()
    for held in pieces.values():
        ids = [x for _, piece, _ in sorted(held) for x in piece]
        assert len(ids) == held[0][2]
        got[tuple(ids)] += 1
    assert got == want
    assert packed_pieces(empty(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=200))
def test_simple8b_round_trip(values):
    ids = np.array(values, dtype=np.uint64)
    assert token_files.decode_block(token_files.encode_block(ids)).tolist() == values if values else True


def test_token_files_in_order(spark, libraries):
    rows = fixture_rows()
    files = token_files.write_token_files(frame(spark, rows))
    out = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    library = libraries["word_bpe_49k.json"][0]
    at = 0
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and len(ids) == r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    ids = [r.doc_id for r in out if r.doc_id is not None]
    assert ids == sorted(ids) and [r.doc_id for r in out[:2]] == [None, None]
    want = Counter((r[0], tuple(_ids(library, r[1], 1))) for r in rows)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == want
    assert token_files.read_token_files(token_files.write_token_files(empty(spark))).count() == 0


def test_classifier_learns_and_covers_whole_texts(spark):
    rng = np.random.default_rng(1)

    def text(good):
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(rng.integers(20, 200))]
        return " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)

    rows = [(i, text(i % 2 == 0), "en", "s", 0) for i in range(300)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    extra = [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (None, rows[0][1], "en", "s", 0), (302, rows[0][1], "en", "s", 0)]
    out = byte_cnn.quality_scores(frame(spark, rows + extra).withColumn("score", F.lit("old")), labels).collect()
    by = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and np.mean([r.predicted == 1 - r.doc_id % 2 for r in held]) > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert 0 <= by[300].score <= 1 and by[300].score == by[301].score and by[302].score == pytest.approx(by[0].score, abs=1e-5)
    weights = byte_cnn.new_weights()
    body = rows[0][1].encode() * 30
    tail = body[:-400] + bytes(rng.integers(33, 64, 400, dtype=np.uint8))
    assert byte_cnn.score_texts(weights, [body])[0] != byte_cnn.score_texts(weights, [tail])[0]
    assert byte_cnn.quality_scores(empty(spark), labels).count() == 0


def test_classifier_gradients(spark):
    rng = np.random.default_rng(2)
    layout = byte_cnn.Layout([bytes(rng.integers(32, 122, n, dtype=np.uint8)) for n in (5, 300, 1700)])
    weights = {k: v.astype(np.float64) for k, v in byte_cnn.new_weights().items()}
    weights["filter_bias"] += 0.05  # padding answers 0, where the rectifier has no derivative
    columns, labels = layout.columns().astype(np.float64), np.array([1.0, 0.0, 1.0])

    def loss():
        p = byte_cnn.forward(weights, layout, columns)[0]
        return -np.sum(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    scores, state = byte_cnn.forward(weights, layout, columns)
    grads = byte_cnn.backward(weights, layout, columns, state, scores - labels)
    for name in weights:
        flat, g = weights[name].reshape(-1), grads[name].reshape(-1)
        for i in rng.integers(0, len(flat), 5):
            old = flat[i]
            flat[i] = old + 1e-5
            high = loss()
            flat[i] = old - 1e-5
            low = loss()
            flat[i] = old
            assert (high - low) / 2e-5 == pytest.approx(g[i], rel=0.05, abs=1e-3)


def _classes(rows):
    sets = [shingles(r[1]) for r in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or (total and shared / total >= 0.8 - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    name = {}
    for held in members.values():
        ids = [rows[i][0] for i in held if rows[i][0] is not None]
        for i in held:
            name[i] = min(ids) if ids else None
    return name, links, len(members)


def test_near_duplicate_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_NODES", 2)  # buckets are cut into blocks
    rows = fixture_rows()
    rng = np.random.default_rng(3)
    body = words(rows[29][1]) + [f"w{i}" for i in range(150)]
    for k in range(9):  # a family of near copies, some beyond the threshold from each other
        held = list(body)
        for at in rng.integers(0, len(held), k % 4):
            held[at] = f"x{k}{at}"
        rows.append((500 + k, " ".join(held), "en", "s", 0))
    out = lsh_forest.ngram_classes(frame(spark, rows)).collect()
    name, links, _ = _classes(rows)
    want = Counter((r[0], name[i], links[i]) for i, r in enumerate(rows))
    assert Counter((r.id, r.class_id, r.n_links) for r in out) == want


def test_near_dedup_keeps_one_of_each_class(spark):
    rows = fixture_rows()
    kept = lsh_forest.near_dedup(frame(spark, rows).withColumn("print", F.lit(1))).collect()
    name, _, classes = _classes(rows)
    assert len(kept) == classes and Counter(r.doc_id for r in kept if r.doc_id is not None).most_common(1)[0][1] == 1
    assert {r.doc_id for r in kept} == set(name.values())
    assert lsh_forest.near_dedup(empty(spark)).count() == 0


def test_recall_target_sets_the_prefix():
    assert lsh_forest.least_length(0.8) <= lsh_forest.least_length(0.95) <= lsh_forest.DEPTH
    k = lsh_forest.least_length(0.8)
    assert lsh_forest.meeting_odds(0.8, k) >= lsh_forest.TARGET_RECALL


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=25), max_size=5), st.integers(2, 6), st.integers(0, 7))
def test_compact_windows_hold_every_passage(texts, width, function):
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    values = np.array([x for t in texts for x in t], dtype=np.uint64)
    document, low, c, high, least = compact_windows.compact_windows(values, counts, function, width)
    for d, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + width - 1, len(t)):
                held = [(p, h) for e, a, p, b, h in zip(document, low, c, high, least, strict=True) if e == d and a <= i <= p <= j <= b]
                assert held and len({int(h) for _, h in held}) == 1


def test_passages_are_found_and_clean_documents_left(spark):
    rows = fixture_rows()
    out = compact_windows.near_passages(frame(spark, rows)).collect()
    found = {r.doc_id for r in out} | {r.partner_id for r in out}
    seen = defaultdict(set)
    for i, r in enumerate(rows):
        w = words(r[1])
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    planted = {i for held in seen.values() if len({(rows[i][0], rows[i][1]) for i in held}) > 1 for i in held}
    assert {rows[i][0] for i in planted} <= found
    for r in out:
        assert r.n_words >= 50 and r.jaccard >= 0.8 - 1e-9
        a = [words(x[1]) for x in rows if x[0] == r.doc_id][0][r.start_word : r.start_word + r.n_words]
        b = [words(x[1]) for x in rows if x[0] == r.partner_id][0][r.partner_start : r.partner_start + r.partner_words]
        assert SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.7
    assert compact_windows.near_passages(empty(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 200]), min_size=1, max_size=80), st.sampled_from([0, 4, 1 << 20]), st.sampled_from([0, 300, 1 << 20]))
def test_external_induced_sort(values, in_memory, limit):
    data = bytes(values)
    order, shared = induced_sort.suffix_order(np.frombuffer(data, np.uint8), in_memory=in_memory, limit=limit)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    for a, b, n in zip(want, want[1:], shared[1:].tolist(), strict=False):
        assert data[a : a + n] == data[b : b + n] and (n == induced_sort.CAP or data[a : a + n + 1] != data[b : b + n + 1] or max(a, b) + n == len(data))


def _strings(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), Counter()
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(data[k : k + 100])
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[(rows[i][0], len(data), sum(gone), spans, sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("shard", [1, 6_000_000])
def test_repeated_byte_strings_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rows = fixture_rows()
    rows.append((900, "a" * 700 + rows[10][1] + "a" * 300, "en", "s", 0))
    rows.append((901, rows[-1][1][350:] + rows[-1][1], "en", "s", 0))
    out = suffix_dedup.suffix_dedup(frame(spark, rows).withColumn("spans", F.lit(1))).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == _strings(rows)
    for r in out:
        assert sum(s["high"] - s["low"] for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_repeated_byte_strings_of_no_rows(spark):
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0
