"""Sharding, quality rules, mixing and exact deduplication."""

from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import exact_dedup, filter_bits
from tessera.llm.mixing import poisson_mix, source_rates
from tessera.llm.quality_rules import MAX_TRUSTED, quality_rules
from tessera.llm.sharding import stratified_shards
from tests.llm.helpers import SPACE, empty, fixture_rows, frame, words


def test_shards_are_even_gapless_and_match_the_mixture(spark):
    rows = stratified_shards(frame(spark), 5).collect()
    assert len(rows) == len(fixture_rows())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert sorted(slots) == list(range(5)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    by = Counter((r.source, r.shard) for r in rows)
    for source, n in Counter(r.source for r in rows).items():
        counts = [by[source, s] for s in range(5)]
        assert max(abs(c - n / 5) for c in counts) < 2


def test_shards_do_not_depend_on_partitions(spark):
    rows = [r for r in fixture_rows() if r[0] is not None][:-1]
    rows = list({r[0]: r for r in rows}.values())
    one = {(r.doc_id, r.shard, r.slot) for r in stratified_shards(frame(spark, rows).coalesce(1), 4).collect()}
    many = {(r.doc_id, r.shard, r.slot) for r in stratified_shards(frame(spark, rows).repartition(5), 4).collect()}
    assert one == many


def test_shards_of_an_empty_table_and_clashing_names(spark):
    assert stratified_shards(empty(spark), 3).count() == 0
    clash = frame(spark).withColumns({"shard": F.lit("x"), "row": F.lit(1), "bucket": F.lit(2), "rank": F.lit(3)})
    out = stratified_shards(clash, 3)
    assert dict(out.dtypes)["shard"] == "int" and {"row", "bucket", "rank"} <= set(out.columns)
    assert out.count() == len(fixture_rows())


def _base(text):
    w = words(text)
    counts = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if counts[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_rules_match_brute_force(spark):
    import math
    import re

    from tessera.llm import quality_rules as Q

    rows = [(i, r[1]) for i, r in enumerate(fixture_rows())]
    rows += [(100, "spam !! " * 60), (101, "a b c\na b c\n\nx | y\nx | y"), (102, "w " * 49), (103, "one two three four " * 20), (104, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(20)] + [(None,), (5,), (999,)], "doc_id long")
    got = {r.doc_id: r for r in quality_rules(docs, trusted).collect()}

    def grams(text):
        t = [x.encode() for x in re.findall(Q._TOKEN, text or "")]

        def signed(x):
            return x - (1 << 64) if x >> 63 else x

        h = [signed(xxhash.xxh64_intdigest(x, seed=42)) % Q.N_BUCKETS for x in t]
        two = [signed(xxhash.xxh64_intdigest(b, seed=xxhash.xxh64_intdigest(a, seed=42))) % Q.N_BUCKETS for a, b in zip(t, t[1:], strict=False)]
        return h + two

    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(grams(text))
        if i < 20:
            target.update(grams(text))
    n, m = raw.total() + Q.SMOOTHING * Q.N_BUCKETS, target.total() + Q.SMOOTHING * Q.N_BUCKETS
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(text)
        g = grams(text)
        score = sum(math.log((target[b] + Q.SMOOTHING) / m) - math.log((raw[b] + Q.SMOOTHING) / n) for b in g) / len(g) if g else 0.0
        assert r.score == pytest.approx(score, abs=1e-9) and r.n_grams == len(g)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and score >= Q.THRESHOLD)
    assert MAX_TRUSTED > 0


def test_quality_rules_without_trusted_texts_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b " * 40), (2, None)], "doc_id long, text string").withColumn("kept", F.lit("old"))
    rows = {r.doc_id: r for r in quality_rules(docs, docs.where("false")).collect()}
    assert rows[1].score == 0.0 and rows[2].n_words == 0 and rows[2].kept is False
    assert quality_rules(docs.where("false"), docs).count() == 0


def test_mixing_reaches_its_rates_and_repeats_itself(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 9}", 1) for i in range(3000)]
    docs = frame(spark, rows)
    rates = {r.stratum: r.rate for r in source_rates(docs).collect()}
    sizes = Counter(r[3] for r in rows)
    weight = {s: n**0.5 for s, n in sizes.items()}
    for s, n in sizes.items():
        assert rates[s] == pytest.approx(3000 * weight[s] / sum(weight.values()) / n)
    out = poisson_mix(docs).collect()
    again = poisson_mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.copy) for r in out) == sorted((r.doc_id, r.copy) for r in again)
    got = Counter(r.source for r in out)
    for s, n in sizes.items():
        expected = rates[s] * n
        assert abs(got[s] - expected) < 5 * expected**0.5
    copies = defaultdict(list)
    for r in out:
        copies[r.doc_id].append((r.copy, r.copies))
    assert all(sorted(c for c, _ in v) == list(range(v[0][1])) for v in copies.values())


def test_mixing_awkward_rows(spark):
    out = poisson_mix(frame(spark).withColumn("copy", F.lit("old")), {"src0": 1.0, "src1": 3.0}, total=200.0)
    assert {r.source for r in out.select("source").distinct().collect()} <= {"src0", "src1"}
    assert dict(out.dtypes)["copy"] == "int" and 100 < out.count() < 320
    assert poisson_mix(empty(spark)).count() == 0
    counts = [r.n for r in poisson_mix(frame(spark)).where("doc_id is null").groupBy("copies").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) <= 1  # repeated rows get equal counts


def _exact(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[SPACE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    return {k: (sorted(v)[0], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("partitions", [1, 6])
def test_exact_dedup_matches_brute_force(spark, partitions):
    rows = fixture_rows()
    out = exact_dedup(frame(spark).repartition(partitions).withColumn("kept", F.lit("old"))).collect()
    want = _exact(rows)
    assert len(out) == len(rows)
    kept = Counter()
    for r in out:
        best, n = want[SPACE.sub("", r.text or "")]
        assert r.group_size == n and r.keep_id == (None if best[1] else best[2])
        kept[SPACE.sub("", r.text or "")] += r.kept
        if r.kept:
            assert r.doc_id == r.keep_id and len(r.text or "") == -best[0]
    assert all(kept[k] == 1 for k in want)


def test_exact_dedup_edges(spark):
    assert exact_dedup(empty(spark)).count() == 0
    assert filter_bits(1) < filter_bits(10**6) == filter_bits(10**12) // 4
