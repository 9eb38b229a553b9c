"""Quality rules: hashed n-gram log-likelihood ratios, in DataFrame operations only.

Two multinomials over hashed unigrams and bigrams are counted: one of trusted target documents, one
of the whole raw corpus.  A document's score is the mean over its n-grams of the log ratio of the
two; the verdict keeps a document whose score reaches a fixed threshold.  Plain counts of words,
symbols, repeated lines and repeated word windows form the base rules.

Counting sends one sum a bucket and task through the shuffle, ids that a bounded filter takes for trusted
ones, and the few texts that a second filter leaves in doubt, which a join tells apart exactly; scoring
shuffles nothing: the ratios are one array of a double a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, packed, text_of, write_table
from tessera.llm.exact_dedup import filter_bits, slot_filter, with_membership

#: Buckets that n-grams of up to ``4 * N_BUCKETS`` documents are hashed to; twice as many for each four times the documents.
N_BUCKETS = 1 << 14
#: Trusted documents that make the target: all of them.
MAX_TRUSTED = math.inf
#: Added to each bucket's count.
SMOOTHING = 0.5
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.25

# Classes name their characters one by one: Java then tests a bit for each character, and a chain of ranges otherwise.
_WORD = r"[^ \t\n\x0b\f\r]+"
_SIGNS = "".join("\\" + chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CONTROLS = "".join(f"\\x{c:02x}" for c in range(33))
_TOKEN = rf"[{_SIGNS}]+|[^{_CONTROLS}{_SIGNS}]+"
_SYMBOLS = "#*$%&|<>"


def bucket_count(n_docs: int) -> int:
    """Buckets for a corpus: they grow with the root of its documents, as distinct words do with the text."""
    count = N_BUCKETS
    while n_docs * N_BUCKETS > 4 * count * count:
        count *= 2
    return count


def _buckets(tokens: str, count: int) -> Column:
    """Buckets, of ``count``, of the unigrams and bigrams of a column of tokens."""
    return F.expr(
        f"concat(transform({tokens}, t -> pmod(xxhash64(t), {count}L)),"
        f" if(size({tokens}) > 1, transform(slice({tokens}, 2, size({tokens}) - 1), (t, i) -> pmod(xxhash64(get({tokens}, i), t), {count}L)), array()))"
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", count: int = N_BUCKETS) -> DataFrame:
    """One row with ``ratios``: the log ratio of target to raw probability of each of ``count`` buckets.

    ``trusted`` names the target documents by ``doc_id``; the raw multinomial counts every document, the
    target every trusted one.  Without any trusted text all ratios are 0.
    """
    given = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).withColumn("print", F.xxhash64("id"))
    ids = trusted.select(F.col(doc_id).cast(given.schema["id"].dataType).alias("trusted_id")).where("trusted_id is not null").distinct()
    bits = filter_bits(ids.count())
    given = with_membership(given, "print", slot_filter(ids.select(F.xxhash64("trusted_id").alias("h")), "h", bits, 1), bits, "maybe")
    # ids alone tell which documents the filter takes for trusted wrongly; a second filter holds those, and only what
    # both filters take in goes through a join with its text
    strangers = given.where("maybe").select("id", "print").join(ids, F.col("id") == F.col("trusted_id"), "left_anti")
    strangers = write_table(strangers.select("print").distinct(), "strangers")
    bits = filter_bits(strangers.count())
    given = with_membership(given, "print", slot_filter(strangers, "print", bits, 1), bits, "doubt")
    met = given.where("maybe and doubt").join(ids, F.col("id") == F.col("trusted_id"), "left")
    marked = met.select(F.col("trusted_id").isNotNull().alias("target"), "text")
    marked = marked.unionByName(given.where("not (maybe and doubt)").select(F.col("maybe").alias("target"), "text"))
    tokens = marked.select("target", F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    grams = tokens.select("target", F.explode(_buckets("tokens", count)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("target").alias("target"))
    every = docs.sparkSession.range(count).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    listed = every.agg(
        F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("b")
    )
    ratio = (
        f"transform(b, x -> if(all_target = 0, 0D, ln((x.target + {SMOOTHING}D) / (all_target + {SMOOTHING * count}D))"
        f" - ln((x.raw + {SMOOTHING}D) / (all_raw + {SMOOTHING * count}D))))"
    )
    return listed.select(F.expr(ratio).alias("ratios"))


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed for a non-null text column."""
    body = F.col(text)
    df = df.withColumn("_words", F.regexp_extract_all(body, F.lit(_WORD), F.lit(0)))
    # Triples are found by hash: the upper 40 bits of a hash and the triple's place share a long, so one
    # sort of longs puts equal triples side by side.  Words are compared wherever hashes agree, and a
    # text with two triples of one hash, or of over 2**24 words, takes the slower way over the strings.
    hashes = (
        "if(size(_words) < 3, array(), transform(slice(_words, 1, greatest(size(_words) - 2, 0)),"
        " (w, i) -> (xxhash64(w, get(_words, i + 1), get(_words, i + 2)) & -16777216L) | i))"
    )
    df = df.withColumn("_hashes", F.expr(hashes))
    tops = "transform(_hashes, h -> shiftright(h, 24))"
    df = df.withColumn("_in_order", F.expr(f"if(size(array_distinct({tops})) = size(_hashes), array(), sort_array(_hashes))"))
    pairs = (
        "filter(transform(_in_order, (h, j) -> if(j > 0 and shiftright(h, 24) = shiftright(get(_in_order, j - 1), 24),"
        " struct(int(get(_in_order, j - 1) & 16777215) as a, int(h & 16777215) as b), null)), x -> x is not null)"
    )
    df = df.withColumn("_pairs", F.expr(pairs))
    equal = " and ".join(f"get(_words, x.a + {k}) = get(_words, x.b + {k})" for k in range(3))
    df = df.withColumn("_clash", F.expr(f"size(_words) > 16777216 or exists(_pairs, x -> not ({equal}))"))
    triples = "transform(slice(_words, 1, size(_words) - 2), (w, i) -> struct(concat_ws(' ', w, get(_words, i + 1), get(_words, i + 2)) as g, i as i))"
    df = df.withColumn("_sorted", F.expr(f"if(_clash, sort_array({triples}), array())"))
    slow = "transform(filter(_sorted, (x, j) -> x.g = get(_sorted, j - 1).g or x.g = get(_sorted, j + 1).g), x -> x.i)"
    fast = "array_distinct(concat(transform(_pairs, x -> x.a), transform(_pairs, x -> x.b)))"
    df = df.withColumn("_places", F.expr(f"sort_array(if(_clash, {slow}, {fast}))"))
    covered = F.expr(
        "aggregate(_places, struct(-3 as last, 0L as n), (s, p) -> struct(p as last, s.n + least(3, p - s.last) as n), s -> s.n)"
    )
    lines = F.expr(rf"filter(split({text}, '\n'), x -> x rlike r'{_WORD}')")
    df = df.withColumn("_lines", lines)
    df = (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.expr("aggregate(_words, 0L, (s, w) -> s + length(w))"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, _SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", covered)
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_words", "_hashes", "_in_order", "_pairs", "_clash", "_sorted", "_places", "_lines")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_grams", "score", "kept")


def quality_rules(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Every row of ``docs`` with the base counts, ``base_failed``, ``n_grams``, ``score`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null text has none and fails the base rules, as does an empty
    one; a text without n-grams scores 0; a text of any length is read whole.  Rows are judged one by one,
    so repeated rows get equal verdicts.  Columns of ``docs`` named like the results are replaced.  An empty table stays empty.
    """
    docs = fresh(docs, *RESULTS)
    count = bucket_count(docs.count())
    ratios = log_ratios(docs, trusted, text, doc_id, count)
    rows = packed(docs, body=text_of(text))
    rows = base_counts(rows, "body")
    rows = rows.withColumn("tokens", F.regexp_extract_all("body", F.lit(_TOKEN), F.lit(0)))
    rows = rows.withColumn("ratios", ratios.scalar()).withColumn("grams", _buckets("tokens", count))
    rows = rows.withColumn("total", F.expr("aggregate(grams, 0D, (s, b) -> s + get(ratios, cast(b as int)))"))
    rows = rows.withColumn("n_grams", F.size("grams").cast("long"))
    rows = rows.withColumn("score", F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams")).otherwise(0.0))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return rows.select("row.*", *RESULTS)
