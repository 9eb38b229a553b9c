"""What the LSH forest join sends through shuffles and keeps on disk."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lsh_forest
from tests.llm.helpers import fixture_rows, frame


def test_signatures_of_all_nodes_and_shingles_stay_out_of_tables(spark, monkeypatch):
    written = {}

    def write(df, name, real=lsh_forest.write_table):
        written.setdefault(name, set()).update(df.dtypes)
        return real(df, name)

    monkeypatch.setattr(lsh_forest, "write_table", write)
    assert lsh_forest.ngram_classes(frame(spark)).count() == len(fixture_rows())
    assert ("signature", "binary") not in written["nodes"] and all(("shingles", "binary") not in columns for columns in written.values())


def test_texts_and_entries_go_through_one_shuffle(spark, monkeypatch):
    plans = {}

    def write(df, name, real=lsh_forest.write_table):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(lsh_forest, "write_table", write)
    lsh_forest.ngram_classes(frame(spark))
    assert plans["company"].count("Join") == 0  # entries are not joined with the places that they make


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_prints_beside_others_over_all_cuts_of_batches(size):
    rng = np.random.default_rng(size)
    rows = sorted(zip(rng.integers(-90, 90, 400).tolist(), rng.integers(-5, 500, 400).tolist(), strict=True))
    rows = sorted(rows + [(200, 7)] * 20 + [(201, 1001)] * 9 + [(201, 1002)] * 9)
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size], strict=True)], names=["place", "print"]) for i in range(0, len(rows), size)]
    found = {p for batch in lsh_forest._companions(iter(batches)) for p in batch.column(0).to_pylist()}
    at = {}
    for place, mark in rows:
        at.setdefault(place, set()).add(mark)
    assert found == set().union(*(marks for marks in at.values() if len(marks) > 1))
