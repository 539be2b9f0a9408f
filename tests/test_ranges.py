"""Files read by byte ranges of any length, against reading them whole."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ramus.sources import files as S
from ramus.sources import ranges as R

PATTERNS = {"space": rb"[^ \t\r\n\x00]+", "not_alphanum": rb"[A-Za-z0-9]+", "not_alpha": rb"[A-Za-z]+"}


@pytest.mark.parametrize("entries", [1, 7, 1000])
def test_csr(spark, tmp_path, monkeypatch, entries):
    """Empty rows at both ends and in runs, a row over many ranges, one entry to a task."""
    r = random.Random(3)
    degree = [0, 0, 3, 0, 17, 1, 0, 0, 0, 2, 1, 0]
    targets = [r.randrange(12) for _ in range(sum(degree))]
    path = tmp_path / "g.bin"
    path.write_bytes(np.array([12, 12, len(targets), 0, *np.cumsum(degree), *targets], "<i4").tobytes())
    got = R.csr_by_ranges(spark, str(path), entries)
    assert got.select(F.spark_partition_id()).distinct().count() == -(-len(targets) // entries)
    assert sorted(got.collect()) == sorted(S.read_binary_csr(spark, str(path)).collect()) and got.count() == 24


def test_csr_in_small_blocks_of_starts(tmp_path, monkeypatch):
    monkeypatch.setattr(R, "STARTS", 2)
    monkeypatch.setattr(R, "BATCH", 3)
    degree = [0, 4, 0, 0, 0, 5, 1, 0]
    path = tmp_path / "g.bin"
    path.write_bytes(np.array([8, 8, 10, 0, *np.cumsum(degree), *range(10)], "<i4").tobytes())
    reader = R.CsrReader({"path": str(path), "entries": "4"})
    got = [(u, v) for p in reader.partitions() for b in reader.read(p) for u, v in zip(*(c.to_pylist() for c in b.columns))]
    assert got == list(zip(np.repeat(range(8), degree).tolist(), range(10)))


def test_csr_of_no_rows_and_short_files(spark, tmp_path):
    (tmp_path / "none.bin").write_bytes(np.array([0, 0, 0, 0], "<i4").tobytes())
    assert R.csr_by_ranges(spark, str(tmp_path / "none.bin")).count() == 0
    (tmp_path / "short.bin").write_bytes(np.array([2, 2, 5, 0, 2, 5, 1], "<i4").tobytes())
    with pytest.raises(Exception, match="shorter"):
        R.csr_by_ranges(spark, str(tmp_path / "short.bin")).count()


@pytest.mark.parametrize("separators", list(PATTERNS))
def test_words(tmp_path, monkeypatch, separators):
    """Ranges of 1 to 60 bytes cut words and characters; tails are read in pieces of two bytes."""
    monkeypatch.setattr(R, "BATCH", 2)
    text = "a bc  déjà-vu\tx1y2\n\n" + "long" * 9 + " 7 \x00z,é end".encode().decode()
    data = text.encode()
    path = tmp_path / "w.txt"
    path.write_bytes(data)
    for share in (1, 2, 3, 5, 8, 60):
        for first, last in ((0, None), (3, 40), (50, 50), (0, 1000)):
            options = {"path": str(path), "separators": separators, "bytes": str(share), "first": str(first)} | ({"last": str(last)} if last is not None else {})
            reader = R.WordReader(options)
            got = [(at, w) for p in reader.partitions() for b in reader.read(p) for at, w in zip(*(c.to_pylist() for c in b.columns))]
            part = data[first : len(data) if last is None else last]
            assert got == [(first + m.start(), m[0].decode("utf-8", "replace")) for m in re.finditer(PATTERNS[separators], part)], (share, first, last)


def test_words_by_tasks(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text("one two\nthree  four five")
    rows = R.words_by_ranges(spark, str(path), share=4)
    assert [r.word for r in rows.orderBy("at").collect()] == [r.token for r in S.tokens(spark, str(path)).orderBy("pos").collect()]
    with pytest.raises(Exception, match="separators"):
        R.words_by_ranges(spark, str(path), separators="comma").count()
