"""Building the search index holds a bounded amount of sketches, whatever a slice's texts come to."""

import pyarrow.parquet as pq

from peerscope.llm import lexical_search as S
from peerscope.llm.common import WordHashes


def test_entries_leave_in_bounded_lists():
    known = WordHashes()
    rows = [S.indexed(i, " ".join(f"w{i}x{j}" for j in range(100 * i)).encode(), known) for i in range(1, 9)]
    lists = list(S.sent(iter(rows), 20_000))
    assert [r for held in lists for r in held] == rows
    assert len(lists) > 2 and all(len(held) == 1 or sum(len(r[2]) for r in held) <= 20_000 for held in lists)
    assert S.indexed(1, b" .,- ", known) is None


def test_index_is_written_in_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "ROW_GROUP", 1 << 20)
    docs = spark.range(0, 1200, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 600), j -> concat('w', id, 'x', j))) AS text")
    index = S.build_index(docs)
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in index.inputFiles()]
    assert index.count() == 1200 and sum(f.metadata.num_row_groups for f in files) > 1
