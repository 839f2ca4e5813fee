import pyarrow as pa

from codicil.llm import leakage
from codicil.llm.batches import by_size


def test_slices_cover_all_rows_in_order():
    texts = ["a" * n for n in (5, 0, 3, 100, 2, 2, 2)] + [None, "b" * 50]
    batch = pa.RecordBatch.from_pydict({"i": list(range(9)), "t": texts})
    parts = [b.column("i").to_pylist() for b in by_size(batch, "t", 10, 3)]
    assert [x for p in parts for x in p] == list(range(9))
    assert [3] in parts and [8] in parts and max(map(len, parts)) <= 3
    assert list(by_size(batch.slice(0, 0), "t")) == []


class Sent:
    """A broadcast value."""

    def __init__(self, value):
        self.value = value


def test_parts_of_a_long_text_and_groups_of_documents_find_the_same(monkeypatch):
    words = [f"w{i % 37}" for i in range(400)]
    hashes = leakage.WordHashes()
    items = [("x", hashes.of(words[50:120]), 13), ("y", hashes.of(words[5:30]), 13)]
    docs = pa.RecordBatch.from_pydict({"d": [1, 2, 3, 4], "t": [" ".join(words), " ".join(words[:20]), None, " ".join(f"v{i}" for i in range(60))]})

    def found(blocks):
        run = leakage._match("d", "t", [Sent(b) for b in blocks], 0.8, 5, False, False, pa.string())
        return sorted(tuple(r.values()) for b in run(iter([docs])) for r in b.to_pylist())

    whole = found([leakage.Block(items, 5, 2)])
    assert {r[:2] for r in whole} == {(1, "x"), (1, "y"), (2, "y"), (2, "x")}
    for step, group in ((1, 10), (7, 100), (50, 10_000)):
        monkeypatch.setattr(leakage, "_STEP", step)
        monkeypatch.setattr(leakage, "_GROUP_WORDS", group)
        assert found([leakage.Block(items, 5, 2)]) == found([leakage.Block(items[:1], 5, 2), leakage.Block(items[1:], 5, 2)]) == whole
