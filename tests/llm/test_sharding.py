"""The lookup table is even and stable, and placement follows it."""

import pytest

from errata.llm import sharding as sh


def test_even_and_complete():
    table = sh.fill(sh.SHARDS)
    sizes = [table.count(k) for k in range(len(sh.SHARDS))]
    assert len(table) == sh.TABLE_SIZE and max(sizes) - min(sizes) <= 1


def test_turns_by_preference():
    """Against the definition, step by step, with whole permutations written out."""
    names, size = ["a", "b", "c"], 13
    table = [None] * size
    prefs = [[(sh._hash(f"offset:{n}") + j * (1 + sh._hash(f"step:{n}") % (size - 1))) % size for j in range(size)] for n in names]
    k = 0
    while None in table:
        table[next(s for s in prefs[k % 3] if table[s] is None)] = k % 3
        k += 1
    assert sh.fill(names, size) == table


def test_removing_a_shard_moves_little():
    before = sh.fill(sh.SHARDS)
    after = sh.fill(sh.SHARDS[:-1])
    gone = len(sh.SHARDS) - 1
    moved = sum(a != b for a, b in zip(before, after) if a != gone)
    assert moved <= 0.15 * sh.TABLE_SIZE


def test_weights():
    table = sh.fill(["a", "b", "c"], 1009, [3, 1, 0])
    assert abs(table.count(0) - 3 * table.count(1)) <= 4 and table.count(2) == 0


def test_bad_arguments():
    for args in (["a"], 12), ([], 13), (["a", "a"], 13), (["a"], 13, [0]):
        with pytest.raises(ValueError):
            sh.fill(*args)


def test_placement(spark):
    rows = [(k, f"t{k % 5}") for k in range(2000)] + [(None, "x"), (None, "x"), (None, None), (5, "other")]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, slot int, shard string")
    got = sh.place(df, sh.SHARDS).collect()
    assert len(got) == len(rows)
    table = sh.fill(sh.SHARDS)
    for r in got:
        key = str(r.row.doc_id) if r.row.doc_id is not None else f"text:{r.row.text or ''}"
        assert r.slot == sh._hash(key) % sh.TABLE_SIZE
        assert r.shard == sh.SHARDS[table[r.slot]]
    assert sh.place(df.limit(0), sh.SHARDS).count() == 0
