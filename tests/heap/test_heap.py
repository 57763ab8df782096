"""The stored heap: batches, reopening, compaction, conflicts, crashes, and a model."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.config import HeapConfig
from tessera.heap import Heap
from tessera.kv import KeyValue
from tessera.sources.manifest import CommitConflict

MIB = b"\xfa" * (1 << 20)
D = None
#: Batches, R (reopen) and M (maintenance), and other settings than the default.
CASES = {
    "one empty object": ([{1: b""}, "R"], {}),
    "two batches": ([{1: b""}, {2: b""}, "R", "M"], {}),
    "only deletes": ([{1: D}, "M", {1: D}, "M", {1: D}, "M", {1: D}, "R"], {}),
    "tiny target": ([{1: bytes([170] * 3)}, {2: bytes([1])}, {3: bytes([5] * 5)}, "R", "M"], {"target_file_size": 1}),
    "overwritten": ([{1: b"", 2: D, 3: D}, {1: D, 3: b"123456789"}, {1: D}, "M"], {"target_file_size": 6400, "file_compaction_percent": 55, "fsync_each_batch": True}),
    "shrinking": ([{1: b"", 2: b"", 3: b""}, {1: b"", 2: b""}, {1: b""}, "M", "M"], {}),
    "large objects": ([{i: MIB for i in range(1, 9)}, "R", "M"], {}),
    "mixed": ([{}, {1: b"", 2: b"", 3: b"", 4: D, 5: b"\0", 6: b"\xfc", 7: D, 8: b"", 9: b"abcdef"}], {}),
    "many deletes": ([{56: D, 46: D}, {46: D, 55: D, 50: D, 60: b"abcd"}, {60: b"abcdefgh", 37: D}, {37: D, 0: D}, "M", "R"], {"target_file_size": 247, "file_compaction_percent": 55}),
}


def settings(tmp_path, **more):
    return HeapConfig(path=str(tmp_path / "heap"), **more)


def contents(heap):
    return {r["object_id"]: bytes(r["payload"]) for r in heap.snapshot().read_all().collect()}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, tmp_path, name):
    steps, more = CASES[name]
    config, model = settings(tmp_path, **more), {}
    heap = config.open(spark)
    for step in steps:
        if step == "R":
            heap = config.open(spark)
        elif step == "M":
            heap.maintenance()
        else:
            heap.write_batch(step.items())
            model |= step
        assert contents(heap) == {k: v for k, v in model.items() if v is not None}
    heap.snapshot().verify()


def test_ids_and_versions(spark, tmp_path):
    heap = Heap.open(spark, str(tmp_path / "h"))
    n, free = heap.snapshot().free_object_ids()
    assert n == 1 and [r[0] for r in free.collect()] == [0]
    v = heap.write_batch([(1, b"a"), (3, None), (1, b"b")])
    old = heap.snapshot()
    heap.write_batch([(1, None), (1 << 63, b"x")])
    assert heap.read(1) is None and old.read(1) == b"b" and heap.snapshot(v).read(1) == b"b"
    assert heap.read(1 << 63) == b"x" and heap.snapshot().next_object_id() == (1 << 63) + 1
    assert {r[0] for r in old.free_object_ids()[1].collect()} == {0, 2}
    assert {r[0] for r in heap.snapshot().deleted_object_ids().collect()} == {1, 3}
    ids = spark.createDataFrame([(1,), (2,)], "object_id long")
    assert {tuple(r) for r in old.read_many(ids).select("object_id", F.col("payload").cast("string")).collect()} == {(1, "b"), (2, None)}


def test_limits(spark, tmp_path):
    for bad in ({"target_file_size": 0}, {"file_compaction_percent": 100}):
        with pytest.raises(ValueError):
            HeapConfig(**bad)
    heap = settings(tmp_path, max_object_size=3).open(spark)
    heap.write_batch([(1, b"abc")])
    with pytest.raises(ValueError):
        heap.write_batch([(2, b"x"), (3, b"abcd")])
    assert contents(heap) == {1: b"abc"}


def test_maintenance_converges(spark, tmp_path):
    heap = settings(tmp_path, small_file_cleanup_threshold=2).open(spark)
    for i in range(5):
        heap.write_batch([(k, bytes([i, k])) for k in range(i, 8)])
    before = contents(heap)
    moved = heap.maintenance()
    s = heap.stats().first()
    assert moved == 8 and s["files"] == 1 and s["live_objects"] == s["stored_objects"] == 8 and contents(heap) == before
    assert heap.maintenance() == 0
    assert heap.vacuum() == 5 and contents(heap) == before


def test_commit_rules(spark, tmp_path):
    heap, other = (settings(tmp_path).open(spark) for _ in range(2))
    assert heap.write_batch([(1, b"a")], txn="t") == 0 and other.write_batch([(1, b"b")], txn="t") is None
    assert other.write_batch([(2, b"b")]) == 1 and contents(heap) == {1: b"a", 2: b"b"}
    name = next(iter(heap.manifest.state().files))
    heap.manifest.commit([], [name])
    with pytest.raises(CommitConflict):
        other.manifest.commit([], [name])


def test_crash_before_commit_shows_nothing(spark, tmp_path, monkeypatch):
    heap = settings(tmp_path).open(spark)
    heap.write_batch([(i, b"old") for i in range(14)])
    monkeypatch.setattr(heap.manifest, "commit", lambda *a, **b: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        heap.write_batch([(i, b"new") for i in range(14)])
    again = settings(tmp_path).open(spark)
    assert set(contents(again).values()) == {b"old"}
    assert again.vacuum() == 1


def test_checkpoints(spark, tmp_path):
    from tessera.sources.manifest import DataFile, Manifest

    m = Manifest(spark, str(tmp_path / "m"))
    for i in range(45):
        m.commit([DataFile(f"f{i}", None, 0, 0, 1, 1, False)], [f"f{i - 1}"] if i else [])
    assert list(m.state().files) == ["f44"] and m.state().version == 44 and list(m.state(30).files) == ["f30"]


def test_model(spark, tmp_path):
    rng = random.Random(5)
    for run in range(2):
        config = settings(tmp_path / str(run), target_file_size=rng.randint(1, 200), file_compaction_percent=rng.randint(0, 99), small_file_cleanup_threshold=3)
        heap, model = config.open(spark), {}
        for _ in range(6):
            op = rng.choice(["write", "write", "gc", "restart"])
            if op == "write":
                batch = [(rng.randint(0, 32), None if rng.random() < 0.3 else rng.randbytes(rng.randint(0, 16))) for _ in range(rng.randint(0, 16))]
                heap.write_batch(batch)
                model |= dict(batch)
            elif op == "gc":
                heap.maintenance()
            else:
                heap = config.open(spark)
            assert contents(heap) == {k: v for k, v in model.items() if v is not None}


def bits(i):
    return i - (1 << 64) if i >> 63 else i


def test_free_ids_of_all_unsigned_ids(spark, tmp_path):
    from tessera.operators import versions

    def ranges(ids):
        df = spark.createDataFrame([(bits(i),) for i in ids], "object_id long")
        return versions.free_ids(df), sorted((r["first"] % 2**64, r["last"] % 2**64) for r in versions.free_ranges(df).collect()), versions.next_object_id(df).first()[0]

    some = [0, 1 << 47, 1 << 60, 1 << 63, (1 << 64) - 1]
    _, got, after = ranges(some)
    assert got == [(a + 1, b - 1) for a, b in zip(some, some[1:], strict=False)] and after is None
    free, got, after = ranges([3, 70_000, 70_002])
    assert sorted(r[0] for r in free.collect()) == sorted(set(range(70_003)) - {3, 70_000, 70_002}) and after == 70_003
    edge = (1 << 63) - 3
    _, got, after = ranges([*range(3), edge, edge + 8])
    assert got == [(3, edge - 1), (edge + 1, edge + 7)] and after == bits(edge + 9)
    assert ranges([])[1:] == ([(0, 0)], 1)
    heap = Heap.open(spark, str(tmp_path / "h"))
    heap.write_batch([(0, b""), ((1 << 64) - 2, b"x")])
    assert heap.snapshot().next_object_id() == (1 << 64) - 1 and heap.read((1 << 64) - 2) == b"x"


def test_log_of_batches(spark, tmp_path):
    heap = settings(tmp_path, min_compaction_files=2, small_file_cleanup_threshold=2).open(spark)
    rows = [(b, i, None if (b + i) % 5 == 0 else bytes([b, i]), 10 * b + i) for b in range(6) for i in range(b, 8)] + [(2, 3, b"newer", 99)]
    log = spark.createDataFrame(rows, "batch_no long, object_id long, payload binary, seq long")
    assert heap.write_log(log, txn=("loader", 4)) == 0 and heap.write_log(log, txn=("loader", 3)) is None and heap.write_log(log.limit(0)) is None
    model = {}
    for _, i, p, _ in sorted(rows, key=lambda r: (r[0], r[3])):
        model[i] = p
    assert contents(heap) == {i: p for i, p in model.items() if p is not None}
    assert heap.snapshot().liveness().count() == 6 and len(heap.manifest.data_names()) == 1
    heap.write_batch([(0, b"last")])
    before = contents(heap)
    assert heap.maintenance() == 8 and contents(heap) == before and before[0] == b"last"
    assert set(heap.snapshot().broken_invariants().values()) == {0}
    assert heap.vacuum() == 2 and contents(heap) == before
    with pytest.raises(ValueError):
        settings(tmp_path, max_object_size=3).open(spark).write_log(log)


def test_invariants_are_found_broken(spark, tmp_path):
    heap = settings(tmp_path).open(spark)
    heap.write_batch([(1, b"abc"), (2, b"x")])
    name = next(iter(heap.manifest.state().files))
    spark.createDataFrame([(1, False, bytearray(b"abd"), 3, 5, None)], "object_id long, is_delete boolean, payload binary, size long, crc long, commit_seq long").write.mode("append").parquet(f"{heap.root}/data/{name}")
    got = heap.snapshot().broken_invariants()
    assert got == {"stored_twice": 1, "without_file": 0, "wrong_counts": 1, "corrupt": 1}


def test_writers_and_maintenance_at_once(spark, tmp_path):
    from threading import Thread

    config = settings(tmp_path, small_file_cleanup_threshold=2)
    failed = []

    def write(k):
        heap = config.open(spark)
        try:
            for n in range(3):
                heap.write_batch([(i, bytes([k, n])) for i in range(14)] + [((1 << 64) - 1, bytes([k, n]))])
        except Exception as e:  # told to the test below
            failed.append(e)

    def tidy():
        heap = config.open(spark)
        try:
            for _ in range(3):
                heap.maintenance()
        except Exception as e:
            failed.append(e)

    threads = [Thread(target=write, args=(k,)) for k in range(2)] + [Thread(target=tidy)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed
    heap = config.open(spark)
    got = contents(heap)
    assert len(got) == 15 and len(set(got.values())) == 1 and next(iter(got.values()))[1] == 2  # whole batches, and one writer's last
    heap.maintenance()
    assert contents(heap) == got and set(heap.snapshot().broken_invariants().values()) == {0}


def test_versions_where_files_cannot_be_linked(spark, tmp_path):
    from tessera.sources.manifest import DataFile, Manifest

    a, b = (Manifest(spark, f"file://{tmp_path}/m") for _ in range(2))
    a.local = b.local = None  # as in a store that only Hadoop's interface reaches
    assert a._create("x.json", {"n": 1}) and not b._create("x.json", {"n": 2}) and a._read("x.json") == {"n": 1}
    for i in range(22):
        (a, b)[i % 2].commit([DataFile(f"f{i}", None, 0, 0, 1, 1, False)], txn=("w", i))
    s = b.state()
    assert len(s.files) == 22 and s.txns == {"w": 21} and s.seq == 21 and a.commit([], txn=("w", 5)) is None
    assert not list((tmp_path / "m" / "_staged").glob("*.json"))


def test_running_values_over_partitions(spark):
    from tessera.operators.ordered import last_up_to, sum_before

    rng = random.Random(3)
    rows = [(k, rng.randint(0, 9), rng.choice([None, k])) for k in rng.sample(range(1000), 300)]
    df, at = spark.createDataFrame(rows, "k long, v long, x long"), {}
    total, last = 0, None
    for k, v, x in sorted(rows):
        at[k] = total, last if x is None else x, last
        total, last = total + v, last if x is None else x
    assert {r["k"]: r["s"] for r in sum_before(df, ["k"], "v", "s").collect()} == {k: a for k, (a, _, _) in at.items()}
    assert {r["k"]: r["y"] for r in last_up_to(df, ["k"], "x", "y").collect()} == {k: b for k, (_, b, _) in at.items()}
    assert {r["k"]: r["y"] for r in last_up_to(df, ["k"], "x", "y", before=True).collect()} == {k: c for k, (_, _, c) in at.items()}
    assert sum_before(df.limit(0), ["k"], "v", "s").count() == 0


def test_ordered_key_values(spark, tmp_path):
    kv = KeyValue(Heap.open(spark, str(tmp_path / "kv")))
    rows = [(n // 10, bytes([97 + n % 7]) * (n % 3 + 1), None if n % 6 == 0 else bytes([n]), n) for n in range(40)]
    kv.put_log(spark.createDataFrame(rows, "batch_no long, key binary, value binary, seq long"))
    model = {k: v for _, k, v, _ in rows}
    live = sorted((k, v) for k, v in model.items() if v is not None)
    pairs = lambda df: [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]
    assert pairs(kv.items()) == live and pairs(kv.items(b"b", b"dd")) == [x for x in live if b"b" <= x[0] < b"dd"]
    assert kv.floor(b"cz") == max(x for x in live if x[0] <= b"cz") and kv.floor(b"") is None
    asked = spark.createDataFrame([(k,) for k in [*model, b"none"]], "key binary")
    assert {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in kv.get_many(asked).collect()} == {**model, b"none": None}
    assert kv.set(live[0][0], b"new") == live[0][1] and kv.get(live[0][0]) == b"new"


def test_key_value(spark, tmp_path):
    kv = KeyValue(Heap.open(spark, str(tmp_path / "kv")))
    assert kv.set(b"yo", b"hi") is None and kv.get(b"yo") == b"hi"
    assert kv.remove(b"yo") == b"hi" and kv.get(b"yo") is None
    kv.set(b"yo", b"again")
    assert KeyValue(Heap.open(spark, str(tmp_path / "kv"))).get(b"yo") == b"again"
