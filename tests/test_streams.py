import json

import pytest
from pyspark.sql import functions as F

from citeweave.operators import records
from citeweave.streaming import verdicts

CHECKS = ", ".join(f"{c} boolean" for c in records.JUDGE_CHECKS)
SCHEMA = f"item string, pass_no int, decision string, reason string, confidence double, score double, {CHECKS}, ts timestamp"


def line(item, number, minute, decision="PASS", score=8.0, confidence=0.9):
    row = {"item": item, "pass_no": number, "decision": decision, "reason": None if decision == "PASS" else "QP_UNDER_SPEC", "confidence": confidence, "score": score}
    return row | {c: (number + k) % 2 == 0 for k, c in enumerate(records.JUDGE_CHECKS)} | {"ts": f"2024-01-01T00:{minute:02d}:00Z"}


def put(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def judge(spark, folder, tmp_path, expected=3, wait="5 minutes", delay="1 minute"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    verdicts.judged(stream, str(tmp_path / "sink"), str(tmp_path / "ck"), expected, wait=wait, delay=delay).awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "sink")).drop("batch").collect())


def test_streamed_verdicts_equal_those_of_a_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    passes = [line(f"i{k}", n, k % 5 + n, "PASS" if (k + n) % 3 else "DROP", float(k % 11), 0.1 * (1 + (k * n) % 9)) for k in range(20) for n in (1, 2, 3)]
    # a third of the passes at a time, in another order, some repeated; then a call that finds nothing, and stragglers
    for part in range(3):
        rows = passes[part::3][:: 1 if part % 2 else -1]
        put(folder, f"{part}.json", rows + rows[:4])
    late = {"wait": "1 hour", "delay": "1 hour"}  # passes may be as late as that
    first = judge(spark, folder, tmp_path, **late)
    assert judge(spark, folder, tmp_path, **late) == first
    put(folder, "again.json", passes[:9])
    again = judge(spark, folder, tmp_path, **late)
    table = spark.read.schema(SCHEMA).json(str(folder)).dropDuplicates(["item", "pass_no"])
    assert again == first == sorted(tuple(r) for r in records.judge_verdicts(table).collect()) and len(first) == 20
    assert any(r[8] for r in first) or len({r[1] for r in first}) == 2


def test_items_that_wait_too_long_are_judged_as_they_are(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "0.json", [line("slow", 1, 1), line("slow", 2, 1), line("whole", 1, 1), line("whole", 2, 1), line("whole", 3, 1)])
    assert [r[0] for r in judge(spark, folder, tmp_path, wait="9 minutes")] == ["whole"]
    put(folder, "1.json", [line("later", 1, 30)])
    put(folder, "2.json", [line("later", 2, 31)])
    found = judge(spark, folder, tmp_path, wait="9 minutes")
    assert [(r[0], r[3]) for r in found] == [("slow", 2), ("whole", 3)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    src, sink = tmp_path / "src", tmp_path / "sink"
    src.mkdir()
    (src / "a.json").write_text('{"k": 1}\n{"k": 1}\n{"k": 2}\n')
    calls = []

    def fails_once(rows):
        calls.append(1)
        rows.write.mode("overwrite").parquet(str(sink / "batch=0"))
        if len(calls) == 1:
            raise RuntimeError("lost after the write")
        return rows

    stream = lambda: spark.readStream.schema("k long").json(str(src)).dropDuplicates(["k"])
    with pytest.raises(Exception, match="lost after the write"):
        verdicts.append_batches(stream(), str(sink), str(tmp_path / "ck"), fails_once).awaitTermination()
    verdicts.append_batches(stream(), str(sink), str(tmp_path / "ck")).awaitTermination()
    (src / "b.json").write_text('{"k": 2}\n{"k": 3}\n')
    verdicts.append_batches(stream(), str(sink), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(sink)).select(F.col("k")).collect()) == [1, 2, 3]
