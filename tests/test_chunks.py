import random
import time
from datetime import timedelta

from tidelog.streaming import chunks
from tidelog.streaming.batches import run_to_end


def land(spark, rows, folder):
    spark.createDataFrame(rows, chunks.CHUNKS).coalesce(1).write.mode("append").parquet(folder)


def test_bodies_and_lines_over_batches(spark, tmp_path):
    texts = {1: b"ab\ncd\nef\n", 2: b"", 3: b"no line end", 4: "é\n\n漢".encode() * 9, 5: b"\n"}
    rows = []
    for seq, data in texts.items():
        parts = [data[n : n + 3] for n in range(0, len(data), 3)] or [b""]
        rows += [(seq, n, part, n == len(parts) - 1) for n, part in enumerate(parts)]
    rows += [rows[0], (9, 1, b"never whole", True)]
    random.Random(3).shuffle(rows)
    for n in range(0, len(rows), 12):
        land(spark, rows[n : n + 12], str(tmp_path / "in"))

    def run(lines):
        out = str(tmp_path / f"out-{lines}")
        stream = spark.readStream.schema(chunks.CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run_to_end(chunks.start_assembly(stream, out, f"{out}-check", lines=lines, available_now=True))
        return chunks.read_assembled(spark, out).orderBy("seq_id", "part_no").collect()

    assert {r.seq_id: bytes(r.bytes) for r in run(False) if r.complete and r.ended} == texts
    got = run(True)
    for seq, data in texts.items():
        own = [r for r in got if r.seq_id == seq]
        assert [bytes(r.bytes) for r in own] == data.splitlines(True) and [r.part_no for r in own] == list(range(len(own)))
        assert [r.ended for r in own] == [n == len(own) - 1 for n in range(len(own))]


def test_a_reply_that_stops_is_given_up(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, [(1, 0, b"begun ", False), (1, 2, b"behind a gap", True)], folder)
    stream = spark.readStream.schema(chunks.CHUNKS).parquet(folder)
    query = chunks.start_assembly(stream, out, str(tmp_path / "check"), wait=timedelta(milliseconds=10))
    until = time.time() + 40
    while time.time() < until and not (got := chunks.read_assembled(spark, out).collect()):
        time.sleep(1)
    query.stop()
    assert [(r.seq_id, bytes(r.bytes), r.ended, r.complete) for r in got] == [(1, b"begun ", True, False)]
