"""Writers that race, logs of segments, and chain verification as a stream."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from ledgerloom.operators import decisions
from ledgerloom.sources import decision_writer
from ledgerloom.streaming import decision_log

SEEN = {"statement_id": "s", "row": 1, "charge_cents": -500, "receipt_cents": None, "verdict": "unchecked", "duplicate_of": None}


def _write(how, path, who):
    for i in range(15):
        getattr(decision_writer, how)(path, SEEN | {"row": who * 100 + i}, "ignore", actor="human", note="ü" * i)


@pytest.mark.parametrize("how", ["record", "record_segment"])
def test_writers_that_race_never_fork_the_chain(spark, tmp_path, how):
    path = str(tmp_path / ("log.jsonl" if how == "record" else "log"))
    # Locks and links hold between open files, whichever process has them.
    with ThreadPoolExecutor(4) as writers:
        list(writers.map(lambda w: _write(how, path, w), range(4)))
    log = decisions.read_log(spark, path) if how == "record" else decisions.read_segments(spark, path)
    checked = decisions.verify_chain(log).collect()
    assert [(r["intact"], r["entries"]) for r in checked] == [(True, 60)]
    assert len({r["row"] for r in decisions.decisions(log).select("seen.row").collect()}) == 60


def test_only_the_end_of_a_log_is_read(tmp_path):
    path = tmp_path / "log"
    with open(path, "wb") as f:
        f.write(b"a" * 200_000 + b"\n" + b"b" * 150_000 + b"\n")
    with open(path, "rb") as f:
        assert decision_writer.last_line(f) == b"b" * 150_000
    path.write_bytes(b"")
    with open(path, "rb") as f:
        assert decision_writer.last_line(f) is None
    path.write_bytes(b"whole\ntorn")
    with pytest.raises(decision_writer.TornLog):
        decision_writer.record(str(path), SEEN, "ignore", actor="human")
    assert path.read_bytes() == b"whole\ntorn"


def test_a_batch_reads_new_lines_only(spark, tmp_path):
    logs, mark = tmp_path / "logs", str(tmp_path / "mark")
    got = []

    def step():
        out = []
        stream = decision_log.follow(spark, str(logs))
        take = lambda df, _: out.extend((r["log_id"].rsplit("/", 1)[1], r["intact"], r["broken_at"], r["entries"], r["tip"]) for r in df.collect())
        query = stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        got.append(sum(p["numInputRows"] for p in query.recentProgress))
        return sorted(out)

    for _ in range(3):
        decision_writer.record_segment(str(logs / "a"), SEEN, "ignore", actor="human")
    decision_writer.record_segment(str(logs / "b"), SEEN, "ignore", actor="human")
    assert [r[:4] for r in step()] == [("a", True, None, 3), ("b", True, None, 1)]
    decision_writer.record_segment(str(logs / "a"), SEEN, "ignore", actor="human")
    (row,) = step()
    tips = {r["log_id"].rsplit("/", 1)[1]: r["tip"] for r in decisions.tip(decisions.read_segments(spark, str(logs))).collect()}
    assert row == ("a", True, None, 4, tips["a"])
    # A forged line, then an honest one behind it: the log stays broken where it broke.
    (logs / "a" / "000000000005.jsonl").write_text(json.dumps({"prev": "0" * 64}) + "\n")
    assert [r[:4] for r in step()] == [("a", False, 5, 5)]
    decision_writer.record_segment(str(logs / "a"), SEEN, "ignore", actor="human")
    (logs / "b" / "000000000003.jsonl").write_text("not json\n")
    assert [r[:4] for r in step()] == [("a", False, 5, 6), ("b", False, 3, 2)]
    assert got == [4, 1, 1, 2]
