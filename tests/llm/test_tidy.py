"""What a long job leaves on the driver is given back."""

from emberline.llm import scratch


def test_the_driver_gives_memory_back_as_tables_are_written(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(scratch, "release", lambda release=scratch.release: (release(), calls.append(1)))
    work = scratch.Scratch(spark, "tidy")
    for i in range(10):
        work.drop(work.write(spark.range(i + 1), "t"))
    assert len(calls) == 10 // scratch.TIDY == 2
