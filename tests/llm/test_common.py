import threading

from tidebar.llm.common import cut, settled


def test_two_threads_keep_their_tables(spark):
    """One query's end doesn't empty what another one still reads."""
    ready, done, seen = threading.Event(), threading.Event(), []

    def other():
        mine = cut(spark.range(100), "other")
        ready.set()
        done.wait(60)
        seen.append(mine.count())

    def make():
        cut(spark.range(5), "step")
        thread.start()
        ready.wait(60)
        return spark.range(7)

    thread = threading.Thread(target=other)
    assert settled(make, "whole").count() == 7
    done.set()
    thread.join(60)
    assert seen == [100]


def folder(df):
    return df.inputFiles()[0].rsplit("/", 1)[0]


def test_steps_are_emptied_inside_out(spark):
    folders = []

    def deep():
        step = cut(spark.range(3), "deep")
        folders.append(folder(step))
        return step

    def make():
        inner = settled(deep, "inner")
        folders.append(folder(inner))
        assert inner.count() == 3 and spark.read.parquet(folders[0]).count() == 0
        return inner

    assert settled(make, "outer").count() == 3
    assert spark.read.parquet(folders[1]).count() == 0
