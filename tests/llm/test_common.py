import os
import time

import pyarrow as pa
from pestle.llm.bpe import default_path, encoder
from pestle.llm.common import lean, written
from pestle.llm.quality import mark_trusted, quality_model


def test_a_task_drops_what_the_encoder_left_in_its_worker():
    encoder(open(default_path(), encoding="utf-8").read())
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert list(lean(lambda b: b, forget=False)(iter([batch]))) == [batch] and encoder.cache_info().currsize == 1
    assert list(lean(lambda b: b)(iter([batch, batch]))) == [batch, batch] and encoder.cache_info().currsize == 0


def test_batches_for_python_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 400, 1, 1).selectExpr("repeat(cast(id AS string), 50000) AS text")
    got = written(rows.mapInArrow(sizes, "n long, bytes long")).collect()
    assert sum(r.n for r in got) == 400 and len(got) > 1 and max(r.bytes for r in got) < 10 << 20
    assert spark.conf.get(key) == before


def test_shuffle_files_and_counts_go_when_the_model_is_written(spark, monkeypatch):
    import pestle.llm.quality as quality

    def files():
        all_files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in all_files.mkString("\n").split("\n") if "shuffle_" in f}

    tables, before = {}, files()
    monkeypatch.setattr(quality, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    docs = spark.createDataFrame([(i, "en", f"text {i} of many") for i in range(40)], "doc_id long, lang string, text string")
    model = quality_model(mark_trusted(docs, docs.select("doc_id"), "doc_id", "lang"), "text")
    assert model.count() > 0 and not os.path.exists(tables["counts"].written_to.removeprefix("file://"))
    end = time.time() + 20
    while (left := files() - before) and time.time() < end:  # executors delete them a little later
        time.sleep(0.2)
    assert len(left) <= 8  # only of the count just made


def test_the_driver_gives_freed_native_memory_back(spark):
    of = spark._jvm.java.lang.Class.forName
    field = of("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, pid, size, page = field.get(None), spark._jvm.java.lang.ProcessHandle.current().pid(), 96 << 10, os.sysconf("SC_PAGE_SIZE")

    def resident(blocks):
        n = 0
        with open(f"/proc/{pid}/pagemap", "rb") as f:
            for at in blocks:
                first, end = -(-at // page), (at + size) // page
                f.seek(8 * first)
                n += sum(b >> 7 for b in f.read(8 * (end - first))[7::8])
        return n * page

    blocks = [unsafe.allocateMemory(size) for _ in range(400)]
    for at in blocks:
        unsafe.setMemory(at, size, 1)
    freed = [at for i, at in enumerate(blocks) if i % 8]  # the rest keep the arena from shrinking by itself
    for at in freed:
        unsafe.freeMemory(at)
    before = resident(freed)
    out = written(spark.range(10))
    after = resident(freed)
    for at in blocks[::8]:
        unsafe.freeMemory(at)
    assert out.count() == 10
    assert before > 0.8 * size * len(freed) and after < 0.3 * before
