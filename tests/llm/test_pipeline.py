"""The pipeline as a whole on small corpora, stage by stage."""

import gc
import os
import random
import re
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeline.llm.common import heaps_returned


def corpus(spark, folder, docs, bench=(), labels=()):
    spark.createDataFrame(list(docs), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    sentence = lambda n=12: " ".join(f"w{rng.randrange(3000)}" for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(4))
    clean = [text() for _ in range(120)]
    toxic = [" ".join(rng.choice(["vileword", "nastyone", "awfulish"]) for _ in range(6)) + " " + text() for _ in range(60)]
    item = sentence(40)
    passage = " ".join(sentence(10) for _ in range(6))
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(clean)] + [(1000 + i, t, "en", "b", len(t)) for i, t in enumerate(toxic)]
    leaked = f"{clean[5]}\nSome more words here, {item.lower()} and an end to it all."
    leaked = leaked.replace(clean[5], text())
    copies = [(2000, clean[7], "en", "c", 1), (2001, clean[7], "en", "c", 1), (2001, clean[7], "en", "c", 1), (2100, leaked, "en", "c", 1), (2200, text() + " " + passage + " Tail of one.", None, None, None), (2300, "Head. " + passage + "\n" + text(), "en", "c", None)]
    odd = [(3000, None, None, None, None), (3001, "", "en", None, 0), (None, text(), "en", "x", 3), (3002, "word " * 30_000, "en", "long", 150_000), (3003, " \n \n", "en", "x", 4)]
    folder = corpus(spark, tmp_path, rows + copies + odd, [(1, item), (2, None)], [(r[0], 1, int(r[0] >= 1000)) for r in rows])
    kept, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/stage-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = lambda n: {r.doc_id for r in kept[n].collect()}
    bad = {1000 + i for i in range(60)}
    assert len(ids("toxicity") & bad) <= 3 and set(range(120)) <= ids("toxicity") and {3000, 3001, None} <= ids("toxicity")
    texts = {r.doc_id: r.text for r in kept["line_dedup"].collect()}
    assert not {2000, 2001} & set(texts) and passage.split(". ")[2] in texts[2200] and passage.split(". ")[2] not in texts[2300] and all(texts[i] == clean[i] for i in range(120))
    assert set(range(120)) <= ids("minhash") and ids("minhash") <= ids("line_dedup")
    cut = {r.doc_id: r.text for r in kept["decontamination"].collect()}
    assert item.lower()[10:60] not in cut[2100] and "Some more words" in cut[2100] and all(cut[i] == clean[i] for i in range(120))
    pieces = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in pieces} == set(cut) and all(r.n == r.m for r in pieces if r.doc_id is not None)
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, run.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, kept["packing"].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_pipeline_of_nothing(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    assert corpus_pipeline.run(spark, corpus(spark, tmp_path, [])).count() == 0


def test_stages_return_heap(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    folder = corpus(spark, tmp_path, [(1, "One text.", "en", "a", 9)], [(1, "An item.")], [(1, 1, 0)])
    docs, beans = spark.read.parquet(f"{folder}/documents.parquet"), spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(x.getCollectionCount() for x in beans() if "Young" not in x.getName())  # noqa: E731  collections of the whole heap
    for name, stage in corpus_pipeline.STAGES:
        before = whole()
        stage(spark, docs, folder)
        assert whole() > before, name


def test_driver_returns_freed_blocks(spark):
    jvm = spark.sparkContext._jvm
    unsafe, pids = jvm.org.apache.spark.unsafe.Platform, (os.getpid(), jvm.java.lang.ProcessHandle.current().pid())
    held = lambda: [int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{p}/status").read_text())[1]) / 1024 for p in pids]  # noqa: E731  MB
    heaps_returned(spark)
    size, n = 100_000, 3_000
    own, native = [np.ones(size, np.uint8) for _ in range(n)], [unsafe.allocateMemory(size) for _ in range(n)]
    for x in native:
        unsafe.setMemory(x, 1, size)
    for x in native[:-1]:  # the last block of each stays, so that no heap shrinks at its end
        unsafe.freeMemory(x)
    del own[:-1]
    gc.collect()
    before = held()
    heaps_returned(spark)
    after = held()
    unsafe.freeMemory(native[-1])
    assert all(b - a > 150 for b, a in zip(before, after, strict=True)), (before, after)
