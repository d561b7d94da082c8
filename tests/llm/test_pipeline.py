import time

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from chronomesh.llm import bpe
from tests.llm.conftest import SCHEMA, edge_rows
from tests.llm.test_decontaminate import brute_score
from tests.llm.test_near_copies import brute_groups
from tests.llm.test_quality import verdict
from tests.llm.test_secrets import base_spans


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scans", "byte_bpe"]


def test_result_equals_brute_force(spark, tiny):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    kept = [d for d, r in docs.items() if verdict(r.text)[1]]
    first = {}
    for d, group in brute_groups([(d, docs[d].text) for d in sorted(kept)])[0]:
        first.setdefault(group, d)
    clean = []
    for d in first.values():
        words = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in docs[d].text.lower().encode()).split()
        seeds = {tuple(words[i:i + 3]) for i in range(len(words))}
        leak = False
        for item in items:
            own = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in item.lower().encode()).split()
            near = sum(tuple(own[i:i + 3]) in seeds for i in range(len(own)))  # pairs that share nothing need no matrix
            leak |= near > 2 and brute_score(own, words) >= len(own)
        if not leak:
            clean.append(d)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, tiny).collect()}
    assert sorted(got) == sorted(clean) and all(r.exact for r in got.values())
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(file.read()), special_tokens={})
    for d, r in got.items():
        text, spans = docs[d].text, base_spans(docs[d].text)
        for start, _, end, _ in sorted(spans, key=lambda s: (s[0], -s[2]), reverse=True):
            if not any(a <= start and end <= b and (a, b) != (start, end) for a, _, b, _ in spans):
                text = text[:start] + "[SECRET]" + text[end:]
        assert list(r.token_ids) == encoding.encode_ordinary(text), d


@pytest.mark.parametrize("rows", [edge_rows(), []])
def test_every_stage_takes_odd_rows(spark, tiny, rows):
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).count() == docs.count()


def test_stages_hand_small_batches_to_python_workers(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    docs = spark.createDataFrame([(i, "x" * 100_000) for i in range(200)], "doc_id long, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        stage = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "bytes long"))
        got = [r.bytes for r in stage(spark, docs, "").collect()]
        assert sum(got) > 20_000_000 and max(got) < corpus_pipeline.BATCH_BYTES + 200_000
        assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    finally:
        spark.conf.set(key, before)


def test_shuffle_files_of_a_stage_go_with_its_jobs(spark, tiny, tmp_path):
    """Near duplicates are many jobs; what all of them shuffle must not lie on the disk at once."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}

    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    before = shuffled()
    dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, tiny).write.parquet(str(tmp_path / "out"))
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:  # executors are told, not waited for
        time.sleep(0.5)
    assert not shuffled() - before
