"""Every stage of the pipeline on odd rows, on rows without ids and on an empty table; what the stages leave on disk."""

import glob
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.functions import bounded
from flowloom.functions.bounded import CLEANUP, scratch, stabilise
from flowloom.llm import common
from flowloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
CALM = "The garden was quiet and the evening light fell on the old stone wall near the river bank today"


@pytest.fixture(scope="module")
def docs(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars"))
    odd = [(None, None, "en", "s", None), (90_001, None, None, None, None), (90_002, "", "en", None, 0), (90_003, " \n\t", "en", "s", 3),
           (None, CALM, "en", "s", 1), (None, CALM, "en", "s", 1), (90_004, CALM + " again", "en", "s", 1), (90_005, "w " * 30_000, None, None, 60_000)]
    return own.limit(60).unionByName(spark.createDataFrame(odd, DOCS))


def test_stages_pass_odd_rows_on(spark, docs, sf):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.stabilise(stage(spark, kept, sf))
        assert out.columns == docs.columns, name
        if name == "quality":  # a text without words is rejected, with an id or without
            assert out.where("text is null or trim(text) = ''").count() == 0 < out.count() < kept.count()
        if name == "near_dedup":  # rows without an id are documents by their text, and one of a group stays
            calm = out.where(F.col("text").startswith("The garden was quiet")).select("doc_id").collect()
            before = kept.where(F.col("text").startswith("The garden was quiet")).count()
            assert len(calm) == min(before, 1)
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in kept.collect()}
        kept = out
    mixed = corpus_pipeline.stabilise(corpus_pipeline.mix(spark, kept, sf))
    assert mixed.columns == [*docs.columns, "_shard", "_order"] and mixed.count() > 0
    packed = corpus_pipeline.pack(spark, mixed, sf).collect()
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.select("doc_id").collect()}
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_an_empty_table_passes_all_stages(spark, sf):
    kept = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stabilise(stage(spark, kept, sf))
        assert kept.count() == 0


@pytest.fixture
def shared(monkeypatch, tmp_path):
    monkeypatch.setattr(bounded, "shared_dir", lambda spark: str(tmp_path))
    return tmp_path


def test_stages_leave_only_what_their_results_read(spark, docs, sf, shared):
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = set(shared.iterdir())
        out = stage(spark, docs, sf)
        assert len(set(shared.iterdir()) - before) == 1, name
        assert 0 < out.count() <= docs.count()


def test_components_leave_their_last_round(spark, shared):
    found = components(spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long"))
    assert len(list(shared.iterdir())) == 1 and {r.component for r in found.collect()} == {0}


def test_scratch_keeps_what_it_is_told_to(spark, shared):
    with scratch(spark) as keep:
        with scratch(spark) as keep_inner:
            inner = keep_inner(stabilise(spark.range(3)))
            stabilise(spark.range(4))
        outer = keep(stabilise(inner.where("id > 0")))
    assert len(list(shared.iterdir())) == 1 and outer.count() == 2


def test_a_stored_frame_leaves_no_shuffle_files(spark, shared):
    def files():
        return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/**/shuffle_*.data", recursive=True))

    before, setting = files(), spark.conf.get(CLEANUP, None)
    stored = stabilise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not files() - before and stored.count() == 7 and spark.conf.get(CLEANUP, None) == setting


def test_an_id_filter_is_sent_as_bits(spark):
    ids = np.random.default_rng(5).integers(-1 << 62, 1 << 62, 3000)
    sent = common.id_filter(spark.createDataFrame([(int(i),) for i in ids[:1000]], "id long"), "id")
    met = common.may_contain(sent.value, pa.array([*ids.tolist(), None]))
    assert sent.value.nbytes * 8 == common.FILTER_BITS
    assert met[:1000].all() and met[1000:].sum() < 20 and not met[-1]
