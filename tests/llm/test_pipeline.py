"""The pipeline's contract: stages, columns and effects, and the registered queries."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from siltstone.llm import oracles, queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mix", "pack"]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    mixed = corpus_pipeline.mixed(spark, docs, sf_dir)
    assert mixed.columns == columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(oracles.ORACLES[name])
    names = [c[0] for c in cursor.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    tidy = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert tidy(got.select(*names).collect()) == tidy(cursor.fetchall())


def test_near_duplicates_leave_no_files_behind_their_use(spark, sf_dir, monkeypatch):
    """Tables of the near-duplicate stage go once they are read, and shuffle files with their query."""
    from siltstone.llm import common, simhash

    gone, modes = [], []
    monkeypatch.setattr(simhash, "discard", lambda *tables: (gone.extend(tables), modes.append(spark.conf.get(common.CLEANUP, None)), common.discard(*tables)))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < simhash.keep_one(docs).count() < docs.count()
    assert len(gone) >= 8 and set(modes) == {"true"} and spark.conf.get(common.CLEANUP, None) != "true"
