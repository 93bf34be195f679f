"""The pipeline stage by stage on a small table, each stage against its operator's brute force or contract."""

import random
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from chronolith.llm import quality
from chronolith.llm.common import materialize, shared_dir
from chronolith.llm.minhash_core import shingles
from chronolith.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "repeat_removal", "source_mixing", "piece_encoding"]
    stages = dict(corpus_pipeline.STAGES)

    kept = materialize(stages["quality_rules"](spark, docs, SF), "t")
    verdict = quality.assess_texts([before[i].text.encode() for i in before])["kept"]
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in zip(before, verdict, strict=True) if k}

    single = materialize(stages["near_dedup"](spark, kept, SF), "t")
    sets = {r.doc_id: set(shingles(r.text.encode(), 5).tolist()) for r in kept.collect()}
    left = {r.doc_id for r in single.collect()}
    assert single.columns == columns
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    for i in sets:
        partners = [j for j in sets if j != i and near(sets[i], sets[j])]
        if i not in left:
            assert partners
        elif not partners:
            assert i in left
    assert not any(near(sets[i], sets[j]) for i in left for j in left if i < j)

    cut = materialize(stages["repeat_removal"](spark, single, SF), "t")
    assert cut.columns == columns and cut.count() == single.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    mixed = materialize(stages["source_mixing"](spark, cut, SF), "t")
    assert mixed.columns == columns
    size = sum(len(r.text.split()) for r in cut.collect())
    taken = sum(len(r.text.split()) for r in mixed.collect())
    longest = max(len(r.text.split()) for r in cut.collect())
    sources = cut.select("source").distinct().count()
    assert abs(taken - 1.5 * size) <= sources * longest

    assert all(r.round_trip for r in stages["piece_encoding"](spark, mixed, SF).collect())
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, component string, `key` long"


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated ids and rows, columns named as stages name theirs."""
    words = lambda seed, n: " ".join(f"{random.Random(f'{seed} {i}').randrange(10**6):x}" for i in range(n))
    long, plain = words("long", 40_000), words("plain", 80)
    return [
        (1, plain, "en", "s", 1, 7, "c", 1),
        (1, plain, "en", "s", 1, 7, "c", 1),
        (1, words("other", 80), None, "s", 2, None, None, None),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "t", 3, 8, "y", 2),
        (4, " \n\t", "en", "t", 3, 8, "y", 2),
        (None, plain, "en", "s", 4, 9, "z", 3),
        (None, words("null", 70), "en", None, 4, 9, "z", 3),
        (5, long, None, None, 5, 9, "q", 4),
        (6, long + " end", "en", "t", 6, 9, "q", 5),
        (7, words("last", 60) + " " + words("plain", 40), "de", "u", 7, 9, "q", 6),
    ]


def test_stages_on_odd_tables(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    stages = dict(corpus_pipeline.STAGES)

    kept = materialize(stages["quality_rules"](spark, docs, SF), "t")
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[0] not in (2, 3, 4))

    def near(order):
        return Counter(tuple(r) for r in stages["near_dedup"](spark, kept.orderBy(*order), SF).collect())

    single = near(["text"])
    assert single == near(["n_chars", "lang"])  # whichever row of id 1 stays, it is the same in every run
    assert Counter(r[0] for r in single) == Counter({1: 1, 5: 1, 7: 1, None: 2})
    assert set(single) <= set(rows)

    whole = spark.createDataFrame(rows, ODD).repartition(2)
    cut = stages["repeat_removal"](spark, whole, SF).collect()
    assert whole.columns == list(ODD.replace("`", "").replace(",", "").split()[::2]) == cut[0].__fields__
    assert len(cut) == len(rows)
    by_id = {r.doc_id: r for r in cut}
    assert by_id[2].text is None and by_id[3].text == "" and by_id[4].text == " \n\t"
    assert by_id[6].text == " end" or len(by_id[6].text) < 60
    assert by_id[5].text == rows[8][1] and sorted(r.text for r in cut if r.doc_id == 1) == sorted(r[1] for r in rows if r[0] == 1)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut)
    assert "n_chars" not in stages["repeat_removal"](spark, whole.drop("n_chars"), SF).columns

    mixed = stages["source_mixing"](spark, whole, SF)
    taken = Counter(map(tuple, mixed.collect()))
    assert mixed.columns == whole.columns and set(taken) <= {r for r in rows if r[0] not in (2, 3, 4)}
    assert max(n / rows.count(r) for r, n in taken.items()) <= 2

    coded = stages["piece_encoding"](spark, whole, SF).collect()
    assert all(r.round_trip for r in coded) and Counter(r.doc_id for r in coded) == Counter(r[0] for r in rows)
    assert [len(r.samples) for r in coded if r.doc_id in (2, 3)] == [1, 1]
    assert len({str(r.samples) for r in coded if r.doc_id == 1}) == 3

    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, spark.createDataFrame([], ODD), SF)
        assert empty.collect() == [] and (name == "piece_encoding" or empty.columns == docs.columns)


def test_tables_of_a_run_are_deleted(spark):
    folder = Path(shared_dir(spark))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, SF)
    left = [p.name.split("-")[0] for p in set(folder.iterdir()) - before]
    assert sorted(x for x in left if x.split("_")[0] in ("quality", "near", "repeat", "source")) == ["source_mixing"]
    assert out.count() > 0


def test_no_folder_of_its_own_on_a_cluster(spark, monkeypatch):
    monkeypatch.delenv("CHRONOLITH_SHARED_DIR", raising=False)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)
