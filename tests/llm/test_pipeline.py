"""The stages on the smallest tables and on planted rows."""

import re

import corpus_pipeline as cp
from almanac.llm.lattice import Pieces, decoded, model_path
from almanac.llm.private import base_spans

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [re.sub(r"\s+", " ", r.text).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen, kept = [docs], {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        rows = stage(spark, seen[-1], SF)
        assert tuple(rows.columns) == cp.COLUMNS and dict(rows.dtypes) == dict(docs.dtypes)
        made = rows.collect()
        after = {r.doc_id: r.text for r in made}
        assert len(after) == len(made) and set(after) <= set(kept)
        gone = set(kept) - set(after)
        if name == "quality":
            assert all(labels.get(d, 0) == 0 for d in gone) and gone
        elif name == "simhash":
            assert len(set(after.values())) == len(after) and all(min(i for i, t in kept.items() if t == kept[d]) == d for d in after)
        elif name == "decontamination":
            plain = {d: re.sub(r"\s+", " ", t).lower() for d, t in kept.items()}
            assert all(any(b in plain[d] for b in bench) == (d in gone) for d in kept)
        else:
            assert not gone and any(after[d] != kept[d] for d in kept)
            assert all((after[d] != kept[d]) == bool(base_spans(kept[d])) and not base_spans(after[d]) for d in kept)
            assert all(r.n_chars == len(r.text) for r in made)
        seen.append(spark.createDataFrame(made, docs.schema))
        kept = after
    pieces = Pieces(model_path())
    last = {r.doc_id: r.pieces for r in cp.STAGES[-1][1](spark, seen[-1], SF).collect()}
    assert {d: decoded(pieces, ids).decode() for d, ids in last.items()} == kept


def test_redaction(spark):
    text = "é a@b.co or 1.2.3.4, +1 (234) 567 8901."
    rows = [(1, text, [("email", 2, 8), ("ip", 12, 19), ("phone", 21, 38)]), (2, "1234567", [("card", 2, 6), ("phone", 1, 4), ("ip", 6, 7)]), (3, "x", [])]
    frame = spark.createDataFrame(rows, "doc_id int, text string, s array<struct<kind:string,start:bigint,end:bigint>>")
    got = {r.doc_id: r.t for r in frame.select("doc_id", cp._redacted(frame.text, frame.s).alias("t")).collect()}
    assert got == {1: "é [EMAIL] or [IP], [PHONE].", 2: "1[PHONE][IP]", 3: "x"}


def test_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", None, "s", 0), (900001, "", None, "s", 0)], docs.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, odd, SF).count() <= 3
        assert stage(spark, odd.limit(0), SF).collect() == []


def test_only_the_judged_rows_go_with_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    good, bad = ([t for d, t in sorted(rows.items()) if t and labels.get(d) == q] for q in (1, 0))
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    frame = lambda made: spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in made], docs.schema)
    after = lambda stage, made: sorted([(str(r.doc_id), r.text) for r in stage(spark, frame(made), SF).collect()])
    told = lambda made: sorted([(str(d), t) for d, t in made])

    mixed = [(None, good[0]), (None, bad[0]), (7000001, good[1]), (7000001, bad[1])]
    made = after(cp.of_quality, [*rows.items(), *mixed])
    stay = {t for d, t in made if int(d if d != "None" else -1) in rows}
    assert {(d, t) for d, t in made if d in ("None", "7000001")} == {(str(d), t) for d, t in mixed if t in stay}
    assert {good[0], good[1]} <= stay and not {bad[0], bad[1]} & stay

    body = " ".join(f"w{i}" for i in range(60))
    leaking = [(None, body), (None, f"{body} {passage} {body}"), (8, body), (8, f"x {passage}")]
    assert after(cp.without_leaks, leaking) == told([(None, body), (8, body)])

    other = " ".join(f"v{i}" for i in range(60))
    copies = [(5, body), (5, body), (5, f"{body} end"), (5, other), (None, body), (None, f"{other} end"), (None, passage), (None, passage), (9, other)]
    made = after(cp.without_near_copies, copies)
    assert len(made) == 3 and made.count(("None", passage)) == 1
    assert {("5", body), ("5", f"{body} end")} & set(made) and ("5", other) in made


def test_the_last_stage_decodes_its_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, "a  [EMAIL] é\n\u2581 x", None, None, 1), (2, "", None, None, 0), (3, None, None, None, None)]
    got = cp.as_pieces(spark, spark.createDataFrame(rows, docs.schema), SF).collect()
    assert sorted((r.doc_id, r.lossless) for r in got) == [(1, True), (2, True), (3, True)]


def test_a_task_of_the_last_stage_holds_one_python_worker_and_small_batches(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    before = spark.conf.get(cp.BATCH)
    try:
        spark.conf.set(cp.BATCH, 10_000)
        made = cp.as_pieces(spark, docs, SF)
        capsys.readouterr()
        made.explain()
        assert capsys.readouterr().out.count("MapInArrow") == 1
        assert spark.conf.get(cp.BATCH) == str(cp.ROWS)
        assert made.filter("lossless").count() == 5
        spark.conf.set(cp.BATCH, 10)
        cp.as_pieces(spark, docs, SF)
        assert spark.conf.get(cp.BATCH) == "10"
    finally:
        spark.conf.set(cp.BATCH, before)
