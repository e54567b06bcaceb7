import json

import pytest
from pyspark.sql import functions as F

from graphloom.sources import readers, sinks
from graphloom.streaming import events

from .conftest import rows


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "q": "x"}\n\n{bad\n{"id": 2, "q": "y"}\n')
    (tmp_path / "b.json").write_text(json.dumps({"train": [{"id": 3}], "test": [{"id": 4}]}))
    (tmp_path / "c.csv").write_text("id,q\n1,\n2,z\n")
    assert rows(readers.read_records(spark, str(tmp_path / "a.jsonl")).select("id")) == [(1,), (2,)]
    assert rows(readers.read_records(spark, str(tmp_path / "b.json"), "test")) == [(4,)]
    assert rows(readers.read_records(spark, str(tmp_path / "c.csv"))) == [("1", ""), ("2", "z")]
    (tmp_path / "d" / "test").mkdir(parents=True)
    (tmp_path / "d" / "test" / "p.jsonl").write_text('{"id": 9}\n')
    assert rows(readers.read_folder(spark, str(tmp_path / "d"), "test")) == [(9,)]


HEAD = "x_id,source_id,y_id,x_name,y_name,x_type,y_type,relation,display_relation,resource,pubmed_ids,x_cui\n"


def test_layouts(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "one" / "primekg.csv").write_text(HEAD + "drug:a,zz,drug:b,A,,drug,,drug_drug,,DrugBank,x|7; 8 n, c0043031 \n,,drug:c,,,,,r_q,Shown,,,\nq,,w,,,,,odd,o,,,\n")
    assert readers.graph_layout(spark, str(tmp_path / "one")) == ("one_table", [f"{tmp_path}/one/primekg.csv"])
    r = readers.read_graph(spark, str(tmp_path / "one")).orderBy("row_index").collect()
    assert [x["edge_id"] for x in r] == ["drug:a|drug_drug|drug:b|0", "node:1:head|r_q|drug:c|1", "q|odd|w|2"]  # x_id comes before source_id
    assert r[0]["supporting_pmids"] == ["7", "8"] and r[0]["source_reliability"] == 0.95 and r[0]["display_relation"] == "drug drug" and r[1]["head_name"] == "node:1:head" and r[1]["source"] == "primekg" and r[1]["head_type"] == "other"
    some = readers.read_graph(spark, str(tmp_path / "one"), ["r_q", "odd"], 1).collect()
    assert len(some) == 1 and some[0]["row_index"] == 1  # the limit counts accepted rows, the number all rows
    assert rows(readers.concept_index(readers.read_graph(spark, str(tmp_path / "one")))) == [("C0043031", "drug:a")]
    with pytest.raises(ValueError):
        readers.edges_from_table(spark.createDataFrame([("a",)], "x string"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "nodes.csv").write_text("node_index,node_id,node_name,node_type,node_source\n0,drug:a,A,drug,\n1,drug:b,B,drug,go\n")
    (tmp_path / "two" / "edges.csv").write_text("relation,display_relation,x_index,y_index\nr,d,0,1\nr,d,0,5\n")
    assert readers.graph_layout(spark, str(tmp_path / "two"))[0] == "two_tables"
    assert rows(readers.read_graph(spark, str(tmp_path / "two")).select("edge_id", "head_name", "source", "source_reliability")) == [("drug:a|r|drug:b|0", "A", "go", 0.84)]
    assert readers.graph_layout(spark, str(tmp_path / "none")) == ("missing", []) and readers.read_graph(spark, str(tmp_path / "none")).count() == 0


def test_row_numbers_do_not_depend_on_tasks(spark):
    df = spark.range(0, 100, 1, 7).select(F.col("id").alias("x"))
    assert all(r["x"] == r["row_index"] for r in readers.numbered(df).collect())


def test_folders_and_traces(spark, tmp_path):
    d = tmp_path / "set"
    d.mkdir()
    (d / "test_a.jsonl").write_text('{"id": 1}\n')
    (d / "test_b.csv").write_text("id,q\n2,z\n")
    (d / "train.jsonl").write_text('{"id": 3}\n')
    (d / "dataset-metadata.json").write_text('{"title": "x"}')
    assert sorted(int(r["id"]) for r in readers.read_folder(spark, str(d), "test").select(F.col("id").cast("int").alias("id")).collect()) == [1, 2]
    assert readers.named_dataset(spark, str(tmp_path), "set") == f"{tmp_path}/set"
    with pytest.raises(ValueError):
        readers.named_dataset(spark, str(tmp_path), "other")
    u = tmp_path / "unsplit"
    u.mkdir()
    (u / "all.jsonl").write_text("".join(f'{{"id": {i}}}\n' for i in range(20)))
    assert readers.read_folder(spark, str(u), "dev", "id").count() == 1
    t = {"sample_id": "q1", "question": "Why?", "gold_answer": "x", "question_type": {"predicted": "other"}, "primekg_retrieval": {"top_edges": [{"edge_id": "E1", "head": "a", "tail": "b", "relation": "r"}]}, "pubmed_retrieval": {"passages": [{"pmid": "1", "title": "t"}]}}
    (tmp_path / "t.json").write_text(json.dumps(t, indent=1))
    q, e, p = readers.read_traces(spark, str(tmp_path / "t.json"))
    assert q.first()["question_type"] == "other" and e.first()["edge_id"] == "E1" and p.first()["pmid"] == "1"


def test_positional_split(spark):
    got = readers.positional_split(spark.range(20), "id").groupBy("split").count()
    assert rows(got) == [("test", 1), ("train", 18), ("validation", 1)]
    assert readers.positional_split(spark.range(0), "id").count() == 0


def test_xml_and_cache(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<Set><PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>A</AbstractText><AbstractText>B</AbstractText></Abstract>"
        "<Journal><Title>J</Title><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal></Article><MeshHeadingList><MeshHeading><DescriptorName>M</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></Set>"
    )
    assert [tuple(r) for r in readers.read_articles_xml(spark, str(tmp_path / "a.xml")).collect()] == [("12", "T", "A B", "J", "2001", ["M"])]
    cache = spark.createDataFrame([(" Warfarin", 50, 1, ["old"]), ("warfarin ", 50, 2, ["new"])], "query string, retmax int, timestamp bigint, articles array<string>")
    hit, miss = readers.cached_articles(spark.createDataFrame([("WARFARIN",), ("other",)], "query string"), cache)
    assert hit.first()["articles"] == ["new"] and rows(miss) == [("other",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "goldish"), (2, "reject"), (3, "reject")], "id int, tier string")
    assert rows(sinks.write_tiers(df, str(tmp_path / "t"))) == [("goldish", 1), ("reject", 2)]
    full = df.withColumn("edge_coverage", F.lit(0.5)).withColumn("reasons", F.array(F.lit("r")))
    got = {r["tier"]: r for r in sinks.write_tiers(full, str(tmp_path / "t2")).collect()}
    assert got["reject"]["mean_edge_coverage"] == 0.5 and got["reject"]["reasons"] == {"r": 2}
    sinks.write_with_dead_letters(df, F.when(F.col("id") > 2, "late"), str(tmp_path / "d"), "id", 1)
    assert rows(spark.read.json(str(tmp_path / "d/saved")).select("id")) == [(1,)]
    v = sinks.write_codebook(spark.createDataFrame([(0, [1.0])], "code_id int, vec array<double>"), str(tmp_path / "cb"), {"size": 1})
    assert v.startswith("cb-") and sinks.read_codebook(spark, str(tmp_path / "cb"), {"size": 1}).count() == 1
    with pytest.raises(ValueError):
        sinks.read_codebook(spark, str(tmp_path / "cb"), {"size": 2})
    sinks.append_events(spark.sql("select timestamp'2024-01-01' timestamp, 'l' layer, 'e' event, '{}' data, 's' session_id"), str(tmp_path / "log"))
    sinks.write_metrics(df.agg(F.count("*").alias("n")), str(tmp_path / "m"))
    sinks.write_training_rows(df, str(tmp_path / "rows"), {"seq_len": 256})
    assert spark.read.json(str(tmp_path / "log")).count() == 1 and spark.read.json(str(tmp_path / "m")).first()["n"] == 3 and spark.read.text(str(tmp_path / "rows/dataset")).count() == 1
    one = lambda c: spark.createDataFrame([(1, 0, "x")], f"k int, pos int, {c} string")
    sinks.write_trace(df.select(F.col("id").alias("k")), one("edge_id"), one("pmid"), str(tmp_path / "tr"))
    assert spark.read.json(str(tmp_path / "tr")).count() == 3
    sinks.write_with_dead_letters(df, F.when(F.col("id") > 2, "late"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/saved")).count() == 2 and spark.read.json(str(tmp_path / "d/skipped")).first()["skip_reason"] == "late"
    assert [r["value"] for r in sinks.markdown_report(df, "x").collect()][:2] == ["# x", "| id | tier |"]


def test_streams_give_what_batches_give(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select id event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id*7 as int)) ts, id % 3 user_id, 'click' event_type, double(id) value, '{\"k\": 1}' props from range(60)").repartition(3).write.parquet(str(src))
    batch = spark.read.parquet(str(src))
    for f, mode in ((events.tumbling_latency, "complete"), (events.layer_summary, "complete")):
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        name = f"q_{f.__name__}"
        q = f(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert rows(spark.table(name)) == rows(f(batch))
    assert events.sessions(batch).count() > 0 and events.first_of_each(batch.unionByName(batch)).count() == 60


def test_resumable_run(spark, tmp_path):
    src, out, chk = str(tmp_path / "s"), str(tmp_path / "o"), str(tmp_path / "c")
    mk = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("sample_id"), F.lit("threshold_a").alias("bucket")).write.mode("append").parquet(src)
    mk(0, 5)
    for extra in (None, (5, 8), None):
        if extra:
            mk(*extra)
        stream = spark.readStream.schema("sample_id string, bucket string").parquet(src)
        events.run_available(stream, out, chk, sinks.append_batch)
    assert spark.read.parquet(f"{out}/rows").count() == 8 and spark.read.csv(f"{out}/manifest", header=True).count() == 8
