import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from clausemill.sources import readers, sinks


def write(path, content, mode="w", **kw):
    with open(path, mode, **(kw or ({"encoding": "utf-8", "newline": ""} if "b" not in mode else {}))) as f:
        f.write(content)
    return str(path)


def test_csv_with_line_breaks_and_subset(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'id,text,n\n1,"two\nlines, ""quoted""",3\n2,plain,\n')
    rows = readers.csv(spark, p, "id int, text string, n int", columns=["id", "text"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'two\nlines, "quoted"'), (2, "plain")]


def test_bom_csv_both_ways(spark, tmp_path):
    p = write(tmp_path / "a.csv", "﻿Code ; Text\nx;1\n")
    df = readers.bom_csv(spark, p)
    assert df.columns == ["Code", "Text"] and df.first().Code == "x"
    sinks.bom_csv(df, str(tmp_path / "b.csv"))
    assert open(tmp_path / "b.csv", "rb").read().startswith(b"\xef\xbb\xbf")


def test_csv_batches_and_fixed_columns(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"batch_{k}.csv", f"a,b\n{k},x\n")
    df = readers.csv_batches(spark, f"{tmp_path}/batch_*.csv", "a int, b string")
    assert {(r.a, r.source_file) for r in df.collect()} == {(k, f"batch_{k}.csv") for k in range(3)}
    sinks.csv(df, f"{tmp_path}/out", ["b", "a"])
    assert readers.csv(spark, f"{tmp_path}/out", "b string, a int").columns == ["b", "a"]


def test_json_array_is_ordered(spark, tmp_path):
    p = write(tmp_path / "t.json", json.dumps({"topics": [{"id": "z", "name": "Z"}, {"id": "a", "name": "A"}]}, indent=1))
    assert [tuple(r) for r in readers.json_array(spark, p, "topics", "struct<id:string,name:string>").orderBy("pos").collect()] == [(0, "z", "Z"), (1, "a", "A")]


def test_nested_points_and_questions(spark, tmp_path):
    service = {"service_id": 1, "service_name": "S", "cases": [{"case_id": 7, "case_title": "c", "case_topic": "t", "case_classification": "bad", "points": [{"point_id": 3, "point_title": "p"}]}, {"case_id": 8, "points": []}]}
    p = write(tmp_path / "s.json", json.dumps(service))
    assert [(r.case_id, r.point_id) for r in readers.service_points(spark, p).collect()] == [(7, 3)]
    qa = {"data": [{"title": "T", "paragraphs": [{"context": "C", "qas": [{"id": "x__Cat", "question": "q", "is_impossible": False, "answers": [{"text": "one", "answer_start": 0}, {"text": "two", "answer_start": 1}]}, {"id": "y", "question": "r", "is_impossible": True, "answers": []}]}]}]}
    got = {r.id: (r.answer, r.category) for r in readers.question_answers(spark, write(tmp_path / "q.json", json.dumps(qa))).collect()}
    assert got == {"x__Cat": ("one", "Cat"), "y": ("", "unknown")}


def test_whole_texts(spark, tmp_path):
    os.mkdir(tmp_path / "t")
    write(tmp_path / "t" / "a.txt", b" x\r\ny\xff \n", "wb")
    assert readers.whole_texts(spark, f"{tmp_path}/t").first().text == "x\ny�"
    write(tmp_path / "t" / "b.pdf", "x")
    with pytest.raises(Exception, match="not a text file"):
        readers.whole_texts(spark, f"{tmp_path}/t").collect()


def test_parallel_lines(spark, tmp_path):
    for kind, text in (("sentences", "a b\nc\n"), ("labels", "1\n\n"), ("tags", "ch2\n \n")):
        write(tmp_path / f"net.{kind}", text)
    kinds = ["sentences", "labels", "tags"]
    rows = readers.parallel_lines(spark, str(tmp_path), kinds).orderBy("pos").collect()
    assert [(r.pos, r.sentences, r.labels) for r in rows] == [(0, "a b", "1"), (1, "c", "")]
    write(tmp_path / "net.tags", "one\n")
    with pytest.raises(Exception, match="unequal length"):
        readers.parallel_lines(spark, str(tmp_path), kinds).collect()


def test_docx_comments_and_errors(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:commentRangeStart w:id="1"/><w:r><w:t>some </w:t></w:r><w:r><w:t>text</w:t></w:r><w:commentRangeEnd w:id="1"/><w:r><w:t>after</w:t></w:r></w:p></w:body></w:document>'
    notes = f'<w:comments {w}><w:comment w:id="1" w:author="me"><w:p><w:r><w:t>ip 0</w:t></w:r></w:p></w:comment></w:comments>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/comments.xml", notes)
    write(tmp_path / "good.docx", buffer.getvalue(), "wb")
    write(tmp_path / "bad.docx", b"junk", "wb")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.docx_comments(spark, str(tmp_path)).collect()}
    assert (rows["good.docx"].author, rows["good.docx"].comment, rows["good.docx"].referenced_text) == ("me", "ip 0", "some text")
    assert rows["bad.docx"].error.startswith("BadZipFile") and {r.title for r in readers.titles(spark, str(tmp_path), ("docx",)).collect()} == {"good", "bad"}


def test_runs_and_absent_libraries(spark, tmp_path):
    for k, held in ((1, None), (2, "x")):
        os.mkdir(tmp_path / f"r{k}")
        write(tmp_path / f"r{k}" / "metrics.json", json.dumps({"run_id": f"r{k}", "best_val": k, "holdout_source": held}))
    runs = readers.json_runs(spark, f"{tmp_path}/*/metrics.json", "run_id string, best_val double, holdout_source string")
    assert [r.run_id for r in runs.collect()] == ["r1"]
    for read in (lambda: readers.pdf_pages(spark, "x"), lambda: readers.excel_sheet(spark, "x", "y")):
        with pytest.raises((RuntimeError, Exception)):
            read().collect()


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1, 0.5), ("c&d", 2, None)], "name string, n long, x double")
    tex, twin = sinks.paper_table(df, f"{tmp_path}/out", "t", "A table")
    text = open(tex).read()
    assert r"a\_b & 1 & 0.500 \\" in text and r"c\&d & 2 & -- \\" in text and os.path.exists(twin)
    assert sinks.summary_json(df.agg(F.count("*").alias("n")), f"{tmp_path}/s.json", policy="raw") == {"n": 2, "policy": "raw"} == json.load(open(tmp_path / "s.json"))
    sinks.nested_json(df, f"{tmp_path}/j")
    assert sinks.as_json(df).first().value == '{"name":"a_b","n":1,"x":0.5}' and '"x":null' in sinks.as_json(df).collect()[1].value
    sinks.once(df, f"{tmp_path}/v")
    sinks.once(df.limit(0), f"{tmp_path}/v")
    sinks.append(df, f"{tmp_path}/v")
    assert readers.embeddings(spark, f"{tmp_path}/v").count() == 4
    sinks.arrays(df, f"{tmp_path}/p", "n")
    assert readers.embeddings(spark, f"{tmp_path}/p").where("n = 2").count() == 1
    assert sinks.without_stamps(df.withColumn("t", F.current_timestamp()).withColumn("created_at", F.lit("x"))).columns == df.columns


def test_large_results_do_not_come_to_the_driver(spark, tmp_path):
    from clausemill.sources import sinks

    with pytest.raises(ValueError, match="more than"):
        sinks.small(spark.range(11), 10)
    assert len(sinks.small(spark.range(10), 10)) == 10


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from clausemill.session import checkpoint_dir

    none = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: none))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
