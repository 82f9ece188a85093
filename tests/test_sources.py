import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lotwise.errors import InputError
from lotwise.plans import workflow
from lotwise.sources import contracts, delimited, profile, sinks, workbook

TITLED = 'Export,,\nmade 2024,,\n\n Batch ID ,NaOH Added,"Notes, etc"\nMB001,"100,3 g","said ""hi"""\nmb-002,<99 g,x\n'
PLAIN = "Batch ID,NaOH Added,Extra\nMB003,97.5,7\n"
QC = "Batch Identifier,Test Name,Result\nMB-001,yield_percent,\"82,9 %\"\n mb002 ,yield_percent,80\nMB003,yield_percent,<79\nMB003,yield_percent,81\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.csv").write_text(TITLED)
    (tmp_path / "p" / "b.csv").write_text(PLAIN)
    (tmp_path / "qc.csv").write_text(QC)
    return tmp_path


@pytest.mark.parametrize("multiline", [False, True])
def test_headers_are_found_per_file(spark, folder, multiline):
    rows = delimited.read_delimited(spark, str(folder / "p"), None, multiline=multiline)
    got = {r["Batch ID"]: r for r in rows.collect()}
    assert got["MB001"]["NaOH Added"] == "100,3 g" and got["MB001"]["Notes, etc"] == 'said "hi"'
    assert got["MB003"]["Extra"] == "7" and got["MB003"]["Notes, etc"] is None and len(got) == 3


def test_given_header_row(spark, folder):
    assert delimited.read_delimited(spark, str(folder / "p" / "a.csv"), 2).count() == 2


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Batch,Note\nB1,"two\nlines"\nB2,one\n')
    rows = delimited.read_delimited(spark, str(tmp_path / "x.csv"), multiline=True).orderBy("Batch").collect()
    assert [r.Note for r in rows] == ["two\nlines", "one"]


def test_open_quotes_are_refused_line_by_line(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Batch,Note\nB1,"two\nlines"\nB2,one\n')
    with pytest.raises(Exception, match="multiline=True"):
        delimited.read_delimited(spark, str(tmp_path / "x.csv")).collect()
    (tmp_path / "y.csv").write_text('Batch,Size\nB1,5" pipe\n')
    rows = delimited.read_delimited(spark, str(tmp_path / "y.csv"), check_quotes=False).collect()
    assert rows[0].Batch == "B1"


def test_header_search_length(spark, tmp_path):
    (tmp_path / "x.csv").write_text("".join(f"title {i}\n" for i in range(21)) + "Batch ID,Result,Test\nB1,2,3\n")
    got = delimited.read_delimited(spark, str(tmp_path / "x.csv"), None, search_rows=30).collect()
    assert [tuple(r) for r in got] == [("B1", "2", "3")]


def test_header_scores(spark):
    df = spark.createDataFrame([(["Batch ID", "Result"],), (["1,5", "2"],), (["", " "],)], "c array<string>")
    scores = [r.s for r in df.select(delimited.header_score(F.col("c")).alias("s")).collect()]
    assert scores == [2 + 2 + 1 + 0.75, 2 + 2 + 0, -1.0]


def test_profile_round_trip(spark, folder):
    p = profile.ImportProfile(
        profile.TableImport(str(folder / "p"), "Batch ID", header_row=None),
        profile.TableImport(str(folder / "qc.csv"), "Batch Identifier", long_name="Test Name", long_value="Result"),
        ["yield_percent"])
    profile.save_profile(spark, p, str(folder / "profile"))
    again = profile.load_profile(spark, str(folder / "profile"))
    assert again == p
    got = {r.batch_id: (r["NaOH Added"], r.yield_percent) for r in profile.replay(spark, again).data.collect()}
    assert got == {"MB001": (100.3, 82.9), "mb-002": (99.0, 80.0), "MB003": (97.5, 80.0)}


def test_link_step(spark):
    process = spark.createDataFrame([("B-1", "1,5 g", 1), ("b1", "2,5 g", 2), ("B2", "3 g", 3)], "Batch string, dose string, line int")
    qc = spark.createDataFrame([("B 1", "80 %", 1), ("B2", "<81 %", 2)], "Batch string, yield_percent string, line int")
    found = workflow.link(process, qc.withColumnRenamed("line", "qc_line"), "Batch", "Batch", ["yield_percent"], ["line"],
                          ["qc_line"], "mean")
    assert sorted(tuple(r) for r in found.data.select("batch_id", "dose", "yield_percent").collect()) == [
        ("B-1", 2.0, 80.0), ("B2", 3.0, 81.0)]
    assert found.qc_report.first().qualifier_count == 1


def write_workbook(path):
    """A tiny workbook: shared and inline texts, a number, a date, two sheets."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = ('<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row>'
            '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>When</t></is></c></row>'
            '<row r="3"><c r="A3" t="inlineStr"><is><t>MB1</t></is></c><c r="B3"><v>1.5</v></c><c r="D3" s="1"><v>45292</v></c></row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="Data" sheetId="1" r:id="r1"/>'
                                      f'<sheet name="Other" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
                                                 '<Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Batch</t></si><si><r><t>Do</t></r><r><t>se</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData/></worksheet>")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    write_workbook(path)
    assert [(r.sheet, r.sheet_position) for r in workbook.list_sheets(spark, [path]).orderBy("sheet_position").collect()] == [
        ("Data", 0), ("Other", 1)]
    row = workbook.read_sheet(spark, [path], header_row=1).first().asDict()
    assert row == {"Batch": "MB1", "Dose": "1.5", "unnamed_column_3": None, "When": "2024-01-01 00:00:00"}
    with pytest.raises(InputError):
        workbook.list_sheets(spark, ["a.xls"])


def test_records_keep_nulls(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.5)], "a int, b double")
    assert json.loads(sinks.records(df, ["a"], 2).first().records) == [{"a": 1, "b": None}, {"a": 2, "b": 2.5}]


def test_write_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    sinks.write_table(df, str(tmp_path / "t"), "csv")
    assert spark.read.csv(str(tmp_path / "t"), header=True).first().b == "x"


def test_templates(spark):
    for name, schema in contracts.CONTRACTS.items():
        assert contracts.template(spark, name).schema == schema


def test_many_layouts_are_one_scan(spark):
    """300 headers with the same columns in other places, some of them missing."""
    draw = random.Random(1)
    names = [f"col {i}" for i in range(6)]
    rows, expected = [], set()
    for f in range(300):
        own = draw.sample(names, draw.randint(2, 6))
        body = [[f"{n}-{f}-{r}" for n in own] for r in range(2)]
        text = "\n".join(",".join(x) for x in [own, *body])
        rows.append((f"f{f}", text))
        expected |= {tuple(f"{n}-{f}-{r}" if n in own else None for n in names) for r in range(2)}
    lines = delimited.split_records(spark.createDataFrame(rows, "file string, content string"), "file", "content")
    found = delimited.load(lines, delimited.fixed_headers(lines, 0))
    assert sorted(found.columns) == names
    assert {tuple(r) for r in found.select(*[f"`{n}`" for n in names]).collect()} == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0


def test_headers_of_whole_texts_need_no_shuffle(spark):
    """Whole texts give the headers and rows of the search by file, and no row of them is sent anywhere."""
    texts = [("a", TITLED), ("b", PLAIN), ("c", "\n \n"), ("d", "1,2\n1,2\n"), ("e", "x\n\nBatch ID,Result\nB1,\"1\n2\"\n")]
    df = spark.createDataFrame(texts, "file string, content string")
    lines = delimited.split_records(df, "file", "content")
    plain = lines.drop("row")  # as from files read by many tasks
    found = delimited.text_headers(df, "file", "content")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in delimited.suggest_headers(plain).select(found.columns).collect()}
    assert {r.file: r.header_row for r in found.collect()} == {"a": 2, "b": 0, "d": 0, "e": 1}
    loaded = delimited.load(delimited.with_headers(df, "file", "content"), None, keep_file=True)
    by_file = delimited.load(plain, delimited.suggest_headers(plain), keep_file=True)
    assert loaded.columns == by_file.columns
    assert sorted(map(str, loaded.collect())) == sorted(map(str, by_file.collect()))
    for frame in (found, loaded):
        assert "Exchange hashpartitioning" not in frame._jdf.queryExecution().executedPlan().toString()
