"""Large files in byte ranges: the same rows wherever the ranges are cut."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from chronolith.sources import json_split, nested_json, split_scan, xml_export


@pytest.fixture
def cut(spark):
    """Sets how many bytes a range has."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        for k in before:
            spark.conf.set(k, f"{size}b")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def by_element_tree(path):
    depth, out = 0, []
    for event, e in ET.iterparse(path, events=("start", "end")):
        if e.tag == "Correlation":
            depth += 1 if event == "start" else -1
        elif e.tag == "Record" and event == "start" and depth == 0:
            out.append(tuple(e.get(f) for f in xml_export.FIELDS))
    return sorted(out, key=repr)


def made_export(seed, n):
    draw = random.Random(seed)
    record = lambda i: draw.choice([f'<Record type="t{i}" sourceName="Bo&#8217;s &lt;x&gt;" value="{i} &gt; 1"/>', f"<Record\n type='t{i}'\tsourceName = 'a \"b\"' unit=\"it's\" device=\"> --> ]> ?>\"/>", f'<Record type="t{i}" value="a\nb"><MetadataEntry key="Record" value="&amp;lt;"/></Record>', f'<Record type="same" startDate="2020"></Record>', "<RecordList type='no'/>"])
    noise = lambda: draw.choice(["<!-- <Record type='no'/> <Correlation> -->", "<!---->", "<![CDATA[ <Record type='no'/> </Correlation> --> ]]>", "<?pi <Record type='no'/> ?>", "text ]> -->", "<Correlation type='alone'/>", "<CorrelationX>", "</CorrelationX>"])
    parts = ['<?xml version="1.0"?>', "<!DOCTYPE HealthData [\n<!-- ]> <Record/> -->\n<!ELEMENT Record (Meta*)>\n<?x ]> ?>\n<!ATTLIST Record type CDATA 'it > ]>'>\n]>", "<HealthData locale='en'>"]
    for i in range(n):
        kind = draw.random()
        if kind < 0.6:
            parts.append(record(i))
        elif kind < 0.8:
            parts.append(noise().replace("<CorrelationX>", "<CorrelationX/>").replace("</CorrelationX>", ""))
        else:
            inner = "".join(draw.choice([record(i), noise().replace("<CorrelationX>", "").replace("</CorrelationX>", ""), "<Correlation>" + record(i) + "</Correlation >"]) for _ in range(draw.randint(0, 5)))
            parts.append(f'<Correlation type="x" device="/">{inner}</Correlation>' + record(i) * draw.randint(0, 1))
    return draw.choice(["", "\n"]).join(parts) + "</HealthData>"


@pytest.mark.parametrize("size", [37, 101, 400, 1 << 20])
def test_xml_ranges(spark, cut, tmp_path, size):
    cut(size)
    (tmp_path / "in").mkdir()
    want = []
    for seed in range(2):
        path = tmp_path / f"in/{seed}.xml"
        path.write_text(made_export(seed, 40))
        want += by_element_tree(path)
    got = xml_export.records(spark, str(tmp_path / "in"))
    assert size > 1000 or got.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_xml_with_many_unusual_ranges(spark, cut, tmp_path, monkeypatch):
    """Beyond a number of ranges, pieces are joined with their states and put in order again."""
    monkeypatch.setattr(split_scan, "BROADCAST_RANGES", 0)
    cut(60)
    path = tmp_path / "a.xml"
    path.write_text(made_export(7, 25))
    assert sorted(map(tuple, xml_export.records(spark, str(path)).collect()), key=repr) == by_element_tree(path)


def test_xml_counts_without_a_second_parse(spark, cut, tmp_path):
    cut(50)
    path = tmp_path / "a.xml"
    path.write_text("<HealthData><Correlation><Record type='x'/><Record type='y'/></Correlation><!-- <Record type='z'/> --></HealthData>")
    with pytest.raises(xml_export.EmptyExportError):
        xml_export.read(spark, str(path), "subject_x")


def test_malformed_tags_are_told(spark, tmp_path):
    for k, text in enumerate(["<a><Record type=x/></a>", "<a><Record type='x' unit/></a>"]):
        (tmp_path / f"{k}.xml").write_text(text)
        with pytest.raises(Exception, match="MalformedExportError"):
            xml_export.records(spark, str(tmp_path / f"{k}.xml")).collect()
    (tmp_path / "d.xml").write_text("<!DOCTYPE a [<!ENTITY b '<c/>'>]><a><Record type='x'/></a>")
    with pytest.raises(xml_export.MalformedExportError):
        xml_export.read(spark, str(tmp_path / "d.xml"), "subject_x")


def test_states_of_pieces():
    for before, piece, want in [
        ("text", "!-- x", "comment"), ("text", "!---->", "text"), ("comment", "a --> b", "text"), ("comment", "a -- > b", "comment"), ("text", "![CDATA[x]] >", "cdata"), ("cdata", "]]>", "text"),
        ("text", "?xml a?>", "text"), ("text", "?x", "instruction"), ("text", "!DOCTYPE a>", "text"), ("text", "!DOCTYPE a SYSTEM 'b>' [", "doctype"), ("doctype", "!ELEMENT a ']>'>", "doctype"), ("doctype", "!ELEMENT a>]\n>", "text"),
        ("doctype", "!-- ]>", "doctype comment"), ("doctype comment", "' -->", "doctype"), ("doctype comment", "--> ]>", "text"), ("doctype", "? ]>", "doctype instruction"), ("text", "Record a='-->'>", "text"),
    ]:
        assert xml_export.after(before, piece) == want, (before, piece)


# JSON


def made_value(draw, depth=0):
    text = lambda: "".join(draw.choice(["a", "}", "{", "]", '"', "\\", "é", ",", ":", " "]) for _ in range(draw.randint(0, 6)))
    kind = draw.random()
    if depth < 3 and kind < 0.3:
        return {text() + str(i): made_value(draw, depth + 1) for i in range(draw.randint(0, 3))}
    if depth < 3 and kind < 0.45:
        return [made_value(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    return text() if kind < 0.8 else draw.choice([1, -2.5, None, True])


def dumped(draw, value):
    return json.dumps(value, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1]), separators=draw.choice([None, (",", ":"), (" , ", " : ")]))


def read_back(rows):
    return sorted((r.name or "", json.dumps(json.loads(r.text), sort_keys=True)) for r in rows)


@pytest.mark.parametrize("size", [23, 90, 700, 1 << 22])
def test_json_arrays_in_ranges(spark, cut, tmp_path, size):
    cut(size)
    for seed in range(4):
        draw = random.Random(seed)
        values = [made_value(draw) for _ in range(60)]
        path = tmp_path / f"{seed}.json"
        path.write_text(dumped(draw, values))
        want = sorted(("", json.dumps(v, sort_keys=True)) for v in values if isinstance(v, dict | list))
        assert read_back(json_split.elements(spark, str(path)).collect()) == want, seed


@pytest.mark.parametrize("size", [29, 150, 1 << 22])
def test_nested_json_in_ranges(spark, cut, tmp_path, size):
    cut(size)
    (tmp_path / "in").mkdir()
    want = []
    for seed in range(3):
        draw = random.Random(seed)
        document = {"metadata": {"records": {"data": [{"no": 1}]}}, "odd": [{"records": {"data": [{"no": 2}]}}], "odder": {"records": [{"data": [{"no": 3}]}], "data": [{"no": 4}]}}
        for i in range(9):
            rows = [v for v in (made_value(draw) for _ in range(draw.randint(0, 6)))]
            document[f"Section{i} \\ \"é"] = {"x": made_value(draw), "records": {"data": rows, "more": [{"data": [{"no": 5}]}]}, "data": [{"no": 6}]}
            want += [(f"Section{i} \\ \"é", json.dumps(v, sort_keys=True)) for v in rows if isinstance(v, dict | list)]
        (tmp_path / f"in/{seed}.json").write_text(dumped(draw, document))
    got = json_split.elements(spark, str(tmp_path / "in"), nested_json.PLACE)
    assert read_back(got.collect()) == sorted(want)


def test_json_equals_the_whole_file_reader(spark, cut, tmp_path):
    """A series file as Spark reads it whole, cut at odd places."""
    rows = [{"dateTime": f"2020-01-01 00:{i % 60:02}:00", "value": {"bpm": i, "confidence": i % 3}} for i in range(500)]
    path = str(tmp_path / "hr.json")
    (tmp_path / "hr.json").write_text(json.dumps(rows))
    ddl = "dateTime string, value struct<bpm:string,confidence:string>"
    want = sorted(spark.read.schema(ddl).option("multiLine", True).json(path).collect())
    for size in (64, 333, 5000):
        cut(size)
        texts = json_split.elements(spark, path)
        assert texts.rdd.getNumPartitions() > 3
        assert sorted(texts.select(F.from_json("text", ddl).alias("r")).select("r.*").collect()) == want


def test_brackets_and_names():
    found = json_split.Brackets(rb'{"a\\": {"b\"}": [1, "]"] }')
    at, step = found.outside(False)
    assert bytes(found.data[i] for i in at) == b"{{[]}" and step.tolist() == [1, 1, 1, -1, -1]
    assert [found.name(int(i)) for i in at[:3]] == [None, "a\\", 'b"}']
    assert json_split.Brackets(rb'x\\" : {').outside(True)[0].tolist() == [7]
    assert json_split.Brackets(b'x" : {').name(5) == json_split.CUT
