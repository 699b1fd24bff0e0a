"""Files written and read back."""

import csv
import glob

from sysweave.model import TRIPLE_SCHEMA
from sysweave.operators import shapes
from sysweave.sources import rdf

XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e#">
 <rdf:Description rdf:about="urn:p1">
  <e:name>one</e:name>
  <e:size rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:size>
  <e:near rdf:resource="urn:p2"/>
  <e:near rdf:resource="urn:p3"/>
 </rdf:Description>
 <rdf:Description rdf:nodeID="b1">
  <e:name>two</e:name>
 </rdf:Description>
</rdf:RDF>
"""


def test_rdf_xml(spark, tmp_path):
    path = tmp_path / "g.xml"
    path.write_text(XML)
    got = {(r.s, r.p, r.o, r.o_kind, r.o_type) for r in rdf.read_rdf_xml(spark, str(path)).collect()}
    assert got == {
        ("urn:p1", "e:name", "one", "lit", "string"),
        ("urn:p1", "e:size", "5", "lit", "integer"),
        ("urn:p1", "e:near", "urn:p2", "uri", None),
        ("urn:p1", "e:near", "urn:p3", "uri", None),
        ("_:b1", "e:name", "two", "lit", "string"),
    }


def test_ntriples(spark, tmp_path):
    rows = [
        ("urn:a", "urn:p", 'say "hi"\\\n\tend', "lit", "string", None),
        ("urn:a", "urn:q", "5", "lit", "integer", None),
        ("urn:a", "urn:r", "ça \u2028 va", "lit", "@fr", None),
        ("_:x", "urn:p", "urn:b", "uri", None, None),
        ("urn:a", "urn:p", "_:x", "bnode", None, None),
    ]
    df = spark.createDataFrame(rows, TRIPLE_SCHEMA)
    path = str(tmp_path / "nt")
    rdf.write_ntriples(df, path)
    assert sorted(tuple(r) for r in rdf.read_ntriples(spark, path).collect()) == sorted(rows)


def test_calls_files(spark, tmp_path):
    calls = spark.createDataFrame(
        [("s", 1, 7, "read@SYS", ["3", "x,y"], "3", "10:00", "10:00", "plain")],
        "session string, seq bigint, pid bigint, fn string, args array<string>, ret string, "
        "t_start string, t_end string, status string",
    )
    for fmt in ("csv", "json", "text"):
        shapes.write_calls(calls, str(tmp_path / fmt), fmt, ordered=True)
    (part,) = [p for p in glob.glob(str(tmp_path / "csv" / "*.csv"))]
    with open(part) as f:
        rows = list(csv.reader(f))
    assert rows[0] == shapes.CALL_COLUMNS and len(rows[1]) == 9
    assert spark.read.json(str(tmp_path / "json")).first()["function"] == "read@SYS"
    assert spark.read.text(str(tmp_path / "text")).first().value.split("\t")[4] == "read@SYS"
