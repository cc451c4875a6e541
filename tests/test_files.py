"""Documents that come line by line against documents parsed as a whole."""

import json
import tracemalloc

import pytest

from quadrille.catalog_more import as_array
from quadrille.sources.rdf import document_parts, json_items, parse_document, read_documents

TURTLE = '''@prefix ex: <http://ex/> . # a comment with """ in it
ex:a ex:p """one
two "" three""" ; ex:q \'\'\'x
"quoted" y\'\'\' , "a#b" ; ex:r [ ex:s ( 1 2.5
 3e1 ) ] .
GRAPH ex:g { ex:a ex:b ex:c .
 ex:d ex:e "f"@en-GB }
ex:g2 { _:x ex:k <<( ex:a ex:b "t" )>> . }
PREFIX y: <http://y/>
y:s a y:T .
'''
JSON = '[ {"@id":"http://a","http://p":[1,{"@value":"x"},{"@list":[1,2]}]}\n , {"@id":"_:b",\n"http://q":\n{"http://r":"]"}} ]\n'


def by_line(text, fmt):
    return [q for part in document_parts((x + "\n" for x in text.split("\n")), fmt, None, 2) for q in part]


@pytest.mark.parametrize("text, fmt", [(TURTLE, "trig"), (JSON, "jsonld"), ('{"@context":{"x":"http://x/"},\n"@graph":[{"x:a":1}]}', "jsonld"), ("[]", "jsonld"), ("", "turtle")])
def test_lines_give_the_quads_of_the_whole(text, fmt):
    assert by_line(text, fmt) == parse_document(text, fmt)


def test_broken_arrays_are_refused():
    assert list(json_items(["[1", "2 ,\n", "3]"])) == [12, 3]
    for bad in ('[{"a":1}', "[1 2]", "[1,]", "[1] x", "["):
        with pytest.raises(ValueError):
            list(json_items([bad]))


def most_held(lines, fmt):
    tracemalloc.start()
    n = sum(len(p) for p in document_parts(lines, fmt, None, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, peak


@pytest.mark.parametrize("fmt, line", [("turtle", '<http://ex/{}> <http://ex/p> "x" .\n'), ("trig", '<http://g> {{ <http://ex/{}> <http://ex/p> "x" . }}\n'), ("jsonld", ',{{"@id":"http://ex/{}","http://ex/p":[{{"@value":"x"}}]}}\n')])
def test_memory_does_not_grow_with_the_document(fmt, line):
    def lines(n):
        for i in range(n):
            text = line.format(i)
            yield "[" + text[1:] if fmt == "jsonld" and i == 0 else text
        if fmt == "jsonld":
            yield "]\n"

    (few, small), (many, large) = most_held(lines(1_000), fmt), most_held(lines(10_000), fmt)
    assert (few, many) == (1_000, 10_000)
    assert large < 2 * small


def test_files_in_pieces_keep_their_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    text = "@prefix ex: <http://ex/> .\n" + "".join(f'ex:s{i} ex:p """{i}\nx""" .\n' for i in range(300))
    (tmp_path / "a.ttl").write_text(text)
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/part.txt").write_text("".join(json.dumps({"@id": f"http://ex/s{i}", "http://ex/p": i}) + "\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert sorted(r.o.lex for r in read_documents(spark, str(tmp_path / "a.ttl"), "turtle").collect()) == sorted(f"{i}\nx" for i in range(300))
        path = as_array(spark, str(tmp_path / "lines"))
        assert sorted(int(r.o.lex) for r in read_documents(spark, path, "jsonld").collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
