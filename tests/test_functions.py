import pytest
from pyspark.sql import functions as F

from lectern.functions import estimate as E
from lectern.functions import text as X
from lectern.functions.spoken import sentence_ranges


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("code, said", [("max_tokens", "max tokens"), ("parseHTTPResponse", "parse HTTP Response"), ("kebab-case", "kebab case"), ("src/lib/db.ts", "src/lib/db.ts"), ("npm run dev", "npm run dev"), ("", "")])
def test_spoken_identifier(spark, code, said):
    assert one(spark, X.spoken_identifier(F.lit(code))) == said


@pytest.mark.parametrize("text, said", [("See https://www.example.com/a/b?c=d.", "See example.com."), ("http://a.org and https://b.org/x, too", "a.org and b.org, too"), ("no links", "no links"), ("(https://example.com:8080/)", "(example.com:8080)")])
def test_spoken_urls(spark, text, said):
    assert one(spark, X.spoken_urls(F.lit(text))) == said


@pytest.mark.parametrize("name, source, title", [("report.PDF", "pdf", "report"), ("notes.markdown", "md", "notes"), ("README", None, "README"), (".txt", None, ".txt"), ("a.", None, "a."), ("my_long--name.txt", "txt", "my long name"), ("", None, "Untitled")])
def test_file_names(spark, name, source, title):
    assert one(spark, X.source_for_filename(F.lit(name))) == source
    assert one(spark, X.title_for_filename(F.lit(name))) == title


def test_lines(spark):
    lines = F.array(*map(F.lit, ["an exam-", "ple of hy-", "phens", "A- ", "Capital", "well -", "known"]))
    assert one(spark, X.join_hyphenated(lines)) == ["an example of hyphens", "A- ", "Capital", "well -", "known"]
    assert one(spark, X.lines_to_paragraphs(F.array(*map(F.lit, ["a ", "b", "", " ", "c"])))) == ["a b", "c"]
    assert one(spark, X.lines_to_paragraphs(F.array(F.lit(" "), F.lit("")))) == []
    assert one(spark, X.normalize_whitespace(F.lit("  a ​ b\t "))) == "a b"


@pytest.mark.parametrize("seconds, clock, left", [(252.0, "4:12", "4 min left"), (9.0, "0:09", "under a minute left"), (3672.0, "1:01:12", "61 min left"), (0.0, "0:00", "finished"), (-5.0, "0:00", "finished")])
def test_times(spark, seconds, clock, left):
    assert one(spark, E.format_clock(F.lit(seconds))) == clock
    assert one(spark, E.format_remaining(F.lit(seconds))) == left


@pytest.mark.parametrize("text, sentences", [("One. Two! Three?", ["One.", "Two!", "Three?"]), ("Dr. Smith paid $3.50. He left.", ["Dr. Smith paid $3.50.", "He left."]), ("Use e.g. this one. Done.", ["Use e.g. this one.", "Done."]), ('He said "Stop." Then ran.', ['He said "Stop."', "Then ran."]), ("", [])])
def test_sentences(text, sentences):
    assert [text[a:b] for a, b in sentence_ranges(text)] == sentences
