"""Documents routed in one pass, against the windows over tables of lines."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import blocks as B
from lectern.operators import pdf as P
from lectern.operators import routing as R

STYLED = "doc_id long, page_no int, piece_no int, str string, x double, y double, width double, height double, bold boolean, italic boolean, mono boolean"
FIGURES = "doc_id long, page_no int, image_id string, y double, width int, height int"
OPENINGS = ["Word", "word", "12. item", "3) item", "• ", "•", "💡 Mind", "ℹ", "📖 ℹ", "Figure 2 shows", "Key:", "it ends.", "con-", "tinued", "\x01", "a\x02b", "two  words", "  ", "x​", "Ünder-", "über", "\x03 ", "​"]


def by_tables(pieces, figures):
    """route() from the operators on tables."""
    lines = P._marked(P.styled_lines(pieces).repartition("doc_id")).where("NOT running").select(*[c.split()[0] for c in P.LINES.split(", ")])
    plain = P.structure_ratio(lines).where(F.col("ratio") < P.LEAST_STRUCTURE).select("doc_id")
    said = P.plain_paragraphs(P.page_rows(pieces.join(plain, "doc_id", "left_semi")))
    run = F.struct(F.col("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("code"))
    order = W.partitionBy("doc_id").orderBy("page_no", "para_no")
    flat = said.select("doc_id", (F.row_number().over(order) - 1).alias("block_no"), F.lit("paragraph").alias("kind"), F.array(run).alias("runs"))
    return P.build_blocks(lines, figures, P.LEAST_STRUCTURE).unionByName(flat, allowMissingColumns=True)


def some_documents(seed, n):
    """Pieces and figures: from plain documents to those whose lines are all of some kind, with running lines or none."""
    r = random.Random(seed)
    pieces, figures = [], []
    for doc in range(n):
        odd, heads, code, number = r.choice([0.0, 0.05, 0.2, 0.7]), r.random() < 0.5, r.choice([0.02, 0.3, 0.9]), 0
        for page in range(r.choice([0, 1, 2, 4, 6])):
            y = 760.0
            texts = [*([f"Report {page}"] if heads else []), *[None] * r.randrange(14), *([f"PAGE {page + 1}"] if heads and r.random() < 0.8 else [])]
            for text in texts:
                own, x = r.random() < odd, 72.0
                mono = own and r.random() < code
                height = r.choice([10.0, 12.0, 15.0, 24.0, 9.6]) if own else 10.0
                if own:
                    x = r.choice([72.0, 76.0, 78.0, 80.0, 90.0, 103.0, 110.0])
                bold, y = own and r.random() < 0.5, y - r.choice([14.0, 14.0, 14.0, 12.0, 30.0])
                for k in range(r.choice([1, 2, 3])):
                    word = text if text and not k else r.choice(OPENINGS if own and not k else ["word", "goes", "on", "tail-", "end.", "Next", "tail-"])
                    pieces.append((doc, page, number, word, x + 40 * k, y + r.choice([0, 0, 0.5]), r.choice([40.0, 30.0, None]), height, bold and (not k or r.random() < 0.5), r.random() < 0.1, mono or (own and r.random() < 0.1)))
                    number += 1
                if r.random() < 0.03:
                    figures.append((doc, page, f"i{len(figures)}", y - r.choice([0, 5]), 60, 70))
    figures.append((n, 0, "alone", 1.0, 50, 50))
    r.shuffle(pieces)
    return pieces, figures


def rows_of(table):
    return sorted(((r.doc_id, r.block_no, -1 if r.child_no is None else r.child_no, repr(r)) for r in table.select([c.split()[0] for c in P.PDF_BLOCKS.split(", ")]).collect()), key=repr)


def test_as_by_tables(spark):
    pieces, figures = some_documents(5, 250)
    pieces, figures = spark.createDataFrame(pieces, STYLED), spark.createDataFrame(figures, FIGURES)
    want, got = rows_of(by_tables(pieces, figures)), rows_of(R.route(pieces, figures))
    assert got == want
    assert {"heading", "callout", "code", "list-item", "meta", "caption", "figure", "paragraph"} <= {r.kind for r in R.route(pieces, figures).select("kind").distinct().collect()}
    whole = {r.doc_id: r for r in B.gathered_documents(by_tables(pieces, figures)).collect()}
    assert {r.doc_id: r for r in R.gathered(pieces, figures).collect()} == whole and len(whole) > 80


def test_batches_do_not_matter(spark, monkeypatch):
    pieces, figures = some_documents(6, 20)
    table = R._dealt_out(spark.createDataFrame(pieces, STYLED), spark.createDataFrame(figures, FIGURES)).coalesce(1).sortWithinPartitions("doc_id", "page_no", F.desc("top")).toArrow()
    whole = list(R.documents(iter(table.to_batches())))
    monkeypatch.setattr(R.G, "CHUNK", 7)
    assert list(R.documents(iter(table.to_batches(max_chunksize=5)))) == whole and len(whole) > 10


def test_one_shuffle(spark):
    pieces, figures = spark.createDataFrame([], STYLED), spark.createDataFrame([], FIGURES)
    for table in (R.gathered(pieces), R.gathered(pieces, figures), R.route(pieces, figures)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan
    assert R.gathered(pieces, figures).count() == 0
