"""Fill-in-middle: against units cut one by one, hard rows, round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_middle

from .conftest import HARD


def by_units(doc_id, text, seed=1):
    """(n, form, output) of a text, by its list of units."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", text
    return len(units), *(("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}"))


MARKS = ["<P>", "<S", "P>", "a<P>b", "<<P>>", "<S<", "<M", "><", "$1 \\1 {2}+", "x\r\n y\x85z", "퟿😀é", "M>", "<", ">"]


@pytest.mark.parametrize("seed", [1, 7])
def test_against_units(spark, hard, docs, seed):
    rows = [(i, t) for i in range(40) for t in MARKS]
    rows = hard.select("doc_id", "text").unionByName(docs.select("doc_id", "text")).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    out = fill_middle.opened(fill_middle.transformed(rows, seed)).collect()
    assert len(out) == rows.count()
    for r in out:
        assert (r.n, r.form, r.output) == by_units(r.doc_id, r.text, seed)
        assert r.restored == (r.text or "") and (r.prefix is None) == (r.form == "plain")
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_hard_rows(hard, none):
    out = fill_middle.transformed(hard)
    assert out.columns == [*hard.columns, "n", "form", "output"] and out.count() == len(HARD)
    assert fill_middle.opened(fill_middle.transformed(none)).count() == 0
    clash = fill_middle.transformed(hard.withColumn("n", F.lit("x")).withColumn("_n", F.lit(3)).withColumn("_a", F.lit(4)).withColumn("_form", F.lit(5)))
    assert clash.columns[-3:] == ["n", "form", "output"] and {r._n for r in clash.select("_n", "n").collect()} == {3}
    both = clash.agg(F.sum("n")).first()[0], out.agg(F.sum("n")).first()[0]
    assert both[0] == both[1]


def test_a_long_text_needs_no_deep_stack(spark):
    rows = spark.range(8).select(F.col("id").alias("doc_id"), F.expr("repeat('Ab cd, é\n', 150000)").alias("text"))
    out = fill_middle.opened(fill_middle.transformed(rows)).select("n", (F.col("restored") == F.col("text")).alias("same")).collect()
    assert all(r.n == 1_050_000 and r.same for r in out)
