import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import assembly

PAGES = "document string, page int, text string"


def made(seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["ab", "한글", "x" * 9, "", "# not", "z" * 70])
    line = lambda: draw.choice(["## head", "# top", "", "  "]) if draw.random() < 0.3 else " ".join(word() for _ in range(draw.randrange(8)))
    rows = [(f"d{d}", p, "\n".join(line() for _ in range(draw.randrange(40)))) for d in range(4) for p in range(1, 4)]
    return rows + [("e", 1, None), ("e", 2, ""), ("e", 3, "\n\n"), ("e", 4, "one"), ("e", 5, "y" * 400)]


@pytest.mark.parametrize("seed", range(2))
def test_every_character_is_in_one_leaf(spark, seed):
    rows = made(seed)
    pages = spark.createDataFrame(rows, PAGES)
    got = assembly.assembled(pages, limit=60).cache()
    assert got.columns == list(assembly.COLUMNS)
    texts = {(d, p): t for d, p, t in rows if t}
    leaves: dict = {}
    for r in got.where("level = 'leaf'").collect():
        assert r["text"] == texts[r["document"], r["page"]][r["start"] : r["end"]] and 0 < r["end"] - r["start"] <= 60
        leaves.setdefault((r["document"], r["page"]), []).append(r)
    assert leaves.keys() == texts.keys()
    for key, its in leaves.items():
        assert "".join(r["text"] for r in sorted(its, key=lambda r: r["start"])) == texts[key]
        # greedy: two neighbours of a section wouldn't have fit, unless a line was cut between them
        its.sort(key=lambda r: r["start"])
        for a, b in zip(its, its[1:], strict=False):
            if a["parent_id"] == b["parent_id"] and a["text"].endswith("\n"):
                head = b["text"].split("\n")[0]
                assert a["end"] - a["start"] + len(head) + (len(head) < len(b["text"])) > 60
    assert assembly.assembly_cover(got).count() == 0 and assembly.link_violations(got, pages).count() == 0
    assert got.where("level = 'section' AND title IS NOT NULL").count() > 0


def test_broken_links_are_found(spark):
    pages = spark.createDataFrame([("d", 1, "# a\nsome text\n# b\nmore text, much more text\nand an end"), ("d", 2, "second page")], PAGES)
    good = assembly.assembled(pages, limit=20).cache()
    leaf = good.where("level = 'leaf' AND text LIKE 'more%'").first()
    section = good.where("level = 'section' AND title = 'b'").first()
    page = good.where("level = 'page' AND page = 1").first()

    def broken(where, **columns):
        df = good
        for c, v in columns.items():
            df = df.withColumn(c, F.when(F.expr(where), v if not isinstance(v, str) else F.lit(v)).otherwise(F.col(c)))
        return {(r["chunk_id"], r["rule"]) for r in assembly.link_violations(df, pages).collect()}, {(r["parent_id"], r["rule"]) for r in assembly.assembly_cover(df).collect()}

    its = f"chunk_id = '{leaf['chunk_id']}'"
    assert broken(its, text="nothing of it")[0] == {(leaf["chunk_id"], x) for x in ("digest", "not_in_parent", "link")}
    assert broken(its, parent_digest="0")[0] == {(leaf["chunk_id"], "parent_digest")}
    assert broken(its, parent_id="0")[0] == {(leaf["chunk_id"], "parent_missing")}
    links, cover = broken(its, start=F.col("start") + 1)
    assert links == {(leaf["chunk_id"], "not_in_parent")} and cover == {(section["chunk_id"], "gap")}
    assert broken(its, start=F.col("start") - 1)[1] == {(section["chunk_id"], "overlap")}
    # a section that says something else breaks the chain above and below it
    got = broken(f"chunk_id = '{section['chunk_id']}'", link="0")[0]
    assert (section["chunk_id"], "link") in got and (leaf["chunk_id"], "link") in got
    gone = good.where(~F.expr(its))
    assert {(r["parent_id"], r["rule"]) for r in assembly.assembly_cover(gone).collect()} == {(section["chunk_id"], "gap")}
    other = spark.createDataFrame([("d", 1, page["text"] + "!"), ("d", 2, "second page"), ("d", 3, "new")], PAGES)
    assert {(r["chunk_id"], r["rule"]) for r in assembly.link_violations(good, other).collect()} == {(page["chunk_id"], "not_the_source"), ("d/3", "page_missing")}


def test_cover_violations(spark):
    wholes = spark.createDataFrame([("a", 0, 10), ("b", 5, 9), ("c", 0, 4), ("e", 0, 3)], "k string, start int, end int")
    parts = [("a", 0, 4), ("a", 4, 10), ("b", 5, 7), ("b", 6, 8), ("c", 1, 5), ("x", 0, 1), ("e", 0, 3), ("e", 2, 2)]
    got = {tuple(r) for r in assembly.cover_violations(spark.createDataFrame(parts, "k string, start int, end int"), wholes, ["k"]).collect()}
    assert got == {("b", 6, 7, "overlap"), ("b", 8, 9, "gap"), ("c", 0, 1, "gap"), ("c", 1, 5, "outside"), ("x", 0, 1, "outside"), ("e", 2, 2, "empty")}


def test_scopes_may_not_be_torn(spark):
    pages = spark.createDataFrame([("d", 1, "first line\nsecond line\nthird line")], PAGES)
    scopes = spark.createDataFrame([("d", 1, 0, 10), ("d", 1, 5, 30)], "document string, page int, start int, end int")
    assert [tuple(r) for r in assembly.uncovered_scopes(assembly.assembled(pages, limit=24), scopes).collect()] == [("d", 1, 5, 30)]
