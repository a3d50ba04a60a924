"""Cutting notes at marks against the plain regular expressions that say the same, on random texts."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.plans.queries import ORACLE_SQL, QUERIES

PARTS = ["---", "-", "--", "\n", "\n\n", "## Themes", "# Themes", "##Themes", "## themes  ", "### Themes", "## Raw", "##\t", "# ", "#", " ", "\t", "\x0b", "\x85", "\xa0", " ", "　", "​", "\x1c", "word", "Ünï", "- a", "\r\n", "Themes\n"]


def random_texts(n=4000):
    rng = random.Random(3)
    return [None, "", "---", "------", "---\n---", "x---y---z", *("".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(n)), *("---\n" + "".join(rng.choices(PARTS, k=8)) for _ in range(n // 4))]


WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def test_cuts_equal_plain_expressions(spark):
    rows = spark.createDataFrame([(t,) for t in random_texts()], "t string").repartition(4)
    lazy = F.regexp_extract("t", r"(?is)##?[ \t]*Themes[ \t]*\n(.*?)(?=\n##?\s|\z)", 1)
    found = rows.select("t", T.frontmatter(F.col("t")).alias("front"), T.body(F.col("t")).alias("body"), T.section(F.col("t"), "Themes").alias("section"), T.strip(F.col("t")).alias("strip"),
                        F.regexp_replace(lazy, r"(?U)^\s+|\s+$", "").alias("lazy"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("regex")).collect()
    assert len(found) == len(random_texts())
    for r in found:
        if r.t is None:
            assert (r.front, r.body, r.section, r.strip) == ("", None, None, None)
            continue
        parts = r.t.split("---", 2)
        whole = r.t.startswith("---") and len(parts) == 3
        assert r.front == (parts[1] if whole else "")
        assert r.body == (parts[2] if whole else r.t).strip(WHITE)
        assert r.section == r.lazy and r.strip == r.regex == r.t.strip(WHITE)


def test_white_space_is_that_of_unicode():
    assert set(T.WHITE) == set(WHITE) and all(re.fullmatch(r"\s", c) for c in T.WHITE)


def test_sections_found_keep_their_blanks_and_blank_texts(spark, tmp_path):
    """Texts with odd white space or none: what the query finds is what its SQL states."""
    odd = ["a", " a \n", "\xa0a\xa0", "\x85a", " a b ", "", " ", "　", "\t\x0b\x0c\r\n", None, "a\r\nb",
           "a\n## b", "## Page Content", "## Raw Capture\nx", "x\n## Why This Was Captured y", "\n## ", "a ### b #\\# c \\## \\\\ d\\", "##", "a\n#", "a\n##  ", "#\\\\## ## #\\#\\# "]
    rows = [(3 * i + k, t) for i, t in enumerate(odd) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["first_existing_section"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duck.execute(ORACLE_SQL["first_existing_section"]).fetchall()))
